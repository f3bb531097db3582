"""Row-by-row state of one key's model set, and block kernels of the linear model.

``KeyModels`` is the small per-key step that the streaming query and the resumable
batch pass share. The block kernels express the same linear model as affine maps, so
that Spark can treat the blocks of one key in parallel.
"""

from __future__ import annotations

import pickle
from dataclasses import asdict, dataclass, field

import numpy as np

from slowtruth.operators.rules import AdaptiveRules, PageHinkley, RuleParams


@dataclass(frozen=True)
class Settings:
    """Model and router settings. The defaults of the original service."""

    mean_rate: float = 0.02
    sgd_rate: float = 0.001
    sgd_decay: float = 0.00001
    overpress: float = 0.25
    underpress: float = 0.20
    trust_rate: float = 0.2
    trust_tolerance: float = 3.0
    rules: RuleParams = field(default_factory=RuleParams)


def ape(predicted: float, actual: float) -> float:
    return 0.0 if actual == 0.0 else abs((actual - predicted) / actual) * 100.0


def apes(predicted: np.ndarray, actual: np.ndarray) -> np.ndarray:
    zero = actual == 0.0
    return np.where(zero, 0.0, np.abs((actual - predicted) / np.where(zero, 1.0, actual)) * 100.0)


class Router:
    """Sends the challenger's force through, or the baseline when the challenger is unsafe or untrusted.

    Trust follows the challenger's raw error, so routing never feeds back into it.
    """

    def __init__(self, settings: Settings, model_trust: float = 0.0, baseline_trust: float = 0.0):
        self.settings, self.model_trust, self.baseline_trust = settings, model_trust, baseline_trust

    def step(self, baseline: float, predicted_residual: float, actual: float):
        s = self.settings
        unsafe = predicted_residual > baseline * s.overpress or predicted_residual < -(baseline * s.underpress)
        untrusted = self.model_trust > self.baseline_trust + s.trust_tolerance
        fallback = unsafe or untrusted
        raw = baseline + predicted_residual
        routed = baseline if fallback else raw
        shadow, base = ape(raw, actual), ape(baseline, actual)
        self.model_trust = s.trust_rate * shadow + (1.0 - s.trust_rate) * self.model_trust
        self.baseline_trust = s.trust_rate * base + (1.0 - s.trust_rate) * self.baseline_trust
        return routed, int(fallback), base, shadow, ape(routed, actual)

    def steps(self, baseline: np.ndarray, predicted_residual: np.ndarray, actual: np.ndarray):
        """``step`` over consecutive rows, column by column; only the two trusts go from row to row."""
        s = self.settings
        raw = baseline + predicted_residual
        shadow, base = apes(raw, actual), apes(baseline, actual)
        rate, kept, untrusted = s.trust_rate, 1.0 - s.trust_rate, []
        model, held = self.model_trust, self.baseline_trust
        for of_model, of_baseline in zip(shadow.tolist(), base.tolist()):
            untrusted.append(model > held + s.trust_tolerance)
            model = rate * of_model + kept * model
            held = rate * of_baseline + kept * held
        self.model_trust, self.baseline_trust = model, held
        unsafe = (predicted_residual > baseline * s.overpress) | (predicted_residual < -(baseline * s.underpress))
        fallback = unsafe | np.array(untrusted, dtype=bool)
        routed = np.where(fallback, baseline, raw)
        return routed, fallback.astype(int), base, shadow, apes(routed, actual)


class KeyModels:
    """The whole model set of one key: offset, scaler, linear model, rules and router.

    The step order is part of the meaning: every model answers before it sees the target. ``challenger`` names the model
    that the router guards: ``rules``, ``linear`` or ``offset``. The rules learn only as the challenger.
    """

    def __init__(self, width: int = 16, settings: Settings = Settings(), challenger: str = "rules"):
        self.width, self.settings, self.challenger = width, settings, challenger
        self.offset = 0.0
        self.n, self.mean, self.m2 = 0, np.zeros(width), np.zeros(width)
        self.weights, self.bias = np.zeros(width), 0.0
        self.rules = AdaptiveRules(width, settings.rules)
        self.router = Router(settings)

    def scale(self, x: np.ndarray) -> np.ndarray:
        self.n += 1
        delta = x - self.mean
        self.mean = self.mean + delta / self.n
        self.m2 = self.m2 + delta * (x - self.mean)
        if self.n < 2:
            return np.zeros(self.width)
        sd = np.sqrt(self.m2 / (self.n - 1))
        return np.where(sd > 1e-8, (x - self.mean) / np.where(sd > 1e-8, sd, 1.0), 0.0)

    def step(self, x: np.ndarray, baseline: float, actual: float) -> tuple:
        """The computed columns of one result row, in order: three forces, five errors, the flag."""
        s = self.settings
        residual = actual - baseline
        answer = self.offset
        mean_force = baseline + answer
        self.offset = s.mean_rate * residual + (1.0 - s.mean_rate) * self.offset
        z = self.scale(x)
        linear = self.bias + float(self.weights @ z)
        sgd_force = baseline + linear
        error = actual - sgd_force
        self.bias += s.sgd_rate * error
        self.weights = (1.0 - s.sgd_decay) * self.weights + s.sgd_rate * error * z
        if self.challenger != "offset":
            answer = linear if self.challenger == "linear" else self.rules.predict_and_train(z, residual)
        routed, flag, base, shadow, safe = self.router.step(baseline, answer, actual)
        return (
            mean_force, sgd_force, routed, base, ape(mean_force, actual), ape(sgd_force, actual), safe, shadow, flag
        )

    def steps(self, x: np.ndarray, baseline: np.ndarray, actual: np.ndarray) -> tuple:
        """``step`` over consecutive rows, column by column: what does not go from row to row is done for all at once."""
        s = self.settings
        residual, n = actual - baseline, len(x)
        rate, kept, offsets = s.mean_rate, 1.0 - s.mean_rate, []
        for r in residual.tolist():
            offsets.append(self.offset)
            self.offset = rate * r + kept * self.offset
        means, squares, mean, m2 = np.empty_like(x), np.empty_like(x), self.mean, self.m2
        for i, row in enumerate(x):
            self.n += 1
            delta = row - mean
            mean = means[i] = mean + delta / self.n
            m2 = squares[i] = m2 + delta * (row - mean)
        self.mean, self.m2 = mean.copy(), m2.copy()
        seen = np.arange(self.n - n + 1, self.n + 1)[:, None]
        sd = np.sqrt(squares / np.maximum(seen - 1, 1))
        wide = (sd > 1e-8) & (seen >= 2)
        z = np.where(wide, (x - means) / np.where(wide, sd, 1.0), 0.0)
        linear, keep = [], 1.0 - s.sgd_decay
        for row, b, a in zip(z, baseline.tolist(), actual.tolist()):
            answer = self.bias + float(self.weights @ row)
            error = a - (b + answer)
            self.bias += s.sgd_rate * error
            self.weights = keep * self.weights + s.sgd_rate * error * row
            linear.append(answer)
        answers = {"offset": offsets, "linear": linear}.get(self.challenger)
        if answers is None:
            answers = self.rules.answers(z, residual.tolist())
        mean_force, sgd_force = baseline + np.array(offsets), baseline + np.array(linear)
        routed, flag, base, shadow, safe = self.router.steps(baseline, np.array(answers), actual)
        return mean_force, sgd_force, routed, base, apes(mean_force, actual), apes(sgd_force, actual), safe, shadow, flag

    def dump(self) -> bytes:
        state = {
            "width": self.width, "settings": asdict(self.settings), "offset": self.offset,
            "scaler": (self.n, self.mean, self.m2), "linear": (self.weights, self.bias),
            "rules": self.rules.dump(), "trust": (self.router.model_trust, self.router.baseline_trust),
            "challenger": self.challenger,
        }
        return pickle.dumps(state)

    @classmethod
    def load(cls, blob: bytes) -> KeyModels:
        state = pickle.loads(blob)
        raw = dict(state["settings"])
        raw["rules"] = RuleParams(**raw["rules"])
        model = cls(state["width"], Settings(**raw), state.get("challenger", "rules"))
        model.offset = state["offset"]
        model.n, model.mean, model.m2 = state["scaler"]
        model.weights, model.bias = state["linear"]
        model.rules = AdaptiveRules.load(state["rules"])
        model.router = Router(model.settings, *state["trust"])
        return model


class RulesAndRouter:
    """The part of the model set that cannot be split: rule learner, then router, over scored rows."""

    def __init__(self, columns: list[str], settings: Settings):
        self.columns, self.settings = columns, settings
        self.rules, self.router = AdaptiveRules(len(columns), settings.rules), Router(settings)

    def run(self, pdf):
        z = np.column_stack([pdf[c].to_numpy(dtype=float) for c in self.columns])
        baseline, actual = pdf["baseline"].to_numpy(dtype=float), pdf["actual"].to_numpy(dtype=float)
        answers = np.array(self.rules.answers(z, (actual - baseline).tolist()))
        routed = self.router.steps(baseline, answers, actual)
        out = pdf.drop(columns=self.columns)
        names = ["rules_residual", "routed_force", "fallback", "baseline_ape", "shadow_ape", "safe_ape"]
        for name, values in zip(names, (answers, *routed)):
            out[name] = values
        return out

    def dump(self) -> bytes:
        return pickle.dumps((self.rules.dump(), self.router.model_trust, self.router.baseline_trust))

    def load(self, blob: bytes) -> None:
        rules, *trust = pickle.loads(blob)
        self.rules, self.router = AdaptiveRules.load(rules), Router(self.settings, *trust)


class DriftDetector:
    """Page-Hinkley over one column; an alarm resets the test."""

    def __init__(self, alpha: float, threshold: float, warmup: int, state: tuple | None = None):
        self.test = PageHinkley(alpha, threshold, warmup)
        if state is not None:
            t = self.test
            t.n, t.mean, t.cum, t.low = state

    def state(self) -> tuple[int, float, float, float]:
        t = self.test
        return t.n, t.mean, t.cum, t.low

    def run(self, values: np.ndarray) -> tuple[list, list, list]:
        """Running mean, excess over the minimum and alarm of each value."""
        means, sums, alarms = [], [], []
        for value in values.tolist():
            alarm = self.test.add(value)
            means.append(self.test.mean)
            sums.append(self.test.cum - self.test.low)
            alarms.append(int(alarm))
            if alarm:
                self.test.reset()
        return means, sums, alarms

    def alarms(self, values: np.ndarray, known: frozenset = frozenset()) -> tuple[list[int], bool]:
        """Positions of the alarms, and whether the last is one of ``known``, after which values are not looked at."""
        found, test = [], self.test
        for i, value in enumerate(values.tolist()):
            if test.add(value):
                test.reset()
                found.append(i)
                if i in known:
                    return found, True
        return found, False


# --- linear model as affine maps ---------------------------------------------------------------
#
# With v = (weights, bias) and u = (z, 1), one row maps v to D v + rate * u * (y - u.v), where D
# decays the weights but not the bias. Maps of consecutive rows compose, so a block of rows is one
# matrix and one vector. Inside a block the rows are cut into strips that advance side by side.

STRIP = 128


def running_scores(x: np.ndarray, n0: int, mean0, m20) -> np.ndarray:
    """z-scores of consecutive rows against all earlier rows and themselves.

    (n0, mean0, m20) are the moments before the first row. Strips of rows advance side by side by
    Welford's update; the moments before each strip are merged in afterwards.
    """
    n, width = x.shape
    count = -(-n // STRIP)
    padded = np.concatenate([x, np.repeat(x[-1:], count * STRIP - n, axis=0)]).reshape(count, STRIP, width)
    mean, m2 = np.zeros((count, STRIP, width)), np.zeros((count, STRIP, width))
    mu, q = np.zeros((count, width)), np.zeros((count, width))
    for t in range(STRIP):
        delta = padded[:, t] - mu
        mu = mu + delta / (t + 1)
        q = q + delta * (padded[:, t] - mu)
        mean[:, t], m2[:, t] = mu, q
    start_n = np.empty(count)
    start_mean, start_m2 = np.empty((count, width)), np.empty((count, width))
    held_n, held_mean, held_m2 = float(n0), np.asarray(mean0, dtype=float), np.asarray(m20, dtype=float)
    for i in range(count):
        start_n[i], start_mean[i], start_m2[i] = held_n, held_mean, held_m2
        total, delta = held_n + STRIP, mean[i, -1] - held_mean
        held_mean = held_mean + delta * STRIP / total
        held_m2 = held_m2 + m2[i, -1] + delta * delta * held_n * STRIP / total
        held_n = total
    here = np.arange(1, STRIP + 1)[None, :, None]
    total = start_n[:, None, None] + here
    delta = mean - start_mean[:, None, :]
    share = here / total
    m2 += start_m2[:, None, :] + delta * delta * start_n[:, None, None] * share
    mean = start_mean[:, None, :] + delta * share
    sd = np.sqrt(m2 / np.maximum(total - 1, 1))
    wide = (sd > 1e-8) & (total >= 2)
    z = np.where(wide, (padded - mean) / np.where(wide, sd, 1.0), 0.0)
    return z.reshape(-1, width)[:n]


def _strips(z: np.ndarray, y: np.ndarray):
    n, width = z.shape
    count = -(-n // STRIP)
    u = np.zeros((count * STRIP, width + 1))
    u[:n, :width], u[:n, width] = z, 1.0
    target = np.zeros(count * STRIP)
    target[:n] = y
    real = np.zeros(count * STRIP, dtype=bool)
    real[:n] = True
    return u.reshape(count, STRIP, -1), target.reshape(count, STRIP), real.reshape(count, STRIP)


def _decay(width: int, decay: float) -> np.ndarray:
    d = np.full(width + 1, 1.0 - decay)
    d[width] = 1.0
    return d


def linear_affine(z, y, rate: float, decay: float) -> tuple[np.ndarray, np.ndarray]:
    """The linear model over a block of rows without its start: what every row's answer, and the model after the block, are of it.

    A training step is an affine map of (weights, bias), and an answer is an affine function of them. Row ``i`` answers
    ``coef[i, :-1] @ start + coef[i, -1]``; after the block the model is ``end[:, :-1] @ start + end[:, -1]``. Strips of rows
    advance side by side, each from a start of its own, and are then put behind one another.
    """
    u, target, real = _strips(z, y)
    seen = np.zeros((*u.shape[:2], u.shape[2] + 1))
    maps = _strip_maps(u, target, real, rate, decay, seen)
    start = np.eye(u.shape[2], u.shape[2] + 1)
    coef = np.empty_like(seen)
    for strip, own in enumerate(seen):
        coef[strip] = chained(start, own)
        start = chained(start, maps[strip])
    return coef.reshape(-1, u.shape[2] + 1)[: len(y)], start


def _strip_maps(u, target, real, rate: float, decay: float, seen: np.ndarray | None = None) -> np.ndarray:
    """The affine map of each strip; in ``seen`` what each row answers of the strip's start."""
    count, _, size = u.shape
    keep = _decay(size - 1, decay)[None, :, None]
    maps = np.zeros((count, size, size + 1))
    maps[:, range(size), range(size)] = 1.0
    tail = int(real[-1].sum())
    for t in range(STRIP):
        # Only the last strip can be short; past its end the others go on without it.
        live = count if t < tail else count - 1
        m, ut = maps[:live], u[:live, t]
        answer = np.matmul(ut[:, None, :], m)
        if seen is not None:
            seen[:live, t] = answer[:, 0]
        answer[:, 0, -1] -= target[:live, t]
        m *= keep
        m -= (rate * ut)[:, :, None] * answer
    return maps


def linear_end(z, y, rate: float, decay: float) -> np.ndarray:
    """Of ``linear_affine`` only the model after the block."""
    u, target, real = _strips(z, y)
    end = np.eye(u.shape[2], u.shape[2] + 1)
    for own in _strip_maps(u, target, real, rate, decay):
        end = chained(end, own)
    return end


def linear_answers(z, y, start, rate: float, decay: float) -> np.ndarray:
    """The answers to the rows of a block by the model ``start`` (weights, and bias last), each before learning from its row.

    The maps of the strips give the model that each starts from; then all strips run at once.
    """
    u, target, real = _strips(z, y)
    count, _, size = u.shape
    held, keep = np.empty((count, size)), _decay(size - 1, decay)
    held[0] = start
    for strip, own in enumerate(_strip_maps(u[:-1], target[:-1], real[:-1], rate, decay) if count > 1 else ()):
        held[strip + 1] = own[:, :-1] @ held[strip] + own[:, -1]
    found = np.empty((count, STRIP))
    for t in range(STRIP):
        ut = u[:, t]
        found[:, t] = answer = (ut * held).sum(axis=1)
        held = keep * held + (rate * (target[:, t] - answer))[:, None] * ut
    return found.ravel()[: len(y)]


def chained(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """One affine map after another."""
    out = then[:, :-1] @ first
    out[:, -1] += then[:, -1]
    return out
