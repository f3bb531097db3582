"""Adaptive rule regression for one key, after Almeida, Ferreira and Gama (2013).

An ordered list of rules and a default rule. A rule is a conjunction of
``feature <= value`` / ``feature > value`` tests on z-scores and holds a mean, a
linear model trained by the delta rule, a faded error of each, a Page-Hinkley test
on its error and binned target sums from which it is specialised. Spark calls
``answers`` with batches of rows inside a keyed pass; nothing here knows about Spark.

Rules become more as rows go by, so the rule that answers a row is not searched along
the list: ``Cover`` holds for each feature and bin the rules that accept it there, as bits.
"""

from __future__ import annotations

import math
from array import array
from dataclasses import asdict, dataclass

import numpy as np


@dataclass(frozen=True)
class RuleParams:
    """All tuning knobs. The defaults are this package's own choice."""

    n_min: int = 200
    delta: float = 1e-7
    tie: float = 0.05
    drift_alpha: float = 0.005
    drift_threshold: float = 35.0
    drift_warmup: int = 30
    rate: float = 0.025
    rate_decay: float = 0.001
    fading: float = 0.99
    # Not at 0: a value equal to its running mean has a score of exactly 0 up to rounding.
    cuts: tuple[float, ...] = (-1.95, -1.45, -0.95, -0.45, 0.05, 0.55, 1.05, 1.55, 2.05)


class PageHinkley:
    """Signals a lasting increase of a series: cumulated deviation from the running mean minus its minimum."""

    __slots__ = ("alpha", "threshold", "warmup", "n", "mean", "cum", "low")

    def __init__(self, alpha: float, threshold: float, warmup: int = 30):
        self.alpha, self.threshold, self.warmup = alpha, threshold, warmup
        self.reset()

    def reset(self) -> None:
        self.n, self.mean, self.cum, self.low = 0, 0.0, 0.0, 0.0

    def add(self, value: float) -> bool:
        self.n += 1
        self.mean += (value - self.mean) / self.n
        self.cum += value - self.mean - self.alpha
        if self.cum < self.low:
            self.low = self.cum
        return self.n >= self.warmup and self.cum - self.low > self.threshold


class Rule:
    def __init__(self, width: int, params: RuleParams, literals=(), weights=None, bias=0.0):
        self.literals = list(literals)
        self.weights = np.zeros(width) if weights is None else weights.copy()
        self.bias = bias
        self.steps, self.place = 0, -1
        self.test = PageHinkley(params.drift_alpha, params.drift_threshold, params.drift_warmup)
        self.clear()

    def clear(self) -> None:
        """Forget the target sums and the rows waiting to be binned; keep the linear model."""
        self.n, self.total = 0, 0.0
        self.mean_error, self.linear_error, self.faded_n = 0.0, 0.0, 0.0
        self.bins = None
        # Of a waiting row only its bins and its target are kept: a byte for each feature, and a number.
        self.waiting, self.targets = bytearray(), array("d")


class Cover:
    """Which rules accept a row, as bits: a row's rules are the AND over its features, the first one answers.

    A row costs one word for each feature and 64 rules. A value's code is the number of cuts below it, one more than
    there are cuts for no number, which is above no cut.
    """

    WORDS, ROWS = 16, 2048

    def __init__(self, width: int, cuts: np.ndarray, rules: list[Rule]):
        self.width, self.cuts = width, cuts
        self.rules: list[Rule | None] = []  # in the order of the list; a dropped rule leaves its place empty
        self.table = np.zeros((width, len(cuts) + 2, 1 + len(rules) // 64), dtype=np.uint64)
        for rule in rules:
            self.append(rule)

    def codes(self, z: np.ndarray) -> np.ndarray:
        found = np.searchsorted(self.cuts, z.ravel(), side="left").astype(np.uint8).reshape(z.shape)
        found[np.isnan(z)] = len(self.cuts) + 1
        return found

    def append(self, rule: Rule) -> None:
        at = rule.place = len(self.rules)
        self.rules.append(rule)
        if at // 64 >= self.table.shape[2]:
            self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=2)
        self.table[:, :, at // 64] |= np.uint64(1 << at % 64)
        for literal in rule.literals:
            self.narrow(rule, literal)

    def drop(self, rule: Rule) -> None:
        self.rules[rule.place] = None
        self.table[:, :, rule.place // 64] &= self._others(rule)

    @staticmethod
    def _others(rule: Rule) -> np.uint64:
        return np.uint64(~(1 << rule.place % 64) & (2**64 - 1))

    def narrow(self, rule: Rule, literal) -> None:
        feature, above, cut = literal
        # code c holds the values from above cuts[c - 1] up to cuts[c]
        accepted = np.append((np.arange(len(self.cuts) + 1) > np.searchsorted(self.cuts, cut)) == above, not above)
        self.table[feature, ~accepted, rule.place // 64] &= self._others(rule)

    def first(self, codes: np.ndarray) -> np.ndarray:
        """Place of the first rule that accepts each row, -1 for none."""
        found = np.full(len(codes), -1)
        if len(codes) == 1:
            bits = np.bitwise_and.reduce(self.table[np.arange(self.width), codes[0]])
            word = int((bits != 0).argmax())
            held = int(bits[word])
            if held:
                found[0] = word * 64 + (held & -held).bit_length() - 1
            return found
        used = -(-len(self.rules) // 64)
        for lo in range(0, len(codes), self.ROWS):
            left = np.arange(lo, min(lo + self.ROWS, len(codes)))
            for word in range(0, used, self.WORDS):
                some, here = self.table[:, :, word: min(word + self.WORDS, used)], codes[left]
                bits = some[0][here[:, 0]]
                for feature in range(1, self.width):
                    bits &= some[feature][here[:, feature]]
                at = (bits != 0).argmax(axis=1)
                held = bits[np.arange(len(bits)), at]
                hit = held != 0
                held = held[hit]
                found[left[hit]] = (word + at[hit]) * 64 + np.bitwise_count((held & (~held + np.uint64(1))) - np.uint64(1))
                left = left[~hit]
                if not len(left):
                    break
        return found


class AdaptiveRules:
    """Predict first, then learn from the same row."""

    def __init__(self, width: int = 16, params: RuleParams = RuleParams()):
        self.width, self.params = width, params
        self.cuts = np.array(params.cuts)
        self.rules: list[Rule] = []
        self.default = Rule(width, params)
        self.count, self.y_mean, self.y_m2 = 0, 0.0, 0.0
        self.alarms, self.version = 0, 0
        self.cover = Cover(width, self.cuts, self.rules)

    def predict_and_train(self, z: np.ndarray, y: float) -> float:
        return self.answers(z[None, :], [y])[0]

    def answers(self, z: np.ndarray, y: list[float]) -> list[float]:
        """The answers to consecutive rows, each before training on its target.

        The rules that answer are looked up for all rows at once; when a rule changes, again for the later rows it had.
        """
        cover, rules = self.cover, self.cover.rules
        codes = cover.codes(z)
        raw, width = codes.tobytes(), self.width
        own = cover.first(codes)
        norms = (z * z).sum(axis=1).tolist()
        found, version = [], self.version
        for at, values in enumerate(z):
            place = own[at]
            rule = rules[place] if place >= 0 else self.default
            found.append(self._step(rule, values, raw[at * width: at * width + width], y[at], norms[at]))
            if self.version != version:
                version = self.version
                later = slice(at + 1, None)
                # one rule differs: only the rows it had can go elsewhere, unless places were given anew
                moved = np.arange(at + 1, len(z)) if self.cover is not cover else at + 1 + np.flatnonzero(own[later] == place)
                cover, rules = self.cover, self.cover.rules
                if len(moved):
                    own[moved] = cover.first(codes[moved])
        return found

    def _step(self, rule: Rule, z: np.ndarray, codes: bytes, y: float, norm: float) -> float:
        """Answer by, and train, the given owner; ``norm`` is the squared length of z."""
        mean = rule.total / rule.n if rule.n else 0.0
        linear = rule.bias + float(rule.weights.dot(z))
        answer = mean if rule.mean_error < rule.linear_error else linear
        self._train(rule, z, codes, y, norm, mean, linear, answer)
        return answer

    def _train(self, rule: Rule, z, codes, y, norm, mean, linear, answer) -> None:
        p = self.params
        self.count += 1
        gap = y - self.y_mean
        self.y_mean += gap / self.count
        self.y_m2 += gap * (y - self.y_mean)
        spread = math.sqrt(self.y_m2 / (self.count - 1)) if self.count > 1 else 0.0
        if spread > 0.0 and rule.test.add(abs(y - answer) / spread):
            self.alarms += 1
            self._prune(rule)
            return
        rule.faded_n = rule.faded_n * p.fading + 1.0
        rule.mean_error = rule.mean_error * p.fading + abs(y - mean)
        rule.linear_error = rule.linear_error * p.fading + abs(y - linear)
        # Delta rule towards the target; the step shrinks for outlying rows so that it cannot overshoot.
        rate = p.rate / (1.0 + p.rate_decay * rule.steps)
        step = rate / max(1.0, rate * (1.0 + norm)) * (y - linear)
        rule.weights += step * z
        rule.bias += step
        rule.steps += 1
        rule.n += 1
        rule.total += y
        rule.waiting += codes
        rule.targets.append(y)
        if rule.n % p.n_min == 0:
            self._expand(rule)

    def _prune(self, rule: Rule) -> None:
        """A rule whose error has lastingly grown is dropped; the default rule starts afresh."""
        self.version += 1
        if rule is self.default:
            self.default = Rule(self.width, self.params)
        else:
            self.rules.remove(rule)
            self.cover.drop(rule)
            if len(self.cover.rules) > 64 + 2 * len(self.rules):
                self.cover = Cover(self.width, self.cuts, self.rules)

    def _expand(self, rule: Rule) -> None:
        """Compare the best two splits by standard-deviation reduction under a Hoeffding bound."""
        self._bin(rule)
        best = self._best_splits(rule.bins)
        if best is None:
            return
        (gain, feature, cut, above), second = best
        bound = math.sqrt(math.log(1.0 / self.params.delta) / (2.0 * rule.n))
        if gain <= 0.0 or not (second / gain + bound < 1.0 or bound < self.params.tie):
            return
        self.version += 1
        literal = (feature, above, float(self.cuts[cut]))
        if rule is self.default:
            self.rules.append(Rule(self.width, self.params, [literal], rule.weights, rule.bias))
            self.cover.append(self.rules[-1])
            self.default = Rule(self.width, self.params, (), rule.weights, rule.bias)
        else:
            rule.literals.append(literal)
            self.cover.narrow(rule, literal)
            rule.clear()

    def _bin(self, rule: Rule) -> None:
        if rule.bins is None:
            rule.bins = np.zeros((3, self.width, len(self.cuts) + 1))
        codes, ys = np.frombuffer(rule.waiting, dtype=np.uint8).reshape(-1, self.width), np.array(rule.targets)
        rule.waiting, rule.targets = bytearray(), array("d")
        slots = np.minimum(codes, len(self.cuts)) + np.arange(self.width) * (len(self.cuts) + 1)
        size = self.width * (len(self.cuts) + 1)
        for i, weight in enumerate((np.ones_like(ys), ys, ys * ys)):
            sums = np.bincount(slots.ravel(), np.repeat(weight, self.width), size)
            rule.bins[i] += sums.reshape(self.width, -1)

    @staticmethod
    def _best_splits(bins):
        left = np.cumsum(bins, axis=2)[:, :, :-1]
        whole = bins.sum(axis=2)[:, :, None]
        right = whole - left

        def deviation(part):
            n = np.maximum(part[0], 1.0)
            return np.sqrt(np.maximum(part[2] / n - (part[1] / n) ** 2, 0.0))

        usable = (left[0] > 0) & (right[0] > 0)
        if not usable.any():
            return None
        low, high = deviation(left), deviation(right)
        n = whole[0]
        gain = np.where(usable, deviation(whole) - left[0] / n * low - right[0] / n * high, -np.inf)
        per_feature = gain.max(axis=1)
        order = np.argsort(-per_feature, kind="stable")
        feature = int(order[0])
        cut = int(gain[feature].argmax())
        second = float(per_feature[order[1]]) if len(order) > 1 else 0.0
        above = bool(high[feature, cut] < low[feature, cut])
        return (float(gain[feature, cut]), feature, cut, above), max(second, 0.0)

    # --- state as plain values, for state stores and resume tables ---

    def dump(self) -> dict:
        def rule_state(r: Rule) -> dict:
            return {
                "literals": r.literals, "weights": r.weights, "bias": r.bias, "steps": r.steps, "n": r.n,
                "total": r.total, "errors": (r.mean_error, r.linear_error, r.faded_n), "bins": r.bins,
                "waiting": (bytes(r.waiting), r.targets.tolist()), "test": (r.test.n, r.test.mean, r.test.cum, r.test.low),
            }

        return {
            "params": asdict(self.params), "width": self.width, "target": (self.count, self.y_mean, self.y_m2),
            "alarms": self.alarms, "rules": [rule_state(r) for r in self.rules], "default": rule_state(self.default),
        }

    @classmethod
    def load(cls, state: dict) -> AdaptiveRules:
        model = cls(state["width"], RuleParams(**state["params"]))
        model.count, model.y_mean, model.y_m2 = state["target"]
        model.alarms = state["alarms"]

        def rule(s: dict) -> Rule:
            r = Rule(model.width, model.params, s["literals"], s["weights"], s["bias"])
            r.steps, r.n, r.total, r.bins = s["steps"], s["n"], s["total"], s["bins"]
            if isinstance(s["waiting"], list):  # saved when whole rows waited
                rows = np.array([z for z, _ in s["waiting"]]).reshape(-1, model.width)
                r.waiting, r.targets = bytearray(model.cover.codes(rows).tobytes()), array("d", [y for _, y in s["waiting"]])
            else:
                r.waiting, r.targets = bytearray(s["waiting"][0]), array("d", s["waiting"][1])
            r.mean_error, r.linear_error, r.faded_n = s["errors"]
            r.test.n, r.test.mean, r.test.cum, r.test.low = s["test"]
            return r

        model.rules = [rule(s) for s in state["rules"]]
        model.default = rule(state["default"])
        model.cover = Cover(model.width, model.cuts, model.rules)
        return model
