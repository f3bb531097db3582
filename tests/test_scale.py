"""What a query must not do, so that its cost grows no faster than its input."""

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from slowtruth.functions import expr
from slowtruth.operators import learn, match, scan
from slowtruth.operators.models import KeyModels, Router, Settings
from slowtruth.operators.rules import AdaptiveRules, Cover, PageHinkley, Rule, RuleParams
from slowtruth.plans import catalog, evaluation
from slowtruth.sources import events, fixtures
from slowtruth.streaming import serving

from .conftest import SMALL


def test_no_text_is_made_of_the_side_that_is_not_read(spark):
    """The side is chosen before the messages are rendered, not among two rendered ones."""
    raw = fixtures.raw_messages(spark, SMALL).where("side = 'A'").select("body")
    plan = raw._jdf.queryExecution().optimizedPlan().toString()
    generated = [line for line in plan.split("\n") if "Generate" in line]
    assert generated and not any("StructsToJson" in line for line in generated)
    assert "side" in next(line for line in plan.split("\n") if "Filter" in line)


def test_unwrap_finds_escaped_keys_and_keeps_plain_texts(spark):
    rows = ['{"value": {"a": 1}}', '{"v\\u0061lue": {"a": 1}}', '{"a": "value"}', '{"a": {"value": 1}}', '{"value": null, "a": 1}', '{"a": 1', None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, body string")
    got = [r.u for r in df.select("i", events.unwrap(F.col("body")).alias("u")).orderBy("i").collect()]
    assert got == ['{"a":1}', '{"a":1}', rows[2], rows[3], None, rows[5], None]


def test_drift_runs_in_blocks_and_gives_what_a_row_loop_gives(spark, tiny_blocks, monkeypatch):
    """No key goes through one task; alarms in every block, in none, at block borders, numbers that are none, a null key."""
    monkeypatch.delattr(learn, "ordered_pass")
    noise = np.random.default_rng(4).random(300)
    series = {
        "often": noise + np.arange(300) % 40, "never": noise, "late": noise + (np.arange(300) > 200) * 9, None: noise * 30,
        "none": np.where(np.arange(300) == 150, np.nan, noise * 30), "short": noise[:1],
    }
    data = [(k, i, f"{k}-{i}", float(v)) for k, values in series.items() for i, v in enumerate(values)]
    staged = scan.stage_order(spark.createDataFrame(data, "k string, t long, name string, e double"), ["k"], ["t"])
    found = learn.drift_detect(staged, ["k"], "e", warmup=5, keep=["t", "name"]).collect()
    assert len(found) == len(data)
    by_row = {(r["k"], r["t"]): r for r in found}
    some = {}
    for k, values in series.items():
        test = PageHinkley(0.005, 35.0, 5)
        for i, v in enumerate(values.tolist()):
            alarm, r = test.add(v), by_row[k, i]
            assert r["name"] == f"{k}-{i}" and r["alarm"] == int(alarm)
            for got, want in ((r["running_mean"], test.mean), (r["excess"], test.cum - test.low)):
                assert got == want or (np.isnan(want) and (got is None or np.isnan(got)))
            some[k] = some.get(k, 0) + alarm
            if alarm:
                test.reset()
    assert some["often"] > 5 and some["never"] == 0 and some["late"] >= 1 and some[None] > 3


def _files(monkeypatch):
    """Labels and columns of the intermediate tables that are written from now on."""
    from slowtruth import session

    written, write = [], session.materialize

    def noted(df, label, *args, **kwargs):
        written.append((label, df.schema))
        return write(df, label, *args, **kwargs)

    for module in (catalog, learn, scan):
        monkeypatch.setattr(module, "materialize", noted)
    return written


def test_models_without_features_do_not_carry_them(spark, monkeypatch):
    written = _files(monkeypatch)
    pairs = catalog._matched(spark, SMALL, None)
    evaluation.stage_matched(pairs, features=False)
    request = dict(written)["events"]["a"].dataType
    assert not {"features", "x"} & set(request.names)
    # the bounds of the ranges are drawn from written rows, so that pairing runs once
    labels = [label for label, _ in written]
    assert labels.index("matched-unordered") < labels.index("matched")


def test_vector_in_place_of_the_map_gives_the_same_rows(spark):
    by_map, by_vector = (evaluation.matched_rows(catalog._matched(spark, SMALL, kind)) for kind in ("map", "vector"))
    assert by_map.columns == by_vector.columns
    assert by_map.exceptAll(by_vector).isEmpty() and by_vector.exceptAll(by_map).isEmpty()


def test_linear_model_writes_its_weights_and_no_unused_scores(spark, monkeypatch):
    staged = evaluation.stage_matched(catalog._matched(spark, SMALL))
    written = _files(monkeypatch)
    lean = learn.sgd_prequential(staged, ["steel_grade"], evaluation.X, "residual", keep_z=False)
    tables = dict(written)
    assert "weights" in tables and not [n for n in tables["affine"].names if n.endswith("_z")]
    assert "BroadcastHashJoin" in lean._jdf.queryExecution().sparkPlan().toString()
    full = learn.sgd_prequential(staged, ["steel_grade"], evaluation.X, "residual")
    assert lean.select("_rid", "sgd_residual").exceptAll(full.select("_rid", "sgd_residual")).isEmpty()


def _exchanged(df):
    """Of the plan of ``df``: how often rows are shuffled other than to be broadcast."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


def _same(found, expected):
    """The same rows but for the last digits, which go with the order in which Spark adds."""
    frames = [df.toPandas().sort_values(["slab_id", "pass_number"]).reset_index(drop=True) for df in (found, expected)]
    pd.testing.assert_frame_equal(frames[0], frames[1][frames[0].columns], rtol=1e-9, atol=1e-9)


def test_blocks_of_rows_in_order_are_neither_shuffled_nor_written_again(spark, monkeypatch):
    """The rows, with their answers as functions of the weights, were two thirds of what the linear model moved."""
    staged = evaluation.stage_matched(catalog._matched(spark, SMALL))
    assert scan.in_place(staged) and not scan.in_place(staged.repartition(3))
    written = _files(monkeypatch)
    rows = learn.sgd_prequential(staged, ["steel_grade"], evaluation.X, "residual", keep_z=False)
    assert _exchanged(rows) == 0
    assert all(not {"baseline", *evaluation.X} & set(schema.names) for _, schema in written)
    scored = scan.whole_blocks(rows, "sgd")
    assert scan.in_place(scored) and _exchanged(scan.ewma(scored, ["steel_grade"], {"sgd_residual": "s"}, 0.2)) == 0
    moved = learn.sgd_prequential(staged.repartition(3), ["steel_grade"], evaluation.X, "residual", keep_z=False)
    _same(rows, moved)


def test_blocks_that_came_apart_are_refused(spark, tiny_blocks):
    import pytest

    rows = spark.range(0, 64, 1, 1).select(F.lit("k").alias("k"), F.col("id").alias("x"))
    apart = scan.stage_order(rows, ["k"], ["x"]).where("x % 2 = 0").union(scan.stage_order(rows, ["k"], ["x"]).where("x % 2 = 1"))
    fake = scan.whole_blocks(apart.repartition(4), "apart")
    step = scan.ewma_step(None, {"x": "s"}, 0.2)
    step = scan.Step(None, ["x"], step.adds, lambda values, state: {"s_prior": scan.floats(values["x"]), "s": scan.floats(values["x"])})
    with pytest.raises(Exception, match="whole blocks"):
        scan.run_blocks(fake, ["k"], 3, [step]).collect()


def test_averages_in_place_are_those_of_the_window(spark, tiny_blocks):
    """Nulls add nothing, a null key is a key, a key may begin inside a block."""
    data = [(k, t, None if t % 7 == 3 else float(t * t % 11)) for k, n in (("a", 21), (None, 30), ("c", 5)) for t in range(n)]
    rows = spark.createDataFrame(data, "k string, t long, x double")
    whole, plain = (scan.ewma(scan.stage_order(rows, ["k"], ["t"], whole=w), ["k"], {"x": "s"}, 0.2) for w in (True, False))
    assert _exchanged(whole) == 0 < _exchanged(plain)
    columns = ["k", "t", "s", "s_prior"]
    found, expected = (df.toPandas()[columns].sort_values(["k", "t"], na_position="first").reset_index(drop=True) for df in (whole, plain))
    pd.testing.assert_frame_equal(found, expected, rtol=1e-12)


def test_the_learner_gets_its_rows_by_round_without_writing_them(spark, monkeypatch):
    """The z-scores of all rows were written for the rounds, 128 bytes a row."""
    monkeypatch.setattr(scan, "BLOCK_BITS", 5)
    pairs = catalog._matched(spark, SMALL).localCheckpoint()
    written = _files(monkeypatch)
    rounds = evaluation.prequential_eval(pairs, rows_per_round=500)[0]
    labels = [label for label, _ in written]
    assert labels.count("rules") > 2 and "rules-rounds" not in labels
    assert not {c for label, schema in written for c in schema.names if c.endswith("_z")}
    whole = evaluation.prequential_eval(pairs)[0]
    _same(rounds, whole)
    monkeypatch.setattr(learn, "SPANS", 0)
    many = evaluation.prequential_eval(pairs, rows_per_round=500)[0]
    assert "rules-rounds" in [label for label, _ in written]
    _same(many, whole)


def test_what_can_be_derived_is_not_staged(spark, monkeypatch):
    written = _files(monkeypatch)
    staged = evaluation.stage_matched(catalog._matched(spark, SMALL))
    for label in ("matched-unordered", "matched"):
        assert not {"residual", *evaluation.X[evaluation.MEASURED:]} & set(dict(written)[label].names)
    found = staged.select("slab_id", "pass_number", "residual", *evaluation.X)
    rows = expr.once(fixtures.requests(spark, SMALL), "v", expr.feature_vector(F.col("features")))
    rows = rows.select("slab_id", "pass_number", *[F.col("v")[i].alias(x) for i, x in enumerate(evaluation.X)])
    assert found.count() > 0 and found.drop("residual").exceptAll(rows).isEmpty()


def _covers(rule, row):
    return all((row[feature] > cut) == above for feature, above, cut in rule.literals)


def _plain_list(model, z, y):
    """The rule learner with its list searched from the top for every row."""
    found = []
    for row, target in zip(z, y):
        rule = next((r for r in model.rules if _covers(r, row)), model.default)
        found.append(model._step(rule, row, model.cover.codes(row[None, :]).tobytes(), target, float((row * row).sum())))
    return found


def test_rules_are_looked_up_by_bits_not_along_the_list():
    """Rules grow with the rows (a third of a key's rows at 1 GB has thousands): a search along the list is quadratic."""
    rng = np.random.default_rng(3)
    z = rng.normal(size=(30_000, 6))
    y = (300 * z[:, 0] * (z[:, 1] > 0.5) + rng.normal(size=len(z)) * 50 + np.where(np.arange(len(z)) > 20_000, 4000, 0)).tolist()
    params = RuleParams(n_min=20, tie=0.9)
    batches, whole, found = AdaptiveRules(6, params), AdaptiveRules(6, params), []
    for lo in range(0, len(z), 7000):
        if lo == 14_000:  # as between two rounds
            batches = AdaptiveRules.load(pickle.loads(pickle.dumps(batches.dump())))
        found += batches.answers(z[lo: lo + 7000], y[lo: lo + 7000])
    assert found == _plain_list(whole, z, y)
    assert batches.alarms > 10 and len(batches.rules) > 130
    assert [r.literals for r in batches.rules] == [r.literals for r in whole.rules]


def test_no_number_is_above_no_cut():
    z = np.array([[np.nan, 0.0], [0.05, 3.0], [0.06, -9.0], [1e300, np.inf]])
    rules = [Rule(2, RuleParams(), [literal]) for literal in ((0, True, 0.05), (0, False, -1.95), (1, True, 2.05), (1, False, 2.05))]
    cover = Cover(2, np.array(RuleParams().cuts), rules)
    expected = [next((i for i, r in enumerate(rules) if _covers(r, row)), -1) for row in z.tolist()]
    assert cover.first(cover.codes(z)).tolist() == expected == [cover.first(cover.codes(row[None]))[0] for row in z]


def test_states_of_waiting_rows_saved_before_are_read():
    rng = np.random.default_rng(5)
    z, y = rng.normal(size=(90, 4)), rng.normal(size=400).tolist()
    model = AdaptiveRules(4)
    model.answers(z, y)
    state = model.dump()
    state["default"]["waiting"] = list(zip(z, y))
    assert AdaptiveRules.load(state).default.waiting == model.default.waiting


def test_the_router_in_columns_is_the_router_row_by_row():
    rng = np.random.default_rng(6)
    b, a = rng.uniform(900, 1100, 2000), rng.uniform(900, 1100, 2000)
    a[5] = 0.0
    answers = rng.normal(size=2000) * 150
    rows, columns = Router(Settings()), Router(Settings())
    expected = [rows.step(*row) for row in zip(b.tolist(), answers.tolist(), a.tolist())]
    found = [columns.steps(b[lo: lo + 700], answers[lo: lo + 700], a[lo: lo + 700]) for lo in range(0, 2000, 700)]
    assert [np.concatenate(c).tolist() for c in zip(*found)] == [list(c) for c in zip(*expected)]
    assert (rows.model_trust, rows.baseline_trust) == (columns.model_trust, columns.baseline_trust)


class CountedState:
    """One value and the timers of a bucket, in memory; counts the calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        assert at not in self.timers
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def _one_by_one(waiting, events, ttl, watermark):
    """What becomes of one key's new events, event by event: (status, a_at, b_at, decided at)."""
    out = []
    lost = lambda e, status, at: out.append((status, *((e[0], None) if e[1] == "A" else (None, e[0])), at))
    for event in sorted(events):
        if event[0] <= watermark and watermark > 0:
            lost(event, "late", watermark + 1000)
            continue
        expired = waiting is not None and waiting[0] + ttl <= event[0]
        if waiting is None:
            waiting = event
        elif expired or waiting[1] == event[1]:
            lost(waiting, "orphan" if expired else "superseded", event[0])
            waiting = event
        else:
            a, b = (waiting, event) if waiting[1] == "A" else (event, waiting)
            out.append(("matched", a[0], b[0], event[0]))
            waiting = None
    return waiting, out


def test_a_bucket_of_keys_is_paired_with_a_few_calls_of_the_state():
    """A call for each event, over a socket, was nearly all of the live job's time."""
    rng, state, ttl = np.random.default_rng(8), CountedState(), 30_000_000
    processor = serving.PairProcessor(30.0)
    processor.init(state)
    waiting, found, expected, mark = {}, [], [], 0
    take = lambda frames, into: [into.append(r) for f in frames for r in f[
        ["slab_id", "pass_number", "status", "a_at", "b_at", "event_ts"]].itertuples(index=False)]
    for batch in range(6):
        at = (rng.integers(0, 100, 900) + 60 * batch) * 1_000_000
        rows = pd.DataFrame({
            "slab_id": rng.choice([f"s{k}" for k in range(40)] + [None], 900), "pass_number": rng.integers(1, 4, 900).astype("int32"), "at": at,
            "side": rng.choice(["A", "B"], 900), "steel_grade": "g", "x": [[1.0]] * 900, "baseline": 1.0, "actual": 2.0, "wear_level": 0.0})
        rows = rows.drop_duplicates(["slab_id", "pass_number", "at", "side"])
        state.calls = 0
        clock = type("Clock", (), {"getCurrentWatermarkInMs": staticmethod(lambda: mark)})
        take(processor.handleInputRows((0,), (rows.iloc[lo: lo + 100] for lo in range(0, len(rows), 100)), clock), found)
        assert state.calls <= 6
        for (slab, number), own in rows.groupby(["slab_id", "pass_number"], dropna=False):
            key = (slab if isinstance(slab, str) else None, number)
            waiting[key], out = _one_by_one(waiting.get(key), list(zip(own["at"], own["side"])), ttl, mark * 1000)
            expected += [(*key, *row) for row in out]
        mark = (60 * batch + 65) * 1000
        while any(t <= mark for t in state.timers):
            fired = min(state.timers)
            state.timers.remove(fired)
            expired = type("Timer", (), {"getExpiryTimeInMs": staticmethod(lambda: fired)})
            take(processor.handleExpiredTimer((0,), clock, expired), found)
        for key, event in waiting.items():
            if event is not None and event[0] + ttl <= mark * 1000:
                expected.append((*key, "orphan", *((event[0], None) if event[1] == "A" else (None, event[0])), event[0] + ttl))
                waiting[key] = None
        held = serving.unpacked(state.value[0]).to_pandas()
        assert sorted(zip(held["at"], held["side"])) == sorted(e for e in waiting.values() if e is not None)
        assert len(state.timers) == 1
    none = lambda v: None if pd.isna(v) else v
    got = [(none(r[0]), int(r[1]), r[2], none(r[3]), none(r[4]), r[5].value // 1000) for r in found]
    plain = [(r[0], int(r[1]), r[2], *[None if v is None else int(v) for v in r[3:]]) for r in expected]
    got = [(*r[:3], *[None if v is None else int(v) for v in r[3:]]) for r in got]
    assert sorted(got, key=str) == sorted(plain, key=str)
    assert {r[2] for r in got} == {"matched", "orphan", "superseded", "late"}


def test_models_in_columns_are_the_models_row_by_row():
    rng = np.random.default_rng(9)
    x, b, a = rng.normal(size=(1500, 5)), rng.uniform(900, 1100, 1500), rng.uniform(900, 1100, 1500)
    for challenger in ("rules", "linear", "offset"):
        rows, columns = KeyModels(5, challenger=challenger), KeyModels(5, challenger=challenger)
        expected = [rows.step(*row) for row in zip(x, b.tolist(), a.tolist())]
        found = [columns.steps(x[lo: lo + 400], b[lo: lo + 400], a[lo: lo + 400]) for lo in range(0, 1500, 400)]
        np.testing.assert_allclose([np.concatenate(c) for c in zip(*found)], [list(c) for c in zip(*expected)], rtol=1e-12)
        assert rows.dump() == columns.dump() or challenger == "rules"


def test_the_topic_of_a_replayed_stream_is_written_compressed(spark, monkeypatch):
    """Messages repeat their field names: as plain text they were nine tenths of all that the query wrote."""
    places, place = {}, catalog.new_path
    monkeypatch.setattr(catalog, "new_path", lambda spark, label: places.setdefault(label, place(spark, label)))
    rows = catalog.read_event_stream(spark, SMALL).count()
    files = [f.path for f in spark.read.format("binaryFile").load(places["topic"]).select("path", "length").collect()]
    assert rows > 0 and files and all(f.endswith(".lz4") for f in files)


def test_the_topics_of_the_live_job_are_written_compressed(spark, monkeypatch):
    """Both runs' messages: as plain text they were most of what the live job's queries wrote."""
    places, place = {}, catalog.new_path
    monkeypatch.setattr(catalog, "new_path", lambda spark, label: places.setdefault(label, place(spark, label)))
    monkeypatch.setattr(catalog, "_worked_off", lambda *args: None)
    monkeypatch.setattr(serving, "read_served", lambda *args: None)
    catalog._served(spark, SMALL)
    for side in "AB":
        files = [f.path for f in spark.read.format("binaryFile").load(places[f"topic-{side}"]).select("path", "length").collect()]
        assert files and all(f.endswith(".lz4") for f in files)


def test_passes_are_made_once_for_both_sides(spark):
    for features in (None, "map"):
        both = fixtures.both_sides(spark, SMALL, features)
        assert both._jdf.queryExecution().optimizedPlan().toString().count("Window") == 1
        if features is None:
            for side, expected in (("a", fixtures.requests(spark, SMALL, features=False)), ("b", fixtures.truths(spark, SMALL))):
                found = both.where(F.col("side") == side.upper()).select(f"{side}.*")
                assert found.columns == expected.columns
                assert found.exceptAll(expected).isEmpty() and expected.exceptAll(found).isEmpty()


def test_keys_and_times_of_events_are_sent_once(spark):
    pairs = match.pair_events(fixtures.requests(spark, SMALL, features=False), fixtures.truths(spark, SMALL), ["slab_id", "pass_number"])
    plan = pairs._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert sum("RepartitionByExpression" in line for line in plan) == 1
    sent = next(line for line in plan[next(i for i, line in enumerate(plan) if "RepartitionByExpression" in line):] if "Project" in line or "Union" in line)
    assert "ts#" not in sent.split("named_struct")[0] and "side#" not in sent.split("named_struct")[0]


def test_hashes_are_counted_only_in_full_buckets(spark, monkeypatch):
    from slowtruth.session import materialize

    written = []
    monkeypatch.setattr(match, "materialize", lambda df, label, *a, **k: written.append(label) or materialize(df, label, *a, **k))
    monkeypatch.setattr(match, "HOT_BUCKETS", 4)
    keys = spark.range(3000).select(F.when(F.col("id") < 1100, -1).otherwise(F.col("id")).alias("k"))
    hot = spark.range(1).select(F.xxhash64(F.lit(-1).cast("long")).alias("h")).first()["h"]
    assert match.hot_key_table(keys, ["k"], 2900).isEmpty() and written == ["hot-buckets"]
    assert [r[0] for r in match.hot_key_table(keys, ["k"], 1000).collect()] == [hot] and written[-1] == "hot-keys"
    assert match.hot_key_table(keys, ["k"], 1100).isEmpty()
