"""The live job equals the batch plans, across a restart; pairing keeps its own deadlines."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from slowtruth.operators import match
from slowtruth.operators.models import KeyModels
from slowtruth.plans import catalog, evaluation
from slowtruth.sources import events, fixtures, sinks
from slowtruth.streaming import serving

from .conftest import SMALL

WAIT = 600


def test_served_rows_equal_batch_after_restart(spark):
    """Messages that come in the second run although they belong in the first change nothing, but for those behind the watermark."""
    served = catalog.serve_stream(spark, SMALL).toPandas()
    raw = fixtures.raw_messages(spark, SMALL)
    middle = F.lit(catalog.SERVED_MIDDLE).cast("timestamp_ntz")
    readable = F.get_json_object("body", "$").isNotNull()
    mark = raw.where(readable & ~F.col("delayed") & (F.col("sent_at") < middle)).agg(F.max("sent_at") - F.expr("INTERVAL 5 MINUTES")).first()[0]
    late = F.col("delayed") & (F.col("sent_at") <= F.lit(mark))
    assert raw.where(late & readable).count() > 10
    raw = raw.where(~late)
    sides = [events.decode_events(raw.where(F.col("side") == s), k) for s, k in (("A", "request"), ("B", "truth"))]
    batch, _ = evaluation.prequential_eval(match.match_pairs(match.pair_events(*sides, ["slab_id", "pass_number"])))
    batch = batch.toPandas()
    assert tuple(served.columns) == evaluation.RESULT_COLUMNS and len(served) == len(batch)
    order = ["slab_id", "pass_number"]
    served, batch = (f.sort_values(order).reset_index(drop=True) for f in (served, batch))
    for c in evaluation.RESULT_COLUMNS[4:]:
        np.testing.assert_allclose(served[c], batch[c], rtol=1e-9, atol=1e-6, err_msg=c)
    assert (served["evaluation_timestamp"] == batch["evaluation_timestamp"]).all()


SCHEMA = (
    "slab_id string, pass_number int, ts timestamp, side string, steel_grade string, x array<double>, "
    "baseline double, actual double, wear_level double, at long"
)
T0 = datetime(2024, 1, 1)
BASE = int((T0 - datetime(1970, 1, 1)).total_seconds())


def work_off(spark, tmp_path, rows, then=lambda df: df):
    """Add one file of events and work it off; returns all results so far."""
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    serving.use_stream_settings(spark)
    query = (
        then(serving.pair_stream(spark.readStream.schema(SCHEMA).parquet(source)))
        .writeStream.option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).foreachBatch(sinks.batch_writer(str(tmp_path / "out"))).start()
    )
    assert query.awaitTermination(WAIT) and query.exception() is None
    return spark.read.parquet(str(tmp_path / "out"))


def feed(spark, tmp_path, plan):
    """The same for (slab, side, second) events."""
    rows = [
        (s, 1, T0 + timedelta(seconds=at), side, "g", [float(at)], 1.0, 2.0, 0.0, (BASE + at) * 1_000_000)
        for s, side, at in plan
    ]
    found = work_off(spark, tmp_path, rows)
    return {
        (r["slab_id"], r["status"], *[None if v is None else v // 1_000_000 - BASE for v in (r["a_at"], r["b_at"])])
        for r in found.collect()
    }


def test_orphan_behind_the_watermark_after_a_restart(spark, tmp_path):
    """The first run ends between an event's time and its deadline; the second one purges it."""
    feed(spark, tmp_path, [("x", "A", 0), ("y", "A", 400)])
    found = feed(spark, tmp_path, [("y", "B", 410), ("end", "A", 100_000)])
    assert found == {("x", "orphan", 0, None), ("y", "matched", 400, 410)}


def test_pairing_cases(spark, tmp_path):
    """Early truth, replaced request, own deadline, exact limit; a late sentinel moves the watermark on."""
    plan = [
        ("early", "B", 0), ("early", "A", 1),
        ("twice", "A", 0), ("twice", "A", 5), ("twice", "B", 9),
        ("own", "A", 0), ("own", "A", 290), ("own", "B", 310),
        ("limit", "A", 0), ("limit", "B", 300),
        ("alone", "A", 20),
        ("sentinel", "A", 86_400),
    ]
    found = feed(spark, tmp_path, plan)
    assert found == {
        ("alone", "orphan", 20, None),
        ("early", "matched", 1, 0),
        ("limit", "orphan", 0, None),
        ("limit", "orphan", None, 300),
        ("own", "matched", 290, 310),
        ("own", "superseded", 0, None),
        ("twice", "matched", 5, 9),
        ("twice", "superseded", 0, None),
    }


def test_late_events_are_rows(spark, tmp_path):
    """Behind the watermark of the run before: they leave as they came, pair with nothing and do not touch what waits."""
    feed(spark, tmp_path, [("x", "A", 0), ("y", "A", 1000)])  # the watermark is at 700
    found = feed(spark, tmp_path, [("x", "B", 5), ("y", "B", 700), ("z", "A", 701), ("y", "B", 1010)])
    assert found == {
        ("x", "orphan", 0, None), ("x", "late", None, 5), ("y", "late", None, 700), ("y", "matched", 1000, 1010),
    }
    assert [r.key.slab_id for r in serving.waiting_events(spark, str(tmp_path / "cp")).collect()] == ["z"]


def passes(n, seed=4):
    """Requests and truths of passes that come every ten seconds, as rows of the tagged stream."""
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        at, truth = 10 * i, 10 * i + int(r.integers(-4, 8))  # a truth may come before its request
        x, base = r.normal(size=4), float(r.uniform(900, 1100))
        grade, actual = ("g", "h")[i % 3 == 0], float(base + 30 * x[0] + r.normal())
        out.append([(f"s{i}", 1, T0 + timedelta(seconds=t), side, *rest, (BASE + t) * 1_000_000) for t, side, *rest in (
            (at, "A", grade, x.tolist(), base, None, None), (truth, "B", None, None, None, actual, 1.5))])
    return out


def in_order(sent, challenger):
    """(slab, computed columns) of each pass, by one model set for each grade in the order of measurement."""
    out, models = {}, {}
    for a, b in sorted(sent, key=lambda m: (m[1][-1], m[1][0])):
        model = models.setdefault(a[4], KeyModels(len(a[5]), challenger=challenger))
        out[a[0]] = model.step(np.array(a[5]), a[6], b[7])
    return out


def check_served(rows, expected):
    found = {r.slab_id: [r[c] for c in serving._COMPUTED] for r in rows}
    assert found.keys() == expected.keys()
    for slab in expected:
        np.testing.assert_allclose(found[slab], expected[slab], rtol=1e-9, atol=1e-9)


def test_order_of_arrival_does_not_matter(spark, tmp_path):
    """Messages arrive up to 280 seconds late, in any batch; models still learn in the order of measurement."""
    sent = passes(150)
    r = np.random.default_rng(1)
    batches = [[], [], [], []]
    for message in (m for pair in sent for m in pair):
        second = message[-1] // 1_000_000 - BASE
        batches[min(3, int((second + r.integers(0, 280)) // 400))].append(message)
    assert any(a[-1] < b[-1] for b in batches[0] for a in batches[1])
    end = [("end", 1, T0 + timedelta(days=1), "A", "g", [0.0] * 4, 1.0, None, None, (BASE + 86_400) * 1_000_000)]
    serve = lambda df: serving.evaluate_stream(df, challenger="linear", stretch=45.0)
    for batch in batches:
        found = work_off(spark, tmp_path, [batch[k] for k in r.permutation(len(batch))], serve)
    expected = in_order(sent, "linear")
    early = {x.slab_id: x for x in found.where("kind = 'matched'").collect()}
    held = {x.slab_id for x in serving.held_rows_of(spark, str(tmp_path / "cp")).select("slab_id").collect()}
    assert 0 < len(early) < 150 and early.keys() | held == expected.keys() and not early.keys() & held
    found = work_off(spark, tmp_path, end, serve)
    check_served(found.where("kind = 'matched'").collect(), expected)
    assert serving.held_rows_of(spark, str(tmp_path / "cp")).count() == 0


class FakeState:
    """What the processor uses of its handle, in memory."""

    def __init__(self):
        self.maps, self.value, self.timers = {}, None, []

    def getValueState(self, name, schema):
        return self

    def getMapState(self, name, *schema):
        held = self.maps.setdefault(name, {})
        return type("Map", (), {
            "getValue": staticmethod(held.get), "updateValue": staticmethod(held.__setitem__),
            "removeKey": staticmethod(held.pop), "keys": staticmethod(lambda: iter(list(held)))})

    def registerTimer(self, at):
        self.timers.append(at)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_a_huge_micro_batch_is_drained_stretch_by_stretch(monkeypatch):
    state, stretches, each = FakeState(), 60, 40
    r = np.random.default_rng(2)
    at = r.permutation(stretches * each) * 1_500_000  # 40 rows a minute, all in one micro-batch, in any order
    rows = pd.DataFrame({
        "slab_id": [f"s{k}" for k in at], "pass_number": 1, "status": "matched", "a_at": at, "b_at": at, "steel_grade": "g",
        "x": list(r.normal(size=(len(at), 3))), "baseline": 1000.0, "actual": r.normal(1000, 20, len(at)), "wear_level": 0.0})
    processor = serving.GradeProcessor(challenger="linear", ttl=300.0)
    processor.init(state)
    frames = (rows.iloc[k : k + 100] for k in range(0, len(rows), 100))
    assert list(processor.handleInputRows(("g",), frames, None)) == []
    assert len(state.timers) == stretches == len(state.maps["chunks"])
    most = []
    whole = pa.concat_tables
    monkeypatch.setattr(serving.pa, "concat_tables", lambda tables: most.append(sum(len(t) for t in tables)) or whole(tables))
    clock = lambda seconds: type("Clock", (), {"getCurrentWatermarkInMs": staticmethod(lambda: seconds * 1000)})
    assert list(processor.handleExpiredTimer(("g",), clock(359), None)) == []  # the first minute and the time limit are not over
    out = list(processor.handleExpiredTimer(("g",), clock(300 + 60 * 10), None))
    assert len(out) == 10 and len(state.maps["chunks"]) == stretches - 10
    assert list(processor.handleExpiredTimer(("g",), clock(300 + 60 * 10), None)) == []
    out += list(processor.handleExpiredTimer(("g",), clock(10**6), None))
    assert max(most) == each and max(map(len, out)) == each and not state.maps["held"] and not state.maps["chunks"]
    found = pd.concat(out)
    assert found["b_at"].is_monotonic_increasing and len(found) == len(rows)
    model = KeyModels(3, challenger="linear")
    ordered = rows.sort_values("b_at")
    expected = [model.step(x, b, a) for x, b, a in zip(ordered["x"], ordered["baseline"], ordered["actual"])]
    np.testing.assert_allclose(found[list(serving._COMPUTED)].to_numpy(float), np.array(expected, float), rtol=1e-9)


def test_saved_models_start_a_live_job(spark):
    """Rule learner, router and all others go from a batch run's tables to the state of a live job and on without a change."""
    found = match.match_pairs(match.pair_events(fixtures.requests(spark, SMALL), fixtures.truths(spark, SMALL), ["slab_id", "pass_number"]))
    rows = evaluation.matched_rows(found).toPandas().sort_values(["evaluation_timestamp", "slab_id", "pass_number"])
    middle = rows["evaluation_timestamp"].iloc[len(rows) // 2]
    for challenger in ("rules", "offset"):
        _, state = evaluation.prequential_eval(found.where(F.col("b.ts") < F.lit(middle)), challenger=challenger)
        blobs = {r.steel_grade: bytes(r.blob) for r in serving.live_models(state, challenger=challenger).collect()}
        assert blobs.keys() == set(rows["steel_grade"])
        for grade, own in rows.groupby("steel_grade"):
            model, late = KeyModels(challenger=challenger), KeyModels.load(blobs[grade])
            for x, b, a, t in zip(own[list(evaluation.X)].to_numpy(), own["baseline"].tolist(), own["actual"].tolist(), own["evaluation_timestamp"]):
                answer = model.step(x, b, a)
                if t >= middle:
                    np.testing.assert_allclose(late.step(x, b, a), answer, rtol=1e-9, atol=1e-6)
