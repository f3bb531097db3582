"""The guarded evaluation: blocked = row by row, resume, leakage, isolation, guard limits, scenarios."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slowtruth.functions import expr
from slowtruth.operators import match
from slowtruth.operators.models import KeyModels, Router, Settings, ape
from slowtruth.operators.rules import AdaptiveRules
from slowtruth.plans import evaluation, report
from slowtruth.session import materialize
from slowtruth.sources import fixtures

from .conftest import SMALL

COMPUTED = [
    "target_mean_roll_force_kn", "sgd_roll_force_kn", "am_rules_roll_force_kn", "baseline_ape", "target_mean_ape",
    "sgd_ape", "am_rules_ape", "am_rules_shadow_ape", "is_am_rules_fallback",
]
ORDER = ["evaluation_timestamp", "slab_id", "pass_number"]


@pytest.fixture(scope="module")
def pairs(spark):
    found = match.pair_events(
        fixtures.requests(spark, SMALL), fixtures.truths(spark, SMALL), ["slab_id", "pass_number"]
    )
    return materialize(match.match_pairs(found), "test-pairs")


def by_row(pairs):
    rows = evaluation.matched_rows(pairs).toPandas().sort_values(ORDER)
    parts = []
    for _, g in rows.groupby("steel_grade"):
        model = KeyModels()
        done = [model.step(x, b, a) for x, b, a in zip(g[list(evaluation.X)].to_numpy(), g["baseline"].tolist(), g["actual"].tolist())]
        parts.append(pd.concat([g[ORDER].reset_index(drop=True), pd.DataFrame(done, columns=COMPUTED)], axis=1))
    return pd.concat(parts)


def same(found, expected):
    found, expected = (f.sort_values(["slab_id", "pass_number"]).reset_index(drop=True) for f in (found, expected))
    assert len(found) == len(expected)
    for c in COMPUTED:
        np.testing.assert_allclose(found[c], expected[c], rtol=1e-9, atol=1e-6, err_msg=c)


def test_batch_equals_row_by_row(spark, pairs):
    result, _ = evaluation.prequential_eval(pairs)
    assert tuple(result.columns) == evaluation.RESULT_COLUMNS
    same(result.toPandas(), by_row(pairs))


def test_small_blocks_rounds_and_resume(spark, pairs, monkeypatch, tmp_path):
    from slowtruth.operators import scan

    monkeypatch.setattr(scan, "BLOCK_BITS", 7)
    cut = F.lit("1998-06-01").cast("timestamp_ntz")
    late = F.lit("1998-09-01").cast("timestamp_ntz")
    path, done = str(tmp_path), []
    # three runs that read and write the same place; each sees all rows so far and takes only the new ones
    for upto, version in ((cut, 1), (late, 2), (F.lit("9999-01-01").cast("timestamp_ntz"), 3)):
        state = evaluation.read_checkpoint(spark, path) if version > 1 else None
        result, state = evaluation.prequential_eval(pairs.where(F.col("b.ts") < upto), state=state, rows_per_round=300)
        assert evaluation.write_checkpoint(state, path) == version
        done.append(result.toPandas())
    assert all(map(len, done))
    same(pd.concat(done), by_row(pairs))
    # a run that died before it published leaves the version before it in force; the next run replaces its tables
    first = evaluation.read_checkpoint(spark, path, 1)
    first["moments"].limit(1).write.parquet(f"{path}/version=4/moments")
    assert evaluation.read_checkpoint(spark, path)["moments"].count() == first["moments"].count()
    again, state = evaluation.prequential_eval(pairs, state=evaluation.read_checkpoint(spark, path))
    assert again.count() == 0 and evaluation.write_checkpoint(state, path) == 4
    with pytest.raises(FileNotFoundError):
        evaluation.read_checkpoint(spark, f"{path}/nowhere")


def test_late_rows_are_scored_once(spark, pairs, tmp_path):
    """Slabs that first come in the second run, some measured before all that the models have seen, one without a time."""
    late = F.col("b.ts") >= F.lit("1998-06-01").cast("timestamp_ntz")
    late = late | (F.pmod(F.xxhash64("a.slab_id"), F.lit(5)) == 0)
    first = pairs.where(~late)
    result, state = evaluation.prequential_eval(first)
    one = result.toPandas()
    path = str(tmp_path)
    evaluation.write_checkpoint(state, path)
    result, state = evaluation.prequential_eval(pairs, state=evaluation.read_checkpoint(spark, path))
    two = result.toPandas()
    rows = evaluation.matched_rows(pairs).toPandas()
    seen = set(map(tuple, one[["slab_id", "pass_number"]].to_numpy()))
    rows["run"] = [(s, p) not in seen for s, p in rows[["slab_id", "pass_number"]].to_numpy()]
    assert len(one) + len(two) == len(rows)
    assert (two.evaluation_timestamp < one.evaluation_timestamp.max()).sum() > 20
    parts = []
    for _, g in rows.sort_values(["run", *ORDER]).groupby("steel_grade", sort=False):
        model = KeyModels()
        done = [model.step(x, b, a) for x, b, a in zip(g[list(evaluation.X)].to_numpy(), g["baseline"].tolist(), g["actual"].tolist())]
        parts.append(pd.concat([g[ORDER].reset_index(drop=True), pd.DataFrame(done, columns=COMPUTED)], axis=1))
    same(pd.concat([one, two]), pd.concat(parts))
    timeless = pairs.limit(1).withColumn("b", F.col("b").withField("ts", F.lit(None).cast("timestamp_ntz")))
    evaluation.write_checkpoint(state, path)
    result, state = evaluation.prequential_eval(pairs.unionByName(timeless), state=evaluation.read_checkpoint(spark, path))
    assert [r.evaluation_timestamp for r in result.collect()] == [None]
    evaluation.write_checkpoint(state, path)
    again, _ = evaluation.prequential_eval(pairs.unionByName(timeless), state=evaluation.read_checkpoint(spark, path))
    assert again.count() == 0


def test_seen_log_grows_by_day_and_is_read_by_day(spark, pairs, tmp_path):
    """A version adds the rows of its own run; a run opens the log of the days it brings rows of, and no other."""
    cut, path = F.lit("1998-06-01").cast("timestamp_ntz"), str(tmp_path)
    _, state = evaluation.prequential_eval(pairs.where(F.col("b.ts") < cut), challenger="offset")
    evaluation.write_checkpoint(state, path)
    late = materialize(pairs.where(F.col("b.ts") >= cut).limit(50), "late")
    result, state = evaluation.prequential_eval(late, state=evaluation.read_checkpoint(spark, path), challenger="offset")
    assert result.count() == 50 and evaluation.write_checkpoint(state, path) == 2
    assert spark.read.parquet(f"{path}/seen/seen_version=2").count() == 50
    log = evaluation.read_checkpoint(spark, path)["seen"]
    assert log.count() == 50 + pairs.where(F.col("b.ts") < cut).count()
    assert evaluation.read_checkpoint(spark, path, 1)["seen"].count() == log.count() - 50
    days = sorted(r[0] for r in log.select("seen_day").distinct().collect())
    plan = evaluation.seen_on(log, days[-2:])._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: ")[1].split("]")[0]
    assert "seen_day" in filters and "seen_version" in filters and all(str(d) in filters for d in days[-2:])
    again, _ = evaluation.prequential_eval(late, state=evaluation.read_checkpoint(spark, path), challenger="offset")
    assert again.count() == 0


def test_no_leakage_and_grade_isolation(spark, pairs):
    rows = evaluation.matched_rows(pairs).where("steel_grade = 'high_alloy'").toPandas().sort_values(ORDER).head(400)
    x, b, a = rows[list(evaluation.X)].to_numpy(), rows["baseline"].tolist(), rows["actual"].tolist()

    def answers(actual):
        model = KeyModels()
        return [model.step(xi, bi, ai)[:3] for xi, bi, ai in zip(x, b, actual)]

    changed = list(a)
    changed[200] *= 3
    before, after = answers(a), answers(changed)
    assert before[:201] == after[:201] and before[201:] != after[201:]
    alone, _ = evaluation.prequential_eval(pairs.where("a.steel_grade = 'high_alloy'"))
    everything, _ = evaluation.prequential_eval(pairs)
    same(alone.toPandas(), everything.where("steel_grade = 'high_alloy'").toPandas())


def test_wear_is_no_feature():
    assert not any("wear" in name for name in expr.FEATURE_NAMES)
    assert len(expr.FEATURE_NAMES) == 16


def test_router_limits():
    ulp = np.nextafter
    for answer, flag in ((25.0, 0), (ulp(25.0, 26), 1), (-20.0, 0), (ulp(-20.0, -21), 1)):
        assert Router(Settings()).step(100.0, float(answer), 100.0)[1] == flag
    assert Router(Settings(), 4.0, 1.0).step(100.0, 1.0, 100.0)[1] == 0
    assert Router(Settings(), float(ulp(4.0, 5)), 1.0).step(100.0, 1.0, 100.0)[1] == 1
    assert ape(5.0, 0.0) == 0.0


def test_guards_as_columns(spark):
    ulp = np.nextafter
    rows = [(25.0, 4.0), (float(ulp(25.0, 26)), float(ulp(4.0, 5))), (-20.0, 0.0), (float(ulp(-20.0, -21)), 9.0)]
    found = spark.createDataFrame(rows, "r double, m double").select(
        expr.unsafe_predicate(F.col("r"), F.lit(100.0)).alias("unsafe"),
        expr.untrusted_predicate(F.col("m"), F.lit(1.0)).alias("untrusted"),
    ).collect()
    assert [r["unsafe"] for r in found] == [False, True, False, True]
    assert [r["untrusted"] for r in found] == [False, True, False, True]


def test_first_row_of_a_key():
    mean_force, sgd_force, routed, *_, flag = KeyModels().step(np.ones(16), 100.0, 130.0)
    assert (mean_force, sgd_force, routed, flag) == (100.0, 100.0, 100.0, 0)


def drive(shift):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(8000, 16))
    y = rng.normal(size=8000) * 400 + np.where(np.arange(8000) >= 4000, shift, 0) * (1 + 0.5 * z[:, 0])
    model, found = AdaptiveRules(), []
    for zi, yi in zip(z, y.tolist()):
        found.append(abs(yi - model.predict_and_train(zi, yi)))
    return model, np.array(found), np.abs(y)


def test_rules_recover_from_an_abrupt_shift():
    model, error, baseline = drive(9000.0)
    assert model.alarms >= 1
    assert error[4000:4010].mean() > 3000
    assert error[-1000:].mean() < 0.2 * baseline[-1000:].mean()


def test_rules_are_stable_without_drift():
    _, error, baseline = drive(0.0)
    assert error[1000:].mean() < 1.1 * baseline[1000:].mean()


def test_rules_state_round_trip():
    rng = np.random.default_rng(2)
    z, y = rng.normal(size=(900, 4)), rng.normal(size=900) * 10
    whole = AdaptiveRules(4)
    expected = [whole.predict_and_train(a, b) for a, b in zip(z, y.tolist())]
    part = AdaptiveRules(4)
    found = [part.predict_and_train(a, b) for a, b in zip(z[:450], y[:450].tolist())]
    part = AdaptiveRules.load(part.dump())
    found += [part.predict_and_train(a, b) for a, b in zip(z[450:], y[450:].tolist())]
    assert found == expected


def test_scenarios_on_the_fixture(spark, pairs):
    """No drift: nothing to correct, no fallback. Drift: the guarded model beats the physics."""
    guarded = evaluation.guarded_target_mean(pairs).groupBy("steel_grade").agg(
        F.avg("baseline_ape").alias("b"), F.avg("safe_ape").alias("s"), F.avg("shadow_ape").alias("r"),
        F.sum("fallback").alias("n"),
    )
    found = {r["steel_grade"]: r for r in guarded.collect()}
    assert found["structural"]["b"] < 0.3 and found["structural"]["n"] == 0
    for grade in ("microalloyed", "high_alloy"):
        assert found[grade]["s"] < found[grade]["b"] and found[grade]["s"] < found[grade]["r"]


def test_latest_rows(spark):
    data = [("g", f"s{i}", 1, i) for i in range(100)] + [("h", "s", 1, 5)]
    rows = spark.createDataFrame(data, "steel_grade string, slab_id string, pass_number int, i int").withColumn(
        "evaluation_timestamp", F.expr("TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(0, 0, 0, i)")
    ).withColumn("wear_level", F.col("i") / 8)
    top = report.latest_per_grade(rows).where("steel_grade = 'g'").orderBy("position").collect()
    assert [r["i"] for r in top] == list(range(40, 100))
    assert {r["steel_grade"]: r["current_wear"] for r in report.current_wear(rows).collect()} == {"g": 12.38, "h": 0.63}
