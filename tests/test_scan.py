"""Blocked running aggregates against plain loops, over many block borders."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slowtruth.operators import learn, models, scan


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [("hot" if i % 3 else f"k{i % 5}", i, rng.gauss(5, 2), rng.gauss(-1, 30), 4.0) for i in range(600)]
    return spark.createDataFrame(data, "k string, t long, x double, y double, c double")


def keyed(frame, column):
    frame = frame.sort_values("t")
    return {k: g[column].to_numpy() for k, g in frame.groupby("k")}


def test_row_ids_follow_the_order(spark, rows):
    staged = scan.stage_order(rows, ["k"], ["t"]).toPandas().sort_values(scan.ROW)
    for _, g in staged.groupby("k"):
        assert g["t"].is_monotonic_increasing
    assert staged[scan.ROW].is_unique


@pytest.mark.parametrize("rate", [0.02, 0.2, 0.9])
def test_ewma(spark, rows, tiny_blocks, rate):
    staged = scan.stage_order(rows, ["k"], ["t"])
    found = scan.ewma(staged, ["k"], {"x": "sx", "y": "sy"}, rate).toPandas()
    for column, out in (("x", "sx"), ("y", "sy")):
        values, after, before = (keyed(found, c) for c in (column, out, f"{out}_prior"))
        for k, xs in values.items():
            s, post, prior = 0.0, [], []
            for x in xs:
                prior.append(s)
                s = rate * x + (1 - rate) * s
                post.append(s)
            np.testing.assert_allclose(after[k], post, rtol=1e-11, atol=1e-12)
            np.testing.assert_allclose(before[k], prior, rtol=1e-11, atol=1e-12)


def test_ewma_weights_stay_finite(spark):
    rows = spark.range(40_000).select(F.lit("a").alias("k"), F.col("id").alias("t"), F.lit(1.0).alias("x"))
    found = scan.ewma(scan.stage_order(rows, ["k"], ["t"]), ["k"], {"x": "s"}, 0.5)
    last = found.orderBy(F.desc("t")).first()
    assert last["s"] == pytest.approx(1.0)
    for rate in (1e-6, 0.02, 0.2, 0.5, 0.99):
        assert (1 - rate) ** -float(2 ** scan.ewma_bits(rate)) < 1e260


def test_moments_and_zscores(spark, rows, tiny_blocks):
    staged = scan.stage_order(rows, ["k"], ["t"])
    m = scan.running_moments(staged, ["k"], ["x", "c"]).toPandas()
    z = scan.running_zscores(staged, ["k"], ["x", "c"]).toPandas()
    for k, xs in keyed(m, "x").items():
        n = np.arange(1, len(xs) + 1)
        mean = np.cumsum(xs) / n
        np.testing.assert_array_equal(keyed(m, "n")[k], n)
        np.testing.assert_allclose(keyed(m, "x_mean")[k], mean, rtol=1e-10)
        m2 = np.array([((xs[:i] - xs[:i].mean()) ** 2).sum() for i in n])
        np.testing.assert_allclose(keyed(m, "x_m2")[k], m2, rtol=1e-8, atol=1e-9)
        sd = np.sqrt(m2 / np.maximum(n - 1, 1))
        expected = np.where(n >= 2, (xs - mean) / np.where(sd > 0, sd, 1), 0.0)
        np.testing.assert_allclose(keyed(z, "x_z")[k], expected, rtol=1e-8, atol=1e-9)
        # A constant feature and the first row of a key have score 0.
        assert (keyed(z, "c_z")[k] == 0).all() and keyed(z, "x_z")[k][0] == 0


def test_running_last(spark, rows, tiny_blocks):
    sparse = rows.withColumn("v", F.when(F.col("t") % 17 == 0, F.col("t")))
    found = scan.running_last(scan.stage_order(sparse, ["k"], ["t"]), ["k"], "v", "seen").toPandas()
    for _, g in found.sort_values("t").groupby("k"):
        expected = g["v"].ffill()
        np.testing.assert_array_equal(g["seen"].to_numpy(dtype=float), expected.to_numpy(dtype=float))


def loop_sgd(z, y, rate, decay):
    w, b, out = np.zeros(z.shape[1]), 0.0, []
    for x, t in zip(z, y):
        p = b + w @ x
        out.append(p)
        b += rate * (t - p)
        w = (1 - decay) * w + rate * (t - p) * x
    return np.array(out), np.append(w, b)


@pytest.mark.parametrize("n", [1, 127, 128, 129, 700])
def test_linear_kernels(n):
    rng = np.random.default_rng(n)
    z, y = rng.normal(size=(n, 5)), rng.normal(size=n) * 100
    expected, end = loop_sgd(z, y, 0.01, 0.001)
    coef, after = models.linear_affine(z, y, 0.01, 0.001)
    np.testing.assert_allclose(coef[:, -1], expected, rtol=1e-9, atol=1e-9)  # from a start of zero
    np.testing.assert_allclose(after[:, -1], end, rtol=1e-9)
    half = n // 2 + 1
    first, then = models.linear_affine(z[:half], y[:half], 0.01, 0.001), models.linear_affine(z[half:], y[half:], 0.01, 0.001) if n > half else None
    if then is not None:  # a block that starts from what the one before has learnt
        start = first[1][:, -1]
        np.testing.assert_allclose(then[0][:, :-1] @ start + then[0][:, -1], expected[half:], rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(models.chained(first[1], then[1])[:, -1], end, rtol=1e-9)


@pytest.mark.parametrize("scanned", [0, 64])
def test_two_levels_of_a_scan_agree(spark, rows, tiny_blocks, monkeypatch, scanned):
    """Blocks folded by range partition, scanned and opened again: the same states as one scan of all blocks."""
    monkeypatch.setattr(scan, "SCANNED_PARTITIONS", scanned)
    staged = scan.stage_order(rows, ["k"], ["t"])
    assert staged.select(F.shiftright(scan.ROW, scan.PART_BITS)).distinct().count() > 1
    blocked = scan.with_block(staged, ["k"])
    start = spark.createDataFrame([("a", 3, [1.0, 2.0], [4.0, 5.0])], "k string, _n0 long, _mean0 array<double>, _m20 array<double>")
    carry = scan.moments_carry(blocked, ["k"], ["x", "c"], start, with_final=True).toPandas()
    smooth = scan.ewma_carry(scan.with_block(staged, ["k"], 2), ["k"], {"x": "s"}, 0.2, with_final=True, bits=2).toPandas()
    for k, g in rows.toPandas().sort_values("t").groupby("k"):
        text = '{"k":"%s"}' % k
        last = carry[(carry[scan.KEY] == text) & carry[scan.BLOCK].isna()].iloc[0]
        n, mean, m2 = (3, np.array([1.0, 2.0]), np.array([4.0, 5.0])) if k == "a" else (0, np.zeros(2), np.zeros(2))
        for x in g[["x", "c"]].to_numpy():
            n, old = n + 1, mean
            mean = mean + (x - mean) / n
            m2 = m2 + (x - old) * (x - mean)
        assert last["_n0"] == n and carry[carry[scan.KEY] == text][scan.BLOCK].nunique() == len(carry[carry[scan.KEY] == text]) - 1
        np.testing.assert_allclose(last["_mean0"], mean, rtol=1e-9)
        np.testing.assert_allclose(last["_m20"], m2, rtol=1e-9, atol=1e-9)
        value = 0.0
        for x in g["x"]:
            value = 0.2 * x + 0.8 * value
        own = smooth[(smooth[scan.KEY] == text) & smooth[scan.BLOCK].isna()]
        np.testing.assert_allclose(own["_c_s"].iloc[0], value, rtol=1e-9)
    found = learn.sgd_prequential(staged, ["k"], ["x", "c"], "y", 0.01, 0.001, standardize=False).toPandas()
    for k, g in found.sort_values("t").groupby("k"):
        np.testing.assert_allclose(g["sgd_residual"], loop_sgd(g[["x", "c"]].to_numpy(), g["y"].to_numpy(), 0.01, 0.001)[0], rtol=1e-8, atol=1e-9)


def test_sgd_blocked(spark, rows, tiny_blocks):
    staged = scan.stage_order(rows, ["k"], ["t"])
    found = learn.sgd_prequential(staged, ["k"], ["x", "c"], "y", 0.01, 0.001, standardize=False).toPandas()
    for k, g in found.sort_values("t").groupby("k"):
        expected, _ = loop_sgd(g[["x", "c"]].to_numpy(), g["y"].to_numpy(), 0.01, 0.001)
        np.testing.assert_allclose(g["sgd_residual"], expected, rtol=1e-8, atol=1e-9)


def test_drift_rounds_agree_and_first_alarm(spark, tiny_blocks):
    rng = random.Random(5)
    data = [(k, i, rng.random() + (8 if i > 150 + 20 * j and i % 97 > 30 else 0))
            for j, k in enumerate("ab") for i in range(400)]
    staged = scan.stage_order(spark.createDataFrame(data, "k string, t long, e double"), ["k"], ["t"])
    whole = learn.drift_detect(staged, ["k"], "e").toPandas().sort_values(["k", scan.ROW])
    parts = learn.drift_detect(staged, ["k"], "e", rows_per_round=64).toPandas().sort_values(["k", scan.ROW])
    np.testing.assert_array_equal(whole["alarm"], parts["alarm"])
    np.testing.assert_allclose(whole["excess"], parts["excess"])
    assert whole["alarm"].sum() >= 2
    first = {r["k"]: r[scan.ROW] for r in learn.first_drift(staged, ["k"], "e").collect()}
    for k, g in whole[whole["alarm"] == 1].groupby("k"):
        assert first[k] == g[scan.ROW].min()
