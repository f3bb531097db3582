"""Pairing against a plain slot machine, in both physical forms."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from slowtruth.operators import match

T0 = datetime(2024, 1, 1)
SCHEMA = "k string, id long, ts timestamp_ntz"


def slot_machine(events, ttl, horizon):
    """Direct replay of one key: list of (status, a id, b id)."""
    fate, slot = [], None

    def gone(status, e):
        fate.append((status, e[2] if e[1] == "A" else None, e[2] if e[1] == "B" else None))

    for e in sorted(events):
        if slot is None:
            slot = e
        elif ttl is not None and slot[0] + ttl <= e[0]:
            gone("orphan", slot)
            slot = e
        elif slot[1] == e[1]:
            gone("superseded", slot)
            slot = e
        else:
            a, b = (slot, e) if slot[1] == "A" else (e, slot)
            fate.append(("matched", a[2], b[2]))
            slot = None
    if slot is not None:
        gone("orphan" if ttl is not None and slot[0] + ttl <= horizon else "waiting", slot)
    return fate


def run(spark, per_key, ttl, **options):
    rows = {"A": [], "B": []}
    for k, events in per_key.items():
        for second, side, i in events:
            rows[side].append((k, i, T0 + timedelta(seconds=second)))
    a, b = (spark.createDataFrame(rows[s], SCHEMA) for s in "AB")
    pairs = match.pair_events(a, b, ["k"], tie=["id"], ttl=ttl, **options)
    found = pairs.select("k", "status", F.col("a.id").alias("a"), F.col("b.id").alias("b")).collect()
    horizon = max(e[0] for es in per_key.values() for e in es)
    expected = Counter((k, *f) for k, es in per_key.items() for f in slot_machine(es, ttl, horizon))
    return Counter(tuple(r) for r in found), expected


CASES = {
    "b before a": [(0, "B", 1), (1, "A", 2)],
    "duplicate a": [(0, "A", 1), (1, "A", 2), (2, "B", 3)],
    "duplicate after match": [(0, "A", 1), (1, "B", 2), (2, "B", 3)],
    "limit reached exactly": [(0, "A", 1), (300, "B", 2)],
    "just inside the limit": [(0, "A", 1), (299, "B", 2)],
    "own deadline": [(0, "A", 1), (290, "A", 2), (310, "B", 3)],
    "alternating run": [(0, "A", 1), (1, "B", 2), (2, "A", 3), (3, "B", 4), (4, "A", 5)],
    "same instant": [(5, "B", 1), (5, "A", 2)],
}


@pytest.mark.parametrize("hot_keys", ["never", "all"])
def test_hand_made_cases(spark, hot_keys):
    for ttl in (300, None):
        found, expected = run(spark, CASES, ttl, hot_keys=hot_keys)
        assert found == expected


@pytest.mark.parametrize("hot_keys", ["never", "all", "auto"])
def test_random_sequences_and_conservation(spark, tiny_blocks, hot_keys):
    # One key holds a third of all rows: with a low bar it takes the blocked form, the others do not.
    rng = random.Random(7)
    per_key, i = {}, 0
    for n in range(40):
        events, second = [], 0
        for _ in range(300 if n == 0 else rng.randint(1, 25)):
            second += rng.choice([0, 1, 2, 5, 12])
            i += 1
            events.append((second, rng.choice("AB"), i))
        per_key[f"k{n}"] = events
    for ttl in (10, None):
        found, expected = run(spark, per_key, ttl, hot_keys=hot_keys, hot_rows=50)
        assert found == expected
        status = Counter()
        for (_, s, _, _), n in found.items():
            status[s] += n
        assert sum(map(len, per_key.values())) == sum(status.values()) + status["matched"]


def test_heavy_keys_are_found(spark):
    ids = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"),
        F.lit(T0).cast("timestamp_ntz").alias("ts"),
    )
    hot = spark.range(1).select(F.xxhash64(F.lit("hot")).alias("h")).first()["h"]
    assert [r[0] for r in match.hot_key_table(ids, ["k"], 10_000).collect()] == [hot]
    assert match.hot_key_table(ids, ["k"], 20_000).isEmpty()


def test_forms_agree_with_null_keys(spark):
    """A null key is a key: 'never', 'auto' and 'all' give the same rows, and none is lost."""
    import random
    from collections import Counter

    r = random.Random(8)
    for schema, make in (("k string", lambda: (r.choice([None, "null", "a", "b"]),)), ("k int, j int", lambda: (r.choice([None, 1, 2]), r.choice([None, 1])))):
        rows = [(*make(), i, r.randrange(3)) for i in range(300)]
        df = spark.createDataFrame(rows, f"{schema}, id int, side int").withColumn("ts", F.expr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,id * 2)"))
        keys = [c for c in df.columns if c in "kj"]
        a, b = df.where("side = 0").drop("side"), df.where("side > 0").drop("side")
        out = {}
        for form, hot_rows in (("never", 1), ("all", 1), ("auto", 60)):
            found = match.pair_events(a, b, keys, tie=["id"], ttl=30.0, hot_keys=form, hot_rows=hot_rows).collect()
            out[form] = Counter((x.status, *[x[k] for k in keys], x.a and x.a.id, x.b and x.b.id) for x in found)
            n = Counter(x.status for x in found)
            assert 2 * n["matched"] + n["orphan"] + n["superseded"] + n["waiting"] == len(rows)
        assert out["never"] == out["all"] == out["auto"]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/Los_Angeles", "Europe/Paris"])
def test_horizon_has_no_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for kind in ("timestamp_ntz", "timestamp"):
            a = spark.sql(f"SELECT 1 AS k, {kind}'2024-03-31 01:00:00' AS ts UNION ALL SELECT 2, {kind}'2024-03-31 01:09:00'")
            b = spark.sql(f"SELECT 3 AS k, {kind}'2024-03-31 01:10:00' AS ts")
            found = {r.k: r.status for r in match.pair_events(a, b, ["k"], ttl=300.0).collect()}
            assert found == {1: "orphan", 2: "waiting", 3: "waiting"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
