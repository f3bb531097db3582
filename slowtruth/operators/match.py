"""One-to-one pairing of two event sequences with a time limit.

Per key there is one slot per side. An event meeting a waiting event of the other
side forms a pair and both are gone; otherwise it is stored and replaces an earlier
one of its own side. A stored event expires once its time limit has passed.

So after every event the slot holds either exactly that event or nothing. Call a row
*linked* if its predecessor in the key is of the other side and not yet expired. A row
that is not linked is always stored; along a run of linked rows the slot alternates.
Hence, with k = rows since the last unlinked row, the row closes a pair with its
predecessor iff k is odd. That needs only lag, a running max and a row number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slowtruth.operators.scan import BLOCK, KEY, ROW, block_window, blocks_in_order, carry_in, stage_order, with_block
from slowtruth.session import materialize

DEFAULT_TTL = 300.0
#: A key of more rows than this is cut into blocks; a smaller one is sorted by a single task.
HOT_ROWS = 1_000_000
#: Hashes are counted in so many buckets before they are counted one by one.
HOT_BUCKETS = 8192


def tag_union(requests: DataFrame, truths: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str] = ()) -> DataFrame:
    """Both sides in one table: keys, ts, side, tie columns and one struct per side."""
    order = [F.col(t) for t in tie]
    a = requests.select(
        *keys, F.col(ts).alias("ts"), F.lit("A").alias("side"), *order,
        F.struct(*requests.columns).alias("a"),
    )
    b = truths.select(
        *keys, F.col(ts).alias("ts"), F.lit("B").alias("side"), *order,
        F.struct(*truths.columns).alias("b"),
    )
    return a.unionByName(b, allowMissingColumns=True)


def _ttl_interval(ttl: float) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl).cast("decimal(18,6)"))


def _expired(prev_ts: Column, ts: Column, ttl: float | None) -> Column:
    return F.lit(False) if ttl is None else prev_ts + _ttl_interval(ttl) <= ts


def pair_events(
    requests: DataFrame,
    truths: DataFrame,
    keys: Sequence[str],
    ts: str = "ts",
    tie: Sequence[str] = (),
    ttl: float | None = DEFAULT_TTL,
    hot_keys: str = "auto",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Every pair and every unpaired event: keys, status, ts, a, b.

    status is ``matched`` (a and b set), ``orphan`` (expired), ``superseded`` (replaced by a
    later event of its side) or ``waiting`` (not expired at the last event time of the input).
    Input rows = 2*matched + orphan + superseded + waiting.

    One hash shuffle on the keys in the usual case. ``hot_keys='auto'`` first counts the rows of each key; keys of
    more than ``hot_rows`` take the blocked form, which splits one key over many tasks. ``'never'`` and ``'all'``
    force a form. The forms agree, null keys included: a null is a key like any other. Events without a time come
    first in their key and never expire.
    """
    tagged = tag_union(requests, truths, keys, ts, tie)
    order = ["ts", "side", *tie]
    light, hot = (None, tagged) if hot_keys == "all" else (tagged, None)
    if hot_keys == "auto":
        crowded = hot_key_table(tagged, keys, hot_rows)
        if not crowded.isEmpty():
            marked = tagged.withColumn("_h", F.xxhash64(*keys))
            light = marked.join(crowded, "_h", "left_anti").drop("_h")
            hot = marked.join(crowded, "_h", "left_semi").drop("_h")
    parts = []
    if light is not None:
        parts.append(_by_key(_together(light, keys, ts), keys, order, ttl))
    if hot is not None:
        parts.append(_by_block(hot, keys, order, ttl))
    scanned = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return _resolve(scanned, keys, ttl, last_time(tagged))


def hot_key_table(tagged: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame:
    """(_h): hashes of the keys with more than ``hot_rows`` rows. A key that shares a hash with one is only treated alike.

    Buckets of hashes are counted first, which shuffles a few rows for each task: a key cannot have more rows than its bucket,
    so hashes are counted only in the buckets that have as many.
    """
    hashes = tagged.select(F.xxhash64(*keys).alias("_h")).withColumn("_bucket", F.pmod("_h", F.lit(HOT_BUCKETS)))
    buckets = hashes.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"))
    full = materialize(buckets.where(F.col("n") > hot_rows).select("_bucket"), "hot-buckets")
    if full.isEmpty():
        return full.select(F.col("_bucket").alias("_h"))
    counts = hashes.join(full, "_bucket", "left_semi").groupBy("_h").agg(F.count(F.lit(1)).alias("n"))
    return materialize(counts.where(F.col("n") > hot_rows).select("_h"), "hot-keys")


def last_time(tagged: DataFrame) -> Column | None:
    """The last event time of the input as a literal that no time zone can move."""
    if tagged.schema["ts"].dataType.typeName() == "timestamp":
        micros = tagged.agg(F.max(F.unix_micros("ts"))).first()[0]
        return None if micros is None else F.timestamp_micros(F.lit(micros))
    text = tagged.agg(F.max("ts").cast("string")).first()[0]
    return None if text is None else F.lit(text).cast(tagged.schema["ts"].dataType)


def _event() -> Column:
    return F.struct("ts", "side", "a", "b")


def _together(tagged: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Rows of a key in one partition. Side, time and keys are not sent twice, as columns and inside the events."""
    inner = {s: [f for f in tagged.schema[s].dataType.names if f not in keys or f == ts] for s in "ab"}
    slim = {s: F.when(F.col(s).isNotNull(), F.struct(*[F.col(s)[f].alias(f) for f in inner[s]])) for s in "ab"}
    rest = [c for c in tagged.columns if c not in ("a", "b", "side", "ts")]
    sent = tagged.select(*rest, *[slim[s].alias(s) for s in "ab"]).repartition(*keys)
    back = {s: F.when(F.col(s).isNotNull(), F.struct(*[
        (F.col(f) if f in keys else F.col(s)[f]).alias(f) for f in tagged.schema[s].dataType.names])) for s in "ab"}
    of_a = F.col("a").isNotNull()
    return sent.select(
        *rest, F.coalesce(F.col("a")[ts], F.col("b")[ts]).alias("ts"), F.when(of_a, "A").otherwise("B").alias("side"),
        *[back[s].alias(s) for s in "ab"],
    ).select(*tagged.columns)


def _by_key(tagged, keys, order, ttl) -> DataFrame:
    win = Window.partitionBy(*keys).orderBy(*order)
    upto = win.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = tagged.select(
        "*",
        F.lag(_event()).over(win).alias("_prev"),
        F.row_number().over(win).alias("_rn"),
        F.lead(F.lit(True), 1, False).over(win).alias("_next"),
    )
    rows = rows.withColumn("_linked", _linked(ttl))
    # Same partitioning and order as above: no new shuffle or sort.
    rows = rows.withColumn("_k", F.col("_rn") - F.max(F.when(~F.col("_linked"), F.col("_rn"))).over(upto))
    return rows.select(
        *keys, "ts", "side", "a", "b", "_prev", "_linked", "_k",
        F.lag("_k", 1, 1).over(win).alias("_prev_k"),
        (~F.col("_next")).alias("_is_last"),
    )


def _linked(ttl) -> Column:
    prev = F.col("_prev")
    linked = (prev["side"] != F.col("side")) & ~_expired(prev["ts"], F.col("ts"), ttl)
    return F.coalesce(linked, F.lit(False))


def _by_block(tagged, keys, order, ttl) -> DataFrame:
    rows = with_block(stage_order(tagged, keys, order, "pairing"), keys)
    win = block_window()
    ends = rows.groupBy(KEY, BLOCK).agg(F.max_by(_event(), ROW).alias("_tail"))
    across = blocks_in_order()
    ends = ends.select(
        KEY, BLOCK,
        F.lag("_tail").over(across).alias("_before"),
        F.lead(F.lit(True), 1, False).over(across).alias("_more"),
    )
    rows = rows.withColumn("_local", F.lag(_event()).over(win)).withColumn(
        "_next", F.lead(F.lit(True), 1, False).over(win)
    )
    rows = (
        rows.join(ends, [KEY, BLOCK])
        .withColumn("_prev", F.coalesce("_local", "_before"))
        .withColumn("_linked", _linked(ttl))
    )
    runs = rows.groupBy(KEY, BLOCK).agg(
        F.count(F.lit(1)).alias("_n"),
        (F.max(ROW) - F.max(F.when(~F.col("_linked"), F.col(ROW)))).alias("_run"),
    ).withColumn("_run", F.coalesce("_run", F.lit(-1)))
    carry = carry_in(
        runs, keys, "_k0 long", (-1,), lambda held, b: (b[1] if b[1] >= 0 else held[0] + b[0],), ["_n", "_run"],
        join=lambda a, b: (a[0] + b[0], b[1] if b[1] >= 0 else a[1] + b[0] if a[1] >= 0 else -1),
    )
    upto = win.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_reset", F.max(F.when(~F.col("_linked"), F.col(ROW))).over(upto)).withColumn(
        "_i", F.row_number().over(win)
    )
    rows = rows.join(carry, [KEY, BLOCK]).withColumn(
        "_k", F.when(F.col("_reset").isNotNull(), F.col(ROW) - F.col("_reset")).otherwise(F.col("_k0") + F.col("_i"))
    )
    rows = rows.withColumn("_lag_k", F.lag("_k").over(win))
    return rows.select(
        *keys, "ts", "side", "a", "b", "_prev", "_linked", "_k",
        F.coalesce("_lag_k", F.when(F.col("_k0") >= 0, F.col("_k0")), F.lit(1)).alias("_prev_k"),
        (~F.col("_next") & ~F.col("_more")).alias("_is_last"),
    )


def _resolve(rows: DataFrame, keys: Sequence[str], ttl, horizon) -> DataFrame:
    """Say what became of each event: its successor decides, or the end of the input."""
    prev = F.col("_prev")
    a_type, b_type = rows.schema["a"].dataType, rows.schema["b"].dataType
    closes = (F.col("_k") % 2) == 1
    prev_stored = prev.isNotNull() & ((F.col("_prev_k") % 2) == 0)
    none_a, none_b = F.lit(None).cast(a_type), F.lit(None).cast(b_type)
    pair = F.when(
        closes,
        F.struct(F.lit("matched").alias("status"), F.col("ts").alias("ts"),
                 F.coalesce(F.col("a"), prev["a"]).alias("a"), F.coalesce(F.col("b"), prev["b"]).alias("b")),
    )
    lost = F.when(
        prev_stored & ~closes,
        F.struct(
            F.when(_expired(prev["ts"], F.col("ts"), ttl), "orphan").otherwise("superseded").alias("status"),
            prev["ts"].alias("ts"), prev["a"].alias("a"), prev["b"].alias("b"),
        ),
    )
    left = F.when(
        F.col("_is_last") & ~closes,
        F.struct(F.lit("waiting").alias("status"), F.col("ts").alias("ts"), F.col("a").alias("a"), F.col("b").alias("b")),
    )
    out = rows.select(*keys, F.explode(F.array_compact(F.array(pair, lost, left))).alias("e")).select(*keys, "e.*")
    if ttl is not None and horizon is not None:
        late = F.coalesce(_expired(F.col("ts"), horizon, ttl), F.lit(False))
        out = out.withColumn(
            "status", F.when((F.col("status") == "waiting") & late, "orphan").otherwise(F.col("status"))
        )
    return out


def match_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("status") == "matched").drop("status")


def match_orphans(pairs: DataFrame) -> DataFrame:
    """Events that waited out their time limit unpaired."""
    return pairs.where(F.col("status") == "orphan")


def latest_orphans_overwritten(pairs: DataFrame) -> DataFrame:
    """Events lost because a later event of the same side replaced them."""
    return pairs.where(F.col("status") == "superseded")


def join_unique(requests: DataFrame, truths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairing where each key is known to occur once per side and no time limit applies: an equi-join."""
    a = requests.select(*keys, F.struct(*requests.columns).alias("a"))
    b = truths.select(*keys, F.struct(*truths.columns).alias("b"))
    return a.join(b, list(keys))
