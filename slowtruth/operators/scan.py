"""Running aggregates over long keys.

A key (a steel grade) may hold a third of all rows, so no operator here gives a
whole key to one task. Rows are range-partitioned by (key, order), written once
with a row id that follows that order, and cut into blocks of at most
``2**bits`` rows. Each running aggregate is then

1. one summary per (key, block), an ordinary partial aggregation;
2. a short ordered scan of the summaries, which yields the state before each block;
3. a window over (key, block), joined with that state.

Step 2 is the only sequential part and touches one row per block.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from slowtruth.operators.models import running_scores
from slowtruth.session import materialize

ROW = "_rid"
BLOCK = "_block"
#: The key columns as one text that is never null. Blocks are grouped and joined by it, so a null key is a key like
#: any other and keeps its rows.
KEY = "_key"
BLOCK_BITS = 14
#: Row ids hold the range partition above so many bits. Up to so many partitions the blocks of a key are scanned at once.
PART_BITS, SCANNED_PARTITIONS, _PART = 33, 64, "_part"
#: Rows of a file of a table with whole blocks, as a power of two; what marks the row ids of such a table; its row group.
FILE_BITS, _WHOLE, _ROW_GROUP = 18, "whole_blocks", 1 << 30


def stage_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str = "ordered", whole: bool = False) -> DataFrame:
    """Sort by (keys, order) across the cluster and pin a row id that follows the order.

    ``order`` must be unique within a key. The id is the range partition in the high
    bits and the position inside it in the low 33 bits, so a block never crosses a partition. The rows are written first:
    the bounds of the ranges are drawn from them in a pass of their own, which would compute them a second time.
    With ``whole`` the files are such that ``run_blocks`` needs no shuffle.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df, f"{label}-unordered", compression="zstd").repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    numbered = ranged.withColumn(ROW, F.monotonically_increasing_id())
    if whole:
        return whole_blocks(numbered, label, maxRecordsPerFile=str(1 << max(FILE_BITS, BLOCK_BITS)))
    return materialize(numbered, label, compression="zstd")


def whole_blocks(rows: DataFrame, label: str, **options: str) -> DataFrame:
    """Write rows that stand in order, a task's blocks whole, so that whoever reads a file meets its blocks whole and in order.

    Spark cuts Parquet files only between row groups, and a file has one.
    """
    found = materialize(rows, label, compression="zstd", **{"parquet.block.size": str(_ROW_GROUP)}, **options)
    return found.withMetadata(ROW, {_WHOLE: True})


def in_place(rows: DataFrame) -> bool:
    """Whether ``rows`` are read from a table with whole blocks, and nothing on the way moves them."""
    if not rows.schema[ROW].metadata.get(_WHOLE):
        return False
    node = rows._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().head()
    return node.nodeName().startswith("LogicalRelation") or node.nodeName().startswith("Relation")


def with_block(staged: DataFrame, keys: Sequence[str], bits: int | None = None) -> DataFrame:
    """Adds the block number, ``2**bits`` consecutive row ids (``2**BLOCK_BITS`` unless given), and the key as text.

    JSON leaves out nulls, so a null and the text "null" stay different keys.
    """
    blocked = staged.withColumn(BLOCK, F.shiftright(F.col(ROW), BLOCK_BITS if bits is None else bits))
    return blocked if KEY in staged.columns else blocked.withColumn(KEY, F.to_json(F.struct(*keys)))


def key_columns(keys: Sequence[str], schema: T.StructType) -> list[Column]:
    """The key columns back from their text."""
    struct = T.StructType([schema[k] for k in keys])
    return [F.from_json(KEY, struct)[k].alias(k) for k in keys]


def block_window():
    return Window.partitionBy(KEY, BLOCK).orderBy(ROW)


def blocks_in_order():
    return Window.partitionBy(KEY).orderBy(BLOCK)


@dataclass(frozen=True)
class Step:
    """What is done with a block: ``run(columns, state)`` gets those it ``reads``, as Arrow arrays, and the state before the block.

    ``state`` has the columns of ``starts``, a row for each block by its key and number. The result has what it ``adds``: a value
    for each row, or for the whole block in ``fold_blocks``.
    """

    starts: DataFrame | None
    reads: Sequence[str]
    adds: T.StructType
    run: Callable[[dict[str, pa.Array], dict], dict]


def floats(column: pa.Array) -> np.ndarray:
    """As numbers, null being no number."""
    return np.asarray(column.to_numpy(zero_copy_only=False), dtype=float)


def run_blocks(rows: DataFrame, keys: Sequence[str], bits: int, steps: Sequence[Step], dropped: Sequence[str] = ()) -> DataFrame:
    """Rows without ``dropped``, with what the steps add, block by block.

    The state before a block comes with its first row, so no row is shuffled if the table was written with whole blocks; any
    other table is put in order first. States are a row for each block, and are broadcast.
    """
    kept = [f for f in rows.schema.fields if f.name not in (*dropped, BLOCK, KEY)]
    out = T.StructType([*kept, *[f for step in steps for f in step.adds]])
    added = to_arrow_schema(T.StructType([f for step in steps for f in step.adds]))
    names = [f.name for f in kept]

    def whole(block: pa.Table, state: dict, found: dict) -> list[pa.Array]:
        # as through pandas: a number that is none is null
        own = [pc.if_else(pc.is_nan(c), pa.scalar(None, c.type), c) if pa.types.is_floating(c.type) else c for c in map(block.column, names)]
        return own + [pa.array(found[f.name], f.type, from_pandas=True) for f in added]

    return _blocks(rows, keys, bits, steps, whole, out)


def fold_blocks(rows: DataFrame, keys: Sequence[str], bits: int, step: Step) -> DataFrame:
    """A row for each block: its key, its number and what the step adds."""
    out = T.StructType([T.StructField(KEY, T.StringType()), T.StructField(BLOCK, T.LongType()), *step.adds])
    added = to_arrow_schema(step.adds)

    def folded(block: pa.Table, state: dict, found: dict) -> list[pa.Array]:
        return [pa.array([state[KEY]]), pa.array([state[BLOCK]], pa.int64()), *[pa.array([found[f.name]], f.type) for f in added]]

    return _blocks(rows.select(ROW, *keys, *[c for c in step.reads if c not in keys]), keys, bits, [step], folded, out)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = [pickle.dumps(row) for row in batch.drop_columns(["_first"]).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("_first"), pa.array(blobs, pa.binary())], names=["_first", "_start"])


def _blocks(rows, keys, bits, steps, result, out) -> DataFrame:
    plain = rows.drop(BLOCK, KEY)
    blocked = with_block(plain, keys, bits)
    first = blocked.groupBy(KEY, BLOCK).agg(F.min(ROW).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    for step in steps:
        first = first if step.starts is None else first.join(step.starts, [KEY, BLOCK])
    # as bytes: Spark's Arrow writer goes back over all empty lists of a batch at every row
    first = materialize(first.mapInArrow(_packed, "_first long, _start binary"), "starts")
    reads, work = list(dict.fromkeys(c for step in steps for c in step.reads)), [step.run for step in steps]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        state: dict = {}

        def ended() -> pa.RecordBatch:
            block = pa.Table.from_batches(held).combine_chunks()
            if not state or len(block) != state["_rows"]:
                raise RuntimeError(f"{len(block)} rows of a block of {state.get('_rows')}: the table was not written with whole blocks")
            columns = {c: block.column(c).combine_chunks() for c in reads}
            found: dict = {}
            for each in work:
                found |= each(columns, state)
            arrays = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in result(block, state, found)]
            return pa.RecordBatch.from_arrays(arrays, names=out.names)

        for batch in batches:
            starts = batch.column("_start")
            at = np.flatnonzero(starts.is_valid().to_numpy(zero_copy_only=False)).tolist()
            head = at[0] if at else len(batch)
            if head:
                held.append(batch.slice(0, head))
            for lo, hi in zip(at, [*at[1:], len(batch)]):
                if held:
                    yield ended()
                held, state = [batch.slice(lo, hi - lo)], pickle.loads(starts[lo].as_py())
        if held:
            yield ended()

    stays = in_place(plain)
    marked = (plain if stays else blocked).join(F.broadcast(first), F.col(ROW) == F.col("_first"), "left").drop("_first")
    if not stays:  # sorted after the join: Spark drops a sort before one
        marked = marked.repartition(KEY, BLOCK).sortWithinPartitions(KEY, BLOCK, ROW).drop(KEY, BLOCK)
    return marked.mapInArrow(run, out)


def carry_in(
    summary: DataFrame,
    keys: Sequence[str],
    state: str,
    zero: tuple,
    merge: Callable[[tuple, tuple], tuple],
    values: Sequence[str],
    initial: DataFrame | None = None,
    with_final: bool = False,
    join: Callable[[tuple, tuple], tuple] | None = None,
    bits: int | None = None,
) -> DataFrame:
    """State before each block: an exclusive ordered scan over the block summaries of each key.

    ``summary`` and the result are keyed by the key's text. ``state`` is a DDL list of the state columns,
    ``merge(state, values)`` folds one block in. ``initial`` (``keys`` + state columns) starts a key from an earlier run. With ``with_final``
    one more row per key, block null, holds the state after its last block.
    The scan streams, so memory does not grow with the number of blocks. With ``join(values, values)``, which puts two
    summaries behind one another, it has two levels: the blocks of a range partition are folded in parallel, the scan over
    a key then has a row for each partition, and the states inside the partitions are found in parallel again. With few
    partitions one scan of all blocks is shorter than two more exchanges.
    """
    state_fields = T.StructType.fromDDL(state).fields
    values = list(values)
    shape = (state_fields, zero, merge, values)
    start = None if initial is None else initial.select(F.to_json(F.struct(*keys)).alias(KEY), *[f.name for f in state_fields])
    parts = int(summary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if join is None or parts <= SCANNED_PARTITIONS:
        return _scanned(summary, [KEY], start, with_final, *shape)
    rows = summary.withColumn(_PART, F.shiftright(BLOCK, PART_BITS - (BLOCK_BITS if bits is None else bits)))
    folded = _folded(rows, join, values).withColumnRenamed(_PART, BLOCK)
    outer = materialize(_scanned(folded, [KEY], start, True, *shape), "carry")
    inner = _scanned(rows, [KEY, _PART], outer.where(F.col(BLOCK).isNotNull()).withColumnRenamed(BLOCK, _PART), False, *shape).drop(_PART)
    return inner.unionByName(outer.where(F.col(BLOCK).isNull())) if with_final else inner


def _folded(rows: DataFrame, join: Callable, values: Sequence[str]) -> DataFrame:
    """One summary for each partition of a key."""
    out = T.StructType([rows.schema[c] for c in (KEY, _PART, *values)])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, None
        for pdf in batches:
            found = []
            for key, part, *row in zip(*[pdf[c].tolist() for c in out.names]):
                if (key, part) != current:
                    if current is not None:
                        found.append((*current, *held))
                    current, held = (key, part), tuple(row)
                else:
                    held = join(held, tuple(row))
            yield pd.DataFrame(found, columns=out.names)
        if current is not None:
            yield pd.DataFrame([(*current, *held)], columns=out.names)

    ordered = rows.repartition(KEY, _PART).sortWithinPartitions(KEY, _PART, BLOCK).select(*out.names)
    return ordered.mapInPandas(fold, schema=out)


def _scanned(summary, by, start, with_final, state_fields, zero, merge, values) -> DataFrame:
    """The scan of the summaries of each value of ``by``, from the states in ``start`` (``by`` and the state) where there are any."""
    names = [f.name for f in state_fields]
    rows = summary.select(*by, BLOCK, *values, *[F.lit(None).cast(f.dataType).alias(f"_s_{f.name}") for f in state_fields])
    if start is not None:
        rows = rows.unionByName(start.select(
            *by, F.lit(-1).cast("long").alias(BLOCK), *[F.lit(None).cast(summary.schema[v].dataType).alias(v) for v in values],
            *[F.col(n).alias(f"_s_{n}") for n in names]))
    out = T.StructType([*[summary.schema[c] for c in by], T.StructField(BLOCK, T.LongType()), *state_fields])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, zero
        for pdf in batches:
            found: list[tuple] = []
            columns = [pdf[c].tolist() for c in [*by, BLOCK, *values, *[f"_s_{n}" for n in names]]]
            for row in zip(*columns):
                key, block, row = row[: len(by)], row[len(by)], row[len(by) + 1 :]
                if key != current:
                    if with_final and current is not None:
                        found.append((*current, None, *held))
                    current, held = key, zero
                if block < 0:
                    held = tuple(row[len(values):])
                    continue
                found.append((*key, block, *held))
                held = merge(held, tuple(row[: len(values)]))
            yield _frame(found, out)
        if with_final and current is not None:
            yield _frame([(*current, None, *held)], out)

    return rows.repartition(*by).sortWithinPartitions(*by, BLOCK).mapInPandas(scan, schema=out)


def _frame(rows: list[tuple], schema: T.StructType) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=schema.names)
    if BLOCK in frame:
        frame[BLOCK] = frame[BLOCK].astype("Int64")
    return frame


def ewma(
    staged: DataFrame,
    keys: Sequence[str],
    columns: dict[str, str],
    rate: float,
    initial: DataFrame | None = None,
    bits: int | None = None,
) -> DataFrame:
    """Exponential moving averages s <- rate*x + (1-rate)*s with s = 0 before the first row.

    ``columns`` maps an input column to the name of its average. Adds that name (the value
    after the row) and ``<name>_prior`` (before it, what a predictor may use).
    Inside a block the average is a weighted running sum; block sizes keep the weights finite.
    With ``bits`` the block column stays, and a following step with the same ``bits`` finds its
    rows already together: no second shuffle.
    """
    size = ewma_bits(rate) if bits is None else bits
    if size > ewma_bits(rate):
        raise ValueError("blocks too large for this rate")
    rows = staged if bits is not None and BLOCK in staged.columns else with_block(staged, keys, size)
    carry = ewma_carry(rows, keys, columns, rate, initial, bits=size)
    found = apply_ewma(rows, carry, columns, rate, size, keys)
    return found if bits is not None else found.drop(BLOCK, KEY)


def ewma_bits(rate: float) -> int:
    """Largest block for which the growing weight (1-rate)**-n stays far from overflow."""
    if not 0.0 < rate < 1.0:
        raise ValueError("rate must lie strictly between 0 and 1")
    return max(0, min(BLOCK_BITS, int(math.log2(575.0 / -math.log1p(-rate)))))


def _position(bits: int) -> Column:
    return F.col(ROW).bitwiseAND((1 << bits) - 1).cast("double")


def _grown(column: str, rate: float, bits: int) -> Column:
    return F.col(column) * rate * F.pow(F.lit(1.0 - rate), -_position(bits))


def ewma_carry(rows, keys, columns, rate, initial=None, with_final=False, bits=None) -> DataFrame:
    """Averages before each block, ``_c_<name>``."""
    bits = ewma_bits(rate) if bits is None else bits
    outs = list(columns.values())
    summary = (
        rows.groupBy(KEY, BLOCK)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.max(_position(bits)).alias("_last"),
            *[F.sum(_grown(c, rate, bits)).alias(f"_sum_{o}") for c, o in columns.items()],
        )
        .select(
            KEY, BLOCK, "_n",
            *[(F.col(f"_sum_{o}") * F.pow(F.lit(1.0 - rate), F.col("_last"))).alias(f"_v_{o}") for o in outs],
        )
    )
    keep = 1.0 - rate

    def merge(held, block):
        factor = keep ** block[0]
        return tuple(h * factor + v for h, v in zip(held, block[1:]))

    def join(first, then):
        factor = keep ** then[0]
        return (first[0] + then[0], *[a * factor + b for a, b in zip(first[1:], then[1:])])

    return carry_in(
        summary, keys, ", ".join(f"_c_{o} double" for o in outs), (0.0,) * len(outs), merge,
        ["_n", *[f"_v_{o}" for o in outs]], initial, with_final, join, bits,
    )


def ewma_step(carry: DataFrame, columns: dict[str, str], rate: float) -> Step:
    """``apply_ewma`` as a step; a null adds nothing."""
    keep = 1.0 - rate

    def run(values: dict[str, pa.Array], state: dict) -> dict:
        found = {}
        for c, o in columns.items():
            x, there = floats(values[c]), values[c].is_valid().to_numpy(zero_copy_only=False)
            t, start = np.arange(len(x), dtype=float), state[f"_c_{o}"]
            grown = np.cumsum(np.where(there, x, 0.0) * rate * keep**-t)
            before = np.concatenate(([0.0], grown[:-1]))
            found[f"{o}_prior"] = before * keep ** (t - 1) + (np.nan if start is None else start) * keep**t
            found[o] = x * rate + keep * found[f"{o}_prior"]
        return found

    adds = T.StructType([T.StructField(name, T.DoubleType()) for name in [*[f"{o}_prior" for o in columns.values()], *columns.values()]])
    return Step(carry, list(columns), adds, run)


def apply_ewma(rows, carry, columns, rate, bits=None, keys=None) -> DataFrame:
    """With ``keys``, rows of a table with whole blocks stay where they are."""
    bits = ewma_bits(rate) if bits is None else bits
    if keys is not None and in_place(rows):
        return run_blocks(rows, keys, bits, [ewma_step(carry, columns, rate)])
    before = block_window().rowsBetween(Window.unboundedPreceding, -1)
    keep = F.lit(1.0 - rate)
    local = rows.select(
        "*",
        (F.row_number().over(block_window()) - 1).cast("double").alias("_k"),
        *[
            F.coalesce(F.sum(_grown(c, rate, bits)).over(before), F.lit(0.0)).alias(f"_l_{o}")
            for c, o in columns.items()
        ],
    )
    joined = local.join(carry, [KEY, BLOCK])
    kept = [F.col(c) for c in rows.columns]
    priors = {
        o: F.col(f"_l_{o}") * F.pow(keep, _position(bits) - 1) + F.col(f"_c_{o}") * F.pow(keep, F.col("_k"))
        for o in columns.values()
    }
    joined = joined.select(*kept, *[p.alias(f"{o}_prior") for o, p in priors.items()])
    return joined.select("*", *[
        (F.col(c) * rate + keep * F.col(f"{o}_prior")).alias(o) for c, o in columns.items()
    ])


def moments_merge(held, block):
    """Merge (n, mean[], m2[]) of two stretches of rows."""
    n0, mean0, m20 = held
    n1, mean1, m21 = block
    if not n0:
        return int(n1), list(mean1), list(m21)
    n = n0 + n1
    mean, m2 = [], []
    for a, b, p, q in zip(mean0, mean1, m20, m21):
        delta = b - a
        mean.append(a + delta * n1 / n)
        m2.append(p + q + delta * delta * n0 * n1 / n)
    return int(n), mean, m2


def running_moments(
    staged: DataFrame, keys: Sequence[str], columns: Sequence[str], initial: DataFrame | None = None
) -> DataFrame:
    """Count, mean and sum of squared deviations of each column up to and including the row.

    Adds ``n`` and, per column c, ``c_mean`` and ``c_m2``.
    """
    rows = with_block(staged, keys)
    carry = moments_carry(rows, keys, columns, initial)
    return apply_moments(rows, carry, columns)


def moments_carry(rows, keys, columns, initial=None, with_final=False) -> DataFrame:
    summary = rows.groupBy(KEY, BLOCK).agg(
        F.count(F.lit(1)).alias("_n"),
        F.array(*[F.avg(c) for c in columns]).alias("_mean"),
        F.array(*[F.var_pop(c) * F.count(F.lit(1)) for c in columns]).alias("_m2"),
    )
    width = len(columns)
    return carry_in(
        summary, keys, "_n0 long, _mean0 array<double>, _m20 array<double>",
        (0, [0.0] * width, [0.0] * width), moments_merge, ["_n", "_mean", "_m2"], initial, with_final,
        moments_merge,
    )


def apply_moments(rows, carry, columns) -> DataFrame:
    win = block_window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.select(
        "*",
        F.count(F.lit(1)).over(win).alias("_k"),
        *[F.avg(c).over(win).alias(f"_a_{c}") for c in columns],
        *[F.var_pop(c).over(win).alias(f"_q_{c}") for c in columns],
    )
    joined = local.join(carry, [KEY, BLOCK]).withColumn("n", F.col("_n0") + F.col("_k"))
    share = (F.col("_k") / F.col("n")).alias("_share")
    joined = joined.withColumn("_share", share)
    merged = []
    for i, c in enumerate(columns):
        delta = F.col(f"_a_{c}") - F.col("_mean0")[i]
        fresh = F.col("_n0") == 0
        merged.append(
            F.when(fresh, F.col(f"_a_{c}")).otherwise(F.col("_mean0")[i] + delta * F.col("_share")).alias(f"{c}_mean")
        )
        merged.append(
            F.when(fresh, F.col(f"_q_{c}") * F.col("_k"))
            .otherwise(
                F.col("_m20")[i] + F.col(f"_q_{c}") * F.col("_k")
                + delta * delta * F.col("_n0") * F.col("_share")
            )
            .alias(f"{c}_m2")
        )
    kept = [c for c in rows.columns if c not in (BLOCK, KEY)]
    return joined.select(*kept, "n", *merged)


def zscore(x: Column, n: Column, mean: Column, m2: Column) -> Column:
    """Standard score against the moments so far; 0 with fewer than 2 rows or no spread."""
    sd = F.sqrt(F.try_divide(m2, n - 1))
    return F.when((n >= 2) & (sd > 1e-8), F.try_divide(x - mean, sd)).otherwise(F.lit(0.0))


def running_zscores(staged, keys, columns, initial=None) -> DataFrame:
    """Adds ``c_z`` per column: the running z-score, the current row included.

    The moments before each block come from a partial aggregation; the rows of one block then
    go through one vectorised call.
    """
    rows = with_block(staged, keys)
    return apply_zscores(rows, moments_carry(rows, keys, columns, initial), columns)


def apply_zscores(rows, carry, columns) -> DataFrame:
    columns = list(columns)
    out = T.StructType([f for f in rows.schema.fields if f.name not in (BLOCK, KEY)])
    for c in columns:
        out.add(f"{c}_z", T.DoubleType())

    def score(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ROW, kind="stable").drop(columns=[BLOCK, KEY])
        z = block_scores(pdf, start, columns)
        return pd.concat([pdf, pd.DataFrame(z, columns=[f"{c}_z" for c in columns], index=pdf.index)], axis=1)

    return rows.groupBy(KEY, BLOCK).cogroup(carry.groupBy(KEY, BLOCK)).applyInPandas(score, out)


def block_scores(pdf: pd.DataFrame, start: pd.DataFrame, columns: Sequence[str]):
    """z-scores of the ordered rows of one block, given the moments before it."""
    x = pdf[list(columns)].to_numpy(dtype=float)
    return running_scores(x, start["_n0"].iloc[0], start["_mean0"].iloc[0], start["_m20"].iloc[0])


def running_last(staged: DataFrame, keys: Sequence[str], column: str, out: str) -> DataFrame:
    """Last non-null value of ``column`` up to the row: an as-of lookup over a union of two tables."""
    rows = with_block(staged, keys)
    summary = rows.groupBy(KEY, BLOCK).agg(
        F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(ROW))).alias("_v")
    )
    before = blocks_in_order().rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(KEY, BLOCK, F.last("_v", ignorenulls=True).over(before).alias("_before"))
    win = block_window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumn("_here", F.last(column, ignorenulls=True).over(win))
    return (
        local.join(carry, [KEY, BLOCK])
        .withColumn(out, F.coalesce("_here", "_before"))
        .drop("_here", "_before", BLOCK, KEY)
    )
