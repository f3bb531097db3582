"""Sharding: a uniform shuffle with exact shard sizes by a hypergeometric communication matrix.

Rows are numbered once and cut into blocks. How many rows of each block go to each shard is drawn first,
as a matrix with fixed row sums (block sizes) and column sums (shard sizes): the law a uniform permutation
would give it. Each block then permutes its rows and deals them by its row of the matrix, shards exchange,
and each shard permutes what it got. Everything is DataFrame expressions; only row numbers are sorted, and
texts cross the network once.

The matrix is drawn in two levels, first for groups of blocks, then for the blocks of each group in
parallel, so no task holds more than one number for each group or block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from slowtruth.llm.common import numbered, restored
from slowtruth.session import materialize

#: A block has at most 2**BLOCK_BITS rows, a group at most 2**GROUP_BITS blocks of one writer.
BLOCK_BITS, GROUP_BITS = 17, 8
SEED = 20260


def let(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on ``parts`` alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0**-53)


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` rows are good if ``good`` of ``total`` are: inversion at ``u``.

    Weights follow from the ratio of neighbours, so no factorials are needed. Values further than nine standard
    deviations and forty from the mean weigh less than a double can tell from nothing.
    """
    def ratio(p: Column, k: Column) -> Column:
        up = (p.good - k).cast("double") * (p.drawn - k)
        return up / ((k + 1).cast("double") * (p.total - p.good - p.drawn + k + 1))

    def bounds(p: Column) -> Column:
        share = p.good / F.greatest(p.total, F.lit(1))
        mean = p.drawn * share
        spread = 40 + 9 * F.sqrt(mean * (1 - share) * (p.total - p.drawn) / F.greatest(p.total - 1, F.lit(1)))
        low = F.greatest(F.lit(0), p.drawn + p.good - p.total, F.floor(mean - spread))
        high = F.least(p.drawn, p.good, F.ceil(mean + spread))
        return F.struct(p.total.alias("total"), p.good.alias("good"), p.drawn.alias("drawn"), p.u.alias("u"),
                        low.alias("low"), F.greatest(low, high).alias("high"))

    def weight(p: Column) -> Column:
        return F.aggregate(
            F.sequence(p.low, p.high), F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum")),
            lambda z, k: F.struct((z.w * ratio(p, k)).alias("w"), (z["sum"] + z.w).alias("sum")))["sum"]

    def invert(p: Column) -> Column:
        found = F.aggregate(
            F.sequence(p.low, p.high),
            F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), p.low.alias("k")),
            lambda z, k: F.struct((z.w * ratio(p, k)).alias("w"), (z["sum"] + z.w).alias("sum"),
                                  F.when(z["sum"] + z.w <= p.goal, k + 1).otherwise(z.k).alias("k")))["k"]
        return F.least(found, p.high)

    given = F.struct(total.alias("total"), good.alias("good"), drawn.alias("drawn"), u.alias("u"))
    return let(given, lambda p: let(bounds(p), lambda q: let(
        F.struct(q.total.alias("total"), q.good.alias("good"), q.drawn.alias("drawn"), q.low.alias("low"),
                 q.high.alias("high"), (q.u * weight(q)).alias("goal")), invert)))


def deal(parts: Column, quotas: Column, seed: Column) -> Column:
    """Rows of a random matrix: for each ``(id, n)`` of ``parts`` how many of its n rows go to each shard.

    Row sums are n, column sums the quotas, which must have the same total.
    """
    nothing = F.array().cast("array<bigint>")

    def row(part: Column, left: Column) -> Column:
        start = F.struct(part.n.alias("rows"), F.aggregate(left, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("seats"),
                         F.lit(0).alias("shard"), nothing.alias("took"))
        step = lambda z, seats: let(
            hypergeometric(z.seats, seats, z.rows, uniform(seed, part.id, z.shard)),
            lambda k: F.struct((z.rows - k).alias("rows"), (z.seats - seats).alias("seats"), (z.shard + 1).alias("shard"),
                               F.array_append(z.took, k).alias("took")))
        return F.aggregate(left, start, step)["took"]

    start = F.struct(quotas.alias("left"), F.array().cast("array<struct<id:bigint,took:array<bigint>>>").alias("rows"))
    step = lambda z, part: let(row(part, z.left), lambda took: F.struct(
        F.zip_with(z.left, took, lambda a, b: a - b).alias("left"),
        F.array_append(z["rows"], F.struct(part.id.alias("id"), took.alias("took"))).alias("rows")))
    return F.aggregate(parts, start, step)["rows"]


def communication_matrix(blocks: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(block, took): exact counts from each block to each shard; ``blocks`` is (group, block, n).

    Shard sizes differ by one at most, the first shards are the larger ones.
    """
    parts = lambda name: F.sort_array(F.collect_list(F.struct(F.col(name).alias("id"), "n")))
    groups = blocks.groupBy("group").agg(F.sum("n").alias("n"))
    total = F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, x: a + x.n)
    quotas = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.floor(F.col("total") / shards).cast("bigint")
                         + F.when(s < F.col("total") % shards, 1).otherwise(0).cast("bigint"))
    by_group = (
        groups.agg(parts("group").alias("parts")).withColumn("total", total)
        .select(F.explode(deal(F.col("parts"), quotas, F.lit(f"{seed}-groups"))).alias("x"))
        .select(F.col("x.id").alias("group"), F.col("x.took").alias("quotas"))
    )
    return (
        blocks.groupBy("group").agg(parts("block").alias("parts")).join(by_group, "group")
        .select(F.explode(deal(F.col("parts"), F.col("quotas"), F.lit(f"{seed}-blocks"))).alias("x"))
        .select(F.col("x.id").alias("block"), F.col("x.took").alias("took"))
    )


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = SEED, block_bits: int = BLOCK_BITS) -> DataFrame:
    """All rows of ``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (0, 1, ... without gaps in each shard).

    Every assignment of rows to places is equally likely. Shard sizes differ by one at most.

    Values do not matter: null or empty texts and repeated rows are rows like others, each with its own place.
    An empty table gives an empty table. Rows are numbered when they are first written to the shared folder, so
    lost executors change nothing; another run over other input files draws another permutation.
    """
    names = docs.columns
    rows = materialize(numbered(docs).withColumn("row", F.monotonically_increasing_id()), "numbered")
    ids = rows.select("row", F.shiftright("row", block_bits).alias("block"))
    blocks = materialize(
        ids.groupBy("block").agg(F.count(F.lit(1)).alias("n")).withColumn("group", F.shiftright("block", GROUP_BITS)), "blocks")
    total = blocks.agg(F.sum("n")).first()[0] or 0
    matrix = communication_matrix(blocks, shards, seed).select("block", F.transform(
        F.sequence(F.lit(1), F.lit(shards)),
        lambda s: F.aggregate(F.slice("took", F.lit(1), s), F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("cuts"))
    place = F.row_number().over(W.partitionBy("block").orderBy(F.xxhash64(F.lit(f"{seed}-local"), "row"), "row")) - 1
    # the exchange: rows of a shard fall into cells by their second random key, about 2**block_bits rows each
    cells = 1
    while total // shards // cells > 1 << block_bits:
        cells *= 2
    key = F.xxhash64(F.lit(f"{seed}-final"), "row")
    dealt = materialize(
        ids.withColumn("place", place).join(matrix, "block")
        .select("row", F.size(F.filter("cuts", lambda c: c <= F.col("place"))).alias("shard"), key.alias("key"))
        .withColumn("cell", F.pmod(F.shiftrightunsigned("key", 8), F.lit(cells))), "dealt")
    before = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    inside = F.row_number().over(W.partitionBy("shard", "cell").orderBy("key", "row")) - 1
    slots = (
        dealt.withColumn("inside", inside).join(offsets, ["shard", "cell"])
        .select("row", "shard", (F.col("offset") + F.col("inside")).alias("slot"))
    )
    # the exchange of the texts: always a shuffle, since the table of places grows with the rows
    return restored(rows.join(slots.hint("merge"), "row"), names, ["shard", "slot"])


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 of equal row counts, each in a uniform random order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return shard_rows(docs, 8).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
