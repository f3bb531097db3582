"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of (source, language, topic). One factor for each value of each dimension
is fitted in turn until the weighted tokens of every source, language and topic have their target shares.
The product of a cell's factors is its weight. A token budget sets the rate: a document is kept with probability
min(1, rate times weight), and the rate is solved on the table of cells so that the expected tokens are the budget.
A cell that is too small for its weight is kept whole and nothing is repeated; it cannot lower the rate of the others.

The corpus is read twice: once to count cells (partial aggregation, one row for each cell and task), once to
sample. Fitting touches only the table of cells and the tables of factors.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slowtruth.llm.common import numbered, position, restored
from slowtruth.session import materialize

TOLERANCE, MAX_ROUNDS = 1e-11, 100
SEED = "mix"
#: Tokens to keep, as a share of all tokens.
BUDGET = 0.68
#: No value is given more than so many times its observed tokens.
CARRY = 4.0


class Margin(NamedTuple):
    """A dimension: its column, and target shares.

    Values named in ``shares`` get that share; the others split the rest in proportion to their observed tokens to the
    power ``temper`` (1: as observed, 0: all alike). A null is a value of its own, named ``None``.
    """

    column: str
    shares: Mapping[str | None, float] = {}
    temper: float = 1.0


def label(column: Column) -> Column:
    """A value as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def words(text: Column) -> Column:
    """Words of a text and one for its end, so that no document weighs nothing."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t\\n\\x0B\\f\\r]+")) + 1).cast("long")


def fill(table: DataFrame, wanted: str, limit: str, amount: float) -> float:
    """The factor f for which the sum of min(f * wanted, limit) is ``amount``; infinite where the limits are below it.

    Each round sets the rows beyond their limit to it and spreads what is left over the others; no row comes back.
    """
    factor, w, most = 0.0, F.col(wanted), F.col(limit)
    while True:
        over = w * factor > most
        held, rest = table.where(w > 0).agg(
            F.coalesce(F.sum(F.when(over, most)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, w)), F.lit(0.0))).first()
        new = (amount - held) / rest if rest else float("inf")
        if new <= factor * (1 + 1e-12):
            return factor
        if new == float("inf"):
            return new
        factor = new


def targets(cells: DataFrame, k: int, margin: Margin, total: int, carry: float | None = None) -> DataFrame:
    """(d{k}, target{k}): the tokens that each value of one dimension should have, at most ``carry`` times its own."""
    named = F.lit(None).cast("double")
    for value, share in margin.shares.items():
        key = "null" if value is None else f"={value}"
        named = F.when(F.col(f"d{k}") == key, F.lit(float(share))).otherwise(named)
    sums = cells.groupBy(f"d{k}").agg(F.sum("tokens").alias("tokens")).select(
        f"d{k}", (F.col("tokens") * float(carry or 0.0)).alias("most"), named.alias("named"),
        F.pow(F.col("tokens").cast("double"), F.lit(float(margin.temper))).alias("free"))
    both = sums.agg(F.coalesce(F.sum("named"), F.lit(0.0)), F.sum(F.when(F.col("named").isNull(), F.col("free")))).first()
    given, free = both[0], both[1]
    # with no value left to take the rest, or more than everything given away, the named shares are scaled
    rest = max(0.0, 1.0 - given) if free else 0.0
    scale = 1.0 / (given + rest) if given + rest else 0.0
    share = F.coalesce(F.col("named") * scale, F.col("free") * (rest * scale / (free or 1.0)))
    wanted = sums.select(f"d{k}", (share * float(total)).alias(f"target{k}"), "most")
    if carry is not None:
        wanted = materialize(wanted, f"wanted{k}")
        factor = fill(wanted, f"target{k}", "most", float(total))
        most = F.when(F.col(f"target{k}") > 0, F.col("most")).otherwise(F.lit(0.0))
        wanted = wanted.withColumn(f"target{k}", F.least(F.col(f"target{k}") * factor, most) if factor < float("inf") else most)
    return wanted.drop("most")


def rake(cells: DataFrame, margins: list[Margin], total: int, tolerance: float, max_rounds: int,
         carry: float | None = None) -> list[DataFrame]:
    """Factor tables (d{k}, f{k}), one for each dimension, fitted in turn until no factor changes."""
    wanted = [materialize(targets(cells, k, m, total, carry), f"targets{k}") for k, m in enumerate(margins)]
    factors = [t.select(f"d{k}", F.lit(1.0).alias(f"f{k}")) for k, t in enumerate(wanted)]
    for _ in range(max_rounds):
        worst = 0.0
        for k, t in enumerate(wanted):
            joined, product = cells, F.col("tokens").cast("double")
            for j, f in enumerate(factors):
                if j != k:
                    joined, product = joined.join(f, f"d{j}"), product * F.col(f"f{j}")
            sums = joined.groupBy(f"d{k}").agg(F.sum(product).alias("sum"))
            fitted = t.join(sums, f"d{k}").join(factors[k].withColumnRenamed(f"f{k}", "old"), f"d{k}").select(
                f"d{k}", F.coalesce(F.try_divide(f"target{k}", "sum"), F.lit(0.0)).alias(f"f{k}"), "old")
            fitted = materialize(fitted, f"factors{k}")
            change = fitted.agg(F.max(F.abs(F.col(f"f{k}") - F.col("old")) / F.greatest(F.col("old"), F.lit(1e-300)))).first()[0]
            worst = max(worst, change or 0.0)
            factors[k] = fitted.select(f"d{k}", f"f{k}")
        if worst <= tolerance:
            break
    return factors


def mix_to_targets(docs: DataFrame, margins: list[Margin], doc_id: str = "doc_id", text: str = "text",
                   tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS, seed: str = SEED,
                   rate: float = 1.0, budget: float | None = BUDGET, carry: float = CARRY) -> DataFrame:
    """All rows of ``docs`` with ``tokens``, ``weight`` (target over observed), ``probability`` and ``kept``.

    ``probability`` is ``rate`` times min(1, f * weight), with f such that the expected tokens at rate 1 are ``budget``:
    a share of all tokens up to 1, else a number of tokens. Cells that f * weight would repeat are kept whole, and
    what they cannot give comes from the others; with all cells whole, less than the budget is kept. No value is given
    more than ``carry`` times its observed tokens; the rest of a share beyond that goes to the other values.

    ``budget=None`` divides by the largest weight instead and limits no share: all margins then stand in the target
    proportions, but the smallest cell sets the rate of the whole corpus.

    ``kept`` compares the probability with a number that depends on the id and the seed alone: rows of the same id share
    their fate, and a larger rate keeps a superset.

    A null or empty text has one token. Nulls in a dimension are a value of their own; null ids are one id. Targets that
    cannot be met together (a value without cells, zero cells in the wrong places) are met as far as ``max_rounds``
    get. An empty table gives an empty table.
    """
    names = docs.columns
    at = lambda c: F.col(f"_{position(docs, c)}")
    dims = [f"d{k}" for k in range(len(margins))]
    rows = numbered(docs).withColumn("tokens", words(at(text))).withColumns(
        {d: label(at(m.column)) for d, m in zip(dims, margins)})
    cells = materialize(rows.groupBy(*dims).agg(F.sum("tokens").alias("tokens")), "cells")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    factors = rake(cells, margins, total, tolerance, max_rounds, None if budget is None else carry)
    weighted = cells
    for f in factors:
        weighted = weighted.join(f, f.columns[0])
    weight = F.lit(1.0)
    for k in range(len(dims)):
        weight = weight * F.col(f"f{k}")
    weighted = materialize(weighted.select(*dims, weight.alias("weight"), "tokens"), "weights")
    if budget is None:
        probability = F.col("weight") * (rate / (weighted.agg(F.max("weight")).first()[0] or 1.0))
    else:
        each = weighted.select((F.col("weight") * F.col("tokens")).alias("wanted"), F.col("tokens").cast("double").alias("most"))
        f = fill(each, "wanted", "most", budget * total if budget <= 1 else float(budget))
        probability = F.when(F.col("weight") > 0, F.least(F.lit(1.0), F.col("weight") * f)).otherwise(F.lit(0.0)) * rate
    weighted = weighted.drop("tokens")
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), label(at(doc_id)))), 1, 13), 16, 10).cast("double") * 2.0**-52
    out = (
        rows.join(weighted, dims).withColumn("probability", probability)
        .withColumn("kept", u < F.col("probability"))
    )
    return restored(out, names, ["tokens", "weight", "probability", "kept"])


def form(text: Column) -> Column:
    """A topic that can be read off the text: table, markup, prose of several lines, or snippet."""
    t = F.coalesce(text, F.lit(""))
    return (F.when(t.contains(" | "), "table").when(t.rlike("[#*$%&]{3}"), "markup")
            .when(t.contains("\n"), "prose").otherwise("snippet"))


#: Flatten large sources, raise small languages a little, halve what is no prose.
TARGETS = [
    Margin("source", temper=0.7), Margin("lang", {"en": 0.5}, temper=0.8),
    Margin("topic", {"markup": 0.02, "table": 0.03}),
]


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """Weights and sample of all documents for the production targets, at the rate that the SQL states."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    mixed = mix_to_targets(docs.withColumn("topic", form(F.col("text"))), TARGETS, budget=None)
    return mixed.select("doc_id", "source", "lang", "topic", "tokens", F.round("weight", 8).alias("weight"),
                        F.round("probability", 8).alias("probability"), "kept")


def _op4_sql(rounds: int = 60) -> str:
    """Weights by the same targets, in a fixed number of rounds."""
    def wanted(k: int, m: Margin) -> str:
        named = "CASE " + " ".join(f"WHEN d{k} = '={v}' THEN {s}" for v, s in m.shares.items()) + " END" if m.shares else "NULL"
        return f"""t{k} AS (SELECT d{k}, T.tokens * coalesce(named, free / sum(free) FILTER (named IS NULL) OVER ()
                   * (1 - coalesce(sum(named) OVER (), 0))) AS target{k}
          FROM (SELECT d{k}, CAST({named} AS DOUBLE) AS named, pow(sum(tokens)::DOUBLE, {m.temper}) AS free
                FROM cells GROUP BY d{k}), T)"""

    n = range(len(TARGETS))
    steps, last = [], "w0"
    for i in range(rounds):
        for k in n:
            new = f"w{i}_{k}"
            steps.append(f"{new} AS MATERIALIZED (SELECT * REPLACE (w * target{k} / sum(w) OVER (PARTITION BY d{k}) AS w) FROM {last})")
            last = new
    return f"""
WITH doc AS (SELECT doc_id, source, lang, CASE WHEN text LIKE '% | %' THEN 'table'
                    WHEN regexp_matches(coalesce(text, ''), '[#*$%&]{{3}}') THEN 'markup'
                    WHEN text LIKE '%' || chr(10) || '%' THEN 'prose' ELSE 'snippet' END AS topic,
                    len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) + 1 AS tokens FROM documents),
     keyed AS (SELECT *, coalesce('=' || source, 'null') AS d0, coalesce('=' || lang, 'null') AS d1, '=' || topic AS d2 FROM doc),
     cells AS (SELECT d0, d1, d2, sum(tokens) AS tokens FROM keyed GROUP BY ALL),
     T AS (SELECT sum(tokens)::DOUBLE AS tokens FROM cells),
     {', '.join(wanted(k, m) for k, m in enumerate(TARGETS))},
     w0 AS (SELECT cells.*, tokens::DOUBLE AS w, {', '.join(f'target{k}' for k in n)}
            FROM cells JOIN t0 USING (d0) JOIN t1 USING (d1) JOIN t2 USING (d2)),
     {', '.join(steps)},
     f AS (SELECT d0, d1, d2, w / tokens AS weight, w / tokens / max(w / tokens) OVER () AS probability FROM {last})
SELECT doc_id, source, lang, topic, CAST(keyed.tokens AS BIGINT) AS tokens, round(weight, 8) AS weight,
       round(probability, 8) AS probability,
       ('0x' || substr(md5('{SEED}:' || coalesce('=' || doc_id, 'null')), 1, 13))::BIGINT / 4503599627370496.0 < probability AS kept
FROM keyed JOIN f USING (d0, d1, d2)
"""


OP4_SQL = _op4_sql()
