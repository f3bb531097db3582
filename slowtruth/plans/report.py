"""Reports over the metrics table: newest rows per grade, current wear, chart series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slowtruth.functions import expr
from slowtruth.sources import sinks

# Series name of each metric column.
SERIES = {
    "Baseline": "baseline_ape",
    "Target Mean": "target_mean_ape",
    "SGD": "sgd_ape",
    "AMRules (Safe)": "am_rules_ape",
    "AMRules (Shadow)": "am_rules_shadow_ape",
}


def grade_filter(metrics: DataFrame, grade: str) -> DataFrame:
    """Rows of one grade; on a table partitioned by grade only its folder is read."""
    return metrics.where(F.col("steel_grade") == grade)


def latest_per_grade(metrics: DataFrame, count: int = 60, keys: Sequence[str] = ("steel_grade",)) -> DataFrame:
    """Newest ``count`` rows of every grade, numbered oldest first as ``position``.

    The rank limit is applied before the shuffle too, so only ``count`` rows per grade and task travel.
    """
    newest = Window.partitionBy(*keys).orderBy(
        F.col("evaluation_timestamp").desc(), F.col("slab_id"), F.col("pass_number")
    )
    top = metrics.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= count)
    oldest = Window.partitionBy(*keys).orderBy(F.col("_rn").desc())
    return top.withColumn("position", F.row_number().over(oldest)).drop("_rn")


def newest_folders(spark: SparkSession, path: str, count: int) -> list[str]:
    """The (grade, period) folders of a metrics table that hold the newest ``count`` rows of each grade.

    Periods are taken from the newest one back, twice as many at each round, until a grade has its rows or no period is left.
    Folder names are the only thing seen of older ones. Rows without a time are in a folder of their own, which comes last.
    """
    left, chosen, take = {}, {}, 1
    for grade in sinks.folders(spark, path):
        if grade.startswith(f"{sinks.GRADE}="):
            periods = [p for p in sinks.folders(spark, f"{path}/{grade}") if p.startswith(f"{sinks.PERIOD}=")]
            left[grade] = sorted(periods, key=lambda p: (not p.startswith(f"{sinks.PERIOD}=__"), p))
            chosen[grade] = []
    open_ = list(left)
    while open_:
        for grade in open_:
            chosen[grade] += [left[grade].pop() for _ in range(min(take, len(left[grade])))]
        rows = [sinks.read_metrics(spark, path, [f"{g}/{p}" for p in chosen[g]]).agg(
            F.lit(g).alias("grade"), F.count(F.lit(1)).alias("n")) for g in open_]
        counted = rows[0]
        for more in rows[1:]:
            counted = counted.unionByName(more)
        full = {r.grade for r in counted.collect() if r.n >= count}
        open_ = [g for g in open_ if g not in full and left[g]]
        take *= 2
    return [f"{g}/{p}" for g, periods in chosen.items() for p in periods]


def newest_rows(spark: SparkSession, path: str, count: int = 60) -> DataFrame:
    """``latest_per_grade`` of a metrics table, without reading its history."""
    return latest_per_grade(sinks.read_metrics(spark, path, newest_folders(spark, path, count)), count)


def current_wear(metrics: DataFrame) -> DataFrame:
    """Wear of the newest row of each grade, to 2 digits."""
    return latest_per_grade(metrics, 1).select(
        "steel_grade", expr.display_round(F.col("wear_level")).alias("current_wear")
    )


def metric_series(metrics: DataFrame, chosen: Sequence[str] = tuple(SERIES)) -> DataFrame:
    """Chosen metric columns as rows: series name and value to 2 digits."""
    ids = [c for c in ("steel_grade", "position", "evaluation_timestamp", "slab_id", "pass_number") if c in metrics.columns]
    wide = metrics.select(*ids, *[F.col(SERIES[name]).alias(name) for name in chosen])
    long = wide.unpivot(ids, list(chosen), "series", "value")
    return long.withColumn("value", expr.display_round(F.col("value"))).withColumn(
        "label", expr.display_time(F.col("evaluation_timestamp"))
    )
