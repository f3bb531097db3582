"""Maps the given tables to rolling passes, events and raw messages (see FIXTURES.md).

Only plain arithmetic on table columns, no random numbers, so a SQL oracle can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slowtruth.functions import expr


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line, with ``k``: its number among the lines of the same order and line number, ordered by the other columns."""
    rest = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("int").alias("p"), *rest)
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("o", "p").orderBy(*rest)))


def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling passes with features, baseline, wear and measured force: three drift regimes by grade."""
    base = lines(spark, sf_dir).select(
        "o", "p",
        F.when(F.col("k") == 1, F.col("o").cast("string")).otherwise(F.concat_ws("-", "o", "k")).alias("slab_id"),
        F.col("p").alias("pass_number"),
        F.expr("CASE o % 3 WHEN 0 THEN 'structural' WHEN 1 THEN 'microalloyed' ELSE 'high_alloy' END").alias(
            "steel_grade"
        ),
        F.expr(
            "CAST(l_shipdate AS TIMESTAMP_NTZ) + make_dt_interval(0, 0, CAST(o % 1440 AS INT), 10 * p)"
        ).alias("requested_at"),
        F.expr("CAST(2 + floor(l_quantity / 10) AS INT)").alias("delay"),
        "l_shipdate", "l_tax",
        F.expr("15 + 4.7D * l_quantity").alias("entry_thickness_mm"),
        F.expr("1613 + CAST(floor(l_extendedprice) AS DOUBLE) % 2500").alias("width_mm"),
        F.expr("1794 + 10 * CAST(l_partkey % 3600 AS DOUBLE)").alias("length_mm"),
        F.expr("889 + CAST((37 * l_suppkey + 11 * o) % 344 AS DOUBLE)").alias("temperature_c"),
        F.expr("round(0.01D + 3 * l_discount, 3)").alias("reduction_pct"),
        F.expr("135 + CAST(l_partkey % 1000 AS DOUBLE)").alias("reheating_time_min"),
        F.expr("1042 + CAST(l_suppkey % 80 AS DOUBLE)").alias("roll_diameter_mm"),
        F.expr("CAST(o % 217 AS DOUBLE)").alias("roll_crown_mm"),
        F.expr("1.5D + l_quantity * 0.08D").alias("speed_m_s"),
        F.expr("6 + CAST(l_partkey % 219 AS DOUBLE)").alias("wait_time_sec"),
        F.expr("0.02D + l_discount * 5").alias("strain"),
        F.expr("0.5D + l_quantity * 0.3D").alias("strain_rate"),
    )
    c = F.col
    out = base.withColumn(
        "baseline",
        expr.baseline_force(c("steel_grade"), c("width_mm"), c("entry_thickness_mm"), c("reduction_pct"), c("temperature_c")),
    )
    wear = F.expr(
        """CASE steel_grade
             WHEN 'structural' THEN 0.0D
             WHEN 'high_alloy' THEN CASE WHEN l_shipdate >= TIMESTAMP_NTZ'1998-07-01' THEN 60.0D ELSE 0.0D END
             ELSE 60.0D * abs(CAST(pmod(datediff(l_shipdate, DATE'1995-01-01'), 730) AS DOUBLE) / 365 - 1)
           END"""
    )
    out = out.withColumn("wear_level", wear)
    factor = expr.wear_factor(c("wear_level"), c("temperature_c"), c("entry_thickness_mm"), c("reduction_pct"))
    noise = F.expr("CAST((31 * o + 17 * p) % 2001 - 1000 AS DOUBLE) / 1000 * 800")
    return out.withColumn(
        "actual", F.round(F.greatest(c("baseline") * factor + noise, F.lit(0.0)), 2)
    ).withColumn("measured_at", F.expr("requested_at + make_dt_interval(0, 0, 0, delay)"))


def feature_map(optional: bool = True) -> Column:
    """The features of a pass as a map; flow stress is never sent, two more only now and then."""
    names = [n for n in expr.FEATURE_DEFAULTS if n != "flow_stress_mpa"]

    def entries(sent: list[str]) -> Column:
        return F.map_from_arrays(F.array(*map(F.lit, sent)), F.array(*map(F.col, sent)))

    if not optional:
        return entries(names)
    fewer = [n for n in names if n not in ("strain", "roll_crown_mm")]
    return F.when(F.col("l_tax") > 0.06, entries(fewer)).otherwise(entries(names))


def requests(spark: SparkSession, sf_dir: str, source: DataFrame | None = None, features: bool = True) -> DataFrame:
    """Prediction requests, flat. Some passes have none, so that their ground truth is an orphan.

    Without ``features`` the column is left out, and its map is not built.
    """
    rows = source if source is not None else passes(spark, sf_dir)
    rows = rows.where("(o + p) % 50 != 1")
    if features:
        rows = expr.once(rows, "features", feature_map())
    return rows.select(
        "slab_id", "pass_number", "steel_grade",
        F.col("requested_at").alias("ts"),
        *(["features"] if features else []),
        F.col("baseline").alias("baseline_roll_force_kn"),
    )


def truths(spark: SparkSession, sf_dir: str, source: DataFrame | None = None) -> DataFrame:
    """Ground truths, flat. Some passes have none, so that their request is an orphan."""
    rows = source if source is not None else passes(spark, sf_dir)
    return rows.where("(o + p) % 50 != 0").select(
        "slab_id", "pass_number",
        F.col("measured_at").alias("ts"),
        F.col("actual").alias("actual_roll_force_kn"),
        "wear_level",
    )


def both_sides(spark: SparkSession, sf_dir: str, features: str | None = "map") -> DataFrame:
    """Requests and truths in one table: ``side``, and a struct ``a`` or ``b`` of the columns that ``requests`` or ``truths`` have.

    The passes are made once for the two of them. ``features`` says what a request carries: its ``map``, the ``vector`` of its
    measured values (``measured``), from which the models' other inputs follow, or None.
    """
    rows = passes(spark, sf_dir)
    carried = []
    if features is not None:
        rows, carried = expr.once(rows, "features", feature_map()), ["features"]
    if features == "vector":
        rows, carried = expr.once(rows, "measured", expr.measured_vector(F.col("features"))), ["measured"]
    request = F.struct(
        "slab_id", "pass_number", "steel_grade", F.col("requested_at").alias("ts"), *(c for c in carried if c == "features"),
        F.col("baseline").alias("baseline_roll_force_kn"), *(c for c in carried if c == "measured"),
    )
    truth = F.struct(
        "slab_id", "pass_number", F.col("measured_at").alias("ts"), F.col("actual").alias("actual_roll_force_kn"), "wear_level")
    sides = rows.withColumn("side", F.explode(F.array(F.lit("A"), F.lit("B"))))
    is_request = F.col("side") == "A"
    sides = sides.where(F.when(is_request, F.expr("(o + p) % 50 != 1")).otherwise(F.expr("(o + p) % 50 != 0")))
    return sides.select("side", F.when(is_request, request).alias("a"), F.when(~is_request, truth).alias("b"))


def user_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two messy event sequences per user: repeated, missing and early events all occur."""
    events = table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", "value"
    )
    first = F.col("event_type").isin("click", "view")
    return events.where(first), events.where(~first)


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both event kinds as JSON text, partly wrapped, with an unknown field and some cut short."""
    rows = passes(spark, sf_dir)
    stamp = "yyyy-MM-dd'T'HH:mm:ss.SSS"
    request = F.struct(
        F.lit("prediction_request").alias("event_type"),
        F.date_format("requested_at", stamp).alias("timestamp"),
        F.struct(
            "slab_id", "pass_number", "steel_grade", F.concat("steel_grade", F.lit("_mill")).alias("routing_key")
        ).alias("identifiers"),
        feature_map().alias("features"),
        F.struct(F.col("baseline").alias("baseline_roll_force_kn")).alias("baseline_prediction"),
        F.lit("x").alias("unknown_field"),
    )
    truth = F.struct(
        F.lit("ground_truth").alias("event_type"),
        F.date_format("measured_at", stamp).alias("timestamp"),
        F.struct("slab_id", "pass_number").alias("identifiers"),
        F.struct(F.col("actual").alias("actual_roll_force_kn"), "wear_level").alias("ground_truth"),
    )
    # the side comes first: a reader of one side filters by it before any text of the other is made
    sides = rows.withColumn("side", F.explode(F.array(F.lit("A"), F.lit("B"))))
    is_request = F.col("side") == "A"
    sides = sides.where(F.when(is_request, F.expr("(o + p) % 50 != 1")).otherwise(F.expr("(o + p) % 50 != 0")))
    sent = sides.select(
        "o", "p", "side", F.when(is_request, F.to_json(request)).otherwise(F.to_json(truth)).alias("body"),
        F.when(is_request, F.col("requested_at")).otherwise(F.col("measured_at")).alias("sent_at"),
    )
    # a few messages are on their way for long
    sent = sent.withColumn("delayed", F.expr("(o + 2 * p) % 61 = CASE side WHEN 'A' THEN 11 ELSE 7 END"))
    wrapped = F.when(F.col("p") % 2 == 1, F.concat(F.lit('{"value":'), "body", F.lit("}"))).otherwise(F.col("body"))
    text = F.when(F.col("o") % 97 == 0, F.expr("substring(body, 1, 40)")).otherwise(F.col("body"))
    return sent.withColumn("body", wrapped).withColumn("body", text)
