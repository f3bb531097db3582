"""The registered queries: each operator over whole tables, with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slowtruth.functions import expr
from slowtruth.operators import history, learn, match, scan
from slowtruth.operators.scan import ROW, stage_order
from slowtruth.plans import evaluation, oracle, report
from slowtruth.session import materialize, new_path
from slowtruth.sources import events, fixtures, sinks
from slowtruth.streaming import serving

PASS_KEYS = ["slab_id", "pass_number"]
USER_TTL = 6 * 3600.0
Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None = None


def _text_time(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSS").alias(name)


def _r(name: str, digits: int, out: str | None = None):
    return F.round(F.col(name), digits).alias(out or name)


def _at_rest(spark, sf, features: str | None = "map") -> tuple[DataFrame, DataFrame]:
    """Both event tables on disk, as a user would have them, instead of rederived at every scan.

    ``features`` is what a request carries: its ``map``, the ``vector`` of what is measured, which is a fifth of it, or
    None where no model takes any.
    """
    stored = materialize(fixtures.both_sides(spark, sf, features), "events", compression="zstd")
    return stored.where("side = 'A'").select("a.*"), stored.where("side = 'B'").select("b.*")


def _all_pairs(spark, sf, features: str | None = None) -> DataFrame:
    return match.pair_events(*_at_rest(spark, sf, features), PASS_KEYS)


def _matched(spark, sf, features: str | None = "vector") -> DataFrame:
    return match.match_pairs(_all_pairs(spark, sf, features))


def _user_pairs(spark, sf) -> DataFrame:
    a, b = fixtures.user_events(spark, sf)
    return match.pair_events(a, b, ["user_id"], tie=["event_id"], ttl=USER_TTL)


def _staged_events(spark, sf, key: str) -> DataFrame:
    rows = fixtures.table(spark, sf, "events").select(key, "event_id", F.col("ts").alias("ts"), "value")
    return stage_order(rows, [key], ["ts", "event_id"], "events")


# --- sources and sinks ---


def read_event_stream(spark, sf):
    """Text files as a stream, decoded, written batch by batch, read back."""
    raw = fixtures.raw_messages(spark, sf).where("side = 'A'").select("body")
    source, out, checkpoint = (new_path(spark, n) for n in ("topic", "decoded", "checkpoint"))
    raw.write.option("compression", "lz4").text(source)
    stream = events.decode_events(events.read_event_stream(spark, source), "request")
    query = (
        stream.select(*PASS_KEYS, "steel_grade", "ts", "baseline_roll_force_kn")
        .writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(sinks.batch_writer(out)).start()
    )
    query.awaitTermination()
    return spark.read.parquet(out).select(*PASS_KEYS, "steel_grade", _text_time("ts"), "baseline_roll_force_kn")


def decode_events(spark, sf):
    raw = fixtures.raw_messages(spark, sf)
    good = events.decode_events(raw.where("side = 'A'"), "request")
    x = expr.default_features(F.col("features"))
    return good.select(*PASS_KEYS, "steel_grade", "routing_key", _text_time("ts"), "baseline_roll_force_kn", *x)


def quarantine_events(spark, sf):
    raw = fixtures.raw_messages(spark, sf)
    bad = [
        events.quarantine_events(raw.where(f"side = '{side}'"), kind) for side, kind in (("A", "request"), ("B", "truth"))
    ]
    return bad[0].unionByName(bad[1]).select("o", "p", "side", "reject_reason")


def valid_rows(spark, sf):
    raw = fixtures.raw_messages(spark, sf).where("side = 'B'")
    rows = events.flatten(events.valid_rows(events.parse_events(raw, "truth")), "truth")
    return rows.select(*PASS_KEYS, _text_time("ts"), "actual_roll_force_kn", _r("wear_level", 6))


def route_events(spark, sf):
    raw = fixtures.raw_messages(spark, sf)
    # Cut and unwrapped messages carry no readable envelope and so go to the lifecycle topic.
    return events.route_events(raw).groupBy("topic").agg(F.count(F.lit(1)).alias("n_messages"))


def _gtm_rows(spark, sf) -> DataFrame:
    g = evaluation.guarded_target_mean(_matched(spark, sf, None))
    return g.select(
        "evaluation_timestamp", "steel_grade", *PASS_KEYS, F.col("baseline").alias("baseline_roll_force_kn"),
        _r("raw_force", 2, "target_mean_roll_force_kn"), _r("routed_force", 2, "routed_roll_force_kn"),
        F.col("actual").alias("actual_roll_force_kn"), _r("baseline_ape", 4), _r("shadow_ape", 4), _r("safe_ape", 4),
        _r("wear_level", 6), "fallback",
    )


def guarded_target_mean(spark, sf):
    """Flagship: would the guarded offset model have beaten the physics?"""
    rows = _gtm_rows(spark, sf)
    return rows.withColumn("evaluation_timestamp", F.date_format("evaluation_timestamp", "yyyy-MM-dd HH:mm:ss.SSS"))


def _metrics_path(spark, sf) -> str:
    """Metrics rows (offset model as challenger) written as the metrics table."""
    g = evaluation.guarded_target_mean(_matched(spark, sf, None))
    path = new_path(spark, "metrics")
    sinks.write_metrics_table(
        g.select(
            "evaluation_timestamp", "steel_grade", *PASS_KEYS, "baseline_ape",
            F.col("shadow_ape").alias("target_mean_ape"), F.col("safe_ape").alias("am_rules_ape"),
            F.col("shadow_ape").alias("am_rules_shadow_ape"), "wear_level",
        ),
        path, period="month",
    )
    return path


def _metrics(spark, sf) -> DataFrame:
    return sinks.read_metrics(spark, _metrics_path(spark, sf))


def metrics_rows(spark, sf):
    """All 16 result columns (the linear model guarded), written as the metrics table and read back."""
    path = new_path(spark, "metrics")
    rows = evaluation.prequential_eval(_matched(spark, sf), challenger="linear")[0]
    sinks.write_metrics_table(sinks.as_metrics(rows), path, period="month")
    return _result(sinks.read_metrics(spark, path), guards=False)


def metrics_tsv(spark, sf):
    """The same rows as tab-separated text, read back."""
    path = new_path(spark, "tsv")
    rows = evaluation.prequential_eval(_matched(spark, sf), challenger="linear")[0]
    sinks.write_tsv(sinks.as_metrics(rows), list(sinks.METRICS_COLUMNS), path)
    return _result(sinks.read_tsv(spark, path, sinks.METRICS_SCHEMA), guards=False)


def metrics_table(spark, sf):
    m = _metrics(spark, sf)
    return m.groupBy("steel_grade").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("baseline_ape"), 4).alias("baseline_ape"),
        F.round(F.avg("am_rules_ape"), 4).alias("guarded_ape"),
        F.date_format(F.min("evaluation_timestamp"), "yyyy-MM-dd HH:mm:ss").alias("first_at"),
        F.date_format(F.max("evaluation_timestamp"), "yyyy-MM-dd HH:mm:ss").alias("last_at"),
    )


def write_metrics(spark, sf):
    """A stream into the batched sink: one folder per micro-batch, read back."""
    source, out, checkpoint = (new_path(spark, n) for n in ("truths", "sink", "checkpoint"))
    truths = fixtures.truths(spark, sf)
    truths.write.parquet(source)
    query = sinks.write_metrics(spark.readStream.schema(truths.schema).parquet(source), out, checkpoint, None)
    query.awaitTermination()
    return spark.read.parquet(out).select(*PASS_KEYS, _text_time("ts"), "actual_roll_force_kn", _r("wear_level", 6))


def export_tsv(spark, sf):
    """Written as text and read back, line by line."""
    rows = fixtures.passes(spark, sf).select(
        F.col("measured_at").alias("evaluation_timestamp"), "steel_grade", *PASS_KEYS,
        F.when(F.col("l_tax") > 0.07, F.lit("a\tb\\c\nd\re")).alias("note"),
        (F.col("temperature_c") / 8).alias("eighth"),
    )
    path = new_path(spark, "tsv")
    sinks.write_tsv(rows, rows.columns, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


# --- expressions ---


def engineer_features(spark, sf):
    rows = fixtures.requests(spark, sf)
    parts = expr.engineer_features(F.col("features"))
    return rows.select(*PASS_KEYS, *[c.alias(n) for c, n in zip(parts, expr.ENGINEERED)])


def default_features(spark, sf):
    rows = fixtures.requests(spark, sf)
    return rows.select(*PASS_KEYS, *expr.default_features(F.col("features")))


def feature_vector(spark, sf):
    rows = expr.once(fixtures.requests(spark, sf), "v", expr.feature_vector(F.col("features")))
    return rows.select(*PASS_KEYS, *[F.col("v")[i].alias(n) for i, n in enumerate(expr.FEATURE_NAMES)])


def ape_query(spark, sf):
    rows = fixtures.passes(spark, sf)
    b, a = F.col("baseline"), F.col("actual")
    return rows.select(*PASS_KEYS, F.round(expr.residual(a, b), 2).alias("residual"),
                       F.round(expr.ape(b, a), 6).alias("baseline_ape"),
                       expr.ape(b, a * 0.0).alias("zero_actual_ape"))


def final_force(spark, sf):
    """A given linear model over raw columns: dot product, bias, force."""
    rows = fixtures.passes(spark, sf)
    z = F.array("reduction_pct", "strain", "strain_rate")
    answer = expr.linear_residual(F.lit(5.0), F.array(F.lit(100.0), F.lit(-20.0), F.lit(3.0)), z)
    return rows.select(*PASS_KEYS, F.round(expr.final_force(F.col("baseline"), answer), 3).alias("force"))


def match_key(spark, sf):
    rows = fixtures.requests(spark, sf)
    return rows.select(expr.match_key(F.col("slab_id"), F.col("pass_number")).alias("match_key"))


def event_time(spark, sf):
    """Good and zoned spellings of the event times: a zone suffix gives null, never a shifted time."""
    rows = fixtures.table(spark, sf, "events").select("event_id", F.date_format(
        F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("t"), "event_type")
    text = F.when(F.col("event_type") == "view", F.concat("t", F.lit("+02:00"))).when(
        F.col("event_type") == "error", F.concat("t", F.lit("Z"))).otherwise(F.col("t"))
    return rows.select("event_id", F.coalesce(
        F.date_format(expr.event_time(text), "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("rejected")).alias("event_time"))


def validate_ranges(spark, sf):
    a = events.violation_counts(events.validate_ranges(fixtures.requests(spark, sf)))
    b = events.violation_counts(events.validate_truths(fixtures.truths(spark, sf)))
    return a.withColumn("kind", F.lit("request")).unionByName(b.withColumn("kind", F.lit("truth")))


def fallback_flag(spark, sf):
    rows = fixtures.passes(spark, sf)
    return rows.select(*PASS_KEYS, expr.fallback_flag(F.col("actual") > F.col("baseline")).alias("flag"))


def display_round(spark, sf):
    rows = fixtures.table(spark, sf, "events")
    return rows.select("event_id", expr.display_round(F.col("value") * 1.37).alias("shown"))


def display_time(spark, sf):
    rows = fixtures.table(spark, sf, "events")
    return rows.select("event_id", expr.display_time(F.col("ts")).alias("label"))


def unsafe_predicate(spark, sf):
    rows = fixtures.passes(spark, sf)
    return rows.select(*PASS_KEYS, expr.unsafe_predicate(
        F.col("actual") - F.col("baseline"), F.col("baseline")).cast("int").alias("unsafe"))


def untrusted_predicate(spark, sf):
    g = evaluation.guarded_target_mean(_matched(spark, sf, None))
    return g.select(*PASS_KEYS, F.col("untrusted").cast("int").alias("untrusted"), F.col("unsafe").cast("int").alias("unsafe"))


# --- pairing ---


def _flat_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select("user_id", F.col("a.event_id").alias("a_id"), F.col("b.event_id").alias("b_id"))


def _flat_events(events: DataFrame) -> DataFrame:
    side = F.when(F.col("a").isNotNull(), "A").otherwise("B")
    return events.select("user_id", side.alias("side"), F.coalesce("a.event_id", "b.event_id").alias("event_id"))


def match_pairs(spark, sf):
    return _flat_pairs(match.match_pairs(_user_pairs(spark, sf)))


def match_orphans(spark, sf):
    return _flat_events(match.match_orphans(_user_pairs(spark, sf)))


def latest_orphans_overwritten(spark, sf):
    return _flat_events(match.latest_orphans_overwritten(_user_pairs(spark, sf)))


def match_passes(spark, sf):
    pairs = _all_pairs(spark, sf)
    return pairs.select(*PASS_KEYS, "status", _text_time("ts"),
                        F.coalesce(F.col("a.steel_grade"), F.lit("unknown")).alias("steel_grade"),
                        F.coalesce(F.col("b.actual_roll_force_kn"), F.lit(-1.0)).alias("actual"))


def match_hot_keys(spark, sf):
    """Pairing by event type side only: one key for all rows, so every row takes the blocked form."""
    a, b = fixtures.user_events(spark, sf)
    one = F.lit("all").alias("line")
    pairs = match.pair_events(a.select("*", one), b.select("*", one), ["line"], tie=["event_id"], ttl=600.0, hot_keys="all")
    return pairs.select("status", *[
        F.coalesce(F.col(f"{s}.event_id"), F.lit(-1)).alias(f"{s}_id") for s in "ab"
    ])


def match_null_keys(spark, sf):
    """Every tenth user is unknown: all their events share the null key, which is large enough to be cut into blocks."""
    a, b = fixtures.user_events(spark, sf)
    known = lambda df: df.withColumn("key", F.when(F.col("user_id") % 10 != 0, F.col("user_id")))
    pairs = match.pair_events(known(a), known(b), ["key"], tie=["event_id"], ttl=USER_TTL, hot_rows=500)
    return pairs.select(F.coalesce("key", F.lit(-1)).alias("key"), "status", *[
        F.coalesce(F.col(f"{s}.event_id"), F.lit(-1)).alias(f"{s}_id") for s in "ab"])


def match_unique(spark, sf):
    pairs = match.join_unique(*_at_rest(spark, sf, None), PASS_KEYS)
    return pairs.select(*PASS_KEYS, F.col("a.baseline_roll_force_kn").alias("baseline"),
                        F.col("b.actual_roll_force_kn").alias("actual"))


def tag_union(spark, sf):
    tagged = match.tag_union(fixtures.requests(spark, sf), fixtures.truths(spark, sf), PASS_KEYS, "ts")
    return tagged.select(*PASS_KEYS, "side", _text_time("ts"))


def keyed_shuffle(spark, sf):
    """Rows and distinct keys per side after hashing on the pass key."""
    tagged = match.tag_union(fixtures.requests(spark, sf), fixtures.truths(spark, sf), PASS_KEYS, "ts")
    per_key = tagged.groupBy(*PASS_KEYS).agg(
        F.count_if(F.col("side") == "A").alias("a"), F.count_if(F.col("side") == "B").alias("b"))
    return per_key.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_keys"))


# --- running aggregates ---


def running_moments(spark, sf):
    m = scan.running_moments(_staged_events(spark, sf, "event_type"), ["event_type"], ["value"])
    return m.select("event_id", "n", F.round(F.col("value_mean") * F.col("n"), 4).alias("value_sum"), F.round(F.sqrt(F.col("value_m2") / F.col("n")), 6).alias("value_sd"))


def welford_zscore(spark, sf):
    z = scan.running_zscores(_staged_events(spark, sf, "event_type"), ["event_type"], ["value"])
    return z.select("event_id", _r("value_z", 6))


def ewma(spark, sf):
    e = scan.ewma(_staged_events(spark, sf, "event_type"), ["event_type"], {"value": "smooth"}, 0.2)
    return e.select("event_id", _r("smooth", 6), _r("smooth_prior", 6))


def ewma_null_keys(spark, sf):
    rows = fixtures.table(spark, sf, "events").select(
        F.expr("CASE WHEN event_type <> 'view' THEN event_type END AS key"), "event_id", "ts", "value")
    e = scan.ewma(stage_order(rows, ["key"], ["ts", "event_id"], "events"), ["key"], {"value": "smooth"}, 0.2)
    return e.select("event_id", F.coalesce("key", F.lit("(null)")).alias("key"), _r("smooth", 6))


def prior_state(spark, sf):
    """State before each row for short keys: the same operator, keyed by user."""
    e = scan.ewma(_staged_events(spark, sf, "user_id"), ["user_id"], {"value": "smooth"}, 0.02)
    return e.select("event_id", _r("smooth_prior", 6))


def target_mean_model(spark, sf):
    rows = evaluation.target_mean_model(evaluation.stage_matched(_matched(spark, sf, None), features=False))
    return rows.select(*PASS_KEYS, F.round(F.col("baseline") + F.col("target_mean_residual"), 2).alias("force"))


def trust_scores(spark, sf):
    g = evaluation.guarded_target_mean(_matched(spark, sf, None))
    return g.select(*PASS_KEYS, _r("model_trust", 5), _r("baseline_trust", 5))


# --- models and router ---


def sgd_prequential(spark, sf):
    rows = learn.sgd_prequential(
        evaluation.stage_matched(_matched(spark, sf)), ["steel_grade"], evaluation.X, "residual", keep_z=False)
    return rows.select(*PASS_KEYS, F.round(F.col("baseline") + F.col("sgd_residual"), 2).alias("force"))


def amrules_prequential(spark, sf):
    result, _ = evaluation.prequential_eval(_matched(spark, sf))
    return result.groupBy("steel_grade").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("am_rules_shadow_ape"), 4).alias("rules_ape"),
        F.round(F.avg("am_rules_ape"), 4).alias("guarded_ape"), F.sum("is_am_rules_fallback").alias("n_fallbacks"),
    )


def drift_detect(spark, sf):
    staged = evaluation.stage_matched(_matched(spark, sf, None), features=False).withColumn(
        "error", expr.ape(F.col("baseline"), F.col("actual")))
    rows = learn.drift_detect(staged, ["steel_grade"], "error", keep=PASS_KEYS)
    return rows.select(*PASS_KEYS, _r("running_mean", 5), _r("excess", 4), "alarm")


def first_drift(spark, sf):
    staged = evaluation.stage_matched(_matched(spark, sf, None), features=False).withColumn(
        "error", expr.ape(F.col("baseline"), F.col("actual")))
    rows = learn.first_drift(staged.select("steel_grade", ROW, "error"), ["steel_grade"], "error")
    return rows.select("steel_grade", "n", _r("excess", 4))


def shadow_route(spark, sf):
    """The router over another challenger: the linear model."""
    rows = learn.sgd_prequential(
        evaluation.stage_matched(_matched(spark, sf)), ["steel_grade"], evaluation.X, "residual", keep_z=False)
    # Written once: the router reads it twice, and the linear model must not run twice.
    scored = scan.whole_blocks(rows.select("steel_grade", *PASS_KEYS, ROW, "baseline", "actual", "sgd_residual"), "sgd")
    g = evaluation.shadow_route(scored, "sgd_residual")
    return g.select(*PASS_KEYS, _r("routed_force", 2), "fallback", _r("safe_ape", 4))


def shadow_vs_safe(spark, sf):
    g = evaluation.guarded_target_mean(_matched(spark, sf, None))
    return g.groupBy("steel_grade").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("baseline_ape"), 4).alias("baseline_ape"),
        F.round(F.avg("shadow_ape"), 4).alias("shadow_ape"), F.round(F.avg("safe_ape"), 4).alias("safe_ape"),
        F.sum("fallback").alias("n_fallbacks"),
    )


def prequential_eval(spark, sf):
    result, _ = evaluation.prequential_eval(_matched(spark, sf))
    return result


def _result(rows: DataFrame, guards: bool = True) -> DataFrame:
    digits = {n: 2 for n in evaluation.RESULT_COLUMNS if n.endswith("_kn") and not n.startswith(("baseline", "actual"))}
    digits |= {n: 4 for n in evaluation.RESULT_COLUMNS if n.endswith("_ape")} | {"wear_level": 6}
    shown = [_r(n, digits[n]) if n in digits else F.col(n) for n in evaluation.RESULT_COLUMNS[1:]]
    return rows.select(_text_time("evaluation_timestamp"), *shown, *[F.col(n).cast("int").alias(n) for n in ("unsafe", "untrusted") if guards])


def prequential_linear(spark, sf):
    """The whole evaluation with the linear model as the one that is guarded."""
    return _result(evaluation.prequential_eval(_matched(spark, sf), challenger="linear")[0])


def _resumed(spark, sf, challenger: str) -> DataFrame:
    """Two half runs joined by saved models: the second half resumes where the first stopped."""
    rows = materialize(_matched(spark, sf), "pairs")
    span = rows.agg(F.expr("percentile_approx(datediff(b.ts, DATE'1970-01-01'), 0.5)").alias("mid")).first()
    early = F.expr("datediff(b.ts, DATE'1970-01-01')") < span["mid"]
    first, state = evaluation.prequential_eval(rows.where(early), challenger=challenger)
    path = new_path(spark, "models")
    evaluation.write_checkpoint(state, path)
    # all rows are given again: those that the saved models know are left out
    second, after = evaluation.prequential_eval(rows, state=evaluation.read_checkpoint(spark, path), challenger=challenger)
    evaluation.write_checkpoint(after, path)
    return first.unionByName(second)


def model_checkpoint(spark, sf):
    return _result(_resumed(spark, sf, "linear"))


def model_checkpoint_rules(spark, sf):
    return _resumed(spark, sf, "rules")


#: Where the runs of the live job part, and how much time its held rows are cut into: the tables span seven years.
SERVED_MIDDLE, SERVED_STRETCH = "1998-06-05", 86_400.0


def _worked_off(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Run a stream over what is there."""
    query = sinks.write_metrics(rows, out, checkpoint, None)
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def _served(spark, sf) -> tuple[DataFrame, str]:
    """The live job over the raw messages in two runs: the second resumes from the checkpoint and gets those delayed in the first."""
    raw = materialize(fixtures.raw_messages(spark, sf).select("side", "body", "sent_at", "delayed"), "raw", compression="zstd")
    serving.use_stream_settings(spark)
    sources = {side: new_path(spark, f"topic-{side}") for side in "AB"}
    out, checkpoint = new_path(spark, "served"), new_path(spark, "checkpoint")
    first = (F.col("sent_at") < F.lit(SERVED_MIDDLE).cast("timestamp_ntz")) & ~F.col("delayed")
    for part in (raw.where(first), raw.where(~first)):
        for side, path in sources.items():
            part.where(F.col("side") == side).select("body").write.mode("append").option("compression", "lz4").text(path)
        streams = [events.read_event_stream(spark, sources[side]) for side in "AB"]
        _worked_off(serving.serve(*streams, stretch=SERVED_STRETCH), out, checkpoint)
    return serving.read_served(spark, out), checkpoint


def serve_stream(spark, sf):
    """The result rows of the live job, and of the rows it still holds, by a batch run with its models."""
    served, checkpoint = _served(spark, sf)
    last, _ = evaluation.prequential_rows(serving.held_rows(spark, checkpoint), state=serving.saved_models(spark, checkpoint))
    return served.where("kind = 'matched'").select(*evaluation.RESULT_COLUMNS).unionByName(last)


def serve_accounts(spark, sf):
    """What became of every message of the live job: two for each result, one for each event lost, waiting, late or unusable."""
    rows, checkpoint = _served(spark, sf)
    fate = F.when(F.col("kind") == "quarantine", "unusable").when(F.col("kind").isin("matched", "late"), F.col("kind")).otherwise("unpaired")
    both = rows.select(fate.alias("fate"), F.when(F.col("kind") == "matched", 2).otherwise(1).alias("n"))
    for more, name, n in ((serving.waiting_events(spark, checkpoint), "unpaired", 1), (serving.held_rows(spark, checkpoint), "matched", 2)):
        both = both.unionByName(more.select(F.lit(name).alias("fate"), F.lit(n).alias("n")))
    return both.groupBy("fate").agg(F.sum("n").alias("n_messages"))


def model_handover(spark, sf):
    """One evaluation in three parts: a batch run, a live job that starts with its models, a batch run that ends what the job holds."""
    pairs = materialize(_matched(spark, sf), "pairs")
    middle = F.lit(SERVED_MIDDLE).cast("timestamp_ntz")
    before, state = evaluation.prequential_eval(pairs.where(F.col("b.ts") < middle), challenger="linear")
    path = new_path(spark, "models")
    evaluation.write_checkpoint(state, path)
    rest = fixtures.passes(spark, sf).where(F.col("measured_at") >= middle)
    topic, out, checkpoint = (new_path(spark, n) for n in ("topic", "served", "checkpoint"))
    tagged = serving.tag_streams(fixtures.requests(spark, sf, rest), fixtures.truths(spark, sf, rest))
    tagged.write.parquet(topic)
    serving.use_stream_settings(spark)
    start = serving.live_models(evaluation.read_checkpoint(spark, path), challenger="linear")
    stream = serving.pair_stream(spark.readStream.schema(tagged.schema).parquet(topic))
    _worked_off(serving.evaluate_stream(stream, challenger="linear", stretch=SERVED_STRETCH, models=start), out, checkpoint)
    live = spark.read.parquet(out).where("kind = 'matched'")
    ended, after = evaluation.prequential_rows(
        serving.held_rows(spark, checkpoint), state=serving.saved_models(spark, checkpoint, "linear"), challenger="linear")
    evaluation.write_checkpoint(after, path)
    parts = [part.select(*evaluation.RESULT_COLUMNS) for part in (before, live, ended)]
    return _result(parts[0].unionByName(parts[1]).unionByName(parts[2]), guards=False)


# --- reports ---


def grade_filter(spark, sf):
    rows = report.grade_filter(_metrics(spark, sf), "high_alloy")
    return rows.select(*PASS_KEYS, _r("baseline_ape", 4))


def latest_60_per_grade(spark, sf):
    rows = report.newest_rows(spark, _metrics_path(spark, sf))
    return rows.select("steel_grade", "position", *PASS_KEYS, _text_time("evaluation_timestamp"),
                       _r("baseline_ape", 4), _r("target_mean_ape", 4), _r("wear_level", 4))


def current_wear(spark, sf):
    path = _metrics_path(spark, sf)
    return report.current_wear(sinks.read_metrics(spark, path, report.newest_folders(spark, path, 1)))


def metric_series(spark, sf):
    rows = report.newest_rows(spark, _metrics_path(spark, sf))
    series = report.metric_series(rows, ["Baseline", "Target Mean", "AMRules (Safe)"])
    return series.select("steel_grade", "position", "series", "label", "value")


# --- plant history ---


def baseline_force(spark, sf):
    return fixtures.passes(spark, sf).select(*PASS_KEYS, "baseline")


def drift_what_if(spark, sf):
    rows = history.drift_what_if(fixtures.passes(spark, sf), [0.0, 20.0, 60.0, 90.0])
    return rows.select(*PASS_KEYS, "wear", "expected_force")


def _schedule(spark, sf) -> DataFrame:
    starts = F.col("o").cast("double")
    return fixtures.passes(spark, sf).select(
        *PASS_KEYS, "reduction_pct", (F.col("wait_time_sec") / 5).alias("wait_time_sec"),
        (F.col("wait_time_sec") % 7 - 3).alias("temp_noise"),
        (200.0 + F.sqrt(2.5 + starts % 50)).alias("h0"), (2000.0 + F.sqrt(2.5 + starts % 1000)).alias("l0"), (940.0 + starts % 280).alias("t0"),
        (1.5 + (starts % 6) / 10).alias("v0"), (1042.0 + starts % 79).alias("roll_diameter_mm"),
    )


def slab_trajectory(spark, sf):
    rows = history.slab_trajectory(_schedule(spark, sf))
    names = ["entry_thickness_mm", "length_mm", "temperature_c", "speed_m_s", "strain", "strain_rate", "flow_stress_mpa"]
    return rows.select(*PASS_KEYS, *[F.round(n, 4).alias(n) for n in names])


def _commands(spark, sf) -> DataFrame:
    grade = F.expr("CASE user_id % 3 WHEN 0 THEN 'structural' WHEN 1 THEN 'microalloyed' ELSE 'high_alloy' END")
    rows = fixtures.table(spark, sf, "events").select(
        grade.alias("steel_grade"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "event_type", "value",
        F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("k"),
    )
    return rows


def _command_log(spark, sf) -> DataFrame:
    kind = F.expr("CASE event_type WHEN 'signup' THEN 'abrupt' WHEN 'error' THEN 'gradual' WHEN 'purchase' THEN 'velocity' END")
    value = F.expr("CASE event_type WHEN 'signup' THEN least(value, 100.0D) WHEN 'error' THEN (value - 10) / 50 ELSE (value - 30) / 1000 END")
    return _commands(spark, sf).select(
        "steel_grade", "ts", F.col("event_id").alias("command_id"), kind.alias("type"), value.alias("value"),
        F.col("k").alias("freq"),
    ).where(F.col("type").isNotNull())


def wear_timeline(spark, sf):
    log = history.wear_timeline(_command_log(spark, sf))
    return log.select("steel_grade", "command_id", _r("wear_start", 6), _r("step", 6), "every")


def wear_asof(spark, sf):
    log = history.wear_timeline(_command_log(spark, sf))
    passes = _commands(spark, sf).where(F.col("event_type").isin("click", "view"))
    rows = history.wear_at(passes, log, order=["event_id"])
    return rows.select("event_id", _r("wear_now", 6))


def pass_phase(spark, sf):
    rows = history.add_phases(fixtures.passes(spark, sf).select(*PASS_KEYS))
    return rows.select(*PASS_KEYS, "pass_phase")


def reduction_class(spark, sf):
    rows = history.add_phases(fixtures.passes(spark, sf).select(*PASS_KEYS))
    return rows.select(*PASS_KEYS, "total_passes", "reduction_class")


QUERIES: dict[str, Query] = {
    "guarded_target_mean": Query(guarded_target_mean, oracle.GUARDED_TARGET_MEAN),
    "read_event_stream": Query(read_event_stream, oracle.READ_EVENT_STREAM),
    "decode_events": Query(decode_events, oracle.DECODE_EVENTS),
    "quarantine_events": Query(quarantine_events, oracle.QUARANTINE_EVENTS),
    "valid_rows": Query(valid_rows, oracle.VALID_ROWS),
    "route_events": Query(route_events, oracle.ROUTE_EVENTS),
    "write_metrics": Query(write_metrics, oracle.WRITE_METRICS),
    "metrics_table": Query(metrics_table, oracle.METRICS_TABLE),
    "export_tsv": Query(export_tsv, oracle.EXPORT_TSV),
    "metrics_rows": Query(metrics_rows, oracle.MODEL_HANDOVER),
    "metrics_tsv": Query(metrics_tsv, oracle.MODEL_HANDOVER),
    "engineer_features": Query(engineer_features, oracle.ENGINEER_FEATURES),
    "default_features": Query(default_features, oracle.DEFAULT_FEATURES),
    "feature_vector": Query(feature_vector, oracle.FEATURE_VECTOR),
    "residual_and_ape": Query(ape_query, oracle.RESIDUAL_AND_APE),
    "final_force": Query(final_force, oracle.FINAL_FORCE),
    "match_key": Query(match_key, oracle.MATCH_KEY),
    "event_time": Query(event_time, oracle.EVENT_TIME),
    "validate_ranges": Query(validate_ranges, oracle.VALIDATE_RANGES),
    "fallback_flag": Query(fallback_flag, oracle.FALLBACK_FLAG),
    "display_round": Query(display_round, oracle.DISPLAY_ROUND),
    "display_time": Query(display_time, oracle.DISPLAY_TIME),
    "unsafe_predicate": Query(unsafe_predicate, oracle.UNSAFE_PREDICATE),
    "untrusted_predicate": Query(untrusted_predicate, oracle.UNTRUSTED_PREDICATE),
    "match_pairs": Query(match_pairs, oracle.MATCH_PAIRS),
    "match_orphans": Query(match_orphans, oracle.MATCH_ORPHANS),
    "latest_orphans_overwritten": Query(latest_orphans_overwritten, oracle.MATCH_SUPERSEDED),
    "match_passes": Query(match_passes, oracle.MATCH_PASSES),
    "match_hot_keys": Query(match_hot_keys, oracle.MATCH_HOT_KEYS),
    "match_null_keys": Query(match_null_keys, oracle.MATCH_NULL_KEYS),
    "match_unique": Query(match_unique, oracle.MATCH_UNIQUE),
    "tag_union": Query(tag_union, oracle.TAG_UNION),
    "keyed_shuffle": Query(keyed_shuffle, oracle.KEYED_SHUFFLE),
    "running_moments": Query(running_moments, oracle.RUNNING_MOMENTS),
    "welford_zscore": Query(welford_zscore, oracle.WELFORD_ZSCORE),
    "ewma": Query(ewma, oracle.EWMA),
    "ewma_null_keys": Query(ewma_null_keys, oracle.EWMA_NULL_KEYS),
    "prior_state": Query(prior_state, oracle.PRIOR_STATE),
    "target_mean_model": Query(target_mean_model, oracle.TARGET_MEAN_MODEL),
    "trust_scores": Query(trust_scores, oracle.TRUST_SCORES),
    "sgd_prequential": Query(sgd_prequential, oracle.SGD_PREQUENTIAL),
    "amrules_prequential": Query(amrules_prequential),
    "drift_detect": Query(drift_detect, oracle.DRIFT_DETECT),
    "first_drift": Query(first_drift, oracle.FIRST_DRIFT),
    "shadow_route": Query(shadow_route, oracle.SHADOW_ROUTE),
    "shadow_vs_safe": Query(shadow_vs_safe, oracle.SHADOW_VS_SAFE),
    "prequential_eval": Query(prequential_eval),
    "prequential_linear": Query(prequential_linear, oracle.PREQUENTIAL_LINEAR),
    "model_checkpoint": Query(model_checkpoint, oracle.PREQUENTIAL_LINEAR),
    "model_checkpoint_rules": Query(model_checkpoint_rules),
    "serve_stream": Query(serve_stream),
    "serve_accounts": Query(serve_accounts, oracle.SERVE_ACCOUNTS),
    "model_handover": Query(model_handover, oracle.MODEL_HANDOVER),
    "grade_filter": Query(grade_filter, oracle.GRADE_FILTER),
    "latest_60_per_grade": Query(latest_60_per_grade, oracle.LATEST_60),
    "current_wear": Query(current_wear, oracle.CURRENT_WEAR),
    "metric_series": Query(metric_series, oracle.METRIC_SERIES),
    "baseline_force": Query(baseline_force, oracle.BASELINE_FORCE),
    "drift_what_if": Query(drift_what_if, oracle.DRIFT_WHAT_IF),
    "slab_trajectory": Query(slab_trajectory, oracle.SLAB_TRAJECTORY),
    "wear_timeline": Query(wear_timeline, oracle.WEAR_TIMELINE),
    "wear_asof": Query(wear_asof, oracle.WEAR_ASOF),
    "pass_phase": Query(pass_phase, oracle.PASS_PHASE),
    "reduction_class": Query(reduction_class, oracle.REDUCTION_CLASS),
}
