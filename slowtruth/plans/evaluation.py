"""The guarded evaluation: score, route and grade every matched event, over history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slowtruth.functions import expr
from slowtruth.operators import learn, scan
from slowtruth.operators.models import Settings
from slowtruth.operators.scan import BLOCK, KEY, ROW, stage_order, with_block
from slowtruth.session import materialize

# The model key. More columns (plant, line) give more independent model sets and more parallel tasks.
MODEL_KEYS = ("steel_grade",)
ORDER = ("evaluation_timestamp", "slab_id", "pass_number")

RESULT_COLUMNS = (
    "evaluation_timestamp", "steel_grade", "slab_id", "pass_number", "baseline_roll_force_kn",
    "target_mean_roll_force_kn", "sgd_roll_force_kn", "am_rules_roll_force_kn", "actual_roll_force_kn",
    "baseline_ape", "target_mean_ape", "sgd_ape", "am_rules_ape", "am_rules_shadow_ape", "wear_level",
    "is_am_rules_fallback",
)
CHALLENGERS = {"linear": "sgd_residual", "offset": "target_mean_residual"}
X = tuple(f"x{i}" for i in range(len(expr.FEATURE_NAMES)))
MEASURED = len(expr.FEATURE_DEFAULTS)


def matched_rows(
    pairs: DataFrame, keys: Sequence[str] = MODEL_KEYS, features: bool = True, derived: bool = True
) -> DataFrame:
    """Flat rows for the models from matched (a, b) structs: time and wear from b, the rest from a.

    Models that use no features do without the vector, so it is neither computed nor shuffled. Requests may carry the
    vector itself (``x``), or the part of it that is measured (``measured``), in place of the map it is made of (``features``).
    Without ``derived`` rows lack what ``with_derived`` adds.
    """
    held = next((n for n in ("x", "measured") if n in pairs.schema["a"].dataType.names), "features")
    flat = pairs.select(
        F.col("b.ts").alias("evaluation_timestamp"),
        F.col("a.steel_grade").alias("steel_grade"),
        F.col("a.slab_id").alias("slab_id"),
        F.col("a.pass_number").alias("pass_number"),
        *[F.col(f"a.{k}").alias(k) for k in keys if k != "steel_grade"],
        F.col("a.baseline_roll_force_kn").alias("baseline"),
        F.col("b.actual_roll_force_kn").alias("actual"),
        F.col("b.wear_level").alias("wear_level"),
        *([F.col(f"a.{held}").alias("features" if held == "features" else "_x")] if features else []),
    )
    if features and held == "features":
        flat = expr.once(flat, "_x", expr.measured_vector(F.col("features")))
    vector = [F.col("_x")[i].alias(x) for i, x in enumerate(X if held == "x" else X[:MEASURED])] if features else []
    rows = flat.select("*", *vector).drop("_x", "features")
    return with_derived(rows) if derived else rows


def with_derived(rows: DataFrame) -> DataFrame:
    """Adds what follows from other columns, unless it is there: the engineered features and the residual."""
    added = []
    if X[0] in rows.columns and X[MEASURED] not in rows.columns:
        named = {name: F.col(x) for name, x in zip(expr.FEATURE_DEFAULTS, X)}
        added += [c.alias(x) for x, c in zip(X[MEASURED:], expr.engineered_inputs(named))]
    if "residual" not in rows.columns:
        added.append(expr.residual(F.col("actual"), F.col("baseline")).alias("residual"))
    return rows.select("*", *added) if added else rows


def stage_matched(pairs: DataFrame, keys: Sequence[str] = MODEL_KEYS, features: bool = True) -> DataFrame:
    """What can be derived is neither shuffled nor written."""
    return with_derived(stage_order(matched_rows(pairs, keys, features, derived=False), keys, ORDER, "matched", whole=features))


def target_mean_model(
    staged: DataFrame, keys: Sequence[str] = MODEL_KEYS, rate: float = 0.02, bits: int | None = None
) -> DataFrame:
    """Adds ``target_mean_residual``: the moving average of the earlier residuals."""
    return scan.ewma(staged, keys, {"residual": "_tm"}, rate, bits=bits).withColumnRenamed(
        "_tm_prior", "target_mean_residual"
    ).drop("_tm")


def trust_scores(
    rows: DataFrame, keys: Sequence[str], model_ape: str, baseline_ape: str, rate: float = 0.2, bits: int | None = None
) -> DataFrame:
    """Adds ``model_trust`` and ``baseline_trust`` as the router sees them: before this row."""
    columns = {model_ape: "_mt", baseline_ape: "_bt"}
    return (
        scan.ewma(rows, keys, columns, rate, bits=bits)
        .withColumnRenamed("_mt_prior", "model_trust").withColumnRenamed("_bt_prior", "baseline_trust")
        .drop("_mt", "_bt")
    )


def shadow_route(
    rows: DataFrame, challenger: str, keys: Sequence[str] = MODEL_KEYS, settings: Settings = Settings(),
    bits: int | None = None,
) -> DataFrame:
    """Guard any challenger given as a residual column.

    ``rows`` must carry the row id of a staged table, baseline and actual. Adds the raw and routed
    force, both errors, the trust scores, the two guards and the flag.
    """
    b, a, r = F.col("baseline"), F.col("actual"), F.col(challenger)
    scored = rows.select(
        "*", (b + r).alias("raw_force"), expr.ape(b, a).alias("baseline_ape"), expr.ape(b + r, a).alias("shadow_ape")
    )
    scored = trust_scores(scored, keys, "shadow_ape", "baseline_ape", settings.trust_rate, bits)
    return route(scored, r, settings)


def route(scored: DataFrame, challenger: Column, settings: Settings = Settings()) -> DataFrame:
    b, a = F.col("baseline"), F.col("actual")
    guarded = scored.withColumn(
        "unsafe", expr.unsafe_predicate(challenger, b, settings.overpress, settings.underpress)
    ).withColumn(
        "untrusted",
        expr.untrusted_predicate(F.col("model_trust"), F.col("baseline_trust"), settings.trust_tolerance),
    )
    return (
        guarded.withColumn("fallback", expr.fallback_flag(F.col("unsafe") | F.col("untrusted")))
        .withColumn("routed_force", F.when(F.col("fallback") == 1, b).otherwise(F.col("raw_force")))
        .withColumn("safe_ape", expr.ape(F.col("routed_force"), a))
    )


def guarded_target_mean(pairs: DataFrame, keys: Sequence[str] = MODEL_KEYS, settings: Settings = Settings()):
    """Would the guarded offset model have beaten the physics? The smallest complete evaluation."""
    # Both averages use the same blocks, so the rows are shuffled once for the two of them.
    bits = min(scan.ewma_bits(settings.mean_rate), scan.ewma_bits(settings.trust_rate))
    rows = target_mean_model(stage_matched(pairs, keys, features=False), keys, settings.mean_rate, bits)
    return shadow_route(rows, "target_mean_residual", keys, settings, bits).drop(BLOCK, KEY)


def prequential_eval(
    pairs: DataFrame,
    keys: Sequence[str] = MODEL_KEYS,
    settings: Settings = Settings(),
    state: dict[str, DataFrame] | None = None,
    rows_per_round: int = learn.ROWS_PER_ROUND,
    challenger: str = "rules",
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The 16-column result row of every matched event, and the models to resume from.

    ``challenger`` names the model that the router guards, whose columns are the ``am_rules_`` ones: the rule learner, or
    the ``linear`` or ``offset`` model. With the latter two nothing is sequential: all steps run in blocks over the whole
    cluster, and the result also says why a row fell back (``unsafe``, ``untrusted``).

    ``state`` is what an earlier call returned or ``read_checkpoint`` read. Rows that the models have seen, by keys, time,
    slab and pass, are left out, so that a repeated run trains nothing twice. A row that comes late, measured before
    others that the models have seen, is scored by the saved models before it trains them, in order with the run's
    other rows: models learn in the order in which rows come, as in the live job.
    Everything but the rule learner runs in blocks over the whole cluster. The learner is
    sequential by nature, so its pass gets only what it needs and is parallel by key.
    """
    return prequential_rows(matched_rows(pairs, list(keys), derived=False), keys, settings, state, rows_per_round, challenger)


def prequential_rows(
    rows_in: DataFrame,
    keys: Sequence[str] = MODEL_KEYS,
    settings: Settings = Settings(),
    state: dict[str, DataFrame] | None = None,
    rows_per_round: int = learn.ROWS_PER_ROUND,
    challenger: str = "rules",
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """``prequential_eval`` over flat rows, as ``matched_rows`` makes them, derived or not, or a live job holds them."""
    state = state or {}
    keys = list(keys)
    if "last" in state:
        rows_in = after_last(rows_in, state["last"], keys)
    if "seen" in state:
        rows_in = unseen(rows_in, state["seen"], keys)
    staged = with_derived(stage_order(rows_in, keys, ORDER, "matched", whole=True))
    blocked = with_block(staged, keys)
    bits = scan.ewma_bits(settings.mean_rate)
    steps = blocked if bits == scan.BLOCK_BITS else with_block(staged, keys, bits)
    # Carries hold a row for each block: written once, they serve every step below and the states at the end.
    offset = learn.materialize(scan.ewma_carry(
        steps, keys, {"residual": "_tm"}, settings.mean_rate, state.get("offset"), with_final=True
    ), "offset")
    moments = learn.materialize(scan.moments_carry(blocked, keys, X, state.get("moments"), with_final=True), "moments")
    affine = learn.sgd_affine(blocked, keys, _started(moments), X, "residual", settings.sgd_rate, settings.sgd_decay)
    weights = learn.materialize(learn.sgd_carry(affine, keys, len(X), state.get("weights"), with_final=True), "weights")

    def scores(rows: DataFrame, keep_z: bool = True) -> DataFrame:
        """The answers of both models; with equal block sizes in one pass."""
        offsets = scan.ewma_step(_started(offset), {"residual": "_tm"}, settings.mean_rate)
        linear = learn.sgd_step(
            _started(moments), _started(weights), X, "residual", settings.sgd_rate, settings.sgd_decay, keep_z)
        if bits == scan.BLOCK_BITS:
            found = scan.run_blocks(rows, keys, bits, [offsets, linear], X)
        else:
            found = scan.run_blocks(scan.run_blocks(rows, keys, bits, [offsets]), keys, scan.BLOCK_BITS, [linear], X)
        return found.withColumnRenamed("_tm_prior", "target_mean_residual").drop("_tm")

    z = [f"{x}_z" for x in X]
    # Without the features a row is short; the scores, which are long, go to the learner and are not written.
    scored = with_derived(scan.whole_blocks(scores(staged, False).drop("residual"), "scored"))
    if challenger == "rules":
        routed, rules = learn.amrules_prequential(
            staged, keys, z, settings=settings, initial=state.get("rules"), rows_per_round=rows_per_round, prepare=scores
        )
        joined = scored.join(routed.drop("baseline", "actual", *keys), ROW)
        router, guards = {"rules": rules}, []
    else:
        joined, trust = routed_in_blocks(scored, CHALLENGERS[challenger], keys, settings, state.get("trust"))
        router, guards = {"trust": _final(trust, keys, staged)}, ["unsafe", "untrusted"]
    b, a = F.col("baseline"), F.col("actual")
    mean_force = expr.final_force(b, F.col("target_mean_residual"))
    sgd_force = expr.final_force(b, F.col("sgd_residual"))
    extra = [k for k in keys if k not in RESULT_COLUMNS]
    result = joined.select(
        *extra, "evaluation_timestamp", "steel_grade", "slab_id", "pass_number",
        b.alias("baseline_roll_force_kn"),
        mean_force.alias("target_mean_roll_force_kn"),
        sgd_force.alias("sgd_roll_force_kn"),
        F.col("routed_force").alias("am_rules_roll_force_kn"),
        a.alias("actual_roll_force_kn"),
        "baseline_ape",
        expr.ape(mean_force, a).alias("target_mean_ape"),
        expr.ape(sgd_force, a).alias("sgd_ape"),
        F.col("safe_ape").alias("am_rules_ape"),
        F.col("shadow_ape").alias("am_rules_shadow_ape"),
        "wear_level",
        F.col("fallback").alias("is_am_rules_fallback"),
        *guards,
    )
    after = {
        **{name: _final(carry, keys, staged) for name, carry in (("offset", offset), ("moments", moments), ("weights", weights))},
        **router,
        "seen": seen_rows(staged, keys, state.get("seen")),
    }
    if "last" in state:
        after["last"] = state["last"]
    return result, after


def routed_in_blocks(scored: DataFrame, residual: str, keys: Sequence[str], settings: Settings, before: DataFrame | None):
    """The router over any residual column, and the trust of each block to resume from."""
    b, a = F.col("baseline"), F.col("actual")
    forces = scored.withColumn("raw_force", b + F.col(residual)).withColumns(
        {"baseline_ape": expr.ape(b, a), "shadow_ape": expr.ape(F.col("raw_force"), a)})
    steps = with_block(forces, keys, scan.ewma_bits(settings.trust_rate))
    columns = {"shadow_ape": "_mt", "baseline_ape": "_bt"}
    trust = learn.materialize(scan.ewma_carry(steps, keys, columns, settings.trust_rate, before, with_final=True), "trust")
    seen = scan.apply_ewma(steps, _started(trust), columns, settings.trust_rate, keys=keys)
    seen = seen.withColumnsRenamed({"_mt_prior": "model_trust", "_bt_prior": "baseline_trust"}).drop("_mt", "_bt", BLOCK, KEY)
    return route(seen, F.col(residual), settings), trust


def _started(carry: DataFrame) -> DataFrame:
    return carry.where(F.col(BLOCK).isNotNull())


def _final(carry: DataFrame, keys: Sequence[str], staged: DataFrame) -> DataFrame:
    """The state of each key after its last row."""
    state = [c for c in carry.columns if c not in (BLOCK, KEY)]
    return carry.where(F.col(BLOCK).isNull()).select(*scan.key_columns(keys, staged.schema), *state)


#: Of the log of seen rows: the day they were measured (NO_DAY without a time), and the saved version that added them.
SEEN_DAY, SEEN_VERSION, NO_DAY = "seen_day", "seen_version", -1_000_000
#: Days of a run up to which the log is read by day.
DAYS_LISTED = 5000


def _day(time: str = ORDER[0]) -> Column:
    return F.coalesce(F.datediff(F.col(time), F.lit("1970-01-01").cast("date")), F.lit(NO_DAY))


def seen_rows(staged: DataFrame, keys: Sequence[str], before: DataFrame | None) -> DataFrame:
    """(keys, time, slab, pass, day, version) of all rows that the models have seen; rows not yet saved have no version."""
    seen = staged.select(*_identity(keys), _day().alias(SEEN_DAY), F.lit(None).cast("int").alias(SEEN_VERSION))
    return seen if before is None else _dated(before).select(seen.columns).unionByName(seen)


def _dated(seen: DataFrame) -> DataFrame:
    """Identities with their day and version, which tables saved before the log do not have."""
    if SEEN_DAY in seen.columns:
        return seen
    return seen.withColumns({SEEN_DAY: _day(), SEEN_VERSION: F.lit(None).cast("int")})


def unseen(rows: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows without an equal identity among ``seen``; nulls are equal to nulls.

    The rows are written first, for the days they were measured. Of the log, which is kept by day, only those days are
    read: what a run costs does not grow with the history.
    """
    incoming = materialize(rows.withColumn(SEEN_DAY, _day()), "incoming")
    days = [r[0] for r in incoming.select(SEEN_DAY).distinct().limit(DAYS_LISTED + 1).collect()]
    known = seen_on(seen, days)
    names = [SEEN_DAY, *_identity(keys)]
    known = known.select(*[F.col(c).alias(f"_seen{k}") for k, c in enumerate(names)])
    same = F.lit(True)
    for k, c in enumerate(names):
        same = same & F.col(c).eqNullSafe(F.col(f"_seen{k}"))
    return incoming.join(known, same, "left_anti").drop(SEEN_DAY)


def seen_on(seen: DataFrame, days: Sequence[int]) -> DataFrame:
    seen = _dated(seen)
    return seen.where(F.col(SEEN_DAY).isin(list(days))) if len(days) <= DAYS_LISTED else seen


def _identity(keys: Sequence[str]) -> list[str]:
    return [*keys, *[c for c in ORDER if c not in keys]]


def after_last(rows: DataFrame, last: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For models saved without identities, which know only the last row of each key."""
    known = last.select(F.to_json(F.struct(*keys)).alias(KEY), "last")
    joined = rows.withColumn(KEY, F.to_json(F.struct(*keys))).join(known, KEY, "left")
    return joined.where(F.col("last").isNull() | (F.struct(*ORDER) > F.col("last"))).drop(KEY, "last")


_MARK, _SEEN = "published", "seen"


def _folders(spark, path: str) -> list[str]:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []


def _versions(spark, path: str) -> list[int]:
    """Published versions, ascending. A version is published once its marker folder is there."""
    return sorted(int(n.removeprefix(f"{_MARK}=")) for n in _folders(spark, path) if n.startswith(f"{_MARK}="))


def write_checkpoint(state: dict[str, DataFrame], path: str) -> int:
    """Save the models of every key as a new version under ``path`` and publish it; returns its number.

    Tables of earlier versions are never touched, so the new state may still be read from them. The marker comes last
    and is one rename-free folder creation: a run that dies before it leaves the earlier version in force, and the next
    run overwrites the unpublished tables. Rows seen are a log by day next to the versions: a version adds its own, and those
    of earlier ones are never read or written again.
    """
    spark = state["offset"].sparkSession
    version = max(_versions(spark, path), default=0) + 1
    if "seen" in state:
        new = _dated(state["seen"]).where(F.col(SEEN_VERSION).isNull()).drop(SEEN_VERSION)
        new.repartitionByRange(SEEN_DAY, "slab_id").write.mode("overwrite").partitionBy(SEEN_DAY).parquet(f"{path}/{_SEEN}/{SEEN_VERSION}={version}")
    for name in state.keys() - {"seen"}:
        state[name].write.mode("overwrite").parquet(f"{path}/version={version}/{name}")
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{_MARK}={version}")
    mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(mark)
    return version


def read_checkpoint(spark, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The state of the last published version, or of the one asked for."""
    known = _versions(spark, path)
    if version is None and known:
        version = known[-1]
    if version not in known:
        raise FileNotFoundError(f"no published models under {path}" + (f" of version {version}" if version else ""))
    tables = [n for n in _folders(spark, f"{path}/version={version}") if not n.startswith((".", "_"))]
    state = {name: spark.read.parquet(f"{path}/version={version}/{name}") for name in tables}
    logged = [int(n.partition("=")[2]) for n in _folders(spark, f"{path}/{_SEEN}") if n.startswith(SEEN_VERSION)]
    if any(v <= version for v in logged):
        log = spark.read.parquet(f"{path}/{_SEEN}").where(F.col(SEEN_VERSION) <= version)
        state["seen"] = log if "seen" not in state else log.unionByName(_dated(state["seen"]))
    return state
