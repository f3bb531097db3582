"""Column expressions: features, errors, guards, plant physics, rendering.

Everything here is a plain Spark column expression, so it stays inside code
generation and can be pushed around by the optimizer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The 13 measured features in model order and the value used when one is missing.
FEATURE_DEFAULTS = {
    "reheating_time_min": 0.0,
    "roll_diameter_mm": 0.0,
    "roll_crown_mm": 0.0,
    "entry_thickness_mm": 1.0,
    "width_mm": 1000.0,
    "length_mm": 1000.0,
    "temperature_c": 1000.0,
    "speed_m_s": 0.0,
    "wait_time_sec": 0.0,
    "reduction_pct": 0.1,
    "strain": 0.0,
    "strain_rate": 0.0,
    "flow_stress_mpa": 0.0,
}
# The three engineered features that follow them.
ENGINEERED = ("absolute_draft", "temp_draft_interaction", "volume")
FEATURE_NAMES = tuple(FEATURE_DEFAULTS) + ENGINEERED

# Accepted range of each measured feature.
FEATURE_RANGES = {
    "reheating_time_min": (135.0, 1188.0),
    "roll_diameter_mm": (1042.0, 1121.0),
    "roll_crown_mm": (0.0, 217.0),
    "entry_thickness_mm": (15.0, 250.0),
    "width_mm": (1613.0, 4182.0),
    "length_mm": (1794.0, 38139.0),
    "temperature_c": (889.0, 1233.0),
    "speed_m_s": (1.5, 5.6),
    "wait_time_sec": (6.0, 225.0),
    "reduction_pct": (0.01, 0.40),
    "strain": (0.02, 0.56),
    "strain_rate": (0.5, 16.3),
    "flow_stress_mpa": (5.0, 179.0),
}

# Resistance constant of each steel grade; unknown grades use the first.
GRADE_HARDNESS = {"structural": 18000.0, "microalloyed": 28000.0, "high_alloy": 45000.0}
WEAR_PENALTY_RATE = 0.40


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that is evaluated once per row.

    Filters pushed down through a plain projection copy its expressions, so a JSON parse or a map
    lookup would run again for each mention. Nothing is copied across a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def feature_value(features: Column, name: str) -> Column:
    """One entry of the feature map, or its default."""
    return F.coalesce(F.try_element_at(features, F.lit(name)), F.lit(FEATURE_DEFAULTS[name]))


def default_features(features: Column) -> list[Column]:
    return [feature_value(features, name).alias(name) for name in FEATURE_DEFAULTS]


def engineered(thickness: Column, reduction: Column, temperature: Column, width: Column, length: Column):
    """Draft, draft over temperature, volume. A zero temperature gives null, not an error."""
    draft = thickness * reduction
    return [
        draft.alias("absolute_draft"),
        F.try_divide(draft, temperature).alias("temp_draft_interaction"),
        (thickness * width * length).alias("volume"),
    ]


def engineer_features(features: Column) -> list[Column]:
    get = {n: feature_value(features, n) for n in FEATURE_DEFAULTS}
    return engineered(
        get["entry_thickness_mm"], get["reduction_pct"], get["temperature_c"], get["width_mm"], get["length_mm"]
    )


def feature_vector(features: Column) -> Column:
    """The 16 model inputs in their fixed order. Wear is never among them.

    A map entry that is NaN stays NaN; a null draft ratio (zero temperature) becomes 0.
    """
    measured = [feature_value(features, n) for n in FEATURE_DEFAULTS]
    derived = [F.coalesce(c, F.lit(0.0)) for c in engineer_features(features)]
    return F.array(*measured, *derived)


def measured_vector(features: Column) -> Column:
    """The 13 measured ones alone, as ``feature_vector`` has them."""
    return F.array(*[feature_value(features, n) for n in FEATURE_DEFAULTS])


def engineered_inputs(measured: dict[str, Column]) -> list[Column]:
    """The model inputs that ``feature_vector`` derives, from the measured ones by name."""
    names = ("entry_thickness_mm", "reduction_pct", "temperature_c", "width_mm", "length_mm")
    return [F.coalesce(c, F.lit(0.0)) for c in engineered(*[measured[n] for n in names])]


def residual(actual: Column, baseline: Column) -> Column:
    return actual - baseline


def ape(predicted: Column, actual: Column) -> Column:
    """Absolute percentage error; 0 where the actual value is 0."""
    return F.when(actual == 0.0, F.lit(0.0)).otherwise(
        F.abs(F.try_divide(actual - predicted, actual)) * 100.0
    )


def linear_residual(bias: Column, weights: Column, z: Column) -> Column:
    products = F.zip_with(weights, z, lambda w, x: w * x)
    return bias + F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def final_force(baseline: Column, predicted_residual: Column) -> Column:
    return baseline + predicted_residual


def match_key(slab_id: Column, pass_number: Column) -> Column:
    return F.concat_ws("-", slab_id, pass_number.cast("string"))


LOCAL_DATE_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?$"


def event_time(text: Column) -> Column:
    """ISO local date-time to a zone-less timestamp in milliseconds; null for any other form.

    The whole text must be a date, ``T`` and a time of day: a cast alone would take dates, years and the zones of
    ``...+2:00`` or ``... Europe/Paris`` and drop what it does not use. Digits after the millisecond are cut off in the
    text, because truncating a timestamp goes through the session's time zone.
    """
    millis = F.regexp_replace(text, r"(\.\d{3})\d+$", "$1")
    return F.when(text.rlike(LOCAL_DATE_TIME), millis.try_cast("timestamp_ntz"))


def fallback_flag(fallback: Column) -> Column:
    return fallback.cast("int")


def display_round(value: Column) -> Column:
    return F.round(value, 2)


def display_time(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def unsafe_predicate(predicted_residual: Column, baseline: Column, overpress=0.25, underpress=0.20) -> Column:
    """The correction leaves the mechanical band; the limit itself is still safe."""
    return (predicted_residual > baseline * overpress) | (predicted_residual < -(baseline * underpress))


def untrusted_predicate(model_trust: Column, baseline_trust: Column, tolerance=3.0) -> Column:
    """The model's recent error is worse than the baseline's by more than the tolerance."""
    return model_trust > baseline_trust + tolerance


def range_violations(features: Column, extra: Sequence[tuple[str, Column, float, float | None]] = ()) -> Column:
    """Names of the violated range rules of one record, as an array."""
    rules = [
        (name, F.try_element_at(features, F.lit(name)), low, high)
        for name, (low, high) in FEATURE_RANGES.items()
    ]
    checks = []
    for name, value, low, high in [*rules, *extra]:
        outside = value.isNull() | (value < low)
        if high is not None:
            outside = outside | (value > high)
        checks.append(F.when(outside, F.lit(name)))
    return F.filter(F.array(*checks), lambda v: v.isNotNull())


def grade_hardness(grade: Column) -> Column:
    constant = F.lit(GRADE_HARDNESS["structural"])
    for name, value in GRADE_HARDNESS.items():
        constant = F.when(grade == name, F.lit(value)).otherwise(constant)
    return constant


def baseline_force(grade: Column, width: Column, thickness: Column, reduction: Column, temperature: Column):
    """The static physical model of the roll force, rounded to 2 decimals."""
    force = grade_hardness(grade) * width * (thickness * reduction) / F.greatest(temperature, F.lit(1.0))
    return F.round(force, 2)


def wear_factor(wear: Column, temperature: Column, thickness: Column, reduction: Column) -> Column:
    """By how much a worn roll raises the force over the baseline."""
    share = F.greatest(F.lit(0.0), F.least(wear, F.lit(100.0))) / 100.0
    thermal = F.greatest(F.lit(0.1), (1250.0 - temperature) / 200.0)
    thin = 100.0 / F.greatest(thickness, F.lit(10.0))
    return 1.0 + F.pow(share, F.lit(1.5)) * WEAR_PENALTY_RATE * (thermal * thin * (1.0 + reduction))


def worn_force(baseline: Column, wear: Column, temperature: Column, thickness: Column, reduction: Column) -> Column:
    """Expected measured force under a given wear, never below 0, rounded to 2 decimals."""
    force = baseline * wear_factor(wear, temperature, thickness, reduction)
    return F.round(F.greatest(force, F.lit(0.0)), 2)


def pass_phase(pass_number: Column) -> Column:
    return (
        F.when(pass_number <= 2, "roughing").when(pass_number <= 4, "intermediate").otherwise("finishing")
    )


def reduction_class(pass_number: Column, total_passes: Column) -> Column:
    progress = pass_number / total_passes
    return F.when(progress < 0.4, "heavy").when(progress < 0.8, "medium").otherwise("light")
