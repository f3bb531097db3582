"""Plant history: slab trajectories from a pass schedule, roll wear from a command log."""

from __future__ import annotations

import math
import pickle
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slowtruth.functions import expr
from slowtruth.operators.learn import ordered_pass
from slowtruth.operators.scan import ROW, running_last, stage_order

# Wear limits at which a gradual drift turns, and the ceiling of the per-tick form.
WEAR_TOP, WEAR_FLOOR, WEAR_CEILING = 60.0, 0.001, 100.0


def slab_trajectory(schedule: DataFrame, slab: str = "slab_id", number: str = "pass_number") -> DataFrame:
    """State of every slab at every pass, from reductions, waits and the furnace-exit values.

    ``schedule`` has reduction_pct, wait_time_sec, temp_noise and the start values h0, l0, t0, v0,
    roll_diameter_mm, repeated on each pass of the slab. The recurrences are running sums and one running
    maximum. A slab has at most ten passes, so a window over it stays small.
    """
    upto = Window.partitionBy(slab).orderBy(number).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(slab).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    r = F.col("reduction_pct")
    drop = F.col("wait_time_sec") * 0.5 + r * 30.0 + F.col("temp_noise")
    rows = schedule.select(
        "*",
        F.exp(F.coalesce(F.sum(F.log(1.0 - r)).over(before), F.lit(0.0))).alias("_left"),
        F.sum(r).over(upto).alias("_reduced"),
        (F.col("t0") - F.sum(drop).over(upto)).alias("_free"),
    )
    # Temperature is held at the floor: the free course plus the largest shortfall so far.
    lift = F.greatest(F.lit(0.0), F.max(889.0 - F.col("_free")).over(upto))
    rows = rows.select(
        "*",
        (F.col("h0") * F.col("_left")).alias("entry_thickness_mm"),
        (F.col("l0") / F.col("_left")).alias("length_mm"),
        (F.col("_free") + lift).alias("temperature_c"),
        F.least(F.lit(5.6), F.col("v0") + 2.0 * F.col("_reduced")).alias("speed_m_s"),
        (-F.log(1.0 - r)).alias("strain"),
    )
    contact = F.sqrt(F.col("roll_diameter_mm") / 2.0 * (F.col("entry_thickness_mm") * r))
    rate = F.try_divide(F.col("speed_m_s") * 1000.0, contact) * F.col("strain")
    rows = rows.withColumn("strain_rate", F.greatest(F.lit(0.5), F.least(F.lit(16.2), rate)))
    stress = 20.0 * F.pow(1200.0 / F.col("temperature_c"), F.lit(4.0)) * (
        F.pow(F.col("strain"), F.lit(0.2)) * F.pow(F.col("strain_rate"), F.lit(0.1))
    )
    rows = rows.withColumn("flow_stress_mpa", F.greatest(F.lit(5.0), F.least(F.lit(178.0), stress)))
    return rows.drop("_left", "_reduced", "_free")


def add_phases(passes: DataFrame, slab: str = "slab_id", number: str = "pass_number") -> DataFrame:
    """Adds ``pass_phase`` and ``reduction_class``; the pass count of a slab is its highest pass number."""
    totals = passes.groupBy(slab).agg(F.max(number).alias("total_passes"))
    return passes.join(totals, slab).select(
        "*", expr.pass_phase(F.col(number)).alias("pass_phase"),
        expr.reduction_class(F.col(number), F.col("total_passes")).alias("reduction_class"),
    )


def drift_what_if(passes: DataFrame, scenarios: Sequence[float]) -> DataFrame:
    """Expected force of every pass under each assumed wear: one row per pass and scenario, no shuffle."""
    spread = passes.withColumn("wear", F.explode(F.array(*[F.lit(float(w)) for w in scenarios])))
    c = F.col
    return spread.withColumn(
        "expected_force",
        expr.worn_force(c("baseline"), c("wear"), c("temperature_c"), c("entry_thickness_mm"), c("reduction_pct")),
    )


def wear_after(wear: float, step: float, bounces: bool, ticks: int) -> tuple[float, float]:
    """Wear and signed step after a number of ticks.

    A bouncing drift is set to the limit it crosses and turns; from the first turn on it is
    periodic, so no tick is played one by one.
    """
    if ticks <= 0 or step == 0.0:
        return wear, step
    if not bounces:
        moved = wear + step * ticks
        return (max(WEAR_FLOOR, min(WEAR_CEILING, moved)), step)
    size = abs(step)
    span = max(1, math.ceil((WEAR_TOP - WEAR_FLOOR) / size))
    up = step > 0
    first = max(1, math.ceil(((WEAR_TOP - wear) if up else (wear - WEAR_FLOOR)) / size))
    if ticks < first:
        return wear + step * ticks, step
    phase = (ticks - first) % (2 * span)
    falling = (phase < span) == up
    inside = phase if phase < span else phase - span
    return (WEAR_TOP - inside * size, -size) if falling else (WEAR_FLOOR + inside * size, size)


class WearClock:
    """Folds the ordered commands of one grade: wear and drift in force right after each command."""

    def __init__(self, start: float):
        self.wear, self.step, self.freq, self.bounces, self.at = start, 0.0, 1, False, 0

    def run(self, pdf):
        found = []
        for at, kind, value, freq in zip(
            pdf["second"].tolist(), pdf["type"].tolist(), pdf["value"].tolist(), pdf["freq"].tolist()
        ):
            ticks = int(at) // self.freq - int(self.at) // self.freq
            self.wear, self.step = wear_after(self.wear, self.step, self.bounces, ticks)
            self.at = int(at)
            if kind == "abrupt":
                self.wear, self.step, self.freq, self.bounces = float(value), 0.0, 1, False
            elif kind == "gradual":
                usable = freq == freq and freq is not None and int(freq) > 0
                self.step, self.freq = (float(value), int(freq)) if usable else (0.0, 1)
                self.bounces = True
            else:
                self.step, self.freq, self.bounces = float(value), 1, False
            found.append((self.wear, self.step, self.freq, self.bounces))
        out = pdf.copy()
        for name, values in zip(("wear_start", "step", "every", "bounces"), zip(*found)):
            out[name] = values
        return out

    def dump(self) -> bytes:
        return pickle.dumps((self.wear, self.step, self.freq, self.bounces, self.at))

    def load(self, blob: bytes) -> None:
        self.wear, self.step, self.freq, self.bounces, self.at = pickle.loads(blob)


def wear_timeline(commands: DataFrame, key: str = "steel_grade", start: float = WEAR_FLOOR, tie: str = "command_id"):
    """Intervals of the command log: from each command to the next, the wear it starts at and how it drifts.

    ``commands``: key, ts, a tie-breaker, type (``abrupt`` sets, ``gradual`` adds every ``freq`` seconds and
    turns at the limits, ``velocity`` adds every second between floor and ceiling), value, freq.
    """
    rows = commands.select(key, "ts", tie, "type", "value", "freq", wall_second(F.col("ts")).alias("second"))
    staged = stage_order(rows, [key], ["ts", tie], "commands")
    columns = ["ts", tie, "second", "type", "value", "freq"]
    done, _ = ordered_pass(
        staged, [key], lambda: WearClock(start), columns,
        "wear_start double, step double, every int, bounces boolean", label="wear",
    )
    return done


def wall_second(ts: Column) -> Column:
    """Whole seconds of the wall clock since 1970, free of any session time zone."""
    return (
        F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("long") * 86400
        + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts))
    ).cast("long")


def wear_column(wear: Column, step: Column, every: Column, bounces: Column, since: Column, now: Column) -> Column:
    """The same rule as ``wear_after``, as a column expression."""
    ticks = (F.floor(now / every) - F.floor(since / every)).cast("long")
    size = F.abs(step)
    span = F.greatest(F.lit(1), F.ceil((WEAR_TOP - WEAR_FLOOR) / size))
    up = step > 0
    first = F.greatest(F.lit(1), F.ceil(F.when(up, WEAR_TOP - wear).otherwise(wear - WEAR_FLOOR) / size))
    phase = (ticks - first) % (2 * span)
    falling = (phase < span) == up
    inside = F.when(phase < span, phase).otherwise(phase - span)
    turned = F.when(falling, WEAR_TOP - inside * size).otherwise(WEAR_FLOOR + inside * size)
    moved = F.greatest(F.lit(WEAR_FLOOR), F.least(F.lit(WEAR_CEILING), wear + step * ticks))
    return (
        F.when((ticks <= 0) | (step == 0.0), wear)
        .when(~bounces, moved).when(ticks < first, wear + step * ticks).otherwise(turned)
    )


def wear_at(passes: DataFrame, timeline: DataFrame, key: str = "steel_grade", order: Sequence[str] = (),
            start: float = WEAR_FLOOR, tie: str = "command_id") -> DataFrame:
    """As-of join: the wear in force at each pass's ``ts``. A command at the same instant counts.

    Union, one range shuffle and a blocked running last: a grade may hold any share of the rows.
    """
    state = F.struct("second", "wear_start", "step", "every", "bounces")
    log = timeline.select(key, "ts", F.lit(0).alias("_kind"), F.col(tie).cast("string").alias("_tie"), state.alias("_cmd"))
    rows = passes.select(
        key, "ts", F.lit(1).alias("_kind"), F.concat_ws("|", *order).alias("_tie"), F.struct(*passes.columns).alias("_pass")
    )
    both = rows.unionByName(log, allowMissingColumns=True)
    staged = stage_order(both, [key], ["ts", "_kind", "_tie"], "asof")
    filled = running_last(staged, [key], "_cmd", "_now").where(F.col("_kind") == 1)
    c = F.col("_now")
    wear = wear_column(
        c["wear_start"], c["step"], c["every"], c["bounces"], c["second"], wall_second(F.col("ts"))
    )
    return filled.select("_pass.*", F.coalesce(wear, F.lit(start)).alias("wear_now"))
