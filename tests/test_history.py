"""Wear timelines against played ticks, slab trajectories against a loop."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from slowtruth.operators import history


def play(wear, step, bounces, ticks):
    for _ in range(ticks):
        if not bounces:
            wear = max(0.001, min(100.0, wear + step))
            continue
        wear += step
        if wear >= 60.0:
            wear, step = 60.0, -abs(step)
        elif wear <= 0.001:
            wear, step = 0.001, abs(step)
    return wear


@pytest.mark.parametrize("bounces", [True, False])
def test_closed_form_equals_played_ticks(bounces):
    rng = random.Random(11)
    for _ in range(400):
        wear = rng.uniform(0.001, 60)
        step = rng.choice([-1, 1]) * rng.choice([0.37, 1.3, 7.7, 61.0])
        ticks = rng.randint(0, 300)
        found, _ = history.wear_after(wear, step, bounces, ticks)
        assert found == pytest.approx(play(wear, step, bounces, ticks), abs=1e-9)


def test_timeline_and_asof(spark, tiny_blocks):
    rng = random.Random(2)
    start = datetime(2024, 5, 1)
    commands, passes = [], []
    for i in range(120):
        kind = rng.choice(["abrupt", "gradual", "velocity"])
        commands.append(("g", start + timedelta(seconds=50 * i), i, kind, rng.uniform(0.1, 9), rng.choice([0, 1, 7])))
    for i in range(300):
        passes.append(("g" if i else "other", start + timedelta(seconds=rng.randint(0, 6000)), i))
    log = spark.createDataFrame(
        commands, "steel_grade string, ts timestamp_ntz, command_id int, type string, value double, freq int")
    rows = spark.createDataFrame(passes, "steel_grade string, ts timestamp_ntz, i int")
    found = history.wear_at(rows, history.wear_timeline(log), order=["i"]).collect()
    assert len(found) == 300

    def clock(t):
        return int((t - datetime(1970, 1, 1)).total_seconds())

    ordered = sorted((p for p in passes if p[0] == "g"), key=lambda p: p[1])
    wear, step, freq, bounces = 0.001, 0.0, 1, False
    second, queue, expected = clock(start), list(commands), {}
    for p in ordered:
        while True:
            upto = min(clock(p[1]), clock(queue[0][1])) if queue else clock(p[1])
            while second < upto:
                second += 1
                if step and second % freq == 0:
                    before = wear
                    wear = play(wear, step, bounces, 1)
                    if bounces and before + step >= 60.0:
                        step = -abs(step)
                    elif bounces and before + step <= 0.001:
                        step = abs(step)
            if queue and clock(queue[0][1]) <= clock(p[1]):
                _, _, _, kind, value, every = queue.pop(0)
                if kind == "abrupt":
                    wear, step, freq, bounces = value, 0.0, 1, False
                elif kind == "gradual":
                    step, freq, bounces = (value, every, True) if every > 0 else (0.0, 1, True)
                else:
                    step, freq, bounces = value, 1, False
                continue
            break
        expected[p[2]] = wear
    for r in found:
        assert r["wear_now"] == pytest.approx(expected.get(r["i"], 0.001), abs=1e-6), r


def test_trajectory_equals_loop(spark):
    rng = random.Random(4)
    data, expected = [], {}
    for s in range(30):
        h, l, t, v, d = rng.uniform(200, 250), rng.uniform(2000, 3000), rng.uniform(900, 1220), rng.uniform(1.5, 2), 1080.0
        h0, l0, t0, v0 = h, l, t, v
        for p in range(1, rng.randint(3, 8)):
            r, wait, noise = rng.uniform(0.02, 0.35), rng.uniform(10, 40), rng.gauss(0, 2)
            data.append((f"s{s}", p, r, wait, noise, h0, l0, t0, v0, d))
            t = max(889.0, t - (wait * 0.5 + r * 30 + noise))
            v = min(5.6, v + 2 * r)
            strain = math.log(1 / (1 - r))
            rate = min(16.2, max(0.5, v * 1000 / math.sqrt(d / 2 * h * r) * strain))
            stress = min(178.0, max(5.0, 20 * (1200 / t) ** 4 * strain**0.2 * rate**0.1))
            expected[f"s{s}", p] = (h, l, t, v, strain, rate, stress)
            h, l = h * (1 - r), l / (1 - r)
    schedule = spark.createDataFrame(
        data, "slab_id string, pass_number int, reduction_pct double, wait_time_sec double, temp_noise double, "
        "h0 double, l0 double, t0 double, v0 double, roll_diameter_mm double")
    rows = history.slab_trajectory(schedule).select(
        "slab_id", "pass_number", "entry_thickness_mm", "length_mm", "temperature_c", "speed_m_s", "strain",
        "strain_rate", "flow_stress_mpa").collect()
    assert len(rows) == len(expected)
    for r in rows:
        assert tuple(r)[2:] == pytest.approx(expected[r[0], r[1]], rel=1e-9)


def test_classes(spark):
    rows = spark.createDataFrame([("s", p) for p in range(1, 6)], "slab_id string, pass_number int")
    found = {r["pass_number"]: (r["pass_phase"], r["reduction_class"]) for r in history.add_phases(rows).collect()}
    assert found[1] == ("roughing", "heavy") and found[2] == ("roughing", "medium")
    assert found[4] == ("intermediate", "light") and found[5] == ("finishing", "light")


def test_what_if(spark):
    rows = spark.createDataFrame([(1000.0, 1150.0, 100.0, 0.2)],
                                 "baseline double, temperature_c double, entry_thickness_mm double, reduction_pct double")
    found = {r["wear"]: r["expected_force"] for r in history.drift_what_if(rows, [0.0, 100.0, 140.0]).collect()}
    assert found == {0.0: 1000.0, 100.0: 1240.0, 140.0: 1240.0}
    assert rows.select(F.lit(1)).count() == 1
