"""Golden values and scalar rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ambientspark.functions import columns as col, constants as C
from ambientspark.operators import labels, mapping, studies, tuning


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def lit(*xs):
    return [F.lit(x) for x in xs]


@pytest.mark.parametrize("x,band", [(0.3, "high"), (0.25, "mid"), (0.0, "mid"), (-0.25, "low"), (-0.6, "low")])
def test_band(spark, x, band):
    assert one(spark, col.band(*lit(x, -0.25, 0.25))) == band


def test_rounding_matches_python(spark):
    rng = random.Random(3)
    xs = [2.675, 0.575, 0.545, -27.25, 0.5, 1.005, 0.125, -2.5, 1e-9, 123456.785] + [rng.uniform(-100, 100) for _ in range(300)] + \
        [rng.randrange(-20000, 20000) / 200 + d for d in (0, 0.005) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", *[col.round_even("x", d).alias(f"r{d}") for d in (0, 1, 2, 3)])
    for r in df.collect():
        for d in (0, 1, 2, 3):
            assert r[f"r{d}"] == round(r["x"], d), (r["x"], d)


def test_presence_golden(spark):
    cases = [(60.0, 300.0, "fresh"), (300.0, 300.0, "handoff"), (330.0, 300.0, "handoff"), (330.1, 300.0, "absent"), (485.0, 357.753, "absent"),
             (211.7, 220.734, "absent"), (323.7, 109.493, "absent"), (115.6, 121.266, "absent"), (289.6, 176.866, "absent"), (121.7, 136.68, "absent"),
             (3.2, 67.709, "fresh"), (5.2, 302.187, "fresh"), (20.0, 258.613, "fresh"), (244.0, 219.493, "handoff"), (54.0, 265.52, "fresh")]
    df = spark.createDataFrame(cases, "s double, d double, want string").withColumn("got", col.presence_basis("s", "d", F.lit(False)))
    assert df.filter("got <> want").count() == 0
    assert one(spark, col.presence_basis(F.lit(None).cast("double"), F.lit(100.0), F.lit(True))) == "tap"
    assert one(spark, col.presence_basis(F.lit(None).cast("double"), F.lit(100.0), F.lit(False))) == "unknown"


def test_dominance_and_correction(spark):
    for x, m in ((0.05, 0.0), (0.175, 0.5), (0.257, 0.828), (0.30, 1.0), (0.9, 1.0)):
        assert one(spark, col.music_dominance(F.lit(x), F.lit(True))) == pytest.approx(m, abs=1e-9)
    assert one(spark, col.music_dominance(F.lit(0.2), F.lit(False))) is None
    r = one(spark, col.apply_correction(*lit(0.3, 0.1, 0.5, 0.6, 1.0, 1.0, 1.0)))
    assert (r["valence"], r["arousal"]) == pytest.approx((-0.2, -0.5))
    assert one(spark, col.apply_correction(*lit(0.3, 0.1, 0.5, 0.6, 1.0, 4.0, 4.0)))["dv"] == 0.6
    base, mixed = (-0.125, -0.606), (0.205, -0.056)
    fixed = one(spark, col.apply_correction(*lit(*mixed, mixed[0] - base[0], mixed[1] - base[1], 1.0, 1.0, 1.0)))
    assert (fixed["valence"], fixed["arousal"]) == pytest.approx(base)


def test_energy_renormalises_without_arousal(spark):
    full = one(spark, col.energy_score(*lit(-10.0, 4.0, 1.0), F.lit(None).cast("double")))
    assert full == pytest.approx(1.0)
    assert one(spark, col.energy_score(*lit(-35.0, 1.2, 0.6, 0.5))) == pytest.approx(0.3 * 0.5 + 0.2 * 0.3 + 0.25 * 0.6 + 0.25 * 0.75)


@pytest.mark.parametrize("x,b", [(-3.0, "solo"), (0.5, "solo"), (1.5, "4"), (2.5, "4"), (10.4, "1024"), (10.5, "1024"), (10.51, "crowd"), (40.0, "crowd")])
def test_rungs(spark, x, b):
    assert one(spark, col.bucket_from_log2(F.lit(x))) == b


def test_rulebook(spark):
    rows = {(b, v, a): p for b, v, a, p in C.rulebook_rows()}
    assert len(rows) == 108 and rows[("16", "low", "high")] == ["Hard Rock", "Rock"] and rows[("8", "low", "low")] == ["Blues"]
    near = {(r.bucket, r.vband, r.aband): r.near for r in mapping.adjacency(mapping.rulebook(spark)).collect()}
    assert near[("solo", "mid", "mid")] == ["Hip-Hop", "Classical"]
    assert near[("solo", "high", "high")] == ["Hip-Hop"]


def record(spark, verdicts):
    rows = [(v, x, 0.0, -0.25, 0.25, -0.25, 0.25, cell) for v, x, cell in verdicts]
    return spark.createDataFrame(rows, "verdict string, valence double, arousal double, valence_low double, valence_high double, "
                                 "arousal_low double, arousal_high double, cell array<string>")


def test_boundary_shift_golden(spark):
    cell, guard = ["4", "high", "mid"], ["guard", "no-speech"]
    df = record(spark, [("wrong", 0.28, cell)] * 3 + [("good", 0.60, cell)] * 2 + [("wrong", 0.26, guard)])
    best = {r.boundary: (r["shift"], r.wrong_flipped, r.good_flipped) for r in tuning.suggest_boundary_shifts(df).collect()}
    assert best["valence_high"] == (0.05, 3, 0) and best["arousal_low"] == (None, 0, 0)
    near = {r.boundary: r.near for r in tuning.boundary_proximity(df).collect()}
    assert near["valence_high"] == 3 and near["valence_low"] == 0


def test_retro_tap_window_and_stamp(spark):
    o = spark.createDataFrame([(1, 1000.0, "played_through", 180.0, 150.0, None, None), (2, 1000.0, "played_through", 180.0, 150.0, None, None),
                               (3, 1000.0, "played_through", 180.0, 999.0, True, "fresh")],
                              "room_id long, ts double, action string, duration_s double, headcount_staleness_s double, stamped_occupied boolean, stamped_basis string")
    o = o.withColumns({"emotion_staleness_s": F.lit(None).cast("double"), "speech_ratio": F.lit(0.5), "playback_active": F.lit(True)})
    taps = spark.createDataFrame([(1, 900.0), (2, 700.0)], "room_id long, tap_ts double")
    got = {r.room_id: (r.basis, r.occupied, r.stamped, r.gate) for r in labels.gate_overrides(o, taps, 300.0).collect()}
    assert got == {1: ("tap", True, False, "usable"), 2: ("absent", False, False, "suspect"), 3: ("fresh", True, True, "usable")}


def test_near_end_unknown_duration(spark):
    assert one(spark, col.near_end(F.lit(5.0), F.lit(None).cast("double"))) is False
    assert one(spark, col.near_end(F.lit(86.0), F.lit(100.0))) is True


def test_latency_rank(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 101)] + [("b", 3.0)], "k string, v double")
    got = {r.k: (r.n, r.p95) for r in studies.latency_report(df, ["k"], "v", 96.0).collect()}
    assert got == {"a": (100, 95.0), "b": (1, 3.0)}


def test_guard_order(spark):
    null = F.lit(None).cast("string")
    assert one(spark, col.guard_reason(F.lit(0.05), null, F.lit(0.1), F.lit(0.1), null, F.lit(0.1))) == "no-speech"
    assert one(spark, col.guard_reason(F.lit(0.5), null, F.lit(0.1), F.lit(0.1), null, F.lit(0.1))) == "no-emotion"
    assert one(spark, col.guard_reason(F.lit(0.5), F.lit("chill"), F.lit(0.1), F.lit(0.1), F.lit("4"), F.lit(0.1))) == "uncertain-regime"
    assert one(spark, col.guard_reason(F.lit(0.5), F.lit("chill"), F.lit(0.1), F.lit(0.1), F.lit("4"), F.lit(None).cast("double"))) is None
