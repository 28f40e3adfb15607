"""What travels through shuffles, and how evenly."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ambientspark.functions import constants as C
from ambientspark.operators import joins, mapping
from ambientspark.plans import room


def test_frames_of_one_slab_are_dealt_to_many_tasks(spark):
    """All rooms' frames lie in one time slab; no task of the join holds most of them."""
    frames = spark.range(20_000).selectExpr("id AS frame_id", "id % 50 AS room_id", "(id % 1000) / 10.0D AS t", "array(id) AS more")
    phases = spark.createDataFrame([("a", 0.0, 60.0), ("b", 40.0, 100.0), ("none", 5.0, 5.0)], "phase string, start_s double, end_s double")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = joins.frames_in_phase(frames, phases, 1000.0).select("frame_id", "phase", "more", F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = {(k, p) for k in range(20_000) for p, lo, hi in (("a", 0, 60), ("b", 40, 100)) if lo <= (k % 1000) / 10 < hi}
    assert {(r.frame_id, r.phase) for r in got} == want and len(got) == len(want)
    share = [sum(r.task == k for r in got) / len(got) for k in {r.task for r in got}]
    assert max(share) < 0.6


def _states(spark):
    rng = random.Random(3)
    rows = [(r, float(t), 1000 * r + t, rng.choice(["excited", "chill", None]), rng.choice(["2", "4-8", None]), rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(0, 1), 0.9,
             0.9, rng.choice(["rising", "stable", "falling"])) for r in range(3) for t in range(0, 400, 4)]
    return spark.createDataFrame(rows, "room_id long, t double, frame_id long, mood string, bucket string, valence double, arousal double, speech_ratio double, "
                                       "emotion_confidence double, headcount_confidence double, trend string")


def test_recommendations_are_the_emitted_candidates_and_described_afterwards(spark, monkeypatch):
    seen = []

    def emitted(df, *rest, base=mapping.emit_on_change):
        seen.extend(df.columns)
        return base(df, *rest)

    monkeypatch.setattr(mapping, "emit_on_change", emitted)
    states, grid = _states(spark), mapping.rulebook(spark)
    made = {r.frame_id: r for r in mapping.candidates(states, grid, 60.0).collect()}
    got = mapping.recommend(states, grid, 60.0).collect()
    assert got and not {"summary", "boundaries_snapshot", "genre_pool"} & set(seen)
    assert all(r == made[r.frame_id] for r in got)
    want = set()
    for k in range(3):
        last = None
        for r in sorted((r for r in made.values() if r.room_id == k), key=lambda r: r.t):
            mark = (r.mood, r.bucket, r.energy_action, r.matched_cell[0] == "guard")
            if last is None or (r.t - last[0] >= C.BOUNDARIES["min_dwell_s"] and mark != last[1]):
                want.add(r.frame_id)
                last = (r.t, mark)
    assert {r.frame_id for r in got} == want


def test_a_room_state_carries_on_only_what_it_publishes(spark, monkeypatch):
    seen = []

    def joined(left, *rest, base=room.joins.asof, **more):
        seen.append(left.columns)
        return base(left, *rest, **more)

    monkeypatch.setattr(room.joins, "asof", joined)
    ticks = _states(spark).selectExpr("room_id", "t", "frame_id", "-30.0D - valence AS loudness_raw", "1.0D AS activity_raw", "speech_ratio AS speech_raw", "0.2D AS high_share",
                                      "t % 80 >= 40 AS playback_active", "IF(t % 80 >= 40, 'x', NULL) AS track_id", "valence AS v_raw", "arousal AS a_raw")
    readings = ticks.selectExpr("room_id", "t AS at", "frame_id AS reading_id", "v_raw AS valence", "a_raw AS arousal", "0.5D AS confidence")
    estimates = ticks.selectExpr("room_id", "t", "frame_id", "2.0D AS log2_count", "0.5D AS confidence")
    made = room.room_state(ticks, readings, estimates, 100.0, 100.0)
    assert made.count() == 300
    assert not {"base_valence", "banked", "sig_valence", "pull_v", "v_raw", "high_share"} & set(seen[-1])
