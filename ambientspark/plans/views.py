"""Telemetry views over the generic test tables: the inputs of the registered queries.

Each view is one projection, so a filter or column choice above it reaches the scan.
Times are compressed: events span about 259 s per room.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from ambientspark.functions import constants as C
from ambientspark.operators.slabs import fit_slab

TRACK_S = 20.0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_US = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)"


def frames(spark, sf) -> DataFrame:
    return (table(spark, sf, "events").selectExpr(
        "event_id AS frame_id", "user_id AS room_id", f"{_US} / 1e10D AS t", "value",
        "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k")
        .selectExpr(
        "frame_id", "room_id", "t",
        "-60.0D + 50.0D * least(value, 100.0D) / 100.0D AS loudness_raw",
        "(k % 41) / 10.0D AS activity_raw",
        "(frame_id * 7 % 50) / 100.0D AS high_share",
        "(k % 20) / 20.0D AS speech_raw",
        "(frame_id * 37 % 201) / 100.0D - 1.0D AS v_raw",
        "(frame_id * 53 % 201) / 100.0D - 1.0D AS a_raw",
        "(frame_id * 11 % 120) / 10.0D AS log2_est",
        "CAST(floor(t / 40) AS BIGINT) % 2 = 1 AS playback_active",
        "CASE WHEN CAST(floor(t / 40) AS BIGINT) % 2 = 1 "
        "THEN concat('trk', CAST(CAST(floor(t / 20) AS BIGINT) % 8 AS STRING)) END AS track_id"))


_DAY = "datediff(CAST(o_orderdate AS DATE), DATE'1995-01-01')"
_RUNG = "CASE o_custkey % 12 " + " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(C.LADDER)) + " END"


def annotations(spark, sf) -> DataFrame:
    """Flat verdict records, as `flatten_annotations` yields them from the logs."""
    return (table(spark, sf, "orders").selectExpr(
        "o_orderkey AS rec_id", "o_custkey % 50 AS room_id", f"CAST({_DAY} * 600 + o_orderkey * 6151 % 600 AS DOUBLE) AS ts",
        "CASE WHEN o_orderkey % 12 = 0 OR o_orderkey * 37 % 201 BETWEEN 126 AND 129 THEN 'wrong' ELSE 'good' END AS verdict",
        "o_orderkey % 17 = 0 AS guard",
        "CASE WHEN o_orderkey % 17 <> 0 THEN (o_orderkey * 37 % 201) / 100.0D - 1.0D END AS valence",
        "CASE WHEN o_orderkey % 17 <> 0 THEN (o_orderkey * 53 % 201) / 100.0D - 1.0D END AS arousal",
        "-0.25D AS valence_low", "CASE WHEN o_orderkey % 3 = 0 THEN 0.30D ELSE 0.25D END AS valence_high",
        "-0.25D AS arousal_low", "0.25D AS arousal_high", f"{_RUNG} AS bucket")
        .selectExpr(
        "rec_id", "room_id", "ts", "verdict", "valence", "arousal",
        "valence_low", "valence_high", "arousal_low", "arousal_high",
        """CASE WHEN guard THEN array('guard', 'no-speech') ELSE array(bucket,
             CASE WHEN valence > valence_high THEN 'high' WHEN valence > valence_low THEN 'mid' ELSE 'low' END,
             CASE WHEN arousal > arousal_high THEN 'high' WHEN arousal > arousal_low THEN 'mid' ELSE 'low' END)
           END AS cell"""))


def overrides(spark, sf) -> DataFrame:
    """Flat override records, as `flatten_overrides` yields them from the logs."""
    return (table(spark, sf, "orders").selectExpr(
        "o_orderkey AS rec_id", "o_custkey % 50 AS room_id", f"CAST({_DAY} * 600 + o_orderkey * 7919 % 600 AS DOUBLE) AS ts",
        "CASE o_orderkey % 10 WHEN 0 THEN 'skip' WHEN 1 THEN 'wrong_vibe' WHEN 2 THEN 'manual' ELSE 'played_through' END AS action",
        "CAST(120 + o_orderkey % 240 AS DOUBLE) AS duration_s",
        "CASE WHEN o_orderkey % 23 <> 0 THEN (o_orderkey * 131 % 5000) / 10.0D END AS headcount_staleness_s",
        "CASE WHEN o_orderkey % 29 <> 0 THEN (o_orderkey * 17 % 1300) / 10.0D END AS emotion_staleness_s",
        "CASE WHEN o_orderkey % 31 <> 0 THEN (o_orderkey * 13 % 101) / 100.0D END AS speech_ratio",
        "o_orderkey % 4 <> 0 AS playback_active",
        "CASE WHEN o_orderkey % 17 <> 0 THEN (o_orderkey * 37 % 201) / 100.0D - 1.0D END AS valence",
        "CASE WHEN o_orderkey % 17 <> 0 THEN (o_orderkey * 53 % 201) / 100.0D - 1.0D END AS arousal",
        "-0.25D AS valence_low", "CASE WHEN o_orderkey % 3 = 0 THEN 0.30D ELSE 0.25D END AS valence_high",
        "-0.25D AS arousal_low", "0.25D AS arousal_high",
        "o_orderkey % 19 = 0 AS no_cell", "o_orderkey % 17 = 0 AS guard", f"{_RUNG} AS bucket",
        "CASE WHEN o_orderkey % 38 = 0 THEN 'manual' END AS source",
        "CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey * 71 % 201) / 100.0D - 1.0D END AS target_arousal",
        "CASE o_orderkey % 4 WHEN 0 THEN 'raise' WHEN 1 THEN 'lower' WHEN 2 THEN 'hold' END AS energy_action",
        "CASE WHEN o_orderkey % 10 = 2 AND o_orderkey % 7 <> 0 THEN CASE o_orderkey * 3 % 11 % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'mid' ELSE 'high' END END AS chosen_tier",
        "CASE WHEN o_orderkey % 5 <> 4 THEN CASE o_orderkey * 7 % 3 WHEN 0 THEN 'Jazz' WHEN 1 THEN 'Rock' ELSE 'Pop' END END AS genre",
        "CASE WHEN o_orderkey % 41 = 0 THEN o_orderkey % 2 = 0 END AS stamped_occupied",
        "CASE WHEN o_orderkey % 41 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'fresh' ELSE 'absent' END END AS stamped_basis")
        .selectExpr(
        "rec_id", "room_id", "ts", "action", "duration_s", "headcount_staleness_s", "emotion_staleness_s",
        "speech_ratio", "playback_active", "valence", "arousal",
        "valence_low", "valence_high", "arousal_low", "arousal_high",
        """CASE WHEN no_cell THEN CAST(NULL AS ARRAY<STRING>) WHEN guard THEN array('guard', 'no-speech') ELSE array(bucket,
             CASE WHEN valence > valence_high THEN 'high' WHEN valence > valence_low THEN 'mid' ELSE 'low' END,
             CASE WHEN arousal > arousal_high THEN 'high' WHEN arousal > arousal_low THEN 'mid' ELSE 'low' END)
           END AS cell""",
        "source", "target_arousal", "energy_action", "chosen_tier", "genre", "stamped_occupied", "stamped_basis"))


def evidence(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").selectExpr(
        "vec_id AS evidence_id", "CAST(floor(vec_id / 25) AS BIGINT) AS room_id", "2.0D * (vec_id % 25) AS at",
        "0.75D + 0.125D * (vec_id % 5) AS duration_s", "CAST(label AS BIGINT) AS label",
        "transform(embedding, x -> CAST(x AS DOUBLE)) AS embedding")


def now_playing_obs(spark, sf) -> DataFrame:
    return (table(spark, sf, "events").selectExpr("event_id AS obs_id", "user_id AS room_id", f"{_US} / 1e10D AS t")
            .selectExpr("obs_id", "room_id", "t",
                        "concat('trk', CAST(CAST(floor(t / 20) AS BIGINT) % 8 AS STRING)) AS track_id",
                        "t - 20.0D * floor(t / 20) AS progress_s", "20.0D AS duration_s", "obs_id % 10 <> 0 AS is_playing"))


def selections(spark, sf) -> DataFrame:
    """Pick log: which track the selector chose, when."""
    return (table(spark, sf, "events").filter("event_type = 'click'")
            .selectExpr("event_id AS pick_id", "user_id AS room_id", f"{_US} / 1e10D AS t",
                        "concat('trk', CAST(event_id * 5 % 12 AS STRING)) AS track_id"))


def track_vetoes(spark, sf) -> DataFrame:
    """Tracks a human overrode, when."""
    return (table(spark, sf, "events").filter("event_type = 'error'")
            .selectExpr("event_id AS veto_id", "user_id AS room_id", f"{_US} / 1e10D AS t",
                        "concat('trk', CAST(event_id * 7 % 30 AS STRING)) AS track_id"))


def tracks(spark, sf) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS track_id", "p_name AS title", "p_type AS genre",
        "CASE p_size % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'mid' ELSE 'high' END AS tier",
        "CAST(120 + p_partkey % 240 AS DOUBLE) AS duration_s", "p_brand AS playlist_id")


def vad_chunks(spark, sf) -> DataFrame:
    return frames(spark, sf).selectExpr("room_id", "frame_id AS chunk_id", "t", "speech_raw AS prob", "playback_active")


def phases(spark) -> DataFrame:
    """A four-phase protocol over the frames' time span."""
    return spark.createDataFrame(
        [("baseline", 0.0, 60.0), ("music", 60.0, 130.0), ("pull", 130.0, 190.0), ("animated", 190.0, 260.0)],
        "phase string, start_s double, end_s double")


@lru_cache(maxsize=None)
def _fitted(app_id: str, sf: str, view: str) -> float:
    spark = SparkSession.getActiveSession()
    if view == "frames":
        return fit_slab(frames(spark, sf).select("room_id", "t"), ["room_id"], "t")
    if view == "tracks":
        on = frames(spark, sf).filter("track_id IS NOT NULL").select("track_id", "t")
        return fit_slab(on, ["track_id"], "t")
    if view == "labels":
        return fit_slab(overrides(spark, sf).select("room_id", "ts"), ["room_id"], "ts")
    return fit_slab(evidence(spark, sf).select("room_id", "at"), ["room_id"], "at")


def slab(spark, sf, view: str = "frames") -> float:
    """Slab width for a view, fitted to its densest key."""
    return _fitted(spark.sparkContext.applicationId, sf, view)
