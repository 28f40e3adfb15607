"""End-to-end compositions over ticks, readings, estimates, playback and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ambientspark.functions import constants as C, columns as col
from ambientspark.operators import emotion, joins, mapping, occupancy, playback, smoothing as sm, studies
from ambientspark.operators.slabs import stage

ROOM, ORDER = ["room_id"], ["t", "frame_id"]
#: What a state takes from the corrected ticks; the rest of the correction's columns would travel through every later shuffle and stage.
CORRECTED = ["room_id", "t", "frame_id", "loudness", "activity", "speech", "floor", "playback_active", "track_id", "m", "at", "staleness_s",
             "v_inst", "a_inst", "emotion_confidence", "dv", "da", "basis", "basis_refs"]


def room_state(ticks: DataFrame, readings: DataFrame, estimates: DataFrame, slab_s: float, track_slab_s: float) -> DataFrame:
    """One published state per tick.

    ticks: room_id, t, frame_id, loudness_raw, activity_raw, speech_raw, high_share, playback_active,
    track_id, v_raw, a_raw (the model's read of the window, used for reference taps).
    readings: room_id, at, reading_id, valence, arousal, confidence.
    estimates: room_id, t, frame_id, log2_count, confidence and the estimator's diagnostics.
    Stages are written to the shared folder where the plan would otherwise branch over itself.
    """
    df = sm.averages(ticks, ROOM, ORDER, slab_s,
                     sm.Average(C.TAU_DSP_S, {"loudness": F.col("loudness_raw"), "activity": F.col("activity_raw"),
                                              "speech": F.col("speech_raw")}),
                     sm.Average(C.TAU_FLOOR_S, {"floor": F.col("loudness_raw")}, F.col("speech_raw") < C.QUIET_SPEECH))
    df = joins.asof_reading(df.drop("loudness_raw", "activity_raw"), readings, ROOM, slab_s, ["valence", "arousal", "confidence"], reading_id="reading_id")
    used = ("high_share", "speech_raw", "v_raw", "a_raw")
    df = emotion.music_correction(stage(df), slab_s, track_slab_s, used).select(*CORRECTED)
    df = stage(emotion.sample_and_hold_ema(stage(df), slab_s).drop("v_inst", "a_inst", "at"))
    smoothed = sm.bucket_smoother(estimates, ROOM, ORDER, slab_s, F.col("log2_count"))
    held = smoothed.select("room_id", F.col("t").alias("hc_at"), F.col("frame_id").alias("hc_id"), "bucket",
                           F.col("confidence").alias("hc_confidence"))
    df = joins.asof(df, stage(held), ROOM, "t", "hc_at", slab_s,
                    ["bucket", "hc_confidence"], right_id="hc_id")
    df = df.withColumns({
        "hc_staleness": F.when(F.col("at").isNotNull(), F.greatest(F.lit(0.0), F.col("t") - F.col("at"))),
        "energy_raw": col.energy_score("loudness", "activity", "speech", "arousal_ema")})
    df = sm.trend(df, ROOM, "t", slab_s, trend=F.col("energy_raw"))
    correction = F.when(F.col("basis").isNotNull(), F.struct(
        col.round_even("dv", 3).alias("valence"), col.round_even("da", 3).alias("arousal"), "track_id", "basis",
        F.col("basis_refs").alias("refs")))
    return df.select(
        "room_id", "t", "frame_id",
        *col.publish_round(loudness_dbfs=("loudness", 1), activity_density=("activity", 2), speech_ratio=("speech", 3),
                           valence_pub=("valence_ema", 3), arousal_pub=("arousal_ema", 3),
                           emotion_confidence=("emotion_confidence", 2), emotion_staleness_s=("staleness_s", 1),
                           headcount_confidence=("hc_confidence", 2), headcount_staleness_s=("hc_staleness", 1),
                           energy=("energy_raw", 3), noise_floor_dbfs=("floor", 1), emotion_music_dominance=("m", 3)),
        F.col("bucket").alias("bucket"), "trend", "playback_active", F.col("track_id").alias("playback_track_id"),
        col.gated_mood("valence_ema", "arousal_ema", "staleness_s").alias("mood"),
        correction.alias("emotion_correction")).withColumnsRenamed({"valence_pub": "valence", "arousal_pub": "arousal"})


def completions(obs: DataFrame, selections: DataFrame, vetoes: DataFrame, taps: DataFrame, states: DataFrame,
                slab_s: float, lead_s: float = C.QUEUE_LEAD_S) -> DataFrame:
    """Completed, attributed, unvetoed tracks with the presence block stamped from the latest state.

    states: room_id, state_t, headcount_staleness_s, emotion_staleness_s."""
    done = stage(playback.played_through(obs, selections, vetoes, slab_s, lead_s))
    done = joins.asof(done, states, ROOM, "t", "state_t", slab_s, ["headcount_staleness_s", "emotion_staleness_s"]).drop("at")
    done = joins.tap_ages(done, taps, ROOM, slab_s, ts="t")
    block = col.presence_block("headcount_staleness_s", "emotion_staleness_s", "prev_duration_s", "tap_age_s")
    return done.withColumn("presence", block).drop("headcount_staleness_s", "emotion_staleness_s", "tap_age_s")


def pick_for_recommendations(recs: DataFrame, items: DataFrame, slab_s: float, seed: int = 0) -> DataFrame:
    """Tier from each recommendation, then one track per recommendation; guard holds ask for nothing.

    recs: frame_id, room_id, t, genre_pool, target_arousal, energy_action."""
    asked = recs.filter(F.size("genre_pool") > 0).select(
        F.col("frame_id").alias("request_id"), "room_id", "t", "genre_pool",
        col.derive_tier("target_arousal", "energy_action").alias("tier"))
    return playback.select_tracks(stage(asked), items, slab_s, seed=seed)  # read twice: the trends behind it are found once


def wrong_vibe_alternatives(recs: DataFrame, near: DataFrame, items: DataFrame, slab_s: float, seed: int = 0) -> DataFrame:
    """Resample a vetoed recommendation from the neighbouring cells."""
    moved = mapping.adjacent_pool(recs, near).drop("genre_pool").withColumnRenamed("adjacent_pool", "genre_pool")
    return pick_for_recommendations(moved, items, slab_s, seed)


def contamination_study(frames: DataFrame, phases: DataFrame, slab_s: float, control: str, treatment: str,
                        positive: str) -> tuple[DataFrame, DataFrame]:
    """(phase summary, deltas) of frames labelled with a protocol's phases."""
    labelled = joins.frames_in_phase(frames, phases, slab_s)
    return studies.phase_summary(labelled), studies.phase_delta(labelled, control, treatment, positive)
