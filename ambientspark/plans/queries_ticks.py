"""Registered queries: scalars, smoothing, as-of joins, music correction, emitters over ticks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ambientspark.functions import constants as C, columns as col
from ambientspark.operators import chains, emotion, joins, mapping, signal, slabs, smoothing as sm
from ambientspark.plans import views as V
from ambientspark.sources import snapshots

ROOM, ORDER = ["room_id"], ["t", "frame_id"]


def _r(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def _ticks(spark, sf, *cols):
    return V.frames(spark, sf).select("room_id", "t", "frame_id", *cols)


# --- scalars -------------------------------------------------------------------

def energy_mood(spark, sf):
    """Energy, quadrant and bands of the raw windows; every ninth has no emotion reading."""
    f = V.frames(spark, sf).withColumn("a", F.expr("CASE WHEN frame_id % 9 <> 0 THEN a_raw END"))
    cuts = F.lit(-0.25), F.lit(0.25)
    return f.select("frame_id", F.round(col.energy_score("loudness_raw", "activity_raw", "speech_raw", "a"), 6).alias("energy"),
                    col.mood_quadrant("v_raw", "a").alias("mood"), col.band("v_raw", *cuts).alias("vband"),
                    col.band("a", *cuts).alias("aband"))


def unit_scalars(spark, sf):
    f = V.frames(spark, sf)
    return f.select("frame_id", F.round(col.clamp(F.col("v_raw") * 1.5), 6).alias("clamped"),
                    F.round(col.ramp("speech_raw", 0.6, 0.95), 6).alias("ramped"),
                    F.round(col.ramp("speech_raw", 0.5, 0.5), 6).alias("stepped"),
                    F.round(col.rescale_unit("speech_raw"), 6).alias("rescaled"),
                    F.round(col.music_dominance("high_share", "playback_active"), 6).alias("dominance"),
                    col.certification_threshold("playback_active").alias("threshold"))


def occupancy_rungs(spark, sf):
    f = V.frames(spark, sf)
    return f.select("frame_id", col.rung("log2_est").cast("bigint").alias("rung"), col.bucket_from_log2("log2_est").alias("bucket"))


def display_labels(spark, sf):
    f = V.frames(spark, sf)
    status = F.expr("CASE frame_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'degraded' ELSE 'stopped' END")
    return f.select(
        "frame_id", col.regime_label("speech_raw").alias("regime"), col.uncertainty_label("high_share").alias("doubt"),
        col.voice_label("speech_raw").alias("voice"), col.stale_flag(F.col("activity_raw") * 10).alias("stale"),
        col.playback_mode(status, "track_id").alias("mode"),
        col.format_ts(F.col("frame_id") * 3600).alias("stamp"))


def published_state(spark, sf):
    """Rounded published fields and the raw value rebuilt from a published correction."""
    f = V.frames(spark, sf)
    return f.select("frame_id", *col.publish_round(loudness_dbfs=(F.col("loudness_raw") / 3, 1),
                                                   activity_density=(F.col("activity_raw") / 7, 2),
                                                   speech_ratio=(F.col("speech_raw") / 3, 3)),
                    F.round(col.raw_from_corrected("v_raw", F.when(F.col("playback_active"), F.col("high_share"))), 6).alias("raw_valence"))


def tier_labels(spark, sf):
    f = V.frames(spark, sf)
    action = F.expr("CASE frame_id % 4 WHEN 0 THEN 'raise' WHEN 1 THEN 'lower' ELSE 'hold' END")
    return f.select("frame_id", col.derive_tier("a_raw", action).alias("tier"))


def playlist_ids(spark, sf):
    p = V.tracks(spark, sf).selectExpr("track_id", """CASE track_id % 4
        WHEN 0 THEN concat(' spotify:playlist:P', track_id) WHEN 1 THEN concat('https://open.spotify.com/playlist/P', track_id, '?si=x')
        WHEN 2 THEN concat('https://open.spotify.com/playlist/P', track_id, '/') ELSE concat('P', track_id) END AS configured""")
    return p.select("track_id", col.normalize_playlist_id("configured").alias("playlist"))


# --- smoothing -----------------------------------------------------------------

def ema_loudness(spark, sf):
    df = _ticks(spark, sf, "loudness_raw", "activity_raw", "speech_raw")
    df = sm.ema(df, ROOM, ORDER, V.slab(spark, sf), C.TAU_DSP_S, loudness=F.col("loudness_raw"),
                activity=F.col("activity_raw"), speech=F.col("speech_raw"))
    return _r(df.select("frame_id", "loudness", "activity", "speech"), "loudness", "activity", "speech")


def noise_floor(spark, sf):
    df = sm.ema(_ticks(spark, sf, "loudness_raw", "speech_raw"), ROOM, ORDER, V.slab(spark, sf), C.TAU_FLOOR_S,
                where=F.col("speech_raw") < C.QUIET_SPEECH, floor=F.col("loudness_raw"))
    return _r(df.select("frame_id", "floor"), "floor")


def linear_scan(spark, sf):
    """y = exp(-0.1) y + x, forgotten whenever playback is off."""
    step = F.when(F.col("playback_active"), 0.1).otherwise(slabs.RESET)
    df = slabs.linear_scan(_ticks(spark, sf, "speech_raw", "playback_active"), ROOM, ORDER, V.slab(spark, sf), step,
                           y=F.col("speech_raw"))
    return _r(df.select("frame_id", "y"), "y")


def trend_energy(spark, sf):
    e = col.energy_score("loudness_raw", "activity_raw", "speech_raw", "a_raw")
    df = sm.trend(_ticks(spark, sf, e.alias("energy")), ROOM, "t", V.slab(spark, sf), trend=F.col("energy"))
    return df.select("frame_id", "trend")


def va_trend(spark, sf):
    f = _ticks(spark, sf, F.expr("CASE WHEN frame_id % 7 <> 0 THEN v_raw END AS valence"), F.col("a_raw").alias("arousal"))
    return sm.va_trend(f, ROOM, "t", V.slab(spark, sf)).select("frame_id", "valence_trend", "arousal_trend")


def hysteresis_bucket(spark, sf):
    f = _ticks(spark, sf, F.floor(F.col("log2_est") / 6).alias("candidate"))
    return sm.hysteresis(f, ROOM, ORDER, V.slab(spark, sf), F.col("candidate")).select("frame_id", "candidate", "published")


def bucket_smoother(spark, sf):
    df = sm.bucket_smoother(_ticks(spark, sf, "log2_est"), ROOM, ORDER, V.slab(spark, sf), F.col("log2_est"))
    return _r(df.select("frame_id", "smoothed_log2", "bucket"), "smoothed_log2")


def envelope_advisory(spark, sf):
    """Advisory over windows whose loudness while playing is well above a quiet-time floor."""
    f = _ticks(spark, sf, "playback_active", F.expr("CASE WHEN frame_id % 5 <> 0 THEN -50.0D + frame_id % 7 END AS floor"),
               F.expr("CASE WHEN frame_id % 11 <> 0 THEN -38.0D + frame_id % 3 END AS loud"),
               F.expr("CASE WHEN frame_id % 13 <> 0 THEN CAST(frame_id % 17 = 0 AS INT) * 0.5D END AS speech"))
    df = sm.envelope_advisory(f, ROOM, ORDER, V.slab(spark, sf), "playback_active", "floor", "loud", "speech", hops=4)
    return df.select("frame_id", "anchor", "blind_streak", "envelope_advisory")


def anchor_writes(spark, sf):
    """Quiet anchors worth saving: the first, then those at least 0.5 dB from the last saved one."""
    f = V.frames(spark, sf).filter("NOT playback_active").select("room_id", "t", "frame_id", "loudness_raw")
    kept = chains.deadband(f, ROOM, ORDER, V.slab(spark, sf), F.col("loudness_raw"), C.ANCHOR_DEADBAND_DB * 8)
    return kept.select("frame_id", F.round("loudness_raw", 6).alias("anchor"))


def anchor_seed(spark, sf):
    """Last quiet anchor per room, usable at time 260 only while at most 150 s old."""
    f = V.frames(spark, sf).filter("NOT playback_active")
    last = f.groupBy("room_id").agg(F.max_by("loudness_raw", F.struct(*ORDER)).alias("anchor"), F.max("t").alias("at"))
    seed = snapshots.usable_anchor(F.col("anchor"), F.col("at"), F.lit(260.0), 150.0)
    return last.select("room_id", F.round(seed, 6).alias("anchor")).filter("anchor IS NOT NULL")


def recent_values(spark, sf):
    df = sm.recent_values(_ticks(spark, sf, "log2_est"), ROOM, ORDER, V.slab(spark, sf), F.col("log2_est"))
    return df.select("frame_id", F.concat_ws(",", F.transform("recent", lambda x: F.format_string("%.1f", x))).alias("recent"))


def trail(spark, sf):
    df = sm.trail(_ticks(spark, sf, "v_raw", "a_raw"), ROOM, "t", V.slab(spark, sf), 12.0, "v_raw", "a_raw")
    return df.select("frame_id", F.size("trail").cast("bigint").alias("points"),
                     F.round(F.aggregate("trail", F.lit(0.0), lambda s, p: s + p["v_raw"]), 6).alias("sum_valence"))


def history_tail(spark, sf):
    return sm.history(_ticks(spark, sf), ROOM, ORDER, 20).select("room_id", "frame_id")


def current_recommendation(spark, sf):
    return sm.current_recommendation(_ticks(spark, sf, "v_raw"), ROOM, ORDER).select("room_id", "frame_id", "v_raw")


# --- emitters ------------------------------------------------------------------

def throttle(spark, sf):
    f = V.frames(spark, sf).filter(F.col("speech_raw") >= C.MIN_SPEECH_RATIO).select("room_id", "t", "frame_id")
    return chains.throttle(f, ROOM, ORDER, V.slab(spark, sf), 8.0).select("room_id", "frame_id")


def deadband(spark, sf):
    f = _ticks(spark, sf, "loudness_raw")
    return chains.deadband(f, ROOM, ORDER, V.slab(spark, sf), F.col("loudness_raw"), 4.0).select("room_id", "frame_id")


def emit_on_change(spark, sf):
    f = _ticks(spark, sf, F.when(F.col("v_raw") > 0.9, "high").otherwise("low").alias("sig"))
    return chains.emit_on_change(f, ROOM, ORDER, V.slab(spark, sf), F.col("sig"), 9.0).select("room_id", "frame_id", "sig")


# --- as-of ---------------------------------------------------------------------

def _readings(spark, sf):
    return (V.frames(spark, sf).filter(F.col("speech_raw") >= C.MIN_SPEECH_RATIO)
            .select("room_id", F.col("t").alias("at"), F.col("frame_id").alias("reading_id"),
                    F.col("v_raw").alias("valence"), F.col("a_raw").alias("arousal"), F.col("speech_raw").alias("confidence")))


def _held(spark, sf, *cols):
    cols = cols or ("loudness_raw", "activity_raw", "speech_raw", "high_share", "playback_active", "track_id", "v_raw", "a_raw")
    return joins.asof_reading(_ticks(spark, sf, *cols), _readings(spark, sf), ROOM, V.slab(spark, sf),
                              ["reading_id", "valence", "arousal", "confidence"], reading_id="reading_id")


def asof_reading(spark, sf):
    h = _held(spark, sf, "v_raw")
    return h.select("frame_id", "reading_id", "valence", F.round("staleness_s", 6).alias("staleness_s"),
                    col.gated_mood("valence", "arousal", "staleness_s").alias("mood"))


def asof_playback(spark, sf):
    obs = V.now_playing_obs(spark, sf).selectExpr(
        "room_id", "t", "obs_id", "CASE WHEN obs_id % 24 <> 0 THEN track_id END AS obs_track", "is_playing AS obs_playing")
    out = joins.asof_playback(_ticks(spark, sf), obs, ROOM, V.slab(spark, sf))
    return out.select("frame_id", "playback_active", "playback_track_id")


def asof_max_age(spark, sf):
    out = joins.asof_max_age(_ticks(spark, sf), _readings(spark, sf), ROOM, V.slab(spark, sf), ["valence"], 5.0,
                             right_id="reading_id")
    return out.select("frame_id", "valence")


# --- music-aware emotion -------------------------------------------------------

def _measured(spark, sf):
    s = V.slab(spark, sf)
    ticks = _held(spark, sf).withColumn("m", col.music_dominance("high_share", "playback_active"))
    return emotion.pull_samples(emotion.clean_baseline(emotion.bankable(slabs.stage(ticks), s), s))


def clean_baseline(spark, sf):
    df = _measured(spark, sf).select("frame_id", "banked", "clean", "base_valence", "base_arousal")
    return _r(df, "base_valence", "base_arousal")


def pull_samples(spark, sf):
    df = _measured(spark, sf).filter("pull_v IS NOT NULL").select("frame_id", "track_id", "pull_v", "pull_a")
    return _r(df, "pull_v", "pull_a")


def reference_taps(spark, sf):
    return emotion.reference_taps(V.frames(spark, sf)).select("frame_id", "track_id", "v_raw", "a_raw")


def running_signature(spark, sf):
    """Standalone response per track after each reference tap."""
    taps = emotion.reference_taps(V.frames(spark, sf))
    df = sm.running_signature(taps.select("track_id", "t", "frame_id", "v_raw", "a_raw"), ["track_id"], ORDER,
                              V.slab(spark, sf, "tracks"), "refs", F.lit(True), valence=F.col("v_raw") * F.sqrt(F.lit(0.5)), arousal=F.col("a_raw") * F.sqrt(F.lit(0.5)))
    return _r(df.select("frame_id", "track_id", "refs", "valence", "arousal"), "valence", "arousal")


def _corrected(spark, sf):
    return emotion.music_correction(slabs.stage(_held(spark, sf)), V.slab(spark, sf), V.slab(spark, sf, "tracks"))


def corrected_emotion(spark, sf):
    df = _corrected(spark, sf).select("frame_id", "v_inst", "a_inst", "dv", "da", "basis", "basis_refs", "emotion_confidence")
    return _r(df, "v_inst", "a_inst", "dv", "da", "emotion_confidence")


def va_hold_ema(spark, sf):
    df = emotion.sample_and_hold_ema(_held(spark, sf), V.slab(spark, sf), v="valence", a="arousal")
    return _r(df.select("frame_id", "valence_ema", "arousal_ema"), "valence_ema", "arousal_ema")


def _signed(spark, sf):
    s = V.slab(spark, sf)
    ticks = slabs.stage(_measured(spark, sf))
    tap = F.col("playback_active") & (F.col("speech_raw") <= C.REF_MAX_SPEECH)
    ticks = ticks.withColumns({"ref_v": F.when(tap, F.col("v_raw")), "ref_a": F.when(tap, F.col("a_raw"))})
    return emotion.track_signatures(ticks, V.slab(spark, sf, "tracks"))


def signature_lookup(spark, sf):
    """Signature each playing tick sees; standalone part only once trusted."""
    df = emotion.signature_lookup(_signed(spark, sf).filter("track_id IS NOT NULL"), trusted=True)
    cols = ["sig_valence", "pull_valence", "pull_arousal"]
    return _r(df.select("frame_id", "refs", "pull_refs", *cols), *cols)


def signature_stats(spark, sf):
    return emotion.signature_stats(emotion.latest_signatures(_signed(spark, sf)))


# --- speech --------------------------------------------------------------------

def speech_ratio(spark, sf):
    v = V.vad_chunks(spark, sf)
    df = signal.rolling_ratio(v, ROOM, ["t", "chunk_id"], V.slab(spark, sf), plain=C.CERT_THRESHOLD,
                              strict=C.CERT_THRESHOLD_PLAYBACK)
    picked = F.when(F.col("playback_active"), F.col("strict")).otherwise(F.col("plain"))
    return df.select("chunk_id", F.round(picked, 6).alias("speech_ratio"))


def _masks(spark, sf):
    """A chunk mask per window, derived from the window's id."""
    return V.frames(spark, sf).selectExpr(
        "frame_id", "transform(sequence(0, 95 + CAST(frame_id % 61 AS INT)), i -> (frame_id * 7 + floor(i / (9 + frame_id % 50))) % 3 <> 0) AS mask")


def speech_runs(spark, sf):
    df = _masks(spark, sf).select("frame_id", F.explode(signal.speech_runs("mask")).alias("r"))
    return df.select("frame_id", F.col("r.start").cast("bigint").alias("start_chunk"), F.col("r.end").cast("bigint").alias("end_chunk"))


def speech_segments(spark, sf):
    df = signal.speech_segments(_masks(spark, sf), "frame_id", "mask", 80_000)
    return df.select("frame_id", F.col("pos").cast("bigint").alias("pos"), F.col("start").cast("bigint").alias("start_sample"),
                     F.col("end").cast("bigint").alias("end_sample"))


def rms_dbfs(spark, sf):
    e = V.evidence(spark, sf)
    return e.select("evidence_id", F.round(signal.rms_dbfs("embedding"), 6).alias("dbfs"))


def spectral_features(spark, sf):
    """Band shares and onset density of a tone per embedding, gated in eighth-second bursts."""
    tone = V.evidence(spark, sf).selectExpr(
        "evidence_id", "transform(sequence(0, 8191), i -> sin(2 * pi() * 100 * (evidence_id % 40 + 1) * i / 16000) * IF(floor(i / 2000) % 2 = 0, 1.0D, 0.1D)) AS samples")
    return signal.spectral_features(tone)


def spectral_short(spark, sf):
    """The same features of the embeddings read as samples, in frames of 16."""
    e = V.evidence(spark, sf).select("evidence_id", F.col("embedding").alias("samples"))
    return signal.spectral_features(e, frame=16, hop=8)


# --- mapping -------------------------------------------------------------------

def _states(spark, sf):
    e = col.energy_score("loudness_raw", "activity_raw", "speech_raw", "a_raw")
    f = _ticks(spark, sf, F.expr("CASE WHEN frame_id % 11 <> 0 THEN v_raw END AS valence"),
               F.expr("CASE WHEN frame_id % 11 <> 0 THEN a_raw END AS arousal"), F.col("speech_raw").alias("speech_ratio"),
               F.col("high_share").alias("emotion_confidence"), F.expr("(frame_id * 29 % 101) / 100.0D AS headcount_confidence"),
               F.when(F.col("frame_id") % 13 != 0, col.bucket_from_log2("log2_est")).alias("bucket"), e.alias("energy"))
    f = f.withColumn("mood", F.when(F.col("frame_id") % 17 != 0, col.mood_quadrant("valence", "arousal")))
    return sm.trend(f, ROOM, "t", V.slab(spark, sf), trend=F.col("energy"))


def guard_reason(spark, sf):
    s = _states(spark, sf)
    return s.select("frame_id", col.guard_reason("speech_ratio", "mood", "valence", "arousal", "bucket",
                                                 "headcount_confidence").alias("reason"))


def rulebook_lookup(spark, sf):
    f = V.frames(spark, sf).select("frame_id", col.bucket_from_log2("log2_est").alias("bucket"),
                                   col.band("v_raw", F.lit(-0.25), F.lit(0.25)).alias("vband"),
                                   col.band("a_raw", F.lit(-0.25), F.lit(0.25)).alias("aband"))
    return mapping.rulebook_lookup(f, mapping.rulebook(spark)).select("frame_id", F.array_join("pool", " / ").alias("pool"))


def _flat_recs(df):
    return df.select("frame_id", "energy_action", F.round("target_valence", 6).alias("target_valence"),
                     F.round("target_arousal", 6).alias("target_arousal"), F.array_join("genre_pool", " / ").alias("pool"),
                     F.round("confidence", 6).alias("confidence"), "summary", col.cell_label("matched_cell").alias("cell"),
                     F.col("boundaries_snapshot.valence_high").alias("valence_high"))


def recommendation_candidates(spark, sf):
    return _flat_recs(mapping.candidates(_states(spark, sf), mapping.rulebook(spark), V.slab(spark, sf)))


def recommendations(spark, sf):
    return _flat_recs(mapping.recommend(_states(spark, sf), mapping.rulebook(spark), V.slab(spark, sf)))


def adjacent_pool(spark, sf):
    recs = mapping.candidates(_states(spark, sf), mapping.rulebook(spark), V.slab(spark, sf))
    df = mapping.adjacent_pool(recs.select("frame_id", "matched_cell", "genre_pool"), mapping.adjacency(mapping.rulebook(spark)))
    return df.select("frame_id", F.array_join("adjacent_pool", " / ").alias("pool"))


QUERIES = {f.__name__: f for f in (
    energy_mood, unit_scalars, occupancy_rungs, display_labels, published_state, tier_labels, playlist_ids,
    ema_loudness, noise_floor, linear_scan, trend_energy, va_trend, hysteresis_bucket, bucket_smoother,
    envelope_advisory, anchor_writes, anchor_seed, recent_values, trail, history_tail, current_recommendation,
    throttle, deadband, emit_on_change, asof_reading, asof_playback, asof_max_age, clean_baseline, pull_samples,
    reference_taps, running_signature, corrected_emotion, va_hold_ema, signature_lookup, signature_stats,
    speech_ratio, speech_runs, speech_segments, rms_dbfs, spectral_features, spectral_short, guard_reason, rulebook_lookup,
    recommendation_candidates, recommendations, adjacent_pool)}
