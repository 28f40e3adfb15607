"""Column-level semantics: pure expressions, no shuffles, no UDFs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ambientspark.functions import constants as C


def _c(x) -> Column:
    """Column names and Columns pass through; numbers become literals."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


# --- arithmetic ----------------------------------------------------------------

def clamp(x, lo=-1.0, hi=1.0) -> Column:
    """Saturate; null stays null (least/greatest alone would skip it)."""
    x = _c(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def clamp01(x) -> Column:
    return clamp(x, 0.0, 1.0)


def ramp(x, lo: float, hi: float) -> Column:
    """0 at or below lo, 1 at or above hi, linear between; a step when hi <= lo."""
    x = _c(x)
    if hi <= lo:
        return F.when(x >= hi, 1.0).when(x < hi, 0.0)
    return clamp01((x - lo) / (hi - lo))


def rescale_unit(x) -> Column:
    """Model output in [0, 1] to [-1, 1]."""
    return clamp(2.0 * _c(x) - 1.0)


def round_even(x, digits: int) -> Column:
    """Round the double's exact binary value, true ties to even (bround works on its decimal
    print-out, which turns near-ties into ties). The product's rounding error is recovered
    exactly by splitting x into two 26-bit halves."""
    x, scale = _c(x), float(10 ** digits)
    p = x * scale
    c = x * 134217729.0
    high = c - (c - x)
    error = (high * scale - p) + (x - high) * scale
    down = F.floor(p).cast("double")
    near_tie = (p - down == 0.5) & (error != 0.0)
    return F.when(near_tie, F.when(error > 0, down + 1.0).otherwise(down)).otherwise(F.rint(p)) / scale


# --- vectors -------------------------------------------------------------------

def dot(x, y) -> Column:
    return F.aggregate(F.zip_with(_c(x), _c(y), lambda a, b: a.cast("double") * b),
                       F.lit(0.0), lambda s, v: s + v)


def l2_normalize(x) -> Column:
    norm = F.greatest(F.sqrt(dot(x, x)), F.lit(1e-10))
    return F.transform(_c(x), lambda v: v / norm)


def cosine_distance(x, y) -> Column:
    return 1.0 - clamp(dot(x, y))


# --- state labels ----------------------------------------------------------------

def band(x, low, high) -> Column:
    """Strictly above high is "high", strictly above low is "mid", else "low"."""
    x = _c(x)
    return F.when(x > _c(high), "high").when(x > _c(low), "mid").when(x.isNotNull(), "low")


def mood_quadrant(v, a) -> Column:
    v, a = _c(v), _c(a)
    return (F.when(v.isNull() | a.isNull(), None)
            .when((a >= 0) & (v >= 0), "excited").when(a >= 0, "tense")
            .when(v >= 0, "chill").otherwise("flat"))


def gated_mood(v, a, staleness, max_staleness=C.EMOTION_MAX_STALENESS_S) -> Column:
    """Quadrant only while the reading is recent."""
    return F.when(_c(staleness) <= max_staleness, mood_quadrant(v, a))


def energy_score(loudness, activity, speech, arousal) -> Column:
    """Weighted 0..1 composite; without arousal the other weights are renormalised."""
    base = (0.30 * clamp01((_c(loudness) + 60.0) / 50.0) + 0.20 * clamp01(_c(activity) / 4.0)
            + 0.25 * clamp01(speech))
    with_arousal = (base + 0.25 * clamp01((_c(arousal) + 1.0) / 2.0)) / 1.0
    return F.when(_c(arousal).isNull(), base / 0.75).otherwise(with_arousal)


def rung(log2_estimate) -> Column:
    """Ladder index of a log2 estimate: nearest, ties to even, 11 = crowd."""
    x = _c(log2_estimate)
    return F.when(x.isNotNull(), F.least(F.rint(F.greatest(x, F.lit(0.0))), F.lit(11.0)).cast("int"))


def rung_label(idx) -> Column:
    return F.element_at(F.array(*[F.lit(b) for b in C.LADDER]), _c(idx) + 1)


def bucket_from_log2(log2_estimate) -> Column:
    return rung_label(rung(log2_estimate))


def certification_threshold(playback_active) -> Column:
    return F.when(_c(playback_active), C.CERT_THRESHOLD_PLAYBACK).otherwise(C.CERT_THRESHOLD)


def publish_round(**columns) -> list[Column]:
    """name=(column, decimals) -> half-even rounded columns under those names."""
    return [round_even(_c(col), digits).alias(name) for name, (col, digits) in columns.items()]


def raw_from_corrected(published, correction) -> Column:
    """Undo a published correction (none counts as zero)."""
    return _c(published) + F.coalesce(_c(correction), F.lit(0.0))


# --- music ---------------------------------------------------------------------

def music_dominance(high_share, playback_active, lo=C.DOMINANCE_LO, hi=C.DOMINANCE_HI) -> Column:
    return F.when(_c(playback_active), ramp(high_share, lo, hi))


def apply_correction(v, a, pull_v, pull_a, m, beta_v, beta_a, cap=C.MAX_CORRECTION) -> Column:
    """STRUCT<valence, arousal, dv, da>: capped subtraction of a track's pull."""
    dv = clamp(_c(beta_v) * _c(m) * _c(pull_v), -cap, cap)
    da = clamp(_c(beta_a) * _c(m) * _c(pull_a), -cap, cap)
    return F.struct(clamp(_c(v) - dv).alias("valence"), clamp(_c(a) - da).alias("arousal"),
                    dv.alias("dv"), da.alias("da"))


def correction_basis(m, refs, v, a, pull_refs, pull_v, pull_a, min_refs=C.MIN_REFS) -> Column:
    """STRUCT<basis, valence, arousal, scale_v, scale_a, refs>; null when nothing is usable."""
    def basis(name, bv, ba, sv, sa, n):
        return F.struct(F.lit(name).alias("basis"), _c(bv).alias("valence"), _c(ba).alias("arousal"),
                        F.lit(sv).alias("scale_v"), F.lit(sa).alias("scale_a"),
                        _c(n).cast("bigint").alias("refs"))
    return (F.when(~F.coalesce(_c(m) > 0, F.lit(False)), None)
            .when(_c(pull_refs) >= min_refs, basis("pull", pull_v, pull_a, C.BETA_V, C.BETA_A, pull_refs))
            .when(_c(refs) >= min_refs, basis("standalone", v, a, C.STANDALONE_V, C.STANDALONE_A, refs)))


def confidence_discount(confidence, m, basis, gamma=C.DISCOUNT_GAMMA) -> Column:
    """Less conviction while music dominates and no correction is possible."""
    discounted = _c(confidence) * F.greatest(F.lit(0.0), 1.0 - gamma * _c(m))
    return F.when((_c(m) > 0) & _c(basis).isNull(), discounted).otherwise(_c(confidence))


# --- mapping -------------------------------------------------------------------

def boundaries_snapshot(cuts: dict[str, float] | None = None) -> Column:
    cuts = {**C.BOUNDARIES, **(cuts or {})}
    return F.struct(*[F.lit(v).alias(k) for k, v in cuts.items()])


def guard_reason(speech, mood, v, a, bucket, bucket_confidence,
                 min_speech=C.BOUNDARIES["min_speech_ratio"],
                 min_confidence=C.BOUNDARIES["min_headcount_confidence"]) -> Column:
    """Why the mapper holds instead of guessing; first rule wins, null = go."""
    return (F.when(_c(speech) < min_speech, "no-speech")
            .when(_c(mood).isNull() | _c(v).isNull() | _c(a).isNull(), "no-emotion")
            .when(_c(bucket).isNull(), "no-headcount")
            .when(_c(bucket_confidence) < min_confidence, "uncertain-regime"))


def derive_tier(target_arousal, action, low=C.TIER_LOW_MAX, high=C.TIER_HIGH_MIN) -> Column:
    """Arousal band moved one step by the energy action, kept on the ladder."""
    x, act = _c(target_arousal), _c(action)
    base = F.when(x > _c(high), 2).when(x > _c(low), 1).when(x.isNotNull(), 0)
    step = F.when(act == "raise", 1).when(act == "lower", -1).otherwise(0)
    moved = F.when(base.isNotNull(), F.least(F.greatest(base + step, F.lit(0)), F.lit(2)))
    return F.element_at(F.array(*[F.lit(t) for t in C.TIERS]), moved + 1)


def tier_rank(tier) -> Column:
    return F.when(_c(tier) == "low", 0).when(_c(tier) == "mid", 1).when(_c(tier) == "high", 2)


# --- labels ----------------------------------------------------------------------

def presence_basis(staleness, duration, tap_in_window, fresh=C.FRESH_S, handoff=C.HANDOFF_S) -> Column:
    s, d = _c(staleness), _c(duration)
    tapped = F.coalesce(_c(tap_in_window), F.lit(False))
    return (F.when(s.isNull(), F.when(tapped, "tap").otherwise("unknown"))
            .when(s <= fresh, "fresh")
            .when((d > 0) & s.between(d, d + handoff), "handoff")
            .when(tapped, "tap").otherwise("absent"))


def presence_block(headcount_staleness, emotion_staleness, duration, tap_age,
                   fresh=C.FRESH_S, handoff=C.HANDOFF_S) -> Column:
    """The evidence struct stamped on a completion record."""
    staleness = F.coalesce(_c(headcount_staleness), _c(emotion_staleness))
    basis = presence_basis(staleness, duration, _c(tap_age) <= _c(duration), fresh, handoff)
    return F.struct(basis.isin(*C.OCCUPIED).alias("occupied"), basis.alias("basis"),
                    staleness.alias("staleness_s"), _c(duration).alias("track_duration_s"),
                    F.lit(fresh).alias("fresh_s"), F.lit(handoff).alias("handoff_s"),
                    round_even(_c(tap_age), 1).alias("last_tap_age_s"))


def is_blind_veto(action, playback_active, speech, emotion_staleness) -> Column:
    hit = (_c(action).isin(*C.VETOES) & _c(playback_active)
           & (F.coalesce(_c(speech), F.lit(1.0)) <= C.BLIND_SPEECH)
           & (_c(emotion_staleness) > C.BLIND_STALENESS_S))
    return F.coalesce(hit, F.lit(False))


def is_guard(cell) -> Column:
    return F.coalesce(F.try_element_at(_c(cell), F.lit(1)) == "guard", F.lit(False))


def attribution_cell(cell, source) -> Column:
    """Where an override is counted when no cell was recorded."""
    return (F.when(F.size(_c(cell)) > 0, _c(cell))
            .when(_c(source) == "manual", F.array(F.lit("manual")))
            .otherwise(F.array(F.lit("?"))))


def strong_label_verdict(action) -> Column:
    return F.when(_c(action).isin("skip", "wrong_vibe"), "wrong").when(_c(action) == "played_through", "good")


def annotation_reject_reason(verdict, state, recommendation) -> Column:
    return (F.when(~F.coalesce(_c(verdict).isin(*C.VERDICTS), F.lit(False)), "verdict")
            .when(_c(recommendation).isNull(), "recommendation")
            .when(_c(state).isNull(), "state"))


def override_reject_reason(action, state, recommendation, now_playing, chosen) -> Column:
    return (F.when(~F.coalesce(_c(action).isin(*C.ACTIONS), F.lit(False)), "action")
            .when(_c(state).isNull(), "state")
            .when(_c(recommendation).isNull(), "recommendation")
            .when(_c(now_playing).isNull(), "now_playing")
            .when((_c(action) == "manual") & _c(chosen).isNull(), "chosen"))


# --- playback ------------------------------------------------------------------

def near_end(progress_s, duration_s, lead=C.QUEUE_LEAD_S) -> Column:
    """Inside the boundary window; an unknown duration is never near its end."""
    d = _c(duration_s)
    return F.coalesce((d > 0) & (_c(progress_s) >= d - lead), F.lit(False))


def normalize_playlist_id(configured, host="open.spotify.com") -> Column:
    """Playlist URI, share URL or bare id -> bare id."""
    value = F.trim(_c(configured))
    marker = f"{host}/playlist/"
    tail = F.regexp_extract(value, marker.replace(".", r"\.") + "([^?]*)", 1)
    return (F.when(value.startswith("spotify:playlist:"), F.element_at(F.split(value, ":"), -1))
            .when(value.contains(marker), F.regexp_replace(tail, "^/+|/+$", ""))
            .otherwise(value))


# --- display labels --------------------------------------------------------------

def cell_label(cell) -> Column:
    return F.array_join(_c(cell), " / ")


def format_ts(ts) -> Column:
    return F.coalesce(F.date_format(F.timestamp_seconds(_c(ts)), "yyyy-MM-dd HH:mm:ss"), F.lit("?"))


def regime_label(crowd_weight) -> Column:
    w = _c(crowd_weight)
    return F.when(w < 0.25, "counting").when(w < 0.75, "blend").when(w.isNotNull(), "crowd")


def uncertainty_label(confidence) -> Column:
    """Rungs of doubt; a missing confidence reads as the widest."""
    c = _c(confidence)
    return F.when(c >= 0.7, "±0 rungs").when(c >= 0.4, "±1 rung").otherwise("±2+ rungs")


def voice_label(speech) -> Column:
    return F.when(_c(speech) >= 0.2, "speech").otherwise("quiet")


def stale_flag(staleness) -> Column:
    return F.coalesce(_c(staleness) > 30, F.lit(False))


def playback_mode(status, now_playing) -> Column:
    return (F.when((_c(status) == "active") & _c(now_playing).isNotNull(), "live")
            .when(_c(status) == "degraded", "degraded").otherwise("shadow"))
