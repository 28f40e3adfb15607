"""Music-aware emotion: clean baseline, measured pull per track, correction of held readings.

Ticks carry the raw window (playback, track, high-band share, raw speech ratio) and the held
reading (`at`, valence, arousal, confidence, staleness) that `asof_reading` attaches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ambientspark.functions import constants as C, columns as col
from ambientspark.operators.slabs import lagged, running, stage
from ambientspark.operators.smoothing import ema, running_signature

ROOM, ORDER = ["room_id"], ["t", "frame_id"]


def reference_taps(ticks: DataFrame, has_audio: str | None = None) -> DataFrame:
    """Music-only windows that measure a track's standalone response."""
    taps = ticks.filter(F.col("playback_active") & F.col("track_id").isNotNull()
                        & (F.col("speech_raw") <= C.REF_MAX_SPEECH) & (F.col("speech_raw") < C.MIN_SPEECH_RATIO))
    return taps if has_audio is None else taps.filter(F.col(has_audio))


def bankable(ticks: DataFrame, slab_s: float,
             max_staleness: float = C.EMOTION_INTERVAL_S + C.HOP_S) -> DataFrame:
    """Marks the one tick on which a reading counts as evidence: the first that holds it, while fresh."""
    ticks = running(ticks, ROOM, ORDER, slab_s, _prev_at=lagged(F.col("at")))
    new = F.col("at").isNotNull() & ~F.col("at").eqNullSafe(F.col("_prev_at"))
    return ticks.withColumn("banked", new & (F.col("staleness_s") <= max_staleness)).drop("_prev_at")


def clean_baseline(ticks: DataFrame, slab_s: float) -> DataFrame:
    """The room without music: an average over banked readings taken with playback off or
    hardly dominant. Adds base_valence / base_arousal, null once older than the age limit."""
    clean = F.col("banked") & (~F.col("playback_active") | F.coalesce(F.col("m") <= C.BASELINE_MAX_M, F.lit(False)))
    ticks = ticks.withColumn("clean", F.coalesce(clean, F.lit(False)))
    ticks = ema(ticks, ROOM, ORDER, slab_s, C.TAU_BASELINE_S, where=F.col("clean"), fed_at="_clean_at",
                base_valence=F.col("valence"), base_arousal=F.col("arousal"))
    fresh = F.col("t") - F.col("_clean_at") <= C.BASELINE_MAX_AGE_S
    return ticks.withColumns({c: F.when(fresh, F.col(c)) for c in ("base_valence", "base_arousal")}).drop("_clean_at")


def pull_samples(ticks: DataFrame) -> DataFrame:
    """Adds pull_v / pull_a on ticks that measure how far the playing track drags the reading."""
    usable = (F.col("banked") & ~F.col("clean") & F.col("track_id").isNotNull() & (F.col("m") >= C.PULL_MIN_M)
              & F.col("base_valence").isNotNull())
    return ticks.withColumns({
        "pull_v": F.when(usable, (F.col("valence") - F.col("base_valence")) / F.col("m")),
        "pull_a": F.when(usable, (F.col("arousal") - F.col("base_arousal")) / F.col("m"))})


def track_signatures(ticks: DataFrame, slab_s: float) -> DataFrame:
    """Every tick with a track gains that track's signature as it stands after the tick's own
    samples: refs, sig_valence, sig_arousal, pull_refs, pull_valence, pull_arousal.

    Keyed by track across rooms; a popular track's history is split into slabs like a room's."""
    on = ticks.filter("track_id IS NOT NULL")
    off = ticks.filter("track_id IS NULL")
    on = running_signature(on, ["track_id"], ORDER, slab_s, "refs", F.col("ref_v").isNotNull(),
                           sig_valence=F.col("ref_v"), sig_arousal=F.col("ref_a"))
    on = stage(on)
    on = running_signature(on, ["track_id"], ORDER, slab_s, "pull_refs", F.col("pull_v").isNotNull(),
                           pull_valence=F.col("pull_v"), pull_arousal=F.col("pull_a"))
    return on.unionByName(off, allowMissingColumns=True)


def signature_lookup(ticks: DataFrame, trusted: bool = False, min_refs: int = C.MIN_REFS) -> DataFrame:
    """Signature columns of `track_signatures`, optionally only once enough references exist."""
    if not trusted:
        return ticks
    return ticks.withColumns({c: F.when(F.col("refs") >= min_refs, F.col(c)) for c in ("sig_valence", "sig_arousal")})


def corrected_emotion(ticks: DataFrame) -> DataFrame:
    """Subtracts the usable basis from the held reading, or discounts its confidence.

    Adds v_inst, a_inst, emotion_confidence and the correction's parts (dv, da, basis, basis_refs)."""
    basis = col.correction_basis("m", "refs", "sig_valence", "sig_arousal",
                                 "pull_refs", "pull_valence", "pull_arousal")
    held = F.col("at").isNotNull()
    ticks = ticks.withColumn("_b", F.when(held, basis))
    fix = col.apply_correction("valence", "arousal", "_b.valence", "_b.arousal", "m", "_b.scale_v", "_b.scale_a")
    ticks = ticks.withColumn("_fix", F.when(F.col("_b").isNotNull(), fix))
    return ticks.select(
        *[c for c in ticks.columns if c not in ("_b", "_fix")],
        F.coalesce("_fix.valence", "valence").alias("v_inst"), F.coalesce("_fix.arousal", "arousal").alias("a_inst"),
        F.col("_fix.dv").alias("dv"), F.col("_fix.da").alias("da"),
        F.col("_b.basis").alias("basis"), F.col("_b.refs").alias("basis_refs"),
        col.confidence_discount("confidence", "m", F.col("_b")).alias("emotion_confidence"))


def music_correction(ticks: DataFrame, room_slab_s: float, track_slab_s: float, used: tuple[str, ...] = ()) -> DataFrame:
    """All of the above in the order that matters: bank, measure, then correct on the same tick.

    Columns in `used`, and what banking and measuring add, are left out once the samples are taken: they need not travel through the shuffles by track."""
    ticks = ticks.withColumn("m", col.music_dominance("high_share", "playback_active"))
    ticks = pull_samples(clean_baseline(bankable(ticks, room_slab_s), room_slab_s))
    tap = (F.col("playback_active") & F.col("track_id").isNotNull() & (F.col("speech_raw") <= C.REF_MAX_SPEECH))
    ticks = ticks.withColumns({"ref_v": F.when(tap, F.col("v_raw")), "ref_a": F.when(tap, F.col("a_raw"))})
    ticks = ticks.drop("banked", "clean", "base_valence", "base_arousal", *used)
    return corrected_emotion(track_signatures(stage(ticks), track_slab_s))


def sample_and_hold_ema(ticks: DataFrame, slab_s: float, tau_s: float = C.TAU_EMOTION_S,
                        v: str = "v_inst", a: str = "a_inst") -> DataFrame:
    """Valence / arousal averages that advance on every tick with the reading held at that tick."""
    return ema(ticks, ROOM, ORDER, slab_s, tau_s, valence_ema=F.col(v), arousal_ema=F.col(a))


def signature_stats(signatures: DataFrame, min_refs: int = C.MIN_REFS) -> DataFrame:
    """Coverage of the signature store: how many tracks carry (trusted) references and pull."""
    return signatures.agg(
        F.count("*").alias("tracks"), F.count_if(F.col("refs") > 0).alias("with_refs"),
        F.count_if(F.col("refs") >= min_refs).alias("trusted"), F.count_if(F.col("pull_refs") > 0).alias("with_pull"),
        F.count_if(F.col("pull_refs") >= min_refs).alias("pull_trusted"),
        F.sum("refs").alias("refs"), F.sum("pull_refs").alias("pull_refs"))


def latest_signatures(ticks: DataFrame) -> DataFrame:
    """The store's contents after the last tick of each track."""
    cols = ["refs", "sig_valence", "sig_arousal", "pull_refs", "pull_valence", "pull_arousal"]
    last = F.max_by(F.struct(*cols), F.struct(*ORDER)).alias("_s")
    return ticks.filter("track_id IS NOT NULL").groupBy("track_id").agg(last).select("track_id", "_s.*")
