"""Registered queries that run as streams: the stored views, read as a stream until they are used up."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from ambientspark.functions import constants as C
from ambientspark.operators import labels, slabs
from ambientspark.plans import queries_rooms as R, queries_ticks as T, views as V
from ambientspark.streaming import processors as P, streams
from ambientspark.streaming.ordered import fold_in_order, fold_stream


#: A stored view is streamed in so many files, one for each micro-batch.
FILES = 4
DELAY_S = 20.0


def streamed(spark: SparkSession, view: DataFrame, build: Callable[[DataFrame], DataFrame], arrival=None, close: str | None = None, after: DataFrame | None = None) -> DataFrame:
    """What build makes of the view's rows as a stream, which come in FILES micro-batches in order of `arrival` (the time t, if not given).

    With `close`, a column of keys, a row of key -1 an hour later comes next, so that the watermark passes all others; then come the rows of `after`. The query
    is stopped and started again from its checkpoint for each of these, so state is always read back. Source, checkpoints and result lie in the shared folder.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", P.ROCKSDB)
    base = f"{slabs.shared_dir(spark)}/stream-{uuid4().hex}"
    marked = view.withColumn("_at", (F.col("t") if arrival is None else arrival).cast("double"))
    marked.write.parquet(f"{base}/view")
    stored = spark.read.schema(marked.schema).parquet(f"{base}/view")
    cuts = stored.select(F.percentile_approx("_at", [k / FILES for k in range(1, FILES)]).alias("cuts"), F.max("t").alias("end")).first()
    parts, low = [], None
    for high in [*(cuts["cuts"] or []), None]:
        inside = (F.lit(True) if low is None else F.col("_at") > low) & (F.lit(True) if high is None else F.col("_at") <= high)
        parts.append(stored.filter(inside).drop("_at"))
        low = high
    if close:
        last = {close: F.lit(-1), "t": F.lit((cuts["end"] or 0.0) + 3600.0)}
        parts.append(spark.range(1).select(*[last.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in view.schema.fields]))
    for part in [*parts, *([] if after is None else [after])]:
        part.write.mode("append").parquet(f"{base}/source")
        live = build(spark.readStream.schema(view.schema).parquet(f"{base}/source"))
        (live.writeStream.foreachBatch(streams.append_once(f"{base}/out")).option("checkpointLocation", f"{base}/checkpoint")
         .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(live.schema).parquet(f"{base}/out/*")


def _folded(spark, view, fold, order=("t", "frame_id")) -> DataFrame:
    return streamed(spark, view, lambda live: fold_stream(live, fold, order=order))


def _reordered(spark, view, fold, ident: str, order=("t", "frame_id")) -> DataFrame:
    """The same on rows that arrive up to DELAY_S late, each by its own delay."""
    arrival = F.col("t") + F.pmod(F.xxhash64(ident), F.lit(1000)) * (0.9 * DELAY_S / 1000)
    return streamed(spark, view, lambda live: fold_in_order(live, fold, DELAY_S, order=order), arrival, "room_id").filter("room_id >= 0")


def stream_smoothing(spark, sf):
    f = T._ticks(spark, sf, "loudness_raw", "activity_raw", "speech_raw")
    df = _folded(spark, f, P.SMOOTHING_FOLD)
    return T._r(df.select("frame_id", "loudness", "activity", "speech"), "loudness", "activity", "speech")


def stream_noise_floor(spark, sf):
    f = T._ticks(spark, sf, "loudness_raw", "activity_raw", "speech_raw")
    return T._r(_folded(spark, f, P.SMOOTHING_FOLD).select("frame_id", "floor"), "floor")


def stream_hysteresis(spark, sf):
    f = T._ticks(spark, sf, F.floor(F.col("log2_est") / 6).alias("candidate"))
    return _folded(spark, f, P.HYSTERESIS_FOLD).select("frame_id", "published")


def stream_dwell(spark, sf):
    f = T._ticks(spark, sf, F.when(F.col("v_raw") > 0.9, "high").otherwise("low").alias("sig"))
    return _folded(spark, f, P.DWELL_FOLD.with_step(_dwell)).select("room_id", "frame_id", "sig")


def _dwell(state, row):
    return P.dwell_step(state, row, 9.0)


def stream_throttle(spark, sf):
    f = V.frames(spark, sf).filter(F.col("speech_raw") >= C.MIN_SPEECH_RATIO).select("room_id", "t", "frame_id")
    return _folded(spark, f, P.THROTTLE_FOLD.with_step(_throttle)).select("room_id", "frame_id")


def _throttle(state, row):
    return P.throttle_step(state, row, 8.0)


def _evidence_stream(spark, sf):
    f = V.evidence(spark, sf).select("room_id", F.col("evidence_id").alias("frame_id"), F.col("at").alias("t"), "duration_s", "embedding")
    return _reordered(spark, f, P.EVIDENCE_FOLD, "frame_id")


def stream_evidence(spark, sf):
    """The buffer of each room after each piece of evidence, which arrives out of order."""
    df = _evidence_stream(spark, sf).filter("not timed_out")
    return df.select("frame_id", "evidence_s", "segments")


def stream_headcount(spark, sf):
    """How the same buffers cluster: what `headcount_estimate` counts."""
    df = _evidence_stream(spark, sf).filter("not timed_out")
    return T._r(df.select("frame_id", "raw_clusters", "fragmentation", "separation", "dispersion"), "fragmentation", "separation", "dispersion")


def stream_evidence_timeouts(spark, sf):
    """What is left of each buffer when its oldest evidence times out, also in silence."""
    return _evidence_stream(spark, sf).filter("timed_out").select("room_id", "t", "segments", "evidence_s")


def _room_ticks(spark, sf):
    """Ticks of which two in three bring a reading; while music plays, a pull to take away."""
    pulls = [f"CASE WHEN playback_active THEN (frame_id % {n} - {n // 2}) / {n}.0D END AS pull_{x}" for n, x in ((7, "v"), (5, "a"))]
    readings = [f"CASE WHEN frame_id % 3 <> 0 THEN {c} END AS {c}" for c in ("v_raw", "a_raw")]
    return V.frames(spark, sf).selectExpr("room_id", "t", "frame_id", "loudness_raw", "activity_raw", "speech_raw", *readings, *pulls, "0.5D AS scale")


def stream_room(spark, sf):
    """Smoothed levels, corrected and averaged emotion, energy and trend of ticks that arrive out of order."""
    df = _reordered(spark, _room_ticks(spark, sf), P.ROOM_FOLD, "frame_id")
    numbers = ("loudness", "activity", "speech", "floor", "valence", "arousal", "energy")
    return T._r(df.select("frame_id", *numbers, "trend"), *numbers)


def stream_late(spark, sf):
    """Every hundredth tick arrives when all others have: those that their room is past come out marked and numbered and change nothing."""
    f = V.frames(spark, sf).select("room_id", "t", "frame_id", F.floor(F.col("log2_est") / 6).alias("candidate"))
    fold = lambda live: fold_in_order(live, P.HYSTERESIS_FOLD, 1.0, 7200.0, late=True)
    df = streamed(spark, f.filter("frame_id % 100 <> 0"), fold, close="room_id", after=f.filter("frame_id % 100 = 0")).filter("room_id >= 0")
    return df.groupBy("room_id").agg(F.count_if("late").alias("late"), F.coalesce(F.max("late_rows"), F.lit(0)).alias("counted"), F.count_if(~F.col("late")).alias("in_order"))


def stream_held_bucket(spark, sf):
    """Silent ticks hold the last bucket of their room while its age grows."""
    f = T._ticks(spark, sf, F.when(F.col("speech_raw") >= 0.5, F.floor(F.col("log2_est")).cast("string")).alias("bucket"))
    df = _folded(spark, f, P.HELD_BUCKET_FOLD).select("frame_id", "bucket", "headcount_staleness_s")
    return T._r(df, "headcount_staleness_s")


SLOT_GAP_S = 4.0


def _slot(state, row):
    return P.slot_step(state, row, SLOT_GAP_S)


def stream_latest_wins(spark, sf):
    """Speech and reference windows offered to one model, which takes one at every third tick."""
    kind = "CASE WHEN frame_id % 3 = 0 THEN 'take' WHEN speech_raw >= 0.3D THEN 'speech' ELSE 'reference' END AS kind"
    f = V.frames(spark, sf).selectExpr("room_id", "t", "frame_id", kind)
    return T._r(_folded(spark, f, P.SLOT_FOLD.with_step(_slot)).select("frame_id", "window_id", "window_kind", "age_s"), "age_s")


def stream_tap_age(spark, sf):
    """Records joined with the last human tap of their room, which alone is kept."""
    taps = labels.tap_times(V.annotations(spark, sf), V.overrides(spark, sf))
    rows = V.overrides(spark, sf).select("room_id", F.col("ts").alias("t"), F.lit(1).alias("rank"), "rec_id", F.lit("record").alias("kind")).unionByName(
        taps.select("room_id", F.col("tap_ts").alias("t"), F.lit(0).alias("rank"), F.lit(-1).cast("bigint").alias("rec_id"), F.lit("tap").alias("kind")))
    return _folded(spark, rows, P.TAP_FOLD, ("t", "rank", "rec_id")).select("rec_id", "tap_age_s")


def stream_completions(spark, sf):
    """Polls, picks and vetoes in one stream: at equal times picks and vetoes come before polls."""
    none = F.lit(None).cast("double")
    obs = R._obs(spark, sf).select("room_id", "t", F.lit(2).alias("rank"), "obs_id", F.lit("poll").alias("kind"), F.col("track_id").cast("string"),
                                   F.col("progress_s").cast("double").alias("progress_s"), F.col("duration_s").cast("double").alias("duration_s"))

    def marks(df, ident, kind, rank):
        return df.select("room_id", "t", F.lit(rank).alias("rank"), F.col(ident).alias("obs_id"), F.lit(kind).alias("kind"),
                         F.col("track_id").cast("string"), none.alias("progress_s"), none.alias("duration_s"))

    rows = obs.unionByName(marks(V.selections(spark, sf), "pick_id", "pick", 0)).unionByName(marks(V.track_vetoes(spark, sf), "veto_id", "veto", 1))
    df = _folded(spark, rows, P.COMPLETION_FOLD.with_step(_completion), ("t", "rank", "obs_id"))
    return df.select("obs_id", "room_id", F.col("track_id").alias("prev_track_id"))


def _completion(state, row):
    return P.completion_step(state, row, R.LEAD_S)


def stream_sliding(spark, sf):
    """Windows of 5 s every 2 s over watermarked chunks; every level is read as a chunk of that power."""
    f = V.frames(spark, sf).select("room_id", "t", F.col("speech_raw").alias("prob"), F.lit(0.01).alias("power"))
    df = streamed(spark, f, lambda live: streams.sliding_features(streams.with_event_time(live)), close="room_id")
    out = df.filter("room_id >= 0").select("room_id", F.unix_micros("window_end").alias("window_end_us"), "chunks", F.round("speech_ratio", 6).alias("speech_ratio"))
    return out


QUERIES = {f.__name__: f for f in (
    stream_smoothing, stream_noise_floor, stream_hysteresis, stream_dwell, stream_throttle, stream_evidence, stream_headcount, stream_evidence_timeouts, stream_room,
    stream_late, stream_held_bucket, stream_latest_wins, stream_tap_age, stream_completions, stream_sliding)}
