"""Streams without custom state: sliding windows, late rows, label joins, sinks."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ambientspark.functions import constants as C

log = logging.getLogger(__name__)


def with_event_time(df: DataFrame, t: str = "t", delay: str = "30 seconds") -> DataFrame:
    """Adds `ts` from the seconds column and watermarks it; rows later than the delay are dropped
    by the engine and show up in the query progress as numRowsDroppedByWatermark."""
    return df.withColumn("ts", F.timestamp_seconds(t)).withWatermark("ts", delay)


def drop_repeats(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key within the watermark delay."""
    return df.dropDuplicatesWithinWatermark(keys)


def sliding_features(chunks: DataFrame, window_s: float = C.WINDOW_S, hop_s: float = C.HOP_S,
                     threshold: float = C.CERT_THRESHOLD) -> DataFrame:
    """Speech share and level per room and sliding window; chunks carry ts (watermarked), prob, power.

    Partial sums are combined before the shuffle, so a busy room costs one row per task and window."""
    w = F.window("ts", f"{int(window_s * 1000)} milliseconds", f"{int(hop_s * 1000)} milliseconds")
    sums = chunks.groupBy("room_id", w.alias("w")).agg(
        F.count("*").alias("chunks"), F.avg((F.col("prob") >= threshold).cast("double")).alias("speech_ratio"),
        F.avg("power").alias("power"))
    level = F.greatest(20.0 * F.log10(F.greatest(F.sqrt("power"), F.lit(1e-10))), F.lit(-120.0))
    return sums.select("room_id", F.col("w.end").alias("window_end"), "chunks", "speech_ratio", level.alias("rms_dbfs"))


def completions_with_taps(completions: DataFrame, taps: DataFrame) -> DataFrame:
    """Stream-stream join: completions with the human taps inside their play window.

    Both sides are watermarked on `ts` / `tap_ts`; a completion without taps is emitted once
    the watermark passes it."""
    c, t = completions.alias("c"), taps.alias("t")
    inside = ((F.col("c.room_id") == F.col("t.room_id")) & (F.col("t.tap_ts") <= F.col("c.ts"))
              & (F.col("t.tap_ts") >= F.col("c.started_at")))
    return c.join(t, inside, "leftOuter").select("c.*", F.col("t.tap_ts"))


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: each micro-batch owns one partition folder, so a replayed batch overwrites itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def fan_out(*consumers: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """foreachBatch over several consumers; one that fails is logged and does not stop the rest."""
    def publish(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            for consume in consumers:
                try:
                    consume(held, batch_id)
                except Exception:
                    log.exception("consumer %r failed on batch %s", consume, batch_id)
        finally:
            held.unpersist()
    return publish
