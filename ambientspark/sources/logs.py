"""Append-only JSON-lines logs: states, verdicts, overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ambientspark.sources import schemas as S

CORRUPT = "_corrupt"
REJECT = "value STRING, file STRING, fault STRING"


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejected lines with their file and fault). Blank lines and bad lines never fail the read.

    A file that several paths name is read once. Every JSON object is a record: a field of another type than the
    schema's reads as null, and its line is among the rejected ones too, with fault `field`. Lines that are
    no JSON object are rejected with fault `line`."""
    files = sorted(set(spark.read.text(paths).inputFiles()))
    if not files:
        return spark.createDataFrame([], schema), spark.createDataFrame([], REJECT)
    lines = spark.read.text(files).select("value", F.col("_metadata.file_path").alias("file")).filter(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = lines.withColumns({"_r": F.from_json("value", f"{schema}, {CORRUPT} STRING", options),
                                "_object": F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))})
    fault = F.when(~F.col("_object"), "line").when(F.col(f"_r.{CORRUPT}").isNotNull(), "field")
    return (parsed.filter("_object").select("_r.*").drop(CORRUPT),
            parsed.withColumn("fault", fault).filter(F.col("fault").isNotNull()).select("value", "file", "fault"))


def read_annotations(spark, paths) -> tuple[DataFrame, DataFrame]:
    """(records, rejected lines)."""
    return read_jsonl(spark, paths, S.ANNOTATION)


def read_overrides(spark, paths) -> tuple[DataFrame, DataFrame]:
    """(records, rejected lines); versions 1 and 2 in one scan, what version 1 lacks reads as null."""
    return read_jsonl(spark, paths, S.OVERRIDE)


def read_states(spark, paths) -> tuple[DataFrame, DataFrame]:
    """(records, rejected lines)."""
    return read_jsonl(spark, paths, S.ROOM_STATE)


def stream_states(spark, path, max_files: int = 100) -> DataFrame:
    """Live record feed from a folder of JSON lines."""
    return spark.readStream.schema(S.ROOM_STATE).option("maxFilesPerTrigger", max_files).json(path)


def write_states(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def write_daily(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Append, one partition folder per day of `ts` in the session time zone; a large day is split among writers by its size."""
    day = F.to_date(F.timestamp_seconds(ts)).cast("string")
    df.withColumn("day", day).hint("rebalance", "day").write.partitionBy("day").mode("append").json(path)


def _cuts():
    snap = "recommendation.boundaries_snapshot"
    return [F.col(f"{snap}.{c}").alias(c) for c in ("valence_low", "valence_high", "arousal_low", "arousal_high")]


def flatten_annotations(df: DataFrame) -> DataFrame:
    """The flat columns the report operators take."""
    return df.select("room_id", "ts", "verdict", F.col("state.valence").alias("valence"), F.col("state.arousal").alias("arousal"),
                     *_cuts(), F.col("recommendation.matched_cell").alias("cell"))


def flatten_overrides(df: DataFrame) -> DataFrame:
    return df.select(
        "room_id", "ts", "action", F.col("now_playing.track.duration_s").alias("duration_s"),
        *[F.col(f"state.{c}").alias(c) for c in ("headcount_staleness_s", "emotion_staleness_s", "speech_ratio",
                                                  "playback_active", "loudness_dbfs", "valence", "arousal")],
        *_cuts(), F.col("recommendation.matched_cell").alias("cell"),
        *[F.col(f"recommendation.{c}").alias(c) for c in ("source", "target_arousal", "energy_action")],
        F.col("chosen.tier").alias("chosen_tier"), F.col("now_playing.track.genre").alias("genre"),
        F.col("now_playing.track.title").alias("title"),
        F.col("presence.occupied").alias("stamped_occupied"), F.col("presence.basis").alias("stamped_basis"))
