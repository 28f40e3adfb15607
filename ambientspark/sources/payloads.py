"""Music-service payloads (JSON text) to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ambientspark.sources import schemas as S


def _artist(artists: Column) -> Column:
    names = F.transform(artists, lambda a: F.coalesce(a["name"], F.lit("")))
    return F.array_join(F.coalesce(names, F.array().cast("array<string>")), ", ")


def _seconds(ms: Column) -> Column:
    return F.coalesce(ms, F.lit(0)) / 1000.0


def flatten_now_playing(df: DataFrame, payload: str) -> DataFrame:
    """One observation per payload; without an item or uri every track column is null."""
    p = F.from_json(payload, S.PLAYER_PAYLOAD)
    out = df.withColumn("_p", p)
    loaded = F.col("_p.item.uri") != ""

    def when(c):
        return F.when(loaded, c)
    return out.select(
        *df.columns, when(F.col("_p.item.uri")).alias("track_id"), when(F.coalesce("_p.item.name", F.lit(""))).alias("title"),
        when(_artist(F.col("_p.item.artists"))).alias("artist"), when(_seconds(F.col("_p.item.duration_ms"))).alias("duration_s"),
        when(F.when(F.col("_p.context.type") == "playlist", F.col("_p.context.uri"))).alias("playlist_id"),
        when(_seconds(F.col("_p.progress_ms"))).alias("progress_s"),
        when(F.coalesce("_p.is_playing", F.lit(False))).alias("is_playing"), when(F.col("_p.device.id")).alias("device_id"))


def flatten_playlist_items(df: DataFrame, payload: str) -> DataFrame:
    """Track rows of the entries of each playlist payload; entries without a uri are left out."""
    items = F.from_json(payload, S.PLAYLIST_PAYLOAD)["items"]
    rows = df.select(*[c for c in df.columns if c != payload], F.posexplode(items).alias("pos", "_e"))
    t = F.col("_e.item")
    return rows.filter(t["uri"] != "").select(
        *[c for c in df.columns if c != payload], F.col("pos").cast("bigint").alias("pos"), t["uri"].alias("track_id"),
        F.coalesce(t["name"], F.lit("")).alias("title"), _artist(t["artists"]).alias("artist"),
        _seconds(t["duration_ms"]).alias("duration_s"))
