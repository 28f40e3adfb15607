"""Curated playlist mapping: JSON map of maps to (genre, tier, playlist id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ambientspark.functions import constants as C
from ambientspark.sources import schemas as S

VERSION = 1


def explode_playlists(docs: DataFrame, doc: str) -> DataFrame:
    """Rows (…, genre, tier, mapped_id) of each mapping document; a wrong version, tier or id fails the job."""
    d = F.from_json(doc, S.PLAYLISTS)
    keep = [c for c in docs.columns if c != doc]
    checked = docs.select(*keep, d.alias("_d")).select(*keep, F.when(
        F.coalesce(F.col("_d.schema_version") == VERSION, F.lit(False)) & F.col("_d.playlists").isNotNull(), F.col("_d.playlists"))
        .otherwise(F.raise_error(F.lit(f"playlists: schema_version must be {VERSION} and playlists an object"))).alias("_m"))
    tiers = checked.select(*keep, F.explode("_m").alias("genre", "_t"))
    rows = tiers.select(*keep, "genre", F.explode("_t").alias("tier", "_id"))
    fault = F.concat(F.lit("playlists: bad tier or empty id for "), "genre", F.lit("/"), "tier")
    ok = F.col("tier").isin(*C.TIERS) & (F.coalesce("_id", F.lit("")) != "")
    return rows.select(*keep, "genre", "tier", F.when(ok, F.col("_id")).otherwise(F.raise_error(fault)).alias("mapped_id"))


def read_playlists(spark: SparkSession, path: str) -> DataFrame:
    """(genre, tier, playlist_id); a missing file maps nothing yet."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "genre string, tier string, playlist_id string")
    docs = spark.read.text(path, wholetext=True)
    return explode_playlists(docs, "value").withColumnRenamed("mapped_id", "playlist_id")
