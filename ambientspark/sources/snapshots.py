"""Small keyed state kept between runs: track signatures and quiet anchors.

A store is a folder with one folder of JSON lines for each version and a file `_current` that names the version in force. A version is
published by renaming that file into place, in one step, once all of its own files are there; so a writer that dies
leaves the version before it in force. Versions older than the one before are removed.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ambientspark.functions import constants as C, columns as col
from ambientspark.sources import schemas as S

CURRENT, VERSION = "_current", "_v"


class _Folder:
    """The files of a store, through the file system that its path names."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.path = spark._jvm, path
        conf = spark._jsc.hadoopConfiguration()
        hadoop = self.jvm.org.apache.hadoop.fs
        self.fs, self.files = hadoop.Path(path).getFileSystem(conf), hadoop
        self.context = hadoop.FileContext.getFileContext(self.fs.getUri(), conf)
        self.overwrite = spark._sc._gateway.new_array(hadoop.Options.Rename, 1)
        self.overwrite[0] = hadoop.Options.Rename.OVERWRITE

    def at(self, name: str):
        return self.files.Path(self.path, name)

    def current(self) -> str | None:
        if not self.fs.exists(self.at(CURRENT)):
            return None
        stream = self.fs.open(self.at(CURRENT))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
        finally:
            stream.close()

    def publish(self, name: str) -> None:
        draft = self.at(f"{CURRENT}-{uuid4().hex}")
        stream = self.fs.create(draft, True)
        stream.write(bytearray(name.encode()))
        stream.close()
        self.context.rename(draft, self.at(CURRENT), self.overwrite)

    def drop_versions(self, keep: set[str]) -> None:
        for status in self.fs.listStatus(self.files.Path(self.path)):
            name = status.getPath().getName()
            if name.startswith(VERSION) and name not in keep:
                self.fs.delete(status.getPath(), True)


def _publish(df: DataFrame, path: str) -> None:
    """df as the version in force; it may have been read from the same path."""
    folder = _Folder(df.sparkSession, path)
    before, name = folder.current(), f"{VERSION}{uuid4().hex}"
    df.write.json(f"{path}/{name}")
    folder.publish(name)
    folder.drop_versions({name, before})


def _in_force(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Records of the version in force, or of the files of a folder from before there were versions. Missing or corrupt files are empty."""
    name = _Folder(spark, path).current()
    try:
        raw = spark.read.schema(schema).json(path if name is None else f"{path}/{name}")
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return raw.filter(F.col(key).isNotNull())


def write_signatures(df: DataFrame, path: str) -> None:
    """A new version of the snapshot; values rounded to 4 decimals."""
    values = ("valence", "arousal", "pull_valence", "pull_arousal")
    _publish(df.withColumns({c: col.round_even(c, 4) for c in values}), path)


def read_signatures(spark: SparkSession, path: str) -> DataFrame:
    """The newest snapshot, older files without pull columns included; a missing or corrupt one is empty."""
    zero = {"pull_valence": F.lit(0.0), "pull_arousal": F.lit(0.0), "pull_refs": F.lit(0)}
    return _in_force(spark, path, S.SIGNATURE, "track_id").withColumns({c: F.coalesce(c, z) for c, z in zero.items()})


def write_anchors(df: DataFrame, path: str) -> None:
    _publish(df.select("room_id", col.round_even("anchor_dbfs", 1).alias("anchor_dbfs"), "ts"), path)


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    return _in_force(spark, path, S.ANCHOR, "room_id")


def usable_anchor(anchor: Column, ts: Column, now: Column, max_age_s: float = C.ANCHOR_MAX_AGE_S) -> Column:
    """A restored anchor seeds a session only while 0 <= age <= max_age_s."""
    return F.when((now - ts).between(0, max_age_s), anchor)
