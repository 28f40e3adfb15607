"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: What a row counts for beside its text, so that very many empty texts are several parts too.
ROW_BYTES = 64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """The two columns that operators on documents use, whatever else the table has; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Only a local master without that setting gets a folder of its own; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def staged(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """df written to the shared folder and read again: computed once, and kept when executors are lost. zstd takes less disk for more time."""
    path = f"{shared_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_batch(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """df with step applied to each Arrow batch, inside the tasks that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return df.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column."""
    return column.cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about `most` bytes of a text column, so that what a task makes of a part stays small; a longer text is a part of its own."""
    offsets = np.asarray(pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)).cast(pa.int64()), 0)))
    at = 0
    while at < batch.num_rows:
        before = int(offsets[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(offsets, before + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def text_bytes(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """What each row of a batch counts for in parts of texts: the bytes of its text, and some for the row itself."""
    return pc.fill_null(pc.binary_length(batch.column(column)).cast(pa.int64()), 0).to_numpy() + ROW_BYTES


def regrouped(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in parts of about `most` bytes of a text column, whatever batches they come in; a longer text is a part of its own."""
    held, room = [], most
    for batch in batches:
        ends, at = np.cumsum(text_bytes(batch, column)), 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = int(np.searchsorted(ends, before + room, "right"))
            if end <= at and held:
                yield pa.concat_batches(held)
                held, room = [], most
                continue
            end = max(at + 1, end)
            held.append(batch.slice(at, end - at))
            room -= int(ends[end - 1]) - before
            at = end
    if held:
        yield pa.concat_batches(held)


@contextmanager
def arrow_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Arrow batches of about `most` bytes for what runs inside: both ends of the pipe to a Python worker hold whole batches, and 10,000 rows of texts have no bound."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def unused(name: str, columns: list[str]) -> str:
    """name, or name with underscores before it if columns has one that reads the same."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def as_rows(docs: DataFrame, *more) -> DataFrame:
    """The rows of docs as one struct column `doc`, so that no column of theirs meets one of an operator's, with further columns."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), *more)
