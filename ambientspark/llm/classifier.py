"""Quality classifier: votes of the nearest labelled documents in a latent semantic space."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ambientspark.llm.common import as_bytes, id_text, per_batch

#: At most so many labelled documents are kept as neighbours and fitted on: those of the smallest id hashes.
LABELLED = 4000
WORD_TERMS = 768
SHAPE_TERMS = 512
TERMS = WORD_TERMS + SHAPE_TERMS
DIMENSIONS = 48
NEIGHBOURS = 25
#: Similarities count by this power, so that close neighbours outweigh far ones.
SHARPNESS = 8
BLOCK = 2048

#: Letters by case, digits, others as they are; bytes outside ASCII count as lower-case letters.
SHAPE = bytes(ord("A") if chr(c).isupper() and c < 128 else ord("a") if c >= 128 or chr(c).islower() else ord("0") if chr(c).isdigit() else c for c in range(256))


class _Terms(dict):
    """Shape of a word -> number of its term; runs of the same sign count once."""

    def __missing__(self, shape: bytes) -> int:
        runs = bytes(c for i, c in enumerate(shape) if not i or c != shape[i - 1])
        number = WORD_TERMS + zlib.crc32(runs[:12] + bytes([min(len(shape).bit_length(), 8)])) % SHAPE_TERMS
        if len(self) < 100_000 and len(shape) < 64:
            self[shape] = number
        return number


_SHAPES = _Terms()


def term_counts(text: bytes) -> np.ndarray:
    """Hashed counts of a whole text: its words, the shapes of its words, and words that repeat the one before."""
    words = text.lower().split()
    if not words:
        return np.zeros(TERMS, dtype=np.float32)
    n = len(words)
    hashes = np.fromiter(map(zlib.crc32, words), np.uint32, n)
    counts = np.bincount(hashes % WORD_TERMS, minlength=TERMS)
    counts += np.bincount(np.fromiter(map(_SHAPES.__getitem__, text.translate(SHAPE).split()), np.int64, n), minlength=TERMS)
    repeats = int((hashes[1:] == hashes[:-1]).sum())
    if repeats:
        counts[WORD_TERMS + zlib.crc32(b"repeat") % SHAPE_TERMS] += repeats
    return counts.astype(np.float32)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Dampened term frequencies by idf, rows of length 1 (0 for empty texts)."""
    values = np.log1p(counts) * idf
    return values / np.maximum(np.linalg.norm(values, axis=1, keepdims=True), 1e-12)


def nearest(similar: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest of each row, in order of column; of equal ones at the limit the first columns."""
    last = -np.partition(-similar, k - 1, axis=1)[:, k - 1 : k]
    above, equal = similar > last, similar == last
    room = k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | (equal & (np.cumsum(equal, axis=1) <= room)))[1].reshape(-1, k)


@dataclass
class Neighbours:
    """The labelled vectors and what maps a text to the same space; at most LABELLED rows, a few MB."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def place(self, counts: np.ndarray) -> np.ndarray:
        got = weighted(counts, self.idf) @ self.axes
        return got / np.maximum(np.linalg.norm(got, axis=1, keepdims=True), 1e-12)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Share of label 1 among the nearest, weighted by similarity; of all labels where nothing is similar.

        Of equally similar ones at the limit those of the smallest ids are taken. Labels count inversely to how often they occur, so that the rarer one is not outvoted by numbers alone.
        """
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        out = np.full(len(texts), prior)
        rarity = np.where(self.labels > 0, 1 / max(prior, 1e-9), 1 / max(1 - prior, 1e-9))
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(texts) if k else 0, BLOCK):
            similar = self.place(np.stack([term_counts(t) for t in texts[at : at + BLOCK]])) @ self.vectors.T
            near = nearest(similar, k)
            weight = np.maximum(np.take_along_axis(similar, near, axis=1), 0).astype(np.float64) ** SHARPNESS * rarity[near]
            total = weight.sum(axis=1)
            vote = (weight * self.labels[near]).sum(axis=1)
            out[at : at + BLOCK] = np.where(total > 1e-9, vote / np.maximum(total, 1e-9), prior)
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", most: int = LABELLED) -> Neighbours:
    """Fits on at most `most` labelled rows outside the held-out fifth; this bounded sample alone reaches the driver.

    Rows without id or label are left out; of repeated labels of a document the smallest counts. Without labelled rows every score is 0.5.
    """
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(target).cast("int").alias("label"))
    known = known.where(~is_held_out("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = id_text(docs).join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = [term_counts(t).tobytes() for t in as_bytes(batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(counts, pa.binary())], names=["doc_id", "label", "counts"])

    rows = per_batch(sample.select("doc_id", "label", "text"), step, "doc_id long, label int, counts binary").orderBy("doc_id").collect()
    counts = np.stack([np.frombuffer(r.counts, np.float32) for r in rows]) if rows else np.zeros((0, TERMS), np.float32)
    idf = np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    values = weighted(counts, idf)
    _, axes = np.linalg.eigh((values.T @ values).astype(np.float64))
    axes = axes[:, ::-1][:, :DIMENSIONS].astype(np.float32)
    found = Neighbours(idf, axes, np.zeros((0, DIMENSIONS), np.float32), np.array([r.label for r in rows], np.float32))
    found.vectors = found.place(counts) if rows else found.vectors
    return found


def is_held_out(column: str):
    """Whether crc32 of the id as text leaves 0 divided by 5; ids that are null are not."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, model: Neighbours, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs; the exact cosine of each text to every labelled vector, in blocks.

    The model is broadcast: its size is bounded by the labelled rows it was fitted on. Null texts are empty; empty
    texts get the share of label 1. Repeated rows and null ids are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.scores(as_bytes(batch.column("text"))))], names=["doc_id", "score"])

    scored = per_batch(id_text(docs), step, "doc_id long, score double")
    return scored.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
