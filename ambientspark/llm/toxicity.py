"""Toxicity by compression distance: windows of a text are compressed with an ordinary and with a toxic zstandard dictionary."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from ambientspark.llm.common import as_bytes, id_text, per_batch, slices, staged

#: At most so many labelled texts of either label are learned from: those of the smallest id hashes.
LABELLED = 5000
#: Bytes of a window, which goes on to the next space.
WINDOW = 96
#: Windows that the ordinary dictionary is trained on at most, and the bytes of both dictionaries.
TRAINED_ON = 30_000
ORDINARY_BYTES = 16_384
TOXIC_BYTES = 8192
#: Dictionaries are made to cover strings of so many bytes; it is also the shortest match of the compression.
STRING = 5
#: A string speaks for toxic texts if at least this share of them holds it, and this many times the share of ordinary texts.
SHARE = 0.02
CONTRAST = 8
#: Margins (bytes saved by the toxic dictionary) above this one count as it.
MOST_MARGIN = 20

#: Letters in lower case; other ASCII signs are spaces; bytes of other letters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def folded(text: bytes) -> bytes:
    """Words alone, each between single spaces; empty if there are none."""
    words = b" ".join(text.translate(FOLD).split())
    return b" " + words + b" " if words else b""


def windows(words: bytes) -> Iterator[bytes]:
    """A folded text in consecutive windows of at least WINDOW bytes (the last may be shorter), cut at spaces, so that no word is split."""
    at, last = 0, len(words) - 1
    while at < last:
        end = words.find(b" ", at + WINDOW)
        end = last if end < 0 else end
        yield words[at : end + 1]
        at = end


def strings(words: bytes) -> np.ndarray:
    """The different strings of STRING bytes in the words of a folded text, as numbers; they may begin or end with the space beside a word."""
    raw = np.frombuffer(words, np.uint8).astype(np.int64)
    if len(raw) < STRING:
        return np.zeros(0, np.int64)
    n = len(raw) - STRING + 1
    key = np.zeros(n, np.int64)
    for k in range(STRING):
        key = key << 8 | raw[k : k + n]
    space = np.concatenate([[0], np.cumsum(raw == 32)])
    return np.unique(key[space[STRING - 1 :][:n] == space[1:][:n]])


@lru_cache(maxsize=4)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    made = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=16, chain_log=16, search_log=5, min_match=STRING, strategy=zstandard.STRATEGY_LAZY,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=made)


@dataclass
class Distance:
    """Both dictionaries and what their margins mean; some 40 kB, whatever was fitted on."""

    ordinary: bytes
    toxic: bytes
    evidence: np.ndarray  # by margin 0..MOST_MARGIN, log ratio of windows of toxic to those of ordinary texts
    per_window: float  # what each window takes from the evidence of its text
    threshold: float

    def margins(self, words: bytes) -> np.ndarray:
        """By how many bytes the toxic dictionary beats the ordinary one in each window.

        The toxic dictionary is the ordinary one behind what toxic texts alone say, so it wins only by the latter. Each window is followed by
        a phrase that both know: a block that does not shrink would be stored as it is, and small gains would not show.
        """
        a, b = _compressor(self.ordinary).compress, _compressor(self.toxic).compress
        phrase = self.ordinary[-400:-336]
        return np.fromiter((len(a(w + phrase)) - len(b(w + phrase)) for w in windows(words)), np.int64)

    def evidence_of(self, margins: np.ndarray) -> float:
        return float(self.evidence[np.clip(margins, 0, MOST_MARGIN)].sum()) + len(margins) * self.per_window

    def score(self, text: bytes, predicted_from: float = 0.7) -> float:
        """0 to 1; `predicted_from` where the evidence meets the threshold."""
        over = self.evidence_of(self.margins(folded(text))) - self.threshold + np.log(predicted_from / (1 - predicted_from))
        return float(1 / (1 + np.exp(-np.clip(over, -30, 30))))


def toxic_content(weights: dict[bytes, float], words: list[bytes], most: int = TOXIC_BYTES) -> bytes:
    """Parts of words that cover the weighted strings, the heaviest strings first, up to `most` bytes.

    A string is covered by the first word that holds it, cut down to the stretches that weighted strings cover; the rest of the word says nothing.
    """
    content = b""
    for string in sorted(weights, key=lambda s: (-weights[s], s)):
        if string not in content:
            word = next((w for w in words if string in w), string)
            covered = np.zeros(len(word), dtype=bool)
            for k in range(len(word) - STRING + 1):
                covered[k : k + STRING] |= word[k : k + STRING] in weights
            part = b"".join(word[k : k + 1] if c else b"\n" for k, c in enumerate(covered)).strip(b"\n") + b"\n"
            if len(content) + len(part) <= most:
                content += part
    return content


def ordinary_content(samples: list[bytes], size: int = ORDINARY_BYTES) -> bytes:
    """A dictionary trained on windows; where they are too few to train on, the windows themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=32, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def is_held_out(column: str) -> Column:
    """Whether crc32 of the id as text leaves 1 divided by 3; ids that are null are not."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, target: str, most: int) -> DataFrame:
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(target).cast("int").alias("label"))
    known = known.where(~is_held_out("doc_id"))
    taken = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (0, 1)]
    return staged(id_text(docs).join(F.broadcast(taken[0].unionByName(taken[1])), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "label", "text"))


def _speaking_strings(sample: DataFrame, sizes: dict[int, int]) -> dict[bytes, float]:
    """Strings that toxic texts hold far more often than ordinary ones, with the logarithm of how many times."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        label = batch.column("label").to_numpy()
        held = [strings(folded(t)) for t in as_bytes(batch.column("text"))]
        parts = [np.unique(np.concatenate([np.zeros(0, np.int64), *(h for h, k in zip(held, label, strict=True) if k == of)]), return_counts=True) for of in (0, 1)]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([p[0] for p in parts])), pa.array(np.repeat([0, 1], [len(p[0]) for p in parts])), pa.array(np.concatenate([p[1] for p in parts]))],
            names=["string", "label", "n"])

    counts = per_batch(sample, step, "string long, label long, n long").groupBy("string").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("ordinary"))
    ratio = (F.col("toxic") / sizes[1]) / ((F.col("ordinary") + 1) / max(1, sizes[0]))
    found = counts.where((F.col("toxic") >= max(3, SHARE * sizes[1])) & (ratio >= CONTRAST)).select("string", (F.log(ratio) * F.col("toxic")).alias("weight"))
    return {r.string.to_bytes(STRING, "big"): r.weight for r in found.orderBy(F.desc("weight"), "string").limit(TOXIC_BYTES).collect()}


def _speaking_words(sample: DataFrame, spoken: dict[bytes, float]) -> list[bytes]:
    """Words of toxic texts that hold such a string, the most common first."""
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[bytes] = []
        for text in as_bytes(batch.column("text")):
            out += [w for w in ({b" " + x + b" " for x in folded(text).split()}) if len(w) <= 64 and any(w[k : k + STRING] in spoken for k in range(len(w) - STRING + 1))]
        return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["word"])

    held = per_batch(sample.where("label = 1"), step, "word binary").groupBy("word").count().orderBy(F.desc("count"), "word").limit(4 * TOXIC_BYTES)
    return [bytes(r.word) for r in held.collect()]


def _ordinary_windows(sample: DataFrame) -> list[bytes]:
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w for t in as_bytes(batch.column("text")) for w in windows(folded(t))], pa.binary())], names=["w"])

    taken = per_batch(sample.where("label = 0").select("text"), step, "w binary").orderBy(F.xxhash64("w"), "w").limit(TRAINED_ON)
    return [bytes(r.w) for r in taken.collect()]


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", most: int = LABELLED) -> Distance:
    """Learns from at most `most` labelled texts of either label, none of the held-out third.

    To the driver come bounded windows, strings and words for the dictionaries, and one row of margin counts for each of these texts, never the texts.
    Rows without id or label are left out; of repeated labels of a document the smallest counts. Without toxic rows every score is that of no evidence.
    """
    sample = _sample(docs, labels, target, most)
    sizes = {0: 0, 1: 0} | {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    ordinary = ordinary_content(_ordinary_windows(sample))
    spoken = _speaking_strings(sample, sizes) if sizes[1] else {}
    content = toxic_content(spoken, _speaking_words(sample, spoken)) if spoken else b""
    model = Distance(ordinary, content + ordinary, np.zeros(MOST_MARGIN + 1), 0.0, 1.0)
    return calibrated(model, sample)


def calibrated(model: Distance, sample: DataFrame) -> Distance:
    """The model with thresholds from labelled texts: how much a window of each margin speaks, what a window without one takes away, and where texts are told apart."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = [np.bincount(np.clip(shared.value.margins(folded(t)), 0, MOST_MARGIN), minlength=MOST_MARGIN + 1) for t in as_bytes(batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("label"), pa.array(counts, pa.list_(pa.int64()))], names=["label", "counts"])

    rows = per_batch(sample.repartition(32).select("label", "text"), step, "label int, counts array<long>").collect()
    if not rows:
        return model
    label, counts = np.array([r.label for r in rows]), np.array([r.counts for r in rows], dtype=np.float64)
    by_label = [counts[label == k].sum(axis=0) + 0.5 for k in (0, 1)]
    rates = [c / c.sum() for c in by_label]
    tails = [r[::-1].cumsum()[::-1] for r in rates]
    speaks = np.log(tails[1] / tails[0])
    speaks[0] = 0
    model.evidence = np.maximum.accumulate(np.maximum(speaks, 0))
    n, held = counts.sum(axis=1), counts[:, 1:].sum(axis=1)
    shares = (held / np.maximum(n, 1))[(label == 1) & (held > 1)]
    model.per_window = float(np.log1p(-np.quantile(shares, 0.05) / 2)) if len(shares) else 0.0
    evidence = counts @ model.evidence + n * model.per_window
    order = np.argsort(evidence, kind="stable")
    cuts = np.concatenate([[0], np.cumsum(label[order] == 1) - np.cumsum(label[order] == 0)])  # toxic texts missed less ordinary texts left alone
    values = evidence[order]
    free = np.concatenate([[True], values[1:] > values[:-1], [True]])
    best = int(np.flatnonzero(free & (cuts == cuts[free].min()))[-1])
    low, high = values[best - 1] if best else values[0] - 1, values[best] if best < len(values) else values[-1] + 1
    model.threshold = float((low + high) / 2) if model.evidence.any() else 1.0
    return model


def score(docs: DataFrame, model: Distance, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs, from all windows of its whole text.

    Null texts are empty; a text without words has no window and the score of no evidence. Repeated rows and null ids are kept. The model is broadcast; its
    size is fixed by the dictionaries'.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [shared.value.score(t, threshold) for t in as_bytes(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    scored = id_text(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
