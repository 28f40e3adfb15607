"""Best-fit packing: minimum bin slack over a histogram of piece lengths."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ambientspark.llm.common import as_bytes, as_rows, id_text, staged

CAPACITY = 2048
END_ID = 0
#: Pieces that one task ranks, about.
RANKED_TOGETHER = 500_000
#: Entries of the per-task table from words to their token ids.
CACHE_WORDS = 800_000
LONGEST_CACHED = 48
#: Words with punctuation are cached up to this length only; longer ones are seldom seen again.
LONGEST_PAIR = 8


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One for each Python worker, which later tasks find filled."""
    return WordEncoder(path)


class WordEncoder(dict):
    """Token ids of whole texts, as little-endian 32-bit bytes; a table from words to ids that fills itself.

    The vocabulary's normalizer lower-cases, and its pre-tokenizer drops white space and takes runs of letters and runs of
    other signs apart, never across white space. So the ids of a text are those of its words one after another, and
    those of a word of Latin letters with punctuation after it are those of the two. Words of Latin letters
    go straight to the merge model, all others through the whole tokenizer.
    """

    PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != ord("'"))

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.visible = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(128, 256) if chr(c).isalpha()}

    @staticmethod
    def is_latin(word: str) -> bool:
        return word.isalpha() and max(word) < "\u0100"

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        stem = word.rstrip(self.PUNCTUATION)
        if b"<|" in word:  # may spell a special token, which is matched before lower-casing
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
        elif self.is_latin(text):
            found = [t.id for t in self.model.tokenize(text.lower().translate(self.visible))]
        elif not stem:
            found = [t.id for t in self.model.tokenize(text)]
        elif len(stem) < len(word) and self.is_latin(stem.decode("utf-8", "replace")):
            found = self[stem] + self[word[len(stem) :]]
            return self.keep(word, found) if len(word) <= LONGEST_PAIR else found
        else:
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.keep(word, np.array(found, dtype="<u4").tobytes())

    def keep(self, word: bytes, ids: bytes) -> bytes:
        if len(word) <= LONGEST_CACHED:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        # bytes.lower() changes A-Z alone, bytes.split() splits at ASCII white space
        return b"".join(map(self.__getitem__, (text if b"<|" in text else text.lower()).split()))


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int | None = END_ID) -> DataFrame:
    """Each document's token ids, cut into pieces of at most `capacity`.

    Columns: doc_id, piece (from 0), start (ids of the document before it), length, ids (little-endian unsigned 32-bit).
    A null text is empty; an empty text has the end id alone. Without an end id it has no piece. Repeated rows
    give repeated pieces. Other columns of docs are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_path)
        end = b"" if end_id is None else np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            row, piece, ids = [], [], []
            for k, text in enumerate(as_bytes(batch.column("text"))):
                got = encoder.encode(text) + end
                for n, cut in enumerate(range(0, len(got), 4 * capacity)):
                    row.append(k)
                    piece.append(n)
                    ids.append(got[cut : cut + 4 * capacity])
            pieces = np.asarray(piece, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(pieces), pa.array(pieces.astype(np.int64) * capacity),
                 pa.array(np.fromiter(map(len, ids), np.int64, len(ids)) // 4), pa.array(ids, pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids"])

    return id_text(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def fullest(lengths: list[int], left: dict[int, int], first: int, capacity: int) -> dict[int, int]:
    """The fullest bin that holds one piece of length `first`: length -> copies.

    Bit i of `reach` says that some of the remaining pieces sum to i; copies of a length are added in powers of two.
    """
    room = capacity - first
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        if length > room:
            continue
        copies, power = min(left[length] - (length == first), room // length), 1
        while copies > 0:
            take = min(power, copies)
            steps.append((length, take, reach))
            reach |= (reach << length * take) & mask
            copies -= take
            power *= 2
        if reach >> room & 1:
            break
    at, bin_of = reach.bit_length() - 1, {first: 1}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            bin_of[length] = bin_of.get(length, 0) + take
    return bin_of


def slack_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Minimum bin slack over a histogram: (length, first rank, pieces, copies a bin, first bin, offset of the first copy).

    Takes the longest piece left, completes it to the fullest feasible bin, and removes that combination as often as
    the counts allow. The work depends on the number of different lengths (at most the capacity), not of pieces.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    if left and max(left) > capacity:
        raise ValueError(f"a piece is longer than {capacity}")
    lengths, used, plan, bins = sorted(left, reverse=True), dict.fromkeys(left, 0), [], 0
    while lengths:
        got = fullest(lengths, left, lengths[0], capacity)
        times, offset = min(left[k] // n for k, n in got.items()), 0
        for length, copies in got.items():
            plan.append((length, used[length], times * copies, copies, bins, offset))
            used[length] += times * copies
            left[length] -= times * copies
            offset += length * copies
        bins += times
        lengths = [k for k in lengths if left[k]]
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset (in place of columns of these names): the sequence each piece goes to and its place there.

    `pieces` has `length` (1 to capacity) besides any other columns and should be a stored table, as it is read
    twice: for the histogram of lengths, then to number the pieces of each length. Only the histogram (at most
    `capacity` rows) reaches the driver, and only the plan made of it is broadcast. A length that very many pieces share is
    numbered in parts. Pieces of the same length are interchangeable, so ties do not matter. An empty table stays empty.
    """
    spark = pieces.sparkSession
    total = pieces.count()
    parts = max(4, -(-total // RANKED_TOGETHER))
    mark = F.xxhash64(*[pieces[f"`{c}`"] for c in pieces.columns])
    rows = as_rows(pieces, F.col("length").alias("length"), mark.alias("mark")).withColumn("part", F.pmod("mark", F.lit(parts)))
    sizes = staged(rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    counts = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("n")).collect()}
    plan = slack_plan(counts, capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy("mark")) - 1
    ranked = rows.withColumn("inside", inside).join(before, ["length", "part"]).select("doc", "length", (F.col("inside") + F.col("before")).alias("rank"))
    table = spark.createDataFrame(plan or [(0,) * 6], "of long, first long, span long, copies long, bin long, start long")
    fits = (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("span"))
    local = F.col("rank") - F.col("first")
    return ranked.join(F.broadcast(table), fits).select(
        *[F.col("doc")[c].alias(c) for c in pieces.columns if c not in ("sequence_id", "offset")],
        (F.col("bin") + F.floor(local / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("start") + F.pmod(local, F.col("copies")) * F.col("length")).cast("long").alias("offset"))


def packed_digest(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Where every piece of every document goes, with the CRC-32 of its ids in place of the ids."""
    pieces = token_pieces(docs, tokenizer_path, capacity, end_id)
    return pack(staged(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))), capacity)
