"""Benchmark decontamination: random-walk embedding of item-sized windows, bit-sampling LSH, exact edit distance."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from ambientspark.llm.common import as_bytes, as_rows, id_text, staged, unused
from ambientspark.llm.licenses import FOLD

#: A window leaks an item if at most this share of the item's words needs inserting, deleting or replacing.
EDIT_RATE = 0.1
#: Share of such windows that the sampled positions find.
RECALL = 0.99
SAMPLED = 4
#: Items of more words are not embedded: the share of differing positions grows with the edits. One of their pieces must stand unchanged.
EMBEDDED_WORDS = 60
PIECE_WORDS = 10
#: Share of embedded positions taken to differ at the edit rate, for items up to EMBEDDED_WORDS.
DIFFERING = 0.35
#: Benchmark text handled in one pass over the documents, in bytes; more is dealt into several passes.
PASS_BYTES = 32 << 20
SEED = 20_240_601
#: Marks for pairs of neighbouring words of items; two pairs that share one only make more windows to embed.
PAIR_SLOTS = 1 << 22
#: Words that one step lays end to end, and windows embedded together.
RUN_WORDS = 1 << 20
WINDOWS = 1 << 14
SPAN = "struct<item_id: bigint, first_word: bigint, last_word: bigint, edits: int>"
_PAIR = pa.struct([("item_id", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())])


def words_of(text: bytes) -> list[bytes]:
    """Words of letters, digits and signs outside ASCII, A-Z lower-cased."""
    return [w for w in text.translate(FOLD).split(b" ") if w]


def edit_limit(n: int, rate: float) -> int:
    return math.floor(n * rate)


def repetitions(recall: float = RECALL, differing: float = DIFFERING, sampled: int = SAMPLED) -> int:
    """Repetitions of `sampled` positions after which a share `recall` of the windows has agreed at least once."""
    return math.ceil(math.log(1 - recall) / math.log(1 - (1 - differing) ** sampled))


class Walk:
    """One embedding of word-id sequences into positions, and the positions sampled of it.

    At step j the walk writes the word it stands at and goes on if hash j of that word is odd; beyond the end it writes -1. Both
    sequences of a pair use the same hashes, so they fall into step again after an edit. Of the 3n steps for n words
    the last third mostly stands beyond the end, so positions are sampled from the first 2n.
    """

    def __init__(self, longest: int, repetition: int) -> None:
        rng = np.random.default_rng([SEED, repetition])
        self.shares = np.sort(rng.random(SAMPLED))
        self.mix = rng.integers(0, 1 << 63, size=SAMPLED, dtype=np.uint64) | np.uint64(1)
        self.salts = rng.integers(0, 1 << 63, size=2 * longest, dtype=np.uint64) | np.uint64(1)

    def keys(self, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """One 64-bit key for each row (its first `length` word ids, then -1): its length and what the sampled positions hold."""
        rows, width = np.arange(len(windows)), windows.shape[1]
        flat = np.concatenate([windows, np.full((len(windows), 1), -1)], axis=1).astype(np.int64).view(np.uint64).ravel()
        sampled = (self.shares[:, None] * (2 * lengths)).astype(np.int64)
        at, last = rows * (width + 1), rows * (width + 1) + lengths
        written = np.empty((int(sampled.max(initial=0)) + 1, len(windows)), dtype=np.uint64)
        for j in range(len(written)):
            here = written[j] = flat[at]
            at = np.minimum(at + ((here + np.uint64(0x9E3779B97F4A7C15)) * self.salts[j] >> np.uint64(63)).astype(np.int64), last)
        key = lengths.astype(np.uint64)
        for places, mix in zip(sampled, self.mix, strict=True):
            key = (key ^ written[places, rows]) * mix
            key ^= key >> np.uint64(29)
        return key


def best_end(item: list[int], window: list[int], limit: int) -> tuple[int, int] | None:
    """(edits, words taken) of the prefix of window nearest to item, or None if all need more than `limit` edits.

    Of equally near prefixes the one whose length is nearest to the item's counts, then the shorter.
    """
    n, far = len(item), limit + 1
    row = list(range(len(window) + 1))
    for i, word in enumerate(item, 1):
        low, high = max(1, i - limit), min(len(window), i + limit)
        new = [far] * (len(window) + 1)
        if i <= limit:
            new[0] = i
        for j in range(low, high + 1):
            new[j] = min(row[j - 1] + (word != window[j - 1]), row[j] + 1, new[j - 1] + 1)
        row = new
    edits, _, taken = min((e, abs(j - n), j) for j, e in enumerate(row))
    return (edits, taken) if edits <= limit else None


def start_edits(item: list[int], window: np.ndarray) -> np.ndarray:
    """For each place in window, the edits that its nearest window from there needs to be the item."""
    back = window[::-1]
    at = np.arange(len(back) + 1)
    row = np.zeros(len(back) + 1, dtype=np.int64)
    for i, word in enumerate(reversed(item), 1):
        new = row + 1
        np.minimum(new[1:], row[:-1] + (back != word), out=new[1:])
        new[0] = i
        row = np.minimum.accumulate(new - at) + at
    return row[:0:-1]


def run_keys(ids: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit key for each run of `size` word ids."""
    ids, keys = ids.astype(np.uint64), np.zeros(max(0, len(ids) - size + 1), dtype=np.uint64)
    for k in range(size):
        keys = (keys ^ ids[k : k + len(keys)]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys


@dataclass
class Items:
    """Benchmark items as word ids, their keys for every repetition, and the pieces of long ones."""

    rate: float
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    items: list[tuple[int, list[int]]] = field(default_factory=list)
    tables: list[tuple[Walk, np.ndarray, np.ndarray]] = field(default_factory=list)
    longest: int = 0
    #: marks of the pairs of neighbouring words, and the fewest different ones of an item of each length
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(PAIR_SLOTS, dtype=bool))
    least_pairs: dict[int, int] = field(default_factory=dict)
    #: by length of the pieces: their keys in order, and the item and offset of each
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple[int, bytes]], rate: float, recall: float) -> Items:
        out = cls(rate)
        short, pieces = [], {}
        for item_id, text in rows:
            ids = [out.vocabulary.setdefault(w, len(out.vocabulary) + 1) for w in words_of(text)]
            if not ids:
                continue
            out.items.append((item_id, ids))
            number, n = edit_limit(len(ids), rate) + 1, len(ids)
            if n > EMBEDDED_WORDS and number <= n:
                for k in range(number):
                    first, last = n * k // number, n * (k + 1) // number
                    size = min(last - first, PIECE_WORDS)
                    key = run_keys(np.array(ids[first : first + size]), size)[0]
                    pieces.setdefault(size, []).append((key, len(out.items) - 1, first))
                continue
            short.append(len(out.items) - 1)
            out.longest = max(out.longest, n)
            different = np.unique(out.slots(np.array(ids, dtype=np.int64)))
            out.pairs[different] = True
            out.least_pairs[n] = min(len(different), out.least_pairs.get(n, n))
        for size, found in pieces.items():
            keys, numbers, offsets = (np.array(x) for x in zip(*found, strict=True))
            order = np.argsort(keys, kind="stable")
            out.pieces[size] = keys[order], numbers[order], offsets[order]
        if short:
            matrix = np.full((len(short), out.longest), -1, dtype=np.int64)
            for row, k in enumerate(short):
                matrix[row, : len(out.items[k][1])] = out.items[k][1]
            lengths = np.array([len(out.items[k][1]) for k in short])
            for r in range(repetitions(recall)):
                walk = Walk(out.longest, r)
                keys = walk.keys(matrix, lengths)
                order = np.argsort(keys, kind="stable")
                out.tables.append((walk, keys[order], np.array(short)[order]))
        return out

    def slots(self, ids: np.ndarray) -> np.ndarray:
        """Where the pairs of neighbouring words are marked."""
        return ((ids[:-1] * 0x9E3779B1 + ids[1:] * 0x85EBCA77) & 0xFFFFFFFF) * PAIR_SLOTS >> 32

    def starts(self, ids: np.ndarray) -> dict[int, np.ndarray]:
        """For each item length, the places in a run of word ids where a window may start.

        An edit touches two pairs of neighbouring words at most. So a window of n + limit words that holds an item with
        `limit` edits holds all but 2 limit of the item's different pairs; any place where it has fewer that occur in any item can
        be left out. A pair that repeats the one before it is not counted, which takes one from the windows that begin with it.
        """
        slots = self.slots(ids)
        known = self.pairs[slots] & (ids[:-1] > 0) & (ids[1:] > 0)
        known[1:] &= slots[1:] != slots[:-1]
        inside = np.concatenate([[0], np.cumsum(known, dtype=np.int32)])
        need = {n: max(0, least - 2 * edit_limit(n, self.rate) - 1) for n, least in self.least_pairs.items()}
        if not need:
            return {}
        places, last = np.arange(len(ids)), len(known)
        reach = max(n + edit_limit(n, self.rate) for n in need)
        places = places[inside[np.minimum(places + reach, last)] - inside[np.minimum(places, last)] >= min(need.values())]
        before = inside[np.minimum(places, last)]
        return {n: places[inside[np.minimum(places + n + edit_limit(n, self.rate) - 1, last)] - before >= least] for n, least in need.items()}

    def leaks(self, texts: list[bytes]) -> list[list[tuple[int, int, int, int]]]:
        """For each whole text, (item_id, first word, last word, edits) of its item-like windows."""
        get = self.vocabulary.get
        found: list[dict[int, list[tuple[int, int, int]]]] = [{} for _ in texts]
        runs, first, size = [], 0, 0
        for k, text in enumerate(texts):
            words = words_of(text)
            runs.append(np.fromiter(map(get, words, repeat(0)), np.int64, len(words)))
            size += len(words) + 1
            if size >= RUN_WORDS or k == len(texts) - 1:
                self._search(runs, found[first:])
                runs, first, size = [], k + 1, 0
        return [self._settled(x) for x in found]

    def _search(self, runs: list[np.ndarray], found: list[dict[int, list[tuple[int, int, int]]]]) -> None:
        """Searches texts laid end to end with a word of no item between them."""
        gap = np.zeros(1, dtype=np.int64)
        ids = np.concatenate([x for run in runs for x in (run, gap)])
        ends = np.cumsum([len(run) + 1 for run in runs]) - 1
        begins = ends - [len(run) for run in runs]
        self._search_pieces(ids, begins, ends, found)
        starts, texts, lengths = [], [], []
        for n, places in self.starts(ids).items():
            text = np.searchsorted(ends, places, "right")
            fits = text < len(ends)
            places, text = places[fits], text[fits]
            fits = ends[text] - places >= n - edit_limit(n, self.rate)
            starts.append(places[fits])
            texts.append(text[fits])
            lengths.append(np.full(len(starts[-1]), n))
        if not starts:
            return
        start, text, length = np.concatenate(starts), np.concatenate(texts), np.concatenate(lengths)
        for at in range(0, len(start), WINDOWS):
            part = slice(at, at + WINDOWS)
            self._compare(ids, start[part], text[part], length[part], begins, ends, found)

    def _search_pieces(self, ids, begins, ends, found) -> None:
        """Long items: with no more edits than allowed, one piece stands unchanged and moves by that many words at most."""
        near: dict[tuple[int, int], list[int]] = {}
        for size, (keys, numbers, offsets) in self.pieces.items():
            own = run_keys(ids, size)
            low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            for at in np.nonzero(high > low)[0].tolist():
                text = int(np.searchsorted(ends, at, "right"))
                for k in range(low[at], high[at]):
                    near.setdefault((text, int(numbers[k])), []).append(at - int(offsets[k]))
        for (text, number), places in near.items():
            wanted, begin, end = self.items[number][1], int(begins[text]), int(ends[text])
            limit, reach, spans = edit_limit(len(wanted), self.rate), -1, []
            for place in sorted(set(places)):
                low, high = max(begin, place - limit), min(place + limit, end - 1) + 1
                if low <= reach:
                    spans[-1][1] = reach = max(reach, high)
                elif low < high:
                    spans.append([low, high])
                    reach = high
            starts = []
            for low, high in spans:
                edits = start_edits(wanted, ids[low : min(high + len(wanted) + limit, end)])[: high - low]
                starts += [(int(edits[i]), low + int(i)) for i in np.nonzero(edits <= limit)[0]]
            taken: list[tuple[int, int]] = []
            for edits, start in sorted(starts):  # as _settled orders them
                if any(a <= start <= b for a, b in taken):
                    continue
                got = best_end(wanted, ids[start : min(start + len(wanted) + limit, end)].tolist(), limit)
                last = start + max(got[1], 1) - 1
                if all(last < a or b < start for a, b in taken):
                    taken.append((start, last))
                    found[text].setdefault(number, []).append((edits, start - begin, last - begin))

    def _compare(self, ids, start, text, length, begins, ends, found) -> None:
        ahead = np.arange(self.longest)
        inside = (ahead < length[:, None]) & (start[:, None] + ahead < ends[text][:, None])
        windows = np.where(inside, ids[np.minimum(start[:, None] + ahead, len(ids) - 1)], -1)
        pairs: set[tuple[int, int]] = set()
        for walk, keys, numbers in self.tables:
            own = walk.keys(windows, length)
            low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            for i in np.nonzero(high > low)[0]:
                pairs.update((int(i), int(x)) for x in numbers[low[i] : high[i]])
        for i, item in pairs:
            s, t, wanted = int(start[i]), int(text[i]), self.items[item][1]
            limit = edit_limit(len(wanted), self.rate)
            if got := best_end(wanted, ids[s : min(s + len(wanted) + limit, int(ends[t]))].tolist(), limit):
                begin = s - int(begins[t])
                found[t].setdefault(item, []).append((got[0], begin, begin + max(got[1], 1) - 1))

    def _settled(self, found: dict[int, list[tuple[int, int, int]]]) -> list[tuple[int, int, int, int]]:
        out = []
        for k, spans in found.items():
            taken: list[tuple[int, int]] = []
            for edits, first, last in sorted(spans):
                if all(last < a or b < first for a, b in taken):
                    taken.append((first, last))
                    out.append((self.items[k][0], first, last, edits))
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def _blocks(benchmark: DataFrame, rate: float, recall: float) -> Iterator[Items]:
    """The items in blocks of about PASS_BYTES at most: only one block at a time is held by the driver."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + total // PASS_BYTES
    for part in range(parts):
        block = items if parts == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
        if rows := [(r.item_id, r.text.encode("utf-8")) for r in block.distinct().orderBy("item_id", "text").collect()]:
            yield Items.of(rows, rate, recall)


def _marked(docs: DataFrame, column: str, items: Broadcast) -> DataFrame:
    """docs with `column`, the leaks of each row's text."""
    names = ("item_id", "first_word", "last_word", "edits")
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.StructType.fromDDL(f"leaks array<{SPAN}>")["leaks"].dataType)])
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(names, x, strict=True)) for x in spans] for spans in items.value.leaks([t or b"" for t in as_bytes(batch.column(text))])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(_PAIR))], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, schema)


def leak_spans(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, recall: float = RECALL, column: str = "_leaks") -> DataFrame:
    """docs with an array column of (item_id, first_word, last_word, edits), words from 0, in place of one of that name.

    An item leaks where a window of a document is within `rate` of its words by edit distance; of overlapping finds of one item
    the nearest counts. Windows of the length of every item up to EMBEDDED_WORDS are embedded, sampled positions find the candidates, with the
    stated recall for edited windows and certainty for exact ones; longer items are found by the piece that must stand unchanged, all of
    them. The edit distance decides. Items without words match nothing; a
    null or empty text has no leaks. All rows and columns of docs stay. There is no shuffle for one block of items. For several, rows are stored once, each block's finds (few)
    are stored and its broadcast is given up before the next block, and the rows meet their finds in the end.
    """
    own = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c != column])
    blocks = _blocks(benchmark, rate, recall)
    first, second = next(blocks, None), next(blocks, None)
    broadcast = docs.sparkSession.sparkContext.broadcast
    if first is None:
        return own.withColumn(column, F.expr(f"cast(array() as array<{SPAN}>)"))
    if second is None:
        return _marked(own, column, broadcast(first))
    rows = staged(as_rows(own, F.monotonically_increasing_id().alias("_row")))
    texts, found = rows.select("_row", F.col("doc.text").alias("text")), []
    for block in chain((first, second), blocks):
        items = broadcast(block)
        found.append(staged(_marked(texts, "leaks", items).where(F.size("leaks") > 0).select("_row", "leaks")))
        items.destroy()
    spans = reduce(DataFrame.unionByName, found).groupBy("_row").agg(F.flatten(F.collect_list("leaks")).alias("leaks"))  # bounded by one text
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    return rows.join(spans, "_row", "left").select("doc.*", F.coalesce("leaks", none).alias(column))


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, recall: float = RECALL) -> DataFrame:
    """One row per leaked item and place: doc_id, item_id, first_word, last_word, edits."""
    found = leak_spans(id_text(docs), benchmark, rate, recall)
    return found.select("doc_id", F.explode("_leaks").alias("x")).select("doc_id", "x.*")


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, recall: float = RECALL) -> DataFrame:
    """The rows of docs without leaks."""
    column = unused("_leaks", docs.columns)
    return leak_spans(docs, benchmark, rate, recall, column).where(F.size(column) == 0).select(*docs.columns)
