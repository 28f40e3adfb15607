"""External induced sorting: suffix tuples and their common prefixes, carried leftward byte by byte through queues on disk."""

from __future__ import annotations

import pickle
import tempfile
from bisect import bisect_left
from collections.abc import Iterable, Iterator

#: Tuples that all queues of a step together keep in memory; the rest lies in temporary files.
IN_MEMORY = 200_000


class DiskQueue:
    """First in, first out; what exceeds its share of memory goes to a file that vanishes with the queue."""

    def __init__(self, in_memory: int = IN_MEMORY) -> None:
        self.in_memory, self.items, self.file = in_memory, [], None

    def push(self, item: tuple) -> None:
        self.items.append(item)
        if len(self.items) >= self.in_memory:
            self.file = self.file or tempfile.TemporaryFile()
            pickle.dump(self.items, self.file, pickle.HIGHEST_PROTOCOL)
            self.items = []

    def __iter__(self) -> Iterator[tuple]:
        if self.file:
            end = self.file.tell()
            self.file.seek(0)
            while self.file.tell() < end:
                yield from pickle.load(self.file)
            self.file.close()
        yield from self.items


class ByteQueue:
    """A priority queue for keys of one byte: pops by byte, and within a byte in the order of pushing. It lives on disk where it is large."""

    def __init__(self, in_memory: int = IN_MEMORY) -> None:
        self.in_memory, self.queues = in_memory, {}

    def push(self, byte: int, item: tuple) -> None:
        queue = self.queues.get(byte)
        if queue is None:
            queue = self.queues[byte] = DiskQueue(max(1, self.in_memory // 256))
        queue.push(item)

    def __iter__(self) -> Iterator[tuple]:
        for byte in sorted(self.queues):
            yield from self.queues[byte]


class Smallest:
    """Least value since a place, for values added one after another: a stack of increasing values, so no larger than their range."""

    def __init__(self) -> None:
        self.places, self.values = [], []

    def add(self, place: int, value: int) -> None:
        while self.values and self.values[-1] >= value:
            self.values.pop()
            self.places.pop()
        self.places.append(place)
        self.values.append(value)

    def since(self, place: int) -> int:
        """The least value added after `place`."""
        return self.values[bisect_left(self.places, place + 1)]


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n - 1
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def sorted_tuples(rights: Iterable[tuple[int, int, bytes, bytes]]) -> Iterator[tuple[int, int, int, bytes]]:
    """(common prefix with the one before, doc, anchor, left) of (doc, anchor, left, right) that come in order of right."""
    before = b""
    for doc, anchor, left, right in rights:
        yield common(before, right), doc, anchor, left
        before = right


def repeated_starts(rights: Iterable[tuple[int, int, bytes, bytes]], length: int, in_memory: int = IN_MEMORY) -> Iterator[tuple[int, int]]:
    """(doc, start) of every string of `length` bytes that an earlier one (smaller doc, then smaller start) equals.

    Each suffix tuple has an anchor in its document, the bytes left of it and the bytes from it on; tuples come in order of
    the latter. The order of the suffixes that begin one byte further left is induced from that of these: by the byte,
    then by the order at hand. The common prefix of two that follow each other with the same byte is one more than the least
    between them. Strings are equal where it reaches `length`. A level reads the queue of the level before and fills its own, so
    memory does not grow with the tuples.
    """
    level, step = iter(sorted_tuples(rights)), 0
    while True:
        queue, least, seen, any_left = ByteQueue(in_memory), Smallest(), {}, False
        best = None
        for place, (prefix, doc, anchor, left) in enumerate(level):
            here = (doc, anchor - step)
            if prefix >= length:
                if here < best:
                    best, here = here, best
                if here != best:
                    yield here
            else:
                best = here
            least.add(place, prefix)
            if step < len(left):
                byte = left[-1 - step]
                last = seen.get(byte)
                queue.push(byte, (0 if last is None else least.since(last) + 1, doc, anchor, left))
                seen[byte] = place
                any_left = True
        if not any_left:
            return
        level, step = iter(queue), step + 1
