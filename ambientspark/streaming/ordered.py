"""Stateful folds over a room's rows in order of event time: typed state, a reorder buffer, timers, late rows.

A `Fold` is a small step function with the schemas of its state and of what it gives out. `fold_in_order` runs it over a
stream: rows wait in a list state until the watermark says that no earlier one can come, an event-time timer per room releases them, and the
same timers let a fold act on time alone (`due`, `lapse`), also while nothing arrives.

Spark calls a processor once for each grouping key of a micro-batch, which with its state calls costs milliseconds, however few rows the key has. So rooms are
dealt to groups by hash; a group's states and waiting rows travel together, as lists by column, while each room keeps a state, clock and late count of its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegralType, LongType, StringType, StructField, StructType

Step = Callable[[Any, dict], tuple[Any, list[dict]]]

#: Keys are dealt to so many groups. A call holds one group's states and waiting rows: a stream of very many keys takes more, which must stay as they are
#: while its checkpoint lives.
GROUPS = 1024


@dataclass(frozen=True)
class Fold:
    """step(state, row) -> (state, rows out); the state is None at first.

    `pack` turns a state into typed rows of the `state` schema and `unpack` back. `due(state)` is the time after which the state changes by
    itself, if any; `lapse(state, key, time)` makes that change, as step does, and must leave a later due time or none.
    """

    step: Step
    out: str
    state: str
    pack: Callable[[Any], list[tuple]]
    unpack: Callable[[list[tuple]], Any]
    due: Callable[[Any], float | None] | None = None
    lapse: Callable[[Any, dict, float], tuple[Any, list[dict]]] | None = None

    def with_step(self, step: Step) -> Fold:
        return replace(self, step=step)


def _plain(value, kind):
    """A value of a pandas row as plain Python of its type; NaN and NaT count as null."""
    if value is None or (not isinstance(kind, ArrayType) and pd.isna(value)):
        return None
    if isinstance(kind, ArrayType):
        return [_plain(v, kind.elementType) for v in value]
    if isinstance(kind, IntegralType):
        return int(value)
    return float(value) if isinstance(kind, (DoubleType, FloatType)) else value


def _plain_column(column: pd.Series, kind) -> list:
    """The values of a column as `_plain` gives them."""
    if (isinstance(kind, IntegralType) and column.dtype.kind in "iu") or (isinstance(kind, (DoubleType, FloatType)) and column.dtype.kind == "f" and not column.hasnans):
        return column.tolist()
    return [_plain(v, kind) for v in column]


def _by_column(schema: StructType) -> StructType:
    return StructType([StructField(f.name, ArrayType(f.dataType)) for f in schema.fields])


class OrderedFold(StatefulProcessor):
    """Runs a Fold for each key of a group. Rows that do not wait for the watermark are taken in order within their micro-batch."""

    def __init__(self, fold: Fold, state: StructType, rows: StructType, keys: list[str], order: list[str], out: StructType, waits: bool, late: bool):
        self.fold, self.state, self.rows, self.keys, self.order, self.out, self.waits, self.late = fold, state, rows, keys, order, out, waits, late
        self.named = StructType([rows[c] for c in keys])
        self.key_at, self.order_at = [rows.names.index(c) for c in keys], [rows.names.index(c) for c in order]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.swept: dict = {}
        # key and state columns are numbered, since both may have a name
        held = [*self.named.fields, *self.state.fields]
        self.held = handle.getValueState("held", _by_column(StructType([StructField(f"c{k}", f.dataType) for k, f in enumerate(held)])))
        clock = [*[StructField(f"c{k}", f.dataType) for k, f in enumerate(self.named.fields)], StructField("seen", DoubleType()), StructField("late", LongType())]
        self.clock = handle.getValueState("clock", _by_column(StructType(clock)))
        self.pending = handle.getListState("pending", _by_column(self.rows))

    def _at(self, row: tuple) -> tuple:
        return tuple([row[k] for k in self.order_at])

    def _key(self, row: tuple) -> tuple:
        return tuple([row[k] for k in self.key_at])

    def _of_keys(self, rows) -> dict[tuple, list[tuple]]:
        found: dict[tuple, list[tuple]] = {}
        for row in rows:
            found.setdefault(self._key(row), []).append(row)
        return found

    def _clocks(self) -> dict[tuple, tuple]:
        n = len(self.keys)
        return {row[:n]: row[n:] for row in zip(*self.clock.get(), strict=True)} if self.clock.exists() else {}

    def _put_clocks(self, clocks: dict[tuple, tuple]) -> None:
        if clocks:
            self.clock.update(_columns([(*key, *clock) for key, clock in clocks.items()]))

    def _states(self) -> dict[tuple, list[tuple]]:
        """The packed state of each key that has one."""
        n, found = len(self.keys), {}
        if self.held.exists():
            for row in zip(*self.held.get(), strict=True):
                found.setdefault(row[:n], []).append(row[n:])
        return found

    def _put_states(self, states: dict[tuple, list[tuple]]) -> None:
        rows = [(*key, *packed) for key, state in states.items() for packed in state]
        if rows:
            self.held.update(_columns(rows))
        elif self.held.exists():
            self.held.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [r for pdf in rows for r in zip(*(_plain_column(pdf[f.name], f.dataType) for f in self.rows.fields), strict=True)]
        self.swept.pop(key, None)
        clocks, out, kept = self._clocks(), [], []
        for named, mine in self._of_keys(new).items():
            seen, missed = clocks.get(named, (None, 0))
            if seen is not None:
                late = [r for r in mine if self._at(r)[0] < seen]
                if late:
                    mine = [r for r in mine if self._at(r)[0] >= seen]
                    clocks[named] = (seen, missed + len(late))
                if self.late:
                    for n, row in enumerate(late):
                        out.append({c: v for c, v in zip(self.rows.names, row, strict=True) if c in self.out.names} | {"late": True, "late_rows": missed + n + 1})
            kept += mine
        if not self.waits:
            out += self._advance(kept, math.inf, clocks)
        else:
            self._put_clocks(clocks)
            if kept:
                self.pending.appendValue(_columns(kept))
                self._wake(min(self._at(r)[0] for r in kept))
        yield from self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() / 1000.0
        if self.swept.get(key) == until:
            return  # by an earlier timer of this micro-batch
        self.swept[key] = until
        waiting = [r for part in self.pending.get() for r in zip(*part, strict=True)] if self.pending.exists() else []
        later = [r for r in waiting if self._at(r)[0] > until]
        ready = [r for r in waiting if self._at(r)[0] <= until]
        if ready:
            self.pending.put([_columns(later)]) if later else self.pending.clear()
        out = self._advance(ready, until, self._clocks())
        if later:
            self._wake(min(self._at(r)[0] for r in later))
        yield from self._frame(out)

    def _advance(self, ready: list[tuple], until: float, clocks: dict[tuple, tuple]) -> list[dict]:
        """Steps each key through its rows in order, and through what falls due before or between them."""
        fold, names, states = self.fold, self.rows.names, self._states()
        mine, out, wake = self._of_keys(ready), [], math.inf
        # a fold that acts on time alone may have something due at any key
        for key in [*mine, *(k for k in states if k not in mine)] if fold.due is not None and self.waits else mine:
            named = dict(zip(self.keys, key, strict=True))
            state = fold.unpack(states[key]) if key in states else None
            seen, missed = clocks.get(key, (None, 0))

            def lapse(before: float) -> None:
                nonlocal state, seen
                while fold.due is not None and state is not None:
                    at = fold.due(state)
                    if at is None or at >= before:
                        break
                    state, made = fold.lapse(state, named, at)
                    seen = at if seen is None else max(seen, at)
                    out.extend(made)

            for row in sorted(mine.get(key, ()), key=self._at):
                at = self._at(row)[0]
                lapse(at)
                state, made = fold.step(state, dict(zip(names, row, strict=True)))
                seen = at
                out.extend(made)
            if self.waits:
                lapse(until)
            if state is not None:
                packed = fold.pack(state)
                if packed:
                    states[key] = [tuple(p) for p in packed]
                else:
                    states.pop(key, None)
                at = fold.due(state) if fold.due else None
                if at is not None:
                    wake = min(wake, at)
            if seen is not None:
                clocks[key] = (seen, missed)
        self._put_states(states)
        self._put_clocks(clocks)
        if self.waits and wake < math.inf:
            self._wake(wake)
        return [r | {"late": False, "late_rows": None} for r in out] if self.late else out

    def _wake(self, at: float) -> None:
        self.handle.registerTimer(math.floor(at * 1000) + 1)

    def _frame(self, out: list[dict]) -> Iterator[pd.DataFrame]:
        if out:
            frame = pd.DataFrame({c: [r.get(c) for r in out] for c in self.out.names})
            for f in self.out.fields:
                if isinstance(f.dataType, IntegralType):
                    frame[f.name] = frame[f.name].astype("Int64")
                elif isinstance(f.dataType, StringType):
                    frame[f.name] = frame[f.name].astype(object)
            yield frame

    def close(self) -> None:
        pass


def _columns(rows: list[tuple]) -> tuple:
    return tuple(map(list, zip(*rows, strict=True)))


def fold_stream(df: DataFrame, fold: Fold, keys: tuple[str, ...] = ("room_id",), order: tuple[str, ...] = ("t", "frame_id"), late: bool = False) -> DataFrame:
    """Runs a fold over a stream that comes in order: rows of a micro-batch are sorted, rows older than what their key has seen are late.

    Late rows change nothing. They are counted in the key's state; with `late` they come out with the columns that the result shares with the input, `late` set and
    `late_rows`, the running number of them.
    """
    return _run(df, fold, keys, order, False, late)


def fold_in_order(df: DataFrame, fold: Fold, delay_s: float, grace_s: float = 0.0, keys: tuple[str, ...] = ("room_id",),
                  order: tuple[str, ...] = ("t", "frame_id"), late: bool = False) -> DataFrame:
    """Runs a fold over a stream whose rows (none of negative time) come up to `delay_s` out of order: they wait until the newest row of the stream is that much younger.

    So any arrival within the delay gives exactly what the rows in order give. Rows that are later, but at most `grace_s` more, are late rows as in
    `fold_stream`; still later ones are dropped by the engine and counted in the query progress (numRowsDroppedByWatermark).
    """
    marked = df.withColumn("_ts", F.timestamp_seconds(F.col(order[0]) + grace_s + 1)).withWatermark("_ts", f"{round((delay_s + grace_s + 1) * 1000)} milliseconds")
    return _run(marked, fold, keys, order, True, late)


def _run(df: DataFrame, fold: Fold, keys, order, waits: bool, late: bool) -> DataFrame:
    out = StructType.fromDDL(f"{fold.out}, late boolean, late_rows bigint" if late else fold.out)
    rows = StructType([StructField(f.name, f.dataType) for f in df.schema.fields if f.name != "_ts"])
    return df.withColumn("_group", F.pmod(F.xxhash64(*keys), F.lit(GROUPS))).groupBy("_group").transformWithStateInPandas(
        OrderedFold(fold, StructType.fromDDL(fold.state), rows, list(keys), list(order), out, waits, late), outputStructType=out, outputMode="Append",
        timeMode="EventTime" if waits else "None")
