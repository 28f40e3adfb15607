"""Emitters whose only memory is the last row they kept: throttle, dead band, dwell.

Which row follows a kept row depends on that row alone, so the kept rows form a
chain of "next" pointers. Each slab is reduced to its possible entry rows and the
row its chain would leave from. Two neighbours combine to the entries and exits of
both together, so a tree over a key's slabs gives what each was entered with in a logarithmic
number of steps; no task sees more than two neighbours. Every slab then replays its own chain
from the row it was really entered on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ambientspark.operators.slabs import SLAB, add_slab, hashed, stage


@dataclass(frozen=True)
class Throttle:
    """Keep a row when at least `gap` seconds passed since the last kept one."""
    gap: float

    def first(self, state, t, x):
        i = int(np.searchsorted(t - state[0], self.gap))
        return i if i < len(t) else None

    def following(self, t, x):
        return _search(t, self.gap)

    def entries(self, t, x):
        return np.arange(min(len(t), int(np.searchsorted(t - t[0], self.gap)) + 1))


@dataclass(frozen=True)
class Dwell:
    """Keep a row when `gap` seconds passed AND its signature differs from the last kept one."""
    gap: float

    def first(self, state, t, x):
        ok = np.flatnonzero((t - state[0] >= self.gap) & (x != state[1]))
        return int(ok[0]) if len(ok) else None

    def following(self, t, x):
        n = len(t)
        due = _search(t, self.gap)
        other = np.append(_next_change(x), n)
        due_x = np.append(x, None)[due]
        return np.where((due < n) & (due_x == x), other[due], due)

    def entries(self, t, x):
        starts = np.arange(min(len(t), int(np.searchsorted(t - t[0], self.gap)) + 1))
        changes = _next_change(x)[starts]
        return np.unique(np.concatenate([starts, changes[changes < len(t)]]))


@dataclass(frozen=True)
class DeadBand:
    """Keep a row when it differs by at least `width` from the last kept one."""
    width: float

    def first(self, state, t, x):
        lo, size = 0, 256
        while lo < len(x):
            ok = np.flatnonzero(np.abs(x[lo:lo + size] - state[1]) >= self.width)
            if len(ok):
                return lo + int(ok[0])
            lo, size = lo + size, 2 * size
        return None

    def following(self, t, x):
        return None  # searched along the chains that are really walked

    def entries(self, t, x):
        high, low = np.maximum.accumulate(x), np.minimum.accumulate(x)
        record = np.ones(len(x), dtype=bool)
        record[1:] = (x[1:] > high[:-1]) | (x[1:] < low[:-1])
        return np.flatnonzero(record)


def _search(t, gap):
    """First index whose distance from each row reaches gap, by the same subtraction the rule uses."""
    n = len(t)
    j = np.searchsorted(t, t + gap)
    for _ in range(2):  # t + gap may round to the other side of the exact difference
        back = (j > 0) & (t[np.maximum(j - 1, 0)] - t >= gap) & (j - 1 > np.arange(n))
        j = np.where(back, j - 1, j)
        short = (j < n) & (t[np.minimum(j, n - 1)] - t < gap)
        j = np.where(short, j + 1, j)
    return np.maximum(j, np.arange(n) + 1)


def _next_change(x):
    """Index of the first later row with another value; n where there is none."""
    n = len(x)
    out = np.full(n, n)
    cut = np.flatnonzero(x[1:] != x[:-1]) + 1
    if len(cut):
        pos = np.searchsorted(cut, np.arange(n), side="right")
        out[pos < len(cut)] = cut[pos[pos < len(cut)]]
    return out


def _chain(rule, t, x, start):
    """Indices kept in this slab once `start` is kept."""
    nxt, i, kept = rule.following(t, x), start, []
    while i is not None and i < len(t):
        kept.append(i)
        if nxt is not None:
            i = int(nxt[i])
        else:
            step = rule.first((t[i], x[i]), t[i + 1:], x[i + 1:])
            i = None if step is None else i + 1 + step
    return kept


def _exits(rule, t, x, entries):
    """Last kept index for every possible entry; chains that meet are walked once."""
    nxt, last = rule.following(t, x), {}
    for e in entries:
        path, i = [], int(e)
        while i not in last:
            path.append(i)
            if nxt is not None:
                j = int(nxt[i])
            else:
                step = rule.first((t[i], x[i]), t[i + 1:], x[i + 1:])
                j = len(t) if step is None else i + 1 + step
            if j >= len(t):
                last[i] = i
                break
            i = j
        end = last[i]
        last.update((p, end) for p in path)
    return [last[int(e)] for e in entries]


def whole_slabs(batches, part):
    """(table, edges) pairs out of record batches sorted by slab: whole slabs only, slab i being
    rows edges[i]:edges[i + 1]."""
    import pyarrow as pa
    held, held_id = [], None
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        ids = [batch.column(c).to_numpy(zero_copy_only=False) for c in part]
        new = np.zeros(n, dtype=bool)
        for col in ids:
            new[1:] |= col[1:] != col[:-1]
        new[0] = bool(held) and tuple(col[0] for col in ids) != held_id
        held_id = tuple(col[-1] for col in ids)
        starts = np.flatnonzero(new)
        if len(starts):
            offset = sum(b.num_rows for b in held)
            edges = np.unique(np.concatenate([[0], offset + starts]))
            yield pa.Table.from_batches([*held, batch.slice(0, starts[-1])]), edges
            held = [batch.slice(starts[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held), np.array([0, sum(b.num_rows for b in held)])


def slab_tables(batches, part):
    """Slabs one by one."""
    for table, edges in whole_slabs(batches, part):
        for lo, hi in zip(edges, edges[1:]):
            yield table.slice(lo, hi - lo)


def _entered(summary: DataFrame, keys: list[str], types: dict[str, str], rule, entry_ddl: str, x_type: str, x_dtype) -> DataFrame:
    """What each slab of a key is entered with: keys, slab, in_t, in_x (null for the first), from the slabs' entries and exits.

    Up the tree: the entries of two neighbours are those of the left one, led on through the right one, and those of the
    right one that something may still enter past the left one. Down the tree: the left child is entered as its parent, the right one with what the
    left one makes of that.
    """
    import pyarrow as pa
    index = Window.partitionBy(*keys).orderBy(SLAB)
    slabs = stage(summary.select(*keys, SLAB).distinct().withColumn("_node", F.row_number().over(index).cast("bigint") - 1))
    top = slabs.agg(F.max("_node")).first()[0]
    key_ddl = "".join(f"{c} {types[c]}, " for c in keys)
    group = [*keys, "_pair"]

    def paired(level: DataFrame, *more: str) -> DataFrame:
        df = level.withColumns({"_pair": F.shiftright("_node", 1), "_right": F.col("_node").bitwiseAND(F.lit(1).cast("bigint"))})
        return hashed(df, group, ["_right", *more, "pos"])

    def columns(table):
        t, exit_t = (table.column(c).to_numpy().astype(float) for c in ("t", "exit_t"))
        x, exit_x = (table.column(c).to_numpy(zero_copy_only=False).astype(x_dtype) for c in ("x", "exit_x"))
        return t, x, exit_t, exit_x

    def combined(batches):
        for table in slab_tables(batches, group):
            t, x, exit_t, exit_x = columns(table)
            cut = int(np.searchsorted(table.column("_right").to_numpy(), 1))
            out_t, out_x, led = exit_t.copy(), exit_x.copy(), {}
            for i in range(cut if cut < len(t) else 0):
                left = (exit_t[i], exit_x[i])
                if left not in led:
                    j = rule.first(left, t[cut:], x[cut:])
                    led[left] = left if j is None else (exit_t[cut + j], exit_x[cut + j])
                out_t[i], out_x[i] = led[left]
            keep = np.asarray(rule.entries(t, x))
            here = table.take(pa.array(keep))
            yield from pa.table(
                [*[here.column(c) for c in (*keys, "_pair")], pa.array(np.arange(len(keep))), here.column("t"), here.column("x"), pa.array(out_t[keep]),
                 pa.array(out_x[keep].tolist(), here.column("x").type)],
                names=[*keys, "_node", "pos", "t", "x", "exit_t", "exit_x"]).to_batches()

    def passed_on(batches):
        for table in slab_tables(batches, group):
            t, x, exit_t, exit_x = columns(table)
            head = table.slice(0, 1).to_pylist()[0]
            came = None if head["in_t"] is None else (head["in_t"], head["in_x"])
            left = np.flatnonzero((table.column("_right").to_numpy() == 0) & (table.column("pos").to_numpy() >= 0))
            j = 0 if came is None else rule.first(came, t[left], x[left])
            leaves = came if j is None else (exit_t[left[j]], exit_x[left[j]])
            children = [(2 * head["_pair"], came), *([(2 * head["_pair"] + 1, leaves)] if table.column("_right").to_numpy()[-1] == 1 else [])]
            yield pa.RecordBatch.from_pylist([{**{c: head[c] for c in keys}, "_node": node, "in_t": None if e is None else float(e[0]), "in_x": None if e is None else e[1]}
                                              for node, e in children], schema=states)

    levels = [summary.join(slabs, [*keys, SLAB]).drop(SLAB)]
    while top >> (len(levels) - 1):
        levels.append(stage(paired(levels[-1]).mapInArrow(combined, f"{key_ddl}_node bigint, {entry_ddl}")))
    state_ddl = f"{key_ddl}_node bigint, in_t double, in_x {x_type}"
    states = _arrow_schema(state_ddl)
    entered = levels[-1].select(*keys, "_node").distinct().withColumns({"in_t": F.lit(None).cast("double"), "in_x": F.lit(None).cast(x_type)})
    for level in reversed(levels[:-1]):
        # the state leads its pair; of the right child one row tells that it is there
        rows = level.filter("_node % 2 = 0 OR pos = 0")
        lead = entered.select(*keys, F.shiftleft("_node", 1).alias("_node"), "in_t", "in_x", F.lit(-1).cast("bigint").alias("pos"))
        entered = stage(paired(rows.unionByName(lead, allowMissingColumns=True)).mapInArrow(passed_on, state_ddl))
    return entered.join(slabs, [*keys, "_node"]).select(*keys, SLAB, "in_t", "in_x")


def _arrow_schema(ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))


def keep_chain(df: DataFrame, keys: list[str], order: list[str], slab_s: float, rule,
               value: Column | None = None) -> DataFrame:
    """Rows of df the rule keeps, per key in `order`; the first row of a key is always kept."""
    import pyarrow as pa
    t_col, part, columns = order[0], [*keys, SLAB], df.columns
    rows = add_slab(df.withColumn("_x", F.lit(0.0) if value is None else value), t_col, slab_s)
    slim = rows.select(*part, *order, "_x")
    types = dict(slim.dtypes)
    key_ddl = ", ".join(f"{c} {types[c]}" for c in part)
    x_type = types["_x"]
    x_dtype = float if x_type == "double" else object

    def arrays(table):
        return (table.column(t_col).to_numpy().astype(float),
                table.column("_x").to_numpy().astype(x_dtype))

    def summarise(batches):
        for table, edges in whole_slabs(batches, part):
            t, x = arrays(table)
            entries, exits, pos = [], [], []
            for lo, hi in zip(edges, edges[1:]):
                e = np.asarray(rule.entries(t[lo:hi], x[lo:hi]))
                pos.append(e)
                entries.append(lo + e)
                exits.append(lo + np.asarray(_exits(rule, t[lo:hi], x[lo:hi], e)))
            entries, exits = np.concatenate(entries), np.concatenate(exits)
            at, out = table.take(pa.array(entries)), table.column("_x").take(pa.array(exits))
            cols = [*[at.column(c) for c in part], pa.array(np.concatenate(pos).astype("int64")), pa.array(t[entries]),
                    at.column("_x"), pa.array(t[exits]), out]
            yield from pa.table(cols, names=[*part, "pos", "t", "x", "exit_t", "exit_x"]).to_batches()

    entry_ddl = f"pos bigint, t double, x {x_type}, exit_t double, exit_x {x_type}"
    summary = stage(hashed(slim, part, order).mapInArrow(summarise, f"{key_ddl}, {entry_ddl}"))
    carry = _entered(summary, keys, types, rule, entry_ddl, x_type, x_dtype)
    # The carry of a slab travels as its leading row, so the rows are shuffled once.
    both = (rows.withColumn("_row", F.lit(1))
            .unionByName(carry.withColumn("_row", F.lit(0)), allowMissingColumns=True))

    def replay(batches):
        for table, edges in whole_slabs(batches, part):
            t, x = arrays(table)
            in_t, in_x = table.column("in_t").to_numpy(), table.column("in_x").to_numpy()
            kept = []
            for lo, hi in zip(edges, edges[1:]):
                rows_t, rows_x = t[lo + 1:hi], x[lo + 1:hi]
                start = 0 if np.isnan(in_t[lo]) else rule.first((in_t[lo], in_x[lo]), rows_t, rows_x)
                if start is not None:
                    kept += [lo + 1 + i for i in _chain(rule, rows_t, rows_x, start)]
            yield from table.select(columns).take(pa.array(kept, type=pa.int64())).to_batches()

    return hashed(both, part, ["_row", *order]).mapInArrow(replay, df.schema)


def throttle(df: DataFrame, keys: list[str], order: list[str], slab_s: float, gap_s: float) -> DataFrame:
    """Greedy rate limit: at least gap_s between kept rows."""
    return keep_chain(df, keys, order, slab_s, Throttle(gap_s))


def deadband(df: DataFrame, keys: list[str], order: list[str], slab_s: float, value: Column,
             width: float) -> DataFrame:
    """Keep a row when its value moved at least `width` from the last kept value."""
    return keep_chain(df, keys, order, slab_s, DeadBand(width), value.cast("double"))


def emit_on_change(df: DataFrame, keys: list[str], order: list[str], slab_s: float, signature: Column,
                   dwell_s: float) -> DataFrame:
    """Keep a row when the dwell elapsed and its signature differs from the last kept one."""
    return keep_chain(df, keys, order, slab_s, Dwell(dwell_s), signature)
