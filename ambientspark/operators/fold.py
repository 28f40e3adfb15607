"""User-defined ordered folds (`scan`) and the capped insertion-ordered map built on them."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from itertools import groupby
from operator import itemgetter

from pyspark.sql import DataFrame, Window, functions as F

from ambientspark.operators.slabs import SLAB, add_slab, hashed, stage


def scan(df: DataFrame, keys: list[str], order: list[str], slab_s: float, zero,
         step: Callable, out: str, max_rounds: int | None = None) -> DataFrame:
    """Fold step(state, row: dict) -> (state, dict | None) over each key in order.

    Emits the rows step returns, with the columns of the DDL `out`. The state must be
    JSON-serialisable and equal states must serialise equally. Every slab that another one follows is first folded
    from `zero`. Then, round by round, a slab whose predecessor ended in another state than it was folded from is folded
    again, and the slabs after it in the same run as long as their states change too. Runs have 1, 2, 4... slabs, so
    the result is the sequential one after as many rounds as the number of slabs has binary digits, and two or three
    for folds that forget their start (caps, resets, time-outs). A run is streamed, row by row. Nothing waits for the end of a key's
    last slab, so a key of one slab is folded once, for its rows. A null key is a key; rows without a time come first.
    """
    import pyarrow as pa
    part = [*keys, SLAB]
    placed = add_slab(stage(df), order[0], slab_s)
    over = Window.partitionBy(*keys).orderBy(SLAB)
    slabs = stage(placed.select(*part).distinct().withColumns(
        {"_nth": F.row_number().over(over).cast("bigint") - 1, "_followed": F.lead(F.lit(True), 1, False).over(over)}))
    types, columns = dict(placed.dtypes), placed.columns
    key_ddl = ", ".join(f"{c} {types[c]}" for c in part)
    start = json.dumps(zero)
    state_ddl = f"{key_ddl}, _nth bigint, state_in string, state_out string"
    ended_schema, schema = _arrow(state_ddl), _arrow(out)

    def led(states, of):
        """Rows with the states of their slabs as leading rows."""
        return of.withColumn("_row", F.lit(1)).unionByName(states.withColumn("_row", F.lit(0)), allowMissingColumns=True)

    def on_slab(left, right, how):
        right = right.withColumnsRenamed({c: f"_of_{c}" for c in part})
        same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in part]
        return left.join(right, reduce(lambda a, b: a & b, same), how).drop(*[f"_of_{c}" for c in part])

    def told(batches):
        """Slab number and leading row or row, in order."""
        nth = 0
        for batch in batches:
            is_row = batch.column("_row").to_pylist()
            leading = iter(batch.take(pa.array([i for i, r in enumerate(is_row) if not r], pa.int64())).to_pylist())
            for r, values in zip(is_row, zip(*(batch.column(c).to_pylist() for c in columns))):
                nth += not r
                yield nth, dict(zip(columns, values)) if r else next(leading)

    def by_slab(batches):
        """(leading row, rows) of each slab; the rows are streamed."""
        for _, slab in groupby(told(batches), itemgetter(0)):
            yield next(slab)[1], (row for _, row in slab)

    def again(batches):
        """Runs of slabs in order; `want` is set where a slab is known to start from another state."""
        run = state = None
        ends: list[dict] = []
        for head, rows in by_slab(batches):
            if (*(head[c] for c in keys), head["_run"]) != run:
                run, state = (*(head[c] for c in keys), head["_run"]), None
            if state is None:
                state = head["want"]
            if state is None or (state == head["state_in"] and head["state_out"] is not None):
                state = None  # as folded before, and so are those after it up to the next that is not
                continue
            value = json.loads(state)
            for row in rows:
                value, _ = step(value, row)
            ends.append({**{c: head[c] for c in part}, "_nth": head["_nth"], "state_in": state, "state_out": json.dumps(value)})
            state = ends[-1]["state_out"]
            if len(ends) >= 256:
                yield pa.RecordBatch.from_pylist(ends, schema=ended_schema)
                ends = []
        yield pa.RecordBatch.from_pylist(ends, schema=ended_schema)

    followed = slabs.filter("_followed").drop("_followed")
    if followed.isEmpty():
        entered = slabs.select(*part, F.lit(start).alias("state_in"))
    else:
        blank = followed.withColumns({"state_in": F.lit(None).cast("string"), "state_out": F.lit(None).cast("string"), "want": F.lit(start)})
        first = led(blank.withColumn("_run", F.col("_nth")), on_slab(placed, followed.select(*part), "left_semi"))
        states = stage(hashed(first, part, ["_row", *order]).mapInArrow(again, state_ddl))
        before = F.coalesce(F.lag("state_out").over(over), F.lit(start))
        rounds = 0
        while True:
            wrong = states.withColumn("want", before).filter("want <> state_in").select(*part, "want")
            if wrong.isEmpty():
                break
            if max_rounds is not None and rounds >= max_rounds:
                raise RuntimeError(f"fold did not settle in {max_rounds} rounds")
            rounds += 1
            due = on_slab(states.withColumn("_run", F.shiftright("_nth", rounds)), wrong, "left")
            # a run is taken from its first wrong slab on
            opened = F.max(F.col("want").isNotNull()).over(Window.partitionBy(*keys, "_run").orderBy(SLAB))
            due = due.withColumn("_open", opened).filter("_open").drop("_open")
            rows = on_slab(placed, due.select(*part, "_run"), "inner").withColumn("_nth", F.lit(None).cast("bigint"))
            redone = hashed(led(due, rows), [*keys, "_run"], [SLAB, "_row", *order]).mapInArrow(again, state_ddl)
            states = stage(on_slab(states, redone.select(*part, F.col("state_in").alias("_i"), F.col("state_out").alias("_o")), "left")
                           .select(*part, "_nth", F.coalesce("_i", "state_in").alias("state_in"), F.coalesce("_o", "state_out").alias("state_out")))
        entered = on_slab(slabs, states.select(*part, "state_out"), "left").select(*part, before.alias("state_in"))

    def emitted(batches):
        made: list[dict] = []
        for head, rows in by_slab(batches):
            state = json.loads(head["state_in"])
            for row in rows:
                state, result = step(state, row)
                if result is not None:
                    made.append(result)
                if len(made) >= 4096:
                    yield from pa.Table.from_pylist(made, schema=schema).to_batches()
                    made = []
        yield from pa.Table.from_pylist(made, schema=schema).to_batches()

    return hashed(led(entered, placed), part, ["_row", *order]).mapInArrow(emitted, out)


def _arrow(ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))


def recent_k(df: DataFrame, keys: list[str], order: list[str], slab_s: float, id_col: str, k: int) -> DataFrame:
    """Ids alive in a map capped at k after each row: re-inserting a live id keeps its slot,
    the oldest insertion is evicted first, and an evicted id re-enters as the newest."""
    def step(live, row):
        if row[id_col] not in live:
            live = (live + [row[id_col]])[-k:]
        return live, {**{c: row[c] for c in kept}, "live": live}

    kept = [*keys, *order] if id_col in (*keys, *order) else [*keys, *order, id_col]
    types = dict(df.dtypes)
    ddl = ", ".join(f"{c} {types[c]}" for c in kept) + f", live array<{types[id_col]}>"
    return scan(df.select(*kept), keys, order, slab_s, [], step, ddl)
