"""Folds along the rows of a key that no window can express, row by row with a state of fixed size.

Spark shuffles rows by key and sorts them; a task then streams through its keys' rows, so that a key may have any
number of them. Each key's fold is sequential by nature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

State = Any
#: Rows of a result that are handed back at once.
SLICE = 50_000


def folded(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], schema: str, start: Callable[[], State], step: Callable[[State, tuple], tuple[State, list[tuple]]],
    end: Callable[[State], list[tuple]] = lambda _: [],
) -> DataFrame:
    """Rows of ``schema`` from folding each key's rows by ``order``.

    ``step`` takes the state and a row's columns other than the keys and gives the next state and rows to put out, ``end`` gives those
    after a key's last row; the keys' values come before their columns. Null keys are a key; an empty input gives no rows.
    """
    kind = StructType.fromDDL(schema)
    others = [c for c in df.columns if c not in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key: tuple | None = None
        state: State = None

        def flush() -> pa.RecordBatch:
            names = kind.names
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

        for b in batches:
            ks = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * b.num_rows
            rows = zip(*(b.column(c).to_pylist() for c in others), strict=True)
            for k, row in zip(ks, rows, strict=True):
                if k != key:
                    if key is not None:
                        out.extend((*key, *r) for r in end(state))
                    key, state = k, start()
                state, made = step(state, row)
                out.extend((*k, *r) for r in made)
            if len(out) > SLICE:
                yield flush()
        if key is not None:
            out.extend((*key, *r) for r in end(state))
        yield flush()

    types = [_ARROW[f.dataType.simpleString()] for f in kind.fields]
    # by the keys' hash: Spark drops a repartition by the keys that a join has dealt out by before, and may then split that join's keys
    placed = df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order) if keys else df.repartition(1).sortWithinPartitions(*order)
    return placed.mapInArrow(run, kind)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
