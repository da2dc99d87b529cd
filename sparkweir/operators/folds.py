"""Folds over a key's rows in order, one row at a time.

Spark deals the rows by key and sorts them within the partitions, on disk if
need be; a task then reads the sorted batches one after another and keeps only
the state of the key that it is at. So a key may have any number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that are given back at a time.
AT_A_TIME = 10_000


def fold(df: DataFrame, keys: list[str], order: list, schema: StructType, start: Callable[[tuple], object], step: Callable[[object, dict], Iterable[tuple]], end: Callable[[object], Iterable[tuple]] | None = None) -> DataFrame:
    """The rows that step and end give for each key.

    start(key) makes a key's state; step(state, row) may change it and gives
    rows of the schema; end(state) gives those after the last row. Null keys
    are a key. Rows that agree in order come in any order.
    """
    sorted_rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    kinds = to_arrow_schema(schema)

    def run(batches):
        at, state, out = None, None, []
        columns = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kinds)], schema=kinds)
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if at is None or key != at:
                    if at is not None and end:
                        out += end(state)
                    at, state = key, start(key)
                out += step(state, row)
                if len(out) >= AT_A_TIME:
                    yield columns(out)
                    out = []
        if at is not None and end:
            out += end(state)
        if out:
            yield columns(out)

    return sorted_rows.mapInArrow(run, schema)
