"""Functions over all rows of a key, in order, streamed from sorted partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TYPES = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def grouped(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """fn(rows of one key, as dicts, in order) -> result rows.

    One shuffle by key and a sort inside partitions; a task holds one key's rows at a
    time, and no frame is built for each of many small keys.
    """
    fields = [f.split() for f in schema.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, TYPES[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []
        for b in batches:
            for r in b.to_pylist():
                k = tuple(r[c] for c in keys)
                if held and k != key:
                    out += fn(held)
                    held = []
                    if len(out) >= 10_000:
                        yield batch(out)
                        out = []
                key = k
                held.append(r)
        if held:
            out += fn(held)
        yield batch(out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
