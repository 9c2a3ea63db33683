"""Passes over small groups in order: sorted partitions are read in batches, so that a group costs no frame of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def _cut(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole groups with the places where groups begin, and the end."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        k = list(zip(*(t[c].to_pylist() for c in keys)))
        at = [0, *(i for i in range(1, len(k)) if k[i] != k[i - 1])]
        if at[-1]:
            yield t.slice(0, at[-1]), at
        rest = t.slice(at[-1])
    if rest is not None:
        yield rest, [0, rest.num_rows]


def folded(df: DataFrame, keys: list[str], order: list[str], step: Callable[[list[dict]], list[tuple]], out: str) -> DataFrame:
    """df with the columns that out names with their types: step turns a group's rows in order into as many tuples."""
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    names = [x.split()[0] for x in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}
        for t, at in _cut(batches, keys):
            rows = t.to_pylist()
            made = list(zip(*(x for i, j in zip(at, at[1:]) for x in step(rows[i:j]))))
            for n, x, values in zip(names, out.split(", "), made):
                t = t.append_column(n, pa.array(values, kinds[x.split()[1]]))
            yield from t.combine_chunks().to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, f"{own}, {out}")


def mapped(df: DataFrame, keys: list[str], order: list[str], step: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """The rows that step makes of each group's rows in order, under schema."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        arrow = to_arrow_schema(StructType.fromJson(kind))
        for t, at in _cut(batches, keys):
            rows = t.to_pylist()
            made = list(zip(*(x for i, j in zip(at, at[1:]) for x in step(rows[i:j]))))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(made, arrow)], schema=arrow)

    kind = df.sparkSession.createDataFrame([], schema).schema.jsonValue()
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
