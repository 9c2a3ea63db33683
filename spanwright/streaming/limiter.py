"""A sliding-window rate limiter: a request is admitted if fewer than limit admitted ones lie within the window before it. A rejected one leaves no
trace, so a range count does not express it; it is a fold in order of time."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def fold(times: Iterable[int], held: deque, limit: int, window: int) -> list[bool]:
    """Admissions of times in order; held is the state and changes. limit 0 or less admits all."""
    out = []
    for t in times:
        while held and held[0] < t - window:
            held.popleft()
        ok = limit <= 0 or len(held) < limit
        if ok and limit > 0:
            held.append(t)
        out.append(ok)
    return out


def admitted(df: DataFrame, key: str, time: str, tie: str, limit: int, window: int) -> DataFrame:
    """df with admitted. A key's rows arrive sorted, in batches, and only the state of one key is held."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, deque()
        for pdf in batches:
            ok = []
            for k, t in zip(pdf[key], pdf[time]):
                if k != now:
                    now, held = k, deque()
                ok += fold([t], held, limit, window)
            yield pdf.assign(admitted=ok)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) + ", admitted boolean"
    return df.repartition(key).sortWithinPartitions(key, time, tie).mapInPandas(run, schema)


def admitted_stream(stream: DataFrame, key: str, time: str, limit: int, window: int) -> DataFrame:
    """The same for a stream with a long time column: state is the admitted times of a key, limit of them at most."""
    def step(k, batches, state):
        held = deque(state.get[0] if state.exists else [])
        rows = pd.concat(list(batches)).sort_values(time, kind="stable")
        ok = fold(rows[time].tolist(), held, limit, window)
        state.update((list(held),))
        yield rows.assign(admitted=ok)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema.fields) + ", admitted boolean"
    return stream.groupBy(key).applyInPandasWithState(step, schema, "held array<long>", "append", "NoTimeout")
