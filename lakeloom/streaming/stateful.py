"""Aggregates with a state of their own, on streams and on tables.

The state is a tuple per group. On a stream Spark's state store keeps it between micro-batches, and a
group that a batch touches gives its new result; on a table every group starts anew and gives its
result once. Rows come in Arrow-backed frames of bounded size, never as one group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def stateful_aggregate(df: DataFrame, keys: list[str], start: tuple, step: Callable[[tuple, pd.DataFrame], tuple], result: Callable[[tuple], tuple], schema: str, state_schema: str) -> DataFrame:
    """``keys`` and the columns of ``schema`` for each group.

    ``step`` takes a state and some of a group's rows (a column _weight tells inserts from deletes,
    if there is one) and gives the next state; ``result`` gives the group's values from it. A step
    mustn't depend on how rows are cut into frames, nor, on tables, on their order.
    """
    types = dict(df.dtypes)
    out_schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), schema])

    def row(key: tuple, state: tuple) -> pd.DataFrame:
        return pd.DataFrame([(*key, *result(state))])

    if df.isStreaming:

        def run(key: tuple, frames: Iterator[pd.DataFrame], held: Any) -> Iterator[pd.DataFrame]:
            state = held.get if held.exists else start
            for frame in frames:
                state = step(state, frame)
            held.update(state)
            yield named(row(key, state))

        def named(frame: pd.DataFrame) -> pd.DataFrame:
            frame.columns = [*keys, *names]
            return frame

        names = [c.split()[0].strip("`") for c in _columns(schema)]
        return df.groupBy(*keys).applyInPandasWithState(run, out_schema, state_schema, "update", "NoTimeout")

    def whole(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = start
        for frame in frames:
            state = step(state, frame)
        yield row(key, state)

    return df.groupBy(*keys).applyInPandas(whole, out_schema)


def _columns(schema: str) -> list[str]:
    """The columns of a schema text; types may hold commas."""
    out, depth = [""], 0
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]
