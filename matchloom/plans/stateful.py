"""Keyed folds whose next state depends on the state itself.

Rows are shuffled by key, sorted inside the partitions, and streamed through a small
per-key state; a key is never held in memory as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def fold_rows(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable, schema: str) -> DataFrame:
    """Stream each key's rows in order through ``step(state, row) -> (state, list of dicts)``.

    ``step`` is called once more with row None at the end of a key to flush.
    Output rows get the key columns added.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, out = None, None, []

        def emit(k, rows):
            for r in rows:
                out.append({**dict(zip(keys, k)), **r})

        for pdf in batches:
            cols = list(pdf.columns)
            for vals in zip(*(pdf[c].tolist() for c in cols)):
                row = dict(zip(cols, vals))
                k = tuple(row[c] for c in keys)
                if k != key:
                    if key is not None:
                        emit(key, step(state, None)[1])
                    key, state = k, start()
                state, rows = step(state, row)
                emit(k, rows)
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if key is not None:
            emit(key, step(state, None)[1])
        if out:
            yield pd.DataFrame(out, columns=names)

    # By a hash of the keys: a repartition by the keys themselves is dropped after a join on them, whose shuffle may be read by mapper
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
