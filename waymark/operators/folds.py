"""Ordered folds: rows that a running state accepts, each key's rows read in order as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def accepted(df: DataFrame, by: list[str], order: tuple[str, ...], reads: tuple[str, ...], step: Callable[[tuple | None, tuple], tuple[tuple, bool]]) -> DataFrame:
    """The rows of df that `step` accepts: step(state, row of reads) gives the next state and whether the row is taken.

    The state is None at the first row of a key and constant in size. A key's rows are sorted by Spark and pass through
    one task batch by batch, since each depends on the one before; they are never gathered.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            names = [pdf[c].astype(object).where(pdf[c].notna(), None) for c in by]
            take = []
            for own, row in zip(zip(*names, strict=True), pdf[list(reads)].itertuples(index=False, name=None), strict=True):
                if own != key:
                    key, state = own, None
                state, good = step(state, row)
                take.append(good)
            yield pdf[take]

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, df.schema)
