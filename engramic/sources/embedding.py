"""The place of an embedding model: a user's function from texts to vectors, run on executors over batches.

No model and no network call is part of the engine; the function is imported where it runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embedded(df: DataFrame, embed: Callable[[list[str]], Sequence[Sequence[float]]], text: str = "content", vector: str = "vector", batch_rows: int = 256) -> DataFrame:
    """``df`` with the vector of each text; ``embed`` gets lists of at most ``batch_rows`` texts. A null text has
    a null vector and is not sent."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            known = s[s.notna()]
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            for lo in range(0, len(known), batch_rows):
                part = known.iloc[lo : lo + batch_rows]
                for i, v in zip(part.index, embed(part.tolist()), strict=True):
                    out[i] = [float(x) for x in v]
            yield out

    return df.withColumn(vector, run(F.col(text)))


def inserted(memories: DataFrame, enrich: Callable[[DataFrame], DataFrame], hooks: Sequence[Callable[[DataFrame], None]] = ()) -> DataFrame:
    """Memories after enrichment; each hook is called with them (a related-record update, an index)."""
    out = enrich(memories)
    for hook in hooks:
        hook(out)
    return out
