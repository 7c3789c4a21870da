"""Slices of ordered rows: pages, visible ranges, batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import Listing

L = Listing()


def visible_range(scroll_top: int, n: int, p: Listing = L) -> tuple[int, int]:
    """[start, end) of the rows that a scrolled view shows, with its overscan."""
    start = max(0, scroll_top // p.item_height - p.overscan)
    shown = -(-p.container_height // p.item_height)
    return start, min(n, scroll_top // p.item_height + shown + p.overscan)


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset + limit - 1 of the order; every task keeps at most offset + limit rows."""
    return df.orderBy(*order).offset(offset).limit(limit)


def first_rows(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def process_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, batch_size: int = L.batch_size) -> DataFrame:
    """``fn`` over batches of at most ``batch_size`` rows, wherever the rows are."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), batch_size):
                yield fn(f.iloc[lo : lo + batch_size])

    return df.mapInPandas(run, schema)


def scroll_metrics(scroll_top: int, n: int, p: Listing = L) -> dict[str, float]:
    total = n * p.item_height
    room = total - p.container_height
    return {"total_height": total, "visible_height": p.container_height, "scroll_top": scroll_top, "scroll_percent": scroll_top / room if room else 0.0}


def toggled(selected: tuple[int, ...], item: int, most: int = 3) -> tuple[int, ...]:
    """The items to compare after one was chosen: it goes if it is there, else it comes while there is room."""
    if item in selected:
        return tuple(x for x in selected if x != item)
    return (*selected, item) if len(selected) < most else selected
