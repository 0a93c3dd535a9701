"""Handing results on: row by row, or as JSON lines."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row


def batches(rows: DataFrame, num: int) -> Iterator[list[Row]]:
    """The rows, ``num`` at a time; one partition is with the driver at once."""
    found = rows.toLocalIterator(prefetchPartitions=True)
    while part := list(islice(found, num)):
        yield part


def write_json(rows: DataFrame, folder: str) -> None:
    """A JSON object a line."""
    rows.write.mode("overwrite").json(folder)
