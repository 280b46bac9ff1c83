"""As-of assignment: the latest marker at or before each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.ranges import PART, carried, in_parts


def latest_before(rows: DataFrame, key: str, order: tuple[str, ...], is_marker: Column, value: str, ranges: int | None = None) -> DataFrame:
    """``rows`` with ``marker``: ``value`` of the key's latest marker that is not after the row.

    A key's rows are dealt over ranges of the first order column, so a key that holds much of the table is shared by many
    tasks. ``ranges`` follows from the table's size.
    """
    dealt = in_parts(rows, order[0], ranges)
    return carried(dealt, [key], list(order), last={"marker": F.when(is_marker, F.col(value))}).drop(PART)
