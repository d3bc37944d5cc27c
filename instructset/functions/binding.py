"""Sharing one value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once for a row, however often ``use`` reads
    it. The optimizer repeats an expression wherever its column is read by a pushed-down
    filter, which is dear for regular expressions over long texts."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
