"""Aggregates whose result does not depend on row order or partitioning.

A double ``sum`` adds in whatever order the partitions arrive, so two runs (or two
engines) can differ in the last bits -- enough to flip a rounded figure. These
accumulate in ``DECIMAL(38, 18)`` (exact, order-free) and return a double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = "decimal(38,18)"


def exact_sum(c: Column) -> Column:
    return F.sum(c.cast(EXACT)).cast("double")


def exact_avg(c: Column) -> Column:
    """Exact sum / count of non-null values (null when there are none)."""
    return F.try_divide(exact_sum(c), F.count(c).cast("double"))
