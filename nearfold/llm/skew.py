"""Joins with a table of one row a key, where a key may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one in so many rows is hot, so there are at most so many of them.
MOST = 1000
#: Fewer rows than these are no load for a task.
LEAST = 1000


def spread_join(rows: DataFrame, named: DataFrame, keys: list[str], times: str, total: int, how: str = "left") -> DataFrame:
    """rows joined (left or inner) with named, which has one row a key and in `times` how many of rows have it.

    total is the sum of times.  Both are read twice, so they should be saved tables.  Hot keys go to where the
    rows are, by a broadcast of at most MOST rows; all others are shuffled, and no task gets more rows of a key
    than a hot one has.  The column times is dropped.
    """
    bar = max(LEAST, -(-total // MOST))
    hot = named.where(F.col(times) > bar).drop(times)
    rest = named.where(F.col(times) <= bar).drop(times)
    here = rows.join(F.broadcast(hot), keys, "inner")
    mark = F.broadcast(hot.select(*keys))
    there = rows.join(mark, keys, "left_anti").join(rest, keys, how)
    return here.unionByName(there.select(*here.columns))
