"""Joins by keys of which a few may hold much of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot with more than one in so many of all rows; so there are fewer hot keys than this, whatever the table's size.
ONE_IN = 1000


def look_up(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """The inner join of rows with table, which has each key once and in column n the number of its rows; both are saved tables.

    Hot keys, fewer than ONE_IN, are broadcast; each of the others, of at most a thousandth of the rows, meets its rows by a shuffle.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(table.where(F.col(n) * ONE_IN > total).drop(n))
    cold = table.where(F.col(n) * ONE_IN <= total).drop(n)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))
