"""Sums and last values along an order, without a group in one task.

Rows are dealt by ranges of key and order and written once; for each key and range one
row is carried to the ranges that follow, and within a range a window does the rest. What
holds for a whole key reaches its rows by way of the same small rows, so that no join
has a key with more rows than a range.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import saved


@dataclass(frozen=True)
class Ranges:
    """Rows with the number of their range in ``part``."""

    rows: DataFrame
    key: tuple[str, ...]
    order: tuple[str, ...]

    def _carried(self, sums: dict[str, Column], lasts: dict[str, Column]) -> DataFrame:
        """(key, part) with what the ranges before hold."""
        latest = lambda v: F.max_by(v, F.when(v.isNotNull(), F.struct(*self.order)))
        each = self.rows.groupBy(*self.key, "part").agg(*(F.sum(v).alias(k) for k, v in sums.items()), *(latest(v).alias(k) for k, v in lasts.items()))
        before = W.partitionBy(*self.key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
        return each.select(*self.key, "part", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"_{k}") for k in sums), *(F.last(k, ignorenulls=True).over(before).alias(f"_{k}") for k in lasts))

    def along(self, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, facts: DataFrame | None = None) -> DataFrame:
        """The rows with ``sums`` over the rows before them, the ``lasts`` that are not null up to them, and the columns of ``facts`` (one row for each key)."""
        sums, lasts = sums or {}, lasts or {}
        carried = self._carried(sums, lasts)
        if facts is not None:
            carried = carried.join(facts, [*self.key], "left")
        within = W.partitionBy(*self.key, "part").orderBy(*self.order)
        before, upto = within.rowsBetween(W.unboundedPreceding, -1), within.rowsBetween(W.unboundedPreceding, 0)
        rows = self.rows.join(carried, [*self.key, "part"])
        own = {k: F.col(f"_{k}") + F.coalesce(F.sum(v).over(before), F.lit(0)) for k, v in sums.items()}
        own |= {k: F.coalesce(F.last(v, ignorenulls=True).over(upto), F.col(f"_{k}")) for k, v in lasts.items()}
        return rows.select(*rows.columns, *(v.alias(k) for k, v in own.items())).drop(*(f"_{k}" for k in own))


def ranged(rows: DataFrame, key: list[str], order: list[str], label: str) -> Ranges:
    """``rows`` dealt by ranges; no column of ``key`` is null, and rows of equal order stand in any one."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Ranges(saved(rows.repartitionByRange(parts, *key, *order).withColumn("part", F.spark_partition_id()), label), tuple(key), tuple(order))
