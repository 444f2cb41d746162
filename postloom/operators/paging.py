"""Places of rows in an order over all of them, and pages found by counts.

Rows are written in ranges of the order, each sorted in a folder of its own; ranges have running counts, so a row's place is the
count before its range and its place within, and a page is read from the range or ranges that hold it, which alone are sorted.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.operators.scan import fresh
from postloom.shared import remove


class Ordered:
    """A frame in an order that tells all its rows apart, in a folder."""

    def __init__(self, df: DataFrame, order: list[Column], path: str, ranges: int | None = None) -> None:
        self.spark, self.columns, self.order, self.path = df.sparkSession, df.columns, order, path
        self.part = fresh(df.columns, "__range")
        ranged = df.repartitionByRange(ranges or int(self.spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn(self.part, F.spark_partition_id())
        ranged.sortWithinPartitions(self.part, *order).write.mode("overwrite").partitionBy(self.part).parquet(path)
        self.schema = ranged.schema
        counts = self._read().groupBy(self.part).agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each range
        self.ranges = sorted((r[0], r[1]) for r in counts)
        self.starts = [0, *accumulate(n for _, n in self.ranges)]

    def _read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def __len__(self) -> int:
        return self.starts[-1]

    def places(self, name: str = "place") -> DataFrame:
        """All rows with their place, from 1. No task has more than a range."""
        inside = F.row_number().over(Window.partitionBy(self.part).orderBy(*self.order))
        before = self.spark.createDataFrame([(k, s) for (k, _), s in zip(self.ranges, self.starts)], f"`{self.part}` int, `__before` long")
        return self._read().withColumn(name, inside).join(F.broadcast(before), self.part).select(*self.columns, (F.col(name) + F.col("__before")).alias(name))

    def held_by(self, start: int, size: int) -> list[int]:
        """The ranges that hold the rows from a place (from 0) on."""
        first, last = bisect_right(self.starts, start) - 1, bisect_right(self.starts, start + size - 1) - 1
        return [k for k, _ in self.ranges[first : last + 1]] if size > 0 and start < len(self) else []

    def page(self, page: int, size: int, most: int) -> DataFrame:
        """L1, L2: a page of rows in order; pages count from 1, and a page has at most `most` rows."""
        size = max(1, min(size, most))
        start = (max(1, page) - 1) * size
        parts = self.held_by(start, size)
        skipped = start - self.starts[[k for k, _ in self.ranges].index(parts[0])] if parts else 0
        return self._read().where(F.col(self.part).isin(parts)).orderBy(*self.order).offset(skipped).limit(size).select(*self.columns)

    def drop(self) -> None:
        remove(self.spark, self.path)
