"""Listings that are walked page by page from where the last page ended.

A listing is written once, range-partitioned and sorted by its order, so that a page is found by its
first key: the files whose range ends before it are not read, and neither are the rows before it counted. The
walk has a bound and says how much there is in all, so that a cut listing never passes for a whole one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows of a page, and pages after which a walk ends.
PER_PAGE = 50
RANGE = "__range"
MOST_PAGES = 20


@dataclass(frozen=True)
class Listing:
    """A stored listing. ``order`` names columns that are never null and together unique; all ascending."""

    path: str
    order: tuple[str, ...]

    def write(self, rows: DataFrame) -> Listing:
        dealt = rows.repartitionByRange(*self.order).withColumn(RANGE, F.spark_partition_id())
        dealt.sortWithinPartitions(*self.order).write.mode("overwrite").parquet(self.path)
        return self

    def _stored(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._stored(spark).drop(RANGE)

    def page(self, spark: SparkSession, after: Sequence | None = None, size: int = PER_PAGE) -> DataFrame:
        """The first ``size`` rows after the given key, in order."""
        return self._after(self._stored(spark), after).drop(RANGE).orderBy(*self.order).limit(size)

    def _after(self, rows: DataFrame, after: Sequence | None) -> DataFrame:
        if after is not None:
            kinds = {f.name: f.dataType for f in rows.schema.fields}
            rows = rows.where(past([(c, kinds[c], value) for c, value in zip(self.order, after, strict=True)]))
        return rows

    def walk(self, spark: SparkSession, size: int = PER_PAGE, most: int = MOST_PAGES) -> tuple[DataFrame, int, bool]:
        """(rows with their page, how many rows there are, whether the walk left some out).

        The rows of the walk, ``size`` times ``most`` at most, pass through the driver: a page begins where the last one ended.
        """
        stored = self._stored(spark)
        shape = stored.drop(RANGE).schema
        # One row a range, as many as the writing job had tasks.
        counts = sorted((r[0], r[1]) for r in stored.groupBy(RANGE).count().collect())
        total = sum(n for _, n in counts)
        rows, after, low = [], None, counts[0][0] if counts else 0
        for number in range(1, most + 1):
            # The range where the last page ended and, after it, as many as hold a page.
            high, held = low, 0
            for at, n in counts:
                if at > low and held < size:
                    high, held = at, held + n
            near = stored.where(F.col(RANGE).between(low, high))
            page = self._after(near, after).orderBy(*self.order).limit(size).collect()
            rows += [(*[row[c] for c in shape.names], number) for row in page]
            if len(page) < size or len(rows) >= total:
                break
            after, low = tuple(page[-1][c] for c in self.order), page[-1][RANGE]
        return spark.createDataFrame(rows, T.StructType([*shape.fields, T.StructField("page", T.IntegerType())])), total, len(rows) < total


def past(key: Sequence[tuple[str, T.DataType, object]]) -> Column:
    """Keys after the given one. The first column's own bound stands alone, so that it reaches the scan."""
    found = F.lit(False)
    for column, kind, value in reversed(key):
        bound = F.lit(value).cast(kind)
        found = (F.col(column) > bound) | ((F.col(column) == bound) & found)
    first, kind, value = key[0]
    return (F.col(first) >= F.lit(value).cast(kind)) & found
