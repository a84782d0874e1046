"""Places in a global order without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Ranges that the rows are dealt into.
RANGES = 64


def with_place(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """df with place (long, from 1): the row's number in the given order, which key, a number, must follow.

    Quantiles of the key cut the rows into ranges; a row's place is its number in its range and the rows in the ranges
    before, which are counted first. The driver holds a number for each range. Rows of one key are in one range."""
    keyed = df.withColumn("_key", key.cast("double"))
    cuts = sorted(set(keyed.approxQuantile("_key", [i / RANGES for i in range(1, RANGES)], 1 / (4 * RANGES))))
    at = F.lit(0)
    for i, c in enumerate(cuts, 1):
        at = F.when(F.col("_key") > c, i).otherwise(at)
    ranged = keyed.withColumn("_range", at)
    before, total = [], 0
    counts = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}
    for i in range(len(cuts) + 1):
        before.append(total)
        total += counts.get(i, 0)
    start = F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), F.col("_range") + 1)
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)).cast("long")
    return ranged.withColumn("place", start + own).drop("_key", "_range")
