"""Row numbers over whole tables without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Leading hex digits of the key that cut a group into ranges.
DIGITS = 3


def ranked(df: DataFrame, by: list[str], key: Column, tie: str, name: str) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... within each group of ``by`` in the order of a hex ``key``.

    Rows are sorted within ranges of keys only; a range's first number comes from the counts of the
    ranges before it, a table of at most 16 ** DIGITS rows a group.
    """
    keyed = df.withColumn("_key", key).withColumn("_range", F.substring("_key", 1, DIGITS))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1) if by else Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy(*by, "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    counts = counts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_of"), "_before")
    same = F.col("_range") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    place = F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_key", tie))
    out = keyed.withColumn("_place", place).join(counts, same)
    return out.withColumn(name, (F.col("_place") + F.col("_before")).cast("long")).drop("_key", "_range", "_place", "_before", "_of", *[f"_by_{c}" for c in by])
