"""Dictionaries, frequency order and grid-capacity coarsening.

A dictionary is one table (col, code, value, cnt) for all columns: the rank of each value among the
sorted distinct ones, missing (null or NaN) last as one level. Everything that coarsens works on
it, never on rows; rows meet it in joins that Spark broadcasts by its own size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, MapType

#: Rows that a coarsened grid has per cell, on average, at least.
ROWS_PER_CELL = 10


def capacity(rows: int) -> int:
    return max(1, rows // ROWS_PER_CELL)


def _value(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType
    if isinstance(kind, (ArrayType, MapType)):
        raise TypeError(f"{c}: arrays and maps are no categories")
    x = F.col(c)
    return F.when(F.isnan(x), None).otherwise(x) if isinstance(kind, (DoubleType, FloatType)) else x


def dictionary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(col, code, value, cnt): value as text; codes follow the column's own order."""
    parts = []
    for c in columns or df.columns:
        counted = df.select(_value(df, c).alias("v")).groupBy("v").agg(F.count("*").alias("cnt"))
        # one row per level from here on
        code = F.row_number().over(Window.partitionBy(F.lit(c)).orderBy(F.asc_nulls_last("v"))) - 1
        parts.append(counted.select(F.lit(c).alias("col"), code.cast("int").alias("code"), F.col("v").cast("string").alias("value"), "cnt"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def encode(df: DataFrame, columns: list[str], words: DataFrame) -> DataFrame:
    """Replace each of ``columns`` by its code; others stay."""
    for c in columns:
        own = words.where(F.col("col") == c).select(F.col("value").alias("_v"), F.col("code").alias("_c"))
        df = df.withColumn(c, _value(df, c).cast("string")).join(own, F.col(c).eqNullSafe(F.col("_v")), "left").withColumn(c, F.col("_c")).drop("_v", "_c")
    return df


def frequency_order(words: DataFrame) -> DataFrame:
    """``words`` with ``rank`` from 0: most frequent level first, ties by code."""
    return words.withColumn("rank", F.row_number().over(Window.partitionBy("col").orderBy(F.desc("cnt"), "code")) - 1)


def coarsen_nominal(words: DataFrame, levels: int) -> DataFrame:
    """``words`` with ``merged``: the levels - 1 most frequent stay, the rest become one.

    A column with no more levels than that keeps its codes.
    """
    ranked = frequency_order(words).withColumn("_n", F.count("*").over(Window.partitionBy("col")))
    merged = F.when(F.col("_n") <= levels, F.col("code")).when(F.lit(levels == 1), 0).otherwise(F.least(F.col("rank"), F.lit(levels - 1)))
    return ranked.withColumn("merged", merged.cast("int")).drop("_n", "rank")


def coarsen_ordered(words: DataFrame, levels: int) -> DataFrame:
    """``words`` with ``merged``: neighbouring levels join into groups of about equal rows."""
    col = Window.partitionBy("col")
    before = F.coalesce(F.sum("cnt").over(col.orderBy("code").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    group = F.floor(before * levels / F.sum("cnt").over(col))
    out = words.withColumn("_g", group).withColumn("_n", F.count("*").over(col))
    dense = F.dense_rank().over(col.orderBy("_g")) - 1
    return out.withColumn("merged", F.when(F.col("_n") <= levels, F.col("code")).otherwise(dense).cast("int")).drop("_g", "_n")


def apply_fitted(fitted: DataFrame, every: DataFrame, ordered: bool) -> DataFrame:
    """Merged codes for the levels of ``every`` under a dictionary fitted on other rows.

    An unseen level of a merged nominal column is "other" (the last group), of a merged ordered
    column the nearest lower fitted level's group (the first if there is none); in a column that
    was not merged it is a level of its own, after the others. Values compare as numbers when
    ``ordered``.
    """
    key = (lambda c: F.col(c).cast("double")) if ordered else F.col
    seen = fitted.select("col", F.col("value").alias("_v"), "merged", F.col("code").alias("_code"))
    joined = every.join(seen, (every["col"] == seen["col"]) & every["value"].eqNullSafe(seen["_v"]), "left").select(every["*"], seen["merged"].alias("_m"))
    facts = fitted.groupBy("col").agg(F.max("merged").alias("_top"), (F.max("merged") + 1 < F.count("*")).alias("_was_merged"))
    joined = joined.join(facts, "col")
    if ordered:
        w = Window.partitionBy("col").orderBy(F.asc_nulls_last(key("value"))).rowsBetween(Window.unboundedPreceding, 0)
        near = F.coalesce(F.last("_m", ignorenulls=True).over(w), F.lit(0))
    else:
        near = F.col("_top")
    fresh = F.col("_top") + F.dense_rank().over(Window.partitionBy("col").orderBy(F.col("_m").isNotNull(), F.asc_nulls_last("value")))
    merged = F.coalesce("_m", F.when(F.col("_was_merged"), near).otherwise(fresh)).cast("int")
    return joined.withColumn("merged", merged).drop("_m", "_top", "_was_merged")


def merge_states(levels: list[int]) -> list[list[int]]:
    """Every step of merging: the widest column (ties: the first) loses a level, none below one."""
    state, out = list(levels), [list(levels)]
    while max(state, default=1) > 1:
        state[state.index(max(state))] -= 1
        out.append(list(state))
    return out


def merge_state(levels: list[int], step: int) -> list[int]:
    """The state after ``step`` steps of :func:`merge_states`, without those before it.

    Down to some height the widest columns are level; of those at that height, the first ones have
    lost one more.
    """
    low, high = 1, max(levels, default=1)
    while low < high:  # the least height that all columns can be cut to
        mid = (low + high) // 2
        low, high = (low, mid) if sum(max(0, n - mid) for n in levels) <= step else (mid + 1, high)
    left = step - sum(max(0, n - low) for n in levels)
    out = [min(n, low) for n in levels]
    for i, n in enumerate(levels):
        if left and low > 1 and n >= low:
            out[i] -= 1
            left -= 1
    return out


def merge_steps(levels: list[int]) -> int:
    """Steps until every column has one level."""
    return sum(n - 1 for n in levels)


def occupied(cells: DataFrame, columns: list[str]) -> int:
    """Distinct combinations; counts, unlike approximate ones, are exact."""
    return cells.select(*columns).distinct().count()


def coarsen_to_capacity(coded: DataFrame, columns: list[str], words: DataFrame, ordered: dict[str, bool], rows: int) -> tuple[DataFrame, list[int]]:
    """``coded`` with columns merged just so far that occupied cells fit the capacity.

    The first state that fits is found by bisection, as merging never adds cells; each probe runs
    over the distinct cells, not over rows.
    """
    fit = capacity(rows)
    cells = coded.groupBy(*columns).agg(F.count("*").alias("_n")).cache()
    sizes = {r["col"]: r["n"] for r in words.groupBy("col").agg(F.count("*").alias("n")).collect()}
    levels = [sizes[c] for c in columns]

    def merged(df: DataFrame, state: list[int]) -> DataFrame:
        for c, k in zip(columns, state):
            if k < sizes[c]:
                own = words.where(F.col("col") == c)
                table = (coarsen_ordered if ordered.get(c) else coarsen_nominal)(own, k).select(F.col("code").alias("_c"), F.col("merged").alias("_m"))
                df = df.join(table, F.col(c) == F.col("_c")).withColumn(c, F.col("_m")).drop("_c", "_m")
        return df

    low, high = 0, merge_steps(levels)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if occupied(merged(cells, merge_state(levels, mid)), columns) <= fit else (mid + 1, high)
    cells.unpersist()
    return merged(coded, merge_state(levels, low)), merge_state(levels, low)
