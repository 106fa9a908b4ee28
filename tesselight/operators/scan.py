"""Global pattern scan: every value of every column as a target, with false-discovery control."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binomial import upper_tail_udf
from ..spec import Rule
from .search import centres, scores, searched_value_cells, winners


def discoveries(tested: DataFrame, q: float, p: str = "p") -> DataFrame:
    """Benjamini-Hochberg: ``tested`` with rank, threshold and whether it is discovered.

    A missing p counts as 1. Ranks come from running counts over distinct p-values.
    """
    filled = tested.withColumn(p, F.coalesce(p, F.lit(1.0)))
    counted = filled.groupBy(p).agg(F.count("*").alias("_c"))
    run = counted.withColumns({"rank": F.sum("_c").over(Window.partitionBy(F.lit(1)).orderBy(p)), "m": F.sum("_c").over(Window.partitionBy(F.lit(1)))})
    last = run.where(F.col(p) <= F.col("rank") * q / F.col("m")).agg(F.max(p).alias("_last"))
    return filled.join(run.select(p, "rank", "m"), p).join(F.broadcast(last)).withColumn("discovered", F.coalesce(F.col(p) <= F.col("_last"), F.lit(False))).drop("_last")


def scan(df: DataFrame, columns: list[str], rule: Rule, widest: int = 2, threshold: float = 0.2, q: float = 0.05, ordered: dict[str, bool] | None = None) -> DataFrame:
    """(col, value, features, coverage, n_centers, purity, p, discovered) by coverage.

    One enumeration per column serves all its values; values whose base rate reaches the floor are
    left out. p is the exact tail of the winner's pooled centres, times the schemas searched.
    """
    if "z" in columns:
        raise ValueError("z is the indicator's name: rename that column")
    out = None
    for c in columns:
        features = [x for x in columns if x != c]
        scored = scores(searched_value_cells(df.select(*columns), features, c, widest, ordered), rule, by=["value"])
        scored = scored.where((F.col("positives") > 0) & (F.col("positives") / F.col("rows") < rule.tau))
        tried = scored.withColumn("tried", F.count("*").over(Window.partitionBy("value")))
        best = Window.partitionBy("value").orderBy(F.desc("coverage"), "n_centers", "d", "mass", "schema_id")
        won = tried.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")
        p = F.when(F.col("n_centers") > 0, F.least(F.lit(1.0), F.col("tried") * upper_tail_udf(F.col("k_sel"), F.col("n_sel"), F.col("positives") / F.col("rows"))))
        part = won.select(F.lit(c).alias("col"), "value", "d", "features", "coverage", "n_centers", "purity", "mass", p.alias("p"))
        out = part if out is None else out.unionAll(part)
    return discoveries(out, q).where(F.col("discovered") & (F.col("coverage") >= threshold)).orderBy(F.desc("coverage"), "n_centers", "col", "value")


__all__ = ["scan", "discoveries", "centres", "winners"]
