"""Rules: every occupied cell as a conjunction, with its parents; filters, facets and bars."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cube import cells as make_cells
from .landscape import bin_of

MOST_SCHEMAS = 400


def conditions() -> Column:
    return F.zip_with("features", "cell", lambda f, v: F.struct(f.alias("feature"), v.alias("value")))


def enumerate_rules(frame: DataFrame, wanted: list[tuple[str, ...]], min_rows: int = 1) -> DataFrame:
    """Cells of the schemas in ``wanted`` with purity, parents and the best generalisation.

    A parent drops one condition; the best generalisation is the purest rule over a subset of the
    conditions (ties: fewest conditions, then first).
    """
    if len(wanted) > MOST_SCHEMAS:
        raise ValueError(f"at most {MOST_SCHEMAS} schemas")
    features = sorted({f for s in wanted for f in s})
    wanted = [tuple(sorted(s)) for s in wanted]
    below = sorted({c for s in wanted for d in range(1, len(s) + 1) for c in combinations(s, d)}, key=lambda c: (len(c), c))
    cells = make_cells(frame, features, 4, only=below).select("d", "features", "cell", "n", "k").withColumns({"conditions": conditions(), "purity": F.col("k") / F.col("n")})
    chosen = F.concat_ws("+", "features").isin(["+".join(s) for s in wanted])
    rules = cells.where(chosen & (F.col("n") >= min_rows))
    subsets = rules.select("features", "cell", F.col("conditions").alias("own"), F.explode(F.filter(_subsets(F.col("conditions")), lambda s: F.size(s) > 0)).alias("part"))
    subsets = subsets.where(F.size("part") < F.size("own"))
    general = cells.select(F.col("conditions").alias("part"), F.col("n").alias("part_n"), F.col("k").alias("part_k"), F.col("purity").alias("part_purity"))
    met = subsets.join(general, "part")
    best = F.min(F.struct((-F.col("part_purity")).alias("o"), F.size("part").alias("size"), F.col("part").alias("conditions"), F.col("part_n").alias("n"), F.col("part_k").alias("k")))
    parent = F.when(F.size("part") == F.size("own") - 1, F.struct(F.col("part").alias("conditions"), F.col("part_n").alias("n"), F.col("part_k").alias("k")))
    family = met.groupBy("features", "cell").agg(best.dropFields("o", "size").alias("generalisation"), F.sort_array(F.collect_list(parent)).alias("parents"))
    out = rules.join(family, ["features", "cell"], "left")
    return out.select("d", "features", "cell", "conditions", "n", "k", "purity", "parents", "generalisation").orderBy(F.desc("purity"), F.desc("n"), "d", "features", "cell")


def _subsets(array: Column) -> Column:
    """All subsets of an array of at most four, in order."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda m: F.filter(array, lambda x, i: (F.floor(m / F.pow(F.lit(2.0), i)) % 2) == 1)))


def holding(rules: DataFrame, wanted: list[tuple[str, str]], widths: list[int] | None = None, without: list[str] | None = None) -> DataFrame:
    """Rules that hold all of the (feature, value) conditions, of given widths, less erased schemas."""
    for f, v in wanted:
        rules = rules.where(F.exists("conditions", lambda c: (c["feature"] == f) & (c["value"] == v)))
    if widths:
        rules = rules.where(F.col("d").isin(widths))
    if without:
        rules = rules.where(~F.concat_ws("+", "features").isin(without))
    return rules


def facets(rules: DataFrame) -> DataFrame:
    """How many rules hold each feature, and each of its values (value null: the feature)."""
    one = rules.select(F.explode("conditions").alias("c")).select("c.feature", "c.value")
    return one.rollup("feature", "value").agg(F.count("*").alias("rules"), F.grouping("feature").alias("_all")).where("_all = 0").drop("_all")


def bars(rules: DataFrame) -> DataFrame:
    """Rules per purity interval and width."""
    return rules.groupBy(bin_of(F.col("purity")).alias("bin"), "d").agg(F.count("*").alias("rules"))


def ranked(rules: DataFrame) -> DataFrame:
    w = Window.partitionBy("d").orderBy(F.desc("purity"), F.desc("n"), "features", "cell")
    return rules.withColumn("place", F.row_number().over(w))
