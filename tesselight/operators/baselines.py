"""Other ways to pick groups of rows, for comparison on held-out rows."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import Rule
from .cube import cells as make_cells
from .search import centres


def budgeted_schema(cells: DataFrame, rule: Rule, budget: int) -> DataFrame:
    """The schema whose best budget / d qualifying cells cover most; its cells, by positives."""
    ok = centres(cells, rule).where("is_centre")
    place = F.row_number().over(Window.partitionBy("schema_id").orderBy(F.desc("k"), "n", "cell"))
    taken = ok.withColumn("place", place).where(F.col("place") <= F.floor(F.lit(budget) / F.col("d")))
    total = taken.groupBy("schema_id").agg(F.sum("k").alias("covered"), F.count("*").alias("groups"))
    best = total.orderBy(F.desc("covered"), "groups", "schema_id").limit(1)
    return taken.join(best, "schema_id")


def greedy_cover(sets: dict[int, frozenset], costs: dict[int, int], budget: int) -> list[int]:
    """Budgeted greedy maximum coverage: best gain per cost, or the best single set if it beats that."""
    covered: set = set()
    chosen: list[int] = []
    spent = 0
    heap = [(-len(s) / costs[i], i, 0) for i, s in sets.items() if costs[i] <= budget]
    heapq.heapify(heap)
    while heap:
        _, i, turn = heapq.heappop(heap)
        if spent + costs[i] > budget:
            continue
        gain = len(sets[i] - covered)
        if not gain:
            continue
        if turn != len(chosen):  # gains only shrink: renew and put back
            heapq.heappush(heap, (-gain / costs[i], i, len(chosen)))
            continue
        chosen.append(i)
        covered |= sets[i]
        spent += costs[i]
    single = max((i for i in sets if costs[i] <= budget), key=lambda i: (len(sets[i]), -i), default=None)
    return [single] if single is not None and len(sets[single]) > len(covered) else chosen


def greedy_chain(scored: DataFrame, widest: int = 4) -> list[list[str]]:
    """Schemas that grow by one feature at a time, each the best that holds the one before."""
    chain: list[list[str]] = []
    for d in range(1, widest + 1):
        level = scored.where(F.col("d") == d)
        if chain:
            level = level.where(F.size(F.array_except(F.array(*[F.lit(c) for c in chain[-1]]), "features")) == 0)
        best = level.orderBy(F.desc("coverage"), "n_centers", "mass", "schema_id").limit(1).collect()
        if not best:
            break
        chain.append(list(best[0]["features"]))
    return chain


def tree_leaves(frame: DataFrame, features: list[str], depth: int = 3, min_rows: int = 1) -> DataFrame:
    """Leaves of a decision tree on indexed features: leaf, n, k."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    text = frame.select("z", *[F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias(c) for c in features])
    steps = [StringIndexer(inputCol=c, outputCol=f"_{c}", stringOrderType="alphabetAsc") for c in features]
    steps += [VectorAssembler(inputCols=[f"_{c}" for c in features], outputCol="_x"), DecisionTreeClassifier(labelCol="z", featuresCol="_x", maxDepth=depth, maxBins=1024, minInstancesPerNode=min_rows, leafCol="leaf")]
    return Pipeline(stages=steps).fit(text).transform(text).groupBy("leaf").agg(F.count("*").alias("n"), F.sum("z").cast("long").alias("k"))


def union_mask(groups: list[dict[str, str]]) -> Column:
    """Rows that any group (conjunction of column = value) holds."""
    out = F.lit(False)
    for g in groups:
        one = F.lit(True)
        for c, v in g.items():
            one = one & F.coalesce(F.col(c).cast("string") == v, F.lit(False))
        out = out | one
    return out


def held_out(frame: DataFrame, groups: list[dict[str, str]], tau: float) -> DataFrame:
    """n, k, coverage, purity and net coverage of a union of groups."""
    inside = union_mask(groups)
    out = frame.agg(F.sum(inside.cast("long")).alias("n"), F.sum(F.when(inside, F.col("z")).otherwise(0)).alias("k"), F.sum("z").alias("positives"))
    net = (F.col("k") - F.lit(tau / (1 - tau)) * (F.col("n") - F.col("k"))) / F.nullif(F.col("positives"), F.lit(0))
    return out.withColumns({"coverage": F.try_divide("k", "positives"), "purity": F.try_divide("k", "n"), "net_coverage": net})


def description_stability(masks: DataFrame) -> DataFrame:
    """Mean Jaccard of row masks: ``masks`` has (mask, row)."""
    sizes = masks.groupBy("mask").agg(F.count("*").alias("n"))
    a, b = (masks.select("row", F.col("mask").alias(x)) for x in "ab")
    shared = a.join(b, "row").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    sa, sb = (sizes.select(F.col("mask").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    # pairs that share no row count as 0: they are all pairs less those found
    jac = shared.join(sa, "a").join(sb, "b").agg(F.sum(F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("s"))
    return sizes.agg(F.count("*").alias("m")).join(F.broadcast(jac)).select(F.try_divide(F.coalesce("s", F.lit(0.0)) * 2, F.col("m") * (F.col("m") - 1)).alias("mean_jaccard"), F.col("m").alias("masks"))


def marks(t: Column) -> Column:
    """+, = or - at two standard errors."""
    return F.when(t >= 2, "+").when(t <= -2, "-").otherwise("=")


def comparison(results: DataFrame) -> DataFrame:
    """Pivot of marks per method: (method, plus, equal, minus, median_gain)."""
    m = marks(F.col("t"))
    return results.groupBy("method").agg(F.count(F.when(m == "+", 1)).alias("plus"), F.count(F.when(m == "=", 1)).alias("equal"), F.count(F.when(m == "-", 1)).alias("minus"), F.median("gain").alias("median_gain"))


def least_rows_table(levels: list[float], tau: float) -> list[tuple[float, int]]:
    """Rows that a pure cell needs at each level."""
    import math

    return [(a, math.ceil(math.log(a) / math.log(tau))) for a in levels]


def tarone_size(cells: DataFrame, tau: float, alpha: float) -> int:
    """Tests that count: the least m with at most m cells that could reach alpha / m at all."""
    sizes = [r["c"] for r in cells.groupBy("n").agg(F.count("*").alias("c")).orderBy("n").select("n", "c").collect()]
    ns = [r["n"] for r in cells.groupBy("n").agg(F.count("*").alias("c")).orderBy("n").collect()]
    m = 1
    while True:
        able = sum(c for n, c in zip(ns, sizes) if tau**n <= alpha / m)
        if able <= m:
            return m
        m = able


__all__ = ["budgeted_schema", "greedy_cover", "greedy_chain", "tree_leaves", "held_out", "description_stability", "comparison", "tarone_size", "least_rows_table", "make_cells"]
