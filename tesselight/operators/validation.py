"""Held-out coverage, certificates after selection, stability and permutation nulls.

Folds and halves come from md5 ranks of row ids, so they are the same on any number of tasks and in
any engine. Fold counts are kept per cell; a training fold's counts are the cell's minus the
fold's, so rows are grouped once for all folds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binomial import exact_lower_udf, upper_tail_udf
from ..spec import LEAST_POSITIVES, Rule
from .capacity import settle, words_of
from .cube import cells_by_arrays
from .cube import cells as make_cells
from .ranking import ranked
from .search import TIE, centres, partition, scores, selected, winners, with_level


def _digest(seed: int, rep: Column | int, row_id: str) -> Column:
    rep = rep if isinstance(rep, Column) else F.lit(rep)
    return F.md5(F.concat_ws(":", F.lit(str(seed)), rep.cast("string"), F.col(row_id).cast("string")))


def folds(df: DataFrame, row_id: str, k: int = 5, repeats: int = 5, seed: int = 0) -> DataFrame:
    """(row, rep, fold): k folds, dealt in turn within each class in digest order."""
    every = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    placed = ranked(every, ["rep", "z"], _digest(seed, F.col("rep"), row_id), row_id, "_fold_place")
    return placed.withColumn("fold", F.pmod(F.col("_fold_place") - 1, F.lit(k)).cast("int")).drop("_fold_place")


def hashed_folds(df: DataFrame, row_id: str, k: int = 5, repeats: int = 5, seed: int = 0) -> DataFrame:
    """Folds by digest alone: no sort, for tables where exact stratification costs a shuffle."""
    every = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return every.withColumn("fold", F.pmod(F.conv(F.substring(_digest(seed, F.col("rep"), row_id), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int"))


def halves(df: DataFrame, row_id: str, seed: int = 0) -> DataFrame:
    """``df`` with ``first``: the half of rows with the lower digests, blind to the target."""
    n = df.count()
    placed = ranked(df, [], _digest(seed, 0, row_id), row_id, "_half_place")
    return placed.withColumn("first", F.col("_half_place") <= math.ceil(n / 2)).drop("_half_place")


def fold_cells(folded: DataFrame, features: list[str], widest: int, only: list[tuple[str, ...]] | None = None, encoding: str = "all_rows", ordered: dict[str, bool] | None = None) -> DataFrame:
    """(rep, _part, schema_id, d, features, cell, n, k, n_train, k_train), a row per fold and merged cell.

    ``_part`` is "rep-fold"; n and k are the fold's own rows, which the others are to predict. A cell
    without rows in a fold still trains there. ``encoding``: whether levels are merged as all rows
    ask for ("all_rows"; the target plays no part in it) or as each fold's training rows do
    ("train"; levels that they lack go with others where their column is merged).
    """
    if encoding not in ("all_rows", "train"):
        raise ValueError(f"unknown encoding: {encoding}")
    tagged = folded.select(*features, "z", F.concat_ws("-", "rep", "fold").alias("_part"))
    test = cells_by_arrays(tagged, features, widest, only, by="_part").persist()
    rep = F.split("_part", "-")[0]
    keys = ["schema_id", "d", "features", "cell"]
    every = test.groupBy(rep.alias("rep"), *keys).agg(F.sum("n").alias("n_all"), F.sum("k").alias("k_all"))
    parts = folded.groupBy(F.col("rep").cast("string").alias("rep"), F.concat_ws("-", "rep", "fold").alias("_part")).agg(F.count("*").alias("_rows")).persist()
    grid = every.join(parts.select("rep", "_part"), "rep").join(test.select("_part", "schema_id", "cell", "n", "k"), ["_part", "schema_id", "cell"], "left").fillna(0, ["n", "k"])
    grid = grid.select("rep", "_part", *keys, "n", "k", (F.col("n_all") - F.col("n")).alias("n_train"), (F.col("k_all") - F.col("k")).alias("k_train"))
    sizes = parts.collect()  # a row a fold
    of_rep = {r["rep"]: 0 for r in sizes}
    for r in sizes:
        of_rep[r["rep"]] += r["_rows"]
    if not sizes:
        return grid
    one = sizes[0]["rep"]  # each repeat holds every row once
    words = words_of(folded.where(F.col("rep").cast("string") == one), features)
    if encoding == "all_rows":
        raw = every.where(F.col("rep") == one).select(*keys, F.col("n_all").alias("n"))
        return settle(raw, words, of_rep[one], ordered).apply(grid, by=("rep", "_part"))
    # levels as the training rows have them: all rows' counts less the fold's
    own = cells_by_arrays(tagged, features, 1, by="_part").select("_part", F.col("features")[0].alias("col"), F.col("cell")[0].alias("label"), F.col("n").alias("_n"))
    fitted = words.join(parts.select("_part")).join(own, ["_part", "col", "label"], "left").withColumn("cnt", F.col("cnt") - F.coalesce("_n", F.lit(0))).drop("_n")
    train = grid.where("n_train > 0").select("_part", *keys, F.col("n_train").alias("n"))
    rows = {(r["_part"],): of_rep[r["rep"]] - r["_rows"] for r in sizes}
    return settle(train, fitted, rows, ordered, per=("_part",)).apply(grid, by=("rep",))


def _trained(cells: DataFrame) -> DataFrame:
    return cells.where("n_train > 0").select("_part", "schema_id", "d", "features", "cell", F.col("n_train").alias("n"), F.col("k_train").alias("k"))


def cross_validated(folded: DataFrame, schema: list[str], rule: Rule, encoding: str = "all_rows", ordered: dict[str, bool] | None = None) -> DataFrame:
    """(rep, fold, coverage, purity, mass): centres chosen on the other folds, measured on this one."""
    cells = fold_cells(folded, schema, len(schema), [tuple(schema)], encoding, ordered).persist()
    chosen = centres(_trained(cells), rule, by=["_part"]).where("is_centre").select("_part", "schema_id", "cell", F.lit(True).alias("chosen"))
    yes = F.coalesce("chosen", F.lit(False))
    out = cells.join(chosen, ["_part", "schema_id", "cell"], "left").groupBy("_part").agg(F.sum(F.when(yes, F.col("k")).otherwise(0)).alias("k_sel"), F.sum(F.when(yes, F.col("n")).otherwise(0)).alias("n_sel"), F.sum("k").alias("positives"), F.sum("n").alias("rows"))
    part = F.split("_part", "-")
    return out.select(part[0].cast("int").alias("rep"), part[1].cast("int").alias("fold"), "k_sel", "n_sel", F.try_divide("k_sel", "positives").alias("coverage"), F.try_divide("k_sel", "n_sel").alias("purity"), F.try_divide("n_sel", "rows").alias("mass"), "positives")


def summary(cv: DataFrame, k: int = 5) -> DataFrame:
    """Mean coverage and its standard error, widened for folds that share training rows."""
    total = F.sum("positives") / F.count_distinct("rep")
    wide = F.sqrt((1 / F.count("coverage") + F.lit(1 / (k - 1))) * F.var_samp("coverage"))
    reason = F.when(total < LEAST_POSITIVES, F.concat(F.lit(f"undetermined: fewer than {LEAST_POSITIVES} positives")))
    return cv.agg(F.when(total >= LEAST_POSITIVES, F.avg("coverage")).alias("coverage"), F.when(total >= LEAST_POSITIVES, wide).alias("std_error"), F.avg("purity").alias("purity"), F.count("coverage").alias("passes"), reason.alias("reason"))


def paired_gain(higher: DataFrame, lower: DataFrame, k: int = 5) -> DataFrame:
    """Mean gain in coverage of one schema over another on the same folds, its error and t."""
    both = higher.select("rep", "fold", F.col("coverage").alias("_h")).join(lower.select("rep", "fold", F.col("coverage").alias("_l")), ["rep", "fold"])
    gain = F.col("_h") - F.col("_l")
    se = F.sqrt((1 / F.count(gain) + F.lit(1 / (k - 1))) * F.var_samp(gain))
    out = both.agg(F.avg(gain).alias("gain"), se.alias("std_error"), F.count(gain).alias("passes"))
    return out.withColumn("t", F.try_divide("gain", "std_error"))


def sufficient_width(gains: dict[int, tuple[float, float | None]], start: int = 1, least_t: float = 2.0) -> int:
    """Smallest width that no wider one beats clearly: {d: (mean coverage, t against the kept one)}."""
    kept = start
    for d in sorted(gains):
        if d > kept and gains[d][1] is not None and gains[d][1] >= least_t and gains[d][0] > gains[kept][0]:
            kept = d
    return kept


def select_width(folded: DataFrame, branches_: list[list[str]], rule: Rule, encoding: str = "all_rows", ordered: dict[str, bool] | None = None, k: int = 5) -> tuple[int | None, DataFrame]:
    """(smallest sufficient width, gains): each branch on the same folds against the width kept so far.

    ``branches_``: a schema per width. Undetermined (None) without coverage at the first width.
    """
    spark = folded.sparkSession
    cv = {len(s): cross_validated(folded, s, rule, encoding, ordered).persist() for s in branches_}
    means = {d: summary(x, k).first()["coverage"] for d, x in cv.items()}
    kept, rows = None, []
    for d in sorted(cv):
        if means[d] is None:
            continue
        if kept is None:
            kept = d
            continue
        gain = paired_gain(cv[d], cv[kept], k).first()
        rows.append((d, kept, gain["gain"], gain["std_error"], gain["t"]))
        kept = sufficient_width({kept: (means[kept], None), d: (means[d], gain["t"])}, kept)
    for x in cv.values():
        x.unpersist()
    return kept, spark.createDataFrame(rows, "d int, against int, gain double, std_error double, t double")


def nested(folded: DataFrame, features: list[str], rule: Rule, widest: int = 2, encoding: str = "train", ordered: dict[str, bool] | None = None) -> DataFrame:
    """Per (rep, fold, d): the schema that the other folds choose, and what it covers on this one.

    One cube keyed by (rep, fold) serves every fold's whole search.
    """
    grid = fold_cells(folded, features, widest, None, encoding, ordered).persist()
    train = _trained(grid)
    won = winners(scores(train, rule, by=["_part"]), by=["_part"])
    chosen = centres(train, rule, by=["_part"]).where("is_centre").select("_part", "schema_id", "cell", F.lit(True).alias("chosen"))
    held = grid.join(won.select("_part", "schema_id"), ["_part", "schema_id"]).join(chosen, ["_part", "schema_id", "cell"], "left")
    yes = F.coalesce("chosen", F.lit(False))
    out = held.groupBy("_part", "d", "schema_id", "features").agg(F.sum(F.when(yes, F.col("k")).otherwise(0)).alias("k_sel"), F.sum("k").alias("positives"))
    part = F.split("_part", "-")
    return out.select(part[0].cast("int").alias("rep"), part[1].cast("int").alias("fold"), "d", "schema_id", "features", "k_sel", F.try_divide("k_sel", "positives").alias("coverage"))


def stability(chosen: DataFrame, reference: list[str] | None = None) -> DataFrame:
    """Per d: mean Jaccard of the folds' schemas, distinct ones, the mode and its share."""
    counted = chosen.groupBy("d", "features").agg(F.count("*").alias("c"))
    a, b = counted.select("d", F.col("features").alias("fa"), F.col("c").alias("ca")), counted.select("d", F.col("features").alias("fb"), F.col("c").alias("cb"))
    # over distinct schemas with their counts: equal pairs count c * (c - 1) / 2 times
    jac = F.size(F.array_intersect("fa", "fb")) / F.size(F.array_union("fa", "fb"))
    same = F.col("fa") == F.col("fb")
    times = F.when(same, F.col("ca") * (F.col("ca") - 1) / 2).otherwise(F.col("ca") * F.col("cb") / 2)
    mean = a.join(b, "d").groupBy("d").agg(F.try_divide(F.sum(jac * times), F.sum(times)).alias("mean_jaccard"))
    mode = counted.groupBy("d").agg(F.count("*").alias("n_schemas"), F.sum("c").alias("passes"), F.min(F.struct((-F.col("c")).alias("c"), "features")).alias("m"))
    out = mode.join(mean, "d").select("d", "n_schemas", F.coalesce("mean_jaccard", F.lit(1.0)).alias("mean_jaccard"), F.col("m.features").alias("mode"), (-F.col("m.c") / F.col("passes")).alias("mode_share"))
    if reference is not None:
        out = out.withColumn("is_reference", F.col("mode") == F.array(*[F.lit(c) for c in reference]))
    return out


def certify(cells: DataFrame, rule: Rule, tests: int) -> DataFrame:
    """Cells with p-value, p adjusted for ``tests``, lower bound at the level and decision, best first."""
    level = rule.alpha / max(1, tests)
    p = upper_tail_udf(F.col("k"), F.col("n"), F.lit(float(rule.tau)))
    out = cells.withColumn("p", p).withColumns({"p_adjusted": F.least(F.lit(1.0), F.col("p") * tests), "lower": exact_lower_udf(F.col("k"), F.col("n"), F.lit(level))})
    certified = (F.col("n") >= rule.min_rows) & (F.col("p") <= level)
    return out.withColumn("certified", certified).orderBy("p", F.desc("k"), "schema_id", "cell")


def certify_split(halved: DataFrame, features: list[str], rule: Rule, widest: int = 2, per_branch: bool = False, screen: str = "purity", ordered: dict[str, bool] | None = None) -> DataFrame:
    """Search the first half, test its winners' centres (``screen`` "all": all their cells) on the second.

    Levels are merged as all rows ask for, in both halves alike; the target plays no part in it.
    """
    if screen not in ("purity", "all"):
        raise ValueError(f"unknown screen: {screen}")
    merged = partition(halved, features, widest, ordered=ordered)
    pure = Rule(tau=rule.tau, alpha=rule.alpha, min_rows=rule.min_rows)
    found = merged.apply(make_cells(halved.where("first").drop("first"), features, widest)).persist()
    won = winners(scores(found, pure)).select("schema_id")
    marked = (found if screen == "all" else centres(found, pure).where("is_centre")).join(won, "schema_id").select("schema_id", "cell")
    held = merged.apply(make_cells(halved.where("not first").drop("first"), features, widest)).join(marked, ["schema_id", "cell"])
    count = F.count("*").over(Window.partitionBy("d") if per_branch else Window.partitionBy(F.lit(1)))
    tested = held.withColumn("tests", count)
    p = upper_tail_udf(F.col("k"), F.col("n"), F.lit(float(rule.tau)))
    return tested.withColumn("p", p).withColumns({"p_adjusted": F.least(F.lit(1.0), F.col("p") * F.col("tests")), "certified": F.col("p") <= rule.alpha / F.col("tests")})


def coverage_null(sizes: list[int], positives: int, rule: Rule, spark, replicates: int = 999, seed: int = 0) -> DataFrame:
    """(replicate, coverage) of one schema when its positives are dealt at random over its cells.

    ``sizes`` are the cells of one coarsened schema: a tenth of the rows at most.
    """
    level = rule.level(len(sizes))
    n = np.array(sizes)
    from ..functions.binomial import least_certified

    need = np.maximum(1, np.ceil(rule.tau * n - 1e-9)) if rule.kind == "purity" else least_certified(n, rule.tau, level, strict=rule.correction == "family")
    need = np.where(n >= rule.min_rows, need, n + 1)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b["id"]:
                k = np.random.default_rng([seed, int(r)]).multivariate_hypergeometric(n, positives, method="marginals")
                out.append(k[k >= need].sum() / positives if positives else 0.0)
            yield pd.DataFrame({"replicate": b["id"], "coverage": out})

    return spark.range(replicates).mapInPandas(draw, "replicate long, coverage double")


def p_value(null: DataFrame, column: str, observed: float) -> float:
    """(1 + replicates that reach the observed value) / (1 + replicates)."""
    hits, n = null.agg(F.count(F.when(F.col(column) >= observed - TIE, 1)), F.count("*")).first()
    return (1 + hits) / (1 + n)


def familywise_null(frame: DataFrame, features: list[str], rule: Rule, row_id: str, widest: int = 2, replicates: int = 99, seed: int = 0, ordered: dict[str, bool] | None = None) -> DataFrame:
    """(replicate, coverage): the most that any schema covers under one shared permutation of ``z``.

    A replicate keeps as many positives: rows take the values of z in digest order. Replicates go
    side by side in one cube, in blocks; the search's partitions hold for all of them, since the
    target plays no part in merging.
    """
    n, positives = frame.agg(F.count("*"), F.sum("z")).first()
    merged = partition(frame, features, widest, ordered=ordered)
    out = []
    for first in range(0, replicates, 32):
        reps = range(first, min(replicates, first + 32))
        every = frame.select(row_id, *features).withColumn("rep", F.explode(F.array(*[F.lit(r) for r in reps])))
        placed = ranked(every, ["rep"], _digest(seed, F.col("rep"), row_id), row_id, "_deal_place")
        dealt = placed.withColumn("z", (F.col("_deal_place") <= positives).cast("int")).drop(row_id, "_deal_place")
        cells = merged.apply(cells_by_arrays(dealt, features, widest, by="rep"), by=("rep",))
        out.append(scores(cells, rule, by=["rep"], wilson=False).groupBy(F.col("rep").cast("int").alias("replicate")).agg(F.max("coverage").alias("coverage")))
    null = out[0]
    for x in out[1:]:
        null = null.unionAll(x)
    return null


__all__ = ["folds", "hashed_folds", "halves", "fold_cells", "cross_validated", "select_width", "summary", "paired_gain", "sufficient_width", "nested", "stability", "certify", "certify_split", "coverage_null", "familywise_null", "p_value", "selected", "with_level"]
