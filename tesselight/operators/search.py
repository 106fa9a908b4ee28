"""Scores of schemas, the winner of each width, and reports on single schemas.

All of it works on the cell table of :mod:`.cube`, which holds a row per occupied cell: rows of the
source are read once, whatever the number of schemas, values and floors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binomial import exact_lower_udf, exact_upper_udf, least_certified_strict_udf, least_certified_udf, least_pure, wilson_lower, z_udf
from ..spec import Rule
from .capacity import Partition, coarsened, settle, words_of
from .cube import cells as make_cells
from .cube import pruned_cells, value_cells
from .encoding import capacity

#: Slack for equal shares.
TIE = 1e-12


def with_level(cells: DataFrame, rule: Rule, by: list[str] | None = None) -> DataFrame:
    """``cells`` with ``level``, the level of each test in its schema.

    Where ``cells`` leaves out cells that hold no centre, ``tests`` says how many a schema has.
    """
    if rule.correction == "bonferroni" and "tests" in cells.columns:
        return cells.withColumn("level", rule.level(F.col("tests")))
    if rule.correction == "bonferroni":
        w = Window.partitionBy("schema_id", *(by or []))
        return cells.withColumn("level", rule.level(F.count("*").over(w)))
    return cells.withColumn("level", rule.level(F.lit(1)))


def selected(cells: DataFrame, rule: Rule) -> Column:
    """Whether a cell with ``level`` is a centre."""
    n, k = F.col("n"), F.col("k")
    enough = n >= rule.min_rows
    if rule.kind == "purity":
        return enough & (k >= least_pure(n, rule.tau))
    if rule.bound == "wilson":
        return enough & (wilson_lower(k, n, z_udf(F.col("level"))) >= rule.tau)
    least = (least_certified_strict_udf if rule.correction == "family" else least_certified_udf)(n, F.lit(float(rule.tau)), F.col("level"))
    return enough & (k >= least)


def centres(cells: DataFrame, rule: Rule, by: list[str] | None = None) -> DataFrame:
    """``cells`` with ``level`` and ``is_centre``."""
    leveled = with_level(cells, rule, by)
    return leveled.withColumn("is_centre", selected(leveled, rule))


def scores(cells: DataFrame, rule: Rule, by: list[str] | None = None, wilson: bool = True) -> DataFrame:
    """One row per schema: k_sel, n_centers, n_sel, coverage, mass, purity and the tie-break bound.

    ``by``: columns that tell several targets apart. Cells with ``tests`` and ``every`` (a schema's
    cells and rows) may leave out those without positives.
    """
    whole = "tests" in cells.columns
    marked = centres(cells, rule, by)
    keys = [*(by or []), "schema_id", "d", "features"]
    yes = F.col("is_centre")
    # all cells of a schema sum up to all rows: totals need no pass of their own
    out = marked.groupBy(*keys).agg(
        F.sum(F.when(yes, F.col("k")).otherwise(0)).alias("k_sel"),
        F.sum(yes.cast("long")).alias("n_centers"),
        F.sum(F.when(yes, F.col("n")).otherwise(0)).alias("n_sel"),
        (F.max("tests") if whole else F.count("*")).alias("n_cells"),
        F.sum("k").alias("positives"),
        (F.max("every") if whole else F.sum("n")).alias("rows"),
        *([F.max(wilson_lower(F.col("k"), F.col("n"), z_udf(F.col("level")))).alias("wilson")] if wilson else []),
    )
    some = (F.col("positives") > 0) & (F.col("rows") > 0)
    out = out.withColumn("k_sel", F.when(some, F.col("k_sel")).otherwise(0)).withColumn("n_sel", F.when(some, F.col("n_sel")).otherwise(0))
    return out.withColumns(
        {
            "coverage": F.when(some, F.col("k_sel") / F.col("positives")).otherwise(0.0),
            "mass": F.when(some, F.col("n_sel") / F.col("rows")).otherwise(0.0),
            "purity": F.try_divide(F.col("k_sel"), F.col("n_sel")),
        }
    )


def winners(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The best schema of each width: coverage, then fewer centres, less mass, higher bound, first."""
    order = [F.desc("coverage"), F.asc("n_centers"), F.asc("mass"), F.desc("wilson"), F.asc("schema_id")]
    w = Window.partitionBy(*(by or []), "d").orderBy(*order)
    return scored.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def total(raw: DataFrame) -> int:
    """Rows of a frame, from its raw cells: those of any one schema sum up to them."""
    first = raw.select("schema_id").limit(1)
    return raw.join(first, "schema_id", "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def searched_cells(frame: DataFrame, features: list[str], widest: int = 4, form: str = "arrow", only: list[tuple[str, ...]] | None = None, ordered: dict[str, bool] | None = None, exact: dict[str, set[str]] | None = None) -> DataFrame:
    """The cell table that searches score: schemas beyond the grid's capacity are merged.

    The table is kept: its cells are few against the rows that they sum up. ``exact`` (which columns
    determine which) leaves out schemas that only repeat a narrower one.
    """
    if exact:
        raw = pruned_cells(frame, features, widest, exact, capacity(frame.count()), form)[0].persist()
    else:
        raw = make_cells(frame, features, widest, only=only, form=form).persist()
    return coarsened(raw, frame, features, total(raw), ordered)


def partition(frame: DataFrame, features: list[str], widest: int = 4, only: list[tuple[str, ...]] | None = None, ordered: dict[str, bool] | None = None) -> Partition:
    """How a search over ``frame`` merges its schemas; the target plays no part."""
    raw = make_cells(frame.select(*features).withColumn("z", F.lit(0)), features, widest, only=only).persist()
    out = settle(raw, words_of(frame, features), total(raw), ordered)
    raw.unpersist()
    return out


def branches(frame: DataFrame, features: list[str], rule: Rule, widest: int = 4, form: str = "arrow", ordered: dict[str, bool] | None = None) -> DataFrame:
    """Winners over all combinations of ``features`` for the indicator ``z``."""
    return winners(scores(searched_cells(frame, features, widest, form, ordered=ordered), rule))


def searched_value_cells(frame: DataFrame, features: list[str], column: str, widest: int = 4, ordered: dict[str, bool] | None = None) -> DataFrame:
    """(value, schema_id, d, features, cell, n, k, tests, every): merged cells that hold a value of ``column``.

    The partitions are those of a search for any one value, as they depend on the features alone.
    """
    sizes, counted = value_cells(frame, features, column, widest)
    sizes = sizes.persist()
    merged = settle(sizes, words_of(frame, features), total(sizes), ordered)
    whole = merged.apply(sizes).withColumns({c: f.over(Window.partitionBy("schema_id")) for c, f in (("tests", F.count("*")), ("every", F.sum("n")))})
    return merged.apply(counted, by=("value",)).join(whole.select("schema_id", "cell", "n", "tests", "every"), ["schema_id", "cell"])


def branches_by_value(frame: DataFrame, features: list[str], column: str, rule: Rule, widest: int = 4, ordered: dict[str, bool] | None = None) -> DataFrame:
    """Winners for every value of ``column`` from one enumeration; void values are left out."""
    scored = scores(searched_value_cells(frame, features, column, widest, ordered), rule, by=["value"])
    return winners(scored.where(F.col("positives") / F.col("rows") < rule.tau), by=["value"])


def void_values(frame: DataFrame, column: str, rule: Rule) -> DataFrame:
    """(value, share, reason): values of ``column`` that need no search."""
    whole = frame.agg(F.count("*").alias("_rows"))  # one row
    each = frame.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).join(F.broadcast(whole))
    share = F.col("n") / F.col("_rows")
    return each.where(share >= rule.tau).select("value", share.alias("share"), F.lit("base rate reaches the floor").alias("reason"))


def prefix_series(frame: DataFrame, axes: list[str], rule: Rule, ordered: dict[str, bool] | None = None) -> DataFrame:
    """Scores of a branch's first one, two, ... axes: a rollup, each prefix merged for itself."""
    only = [tuple(axes[:i]) for i in range(1, len(axes) + 1)]
    return scores(searched_cells(frame, axes, len(axes), only=only, ordered=ordered), rule)


def report(frame: DataFrame, schema: list[str], rule: Rule, ordered: dict[str, bool] | None = None) -> DataFrame:
    """One row on one schema: scores, bounds and its centres by their lower bound."""
    cells = centres(searched_cells(frame, schema, len(schema), only=[tuple(schema)], ordered=ordered), rule)
    k, n = F.col("k"), F.col("n")
    bounded = cells.withColumns({"purity": k / n, "lower": exact_lower_udf(k, n, F.col("level")), "upper": exact_upper_udf(k, n, F.col("level"))})
    yes = F.col("is_centre")
    entry = F.struct((-F.col("lower")).alias("o"), "cell", "n", "k", "purity", "lower", "upper")
    out = bounded.groupBy("features").agg(
        F.count("*").alias("n_cells"),
        F.first("level").alias("level"),
        F.sum("n").alias("rows"),
        F.sum("k").alias("positives"),
        F.sum(F.when(yes, k).otherwise(0)).alias("k_sel"),
        F.sum(F.when(yes, n).otherwise(0)).alias("n_sel"),
        F.sum(yes.cast("long")).alias("n_centers"),
        F.max("purity").alias("max_purity"),
        F.max("lower").alias("max_lower"),
        F.sort_array(F.collect_list(F.when(yes, entry))).alias("centers"),
    )
    alpha = F.lit(float(rule.alpha))
    base = F.col("positives") / F.col("rows")
    return out.withColumns(
        {
            "prevalence": base,
            "coverage": F.coalesce(F.try_divide(F.col("k_sel"), F.col("positives")), F.lit(0.0)),
            "coverage_lower": exact_lower_udf(F.col("k_sel"), F.col("positives"), alpha),
            "mass": F.col("n_sel") / F.col("rows"),
            "purity_pooled": F.try_divide(F.col("k_sel"), F.col("n_sel")),
            "purity_pooled_lower": F.when(F.col("n_sel") > 0, exact_lower_udf(F.col("k_sel"), F.col("n_sel"), alpha)),
            "centers": F.transform("centers", lambda c: c.dropFields("o").withField("lift", F.try_divide(c["purity"], base))),
        }
    )


def gated(branches_: DataFrame, alpha: float = 0.01) -> DataFrame:
    """Branches with centres whose p-value, where there is one, is small enough (p_familywise first)."""
    p = [F.col(c) for c in ("p_familywise", "p_value") if c in branches_.columns]
    ok = F.coalesce(*p, F.lit(0.0)) <= alpha if p else F.lit(True)
    return branches_.where((F.col("n_centers") > 0) & ok)


def kept_levels(words: DataFrame, cells: DataFrame) -> DataFrame:
    """Catalogue entries (col, value) for which a scan found something: a semi-join."""
    return words.join(cells.select("col", "value").distinct(), ["col", "value"], "left_semi")


def top_centres(cells: DataFrame, rule: Rule, limit: int = 10) -> DataFrame:
    """The centres with most positives, then the higher bound, then the cell."""
    marked = centres(cells, rule).where("is_centre")
    bounded = marked.withColumn("lower", exact_lower_udf(F.col("k"), F.col("n"), F.col("level")))
    return bounded.orderBy(F.desc("k"), F.desc("lower"), "schema_id", "cell").limit(limit)


def zones(cells: DataFrame, rule: Rule, low: float = 0.4) -> DataFrame:
    """centre, mixed or low for each cell."""
    zone = F.when(F.col("is_centre"), "centre").when(F.col("k") / F.col("n") >= low, "mixed").otherwise("low")
    return centres(cells, rule).withColumn("zone", zone)
