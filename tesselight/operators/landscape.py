"""The landscape of all scored schemas: bins, listings, frontier and curves over purity floors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binomial import SHARE_SLACK, least_certified_udf
from ..spec import Rule
from .search import TIE

BINS = 10


def x_axis(direction: str = "presence") -> str:
    """Coverage, or mass where the target's absence is searched."""
    return "coverage" if direction == "presence" else "mass"


def bin_of(share: Column) -> Column:
    """Ten intervals (l, u]; zero falls into the first."""
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.ceil(share * BINS - SHARE_SLACK).cast("int") - 1))


def placed(scored: DataFrame, direction: str = "presence") -> DataFrame:
    """``scored`` with its place: ix by x, iy by the number of centres against the most."""
    most = F.max("n_centers").over(Window.partitionBy("d"))
    x = F.col(x_axis(direction))
    return scored.withColumns({"x": x, "ix": bin_of(x), "iy": bin_of(F.coalesce(F.try_divide(F.col("n_centers"), most), F.lit(0.0)))})


def histogram(scored: DataFrame, direction: str = "presence", d: int | None = None) -> DataFrame:
    at = placed(scored, direction)
    if d is not None:
        at = at.where(F.col("d") == d)
    return at.groupBy("d", "ix", "iy").agg(F.count("*").alias("schemas"))


def cell(scored: DataFrame, d: int, ix: int, iy: int, offset: int = 0, limit: int = 50, direction: str = "presence") -> DataFrame:
    """Schemas of one bin: less mass, fewer centres, greater x, first."""
    at = placed(scored, direction).where((F.col("d") == d) & (F.col("ix") == ix) & (F.col("iy") == iy))
    return at.orderBy("mass", "n_centers", F.desc("x"), "schema_id").offset(offset).limit(limit)


def by_x(scored: DataFrame, d: int, ix: int, offset: int = 0, limit: int = 50, direction: str = "presence") -> DataFrame:
    """Schemas of one category of x: greater x, fewer centres, less mass, first."""
    at = placed(scored, direction).where((F.col("d") == d) & (F.col("ix") == ix))
    return at.orderBy(F.desc("x"), "n_centers", "mass", "schema_id").offset(offset).limit(limit)


def frontier(scored: DataFrame, cost: str = "centers", direction: str = "presence") -> DataFrame:
    """Per width, the schemas that reach more than any cheaper one (cost: centres, or conditions)."""
    price = F.col("n_centers") * (F.col("d") if cost == "conditions" else 1)
    order = Window.partitionBy("d").orderBy("cost", F.desc("x"), "n_centers", "schema_id").rowsBetween(Window.unboundedPreceding, -1)
    at = scored.where("n_centers > 0").withColumns({"x": F.col(x_axis(direction)), "cost": price})
    return at.withColumn("_best", F.max("x").over(order)).where(F.col("_best").isNull() | (F.col("x") > F.col("_best") + TIE)).drop("_best")


def floors(base: float, step: int = 5) -> list[float]:
    """Whole steps of percent above the base rate, up to 1."""
    first = math.floor(base * 100 / step + 1e-9) + 1
    return [i * step / 100 for i in range(first, 100 // step + 1)]


def curves(cells: DataFrame, rule: Rule, base: float, step: int = 5, direction: str = "presence", exclude: list[int] | None = None) -> DataFrame:
    """Per width and floor the best schema by (x, fewer centres, less mass), first wins.

    Cells meet the floors that they reach only: each cell's number of floors comes from its purity,
    so no grid of cells and floors is built for the purity rule.
    """
    grid = [t for t in floors(base, step) if rule.kind == "purity" or t < 1]
    if not grid:
        return cells.sparkSession.createDataFrame([], "d int, tau double, schema_id int, features array<string>, x double, n_centers long, n_sel long, n_certifying long, n_family long")
    taus = F.array(*[F.lit(t) for t in grid])
    kept = cells.where(~F.col("schema_id").isin(exclude)) if exclude else cells
    per_schema = kept.groupBy("schema_id", "d", "features").agg(F.sum("n").alias("rows"), F.sum("k").alias("positives"))
    n, k = F.col("n"), F.col("k")
    if rule.kind == "purity":
        reached = kept.where(n >= rule.min_rows).withColumn("tau", F.explode(F.filter(taus, lambda t: (k > 0) & (k / n >= t - SHARE_SLACK))))
    else:
        leveled = kept.withColumn("level", rule.level(F.count("*").over(Window.partitionBy("schema_id"))))
        at = leveled.where(n >= rule.min_rows).withColumn("tau", F.explode(F.filter(taus, lambda t: k / n > t)))
        reached = at.where(k >= least_certified_udf(n, F.col("tau"), F.col("level")))
    summed = reached.groupBy("schema_id", "tau").agg(F.sum("k").alias("k_sel"), F.sum("n").alias("n_sel"), F.count("*").alias("n_centers"))
    grid_rows = per_schema.withColumn("tau", F.explode(taus))
    out = grid_rows.join(summed, ["schema_id", "tau"], "left").fillna(0, ["k_sel", "n_sel", "n_centers"])
    share = F.try_divide(F.col("k_sel"), F.col("positives")) if direction == "presence" else F.col("n_sel") / F.col("rows")
    out = out.withColumns({"x": F.coalesce(share, F.lit(0.0)), "mass": F.col("n_sel") / F.col("rows")})
    w = Window.partitionBy("d", "tau")
    best = F.row_number().over(w.orderBy(F.desc("x"), "n_centers", "mass", "schema_id"))
    out = out.withColumns({"_r": best, "n_certifying": F.count(F.when(F.col("n_centers") > 0, 1)).over(w), "n_family": F.count("*").over(w)})
    return out.where("_r = 1").select("d", "tau", "schema_id", "features", "x", "n_centers", "n_sel", "n_certifying", "n_family")


def leaders(curve: DataFrame) -> DataFrame:
    """Stretches of floors that one width leads: start, end and floors of each.

    At a floor the greatest x leads; within the tie slack fewer centres, then the smaller width.
    Floors where nothing is reached don't break a stretch.
    """
    live = curve.where("n_centers > 0")
    top = F.max("x").over(Window.partitionBy("tau"))
    near = live.withColumn("_top", top).where(F.col("x") >= F.col("_top") - TIE)
    lead = near.withColumn("_r", F.row_number().over(Window.partitionBy("tau").orderBy("n_centers", "d"))).where("_r = 1")
    # one row per floor: at most a hundred
    along = Window.partitionBy(F.lit(1)).orderBy("tau")
    changed = F.coalesce((F.col("d") != F.lag("d").over(along)).cast("int"), F.lit(1))
    return lead.withColumn("_new", changed).withColumn("segment", F.sum("_new").over(along)).groupBy("segment", "d").agg(F.min("tau").alias("tau_from"), F.max("tau").alias("tau_to"), F.count("*").alias("floors"))


def winner_changes(curve: DataFrame) -> DataFrame:
    """Floors at which a width's winner differs from that of the floor before."""
    along = Window.partitionBy("d").orderBy("tau")
    return curve.where("n_centers > 0").withColumn("_before", F.lag("schema_id").over(along)).where(F.col("_before").isNotNull() & (F.col("_before") != F.col("schema_id"))).drop("_before")


def branch_series(curve: DataFrame, d: int) -> DataFrame:
    return curve.where(F.col("d") == d).select("tau", "x", "n_centers", "schema_id").orderBy("tau")


def envelope(curve: DataFrame) -> DataFrame:
    """The greatest x over widths at each floor."""
    return curve.groupBy("tau").agg(F.max("x").alias("x"), F.max_by("d", F.struct("x", -F.col("n_centers"), -F.col("d"))).alias("d"))


def rule_pool(curve: DataFrame, won: DataFrame) -> DataFrame:
    """Schemas on the curves together with the winners."""
    return curve.where("n_centers > 0").select("schema_id", "d", "features").unionByName(won.select("schema_id", "d", "features")).distinct()
