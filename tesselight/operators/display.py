"""What a view of a branch shows: uncoarsened cells by text, grids, slices and point placement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..spec import Rule
from .cube import cells as make_cells
from .search import centres

MOST_POINTS = 10_000


def grid(frame: DataFrame, axes: list[str], rule: Rule) -> DataFrame:
    """The cells of one to three axes (or all four) with purity, opacity and zone."""
    cells = centres(make_cells(frame, axes, len(axes), only=[tuple(axes)]), rule)
    most = F.max("n").over(Window.partitionBy(F.lit(1)))
    share = F.col("k") / F.col("n")
    return cells.withColumns({"purity": share, "opacity": 0.2 + 0.8 * F.sqrt(F.col("n") / most), "zone": F.when(F.col("is_centre"), "centre").when(share >= 0.4, "mixed").otherwise("low")})


def slices(frame: DataFrame, axes: list[str], rule: Rule) -> DataFrame:
    """Four axes as one grid of the first three per value of the fourth, by ``slice``."""
    return grid(frame, axes, rule).withColumn("slice", F.col("cell")[3]).withColumn("cell", F.slice("cell", 1, 3))


def summary(cells: DataFrame) -> DataFrame:
    """Counts over a view: cells, rows, positives, and those of its centres."""
    yes = F.col("is_centre")
    return cells.agg(
        F.count("*").alias("cells"), F.sum("n").alias("rows"), F.sum("k").alias("positives"),
        F.sum(yes.cast("long")).alias("centres"), F.sum(F.when(yes, F.col("n")).otherwise(0)).alias("n_sel"), F.sum(F.when(yes, F.col("k")).otherwise(0)).alias("k_sel"),
    )


def points(frame: DataFrame, axes: list[str], row_id: str, limit: int = MOST_POINTS) -> DataFrame:
    """Rows to draw, at most ``limit`` by digest, each with its place in its cell's lattice.

    A cell of m points is a cube of side ceil(m ** (1/3)); steps shrink with the side.
    """
    drawn = frame.select(row_id, "z", *[F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias(c) for c in axes]).orderBy(F.md5(F.col(row_id).cast("string")), row_id).limit(limit)
    cell = Window.partitionBy(*axes)
    at = drawn.withColumns({"i": F.row_number().over(cell.orderBy(row_id)) - 1, "m": F.count("*").over(cell)})
    side = F.ceil(F.pow(F.col("m").cast("double"), F.lit(1 / 3)) - 1e-9)
    step = F.least(F.lit(0.052), F.coalesce(F.try_divide(F.lit(0.78), side - 1), F.lit(0.052)))
    off = lambda part: F.round((part - (F.col("side") - 1) / 2) * F.col("step"), 4)
    at = at.withColumns({"side": side, "step": step})
    return at.withColumns({"dx": off(F.col("i") % F.col("side")), "dy": off(F.floor(F.col("i") / F.col("side")) % F.col("side")), "dz": off(F.floor(F.col("i") / (F.col("side") * F.col("side"))))})


def humanised(column: str, names: dict[str, str]) -> str:
    """A column's display name: its translation with the raw name, or the raw name."""
    return f"{names[column]} ({column})" if column in names else column
