"""What the data look like before a search: profiles, dependencies, leakage."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import Target
from .cube import MISSING, cells_by_sets
from .encoding import capacity

DOMINANT, MOSTLY_MISSING, PLACEHOLDER_SHARE, STRENGTH = 0.90, 0.5, 0.05, 0.90
#: Labels that stand for "no value", without punctuation and in lower case.
PLACEHOLDERS = (
    "na", "nan", "null", "none", "nil", "missing", "unknown", "unspecified", "undefined", "unrecorded", "notrecorded",
    "notavailable", "notapplicable", "other", "blank", "empty",
)


def is_placeholder(label: Column) -> Column:
    """Whether a label, or a word of it, says that there is no value."""
    flat = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    words = F.split(label, r"[ \-_/]+")
    return (flat(label) == "") | flat(label).isin(*PLACEHOLDERS) | F.exists(words, lambda w: flat(w).isin(*PLACEHOLDERS))


def catalogue(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(col, value, n, share, place): each column's values, most frequent first; nulls are no values.

    One job for all columns; shares are of all rows.
    """
    columns = columns or df.columns
    n = df.count()
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    counted = stacked.where("value is not null").groupBy("col", "value").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("col").orderBy(F.desc("n"), "value"))
    return counted.withColumns({"share": F.col("n") / F.lit(max(n, 1)), "place": place})


def profiles(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: levels, the largest, singletons, missing, placeholders and flags."""
    columns = columns or df.columns
    n = df.count()
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    levels = stacked.groupBy("col", "value").agg(F.count("*").alias("n"))
    odd = F.col("value").isNotNull() & is_placeholder(F.col("value"))
    ranked = levels.withColumns({"_odd": odd, "_place": -F.row_number().over(Window.partitionBy("col").orderBy(F.asc_nulls_last("value")))})
    largest = F.max_by(F.coalesce("value", F.lit(MISSING)), F.struct("n", "_place"))
    out = ranked.groupBy("col").agg(
        F.count("*").alias("n_levels"),
        largest.alias("largest"),
        F.max("n").alias("largest_n"),
        F.count(F.when(F.col("n") == 1, 1)).alias("singletons"),
        F.coalesce(F.max(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.max_by("value", F.when(F.col("_odd"), F.struct("n", "_place"))).alias("placeholder"),
        F.coalesce(F.max(F.when(F.col("_odd"), F.col("n"))), F.lit(0)).alias("placeholder_n"),
    )
    rows = F.lit(max(n, 1))
    return out.withColumns(
        {
            "constant": F.col("n_levels") <= 1,
            "exceeds_capacity": F.col("n_levels") > capacity(n),
            "dominant": F.col("largest_n") / rows >= DOMINANT,
            "mostly_missing": F.col("missing") / rows >= MOSTLY_MISSING,
            "placeholder_level": F.col("placeholder_n") / rows >= PLACEHOLDER_SHARE,
        }
    )


def _maxima(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(pair, hit_xy, hit_yx): rows that the best guess of y from x, and of x from y, gets right."""
    names = sorted({c for p in pairs for c in p})
    counted = cells_by_sets(df.select(*names), names, 2, only=[tuple(sorted(p)) for p in pairs])
    best = lambda i: counted.groupBy("schema_id", "features", F.col("cell")[i].alias("_v")).agg(F.max("n").alias("m")).groupBy("schema_id", "features").agg(F.sum("m").alias("hit"))
    return best(0).withColumnRenamed("hit", "hit_ab").join(best(1).select("schema_id", F.col("hit").alias("hit_ba")), "schema_id").select(F.col("features")[0].alias("a"), F.col("features")[1].alias("b"), "hit_ab", "hit_ba")


def strength(hit: Column, rows: Column, majority: Column) -> Column:
    """How much better than the majority's share a guess is; 1 or 0 where there is no room."""
    share, base = hit / rows, majority / rows
    return F.when(base >= 1, F.when(share >= 1, 1.0).otherwise(0.0)).otherwise((share - base) / F.nullif(1 - base, F.lit(0.0)))


def dependencies(df: DataFrame, columns: list[str] | None = None, least: float = STRENGTH) -> DataFrame:
    """Pairs of columns where one (nearly) determines the other, strongest kinds first."""
    columns = sorted(columns or df.columns)
    n = df.count()
    hits = _maxima(df, list(combinations(columns, 2)))
    largest = catalogue_max(df, columns)
    a, b = (largest.select(F.col("col").alias(x), F.col("m").alias(f"m_{x}")) for x in "ab")
    rows = F.lit(n)
    out = hits.join(a, "a").join(b, "b").withColumns(
        {
            "strength_ab": strength(F.col("hit_ab"), rows, F.col("m_b")),
            "strength_ba": strength(F.col("hit_ba"), rows, F.col("m_a")),
            "exceptions_ab": rows - F.col("hit_ab"),
            "exceptions_ba": rows - F.col("hit_ba"),
        }
    )
    exact_ab, exact_ba = F.col("exceptions_ab") == 0, F.col("exceptions_ba") == 0
    kind = F.when(exact_ab & exact_ba, "equivalent").when(exact_ab | exact_ba, "exact").otherwise("approximate")
    out = out.withColumns({"kind": kind, "best": F.greatest("strength_ab", "strength_ba")})
    return out.where((F.col("best") >= least) | exact_ab | exact_ba).drop("m_a", "m_b").orderBy(F.expr("case kind when 'equivalent' then 0 when 'exact' then 1 else 2 end"), F.desc("best"), "a", "b")


def catalogue_max(df: DataFrame, columns: list[str]) -> DataFrame:
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("value")) for c in columns])).alias("x")).select("x.*")
    return stacked.groupBy("col", "value").agg(F.count("*").alias("n")).groupBy("col").agg(F.max("n").alias("m"))


def exact_dependencies(df: DataFrame, columns: list[str] | None = None) -> dict[str, set[str]]:
    """Which columns each column determines without exception."""
    out: dict[str, set[str]] = {}
    for r in dependencies(df, columns, least=2.0).collect():
        if r["exceptions_ab"] == 0:
            out.setdefault(r["a"], set()).add(r["b"])
        if r["exceptions_ba"] == 0:
            out.setdefault(r["b"], set()).add(r["a"])
    return out


def leakage(df: DataFrame, target: Target, columns: list[str] | None = None) -> DataFrame:
    """How well each column alone tells the target, strongest first."""
    z = target.indicator()
    columns = columns or [c for c in df.columns if c not in target.columns]
    stacked = df.select(z.alias("z"), F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("value")) for c in columns])).alias("x")).select("z", "x.*")
    levels = stacked.groupBy("col", "value").agg(F.sum("z").alias("k"), F.count("*").alias("n"))
    out = levels.groupBy("col").agg(F.sum(F.greatest("k", F.col("n") - F.col("k"))).alias("hit"), F.sum("k").alias("k"), F.sum("n").alias("n"), F.count("*").alias("n_levels"))
    out = out.withColumn("strength", strength(F.col("hit"), F.col("n"), F.greatest("k", F.col("n") - F.col("k"))))
    return out.select("col", "n_levels", (F.col("n") - F.col("hit")).alias("exceptions"), "strength").orderBy(F.desc("strength"), "col")


def axis_order(df: DataFrame, column: str, target_code: Column) -> DataFrame:
    """A column's values by mean target code, then more rows, then text."""
    counted = df.select(F.coalesce(F.col(column).cast("string"), F.lit(MISSING)).alias("value"), target_code.alias("z")).groupBy("value").agg(F.sum("z").alias("k"), F.count("*").alias("n"))
    mean = F.col("k") / F.col("n")
    return counted.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(mean, F.desc("n"), "value")))
