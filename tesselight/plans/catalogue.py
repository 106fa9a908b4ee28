"""The registered queries, by group, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import binomial
from ..operators import baselines, capacity, comparison, cube, display, encoding, landscape, redundancy, rules, scan, screen, search, validation
from ..sources import frames
from ..sources.frames import EVENT_FEATURES, EVENTS_SQL, LINE_FEATURES, LINES_SQL, ORDER_FEATURES, ORDERS_SQL, PART_FEATURES, PARTS_SQL
from ..spec import Rule, Target, base_rate, certificate, framed, positive_value, resolve_target
from . import twins

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PURE = Rule(tau=0.5)
ORDER_RULE = Rule(tau=0.36)
EVENT_RULE = Rule(tau=0.22)
PART_RULE, SIZES = Rule(tau=0.3), {"p_size": True}
CERTIFIED = certificate("certified", tau=0.5, correction="bonferroni")


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def _flat(df: DataFrame) -> DataFrame:
    """Feature and cell arrays as text."""
    if "features" in df.columns:
        df = df.withColumn("features", F.concat_ws("+", "features"))
    if "cell" in df.columns:
        df = df.withColumn("cell", F.concat_ws("|", "cell"))
    return df


SCORED = ["schema_id", "d", "features", "k_sel", "n_centers", "n_sel", "coverage", "mass"]


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return frames.lines(spark, sf)


def _line_cells(spark: SparkSession, sf: str, widest: int = 3) -> DataFrame:
    return cube.cells(_lines(spark, sf), LINE_FEATURES, widest)


def _line_scores(spark: SparkSession, sf: str) -> DataFrame:
    return search.scores(_line_cells(spark, sf), PURE, wilson=False)


def _order_cells(spark: SparkSession, sf: str, form: str = "arrow") -> DataFrame:
    return cube.cells(frames.orders(spark, sf), ORDER_FEATURES, 3, form=form)


# sources, catalogue, targets


@query("""WITH x AS (SELECT 'p_brand' AS col, p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_size', p_size::VARCHAR FROM part)
SELECT col, value, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM part) AS share, row_number() OVER (PARTITION BY col ORDER BY count(*) DESC, value)::INT AS place FROM x WHERE value IS NOT NULL GROUP BY col, value""")
def catalog_part(spark: SparkSession, sf: str) -> DataFrame:
    return screen.catalogue(frames.parts(spark, sf), ["p_brand", "p_type", "p_size"])


@query(f"WITH f AS ({ORDERS_SQL}) SELECT count(*) AS rows, sum(z)::BIGINT AS positives, sum(z)::DOUBLE / count(*) AS share FROM f")
def base_rate_orders(spark: SparkSession, sf: str) -> DataFrame:
    df = frames.orders(spark, sf).drop("z", "id")
    frame = framed(df, resolve_target(df, "o_orderstatus", "F"))
    return frame.agg(F.count("*").alias("rows"), F.sum("z").cast("long").alias("positives"), (F.sum("z") / F.count("*")).alias("share"))


@query(f"""WITH f AS (SELECT o_orderpriority, r_name, (o_orderstatus = 'F' AND c_mktsegment = 'BUILDING')::INT AS z FROM ({ORDERS_SQL}))
SELECT o_orderpriority, r_name, count(*) AS n, sum(z)::BIGINT AS k FROM f GROUP BY ALL""")
def composite_target_orders(spark: SparkSession, sf: str) -> DataFrame:
    df = frames.orders(spark, sf).drop("z", "id", "n_name")
    frame = framed(df, Target("o_orderstatus", "F", (("c_mktsegment", "BUILDING"),)))
    return frame.groupBy(*[c for c in frame.columns if c != "z"]).agg(F.count("*").alias("n"), F.sum("z").cast("long").alias("k"))


@query("SELECT l_linestatus AS positive, count(*) AS n FROM lineitem WHERE l_linestatus = (SELECT max(l_linestatus) FROM lineitem) GROUP BY 1")
def positive_class_lines(spark: SparkSession, sf: str) -> DataFrame:
    df = frames.table(spark, sf, "lineitem")
    value = positive_value(df, "l_linestatus")
    return df.where(Target("l_linestatus", value).indicator() == 1).groupBy(F.lit(value).alias("positive")).agg(F.count("*").alias("n"))


# encoding and coarsening

WORDS = "w AS (SELECT p_size AS value, count(*) AS cnt, row_number() OVER (ORDER BY p_size) - 1 AS code FROM part GROUP BY p_size)"


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.dictionary(frames.parts(spark, sf), ["p_size"])


@query(f"WITH {WORDS} SELECT 'p_size' AS col, code::INT AS code, value::VARCHAR AS value, cnt FROM w")
def encode_part(spark: SparkSession, sf: str) -> DataFrame:
    return _sizes(spark, sf)


@query(f"WITH {WORDS} SELECT p_partkey, code::INT AS p_size FROM part JOIN w ON p_size = value")
def encoded_rows_part(spark: SparkSession, sf: str) -> DataFrame:
    df = frames.parts(spark, sf).select("p_partkey", "p_size")
    return encoding.encode(df, ["p_size"], encoding.dictionary(df, ["p_size"]))


@query(f"WITH {WORDS} SELECT value::VARCHAR AS value, cnt, (row_number() OVER (ORDER BY cnt DESC, code) - 1)::INT AS rank FROM w")
def level_order_part(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.frequency_order(_sizes(spark, sf)).select("value", "cnt", "rank")


@query(f"WITH {WORDS} SELECT value::VARCHAR AS value, least(row_number() OVER (ORDER BY cnt DESC, code) - 1, 11)::INT AS merged FROM w")
def coarsen_nominal_part(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.coarsen_nominal(_sizes(spark, sf), 12).select("value", "merged")


@query(f"""WITH {WORDS}, g AS (SELECT value, code, floor(coalesce(sum(cnt) OVER (ORDER BY code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 8 / (SELECT sum(cnt) FROM w)) AS g FROM w)
SELECT value::VARCHAR AS value, (dense_rank() OVER (ORDER BY g) - 1)::INT AS merged FROM g""")
def coarsen_ordered_part(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.coarsen_ordered(_sizes(spark, sf), 8).select("value", "merged")


@query("SELECT count(*) AS occupied FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem)")
def occupied_lines(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(encoding.occupied(frames.table(spark, sf, "lineitem"), LINE_FEATURES[:3]),)], "occupied long")


def _merged(widest: int, tail: str, tau: float = 0.3, only: list[tuple[str, ...]] | None = None, frame: str = PARTS_SQL) -> str:
    return twins.merged_search(frame, PART_FEATURES, widest, tau, tail, ("p_size",), only)


TRIPLE = [("p_brand", "p_type", "p_size")]


@query(_merged(3, "SELECT n FROM cells", only=TRIPLE))
def coarsened_to_capacity_part(spark: SparkSession, sf: str) -> DataFrame:
    """Brand x type x size merged until the cells fit: their sizes."""
    df = frames.parts(spark, sf).select(*PART_FEATURES)
    words = encoding.dictionary(df)
    merged, _ = encoding.coarsen_to_capacity(encoding.encode(df, PART_FEATURES, words), PART_FEATURES, words, SIZES, df.count())
    return merged.groupBy(*PART_FEATURES).agg(F.count("*").alias("n")).select("n")


@query(_merged(3, twins.BEST))
def branches_coarsened_part(spark: SparkSession, sf: str) -> DataFrame:
    """Winners where most schemas have too many cells."""
    return _flat(search.branches(frames.marked_parts(spark, sf), PART_FEATURES, PART_RULE, 3, ordered=SIZES)).select(*SCORED)


@query(" UNION ALL ".join(f"SELECT 'v{v}' AS value, * FROM ({_merged(2, twins.BEST, 0.4, frame=PARTS_SQL.replace('(p_partkey % 5 = 0)', f'(p_partkey % 5 = {v})'))})" for v in range(5)))
def branches_by_value_part(spark: SparkSession, sf: str) -> DataFrame:
    """Winners for every bucket: the same partitions, merged alike for all values."""
    frame = frames.marked_parts(spark, sf).select(*PART_FEATURES, "bucket")
    return _flat(search.branches_by_value(frame, PART_FEATURES, "bucket", Rule(tau=0.4), 2, SIZES)).select("value", *SCORED)


AXES = ["p_type", "p_size", "p_brand"]


@query(_merged(3, "SELECT schema_id, d, features, k_sel, n_centers, n_sel, coverage, mass FROM s", only=[tuple(AXES[:i]) for i in (1, 2, 3)]))
def prefix_series_part(spark: SparkSession, sf: str) -> DataFrame:
    """Each prefix merged for itself."""
    return _flat(search.prefix_series(frames.marked_parts(spark, sf), AXES, PART_RULE, SIZES)).select(*SCORED)


@query(
    _merged(
        2,
        """SELECT s.features, (SELECT count(*) FROM marked) AS n_cells, rows, positives, k_sel, n_sel, n_centers, (SELECT max(k::DOUBLE / n) FROM marked) AS max_purity,
        positives::DOUBLE / rows AS prevalence, coverage, mass, k_sel::DOUBLE / nullif(n_sel, 0) AS purity_pooled FROM s""",
        only=[("p_brand", "p_size")],
    )
)
def report_schema_part(spark: SparkSession, sf: str) -> DataFrame:
    out = _flat(search.report(frames.marked_parts(spark, sf), ["p_brand", "p_size"], PART_RULE, SIZES))
    return out.select("features", "n_cells", "rows", "positives", "k_sel", "n_sel", "n_centers", "max_purity", "prevalence", "coverage", "mass", "purity_pooled")


@query("""WITH p AS (SELECT p_size AS v, count(*) FILTER (p_partkey % 2 = 0) AS c FROM part GROUP BY ALL), f AS (SELECT v, row_number() OVER (ORDER BY c DESC, v) - 1 AS r FROM p WHERE c > 0)
SELECT p.v::VARCHAR AS value, CASE WHEN f.r IS NULL THEN 9 ELSE least(f.r, 9) END::INT AS merged FROM p LEFT JOIN f ON p.v = f.v""")
def fitted_levels_part(spark: SparkSession, sf: str) -> DataFrame:
    """Levels merged on half the rows, applied to all of them."""
    df = frames.parts(spark, sf)
    fitted = encoding.coarsen_nominal(encoding.dictionary(df.where("p_partkey % 2 = 0"), ["p_size"]), 10)
    return encoding.apply_fitted(fitted, encoding.dictionary(df, ["p_size"]), False).select("value", "merged")


# cells, cube, search


@query(f"WITH {twins.cells(ORDERS_SQL, ORDER_FEATURES, 3)}, {twins.marked(0.36)} SELECT schema_id, features, cell, n, k, k::DOUBLE / n AS purity FROM marked WHERE yes")
def cells_purity_orders(spark: SparkSession, sf: str) -> DataFrame:
    marked = search.centres(_order_cells(spark, sf), ORDER_RULE).where("is_centre")
    return _flat(marked).select("schema_id", "features", "cell", "n", "k", (F.col("k") / F.col("n")).alias("purity"))


@query(f"WITH {twins.cells(LINES_SQL, LINE_FEATURES, 3)} SELECT * FROM cells")
def cube_arrays_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(_line_cells(spark, sf))


@query(f"WITH {twins.cells(ORDERS_SQL, ORDER_FEATURES, 3)} SELECT * FROM cells")
def cube_sets_orders(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(_order_cells(spark, sf, "grouping_sets"))


@query(twins.lines("SELECT schema_id, d, features, k_sel, n_centers, n_sel, coverage, mass FROM s"))
def cube_scores_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(_line_scores(spark, sf)).select(*SCORED)


@query(twins.orders(twins.BEST))
def branches_orders(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(search.branches(frames.orders(spark, sf), ORDER_FEATURES, ORDER_RULE, 3)).select(*SCORED)


@query(twins.lines(twins.BEST, widest=4))
def branches_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(search.branches(_lines(spark, sf), LINE_FEATURES, PURE)).select(*SCORED)


@query(twins.search(LINES_SQL.replace("::INT AS z FROM", "::INT AS y FROM").replace("SELECT l_orderkey * 10", "SELECT 1 - y AS z, * FROM (SELECT l_orderkey * 10", 1) + ")", LINE_FEATURES, 3, 0.94, twins.BEST))
def absence_lines(spark: SparkSession, sf: str) -> DataFrame:
    frame = _lines(spark, sf).withColumn("z", 1 - F.col("z"))
    return _flat(search.branches(frame, LINE_FEATURES, Rule(tau=0.94), 3)).select(*SCORED)


BY_VALUE = " UNION ALL ".join(
    f"SELECT * FROM (WITH f AS (SELECT quarter, user_group, size, (event_type = '{v}')::INT AS z FROM ({EVENTS_SQL})), {twins.cells(EVENTS_SQL, EVENT_FEATURES, 2).split(', cells AS', 1)[1].join(['cells AS', ''])}, {twins.marked(0.22)}, {twins.SCORES} SELECT '{v}' AS value, * FROM ({twins.BEST}) WHERE EXISTS (SELECT 1 FROM f HAVING avg(z) < 0.22))"
    for v in ("click", "error", "purchase", "signup", "view")
)


@query(BY_VALUE)
def branches_by_value_events(spark: SparkSession, sf: str) -> DataFrame:
    frame = frames.events(spark, sf).select(*EVENT_FEATURES, "event_type", F.lit(0).alias("z"))
    return _flat(search.branches_by_value(frame, EVENT_FEATURES, "event_type", EVENT_RULE, 2)).select("value", *SCORED)


PREFIX = ["l_returnflag", "l_linenumber", "l_linestatus"]


@query(twins.search(LINES_SQL, PREFIX, 3, 0.5, "SELECT schema_id, d, features, k_sel, n_centers, n_sel, coverage, mass FROM s", only=[tuple(PREFIX[:i]) for i in (1, 2, 3)]))
def prefix_series_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(search.prefix_series(_lines(spark, sf), PREFIX, PURE)).select(*SCORED)


@query(
    twins.search(
        LINES_SQL, PREFIX, 2, 0.5,
        """SELECT s.features, (SELECT count(*) FROM marked) AS n_cells, rows, positives, k_sel, n_sel, n_centers, (SELECT max(k::DOUBLE / n) FROM marked) AS max_purity,
        positives::DOUBLE / rows AS prevalence, coverage, mass, k_sel::DOUBLE / nullif(n_sel, 0) AS purity_pooled FROM s""",
        only=[("l_returnflag", "l_linenumber")],
    )
)
def report_schema_lines(spark: SparkSession, sf: str) -> DataFrame:
    out = _flat(search.report(_lines(spark, sf), ["l_returnflag", "l_linenumber"], PURE))
    return out.select("features", "n_cells", "rows", "positives", "k_sel", "n_sel", "n_centers", "max_purity", "prevalence", "coverage", "mass", "purity_pooled")


@query(twins.lines("SELECT features, cell, n, k, CASE WHEN yes THEN 'centre' WHEN k::DOUBLE / n >= 0.4 THEN 'mixed' ELSE 'low' END AS zone FROM marked"))
def zones_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(search.zones(_line_cells(spark, sf), PURE)).select("features", "cell", "n", "k", "zone")


@query(twins.lines("SELECT features, cell, n, k FROM marked WHERE yes ORDER BY k DESC, k::DOUBLE / n DESC, schema_id, cell LIMIT 10"))
def top_centres_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The ten centres with most positives; among equal k, a higher share has the higher bound."""
    return _flat(search.top_centres(_line_cells(spark, sf), PURE)).select("features", "cell", "n", "k")


# landscape


@query(twins.lines(f", {twins.PLACED} SELECT d, ix, iy, count(*) AS schemas FROM p GROUP BY ALL").replace("mass FROM scores) ,", "mass FROM scores),"))
def landscape_bins_lines(spark: SparkSession, sf: str) -> DataFrame:
    return landscape.histogram(_line_scores(spark, sf))


@query(twins.lines(f", {twins.PLACED} SELECT schema_id, features, coverage, n_centers, mass FROM p WHERE d = 2 AND ix = 0 AND iy = 0 ORDER BY mass, n_centers, coverage DESC, schema_id LIMIT 5"))
def landscape_cell_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(landscape.cell(_line_scores(spark, sf), 2, 0, 0, limit=5)).select("schema_id", "features", "coverage", "n_centers", "mass")


@query(twins.lines(f", {twins.PLACED} SELECT schema_id, features, coverage, n_centers, mass FROM p WHERE d = 3 AND ix = 6 ORDER BY coverage DESC, n_centers, mass, schema_id LIMIT 5"))
def x_category_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(landscape.by_x(_line_scores(spark, sf), 3, 6, limit=5)).select("schema_id", "features", "coverage", "n_centers", "mass")


def _frontier_sql(cost: str) -> str:
    return twins.lines(f"""SELECT d, schema_id, features, {cost} AS cost, coverage AS x FROM (SELECT *, max(coverage) OVER (PARTITION BY d ORDER BY {cost}, coverage DESC, n_centers, schema_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s WHERE n_centers > 0) WHERE b IS NULL OR coverage > b + 1e-12""")


@query(_frontier_sql("n_centers"))
def frontier_centers_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(landscape.frontier(_line_scores(spark, sf))).select("d", "schema_id", "features", "cost", "x")


@query(_frontier_sql("n_centers * d"))
def frontier_conditions_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(landscape.frontier(_line_scores(spark, sf), "conditions")).select("d", "schema_id", "features", "cost", "x")


GRID = f"WITH f AS ({LINES_SQL}) SELECT i * 5 / 100.0::DOUBLE AS tau FROM range(1, 21) t(i) WHERE i * 5 > (SELECT 100 * avg(z) FROM f) + 1e-7"


@query(GRID)
def tau_grid_lines(spark: SparkSession, sf: str) -> DataFrame:
    _, _, share = base_rate(_lines(spark, sf))
    return spark.createDataFrame([(t,) for t in landscape.floors(share)], "tau double")


CURVES = f"""WITH {twins.cells(LINES_SQL, LINE_FEATURES, 3)}, g AS (SELECT i * 5 / 100.0::DOUBLE AS tau FROM range(1, 21) t(i) WHERE i * 5 > (SELECT 100 * avg(z) FROM f) + 1e-7),
m AS (SELECT schema_id, d, features, tau, sum(k) AS positives, sum(n) AS rows, coalesce(sum(k) FILTER (k > 0 AND k::DOUBLE / n >= tau - 1e-9), 0)::BIGINT AS k_sel,
  coalesce(sum(n) FILTER (k > 0 AND k::DOUBLE / n >= tau - 1e-9), 0)::BIGINT AS n_sel, count(*) FILTER (k > 0 AND k::DOUBLE / n >= tau - 1e-9) AS n_centers FROM cells, g GROUP BY ALL),
r AS (SELECT *, k_sel::DOUBLE / positives::BIGINT AS x, row_number() OVER (PARTITION BY d, tau ORDER BY k_sel::DOUBLE / positives::BIGINT DESC, n_centers, n_sel::DOUBLE / rows::BIGINT, schema_id) AS r,
  count(*) FILTER (n_centers > 0) OVER (PARTITION BY d, tau) AS n_certifying, count(*) OVER (PARTITION BY d, tau) AS n_family FROM m),
c AS (SELECT * FROM r WHERE r = 1)"""


def _curves(spark: SparkSession, sf: str) -> DataFrame:
    frame = _lines(spark, sf)
    return landscape.curves(cube.cells(frame, LINE_FEATURES, 3), PURE, base_rate(frame)[2])


@query(f"{CURVES} SELECT d, tau, schema_id, features, x, n_centers, n_sel, n_certifying, n_family FROM c")
def tau_curves_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(_curves(spark, sf))


LEAD = f"""{CURVES}, l AS (SELECT tau, d FROM (SELECT *, row_number() OVER (PARTITION BY tau ORDER BY n_centers, d) AS q FROM (SELECT *, max(x) OVER (PARTITION BY tau) AS top FROM c WHERE n_centers > 0) WHERE x >= top - 1e-12) WHERE q = 1),
i AS (SELECT *, sum(new) OVER (ORDER BY tau) AS segment FROM (SELECT *, CASE WHEN d IS DISTINCT FROM lag(d) OVER (ORDER BY tau) THEN 1 ELSE 0 END AS new FROM l))"""


@query(f"{LEAD} SELECT segment::BIGINT AS segment, d, min(tau) AS tau_from, max(tau) AS tau_to, count(*) AS floors FROM i GROUP BY segment, d")
def lead_segments_lines(spark: SparkSession, sf: str) -> DataFrame:
    return landscape.leaders(_curves(spark, sf))


@query(f"{CURVES} SELECT d, tau, schema_id FROM (SELECT *, lag(schema_id) OVER (PARTITION BY d ORDER BY tau) AS b FROM c WHERE n_centers > 0) WHERE b <> schema_id")
def winner_changes_lines(spark: SparkSession, sf: str) -> DataFrame:
    return landscape.winner_changes(_curves(spark, sf)).select("d", "tau", "schema_id")


@query(f"{CURVES} SELECT tau, max(x) AS x FROM c GROUP BY tau")
def envelope_lines(spark: SparkSession, sf: str) -> DataFrame:
    return landscape.envelope(_curves(spark, sf)).select("tau", "x")


# statistics

TAIL = "list_sum(list_transform(range({k}, {n} + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p}))))"


@query(f"SELECT n, k, round(CASE WHEN k = 0 THEN 1 ELSE {TAIL.format(k='k', n='n', p='0.8')} END, 9) AS tail FROM range(1, 41) a(n), range(0, 41) b(k) WHERE k <= n")
def binomial_tail_grid(spark: SparkSession, sf: str) -> DataFrame:
    grid = spark.range(1, 41).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id"))).alias("k"))
    return grid.select("n", "k", F.round(binomial.upper_tail_udf("k", "n", F.lit(0.8)), 9).alias("tail"))


@query(f"""SELECT n, coalesce((SELECT min(k) FROM range(0, 201) b(k) WHERE k > 0 AND k <= n AND {TAIL.format(k='k', n='n', p='0.8')} <= 0.05), n + 1) AS least FROM range(1, 101) a(n)""")
def min_successes_grid(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(1, 101).select(F.col("id").alias("n"), binomial.least_certified_udf("id", F.lit(0.8), F.lit(0.05)).alias("least"))


def _bounds(spark: SparkSession) -> DataFrame:
    grid = spark.range(1, 31).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id"))).alias("k"))
    return grid.select("n", "k", binomial.exact_lower_udf("k", "n", F.lit(0.05)).alias("lower"), binomial.exact_upper_udf("k", "n", F.lit(0.05)).alias("upper"))


#: Halving of (0, 1): the bound of (k, n) is where the tail is 0.05.
HALVED = """SELECT n, k, 0 AS i, 0::DOUBLE AS lo, 1::DOUBLE AS hi, 0::DOUBLE AS lo2, 1::DOUBLE AS hi2 FROM range(1, 31) a(n), range(0, 31) b(k) WHERE k <= n
UNION ALL SELECT n, k, i + 1, CASE WHEN up <= 0.05 THEN mid ELSE lo END, CASE WHEN up <= 0.05 THEN hi ELSE mid END, CASE WHEN dn > 0.05 THEN mid2 ELSE lo2 END, CASE WHEN dn > 0.05 THEN hi2 ELSE mid2 END
FROM (SELECT *, {up} AS up, {dn} AS dn FROM (SELECT *, (lo + hi) / 2 AS mid, (lo2 + hi2) / 2 AS mid2 FROM h WHERE i < 44))"""
HALVED = HALVED.replace("{up}", TAIL.format(k="k", n="n", p="mid")).replace("{dn}", TAIL.format(k="0", n="k", p="0.5").replace("range(0, k + 1)", "range(0, k + 1)").replace("lgamma(k + 1) - lgamma(i + 1) - lgamma(k - i + 1) + i * ln(0.5) + (k - i) * ln(1 - 0.5)", "lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(mid2) + (n - i) * ln(1 - mid2)"))


@query(f"WITH RECURSIVE h AS ({HALVED}) SELECT n, k, CASE WHEN k = 0 THEN 0 ELSE round(lo, 8) END AS lower, CASE WHEN k = n THEN 1 ELSE round(hi2, 8) END AS upper FROM h WHERE i = 44")
def exact_bounds_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Exact bounds by (k, n): the share at which the tail beyond k is 0.05."""
    return _bounds(spark).select("n", "k", F.round("lower", 8).alias("lower"), F.round("upper", 8).alias("upper"))


@query(f"""WITH {twins.cells(LINES_SQL, LINE_FEATURES, 2)}, c AS (SELECT features, cell, n, k, k::DOUBLE / n AS p, 1.6448536269514722::DOUBLE AS z FROM cells)
SELECT features, cell, round((p + z * z / (2 * n) - z * sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n), 9) AS lower FROM c""")
def wilson_lines(spark: SparkSession, sf: str) -> DataFrame:
    cells = _flat(_line_cells(spark, sf, 2))
    return cells.select("features", "cell", F.round(binomial.wilson_lower(F.col("k"), F.col("n"), binomial.z_score(0.05)), 9).alias("lower"))


@query(f"""WITH {twins.cells(LINES_SQL, ['l_returnflag', 'l_linenumber'], 2)}, t AS (SELECT *, 0.05 / count(*) OVER (PARTITION BY schema_id) AS level FROM cells)
SELECT features, cell, n, k FROM t WHERE k > 0 AND {TAIL.format(k='k', n='n', p='0.5')} <= level""")
def certified_cells_lines(spark: SparkSession, sf: str) -> DataFrame:
    cells = cube.cells(_lines(spark, sf), ["l_returnflag", "l_linenumber"], 2)
    return _flat(search.centres(cells, CERTIFIED).where("is_centre")).select("features", "cell", "n", "k")


@query(f"WITH f AS ({EVENTS_SQL}) SELECT count(*) AS family FROM (SELECT DISTINCT s FROM ({' UNION ALL '.join(f'SELECT list(id ORDER BY id) AS s FROM f GROUP BY {c}' for c in ('quarter', 'user_group', 'size', 'quarter, user_group', 'quarter, size', 'user_group, size'))}))")
def family_cells_events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(capacity.family_size(frames.events(spark, sf), EVENT_FEATURES, "id", 2),)], "family long")


@query("""WITH e AS (SELECT event_type, hour(ts) AS h, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT *, 1.0::DOUBLE / n AS p FROM e),
r AS (SELECT *, count(*) OVER (ORDER BY p) AS rank, count(*) OVER () AS m FROM t)
SELECT event_type, h::INT AS h, p <= coalesce((SELECT max(p) FROM r WHERE p <= rank * 0.012 / m), -1) AS discovered FROM r""")
def bh_events(spark: SparkSession, sf: str) -> DataFrame:
    e = frames.table(spark, sf, "events").groupBy("event_type", F.hour("ts").alias("h")).agg((F.lit(1.0) / F.count("*")).alias("p"))
    return scan.discoveries(e, 0.012).select("event_type", "h", "discovered")


# screen

LEVELS = "x AS (SELECT 'p_brand' AS col, p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_size', p_size::VARCHAR FROM part), l AS (SELECT col, value, count(*) AS n FROM x GROUP BY ALL)"


@query(f"""WITH {LEVELS} SELECT col, count(*) AS n_levels, first(value ORDER BY n DESC, value) AS largest, max(n) AS largest_n, count(*) FILTER (n = 1) AS singletons,
  coalesce(max(n) FILTER (value IS NULL), 0) AS missing, count(*) > (SELECT count(*) FROM part) // 10 AS exceeds_capacity, max(n) >= 0.9 * (SELECT count(*) FROM part) AS dominant FROM l GROUP BY col""")
def profiles_part(spark: SparkSession, sf: str) -> DataFrame:
    out = screen.profiles(frames.parts(spark, sf), ["p_brand", "p_type", "p_size"])
    return out.select("col", "n_levels", "largest", "largest_n", "singletons", "missing", "exceeds_capacity", "dominant")


def _fd_frame(spark: SparkSession, sf: str) -> DataFrame:
    return frames.orders(spark, sf).select("n_name", "r_name", "c_mktsegment", F.substring("o_orderpriority", 1, 1).alias("level"), "o_orderpriority")


FD = f"""WITH f AS (SELECT n_name, r_name, c_mktsegment, o_orderpriority[1:1] AS level, o_orderpriority FROM ({ORDERS_SQL})), """


@query(
    FD
    + ", ".join(f"h{i} AS (SELECT '{a}' AS a, '{b}' AS b, (SELECT sum(m) FROM (SELECT max(c) AS m FROM (SELECT {a}, {b}, count(*) AS c FROM f GROUP BY ALL) GROUP BY {a}))::BIGINT AS hit_ab, (SELECT sum(m) FROM (SELECT max(c) AS m FROM (SELECT {a}, {b}, count(*) AS c FROM f GROUP BY ALL) GROUP BY {b}))::BIGINT AS hit_ba)" for i, (a, b) in enumerate([("n_name", "r_name"), ("level", "o_orderpriority")]))
    + " SELECT a, b, (SELECT count(*) FROM f) - hit_ab AS exceptions_ab, (SELECT count(*) FROM f) - hit_ba AS exceptions_ba, CASE a WHEN 'level' THEN 'equivalent' ELSE 'exact' END AS kind FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1)"
)
def dependency_pairs_orders(spark: SparkSession, sf: str) -> DataFrame:
    return screen.dependencies(_fd_frame(spark, sf)).select("a", "b", "exceptions_ab", "exceptions_ba", "kind")


@query("SELECT * FROM (VALUES ('level', 'o_orderpriority'), ('n_name', 'r_name'), ('o_orderpriority', 'level')) t(a, b)")
def exact_dependencies_orders(spark: SparkSession, sf: str) -> DataFrame:
    found = screen.exact_dependencies(_fd_frame(spark, sf))
    return spark.createDataFrame([(a, b) for a in sorted(found) for b in sorted(found[a])], "a string, b string")


@query(f"""WITH f AS ({LINES_SQL}), x AS (SELECT 'l_returnflag' AS col, l_returnflag AS v, z FROM f UNION ALL SELECT 'l_linestatus', l_linestatus, z FROM f UNION ALL SELECT 'l_linenumber', l_linenumber, z FROM f),
l AS (SELECT col, v, sum(z) AS k, count(*) AS n FROM x GROUP BY ALL), a AS (SELECT col, sum(greatest(k, n - k))::BIGINT AS hit, sum(k)::BIGINT AS k, sum(n)::BIGINT AS n, count(*) AS n_levels FROM l GROUP BY col)
SELECT col, n_levels, n - hit AS exceptions, (hit::DOUBLE / n - greatest(k, n - k)::DOUBLE / n) / (1 - greatest(k, n - k)::DOUBLE / n) AS strength FROM a""")
def target_leakage_lines(spark: SparkSession, sf: str) -> DataFrame:
    df = _lines(spark, sf).drop("id", "l_discount")
    return screen.leakage(df.withColumn("z", F.col("z").cast("string")), Target("z", "1"))


@query("SELECT x, f FROM (VALUES ('unknown_deck', true), ('?', true), ('n/a', true), ('Other', true), ('A1', false), ('nation', false), ('not-recorded', true), ('', true), ('mixed / none', true)) t(x, f)")
def placeholder_labels(spark: SparkSession, sf: str) -> DataFrame:
    labels = ["unknown_deck", "?", "n/a", "Other", "A1", "nation", "not-recorded", "", "mixed / none"]
    df = spark.createDataFrame([(x,) for x in labels], "x string")
    return df.select("x", screen.is_placeholder(F.col("x")).alias("f"))


@query(f"""WITH {twins.cells(ORDERS_SQL, ['c_mktsegment'], 1)} SELECT cell AS value, n, k, row_number() OVER (ORDER BY k::DOUBLE / n, n DESC, cell)::INT AS place FROM cells""")
def axis_order_orders(spark: SparkSession, sf: str) -> DataFrame:
    return screen.axis_order(frames.orders(spark, sf), "c_mktsegment", F.col("z").cast("long"))


@query(f"WITH {twins.cells(ORDERS_SQL, ['n_name', 'r_name', 'c_mktsegment'], 3, only=[('n_name',), ('r_name',), ('c_mktsegment',), ('n_name', 'c_mktsegment'), ('r_name', 'c_mktsegment')])} SELECT d, features, cell, n, k FROM cells")
def pruned_cube_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The cube without schemas that only rename a narrower one: a nation tells its region."""
    names = ["n_name", "r_name", "c_mktsegment"]
    frame = frames.orders(spark, sf).select("id", "z", *names)
    cells, _ = cube.pruned_cells(frame, names, 3, screen.exact_dependencies(frame, names), encoding.capacity(frame.count()))
    return _flat(cells).select("d", "features", "cell", "n", "k")


# validation

FOLDED = f"folded AS (SELECT *, (row_number() OVER (PARTITION BY rep, z ORDER BY md5('0:' || rep || ':' || id), id) - 1) % 5 AS fold FROM ({ORDERS_SQL}), range(0, 2) r(rep))"


def _folded(spark: SparkSession, sf: str) -> DataFrame:
    return validation.folds(frames.orders(spark, sf), "id", 5, 2)


@query(f"WITH {FOLDED} SELECT rep::INT AS rep, fold::INT AS fold, count(*) AS n, sum(z)::BIGINT AS k, sum(id)::BIGINT AS ids FROM folded GROUP BY ALL")
def cv_folds_orders(spark: SparkSession, sf: str) -> DataFrame:
    return _folded(spark, sf).groupBy("rep", "fold").agg(F.count("*").alias("n"), F.sum("z").cast("long").alias("k"), F.sum("id").alias("ids"))


CV = f"""{FOLDED}, t AS (SELECT rep, fold, o_orderpriority || c_mktsegment AS a, r_name AS b, count(*) AS n, sum(z)::BIGINT AS k FROM folded GROUP BY ALL),
w AS (SELECT rep, a, b, sum(n)::BIGINT AS na, sum(k)::BIGINT AS ka FROM t GROUP BY ALL), g AS (SELECT w.*, f.fold, coalesce(t.n, 0) AS n, coalesce(t.k, 0) AS k FROM w CROSS JOIN (SELECT DISTINCT fold FROM folded) f
LEFT JOIN t ON t.rep = w.rep AND t.fold = f.fold AND t.a = w.a AND t.b = w.b),
m AS (SELECT *, na > n AND ka - k >= greatest(1, ceil(0.36 * (na - n) - 1e-9)) AS yes FROM g),
cv AS (SELECT rep::INT AS rep, fold::INT AS fold, coalesce(sum(k) FILTER (yes), 0)::BIGINT AS k_sel, coalesce(sum(n) FILTER (yes), 0)::BIGINT AS n_sel, sum(k)::BIGINT AS positives FROM m GROUP BY ALL)"""


@query(f"WITH {CV} SELECT rep, fold, k_sel, n_sel, k_sel::DOUBLE / positives AS coverage FROM cv")
def cv_coverage_orders(spark: SparkSession, sf: str) -> DataFrame:
    return validation.cross_validated(_folded(spark, sf), ["o_orderpriority", "c_mktsegment", "r_name"], ORDER_RULE).select("rep", "fold", "k_sel", "n_sel", "coverage")


@query(f"WITH {CV} SELECT round(avg(k_sel::DOUBLE / positives), 9) AS coverage, round(sqrt((1.0 / count(*) + 0.25) * var_samp(k_sel::DOUBLE / positives)), 9) AS std_error, count(*) AS passes FROM cv")
def cv_summary_orders(spark: SparkSession, sf: str) -> DataFrame:
    cv = validation.cross_validated(_folded(spark, sf), ["o_orderpriority", "c_mktsegment", "r_name"], ORDER_RULE)
    return validation.summary(cv).select(F.round("coverage", 9).alias("coverage"), F.round("std_error", 9).alias("std_error"), "passes")


@query(f"WITH {CV} SELECT round(avg(k_sel::DOUBLE / positives), 9) AS gain, count(*) AS passes FROM cv")
def paired_gain_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Three features over one: the region alone has no centres, so the gain is the triple's coverage."""
    folded = _folded(spark, sf)
    two, one = (validation.cross_validated(folded, s, ORDER_RULE) for s in (ORDER_FEATURES, ["r_name"]))
    return validation.paired_gain(two, one).select(F.round("gain", 9).alias("gain"), "passes")


@query(f"SELECT rank <= (count(*) OVER () + 1) // 2 AS first, id FROM (SELECT id, row_number() OVER (ORDER BY md5('0:0:' || id), id) AS rank FROM ({EVENTS_SQL}))")
def halves_events(spark: SparkSession, sf: str) -> DataFrame:
    return validation.halves(frames.events(spark, sf), "id").select("first", "id")


CV_PART = f"WITH RECURSIVE {twins.keyed(PARTS_SQL, PART_FEATURES, 2, ('p_size',), [('p_brand', 'p_size')])}, {twins.folds(1)}, {twins.FOLD_CELLS}, {twins.fold_marked(0.3)}"


@query(f"{CV_PART} SELECT rep::INT AS rep, fold::INT AS fold, coalesce(sum(k) FILTER (yes), 0)::BIGINT AS k_sel, coalesce(sum(n) FILTER (yes), 0)::BIGINT AS n_sel, coalesce(sum(k) FILTER (yes), 0)::DOUBLE / sum(k)::BIGINT AS coverage FROM m GROUP BY rep, fold")
def cv_coverage_part(spark: SparkSession, sf: str) -> DataFrame:
    """Folds over a schema that is merged as all rows ask for."""
    folded = validation.folds(frames.marked_parts(spark, sf), "id", 5, 1)
    return validation.cross_validated(folded, ["p_brand", "p_size"], PART_RULE, ordered=SIZES).select("rep", "fold", "k_sel", "n_sel", "coverage")


@query(f"WITH RECURSIVE {twins.keyed(PARTS_SQL, PART_FEATURES, 2, ('p_size',))}, {twins.folds(1)}, {twins.nested(0.3)} SELECT * FROM held")
def nested_cv_part(spark: SparkSession, sf: str) -> DataFrame:
    """A search a fold, over partitions that all rows ask for."""
    folded = validation.folds(frames.marked_parts(spark, sf), "id", 5, 1)
    return _flat(validation.nested(folded, PART_FEATURES, PART_RULE, 2, "all_rows", SIZES))


NESTED = f"WITH RECURSIVE {twins.keyed(ORDERS_SQL, ORDER_FEATURES, 3)}, {twins.folds(2)}, {twins.nested(0.36)}"


@query(f"{NESTED} SELECT * FROM held")
def nested_cv_orders(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(validation.nested(_folded(spark, sf), ORDER_FEATURES, ORDER_RULE, 3))


@query(f"""{NESTED}, c AS (SELECT d, features, count(*) AS c FROM held GROUP BY ALL),
j AS (SELECT a.d, avg(len(list_intersect(string_split(a.features, '+'), string_split(b.features, '+')))::DOUBLE / len(list_distinct(string_split(a.features, '+') || string_split(b.features, '+')))) AS mean_jaccard
  FROM held a JOIN held b ON a.d = b.d AND (a.rep, a.fold) < (b.rep, b.fold) GROUP BY a.d)
SELECT d, n_schemas, round(mean_jaccard, 9) AS mean_jaccard, mode, c::DOUBLE / passes AS mode_share FROM (SELECT d, count(*) AS n_schemas, sum(c)::BIGINT AS passes, max(c) AS c, arg_min(features, (-c, features)) AS mode FROM c GROUP BY d) JOIN j USING (d)""")
def stability_orders(spark: SparkSession, sf: str) -> DataFrame:
    out = validation.stability(validation.nested(_folded(spark, sf), ORDER_FEATURES, ORDER_RULE, 3))
    return out.select("d", "n_schemas", F.round("mean_jaccard", 9).alias("mean_jaccard"), F.concat_ws("+", "mode").alias("mode"), "mode_share")


HALVES = f"hv AS (SELECT *, row_number() OVER (ORDER BY md5('0:0:' || id), id) <= (count(*) OVER () + 1) // 2 AS first FROM ({LINES_SQL}))"


@query(f"""WITH {HALVES}, {twins.cells('SELECT * FROM hv WHERE first', LINE_FEATURES, 2)}, {twins.marked(0.5)}, {twins.SCORES}, won AS ({twins.BEST}),
two AS (SELECT * FROM (WITH {twins.cells('SELECT * FROM hv WHERE NOT first', LINE_FEATURES, 2)} SELECT * FROM cells)),
held AS (SELECT two.*, CASE WHEN two.k = 0 THEN 1 ELSE {TAIL.format(k='two.k', n='two.n', p='0.5')} END AS p, count(*) OVER () AS tests FROM two JOIN marked USING (schema_id, cell) JOIN won ON won.schema_id = two.schema_id WHERE yes)
SELECT features, cell, n, k, round(least(1, p * tests), 8) AS p_adjusted, p <= 0.05 / tests AS certified FROM held""")
def certify_split_lines(spark: SparkSession, sf: str) -> DataFrame:
    halved = validation.halves(_lines(spark, sf), "id").drop("id")
    out = _flat(validation.certify_split(halved, LINE_FEATURES, PURE, 2))
    return out.select("features", "cell", "n", "k", F.round("p_adjusted", 8).alias("p_adjusted"), "certified")


@query(f"""WITH {twins.cells(LINES_SQL, ['l_returnflag', 'l_linenumber'], 2)}, t AS (SELECT *, CASE WHEN k = 0 THEN 1 ELSE {TAIL.format(k='k', n='n', p='0.5')} END AS p FROM cells)
SELECT features, cell, n, k, p <= 0.05 / 31 AS certified FROM t""")
def certify_family_lines(spark: SparkSession, sf: str) -> DataFrame:
    cells = cube.cells(_lines(spark, sf), ["l_returnflag", "l_linenumber"], 2)
    return _flat(validation.certify(cells, Rule(tau=0.5), 31)).select("features", "cell", "n", "k", "certified")


@query()
def coverage_null_lines(spark: SparkSession, sf: str) -> DataFrame:
    cells = cube.cells(_lines(spark, sf), LINE_FEATURES, 2, only=[("l_returnflag", "l_linenumber")]).collect()
    return validation.coverage_null([r["n"] for r in cells], sum(r["k"] for r in cells), Rule(tau=0.2), spark, 199)


@query(f"""WITH dealt AS (SELECT rep, quarter, user_group, size, (row_number() OVER (PARTITION BY rep ORDER BY md5('0:' || rep || ':' || id), id) <= (SELECT sum(z) FROM ({EVENTS_SQL})))::INT AS z FROM ({EVENTS_SQL}), range(0, 19) r(rep)),
{twins.cells('SELECT * FROM dealt', EVENT_FEATURES, 2, by='rep, ')}, t AS (SELECT rep, schema_id, coalesce(sum(k) FILTER (k >= greatest(1, ceil(0.22 * n - 1e-9))), 0)::DOUBLE / sum(k)::BIGINT AS coverage FROM cells GROUP BY rep, schema_id)
SELECT rep::INT AS replicate, max(coverage) AS coverage FROM t GROUP BY rep""")
def familywise_null_events(spark: SparkSession, sf: str) -> DataFrame:
    return validation.familywise_null(frames.events(spark, sf), EVENT_FEATURES, EVENT_RULE, "id", 2, 19)


SCAN = ["planted", "l_returnflag", "l_linenumber"]


def _scan_sql() -> str:
    """Every (column, value) below the floor: its winner, the p-value of the winner's centres, and the step-up."""
    parts = []
    for c in SCAN:
        rest = [x for x in SCAN if x != c]
        wanted = [(x,) for x in rest] + [tuple(rest)]
        cells = " UNION ALL ".join(f"SELECT {i} AS schema_id, {len(s)} AS d, '{'+'.join(s)}' AS features, concat_ws('|', {', '.join(s)}) AS cell, {c} AS value, count(*) AS k FROM f GROUP BY ALL" for i, s in enumerate(wanted))
        sizes = " UNION ALL ".join(f"SELECT {i} AS schema_id, concat_ws('|', {', '.join(s)}) AS cell, count(*) AS n FROM f GROUP BY ALL" for i, s in enumerate(wanted))
        parts.append(f"""SELECT '{c}' AS col, value, schema_id, d, features, coalesce(sum(k) FILTER (yes), 0)::BIGINT AS k_sel, coalesce(sum(n) FILTER (yes), 0)::BIGINT AS n_sel, count(*) FILTER (yes) AS n_centers, sum(k)::BIGINT AS positives,
  3 AS tried FROM (SELECT *, k >= greatest(1, ceil(0.6 * n - 1e-9)) AS yes FROM ({cells}) JOIN ({sizes}) USING (schema_id, cell)) GROUP BY ALL""")
    return f"""WITH f AS (SELECT z::VARCHAR AS planted, * FROM ({LINES_SQL})), rows AS (SELECT count(*) AS rows FROM f), a AS ({' UNION ALL '.join(parts)}),
r AS (SELECT *, positives::DOUBLE / rows AS share, k_sel::DOUBLE / positives AS coverage, n_sel::DOUBLE / rows AS mass FROM a, rows WHERE positives::DOUBLE / rows < 0.6),
won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY col, value ORDER BY coverage DESC, n_centers, d, mass, schema_id) AS q FROM r) WHERE q = 1),
p AS (SELECT *, CASE WHEN n_centers = 0 THEN 1 ELSE least(1, tried * {TAIL.format(k='k_sel', n='n_sel', p='share')}) END AS p FROM won),
o AS (SELECT *, count(*) OVER () AS m, count(*) OVER (ORDER BY p) AS rank FROM p)
SELECT col, value, d, features, coverage, n_centers, k_sel::DOUBLE / n_sel AS purity, mass FROM o WHERE p <= (SELECT max(p) FROM o WHERE p <= rank * 0.05 / m) AND coverage >= 0.2"""


@query(_scan_sql())
def pattern_scan_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every value of three columns as a target; the planted one is found."""
    df = _lines(spark, sf).select(F.col("z").cast("string").alias("planted"), *SCAN[1:])
    return _flat(scan.scan(df, SCAN, Rule(tau=0.6), 2)).select("col", "value", "d", "features", "coverage", "n_centers", "purity", "mass")


# rules and display


def _rules(spark: SparkSession, sf: str) -> DataFrame:
    return rules.enumerate_rules(_lines(spark, sf), [("l_returnflag", "l_linenumber"), ("l_returnflag", "l_linestatus")])


RULES = twins.cells(LINES_SQL, LINE_FEATURES, 2, only=[("l_returnflag", "l_linenumber"), ("l_returnflag", "l_linestatus"), ("l_returnflag",), ("l_linenumber",), ("l_linestatus",)]).replace("l_returnflag+l_linenumber", "l_linenumber+l_returnflag").replace("concat_ws('|', coalesce(l_returnflag::VARCHAR, 'missing'), coalesce(l_linenumber::VARCHAR, 'missing'))", "concat_ws('|', coalesce(l_linenumber::VARCHAR, 'missing'), coalesce(l_returnflag::VARCHAR, 'missing'))").replace("l_returnflag+l_linestatus", "l_linestatus+l_returnflag").replace("concat_ws('|', coalesce(l_returnflag::VARCHAR, 'missing'), coalesce(l_linestatus::VARCHAR, 'missing'))", "concat_ws('|', coalesce(l_linestatus::VARCHAR, 'missing'), coalesce(l_returnflag::VARCHAR, 'missing'))")


@query(f"""WITH {RULES}, r AS (SELECT *, string_split(features, '+') AS fs, string_split(cell, '|') AS vs FROM cells),
g AS (SELECT a.features, a.cell, max(b.k::DOUBLE / b.n) AS general, count(*) AS n_parents FROM r a JOIN r b ON a.d = 2 AND b.d = 1 AND ((b.features = a.fs[1] AND b.cell = a.vs[1]) OR (b.features = a.fs[2] AND b.cell = a.vs[2])) GROUP BY ALL)
SELECT r.features, r.cell, n, k, k::DOUBLE / n AS purity, n_parents, general FROM r JOIN g USING (features, cell)""")
def rules_lines(spark: SparkSession, sf: str) -> DataFrame:
    g = F.col("generalisation")
    return _flat(_rules(spark, sf).select("features", "cell", "n", "k", "purity", F.size("parents").cast("long").alias("n_parents"), (g["k"] / g["n"]).alias("general")))


@query(f"""WITH {RULES}, r AS (SELECT unnest(string_split(features, '+')) AS feature, unnest(string_split(cell, '|')) AS value FROM cells WHERE d = 2)
SELECT feature, value, count(*) AS rules FROM r GROUP BY ALL UNION ALL SELECT feature, NULL, count(*) FROM r GROUP BY feature""")
def rule_facets_lines(spark: SparkSession, sf: str) -> DataFrame:
    return rules.facets(_rules(spark, sf))


@query(f"WITH {RULES} SELECT {twins.BIN.format('(k::DOUBLE / n)')} AS bin, d, count(*) AS rules FROM cells WHERE d = 2 GROUP BY ALL")
def rule_bars_lines(spark: SparkSession, sf: str) -> DataFrame:
    return rules.bars(_rules(spark, sf))


@query(f"WITH {RULES} SELECT features, cell, n, k FROM cells WHERE d = 2 AND ('|' || cell || '|') LIKE '%|R|%'")
def rule_filter_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(rules.holding(_rules(spark, sf), [("l_returnflag", "R")])).select("features", "cell", "n", "k")


@query(f"WITH {twins.cells(LINES_SQL, ['l_returnflag', 'l_linenumber', 'l_linestatus'], 3, only=[('l_returnflag', 'l_linenumber', 'l_linestatus')])}, {twins.marked(0.5)} SELECT cell, n, k, k::DOUBLE / n AS purity, 0.2 + 0.8 * sqrt(n / max(n) OVER ()) AS opacity, CASE WHEN yes THEN 'centre' WHEN k::DOUBLE / n >= 0.4 THEN 'mixed' ELSE 'low' END AS zone FROM marked")
def display_grid_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(display.grid(_lines(spark, sf), PREFIX, PURE)).select("cell", "n", "k", "purity", "opacity", "zone")


@query("SELECT slice, count(*) AS cells, sum(n)::BIGINT AS rows FROM (SELECT l_linestatus AS slice, count(*) AS n FROM (" + LINES_SQL + ") GROUP BY l_returnflag, l_linenumber, l_discount, l_linestatus) GROUP BY slice")
def slice_grid_lines(spark: SparkSession, sf: str) -> DataFrame:
    out = display.slices(_lines(spark, sf), ["l_returnflag", "l_linenumber", "l_discount", "l_linestatus"], PURE)
    return out.groupBy("slice").agg(F.count("*").alias("cells"), F.sum("n").alias("rows"))


@query()
def display_points_events(spark: SparkSession, sf: str) -> DataFrame:
    return display.points(frames.events(spark, sf), EVENT_FEATURES, "id", 500)


@query(f"WITH {twins.cells(EVENTS_SQL, EVENT_FEATURES, 1, only=[(c,) for c in EVENT_FEATURES])}, {twins.marked(0.205)} SELECT DISTINCT features AS col, cell AS value FROM marked WHERE yes")
def scan_filtered_catalog_events(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogue entries that are centres by themselves."""
    df = frames.events(spark, sf)
    found = search.centres(cube.cells(df, EVENT_FEATURES, 1), Rule(tau=0.205)).where("is_centre")
    found = found.select(F.col("features")[0].alias("col"), F.col("cell")[0].alias("value"))
    return search.kept_levels(screen.catalogue(df, EVENT_FEATURES), found).select("col", "value")


@query(f"{CURVES}, b AS (SELECT schema_id, d, features FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY x DESC, n_centers, n_sel, schema_id) AS q FROM c WHERE tau = 0.5) WHERE q = 1 AND n_centers > 0) SELECT schema_id, d, features FROM (SELECT schema_id, d, features FROM c WHERE n_centers > 0 UNION SELECT schema_id, d, features FROM b)")
def rule_pool_lines(spark: SparkSession, sf: str) -> DataFrame:
    won = search.gated(search.winners(search.scores(_line_cells(spark, sf), PURE)))
    return _flat(landscape.rule_pool(_curves(spark, sf), won))


@query("SELECT method, count(*) FILTER (t >= 2) AS plus, count(*) FILTER (t > -2 AND t < 2) AS equal, count(*) FILTER (t <= -2) AS minus, median(gain) AS median_gain FROM (SELECT event_type AS method, value / 20 - 3 AS t, value AS gain FROM events) GROUP BY method")
def comparison_marks_events(spark: SparkSession, sf: str) -> DataFrame:
    e = frames.table(spark, sf, "events")
    return baselines.comparison(e.select(F.col("event_type").alias("method"), (F.col("value") / 20 - 3).alias("t"), F.col("value").alias("gain")))


# redundancy

SETS_RULE = Rule(tau=0.21)


def _sets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return redundancy.collect(frames.events(spark, sf), EVENT_FEATURES, SETS_RULE, "id", 3)


SETS = f"""WITH f AS ({EVENTS_SQL}), {', '.join(f"g{i} AS (SELECT {len(s)} AS d, '{'+'.join(s)}' AS features, concat_ws('|', {', '.join(s)}) AS cell, count(*) AS n, sum(z)::BIGINT AS k, list(id ORDER BY id) AS ids FROM f GROUP BY {', '.join(s)})" for i, s in enumerate([('quarter',), ('user_group',), ('size',), ('quarter', 'user_group'), ('quarter', 'size'), ('user_group', 'size'), ('quarter', 'user_group', 'size')]))},
c AS (SELECT * FROM ({' UNION ALL '.join(f'SELECT * FROM g{i}' for i in range(7))}) WHERE k >= greatest(1, ceil(0.21 * n - 1e-9)))"""


@query(f"{SETS} SELECT features, cell, n, k FROM c")
def center_sets_events(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(_sets(spark, sf)[0]).select("features", "cell", "n", "k")


@query(f"""{SETS}, u AS (SELECT DISTINCT ids FROM c), p AS (SELECT len(list_intersect(a.ids, b.ids)) AS shared, least(len(a.ids), len(b.ids)) AS small, greatest(len(a.ids), len(b.ids)) AS large FROM u a JOIN u b ON a.ids < b.ids)
SELECT small, large, shared, shared::DOUBLE / large AS similarity FROM p WHERE shared::DOUBLE / large >= 0.5 - 1e-12""")
def similar_pairs_events(spark: SparkSession, sf: str) -> DataFrame:
    _, sets, members = _sets(spark, sf)
    return redundancy.similar(sets, members).select(F.least("n_a", "n_b").alias("small"), F.greatest("n_a", "n_b").alias("large"), "shared", "similarity")


@query()
def leader_groups_events(spark: SparkSession, sf: str) -> DataFrame:
    named, sets, members = _sets(spark, sf)
    sets, members = sets.cache(), members.cache()
    grouped = redundancy.groups(sets, redundancy.similar(sets, members), 0.5)
    return redundancy.group_table(sets, grouped, members, named)


@query(f"""{SETS}, u AS (SELECT DISTINCT ids FROM c), s AS (SELECT a.ids, coalesce(max(len(list_intersect(a.ids, b.ids))::DOUBLE / greatest(len(a.ids), len(b.ids))), 0) AS s FROM u a LEFT JOIN u b ON a.ids <> b.ids GROUP BY a.ids)
SELECT CASE WHEN s >= 1 - 1e-12 THEN 'identical' WHEN s < 0.5 - 1e-12 THEN 'below' ELSE printf('%.2f', floor((s + 1e-12) / 0.05) * 0.05) END AS bin, count(*) AS sets FROM s GROUP BY 1""")
def nn_histogram_events(spark: SparkSession, sf: str) -> DataFrame:
    _, sets, members = _sets(spark, sf)
    return redundancy.histogram(redundancy.nearest(sets, redundancy.similar(sets, members)))


KIN = f"""{SETS}, x AS (SELECT *, string_split(features, '+') AS fs, len(ids) AS m FROM c),
y AS (SELECT a.fs AS fa, b.fs AS fb, a.ids AS ia, b.ids AS ib, a.m AS ma, b.m AS mb, a.cell AS ca, b.cell AS cb, a.d AS da, b.d AS db, len(list_intersect(a.ids, b.ids)) AS shared FROM x a, x b WHERE a.ids <> b.ids)"""


@query(f"""{KIN}, z AS (SELECT *, CASE WHEN len(list_intersect(fa, fb)) = len(fa) AND len(fa) = len(fb) THEN 'same' WHEN len(list_intersect(fa, fb)) = len(fb) THEN 'child' WHEN len(list_intersect(fa, fb)) = len(fa) THEN 'parent' ELSE 'unrelated' END AS lineage,
CASE WHEN shared = ma THEN 'inside' WHEN shared = mb THEN 'contains' ELSE 'crossing' END AS relation FROM y WHERE shared::DOUBLE / greatest(ma, mb) >= 0.5 - 1e-12)
SELECT lineage, relation, NOT ((lineage = 'child' AND relation = 'contains') OR (lineage = 'parent' AND relation = 'inside')) AS consistent, count(*) AS pairs FROM z GROUP BY ALL""")
def kinship_events(spark: SparkSession, sf: str) -> DataFrame:
    named, sets, members = _sets(spark, sf)
    out = redundancy.kinship(named, redundancy.both_ways(redundancy.similar(sets, members)))
    return out.groupBy("lineage", "relation", "consistent").agg(F.count("*").alias("pairs"))


@query()
def branch_alternatives_events(spark: SparkSession, sf: str) -> DataFrame:
    named, sets, members = _sets(spark, sf)
    out = redundancy.alternatives(named, sets, redundancy.similar(sets, members), 6, 0.5)
    return out.select(F.concat_ws("|", "centre").alias("centre"), "b", "similarity", "d", "place")


@query(f"SELECT 'l_returnflag' AS feature, 'R' AS values FROM range(1) UNION ALL SELECT 'l_linestatus', (SELECT string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) FROM ({LINES_SQL}) WHERE l_returnflag = 'R')")
def describe_center_lines(spark: SparkSession, sf: str) -> DataFrame:
    out = redundancy.describe(_lines(spark, sf), ["l_returnflag", "l_linestatus"], ["l_returnflag"], ["R"])
    return out.select("feature", F.concat_ws(",", "values").alias("values"))


@query(f"""{SETS}, o AS (SELECT cell, n, k, ids FROM c WHERE features = 'quarter+user_group+size'), m AS (SELECT o.cell, x.d, x.features, x.ids, len(list_intersect(o.ids, x.ids))::DOUBLE / greatest(len(o.ids), len(x.ids)) AS s
  FROM o, c x WHERE x.features <> 'quarter+user_group+size'), a AS (SELECT * FROM m WHERE s >= 0.5 - 1e-12),
t AS (SELECT cell, count(*) AS total, count(*) FILTER (s >= 1 - 1e-12) AS identical, count(DISTINCT features) AS schemas, min(d)::INT AS simplest_d FROM a GROUP BY cell),
u AS (SELECT cell, count(DISTINCT id) AS union_n FROM (SELECT cell, unnest(ids) AS id FROM a UNION ALL SELECT cell, unnest(ids) FROM o) GROUP BY cell)
SELECT o.cell, n, k, coalesce(total, 0) AS total, coalesce(identical, 0) AS identical, coalesce(schemas, 0) AS schemas, simplest_d, union_n FROM o LEFT JOIN t USING (cell) JOIN u USING (cell)""")
def branch_view_events(spark: SparkSession, sf: str) -> DataFrame:
    """The centres of the widest schema, and what else describes their rows."""
    named, sets, members = _sets(spark, sf)
    out = redundancy.branch_view(named, sets, redundancy.similar(sets, members), members, 6, 0.5)
    return _flat(out).select("cell", "n", "k", "total", "identical", "schemas", "simplest_d", "union_n")


@query(twins.events(f""", most AS (SELECT max(n_centers) AS most FROM s), {twins.PLACED}, x AS (SELECT p.*, {twins.BIN.format('coalesce(n_centers::DOUBLE / nullif(most, 0), 0)')} AS iy_all FROM p, most)
SELECT d, ix, iy, iy_all, count(*) AS schemas FROM x WHERE n_centers > 0 GROUP BY ALL""", 0.21).replace("FROM scores) ,", "FROM scores),"))
def group_cells_events(spark: SparkSession, sf: str) -> DataFrame:
    """Where in the landscape the groups' schemas lie; every schema with centres lies in some group."""
    df = frames.events(spark, sf)
    named, sets, members = _sets(spark, sf)
    grouped = redundancy.groups(sets, redundancy.similar(sets, members), 0.5)
    scored = search.scores(search.searched_cells(df, EVENT_FEATURES, 3), SETS_RULE, wilson=False)
    of = named.join(grouped.select("set_id", "leader"), "set_id").select("leader", "schema_id").distinct()
    cells = redundancy.group_cells(named, grouped, scored)
    at = redundancy.coordinates(scored).join(of.select("schema_id").distinct(), "schema_id", "left_semi")
    # each bin that some group has, with its schemas counted once
    return at.join(cells.select("d", "ix", "iy", "iy_all").distinct(), ["d", "ix", "iy", "iy_all"], "left_semi").groupBy("d", "ix", "iy", "iy_all").agg(F.count("*").alias("schemas"))


@query(_merged(2, "SELECT features, n, k FROM marked WHERE yes", 0.4))
def center_sets_part(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue of centres over merged partitions."""
    named, _, _ = redundancy.collect(frames.marked_parts(spark, sf), PART_FEATURES, Rule(tau=0.4), "id", 2, SIZES)
    return _flat(named).select("features", "n", "k")


# baselines


@query(f"WITH f AS ({LINES_SQL}), u AS (SELECT z, (l_returnflag = 'R' AND l_linenumber = '1') OR (l_returnflag = 'R' AND l_linenumber = '2') AS i FROM f) SELECT count(*) FILTER (i) AS n, (sum(z) FILTER (i))::BIGINT AS k, (sum(z) FILTER (i))::DOUBLE / sum(z) AS coverage, (sum(z) FILTER (i))::DOUBLE / count(*) FILTER (i) AS purity FROM u")
def held_out_union_lines(spark: SparkSession, sf: str) -> DataFrame:
    groups = [{"l_returnflag": "R", "l_linenumber": v} for v in "12"]
    return baselines.held_out(_lines(spark, sf), groups, 0.5).select("n", "k", "coverage", "purity")


@query(
    f"""WITH {twins.cells(LINES_SQL, LINE_FEATURES, 2)}, {twins.marked(0.5)}, r AS (SELECT *, row_number() OVER (PARTITION BY schema_id ORDER BY k DESC, n, cell) AS place FROM marked WHERE yes), t AS (SELECT * FROM r WHERE place <= 8 // d),
    b AS (SELECT schema_id, sum(k)::BIGINT AS covered, count(*) AS groups FROM t GROUP BY ALL ORDER BY covered DESC, groups, schema_id LIMIT 1) SELECT features, cell, n, k, covered FROM t JOIN b USING (schema_id)"""
)
def budgeted_schema_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(baselines.budgeted_schema(_line_cells(spark, sf, 2), PURE, 8)).select("features", "cell", "n", "k", "covered")


@query()
def tree_leaves_lines(spark: SparkSession, sf: str) -> DataFrame:
    return baselines.tree_leaves(_lines(spark, sf), LINE_FEATURES)


CHAIN = "SELECT features, string_split(features, '+') AS fs FROM s WHERE d = {d}{also} ORDER BY coverage DESC, n_centers, mass, schema_id LIMIT 1"


@query(twins.lines(f""", c1 AS ({CHAIN.format(d=1, also='')}), c2 AS ({CHAIN.format(d=2, also=" AND list_has_all(string_split(features, '+'), (SELECT fs FROM c1))")}), c3 AS ({CHAIN.format(d=3, also=" AND list_has_all(string_split(features, '+'), (SELECT fs FROM c2))")})
SELECT len(fs)::INT AS d, features FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3)""").replace("FROM scores) ,", "FROM scores),"))
def greedy_chain_lines(spark: SparkSession, sf: str) -> DataFrame:
    chain = baselines.greedy_chain(_line_scores(spark, sf).cache(), 3)
    return spark.createDataFrame([(len(c), "+".join(c)) for c in chain], "d int, features string")


@query()
def method_comparison_orders(spark: SparkSession, sf: str) -> DataFrame:
    return comparison.compare(frames.orders(spark, sf), ORDER_FEATURES, ORDER_RULE, 6, "id", k=2, widest=3).drop("net_coverage")


__all__ = ["QUERIES", "ORACLES", "Window"]
