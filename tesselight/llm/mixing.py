"""Mixing sources to target weights (operator 4).

Sources in code-point order (null last) weigh 5, 2, 1, 5, 2, 1, ... and share a budget of
``share`` times all words. A source's target stops at ``most`` times its own words; what it leaves
goes to the others by weight until none is above. Each document gets a hash-random key; within a
source documents stand in key order, the distributed prefix sum of their words is taken, and the
source's budget is cut exactly: whole epochs first, then documents up to the cut, the last of them
in part.

The prefix sum needs no task that holds a source: keys fall into ranges by their first digits, the
words of each (source, range) are summed, running sums over that small table give each range's
offset, and only within a range are documents sorted. The number of ranges follows the number of
documents, so a source with a third of all rows is spread as finely as any other.

Edge cases: null or blank texts have size 0 and take nothing; null sources are one source, last;
rows that repeat in full are ordered arbitrarily among themselves, which leaves the multiset of
results unchanged; an empty table gives no rows; other columns pass through :func:`mixed`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import local, n_words, written

#: Fixed by the contract of the query.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Documents that one range of keys holds on average, at most.
RANGE_ROWS = 20_000


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> list[tuple[str | None, int, float]]:
    """(source, words, target) of each source: weights filled up to the caps."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {i: weights[i % len(weights)] for i in range(len(order))}
    budget = share * sum(n for _, n in order)
    full: set[int] = set()
    while True:
        left = budget - sum(float(most * order[i][1]) for i in full)
        open_ = [i for i in weight if i not in full]
        level = left / sum(weight[i] for i in open_) if open_ else 0.0
        over = {i for i in open_ if level * weight[i] > most * order[i][1]}
        if not over:
            return [(s, n, float(most * n) if i in full else level * weight[i]) for i, (s, n) in enumerate(order)]
        full |= over


def take(docs: DataFrame, carry: bool = False) -> DataFrame:
    """size, source_size, target and taken for each document; ``carry``: all columns as ``_row``, _size and _taken."""
    spark = docs.sparkSession
    # the text too: rows without a doc_id, or with the same one, spread over the ranges
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else []
    sized = docs.select("doc_id", "source", *own, n_words(F.col("text")).alias("_size"), key.alias("_key"))
    if not carry:
        sized = written(sized, "sizes")
    per_source = sized.groupBy("source").agg(F.sum("_size").alias("n"), F.count("*").alias("rows")).collect()
    rows = sum(r["rows"] for r in per_source)
    digits = 1
    while 16**digits * RANGE_ROWS < rows:
        digits += 1
    plan = local(spark, targets([(r["source"], r["n"]) for r in per_source]), "_source string, _source_size long, _target double")
    sized = sized.withColumn("_range", F.substring("_key", 1, digits))
    # a row for each source and range: at most rows / RANGE_ROWS * 16 times the sources
    by_source = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized.groupBy("source", "_range").agg(F.sum("_size").alias("_sum")).select(F.col("source").alias("_source2"), F.col("_range").alias("_range2"), F.coalesce(F.sum("_sum").over(by_source), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    out = sized.withColumn("_before", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    out = out.join(offsets, F.col("source").eqNullSafe(F.col("_source2")) & (F.col("_range") == F.col("_range2")))
    out = out.join(plan, F.col("source").eqNullSafe(F.col("_source")))  # a row per source: Spark knows its size
    epochs = F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size"))).otherwise(0)
    rest = F.floor(F.col("_target")) - epochs * F.col("_source_size")
    part = F.greatest(F.lit(0), F.least(F.col("_size"), rest - F.col("_offset") - F.col("_before")))
    taken = (epochs * F.col("_size") + part).cast("long").alias("_taken")
    if carry:
        return out.select("_row", "_size", taken)
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), taken.alias("taken"), "source")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, the one at a cut in part.

    Rows keep the columns of ``docs``; documents of which nothing is taken go, and ``n_chars``
    follows a cut text.
    """
    drawn = take(docs, carry=True).where("_taken > 0")
    rows = drawn.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_taken") / F.col("_size")).cast("int") - 1)))
    rows = rows.withColumn("_left", F.least(F.col("_size"), F.col("_taken") - F.col("_copy") * F.col("_size")).cast("int"))
    short = F.col("_left") < F.col("_size")
    head = F.array_join(F.slice(F.split("_row.text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), F.col("_left")), "")
    own = {c: F.col(f"_row.`{c}`") for c in docs.columns}
    own["text"] = F.when(short, head).otherwise(own["text"])
    if "n_chars" in own:
        own["n_chars"] = F.when(short, F.length(head).cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return rows.select(*[x.alias(c) for c, x in own.items()])


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY n::DOUBLE / w, source NULLS LAST) AS i FROM s),
f AS (SELECT j, (1.5 * (SELECT sum(n)::DOUBLE FROM s) - (SELECT coalesce(sum(2 * n), 0)::DOUBLE FROM o WHERE i <= j))
                / (SELECT sum(w)::DOUBLE FROM o WHERE i > j) AS level
      FROM (SELECT unnest(range(0, (SELECT count(*) FROM o))) AS j)),
best AS (SELECT min(j) AS j FROM f WHERE NOT EXISTS (SELECT 1 FROM o WHERE i > f.j AND f.level * w > 2 * n)),
t AS (SELECT source, n, CASE WHEN i <= best.j THEN (2 * n)::DOUBLE ELSE f.level * w END AS target FROM o, best JOIN f ON f.j = best.j),
r AS (SELECT d.*, t.n, t.target, CASE WHEN t.n > 0 THEN floor(t.target / t.n)::BIGINT ELSE 0 END AS e,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, n AS source_size, target, (e * size + greatest(0, least(size, floor(target)::BIGINT - e * n - b)))::BIGINT AS taken, source FROM r
"""
