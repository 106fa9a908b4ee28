"""Centres that describe the same rows: row sets, their similarity, groups and kinship.

Rows that agree in all features lie in the same centres, so membership (set, row, w) holds one row
of each such combination, with the number of rows that it stands for; intersections come from
joining it with itself within the band of sizes that can reach the similarity floor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binomial import exact_lower_udf
from ..spec import Rule
from .capacity import settle, words_of
from .cube import cells as make_cells
from .cube import _labelled, schemas
from .landscape import bin_of, placed
from .search import TIE, centres, total

#: Least similarity of a pair that is kept, similarity of a group, and distinct sets at most.
FLOOR, GROUP_AT, MOST_SETS = 0.5, 0.8, 60_000
HISTOGRAM_WIDTH = 0.05


def collect(frame: DataFrame, features: list[str], rule: Rule, row_id: str, widest: int = 3, ordered: dict[str, bool] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(centres, sets, members): each centre with its set_id, ranked distinct row sets, (set_id, row, w, p).

    ``w`` and ``p`` are the rows, and those with z, that a member row stands for. A set's rank is its place by width, lower bound, size and first centre; set_id is that rank.
    Cells are those of the search, merged where a schema has too many.
    """
    raw = make_cells(frame, features, widest).persist()
    merged = settle(raw, words_of(frame, features), total(raw), ordered)
    found = centres(merged.apply(raw), rule).where("is_centre")
    found = found.withColumn("lower", exact_lower_udf(F.col("k"), F.col("n"), F.col("level"))).drop("is_centre")
    # rows of a centre: each schema's key of a combination of features, matched with the cell's
    keyed = _labelled(frame.select(F.col(row_id).alias("_row"), "z", *features), features)
    of = F.struct(F.min("_row").alias("row"), F.count("*").alias("w"), F.sum("z").cast("long").alias("p"), F.bit_xor(F.xxhash64(F.lit(1), "_row")).alias("a"), F.bit_xor(F.xxhash64(F.lit(2), "_row")).alias("b"))
    combos = keyed.groupBy(*features).agg(of.alias("_of"))  # a feature may have any of these names
    keys = F.array(*[F.struct(F.lit(i).alias("schema_id"), F.array(*[F.col(c) for c in s]).alias("cell")) for i, s in enumerate(schemas(features, widest))])
    rows = combos.select("_of", F.explode(keys).alias("x")).select("x.*", "_of.*")
    if merged.crowded:
        rows = merged.relabelled(rows)
    held = rows.join(found.select("schema_id", "cell"), ["schema_id", "cell"]).persist()
    prints = held.groupBy("schema_id", "cell").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    marked = found.join(prints, ["schema_id", "cell"])
    best = F.min(F.struct("d", (-F.col("lower")).alias("o"), (-F.col("n")).alias("m"), "schema_id", "cell"))
    sets = marked.groupBy("n", "a", "b").agg(best.alias("best"), F.count("*").alias("centres"), F.max("k").alias("k")).persist()
    if sets.count() > MOST_SETS:
        raise ValueError(f"more than {MOST_SETS} distinct row sets: raise the floor or narrow the search")
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("best")) - 1  # of at most MOST_SETS rows
    sets = sets.withColumn("set_id", rank)
    ids = sets.select("n", "a", "b", "set_id")
    named = marked.join(ids, ["n", "a", "b"]).drop("a", "b")
    members = held.join(sets.select("set_id", F.col("best.schema_id").alias("schema_id"), F.col("best.cell").alias("cell")), ["schema_id", "cell"]).select("set_id", "row", "w", "p")
    sets = sets.select("set_id", F.col("best.d").alias("d"), F.col("best.schema_id").alias("schema_id"), F.col("best.cell").alias("cell"), "n", "k", (-F.col("best.o")).alias("lower"), "centres")
    return named, sets, members


def similar(sets: DataFrame, members: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(a, b, shared, similarity): pairs of sets with shared / larger size of ``floor`` at least.

    Combinations that lie in the same sets count together, once. Of a set's members, taken with the
    least common first, two similar sets share one among those that leave less than ``floor`` of the
    set's rows behind; only these prefixes are joined to find pairs, within bands of sizes.
    """
    sized = members.join(sets.select("set_id", "n"), "set_id")
    # equal membership: one row for all combinations with the same list of sets
    of_row = sized.groupBy("row").agg(F.max("w").alias("w"), F.sort_array(F.collect_list("set_id")).alias("_in"))
    same = of_row.groupBy("_in").agg(F.min("row").alias("row"), F.sum("w").alias("w"), F.size("_in").alias("held"))
    every = same.select("row", "w", "held", F.explode("_in").alias("set_id")).join(sets.select("set_id", "n"), "set_id").persist()
    behind = F.coalesce(F.sum("w").over(Window.partitionBy("set_id").orderBy("held", "row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    prefix = every.withColumn("_behind", behind).where(F.col("n") - F.col("_behind") >= floor * F.col("n") - TIE * F.col("n"))
    # sizes within a factor of each other lie in the same band or the next
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / floor)) + 1e-9) if floor < 1 else F.col("n")
    posted = prefix.select("row", F.col("set_id"), F.col("n"), band.alias("_band"))
    a = posted.select("row", F.col("set_id").alias("a"), F.col("n").alias("n_a"), F.explode(F.array(F.col("_band") - 1, F.col("_band"), F.col("_band") + 1)).alias("_band"))
    b = posted.select("row", F.col("set_id").alias("b"), F.col("n").alias("n_b"), "_band")
    able = (F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= floor * F.greatest("n_a", "n_b") - TIE)
    pairs = a.join(b, ["row", "_band"]).where(able).select("a", "b", "n_a", "n_b").distinct()
    left, right = every.select(F.col("set_id").alias("a"), "row", "w"), every.select(F.col("set_id").alias("b"), "row")
    shared = pairs.join(left, "a").join(right, ["b", "row"]).groupBy("a", "b", "n_a", "n_b").agg(F.sum("w").alias("shared"))
    return shared.withColumn("similarity", F.col("shared") / F.greatest("n_a", "n_b")).where(F.col("similarity") >= floor - TIE)


def groups(sets: DataFrame, pairs: DataFrame, at: float = GROUP_AT) -> DataFrame:
    """(set_id, leader, similarity): sets in rank order join the most similar leader, or lead.

    Leaders depend on the sets before them, so the choice is sequential; it runs over the pairs of
    one catalogue, whose sets are bounded by MOST_SETS.
    """
    order = [r[0] for r in sets.select("set_id").orderBy("set_id").collect()]
    near: dict[int, list[tuple[int, float]]] = {}
    for r in pairs.where(F.col("similarity") >= at - TIE).select("a", "b", "similarity").toLocalIterator():
        near.setdefault(max(r["a"], r["b"]), []).append((min(r["a"], r["b"]), r["similarity"]))
    leads: set[int] = set()
    out = []
    for s in order:
        best = None
        for other, sim in sorted(near.get(s, [])):
            if other in leads and (best is None or sim > best[1] + TIE):
                best = (other, sim)
        if best is None:
            leads.add(s)
            best = (s, 1.0)
        out.append((s, *best))
    return sets.sparkSession.createDataFrame(out, "set_id long, leader long, similarity double")


def group_table(sets: DataFrame, grouped: DataFrame, members: DataFrame, named: DataFrame) -> DataFrame:
    """Per group: sets, centres, schemas by width, least similarity, and the union of its rows (n, k, purity)."""
    led = grouped.select("set_id", "leader")
    union = members.join(led, "set_id").select("leader", "row", "w", "p").distinct().groupBy("leader").agg(F.sum("w").alias("union_n"), F.sum("p").alias("union_k"))
    of = named.join(led, "set_id")
    facts = of.groupBy("leader").agg(F.count_distinct("set_id").alias("sets"), F.count("*").alias("centres"), F.count_distinct("schema_id").alias("schemas"), F.sort_array(F.collect_set("d")).alias("widths"))
    head = sets.select(F.col("set_id").alias("leader"), "d", "n", "k")
    least = grouped.groupBy("leader").agg(F.min("similarity").alias("min_similarity"))
    return facts.join(union, "leader").join(head, "leader").join(least, "leader").withColumn("union_purity", F.col("union_k") / F.col("union_n"))


def coordinates(scored: DataFrame, direction: str = "presence") -> DataFrame:
    """(schema_id, d, ix, iy, iy_all): a schema's bin of the landscape of its width, and of all widths."""
    most = scored.agg(F.max("n_centers").alias("_most"))  # one row
    at = placed(scored, direction).join(F.broadcast(most))
    return at.select("schema_id", "d", "ix", "iy", bin_of(F.coalesce(F.try_divide(F.col("n_centers"), F.col("_most")), F.lit(0.0))).alias("iy_all"))


def group_cells(named: DataFrame, grouped: DataFrame, scored: DataFrame, direction: str = "presence") -> DataFrame:
    """(leader, d, ix, iy, iy_all, schemas): where in the landscape a group's schemas lie."""
    of = named.join(grouped.select("set_id", "leader"), "set_id").select("leader", "schema_id").distinct()
    return of.join(coordinates(scored, direction), "schema_id").groupBy("leader", "d", "ix", "iy", "iy_all").agg(F.count("*").alias("schemas"))


def groups_in(cells: DataFrame, d: int | None = None, ix: int | None = None, iy: int | None = None) -> DataFrame:
    """(leader): groups with a schema of this width, in this bin (without a width: of the landscape of all)."""
    at = cells if d is None else cells.where(F.col("d") == d)
    if ix is not None:
        at = at.where((F.col("ix") == ix) & (F.col("iy_all" if d is None else "iy") == iy))
    return at.select("leader").distinct()


def group_features(named: DataFrame, grouped: DataFrame) -> DataFrame:
    """How many schemas of each group use a feature."""
    of = named.join(grouped.select("set_id", "leader"), "set_id").select("leader", "schema_id", "features").distinct()
    return of.select("leader", F.explode("features").alias("feature")).groupBy("leader", "feature").agg(F.count("*").alias("schemas"))


def page(table: DataFrame, by: str = "coverage", offset: int = 0, limit: int = 50) -> DataFrame:
    """Groups by positives, or by members, then rank."""
    first = "k" if by == "coverage" else "sets"
    return table.orderBy(F.desc(first), F.desc("n" if by == "coverage" else "k"), "leader").offset(offset).limit(limit)


def both_ways(pairs: DataFrame) -> DataFrame:
    flipped = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b"), "shared", "similarity")
    return pairs.select("a", "b", "n_a", "n_b", "shared", "similarity").unionAll(flipped)


def alternatives(named: DataFrame, sets: DataFrame, pairs: DataFrame, schema_id: int, at: float = GROUP_AT) -> DataFrame:
    """For each centre of a schema, the sets as similar as ``at``: most similar, narrowest, first."""
    own = named.where(F.col("schema_id") == schema_id).select(F.col("set_id").alias("a"), F.col("cell").alias("centre"))
    near = own.join(both_ways(pairs).where(F.col("similarity") >= at - TIE), "a").join(sets.select(F.col("set_id").alias("b"), "d", F.col("cell").alias("other")), "b")
    w = Window.partitionBy("a").orderBy(F.desc("similarity"), "d", "b")
    return near.withColumn("place", F.row_number().over(w))


def branch_view(named: DataFrame, sets: DataFrame, pairs: DataFrame, members: DataFrame, schema_id: int, at: float = GROUP_AT, kin: str = "all") -> DataFrame:
    """For each centre of a schema: what other schemas' centres describe almost the same rows.

    (cell, n, k, total, identical, schemas, simplest_d, simplest, union_n, union_k); ``kin`` keeps
    alternatives whose schema is nested with this one ("related"), or is not ("unrelated").
    """
    if kin not in ("all", "related", "unrelated"):
        raise ValueError(f"unknown kin: {kin}")
    own = named.where(F.col("schema_id") == schema_id).select("cell", "n", "k", F.col("set_id").alias("a"), F.col("features").alias("_own"))
    near = both_ways(pairs).where(F.col("similarity") >= at - TIE).select("a", "b", "similarity")
    near = near.unionAll(own.select("a", F.col("a").alias("b"), F.lit(1.0).alias("similarity")).distinct())
    other = named.where(F.col("schema_id") != schema_id).select(F.col("set_id").alias("b"), F.col("schema_id").alias("_schema"), F.col("features").alias("_features"), F.size("features").alias("_d"))
    met = own.join(near, "a").join(other, "b")
    if kin != "all":
        nested = lineage(F.col("_own"), F.col("_features")) != "unrelated"
        met = met.where(nested if kin == "related" else ~nested)
    met = met.persist()
    best = F.min(F.struct("_d", "b", "_schema", "_features"))
    facts = met.groupBy("cell").agg(F.count("*").alias("total"), F.count(F.when(F.col("similarity") >= 1 - TIE, 1)).alias("identical"), F.count_distinct("_schema").alias("schemas"), best.alias("best"))
    # the union of the centre's own rows and those of all alternatives
    of = met.select("cell", F.col("b").alias("set_id")).unionAll(own.select("cell", F.col("a").alias("set_id"))).distinct()
    union = of.join(members, "set_id").select("cell", "row", "w", "p").distinct().groupBy("cell").agg(F.sum("w").alias("union_n"), F.sum("p").alias("union_k"))
    out = own.select("cell", "n", "k").join(facts, "cell", "left").join(union, "cell")
    return out.select("cell", "n", "k", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("identical", F.lit(0)).alias("identical"), F.coalesce("schemas", F.lit(0)).alias("schemas"), F.col("best._d").alias("simplest_d"), F.col("best._features").alias("simplest"), "union_n", "union_k")


def detail(grouped: DataFrame, sets: DataFrame, pairs: DataFrame, leader: int, rows: int) -> DataFrame:
    """A group's sets against its leader: one-sided shares and rows, chance, and similarity beyond chance."""
    own = grouped.where((F.col("leader") == leader) & (F.col("set_id") != leader)).select(F.col("set_id").alias("b"), F.col("leader").alias("a"))
    met = own.join(both_ways(pairs), ["a", "b"]).join(sets.select(F.col("set_id").alias("b"), "d", "cell"), "b")
    chance = F.least("n_a", "n_b") / F.lit(rows)
    out = met.withColumns({"of_leader": F.col("shared") / F.col("n_a"), "of_member": F.col("shared") / F.col("n_b"), "chance": chance, "only_leader": F.col("n_a") - F.col("shared"), "only_member": F.col("n_b") - F.col("shared")})
    out = out.withColumn("beyond", F.try_divide(F.col("similarity") - F.col("chance"), 1 - F.col("chance")))
    return out.orderBy(F.desc("similarity"), "d", "b")


def histogram(similarity: DataFrame, column: str = "similarity") -> DataFrame:
    """Counts by twentieths from the floor; identical sets and those below it apart."""
    s = F.col(column)
    label = F.when(s >= 1 - TIE, "identical").when(s < FLOOR - TIE, "below").otherwise(F.format_string("%.2f", F.floor((s + TIE) / HISTOGRAM_WIDTH) * HISTOGRAM_WIDTH))
    return similarity.groupBy(label.alias("bin")).agg(F.count("*").alias("sets"))


def nearest(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(set_id, similarity) to the most similar other set; zero without any."""
    best = both_ways(pairs).groupBy(F.col("a").alias("set_id")).agg(F.max("similarity").alias("similarity"))
    return sets.select("set_id").join(best, "set_id", "left").fillna(0.0, ["similarity"])


def lineage(own: Column, other: Column) -> Column:
    """child, parent, same or unrelated: by which schema holds the other's features."""
    more, less = F.size(F.array_except(own, other)) > 0, F.size(F.array_except(other, own)) > 0
    return F.when(~more & ~less, "same").when(~less, "child").when(~more, "parent").otherwise("unrelated")


def relation(shared: Column, own: Column, other: Column) -> Column:
    """identical, inside, contains or crossing: by rows."""
    return F.when((shared == own) & (shared == other), "identical").when(shared == own, "inside").when(shared == other, "contains").otherwise("crossing")


def kinship(named: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of centres of similar sets: lineage, relation, and whether the two agree.

    A child (a wider schema) that lies inside, or a parent that contains, is consistent.
    """
    a, b = (named.select(F.col("set_id").alias(x), F.col("features").alias(f"f_{x}"), F.col("cell").alias(f"c_{x}")) for x in "ab")
    met = pairs.join(a, "a").join(b, "b").withColumns({"lineage": lineage(F.col("f_a"), F.col("f_b")), "relation": relation(F.col("shared"), F.col("n_a"), F.col("n_b"))})
    bad = ((F.col("lineage") == "child") & (F.col("relation") == "contains")) | ((F.col("lineage") == "parent") & (F.col("relation") == "inside"))
    return met.withColumn("consistent", ~bad)


def describe(frame: DataFrame, features: list[str], schema: list[str], cell: list[str]) -> DataFrame:
    """(feature, values): what the rows of a centre hold in each feature."""
    labelled = _labelled(frame, features)
    for c, v in zip(schema, cell):
        labelled = labelled.where(F.col(c) == v)
    stacked = labelled.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in features])).alias("x")).select("x.*")
    return stacked.groupBy("feature").agg(F.sort_array(F.collect_set("value")).alias("values"))
