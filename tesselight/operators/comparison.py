"""Selectors of groups compared on the same held-out folds under the same budget of conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import Rule
from .baselines import budgeted_schema, greedy_chain, greedy_cover, held_out
from .cube import _labelled, cells, schemas
from .redundancy import MOST_SETS
from .search import centres, scores
from .validation import folds

Group = dict[str, str]


def rule_groups(train: DataFrame, features: list[str], rule: Rule, budget: int, row_id: str, widest: int) -> list[Group]:
    """Qualifying conjunctions that cover most positives under the budget, greedily.

    Conjunctions with the same positives count once, the first and so the shortest. The choice is
    sequential; it runs on the positives of qualifying cells, and refuses beyond MOST_SETS cells.
    """
    found = centres(cells(train, features, widest), rule).where("is_centre").orderBy("schema_id", "cell").collect()
    if len(found) > MOST_SETS:
        raise ValueError(f"more than {MOST_SETS} qualifying cells")
    wanted = schemas(features, widest)
    keyed = _labelled(train.where("z = 1").select(row_id, *features), features)
    keys = F.array(*[F.struct(F.lit(i).alias("schema_id"), F.array(*[F.col(c) for c in s]).alias("cell")) for i, s in enumerate(wanted)])
    chosen = train.sparkSession.createDataFrame([(r["schema_id"], r["cell"]) for r in found], "schema_id int, cell array<string>")
    rows = keyed.select(F.col(row_id).alias("row"), F.explode(keys).alias("x")).select("row", "x.*").join(chosen, ["schema_id", "cell"])
    held = {(r["schema_id"], tuple(r["cell"])): frozenset(r["rows"]) for r in rows.groupBy("schema_id", "cell").agg(F.collect_list("row").alias("rows")).collect()}
    sets: dict[int, frozenset] = {}
    seen: set[frozenset] = set()
    for i, r in enumerate(found):
        s = held.get((r["schema_id"], tuple(r["cell"])), frozenset())
        if s and s not in seen:
            seen.add(s)
            sets[i] = s
    picked = greedy_cover(sets, {i: found[i]["d"] for i in sets}, budget)
    return [dict(zip(found[i]["features"], found[i]["cell"])) for i in picked]


def schema_groups(train: DataFrame, features: list[str], rule: Rule, budget: int, widest: int, only: list[tuple[str, ...]] | None = None) -> list[Group]:
    """The cells of the one schema that covers most under the budget."""
    best = budgeted_schema(cells(train, features, widest, only=only), rule, budget).orderBy("place").collect()
    return [dict(zip(r["features"], r["cell"])) for r in best]


def chain_groups(train: DataFrame, features: list[str], rule: Rule, budget: int, widest: int) -> list[Group]:
    """The same, among schemas that grow greedily by one feature."""
    chain = greedy_chain(scores(cells(train, features, widest), rule).cache(), widest)
    return schema_groups(train, features, rule, budget, widest, [tuple(c) for c in chain]) if chain else []


def one_fold(train: DataFrame, test: DataFrame, features: list[str], rule: Rule, budget: int, row_id: str, widest: int = 2) -> DataFrame:
    """(method, groups, conditions, n, k, positives, coverage, purity, net_coverage) on ``test``."""
    picked = {
        "schema": schema_groups(train, features, rule, budget, widest),
        "chain": chain_groups(train, features, rule, budget, widest),
        "rules": rule_groups(train, features, rule, budget, row_id, widest),
    }
    out = None
    for method, groups in picked.items():
        spent = sum(map(len, groups))
        if spent > budget:
            raise AssertionError(f"{method} spent {spent} of {budget} conditions")
        part = held_out(test, groups, rule.tau).select(F.lit(method).alias("method"), F.lit(len(groups)).alias("groups"), F.lit(spent).alias("conditions"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def compare(frame: DataFrame, features: list[str], rule: Rule, budget: int, row_id: str, k: int = 5, repeats: int = 1, widest: int = 2, seed: int = 0) -> DataFrame:
    """One row per (rep, fold, method); folds are the same for all methods, so results are paired."""
    folded = folds(frame, row_id, k, repeats, seed).persist()
    out = None
    for rep in range(repeats):
        for fold in range(k):
            of = folded.where(F.col("rep") == rep)
            train, test = (of.where(c).select(row_id, "z", *features) for c in (F.col("fold") != fold, F.col("fold") == fold))
            part = one_fold(train, test, features, rule, budget, row_id, widest).select(F.lit(rep).alias("rep"), F.lit(fold).alias("fold"), "*")
            out = part if out is None else out.unionAll(part)
    return out


def summarised(results: DataFrame, tau: float, k: int = 5) -> DataFrame:
    """Per method: mean coverage and net coverage with errors widened for shared rows, how often purity holds."""
    wide = lambda c: F.sqrt((1 / F.count(c) + F.lit(1 / (k - 1))) * F.var_samp(c))
    held = F.avg(F.when(F.col("n") > 0, (F.col("k") >= tau * F.col("n") - 1e-9).cast("int")))
    return results.groupBy("method").agg(
        F.avg("coverage").alias("coverage"), wide("coverage").alias("coverage_error"), F.avg("net_coverage").alias("net_coverage"),
        wide("net_coverage").alias("net_error"), held.alias("purity_holds"), F.avg("conditions").alias("conditions"), F.count("*").alias("folds"),
    )
