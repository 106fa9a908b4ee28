"""Searched partitions: schemas with too many cells are merged until they fit the grid's capacity.

All schemas are settled together: each round tries one state per open schema on the cell table
(never on rows), counts merged cells, and halves the range of states left. Sums, and fingerprints
by exclusive or, roll up from raw cells to merged ones.

A partition depends on rows and features, not on the target, so one serves every value of a target,
every permutation of it and every fold, by :meth:`Partition.apply`. Where folds are to choose their
own (``per``), each is settled on its training cells in the same rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cube import _labelled, labels, schemas
from .encoding import capacity, dictionary, merge_state, merge_steps

#: Levels of all features together that the merge maps may hold.
MOST_LEVELS = 500_000

#: What a partition is settled for: the values of ``per``, and a schema.
Key = tuple


@dataclass
class Levels:
    """Levels of each column with their counts, and merged labels made from them when asked for."""

    #: (values of ``per``, column) -> [(code, label, count)]; a level with count 0 was not fitted on.
    known: dict[tuple[Key, str], list[tuple[int, str, int]]]
    ordered: dict[str, bool]
    made: dict[tuple[Key, str, int], dict[str, str]] = field(default_factory=dict)

    def size(self, per: Key, col: str) -> int:
        return max(1, sum(cnt > 0 for *_, cnt in self.known[per, col]))

    def merged(self, per: Key, col: str, k: int) -> dict[str, str]:
        """label -> merged label, for k groups.

        A level that was not fitted on is "other" (the last group) of a nominal column and goes with
        the nearest lower level of an ordered one, or the first.
        """
        if (per, col, k) not in self.made:
            levels = sorted(self.known[per, col])
            if self.ordered.get(col):
                total, before, raw = sum(c for *_, c in levels), 0, []
                for _, label, c in levels:
                    raw.append((label, before * k // total if c else raw[-1][1] if raw else 0))
                    before += c
                dense = {g: i for i, g in enumerate(sorted({g for _, g in raw}))}
                out = {label: f"#{dense[g]}" for label, g in raw}
            else:
                top = sorted((x for x in levels if x[2]), key=lambda x: (-x[2], x[0]))
                out = {label: f"#{k - 1}" for _, label, _ in levels}
                out |= {label: f"#{min(i, k - 1)}" for i, (_, label, _) in enumerate(top)}
            self.made[per, col, k] = out
        return self.made[per, col, k]


@dataclass
class Partition:
    """Which schemas are merged, and how."""

    levels: Levels
    per: tuple[str, ...]
    #: (values of ``per``, schema_id) -> features, and the steps of merging.
    crowded: dict[tuple[Key, int], list[str]]
    steps: dict[tuple[Key, int], int]

    def _tables(self, at: dict[tuple[Key, int], int]) -> dict:
        out = {}
        for (per, schema), step in at.items():
            features = self.crowded[per, schema]
            sizes = [self.levels.size(per, c) for c in features]
            out[per, schema] = [self.levels.merged(per, c, k) if k < n else None for c, n, k in zip(features, sizes, merge_state(sizes, step))]
        return out

    def relabelled(self, df: DataFrame, at: dict[tuple[Key, int], int] | None = None) -> DataFrame:
        """``df`` (schema_id, cell, the columns of ``per``, any others) with merged cells; nothing is summed."""
        tables, per = self._tables(self.steps if at is None else at), list(self.per)

        def relabel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                own = zip(*(b[c] for c in per)) if per else iter(lambda: (), None)
                cells = []
                for key, schema, cell in zip(own, b["schema_id"], b["cell"]):
                    table = tables.get((tuple(key), schema))
                    cells.append(list(cell) if table is None else [v if t is None else t[v] for t, v in zip(table, cell)])
                b["cell"] = cells
                yield b

        return df.mapInPandas(relabel, df.schema)

    def _summed(self, df: DataFrame, by: list[str], at=None) -> DataFrame:
        keys = [*by, "schema_id", "d", "features", "cell"]
        prints = [c for c in ("a", "b") if c in df.columns]
        sums = [c for c in df.columns if c not in (*keys, *prints)]
        out = self.relabelled(df, at).groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in sums], *[F.bit_xor(c).alias(c) for c in prints])
        return out.select(*df.columns)

    def apply(self, cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        """Merged cells; ``by``: columns that tell cells of one schema apart, beside ``per``."""
        ids = sorted({s for _, s in self.crowded})
        if not ids:
            return cells
        hit = F.col("schema_id").isin(ids)
        return cells.where(~hit).unionByName(self._summed(cells.where(hit), [*self.per, *by]))


def words_of(frame: DataFrame, features: list[str]) -> DataFrame:
    """(col, code, label, cnt): levels in their columns' order, as cells name them."""
    words = dictionary(frame.select(*features))
    return words.select("col", "code", labels(F.col("value")).alias("label"), "cnt")


def settle(cells: DataFrame, words: DataFrame, rows: int | dict[Key, int], ordered: dict[str, bool] | None = None, per: tuple[str, ...] = ()) -> Partition:
    """The partition of raw ``cells`` within the capacity of ``rows`` (for each ``per``, if any).

    ``words``: (per, col, code, label, cnt).
    """
    fits = {k: capacity(n) for k, n in rows.items()} if isinstance(rows, dict) else {(): capacity(rows)}
    many = cells.groupBy(*per, "schema_id", "features").agg(F.count("*").alias("c")).where(F.col("c") > min(fits.values(), default=0))
    crowded = {(k, r["schema_id"]): list(r["features"]) for r in many.collect() if r["c"] > fits[k := tuple(r[c] for c in per)]}
    part = Partition(Levels({}, ordered or {}), per, crowded, dict.fromkeys(crowded, 0))
    if not crowded:
        return part
    wanted = words.where(F.col("col").isin(sorted({c for f in crowded.values() for c in f})))
    if wanted.count() > MOST_LEVELS:
        raise ValueError(f"more than {MOST_LEVELS} levels: drop identifiers from the features")
    for r in wanted.collect():
        part.levels.known.setdefault((tuple(r[c] for c in per), r["col"]), []).append((r["code"], r["label"], r["cnt"]))
    raw = cells.where(F.col("schema_id").isin(sorted({s for _, s in crowded}))).select(*per, "schema_id", "d", "features", "cell", "n")
    low = dict.fromkeys(crowded, 0)
    high = {(k, s): merge_steps([part.levels.size(k, c) for c in f]) for (k, s), f in crowded.items()}
    while open_ := [x for x in crowded if low[x] < high[x]]:
        at = {x: (low[x] + high[x]) // 2 for x in open_}
        some = raw.where(F.col("schema_id").isin(sorted({s for _, s in open_})))
        counted = part._summed(some, list(per), at).groupBy(*per, "schema_id").agg(F.count("*").alias("c"))
        count = {(tuple(r[c] for c in per), r["schema_id"]): r["c"] for r in counted.collect()}
        for x in open_:
            if count[x] <= fits[x[0]]:
                high[x] = at[x]
            else:
                low[x] = at[x] + 1
    part.steps.update(low)
    return part


def coarsened(cells: DataFrame, frame: DataFrame, features: list[str], rows: int, ordered: dict[str, bool] | None = None) -> DataFrame:
    """``cells`` with every schema within the capacity of ``rows``; merged levels are ``#group``.

    Columns beyond schema_id, d, features, cell and n are sums, but for ``a`` and ``b``, which are
    fingerprints.
    """
    return settle(cells, words_of(frame, features), rows, ordered).apply(cells)


def family_size(frame: DataFrame, features: list[str], row_id: str, widest: int = 4, ordered: dict[str, bool] | None = None) -> int:
    """Distinct row sets over all cells of all schemas, as searched and as displayed.

    A set is told by its size and two 64-bit fingerprints.
    """
    prints = frame.select(*features, F.xxhash64(F.lit(1), row_id).alias("_pa"), F.xxhash64(F.lit(2), row_id).alias("_pb"))
    wanted = schemas(features, widest)
    # rows that agree in all features are one row from here on
    small = _labelled(prints, features).groupBy(*features).agg(F.count("*").alias("_n"), F.bit_xor("_pa").alias("_pa"), F.bit_xor("_pb").alias("_pb")).persist()
    grouped = small.groupingSets([[F.col(c) for c in s] for s in wanted], *[F.col(c) for c in features])
    sets = grouped.agg(F.grouping_id().alias("_g"), F.sum("_n").alias("n"), F.bit_xor("_pa").alias("_xa"), F.bit_xor("_pb").alias("_xb"))
    bits = {s: sum(1 << (len(features) - 1 - i) for i, c in enumerate(features) if c not in s) for s in wanted}
    ids = F.create_map(*[F.lit(x) for i, s in enumerate(wanted) for x in (bits[s], i)])
    cell = F.filter(F.array(*[F.when(F.col("_g").bitwiseAND(1 << (len(features) - 1 - i)) == 0, F.col(c)) for i, c in enumerate(features)]), lambda v: v.isNotNull())
    names = F.create_map(*[F.lit(x) for i, s in enumerate(wanted) for x in (i, "+".join(s))])
    raw = sets.select(ids[F.col("_g").cast("int")].alias("schema_id"), cell.alias("cell"), "n", F.col("_xa").alias("a"), F.col("_xb").alias("b"))
    raw = raw.withColumn("features", F.split(names[F.col("schema_id")], r"\+")).withColumn("d", F.size("features")).persist()
    searched = coarsened(raw.select("schema_id", "d", "features", "cell", "n", "a", "b"), frame, features, small.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0], ordered)
    out = raw.select("n", "a", "b").unionAll(searched.select("n", "a", "b")).distinct().count()
    raw.unpersist()
    small.unpersist()
    return out

