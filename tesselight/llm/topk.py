"""Exact top-k by inner product with a vector-approximation file (operator 10).

Each component x becomes floor(64 * x). The vectors are written once, in blocks of one length: a row
holds the block's ids, for each component the number of the cell that it falls into (one byte;
the cells' edges are the block's own quantiles), the cells' least and greatest values, and, in a
column of its own, the exact components. Then, for queries in chunks:

1. The approximations alone are scanned (Parquet reads only their columns). A query's cells bound
   each vector's score from both sides. A vector whose upper bound is below the k-th best lower
   bound is no answer; each task drops those by its own k-th bound, then all tasks' remaining
   candidates are held against the k-th best of all.
2. The exact components of the blocks that still hold candidates are read. Within a block, a query's
   candidates are scored in the order of their upper bounds, in steps, until the next bound is below
   the k-th score; the k best of all blocks are the answer.

Queries go to the vectors in chunks of at most ``QUERIES`` (a broadcast of known size), read by
ascending id until none is left.

Edge cases: vectors that are null or hold a null or non-finite component take no part; vectors of
different lengths have no score with each other; ties go to the smaller vec_id; rows that repeat a
query's vec_id are its own and no candidates (the query takes the smallest of their vectors);
repeated candidates count once each; components beyond a long's range are held to it, and so are
scores; a null vec_id is no query, and as a candidate comes last in a tie; empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Queries that are broadcast at once; vectors of a block; queries that are compared at once.
QUERIES, BLOCK, SLICE = 8192, 8192, 128
#: Cells of a component (a byte's), and candidates beyond k that are scored in one step.
CELLS, STEP = 256, 16
SEGMENT = "block string, dim int, ids binary, codes binary, low binary, high binary, exact binary"
CANDIDATE = "query_id long, block string, place int, vec_id long, most double, least double"
FOUND = "query_id long, vec_id long, score long"

_NULL_ID = (1 << 63) - 1  # sorts after every other id
_FAR = float((1 << 63) - 1)


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id and integer components of the vectors that take part."""
    x = F.col("embedding")
    finite = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long"), F.transform(x, lambda v: F.floor(v.cast("double") * 64)).alias("v"))


def approximate(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell numbers of each component, and each cell's least and greatest value: (dimensions, CELLS)."""
    n, dim = vectors.shape
    codes = np.empty((n, dim), np.uint8)
    low, high = np.empty((dim, CELLS), np.int64), np.empty((dim, CELLS), np.int64)
    for j in range(dim):
        own = np.sort(vectors[:, j])
        inner = own[np.arange(1, CELLS) * n // CELLS]
        codes[:, j] = np.searchsorted(inner, vectors[:, j], "right")
        # an edge is a value, and a cell ends with the value before the next cell's edge
        low[j] = np.concatenate((own[:1], inner))
        high[j] = np.concatenate((own[np.maximum(np.searchsorted(own, inner, "left") - 1, 0)], own[-1:]))
    return codes, low, high


def written_file(base: DataFrame) -> DataFrame:
    """The approximation file of vectors (vec_id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        held: dict[int, tuple[list, list]] = {}

        def block(dim: int) -> pa.RecordBatch:
            nonlocal seq
            ids, rows = held.pop(dim)
            exact = np.array(rows, np.int64).reshape(len(ids), dim)
            codes, low, high = approximate(exact)
            seq += 1
            values = [f"{part}-{seq}", dim, np.array(ids, np.int64).tobytes(), codes.tobytes(), low.tobytes(), high.tobytes(), exact.tobytes()]
            kinds = [pa.string(), pa.int32(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["block", "dim", "ids", "codes", "low", "high", "exact"])

        for b in batches:
            for vec_id, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids, rows = held.setdefault(len(v), ([], []))
                ids.append(_NULL_ID if vec_id is None else vec_id)
                rows.append(v)
                if len(ids) == BLOCK:
                    yield block(len(v))
        for dim in list(held):
            yield block(dim)

    return written(base.mapInArrow(run, SEGMENT), "approximations")


class Asked:
    """Queries of one length, and how good a vector has to be for each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.tops = np.full((len(ids), k), -np.inf)  # the k best lower bounds
        self.found: list[tuple] = []

    def scan(self, block: str, ids: np.ndarray, codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        dims = np.arange(codes.shape[1])
        a, b = low[dims, codes].astype(float), high[dims, codes].astype(float)
        mid, half = (a + b) / 2, (b - a) / 2
        largest = np.maximum(np.abs(a), np.abs(b)).max(initial=0)
        # sums below this are exact in single precision (halves have one more bit)
        exact32 = largest * np.abs(self.vectors).max(initial=0) * max(1, len(dims)) < 2.0**22
        kind = np.float32 if exact32 else np.float64
        mid, half, asked = mid.T.astype(kind), half.T.astype(kind), self.vectors.astype(kind)
        for s in range(0, len(self.ids), SLICE):
            q = asked[s : s + SLICE]
            middle, reach = q @ mid, np.abs(q) @ half
            if not exact32:
                reach += 2.0**-40 * largest * np.abs(q).sum(1, keepdims=True)
            most, least = np.minimum(middle + reach, _FAR), np.maximum(middle - reach, -_FAR)
            own = ids[None, :] == self.ids[s : s + SLICE, None]
            least[own] = most[own] = -np.inf
            tops = np.concatenate((self.tops[s : s + SLICE], least), axis=1)
            self.tops[s : s + SLICE] = tops = np.partition(tops, tops.shape[1] - self.k, axis=1)[:, -self.k :]
            row, place = np.nonzero((most >= tops[:, :1]) & ~own)
            self.found.append((s + row, np.full(len(row), block), place, ids[place], most[row, place].astype(float), least[row, place].astype(float)))

    def candidates(self) -> pa.RecordBatch:
        cols = [np.concatenate(x) for x in zip(*self.found)] if self.found else [np.zeros(0, np.int64)] * 6
        keep = cols[4] >= self.tops[cols[0], 0]
        row, block, place, ids, most, least = (x[keep] for x in cols)
        none = ids == _NULL_ID
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[row], pa.int64()), pa.array(block.astype(str), pa.string()), pa.array(place.astype(np.int32)), pa.array(ids, pa.int64(), mask=none), pa.array(most.astype(float)), pa.array(least.astype(float))],
            ["query_id", "block", "place", "vec_id", "most", "least"],
        )


def _by_dim(shared, k: int) -> dict[int, Asked]:
    ids, vecs = shared.value
    dims = np.array([len(v) for v in vecs])
    return {d: Asked(np.array(ids)[dims == d], np.array([v for v in vecs if len(v) == d], np.int64).reshape(-1, d), k) for d in set(dims.tolist())}


def _scanner(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = _by_dim(shared, k)
        for b in batches:
            for r in b.to_pylist():
                if r["dim"] in asked:
                    codes = np.frombuffer(r["codes"], np.uint8).reshape(-1, r["dim"])
                    edges = (np.frombuffer(r[x], np.int64).reshape(r["dim"], CELLS) for x in ("low", "high"))
                    asked[r["dim"]].scan(r["block"], np.frombuffer(r["ids"], np.int64), codes, *edges)
        for x in asked.values():
            yield x.candidates()

    return run


def scores(vectors: np.ndarray, query: np.ndarray) -> list[int]:
    """Inner products, held to the range of a long."""
    if np.abs(vectors.astype(float)).max(initial=0) * np.abs(query.astype(float)).max(initial=0) * max(1, vectors.shape[1]) < 2.0**62:
        return (vectors @ query).tolist()
    ints = query.tolist()
    return [max(-(1 << 63), min((1 << 63) - 1, sum(map(int.__mul__, ints, v)))) for v in vectors.tolist()]


def _reader(shared, k: int):
    def run(candidates: pa.Table, blocks: pa.Table) -> pa.Table:
        asked = _by_dim(shared, k)
        out: list[tuple] = []
        if candidates.num_rows:
            dim = blocks.column("dim")[0].as_py()
            exact = np.frombuffer(blocks.column("exact")[0].as_py(), np.int64).reshape(-1, dim)
            query = {q: v for q, v in zip(asked[dim].ids.tolist(), asked[dim].vectors)}
            ids, places, most = (candidates.column(x).to_numpy() for x in ("query_id", "place", "most"))
            vec_ids = candidates.column("vec_id").to_pylist()
            order = np.lexsort((-most, ids))
            for part in np.split(order, np.flatnonzero(np.diff(ids[order])) + 1):
                q, best, at = int(ids[part[0]]), [], 0
                while at < len(part) and (len(best) < k or most[part[at]] >= -best[k - 1][0]):
                    step = part[at : at + k + STEP if not at else at + STEP]
                    at += len(step)
                    new = zip(scores(exact[places[step]], query[q]), (vec_ids[i] for i in step))
                    best = sorted([*best, *((-s, _NULL_ID if i is None else i) for s, i in new)])[:k]
                out += [(q, None if i == _NULL_ID else i, -s) for s, i in best]
        cols = list(zip(*out)) or [()] * 3
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Of each row of ``queries`` the k highest scores among ``vectors``: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    file = written_file(whole(vectors))
    asked = whole(queries).where("vec_id is not null").groupBy("vec_id").agg(F.min("v").alias("v"))
    found, last = None, None
    while True:
        rows = (asked if last is None else asked.where(F.col("vec_id") > last)).orderBy("vec_id").limit(QUERIES).toArrow()
        if rows.num_rows:
            ids, vecs = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            last = ids[-1]
            shared = spark.sparkContext.broadcast((ids, vecs))
            able = written(file.drop("exact").mapInArrow(_scanner(shared, k), CANDIDATE), "candidates")
            by_bound = Window.partitionBy("query_id").orderBy(F.desc("least"))
            kth = able.select("query_id", "least", F.row_number().over(by_bound).alias("r")).where(F.col("r") <= k).where(F.col("r") == k).select("query_id", F.col("least").alias("floor"))
            able = able.join(kth, "query_id", "left").where(F.col("floor").isNull() | (F.col("most") >= F.col("floor"))).drop("floor", "least")
            read = able.groupBy("block").cogroup(file.select("block", "dim", "exact").groupBy("block")).applyInArrow(_reader(shared, k), FOUND)
            found = read if found is None else found.unionAll(read)
        if rows.num_rows < QUERIES:
            break
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
      FROM v AS q, v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e))
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
