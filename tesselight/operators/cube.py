"""The bounded cube: every combination of one to four features, grouped and counted.

Two physical forms give the same table (schema_id, d, features, cell, n, k):

``grouping_sets`` declares one GROUPING SETS aggregate. ``arrow`` first sums equal rows (a partial
aggregate, after which a categorical frame is small whatever its rows), then counts all schemas of
a batch in arrays and leaves one row per schema, cell and task to a final aggregate, where GROUPING
SETS would multiply every row by the number of schemas.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text of a missing category in a cell.
MISSING = "missing"
#: Schemas that are counted together over the same rows; rows go to each such chunk.
SCHEMAS_A_CHUNK = 400
CELLS = "schema_id int, code binary, n long, k long"


def schemas(features: list[str], widest: int) -> list[tuple[str, ...]]:
    """Combinations by width, in the order of the columns; a schema's id is its place here."""
    return [c for d in range(1, min(widest, len(features)) + 1) for c in combinations(features, d)]


def renamed(schema: tuple[str, ...], exact: dict[str, set[str]], occupied: dict[tuple[str, ...], int], fit: int) -> bool:
    """Whether ``schema`` only repeats a narrower one.

    It does if it holds x and y, x determines y exactly, and the schema without y is searched as it
    stands: it has been counted and its cells are within the capacity. (Beyond it, the two are merged
    in different ways.)
    """
    return len(schema) > 1 and any(y in exact.get(x, ()) and occupied.get(tuple(c for c in schema if c != y), fit + 1) <= fit for x in schema for y in schema if x != y)


def pruned_cells(frame: DataFrame, features: list[str], widest: int, exact: dict[str, set[str]], fit: int, form: str = "arrow") -> tuple[DataFrame, list[tuple[str, ...]]]:
    """Raw cells without schemas that only repeat a narrower one, and the schemas counted.

    Width by width: a schema's cells have to be known before wider ones can repeat it.
    """
    place = {s: i for i, s in enumerate(schemas(features, widest))}
    occupied: dict[tuple[str, ...], int] = {}
    out = None
    for d in range(1, min(widest, len(features)) + 1):
        only = [s for s in combinations(features, d) if not renamed(s, exact, occupied, fit)]
        if not only:
            continue
        part = cells(frame, features, d, only=only, form=form).persist()
        if exact and d < widest:
            occupied |= {tuple(r["features"]): r["c"] for r in part.groupBy("features").agg(F.count("*").alias("c")).collect()}
        else:
            occupied |= dict.fromkeys(only, fit + 1)
        # ids as without pruning
        ids = frame.sparkSession.createDataFrame([(i, place[s]) for i, s in enumerate(only)], "schema_id int, _id int")
        part = part.join(ids, "schema_id").withColumn("schema_id", F.col("_id")).drop("_id")
        out = part if out is None else out.unionByName(part)
    return out, [s for s in place if s in occupied]


def labels(value: Column) -> Column:
    """A level's name in a cell: its text, or MISSING. A text that reads like this name is quoted."""
    return F.coalesce(F.when(value.rlike(f"^'*{MISSING}'*$"), F.concat(F.lit("'"), value, F.lit("'"))).otherwise(value), F.lit(MISSING))


def _labelled(frame: DataFrame, features: list[str]) -> DataFrame:
    return frame.select(*[labels(F.col(c).cast("string")).alias(c) for c in features], *[c for c in frame.columns if c not in features])


def cells_by_sets(frame: DataFrame, features: list[str], widest: int, only: list[tuple[str, ...]] | None = None, by: list[str] | None = None) -> DataFrame:
    """Cells by GROUPING SETS. ``by``: further columns that every grouping keeps."""
    by = by or []
    wanted = only or schemas(features, widest)
    ids = {s: i for i, s in enumerate(wanted)}
    k = {"k": F.sum("z").cast("long")} if "z" in frame.columns else {}
    grouped = _labelled(frame, features).groupingSets([[F.col(c) for c in (*by, *s)] for s in wanted], *[F.col(c) for c in (*by, *features)])
    out = grouped.agg(F.grouping_id().alias("_g"), F.count("*").alias("n"), *[v.alias(name) for name, v in k.items()])
    bits = {s: sum(1 << (len(features) - 1 - i) for i, c in enumerate(features) if c not in s) for s in wanted}
    which = F.create_map(*[F.lit(x) for s in wanted for x in (bits[s], ids[s])])
    out = out.withColumn("schema_id", which[F.col("_g").cast("int")])
    cell = F.filter(F.array(*[F.when(F.col("_g").bitwiseAND(1 << (len(features) - 1 - i)) == 0, F.col(c)) for i, c in enumerate(features)]), lambda v: v.isNotNull())
    return _named(out.withColumn("cell", cell), wanted).select(*by, "schema_id", "d", "features", "cell", "n", *k)


def _named(df: DataFrame, wanted: list[tuple[str, ...]]) -> DataFrame:
    names = F.create_map(*[F.lit(x) for i, s in enumerate(wanted) for x in (i, "+".join(s))]) if len(wanted) <= 500 else None
    if names is None:
        spark = df.sparkSession
        table = spark.createDataFrame([(i, "+".join(s)) for i, s in enumerate(wanted)], "schema_id int, _f string")
        df = df.join(table, "schema_id").withColumn("features", F.split("_f", r"\+")).drop("_f")
    else:
        df = df.withColumn("features", F.split(names[F.col("schema_id")], r"\+"))
    return df.withColumn("d", F.size("features"))


def _dense(group: np.ndarray, many: int) -> tuple[np.ndarray, int]:
    """Numbers below ``many`` as places among those that occur."""
    if many <= 8 * len(group) + 4096:
        seen = np.zeros(many, bool)
        seen[group] = True
        rank = np.cumsum(seen) - 1
        return rank[group], int(rank[-1]) + 1
    found, group = np.unique(group, return_inverse=True)
    return group.reshape(-1), len(found)


def _counted(rows: pa.RecordBatch, width: int, first: int, wanted: list[tuple[int, ...]]) -> Iterator[tuple]:
    """(schema, cell, n, k) arrays of each wanted tuple of columns.

    Tuples come in the order of combinations, so most start as the one before, whose groups are kept.
    """
    if not rows.num_rows:
        return
    codes, words = [], []
    for i in range(width):
        e = rows.column(i).dictionary_encode()
        codes.append(np.asarray(e.indices, np.int64))
        # 1E keeps the separator 1F apart from what a label holds
        words.append(pa.array([v.replace("\x1e", "\x1e0").replace("\x1f", "\x1e1") for v in e.dictionary.to_pylist()], pa.string()))
    n, k = (np.asarray(rows.column(i)).astype(np.float64) for i in (width, width + 1))  # exact below 2 ** 53
    back = np.arange(rows.num_rows)[::-1]
    path: list[tuple[int, np.ndarray, int]] = []
    for schema, cols in enumerate(wanted, first):
        same = 0
        while same < min(len(path), len(cols)) and path[same][0] == cols[same]:
            same += 1
        del path[same:]
        for c in cols[same:]:
            group, size = (path[-1][1], path[-1][2]) if path else (np.zeros(rows.num_rows, np.int64), 1)
            path.append((c, *_dense(group * len(words[c]) + codes[c], size * len(words[c]))))
        _, group, size = path[-1]
        one = np.empty(size, np.int64)
        one[group[::-1]] = back  # the first row of each group
        cell = pc.binary_join_element_wise(*[words[c].take(pa.array(codes[c][one])) for c in cols], "\x1f")
        yield np.full(size, schema, np.int32), cell, np.bincount(group, n, size).astype(np.int64), np.bincount(group, k, size).astype(np.int64)


def _joined(done: list[list]) -> pa.RecordBatch:
    schema, cell, n, k = done
    out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(schema)), pa.concat_arrays(cell).cast(pa.binary()), pa.array(np.concatenate(n)), pa.array(np.concatenate(k))], ["schema_id", "code", "n", "k"])
    for x in done:
        x.clear()
    return out


def cells_by_arrays(frame: DataFrame, features: list[str], widest: int, only: list[tuple[str, ...]] | None = None, by: str | None = None) -> DataFrame:
    """Cells by partial counts in Arrow batches and a final aggregate.

    ``by``: a further column, as text, that tells cells apart; it stays null where it is null.
    """
    wanted = only or schemas(features, widest)
    if by:
        frame = frame.withColumn(by, F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("")))
    given, features = features, [*([by] if by else []), *features]
    frame = frame if "z" in frame.columns else frame.withColumn("z", F.lit(0))
    small = _labelled(frame.select("z", *features), given).groupBy(*features).agg(F.count("*").alias("n"), F.sum("z").cast("long").alias("k"))
    place = {c: i for i, c in enumerate(features)}
    columns = [tuple([*([0] if by else []), *(place[c] for c in s)]) for s in wanted]
    chunks = max(1, -(-len(wanted) // SCHEMAS_A_CHUNK))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[list[np.ndarray | pa.Array]] = [[], [], [], []]
        for b in batches:
            which = np.asarray(b.column(len(features) + 2))
            for chunk in np.unique(which).tolist():
                rows = b.filter(pa.array(which == chunk)) if chunks > 1 else b
                first = chunk * SCHEMAS_A_CHUNK
                for part in _counted(rows, len(features), first, columns[first : first + SCHEMAS_A_CHUNK]):
                    for held, x in zip(done, part):
                        held.append(x)
                    if sum(map(len, done[0])) >= 1 << 16:
                        yield _joined(done)
            if done[0]:
                yield _joined(done)

    dealt = small.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    if chunks > 1:  # schemas are work as rows are: both are dealt out
        splits = max(1, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")) // chunks)
        dealt = dealt.repartition(chunks * splits, "_chunk", F.pmod(F.xxhash64(*features), F.lit(splits)))
    out = dealt.select(*features, "n", "k", "_chunk").mapInArrow(count, CELLS)
    out = out.groupBy("schema_id", "code").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    plain = lambda v: F.replace(F.replace(v, F.lit("\x1e1"), F.lit("\x1f")), F.lit("\x1e0"), F.lit("\x1e"))
    out = _named(out, wanted).withColumn("cell", F.transform(F.split(F.col("code").cast("string"), "\x1f"), plain))
    if not by:
        return out.select("schema_id", "d", "features", "cell", "n", "k")
    own = F.when(F.col("cell")[0] != "", F.substring(F.col("cell")[0], 2, 1 << 30))
    return out.select(own.alias(by), "schema_id", "d", "features", F.slice("cell", F.lit(2), F.col("d")).alias("cell"), "n", "k")


def cells(frame: DataFrame, features: list[str], widest: int = 4, only: list[tuple[str, ...]] | None = None, form: str = "arrow") -> DataFrame:
    """(schema_id, d, features, cell, n, k) for each occupied cell of each schema."""
    return (cells_by_arrays if form == "arrow" else cells_by_sets)(frame, features, widest, only)


def value_cells(frame: DataFrame, features: list[str], value: str, widest: int = 4) -> tuple[DataFrame, DataFrame]:
    """(cells, cells times the values of a target column) from one enumeration.

    The first has n, a cell's rows; the second (value, schema_id, d, features, cell, k), k of these
    rows having the value, for cells where there are any.
    """
    own = frame.select(*features, F.col(value).cast("string").alias("_value"))
    counted = cells_by_arrays(own, features, widest, by="_value").drop("k").persist()
    sizes = counted.groupBy("schema_id", "d", "features", "cell").agg(F.sum("n").alias("n"))
    return sizes, counted.where(F.col("_value").isNotNull()).select(F.col("_value").alias("value"), "schema_id", "d", "features", "cell", F.col("n").alias("k"))
