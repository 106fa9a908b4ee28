"""Near-duplicate groups by MinHash (operator 2).

1. Each text becomes its set of 5-word shingles (64-bit hashes), the set's digest and a signature
   of ``COORDINATES`` minima. Texts with equal sets are one class, its smallest doc_id stands for it.
2. Signature-coordinate inverted join: a class is posted under its (coordinate, value) pairs. Two
   sets of similarity s agree in a binomial number of coordinates with mean s * COORDINATES; pairs
   that agree in at least ``MATCHES`` are of interest. In each class's pairs, ordered by how many
   classes hold them, two such classes share one among the first COORDINATES - MATCHES + 1, so only
   these prefixes are posted: what stands in a common passage comes last and is skipped, and values
   that one class alone holds use up the prefix without being posted at all.
3. Links are confirmed on full sets, without forming all pairs of a posting list: a class meets one
   other, the pivot that it shares most lists with; confirmed links join components, and lists
   within one component are skipped. Classes in lists that hold several components then count the
   shingles that they share with any other component, their reach: a link needs as much overlap,
   so a class (such as a copy with many edits of its own) whose reach is too short meets nobody.
   The others meet pivots again, in lists by bands of coordinates, which near copies share. What
   is left is settled pair by pair, so no link between components is lost. Lists with the same
   pivot (their smallest class) are one block, so that a pair is compared in few places however
   many lists it shares; within a block, classes outside its largest component are compared with
   all, on reach, agreement of signatures and an upper bound of the overlap from bitmaps, and the
   pairs that pass are confirmed or refuted on full sets.

A pair of similarity 0.75 agrees in fewer than MATCHES = 20 of 64 coordinates with probability
below 1e-13; that is the only way to miss a link. Within a block, comparisons (not rows) grow with
its classes times those that no link has joined to its largest component.

Edge cases: text that is null or has no words has an empty set, no links and is kept; rows that
share a doc_id share its component; rows with a null doc_id take part in no link, have no component
and are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, blocks, collected, release, shingle_sets, tasks, utf8, written
from .components import components

SHINGLE, SIMILARITY = 5, 75  # words; percent
COORDINATES, MATCHES = 64, 20
PREFIX = COORDINATES - MATCHES + 1
#: Rounds over bands of BAND coordinates.
BAND_ROUNDS, BAND = 2, 6
#: Bits of a class's bitmap; classes of a block that are compared at once: outsiders, and all.
SKETCH, PART, SLICE = 4096, 512, 512

_SEEDS = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 62, (COORDINATES, 2), dtype=np.int64).astype(U64) * U64(2) + U64(1)


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(sets, COORDINATES) minima; empty sets have zeros."""
    out = np.zeros((len(offsets) - 1, COORDINATES), np.int32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        at = offsets[:-1][full]
        for k, (a, b) in enumerate(_SEEDS):
            v = ((hashes ^ b) * a >> U64(32)).astype(np.uint32)
            out[full, k] = np.minimum.reduceat(v, at).view(np.int32)
    return out


SIGNED = "doc_id long, n_shingles long, set_hash binary, signature array<int>"


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            buf, offsets = utf8(b.column(1))
            for i, j in blocks(offsets):
                hashes, at = shingle_sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SHINGLE)
                digests = [hashlib.blake2b(hashes[s:e].tobytes(), digest_size=16).digest() for s, e in zip(at.tolist(), at[1:].tolist())]
                sig = signatures(hashes, at)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * COORDINATES), pa.array(sig.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array(digests, pa.binary()), lists], ["doc_id", "n_shingles", "set_hash", "signature"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SIGNED)


def postings(classes: DataFrame) -> DataFrame:
    """(token, rep): each class under the prefix of its shared (coordinate, value) pairs."""
    # one long for the pair: coordinate above, value below
    tokens = classes.select("rep", F.posexplode("signature").alias("c", "v")).select("rep", (F.shiftleft(F.col("c").cast("long"), 32) + F.col("v").bitwiseAND(F.lit(0xFFFFFFFF))).alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    listed = tokens.join(shared, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("x"))
    # pairs that no other class holds come first and use up the prefix
    room = F.lit(PREFIX - COORDINATES) + F.size("x")
    return listed.where(room > 0).select("rep", F.explode(F.slice("x", F.lit(1), room)).alias("x")).select("x.token", "rep")


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of ``pairs`` (a, b) those whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            a, at = utf8(batch.column(2))
            b, bt = utf8(batch.column(3))
            for i, j in blocks(at + bt):
                x, xo = shingle_sets(a[at[i] : at[j]], at[i : j + 1] - at[i], SHINGLE)
                y, yo = shingle_sets(b[bt[i] : bt[j]], bt[i : j + 1] - bt[i], SHINGLE)
                for k in range(j - i):
                    p, q = x[xo[k] : xo[k + 1]], y[yo[k] : yo[k + 1]]
                    if len(p) and len(q):
                        both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                        keep[i + k] = 100 * both >= SIMILARITY * (len(p) + len(q) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    one, two = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _pivots(lists: DataFrame) -> DataFrame:
    """(a, b): for each class the pivot, of another component, that most of its lists have.

    ``lists``: (token, rep, comp). A list's pivot is its smallest class.
    """
    heads = lists.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(F.struct("rep", "comp")).alias("p")).where("low <> high")
    met = lists.join(heads.select("token", F.col("p.rep").alias("pivot"), F.col("p.comp").alias("of")), "token").where("comp <> of")
    counted = met.groupBy("rep", "pivot").agg(F.count("*").alias("n"))
    return counted.groupBy("rep").agg(F.max(F.struct("n", (-F.col("pivot")).alias("m"))).alias("x")).select(F.col("rep").alias("a"), (-F.col("x.m")).alias("b"))


def reach(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """(rep, s): how many of each class's shingles a class of another component holds too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offsets = utf8(b.column(2))
            for i, j in blocks(offsets):
                hashes, at = shingle_sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SHINGLE)
                own = [np.repeat(np.asarray(b.column(k))[i:j], np.diff(at)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, own), pa.array(hashes.view(np.int64))], ["rep", "comp", "h"])

    held = texts.join(placed, "rep").select("rep", "comp", "text").mapInArrow(run, "rep long, comp long, h long")
    both = held.groupBy("h").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("h")
    return held.join(both, "h").groupBy("rep").agg(F.count("*").alias("s"))


def sketched(able: DataFrame, texts: DataFrame) -> DataFrame:
    """``able`` with ``bits``: a bitmap of SKETCH bits that has each shingle's bit set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offsets = utf8(b.column(1))
            bits = np.zeros((b.num_rows, SKETCH), bool)
            for i, j in blocks(offsets):
                hashes, at = shingle_sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SHINGLE)
                bits[np.repeat(np.arange(i, j), np.diff(at)), (hashes % U64(SKETCH)).astype(np.int64)] = True
            packed = np.packbits(bits, axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in packed], pa.binary())], ["rep", "bits"])

    return able.join(texts.join(able.select("rep"), "rep", "left_semi").select("rep", "text").mapInArrow(run, "rep long, bits binary"), "rep")


def blocks_of(lists: DataFrame) -> DataFrame:
    """(pivot, rep, comp): each class once for each pivot that heads a list of its.

    ``lists``: (token, rep, comp). A list's pivot is its smallest class, so two classes that share
    a list share its pivot, and the many lists of one group of near copies, whose pivot is mostly
    the same, become one block. A block holds no class without a list in common with its pivot.
    """
    heads = lists.groupBy("token").agg(F.min("rep").alias("pivot"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    return lists.join(heads.select("token", "pivot"), "token").select("pivot", "rep", "comp").distinct()


def left_over(block: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): pairs that share a block, not a component, and may reach the similarity.

    ``classes``: (rep, n, s, signature, bits). A pair lies in a block with one class at least
    outside of the block's largest component. Such outsiders are dealt into parts of about PART
    and all classes into slices of about SLICE; each cell, a part beside a slice, is compared in
    arrays: reach, agreement of signatures, and the overlap that the bitmaps allow (shingles whose
    bit the other has not are no common ones). Only pairs that pass all are put out. A class
    stands in as many cells as its block has parts (and slices, if it is an outsider): once or
    twice, but in blocks with many classes that no link has joined.
    """
    each = block.groupBy("pivot", "comp").agg(F.count("*").alias("m"))
    sizes = each.groupBy("pivot").agg(F.sum("m").alias("all"), F.max(F.struct("m", F.col("comp").alias("of"))).alias("top")).where("top.m < all")
    sizes = sizes.select("pivot", F.col("top.of").alias("inner"), F.ceil((F.col("all") - F.col("top.m")) / PART).cast("int").alias("parts"), F.ceil(F.col("all") / SLICE).cast("int").alias("slices"))
    sizes = written(sizes, "sizes")  # so that the join below can be dealt anew where a block is large
    dealt = block.join(sizes, "pivot").withColumns({"part": F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"), "slice": F.pmod(F.xxhash64("rep", F.lit(1)), F.col("slices")).cast("int")})
    along = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(i.alias("i"), F.col("slice").alias("j"), F.lit(False).alias("out")))
    across = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda j: F.struct(F.col("part").alias("i"), j.alias("j"), F.lit(True).alias("out")))
    cells = dealt.select("pivot", "rep", "comp", F.explode(F.when(F.col("comp") == F.col("inner"), along).otherwise(F.concat(along, across))).alias("x"))
    cells = cells.select("pivot", "x.i", "x.j", "x.out", "rep", "comp").join(classes, "rep")

    def compare(cell: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        out, rep, comp, n, s = (cell.column(k).to_numpy() for k in (3, 4, 5, 6, 7))
        sig = cell.column(8).combine_chunks().flatten().to_numpy().reshape(len(rep), COORDINATES)
        bits = utf8(cell.column(9))[0].view(np.uint64).reshape(len(rep), -1)
        x, y = np.flatnonzero(out), np.flatnonzero(~out)
        least = np.minimum(s[x][:, None], s[y][None, :])
        able = (comp[x][:, None] != comp[y][None, :]) & (100 * least >= SIMILARITY * (n[x][:, None] + n[y][None, :] - least))
        p, q = np.nonzero(able)
        p, q = x[p], y[q]
        found: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
        for at in range(0, len(p), 1 << 14):
            u, v = p[at : at + (1 << 14)], q[at : at + (1 << 14)]
            good = (sig[u] == sig[v]).sum(1) >= MATCHES
            u, v = u[good], v[good]
            most = np.minimum(n[u] - np.bitwise_count(bits[u] & ~bits[v]).sum(1, dtype=np.int64), n[v] - np.bitwise_count(bits[v] & ~bits[u]).sum(1, dtype=np.int64))
            good = 100 * most >= SIMILARITY * (n[u] + n[v] - most)
            found.append(np.column_stack([np.minimum(rep[u], rep[v])[good], np.maximum(rep[u], rep[v])[good]]))
        return np.unique(np.concatenate(found), axis=0).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        own = None

        def pairs() -> pa.RecordBatch:
            a, b = compare(pa.Table.from_batches(held))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            keys = np.column_stack([batch.column(k).to_numpy() for k in range(3)])
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if s < e and held and keys[s].tolist() != own:
                    yield pairs()
                    held.clear()
                if s < e:
                    own = keys[s].tolist()
                    held.append(batch.slice(s, e - s))
        if held:
            yield pairs()

    keys = ["pivot", "i", "j"]
    cells = cells.select(*keys, "out", "rep", "comp", "n", "s", "signature", "bits")
    return cells.repartition(tasks(block.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    every = written(signed(docs), "signed")
    classes = every.where("n_shingles > 0 and doc_id is not null").groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n"))
    classes = written(classes, "classes")
    lists = written(postings(classes), "postings")
    texts = written(docs.join(lists.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").withColumnRenamed("doc_id", "rep"), "candidates", compression="zstd")
    collected(spark)
    # a doc_id with several texts ties their classes together
    several = every.where("n_shingles > 0 and doc_id is not null").join(classes.select("set_hash", "rep"), "set_hash").where("doc_id <> rep")
    ids = several.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("v"))
    links = ids.where("u <> v").select("u", "v")
    twice = several.join(ids.where("u <> v").select("doc_id", "u"), "doc_id").select("u", F.col("rep").alias("v"))
    also = several.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    links = written(links.unionAll(twice).unionAll(also).where("u <> v").distinct(), "links")
    found = components(links)

    def placed(lists: DataFrame) -> DataFrame:
        return lists.join(found.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("comp", F.coalesce("label", "rep")).drop("label")

    def settle(pairs: DataFrame) -> None:
        nonlocal links, found
        pairs = written(pairs, "pairs")
        if not pairs.isEmpty():
            links = links.unionAll(written(confirm(pairs, texts).select(F.col("a").alias("u"), F.col("b").alias("v")), "links"))
            found = components(links)
            collected(spark)

    settle(_pivots(placed(lists)))
    now = placed(lists)
    several = now.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("token")
    open_ = now.join(several, "token", "left_semi").select("token", "rep", "comp")
    able = written(reach(open_.select("rep", "comp").distinct(), texts).join(classes, "rep").where(f"100 * s >= {SIMILARITY} * n").select("rep", "n", "s", "signature"), "able")
    for turn in range(BAND_ROUNDS):
        order = np.random.Generator(np.random.PCG64(turn)).permutation(COORDINATES).tolist()
        bands = [F.xxhash64(F.lit(i), *[F.col("signature")[c] for c in order[i : i + BAND]]) for i in range(0, COORDINATES - BAND + 1, BAND)]
        settle(_pivots(placed(able.select("rep", F.explode(F.array(*bands)).alias("token")))))
    near = written(blocks_of(placed(open_.drop("comp").join(able.select("rep"), "rep", "left_semi"))), "near")
    settle(left_over(near, sketched(able, texts)))
    joined = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("set_hash").alias("h"), F.coalesce("label", "rep").alias("comp"))
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull() & (F.col("set_hash") == F.col("h"))
    out = every.select("doc_id", "n_shingles", "set_hash").join(joined, linked, "left")
    # a document without words that shares its doc_id with one that has some
    comp = F.coalesce("comp", "doc_id")
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT u AS d, u AS c FROM e UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.d),
m AS (SELECT d, min(c) AS c FROM r GROUP BY d)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, w.doc_id) AS component_id, coalesce(m.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.d = w.doc_id
"""
