"""Line dedup by pairwise alignment (operator 5).

A line counts by its text without white space at its ends. A document posts each distinct line of
``LEAST`` characters or more once, however often it holds it, and, if it has no such line, its
whole sequence of lines. Each post is looked up by hash, and a document meets the earliest document
(smallest doc_id) that has the same post. Meeting the earliest holder alone keeps the pairs in
proportion to the lines, whatever a line's frequency, and misses no repeated line: a line's
earliest holder never loses it. Each pair is aligned by patience diff (lines that stand once in
both, the longest common order of them, then the gaps between), and aligned blocks with at least
one posted line go from the later document. What the one order leaves (posted lines that moved, or
that either document repeats) is aligned from where the earlier document first has the line, as far
as lines agree both ways, and goes too. So a later document keeps no line of ``LEAST`` characters
that an earlier one holds, and no copy of a document of shorter lines.

Edge cases: null text has no lines; rows that share doc_id and text are one document and don't
count as earlier or later; rows that share doc_id alone are ordered by digest; rows with a null
doc_id come after all others; an empty table gives no rows; other columns pass through as they are.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, fresh, release, utf8, written

#: Characters of a line, without white space at its ends, that make it worth looking up.
LEAST = 20
KEY = "key struct<no_id: boolean, doc_id: long, digest: string>"
LINES = f"{KEY}, hashes array<long>, posted array<long>"


def line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.strip().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _key():
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


def sequence_hash(hashes: list[int]) -> int:
    raw = pa.array(hashes, pa.int64()).buffers()[1].to_pybytes()[: 8 * len(hashes)]
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8, person=b"sequence").digest(), "little", signed=True)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, hashes, posted of batches of key and text, by the block: Spark's batches hold up to 64 MB."""
    release()
    for b in batches:
        for i, j in blocks(utf8(b.column(1))[1]):
            hashes, posted = [], []
            for text in b.column(1)[i:j].to_pylist():
                lines = (text or "").split("\n")
                own = [line_hash(x) for x in lines]
                hashes.append(own)
                posted.append(list(dict.fromkeys(h for x, h in zip(lines, own) if len(x.strip()) >= LEAST)) or [sequence_hash(own)])
            yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(hashes, pa.list_(pa.int64())), pa.array(posted, pa.list_(pa.int64()))], ["key", "hashes", "posted"])


def line_table(docs: DataFrame) -> DataFrame:
    """Each document's line hashes, and what it posts."""
    return docs.where("text is not null").select(_key().alias("key"), F.col("text").cast("string")).mapInArrow(_hashed, LINES)


def patience(later: list[int], earlier: list[int]) -> list[tuple[int, int, int]]:
    """Blocks (start in later, start in earlier, length) that align."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(later), 0, len(earlier))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and later[a] == earlier[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and later[b - 1] == earlier[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a >= b or c >= d:
            continue
        once_later = Counter(later[a:b])
        once_earlier = Counter(earlier[c:d])
        place = {h: j for j, h in enumerate(earlier[c:d], c) if once_earlier[h] == 1}
        common = [(i, place[h]) for i, h in enumerate(later[a:b], a) if once_later[h] == 1 and h in place]
        if not common:
            continue
        # patience sorting: the longest increasing run of places in the earlier document
        tops: list[int] = []
        last: list[int] = []
        before: list[int] = []
        for k, (_, j) in enumerate(common):
            p = bisect_left(tops, j)
            before.append(last[p - 1] if p else -1)
            if p == len(tops):
                tops.append(j)
                last.append(k)
            else:
                tops[p], last[p] = j, k
        chain, k = [], last[-1]
        while k >= 0:
            chain.append(common[k])
            k = before[k]
        for i, j in reversed(chain):  # each anchor starts the part below it
            todo.append((a, i, c, j))
            pairs.append((i, j))
            a, c = i + 1, j + 1
        todo.append((a, b, c, d))
    blocks: list[tuple[int, int, int]] = []
    for i, j in sorted(pairs):
        if blocks and i == blocks[-1][0] + blocks[-1][2] and j == blocks[-1][1] + blocks[-1][2]:
            blocks[-1] = (*blocks[-1][:2], blocks[-1][2] + 1)
        else:
            blocks.append((i, j, 1))
    return blocks


def lost(later: list[int], earlier: list[int], posted: set[int]) -> list[int]:
    """Numbers of the lines that ``later`` loses to ``earlier``, whose posts it shares in part."""
    if later == earlier:
        return list(range(len(later)))
    gone = [False] * len(later)
    for s, _, n in patience(later, earlier):
        if not posted.isdisjoint(later[s : s + n]):
            gone[s : s + n] = [True] * n
    place: dict[int, int] = {}
    for j, h in enumerate(earlier):
        place.setdefault(h, j)
    for i, h in enumerate(later):
        if gone[i] or h not in posted or h not in place:
            continue
        for step in (-1, 1):  # each line goes once, so this is linear in all
            a, c = i, place[h]
            while 0 <= a < len(later) and 0 <= c < len(earlier) and later[a] == earlier[c] and (a == i or not gone[a]):
                gone[a] = True
                a, c = a + step, c + step
    return [i for i, x in enumerate(gone) if x]


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, gone of batches of key and the three lists that :func:`lost` takes, by the block."""
    release()
    for b in batches:
        for i, j in blocks(8 * sum(b.column(c).offsets.to_numpy().astype(np.int64) for c in (1, 2, 3))):
            gone = [lost(x, y, set(posted)) for x, posted, y in zip(*(b.column(c)[i:j].to_pylist() for c in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(gone, pa.list_(pa.int32()))], ["key", "gone"])


def repeated(docs: DataFrame) -> DataFrame:
    """key and the numbers of the lines that go, for each document that loses any."""
    table = written(line_table(docs), "lines")
    one = table.dropDuplicates(["key"])
    held = one.select("key", F.explode("posted").alias("h"))
    # a table of its own, so that the join below can be dealt anew where one line has many holders
    first = written(held.groupBy("h").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "first"), "firsts")
    pairs = written(held.join(first, "h").where("key <> first").select("key", "first").distinct(), "pairs")
    later = one.select("key", F.col("hashes").alias("a"), "posted")
    earlier = one.select(F.col("key").alias("first"), F.col("hashes").alias("b"))
    aligned = pairs.join(earlier, "first").join(later, "key").select("key", "a", "posted", "b").mapInArrow(_aligned, f"{KEY}, gone array<int>")
    # a document meets at most as many others as it has posts
    return aligned.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone")).where(F.size("gone") > 0)


def _kept(text: Column, lost: Column) -> Column:
    """``text`` without the lines numbered in ``lost``, in proportion to its lines."""

    def left(lines: Column) -> Column:
        rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)  # by a hash set
        return F.array_join(F.transform(rest, lambda i: F.get(lines, i)), "\n")

    # the lines are a lambda's variable: as an expression, they would be split anew for each line that stays
    return F.get(F.transform(F.array(F.split(text, "\n")), left), F.lit(0))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with text_kept, n_lines and n_removed (with ``_`` before a name that ``docs`` has)."""
    key, own, lost = (fresh(docs, x) for x in ("gone_key", "own_key", "gone_lines"))
    gone = repeated(docs).select(F.col("key").alias(key), F.col("gone").alias(lost))
    marked = docs.withColumn(own, _key()).join(gone, F.col(own) == F.col(key), "left")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    fewer = F.when(F.col(lost).isNull(), 0).otherwise(F.size(lost))
    made = {"text_kept": F.when(fewer > 0, _kept(F.col("text"), F.col(lost))).otherwise(F.col("text")), "n_lines": n.cast("long"), "n_removed": fewer.cast("long")}
    return marked.withColumns({fresh(docs, c): x for c, x in made.items()}).drop(own, key, lost)
