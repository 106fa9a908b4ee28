"""Benchmark decontamination (operator 8).

Texts and benchmark items are normalised (A-Z lower-cased, white space runs to one blank) and
compared as bytes. An item of m bytes leaks into a document if some region of it is within the
item's edit budget e, ``EDITS`` percent of m. By the q-gram lemma such a region shares at least
m + 1 - q - e * q q-grams with the item, on diagonals (place in document - place in item) that
differ by at most e. So:

1. positions whose q-gram occurs in any item are marked, and windows with too few marks for any
   item of their length are dropped (a coarser form of the same lemma);
2. in what is left, q-grams shared with each item are counted in diagonal bands that overlap by
   more than e, and (item, band) with fewer than the lemma asks are dropped;
3. each remaining region is verified by alignment within the band: an alignment of at most e edits
   moves by at most e diagonals, and all of these lie in one band, so only the band's cells are
   computed, in rows of 2 * (e + 1).

Items go to the documents in chunks of bounded bytes; documents never move. A benchmark of several
chunks is not looked up chunk by chunk in all documents: step 1 runs once, with a bitmap of all
items' q-grams (at most MARKS bits), and the chunks meet what it leaves.

Edge cases: null texts match nothing; an item has to have q bytes (after normalising, without white
space at its ends) to be told from chance, and shorter ones match nothing by definition; null ids
stay null; repeated rows each get their rows; repeated items count once for each item_id; empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, blocks, fresh, mix, release, utf8, written

Q, EDITS = 12, 5  # bytes; percent
#: Bytes of items that are broadcast at once: 16 bytes of postings for each, and 2 of bitmap.
CHUNK = 1 << 20
#: Bits of a bitmap, at most.
MARKS = 1 << 28
LEAKS = "doc_id long, item_id long, edits int, start int, end int"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32


def normalised(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = _LOWER[buf]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    keep[offsets[:-1][offsets[:-1] < len(x)]] = True
    return x[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]


def budget(m: int) -> int:
    """Edits allowed for an item of m bytes; few enough that the lemma asks for a shared q-gram."""
    return max(0, min(m * EDITS // 100, (m - Q) // Q))


def shared_least(m: int) -> int:
    return m + 1 - Q - budget(m) * Q


def grams(x: np.ndarray) -> np.ndarray:
    """Hash of the q-gram at each position."""
    if len(x) < Q:
        return np.zeros(0, U64)
    h = x.astype(U64) + U64(1)
    b = 0x9E3779B97F4A7C15
    parts = {1: h}
    size = 1
    while size * 2 <= Q:
        h = h[:-size] * U64(b) + h[size:]
        b = b * b & (1 << 64) - 1
        size *= 2
        parts[size] = h
    out, at, rest = parts[size], size, Q - size
    for p in sorted((p for p in parts if p < size), reverse=True):
        if p <= rest:
            n = len(x) - at - p + 1
            out = out[:n] * U64(0xD1342543DE82EF95) + parts[p][at : at + n]
            at, rest = at + p, rest - p
    return mix(out.copy())


def prepared(text: str) -> np.ndarray:
    """A normalised item, without white space at its ends."""
    raw = np.frombuffer(text.encode(), np.uint8)
    x, _ = normalised(raw, np.array([0, len(raw)]))
    return np.frombuffer(bytes(x).strip(b" "), np.uint8)


class Marks:
    """A bitmap of items' q-grams, and what windows of documents must hold of them."""

    def __init__(self, bytes_: int):
        self.bits = min(max(16, (bytes_ * 16).bit_length()), MARKS.bit_length() - 1)
        self.map = np.zeros(1 << self.bits - 3, np.uint8)
        self.bounds: dict[int, tuple[int, int]] = {}  # class of lengths: longest window, least marks

    def add(self, h: np.ndarray, m: int) -> None:
        at = h >> U64(64 - self.bits)
        np.bitwise_or.at(self.map, (at >> U64(3)).astype(np.int64), np.uint8(1) << (at & U64(7)).astype(np.uint8))
        # lengths in classes of a fourth: a window as long as the longest, marks for the least that any asks
        of, window, least = int(np.log(m) / np.log(1.25)), m + budget(m), shared_least(m)
        w, n = self.bounds.get(of, (window, least))
        self.bounds[of] = (max(w, window), min(n, least))

    def near(self, h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Places with a marked q-gram, in windows with enough of them."""
        n = len(h)
        if not n or not self.bounds:
            return np.zeros(0, np.int64)
        at = h >> U64(64 - self.bits)
        marked = (self.map[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8) & 1).astype(bool)
        for o in offsets[1:-1]:  # q-grams that cross into the next text don't count
            marked[max(0, o - Q + 1) : o] = False
        sums = np.concatenate(([0], np.cumsum(marked, dtype=np.int32)))
        near = np.zeros(n + 1, np.int32)
        for window, least in self.bounds.values():
            w = min(n, max(1, window - Q + 1))
            rich = np.flatnonzero(sums[w:] - sums[:-w] >= least)
            if len(rich):
                np.add.at(near, rich, 1)
                np.add.at(near, np.minimum(rich + w, n), -1)
        return np.flatnonzero(marked & (np.cumsum(near)[:n] > 0))


class Items:
    """Postings of the items' q-grams."""

    def __init__(self, rows: list[tuple[int | None, np.ndarray]]):
        self.ids, self.texts = [i for i, _ in rows], [x for _, x in rows]
        all_ = [grams(t) for t in self.texts]
        self.marks = Marks(sum(map(len, self.texts)))
        for g, t in zip(all_, self.texts):
            self.marks.add(g, len(t))
        h = np.concatenate(all_) if all_ else np.zeros(0, U64)
        item = np.repeat(np.arange(len(all_), dtype=np.int32), [len(g) for g in all_])
        place = np.concatenate([np.arange(len(g), dtype=np.int32) for g in all_]) if all_ else np.zeros(0, np.int32)
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.place = h[order], item[order], place[order]
        self.length = np.array([len(t) for t in self.texts], np.int64)
        self.least = np.array([shared_least(len(t)) for t in self.texts], np.int64)
        self.edits = np.array([budget(len(t)) for t in self.texts], np.int64)

    def leaks(self, x: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, edits, start, end) of the best region of each (text, item)."""
        h = grams(x)
        todo = self.marks.near(h, offsets)
        if not len(todo):
            return
        a, b = np.searchsorted(self.hash, h[todo], "left"), np.searchsorted(self.hash, h[todo], "right")
        many = b - a
        at = np.repeat(todo, many)
        entry = np.repeat(a - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        item, diagonal = self.item[entry].astype(np.int64), at - self.place[entry]
        text = np.searchsorted(offsets, at, "right") - 1
        # bands of width 2 * (e + 1), one every e + 1: any e + 1 diagonals lie within one
        step = self.edits[item] + 1
        first = diagonal // step
        keys = np.concatenate([np.column_stack([text, item, first]), np.column_stack([text, item, first - 1])])
        found, count = np.unique(keys, axis=0, return_counts=True)
        found = found[count >= self.least[found[:, 1]]]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for t, i, band in found.tolist():
            e, low, high = int(self.edits[i]), int(offsets[t]), int(offsets[t + 1])
            hit = align(self.texts[i], x[low:high], band * (e + 1) - low, 2 * (e + 1), e)
            if hit is not None:
                best[t, i] = min(best.get((t, i), hit), hit)
        for (t, i), (edits, start, end) in sorted(best.items()):
            yield t, i, edits, start, end


def align(item: np.ndarray, text: np.ndarray, first: int, width: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the part of ``text`` nearest to ``item``, within ``most`` edits.

    Only alignments on ``width`` diagonals (place in text - place in item) from ``first`` on are
    tried; of equal ones the later start wins, then the earlier end.
    """
    n, m = len(text), len(item)
    big, far = n + 2, (len(item) + 2) * (n + 2)
    lanes = np.arange(width)
    # the text under each row of the band; outside of it, nothing matches
    padded = np.full(m + width, -1, np.int16)
    a, b = max(0, first), min(n, first + m + width)
    padded[a - first : max(a, b) - first] = text[a : max(a, b)]
    # costs and starts in one number: the smaller cost, then the later start, wins
    row = np.where((first + lanes >= 0) & (first + lanes <= n), n - (first + lanes), far)
    for i in range(m):
        new = row + big * (padded[i : i + width] != item[i])
        if width > 1:
            new[:-1] = np.minimum(new[:-1], row[1:] + big)
        new = np.minimum.accumulate(new - lanes * big) + lanes * big
        place = first + i + 1
        if place < 0 or place + width > n:  # cells outside of the text
            new[: max(0, -place)] = far
            new[max(0, n + 1 - place) :] = far
        row = new
        if i & 63 == 63 and int(row.min()) // big > most:
            return None
    lane = int(np.argmin(row))
    edits, start = int(row[lane]) // big, n - int(row[lane]) % big
    return (edits, start, first + m + lane) if edits <= most else None


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, start and end (bytes of the normalised text) of each leak."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    size, n = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    if (size or 0) > CHUNK and n > 1:
        docs = written(_able(docs, rows, size), "able")
        rows = written(rows, "items")  # each chunk is a part of the same table
    chunks = max(1, -(-(size or 0) // CHUNK))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) if n > 1 else F.lit(0)
    out = None
    for k in range(chunks if n > 1 else 1):
        chunk = [(i, x) for i, t in rows.where(place == k).collect() if len(x := prepared(t)) >= Q]
        found = docs.mapInArrow(_finder(spark.sparkContext.broadcast(Items(chunk))), LEAKS)  # CHUNK bytes of items on average
        out = found if out is None else out.unionAll(found)
    return out


def _able(docs: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """Documents with a window that holds enough of all items' q-grams."""
    marks = Marks(size)
    for _, t in rows.toLocalIterator():
        if len(x := prepared(t)) >= Q:
            marks.add(grams(x), len(x))
    shared = docs.sparkSession.sparkContext.broadcast(marks)  # at most MARKS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        m = shared.value
        for b in batches:
            buf, offsets = utf8(b.column(1))
            keep = np.zeros(b.num_rows, bool)
            for i, j in blocks(offsets):
                x, at = normalised(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                keep[i + np.searchsorted(at, m.near(grams(x), at), "right") - 1] = True
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def _finder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        items = shared.value
        for b in batches:
            buf, offsets = utf8(b.column(1))
            rows = []
            for i, j in blocks(offsets):
                x, at = normalised(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                rows += [(i + t, items.ids[k], e, s, z) for t, k, e, s, z in items.leaks(x, at)]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), *[pa.array(c, k) for c, k in zip(cols[1:], (pa.int64(), pa.int32(), pa.int32(), pa.int32()))]], ["doc_id", "item_id", "edits", "start", "end"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a leak."""
    name = fresh(docs, "leaked")
    found = leaks(docs, benchmark).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")
