"""Suffix-array dedup of exact substrings (operator 6).

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document with
a smaller doc_id, or earlier in the same one. Strings never cross documents, they may overlap, and
all are judged on the input.

Suffixes of a whole corpus need no common order to find that out; those that share ``LENGTH`` bytes
must meet:

1. Anchors. Of the ``GRAM``-byte strings in each window of LENGTH bytes the one with the least hash
   is an anchor (all of them, at a tie). Equal windows have equal anchors at equal places, so they
   meet under the anchor's hash.
2. Around each anchor lies its context: the bytes that windows with this anchor can cover. Anchors
   are looked for once, dealt by hash and sorted by hash and context, so that one pass tells them
   apart: of equal contexts all but the first are repeated as a whole, the first of each go
   on, if their hash has several contexts, and hashes that occur once are dropped.
3. Contexts under one hash are a bucket. Parts of them that hold no string of LENGTH bytes twice
   are left out, parts that lie within an earlier document's part are repeated as a whole, and the
   suffixes of what is left in each bucket are sorted (:mod:`.suffix`: linear grouping by Lyndon prefixes). Neighbours in that order
   that share LENGTH bytes form runs; in each run the earliest stays, the other windows go.
4. A hash with more than ``HOT`` contexts (a passage in a large share of all documents) would fill
   one task. Its contexts are cut into pieces by where the window starts, eight starts a piece, and
   meet under the hash of the bytes that all windows of a piece share; what is still hot is cut
   into single windows, of which one hash has at most LENGTH - GRAM + 1 contexts (places of the
   anchor). Pieces go through 2. and 3. again, so nothing is lost or capped.

Edge cases: null text is empty; texts under LENGTH bytes stay; rows with a null doc_id come after
all others, and rows that share a doc_id are ordered by their texts (then arbitrarily among equal
rows: the first stays); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BASE, _BYTE, U64, _powers, blocks, collected, gathered, mix, tasks, utf8, written, written_from_short_rows
from .suffix import bucket_orders

LENGTH, GRAM = 100, 40
#: Bytes of text in which anchors are looked for at once: arrays of 8 times as many stay in a core's cache.
BLOCK = 1 << 17
#: Contexts of one hash that one bucket takes.
HOT = 128
#: Bits of an anchor's hash that make way for bits of its context's when both are sorted as one number.
LOW = 20
#: Repeated contexts that a worker holds before it hands on what they cover.
COPIES = 1 << 17
#: Bytes of contexts that are sorted together.
SORTED_BYTES = 1 << 20
_SIDE = LENGTH - GRAM

#: h: hash; c: the context's hash; p: the anchor's place in its document.
ANCHORS = "h long, c long, doc long, p int"
#: at: where the bytes start in their document; a: the anchor's place in them.
PIECES = "h long, c long, doc long, at int, a int, bytes binary"
SPANS = "doc long, s long, e long"


def _slide(x: np.ndarray, w: int, pick) -> np.ndarray:
    """``pick`` over each window of ``w``."""
    n, size, y = len(x) - w + 1, 1, x
    while size * 2 <= w:
        y = pick(y[:-size], y[size:])
        size *= 2
    return pick(y[:n], y[w - size : w - size + n])


class _Ranges:
    """Hashes of any byte ranges of a buffer."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.p = _powers(max(n, 1))
        self.total = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[buf] * self.p[:n][::-1], out=self.total[1:])
        self.scale = U64(pow(int(_BASE), -n, 1 << 64))

    def __call__(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        h = (self.total[e] - self.total[s]) * self.p[s] * self.scale
        return mix(h + (e - s).astype(U64) * U64(0xD1342543DE82EF95))


def anchors(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, _Ranges]:
    """Anchors' places in a buffer of texts, their hashes, and the buffer's range hashes."""
    ranges = _Ranges(buf)
    n = len(buf)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, U64), ranges
    s = np.arange(n - GRAM + 1)
    h = ranges(s, s + GRAM)
    w = _SIDE + 1
    least = _slide(h, w, np.minimum)
    # windows that cross from one text into the next don't count
    cross = np.zeros(n + 1, np.int32)
    for o in offsets[1:-1].tolist():
        if 0 < o < n:
            cross[max(0, o - LENGTH + 1)] += 1
            cross[o] -= 1
    # a window's least hash, or 0 where the window doesn't count; hashes of 0 are as good as none
    least[np.cumsum(cross)[: len(least)] > 0] = U64(0)
    pad = np.zeros(_SIDE, U64)
    most = _slide(np.concatenate([pad, least, pad]), w, np.maximum)
    at = np.flatnonzero(most == h)
    return at, h[at], ranges


def _merge(doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One span for those of a document that touch."""
    order = np.lexsort((s, doc))
    doc, s, e = doc[order], s[order], e[order]
    fresh = np.concatenate(([True], doc[1:] != doc[:-1]))
    # ends so far within a document: a running maximum over a key that grows by document
    part = np.cumsum(fresh)
    far = np.maximum.accumulate(e + part * (1 << 40)) - part * (1 << 40)
    at = np.flatnonzero(fresh | np.concatenate(([True], s[1:] > far[:-1])))
    return doc[at], s[at], far[np.append(at[1:], len(doc)) - 1]


def _found(docs: DataFrame) -> DataFrame:
    """Anchors with their contexts' hashes, as :func:`_spread` marks them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.asarray(b.column(0))
            buf, offsets = utf8(b.column(1))
            for i, j in blocks(offsets, BLOCK):
                part, o = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                at, h, ranges = anchors(part, o)
                text = np.searchsorted(o, at, "right") - 1
                s, e = np.maximum(at - _SIDE, o[text]), np.minimum(at + LENGTH, o[text + 1])
                c = mix(ranges(s, e) ^ (at - s).astype(U64))
                doc = ids[i:j][text]
                h, place = _spread(h, c, doc, (at - o[text]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c.view(np.int64)), pa.array(doc), pa.array(place)], ["h", "c", "doc", "p"])

    return docs.mapInArrow(run, ANCHORS)


def _spread(h: np.ndarray, c: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places as they are dealt: equal contexts (under equal hashes) but the first are marked by ~place.

    They are repeated whatever else there is, so they need not meet any and go by a number of their
    own: a context in each document is not dealt to one task as often as it occurs.
    """
    h, place = h.view(np.int64).copy(), place.copy()
    key = h.view(U64) ^ (c.view(U64) * U64(0xD1342543DE82EF95))
    if ((doc[1:] > doc[:-1]) | (doc[1:] == doc[:-1]) & (place[1:] >= place[:-1])).all():
        order = np.argsort(key, kind="stable")
    else:
        order = np.lexsort((place, doc, key))
    a, b = order[1:], order[:-1]
    again = a[(h[a] == h[b]) & (c.view(np.int64)[a] == c.view(np.int64)[b])]
    h[again] = mix(doc[again].astype(U64) * U64(0x9E3779B97F4A7C15) + place[again].astype(U64)).view(np.int64)
    place[again] = ~place[again]
    return h, place


def _low(c: np.ndarray) -> np.ndarray:
    """The bits of contexts' hashes by which they are sorted."""
    return c.view(U64) >> U64(64 - LOW)


def _met(found: DataFrame) -> DataFrame:
    """Contexts that go on and spans of those that don't, of ``found`` (h, c, doc, place and, for pieces, a and bytes).

    Rows with a place below 0 are repeated contexts already (see :func:`_spread`).
    With k, how many contexts its hash has (HOT + 1 stands for all above HOT): the first place of
    each context whose hash has several. With k 0: from the place to ``e``, what contexts cover that are not the
    first of their kind, one row where they touch.
    """
    names, most = found.columns, HOT
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields) + ", k long, e int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []
        held = hot = None  # firsts of the last hash, which may have more; that hash, if it has too many for all to wait
        copies: list[tuple[np.ndarray, ...]] = []

        def repeat(b: pa.RecordBatch, rows: np.ndarray, at: np.ndarray) -> None:
            s, doc = at.astype(np.int64), np.asarray(b.column(2))[rows]
            if "bytes" in names:
                copies.append((doc, s, s + np.asarray(pc.binary_length(b.column(names.index("bytes")))).astype(np.int64)[rows]))
            else:
                copies.append((doc, np.maximum(s - _SIDE, 0), s + LENGTH))

        def repeated() -> pa.RecordBatch:
            doc, s, e = _merge(*(np.concatenate(x) for x in zip(*copies)))
            copies.clear()
            none = [pa.nulls(len(doc), x) for x in kinds]
            return pa.RecordBatch.from_arrays([*none[:2], pa.array(doc), pa.array(s.astype(np.int32)), *none[4:], pa.array(np.zeros(len(doc), np.int64)), pa.array(e.astype(np.int32))], [*names, "k", "e"])

        def going(firsts: pa.RecordBatch, k: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*firsts.columns, pa.array(k), pa.nulls(len(k), pa.int32())], [*names, "k", "e"])

        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                b = pa.concat_batches([held, b])
            kinds = [x.type for x in b.columns]
            h, c, doc, at = (np.asarray(b.column(i)) for i in range(4))
            marked = np.flatnonzero(at < 0)
            if len(marked):
                repeat(b, marked, ~at[marked])
                b = b.take(pa.array(np.flatnonzero(at >= 0)))
                if not b.num_rows:
                    continue
                h, c, doc, at = (np.asarray(b.column(i)) for i in range(4))
            differ = h[1:] != h[:-1]
            some = np.concatenate((~differ, [True])) | np.concatenate(([False], ~differ))  # and the last, for now
            rows = np.flatnonzero(some if hot is None else some | (h == hot))
            rows = rows[np.lexsort((at[rows], doc[rows], c[rows], h[rows]))]
            own, kind = h[rows], c[rows]
            new = np.ones(len(rows), bool)
            new[1:] = (own[1:] != own[:-1]) | (kind[1:] != kind[:-1])
            again, firsts, own = rows[~new], rows[new], own[new]
            if len(again):
                repeat(b, again, at[again])
            if sum(len(x[0]) for x in copies) >= COPIES:
                yield repeated()
            cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            size = np.diff(np.append(cut, len(own)))
            k = np.minimum(size, most + 1)
            k[own[cut] == hot] = most + 1
            wait = np.arange(len(own)) >= cut[-1]
            if k[-1] > most:  # of too many, those wait that a later one can equal
                hot = own[-1]
                wait &= _low(c[firsts]) == _low(c[-1:])
            held = b.take(pa.array(firsts[wait]))
            k = np.repeat(k, size)
            go = np.flatnonzero((k > 1) & ~wait)
            if len(go):
                yield going(b.take(pa.array(firsts[go])), k[go])
        if held is not None:
            k = most + 1 if held.column(0)[0].as_py() == hot else held.num_rows
            if k > 1:
                yield going(held, np.full(held.num_rows, k))
        if copies:
            yield repeated()

    # one number orders hashes and, within each, contexts (by LOW bits of theirs): such a sort compares no rows
    found = found.withColumn("h", F.col("h").bitwiseAND(F.lit(-1 << LOW)))
    order = F.col("h").bitwiseOR(F.shiftrightunsigned("c", 64 - LOW))
    return found.repartition(tasks(found.sparkSession), "h").sortWithinPartitions(order).mapInArrow(run, schema)


def _cut(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The contexts at ``places``, from their documents; those too short for a window go."""
    wanted = places.groupBy("doc").agg(F.collect_list(F.struct("h", "c", "p", "k")).alias("x"))  # as many as the text has anchors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offsets = utf8(b.column(1))
            lists = b.column(2)
            flat = lists.flatten()
            h, c, p, k = (np.asarray(flat.field(i)) for i in range(4))
            row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
            s = np.maximum(p.astype(np.int64) - _SIDE, 0)
            e = np.minimum(p + LENGTH, np.diff(offsets)[row])
            keep = np.flatnonzero(e - s >= LENGTH)
            data, first = buf.tobytes(), offsets[row] + s
            for at in range(0, len(keep), 20_000):
                x = keep[at : at + 20_000]
                cut = [data[i : i + n] for i, n in zip(first[x].tolist(), (e - s)[x].tolist())]
                out = [h[x], c[x], np.asarray(b.column(0))[row[x]], s[x].astype(np.int32), (p - s)[x].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, out), pa.array(cut, pa.binary()), pa.array(k[x])], ["h", "c", "doc", "at", "a", "bytes", "k"])

    return docs.join(wanted, "doc").select("doc", "text", "x").mapInArrow(run, PIECES + ", k long")


def _pieces(hot: DataFrame, starts: int) -> DataFrame:
    """Contexts cut by where windows start, ``starts`` to a piece, under the bytes all have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first_row in range(0, whole.num_rows, 500):
                b = whole.slice(first_row, 500)
                rows: list[tuple] = []
                for h, doc, at, a, data in zip(*(b.column(i).to_pylist() for i in range(5))):
                    # places are counted back from the anchor, so that equal windows fall into one piece
                    for far in range(0, a + 1, starts):
                        first, last = max(0, a - far - starts + 1), min(a - far, len(data) - LENGTH)
                        if first <= last:
                            core = data[a - far : a - far - starts + 1 + LENGTH]
                            rows.append((h, core, data[first : last + LENGTH], doc, at + first, a - first))
                if not rows:
                    continue
                key = [int.from_bytes(hashlib.blake2b(core, digest_size=8, key=h.to_bytes(8, "little", signed=True)).digest(), "little", signed=True) for h, core, *_ in rows]
                own = [int.from_bytes(hashlib.blake2b(r[2], digest_size=8, salt=r[5].to_bytes(2, "little")).digest(), "little", signed=True) for r in rows]
                _, _, cut, docs, places, a_ = zip(*rows)
                own, docs = np.array(own, np.int64), np.array(docs, np.int64)
                key, places = _spread(np.array(key, np.int64), own, docs, np.array(places, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own), pa.array(docs), pa.array(places), pa.array(a_, pa.int32()), pa.array(cut, pa.binary())], ["h", "c", "doc", "at", "a", "bytes"])

    return hot.select("h", "doc", "at", "a", "bytes").mapInArrow(run, PIECES)


def shared_parts(texts: list[bytes], bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of what windows of each text cover whose hash occurs again in its bucket.

    What lies outside starts no string that another has, so it need not be sorted.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(size) - size
    many = np.maximum(size - LENGTH + 1, 0)
    text = np.repeat(np.arange(len(texts)), many)
    at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    p = first[text] + at
    h = _Ranges(data)(p, p + LENGTH) ^ mix(bucket[text].astype(U64))
    order = np.argsort(h)
    equal = h[order[1:]] == h[order[:-1]]
    again = np.zeros(len(h), bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    keep = np.flatnonzero(again)
    if not len(keep):
        return (np.zeros(0, np.int64),) * 3
    run = np.concatenate(([True], (keep[1:] != keep[:-1] + 1) | (text[keep[1:]] != text[keep[:-1]])))
    cut = np.flatnonzero(run)
    last = keep[np.append(cut[1:], len(keep)) - 1]
    return text[keep[cut]], at[keep[cut]], at[last] + LENGTH


def removed_windows(texts: list[bytes], bucket: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) of windows in buckets of contexts that also start earlier."""
    order, starts, data = bucket_orders(texts, bucket)
    n = len(data)
    text = np.repeat(np.arange(len(texts)), np.diff(np.append(starts, n)))
    ends = np.append(starts[1:], n) - 1
    order = order[order + LENGTH <= ends[text[order]]]
    if len(order) < 2:
        return (np.zeros(0, np.int64),) * 3
    words = np.ndarray((n - 7,), "<u8", data.tobytes(), strides=(1,))
    same = np.flatnonzero(bucket[text[order[1:]]] == bucket[text[order[:-1]]])
    for k in (*range(0, LENGTH - 7, 8), LENGTH - 8):
        same = same[words[order[same] + k] == words[order[same + 1] + k]]
    head = np.ones(len(order), bool)
    head[same + 1] = False
    run = np.flatnonzero(head)
    # earliest of each run: by document, then by place in it
    rank = np.unique(doc, return_inverse=True)[1].reshape(-1)[text[order]]
    place = at[text[order]] + order - starts[text[order]]
    key = (rank.astype(np.int64) << 36) | place
    first = np.repeat(np.minimum.reduceat(key, run), np.diff(np.append(run, len(key))))
    gone = np.sort(order[key != first])
    if not len(gone):
        return (np.zeros(0, np.int64),) * 3
    # windows one after the other in a context are one span
    cut = np.flatnonzero(np.concatenate(([True], gone[1:] != gone[:-1] + 1)))
    a, b = gone[cut], gone[np.append(cut[1:], len(gone)) - 1]
    shift = at[text[a]] - starts[text[a]]
    return doc[text[a]], a + shift, b + shift + LENGTH


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    return list(zip(cut.tolist(), [*cut[1:].tolist(), len(x)]))


def _not_covered(parts: list[tuple[int, int, bytes]]) -> tuple[list[tuple[int, int, bytes]], list[tuple[int, int, int]]]:
    """Parts of a bucket, by (document, place), without those that lie within an earlier one.

    Those are repeated as a whole and returned as spans. A part of the same document counts only
    if it is equal, as a place within it could otherwise come later.
    """
    kept: list[tuple[int, int, bytes]] = []
    spans_: list[tuple[int, int, int]] = []
    seen: dict[bytes, tuple[int, int]] = {}
    before, new, last = bytearray(), [], None
    for doc, at, part in parts:
        if doc != last:
            for x in new:
                before += b"\xff"  # in no UTF-8 text
                before += x
            new, last = [], doc
        own = (doc, at)
        if seen.setdefault(part, own) == own and part not in before:
            if not kept or kept[-1] != (doc, at, part):  # contexts of one document overlap
                kept.append((doc, at, part))
                new.append(part)
        elif seen[part] != own or part in before:
            spans_.append((doc, at, at + len(part)))
    return kept, spans_


def _sorted_spans(pieces: DataFrame) -> DataFrame:
    """Removed spans of contexts whose buckets are of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        # buckets of like size advance together: by the power of two of their bytes
        waiting: dict[int, list[tuple[list[bytes], np.ndarray, np.ndarray]]] = {}
        bytes_of: dict[int, int] = {}
        size = 0

        def trim() -> pa.RecordBatch:
            """Deal what is held, bucket by bucket, to the buckets of its size.

            A bucket that has one part left holds no further repeat.
            """
            gone: list[tuple[int, int, int]] = []
            h = np.array([r[0] for r in held], np.int64)
            bucket = np.cumsum(np.concatenate(([0], h[1:] != h[:-1])))
            text, s, e = shared_parts([r[3] for r in held], bucket)
            if len(text):
                doc, at = (np.array([r[k] for r in held], np.int64)[text] for k in (1, 2))
                parts = [held[t][3][a:b] for t, a, b in zip(text.tolist(), s.tolist(), e.tolist())]
                of = bucket[text]
                docs, places = doc.tolist(), (at + s).tolist()
                for a, z in _runs(of):
                    kept, whole = _not_covered(sorted((docs[i], places[i], parts[i]) for i in range(a, z)))
                    gone += whole
                    if len(kept) > 1:
                        n = sum(len(x[2]) for x in kept)
                        kind = n.bit_length()
                        waiting.setdefault(kind, []).append(([x[2] for x in kept], np.array([x[0] for x in kept], np.int64), np.array([x[1] for x in kept], np.int64)))
                        bytes_of[kind] = bytes_of.get(kind, 0) + n
            held.clear()
            cols = list(zip(*gone)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["doc", "s", "e"])

        def sort(kind: int) -> pa.RecordBatch:
            ready = waiting.pop(kind)
            bytes_of[kind] = 0
            bucket = np.repeat(np.arange(len(ready)), [len(r[0]) for r in ready])
            out = removed_windows([t for r in ready for t in r[0]], bucket, np.concatenate([r[1] for r in ready]), np.concatenate([r[2] for r in ready]))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc", "s", "e"])

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4))):
                if size >= SORTED_BYTES and row[0] != held[-1][0]:
                    yield trim()
                    size = 0
                    for kind in [k for k, n in bytes_of.items() if n >= SORTED_BYTES]:
                        yield sort(kind)
                held.append(row)
                size += len(row[3])
        if held:
            yield trim()
        for kind in list(waiting):
            yield sort(kind)

    return pieces.select("h", "doc", "at", "bytes").repartition(tasks(pieces.sparkSession), "h").sortWithinPartitions("h").mapInArrow(run, SPANS)


def _numbered(docs: DataFrame) -> DataFrame:
    """(doc, text) with a number for each row that follows the order of documents."""
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if odd.isEmpty():
        return docs.select(F.col("doc_id").alias("doc"), "text")
    ordered = docs.orderBy(F.asc_nulls_last("doc_id"), "text").rdd.zipWithIndex().map(lambda x: (x[1], x[0][0], x[0][1]))
    return written(docs.sparkSession.createDataFrame(ordered, "doc long, doc_id long, text string"), "numbered")


def spans(docs: DataFrame) -> DataFrame:
    """(doc, s, e): spans to remove of ``docs`` (doc, text); they may overlap."""
    spark = docs.sparkSession
    long = docs.where(F.octet_length("text") >= LENGTH)
    met = written(_met(_found(long)), "contexts")
    collected(spark)
    out = [met.where("k = 0").select("doc", F.col("p").alias("s"), "e")]
    bytes_ = written(_cut(long, met.where("k > 0")), "cut", compression="zstd")
    collected(spark)
    out.append(written(gathered(_sorted_spans(bytes_.where(F.col("k") <= HOT))), "spans"))
    collected(spark)
    hot = bytes_.where(F.col("k") > HOT)
    for starts in (8, 1):
        if hot.isEmpty():
            break
        met = written_from_short_rows(_met(_pieces(hot, starts)), "contexts", compression="zstd")
        collected(spark)
        out.append(met.where("k = 0").select("doc", F.col("at").alias("s"), "e"))
        # under one window's hash its contexts differ in the anchor's place alone: all of them go on
        out.append(written(gathered(_sorted_spans(met.where((F.col("k") > 0) & (F.col("k") <= HOT) if starts > 1 else F.col("k") > 0))), "spans"))
        collected(spark)
        hot = met.where(F.col("k") > HOT)
    spans_ = out[0]
    for x in out[1:]:
        spans_ = spans_.unionAll(x)
    return spans_


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of each document."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    numbered = _numbered(docs)
    with_id = numbered if "doc_id" in numbered.columns else numbered.withColumn("doc_id", F.col("doc"))
    # as many spans as the text has anchors
    gone = spans(numbered.select("doc", "text")).groupBy("doc").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offsets = utf8(b.column(1))
            rows = []
            for i, (s, e) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                text = buf[offsets[i] : offsets[i + 1]]
                if not s:
                    kept, lost, runs = text.tobytes(), 0, 0
                else:
                    step = np.zeros(len(text) + 1, np.int32)
                    np.add.at(step, np.array(s), 1)
                    np.add.at(step, np.minimum(np.array(e), len(text)), -1)
                    cover = np.cumsum(step[:-1]) > 0
                    kept, lost = text[~cover].tobytes(), int(cover.sum())
                    runs = int(cover[0]) + int((cover[1:] & ~cover[:-1]).sum())
                rows.append((len(text), lost, runs, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return with_id.join(gone, "doc", "left").select("doc_id", "text", "s", "e").mapInArrow(run, RESULT)
