"""Language identification by prediction by partial matching (operator 1).

For each language a tree of byte contexts of length 0 to ``order`` holds how often each byte
followed. A byte's probability in a context is its count over (total + distinct), escape method C;
a byte not seen there gets the escape probability times its probability in the next shorter
context, with the bytes seen in the longer one excluded and the rest scaled up, so that each
context's probabilities over all 256 bytes sum to 1. Below the empty context all bytes are alike.
The statistics are frozen after training: a text's code length is the exact sum over its bytes, and
the language with the shortest code wins (ties: first in code-point order). ``score`` is that
language's share when each language, and a code of no language (order 0, over the bytes of all),
weighs 2**-length: a text that no tree predicts better than single bytes scores below one half.

Every context of the training texts is kept. Scaling for exclusion depends on the context alone, so
a byte that was not seen after several contexts costs the sum of their escapes and of its cost after
the longest context that has it. So the joined trees of all languages are one table of strings of up
to ``order`` + 1 bytes; a text is scored by the longest string of the table that ends at each byte,
and each string has one number a language: its last byte's cost, less the escapes of the contexts
that it does not need, plus those that the next byte may. The strings are found in a hash table, all
bytes of a block at once, the longest first.

Training takes the rows with text and lang whose crc32(doc_id as text) mod 3 is not 1; of these, of
each language, at most ``SAMPLE`` distinct documents (least hash), and no further one once
``SAMPLE_BYTES`` are reached. These two parameters bound the model; nothing else is left out of it.

Edge cases: null text, or text without a letter, is ``und`` with score 0; without training rows
every document is ``und``; null doc_id trains nothing and is not held out; repeated rows count once
in training and each get their row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import U64, blocks, fresh, local, release, utf8

#: Documents of each language that the classifier is fitted on, and bytes after which none is added.
SAMPLE, SAMPLE_BYTES = 250, 4 << 20
#: Bytes of context, at most.
ORDER = 4
BLOCK = 1 << 18
UNKNOWN = "und"
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


#: A string of up to 7 bytes as one number: its bytes below, its length above, so none is 0.
_LENGTH = 56
_SPREAD = U64(0x9E3779B97F4A7C15)


def _tagged(keys: np.ndarray, n: int) -> np.ndarray:
    return keys | U64(n << _LENGTH)


@dataclass(frozen=True)
class Model:
    langs: list[str]
    slots: np.ndarray  # open addressing: tagged strings, 0 where free
    rows: np.ndarray  # of each slot: its string's row of the tables below
    cost: np.ndarray  # (strings + 1, languages + 1) bits, the last row for unseen bytes, the last column for no language
    after: np.ndarray  # of the same rows: escapes that ``cost`` has on account of the next byte
    order: int

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of tagged strings; -1 for those that are not in the table."""
        mask = len(self.slots) - 1
        at = (keys * _SPREAD >> U64(64 - mask.bit_length())).astype(np.int64)
        there = self.slots.take(at)
        out = np.where(there == keys, self.rows.take(at), -1)
        left = np.flatnonzero((there != keys) & (there != 0))
        at, keys = at[left], keys[left]
        while len(left):
            at = (at + 1) & mask
            there = self.slots.take(at)
            hit = there == keys
            out[left[hit]] = self.rows.take(at[hit])
            more = ~hit & (there != 0)
            left, at, keys = left[more], at[more], keys[more]
        return out

    def longest(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Row of the longest known string that ends at each byte and lies within its text."""
        n = len(buf)
        keys = buf.astype(U64)
        for i in range(1, self.order + 1):
            keys[i:] |= buf[: n - i].astype(U64) << U64(8 * i)
        place = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
        out = np.full(n, len(self.cost) - 1, np.int64)
        todo = np.arange(n)
        for size in range(self.order + 1, 0, -1):
            able = todo if size == 1 else todo[place[todo] >= size - 1]
            found = self.find(_tagged(keys[able] & U64((1 << 8 * size) - 1), size))
            hit = found >= 0
            out[able[hit]] = found[hit]
            if size > 1:
                mark = np.zeros(n, bool)
                mark[todo] = True
                mark[able[hit]] = False
                todo = np.flatnonzero(mark)
        return out

    def bits(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code lengths of texts: (texts, languages + 1); the last column is that of no language."""
        out = np.zeros((len(offsets) - 1, len(self.langs) + 1))
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            rows = self.longest(buf, offsets)
            out[full] = np.add.reduceat(self.cost.take(rows, axis=0), offsets[:-1][full], axis=0)
            out[full] -= self.after[rows[offsets[1:][full] - 1]]
        return out


def fit(texts: list[tuple[str, bytes]], order: int = ORDER) -> Model:
    """Count contexts of (language, text) pairs and freeze their costs."""
    langs = sorted({x for x, _ in texts})
    many = len(langs)
    strings, counts = [], []
    for size in range(1, order + 2):
        of_lang = []
        for lang in langs:
            found = [np.zeros(0, U64)]
            for x in (np.frombuffer(t, np.uint8).astype(U64) for name, t in texts if name == lang):
                n = len(x) - size + 1
                if n > 0:
                    g = x[:n].copy()
                    for i in range(1, size):
                        g = g << U64(8) | x[i : n + i]
                    found.append(g)
            of_lang.append(np.unique(np.concatenate(found), return_counts=True))
        own = np.unique(np.concatenate([g for g, _ in of_lang])) if langs else np.zeros(0, U64)
        count = np.zeros((len(own), many))
        for k, (g, c) in enumerate(of_lang):
            count[np.searchsorted(own, g), k] = c
        strings.append(own)
        counts.append(count)
    # by size of the string: probability of its last byte after the ones before it
    prob: list[np.ndarray] = []
    escape: list[np.ndarray] = []  # of contexts of 0 to order bytes, in bits, scaled for exclusion
    for size, (own, n) in enumerate(zip(strings, counts), 1):
        if size == 1:
            contexts, to = np.zeros(1, U64), np.zeros(len(own), np.int64)
            below = np.full((len(own), many), 1 / 256)
        else:
            contexts = strings[size - 2]
            to = np.searchsorted(contexts, own >> U64(8))
            below = prob[-1][np.searchsorted(contexts, own & U64((1 << 8 * (size - 1)) - 1))]
        seen = n > 0
        total, distinct, excluded = (np.zeros((len(contexts), many)) for _ in range(3))
        np.add.at(total, to, n)
        np.add.at(distinct, to, seen)
        np.add.at(excluded, to, np.where(seen, below, 0))
        left = 1 - excluded
        full = distinct == 256  # every byte was seen: nothing to escape to
        scaled = np.where(total > 0, distinct / np.maximum(total + distinct, 1) / np.where(full | (left <= 0), 1, left), 1)
        base = np.where(full, total, total + distinct)[to]
        prob.append(np.where(seen, n / np.maximum(base, 1), scaled[to] * below))
        escape.append(np.where(full, 0, -np.log2(scaled)))
    # escapes of a context and all its shorter ones but the empty one
    escapes = [np.zeros((1, many))]
    for size in range(1, order + 1):
        shorter = np.zeros(len(strings[size - 1]), np.int64) if size == 1 else np.searchsorted(strings[size - 2], strings[size - 1] & U64((1 << 8 * (size - 1)) - 1))
        escapes.append(escape[size] + escapes[-1][shorter])
    cost, after = [], []
    single = counts[0].sum(1) + 1  # no language: single bytes, those of all languages together
    single = -np.log2(single / (single.sum() + 256 - len(single)))
    for size, own in enumerate(strings, 1):
        before = np.zeros(len(own), np.int64) if size == 1 else np.searchsorted(strings[size - 2], own >> U64(8))
        if size <= order:
            next_ = escapes[size]
        else:
            next_ = escapes[order][np.searchsorted(strings[order - 1], own & U64((1 << 8 * order) - 1))] if order else np.zeros((len(own), many))
        plain = single[np.searchsorted(strings[0], own & U64(255))][:, None]
        cost.append(np.hstack([-np.log2(prob[size - 1]) - escapes[size - 1][before] + next_, plain]))
        after.append(np.hstack([next_, np.zeros_like(plain)]))
    unseen = np.append(escape[0][0] + 8, np.log2(counts[0].sum() + 256))[None, :]
    cost.append(unseen)
    after.append(np.zeros_like(unseen))
    keys = np.concatenate([_tagged(own, size) for size, own in enumerate(strings, 1)])
    slots, rows = _placed(keys)
    return Model(langs, slots, rows, np.concatenate(cost), np.concatenate(after), order)


def _placed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An open-addressing table of distinct keys, at most a third full, and each slot's key number."""
    bits = max(4, (3 * len(keys)).bit_length())
    slots, rows = np.zeros(1 << bits, U64), np.full(1 << bits, -1, np.int32)
    at = (keys * _SPREAD >> U64(64 - bits)).astype(np.int64)
    left = np.arange(len(keys))
    while len(left):
        free = left[slots[at[left]] == 0]
        taken, which = np.unique(at[free], return_index=True)  # one key a slot, the others go on
        slots[taken], rows[taken] = keys[free[which]], free[which]
        left = left[rows[at[left]] != left]
        at[left] = (at[left] + 1) & ((1 << bits) - 1)
    return slots, rows


def train(docs: DataFrame) -> Model:
    """Fit on the sample. Only hashes and lengths are ranked; texts are fetched once it is known."""
    rows = docs.where("text is not null and lang is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    rows = rows.select("lang", F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    many = rows.groupBy("lang").agg(F.count("*").alias("n"))
    # of a language's documents, about twice the sample by hash: what is ranked is bounded
    part = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    able = rows.select("lang", "h", F.octet_length("text").alias("b")).join(F.broadcast(many), "lang")  # a row a language, as the model has
    able = able.where(part * F.col("n") < 2 * SAMPLE + 200).select("lang", F.shiftrightunsigned("h", 11).alias("o"), "h", "b").distinct()
    order = Window.partitionBy("lang").orderBy("o", "h")
    ranked = able.select("lang", "h", F.row_number().over(order).alias("r"), F.sum("b").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    sample = ranked.where((F.col("r") <= SAMPLE) & (F.coalesce("before", F.lit(0)) < SAMPLE_BYTES)).select("lang", "h").collect()
    if not sample:
        return fit([])
    wanted = local(docs.sparkSession, [(x["lang"], x["h"]) for x in sample], "lang string, h long")
    # at most SAMPLE rows a language
    texts = rows.join(F.broadcast(wanted), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.first("text").alias("text"))
    return fit([(r["lang"], r["text"].encode()) for r in texts.select("lang", "text").collect()])


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def known(docs: DataFrame, model: Model, least: float = 0.1) -> DataFrame:
    """``docs`` without rows that are ``und`` or whose score is below ``least``.

    Below one half are texts that no learned language predicts better than single bytes do, or
    that two languages predict alike.
    """
    pred, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    marked = classify(docs, model, carry=(pred, score))
    return marked.where((F.col(pred) != UNKNOWN) & (F.col(score) >= least)).drop(pred, score)


def classify(docs: DataFrame, model: Model, carry: tuple[str, str] | None = None) -> DataFrame:
    """Predictions from the text alone, beside doc_id and held_out.

    ``carry`` returns all columns of ``docs`` instead, with prediction and score under these names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        m = shared.value
        for b in batches:
            texts = b.column(where)
            buf, offsets = utf8(texts)
            n = len(texts)
            bits = np.zeros((n, len(m.langs) + 1))
            letters = np.zeros(n, bool)
            for i, j in blocks(offsets, BLOCK):
                part, at = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                bits[i:j] = m.bits(part, at)
                sums = np.concatenate(([0], np.cumsum(_LETTER[part])))
                letters[i:j] = sums[at[1:]] > sums[at[:-1]]
            for i in np.flatnonzero(~letters & (np.diff(offsets) > 0)).tolist():
                letters[i] = any(c.isalpha() for c in texts[i].as_py())
            known = letters if m.langs else np.zeros(n, bool)
            if m.langs:
                best = bits[:, :-1].argmin(1)
                least = bits[np.arange(n), best]
                share = 1 / np.exp2(np.clip(least[:, None] - bits, -1000, 1000)).sum(1)
            else:
                best, least, share = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            names = np.array([*m.langs, UNKNOWN], object)
            pred = pa.array(names[np.where(known, best, len(m.langs))], pa.string())
            score = pa.array(np.where(known, share, 0.0))
            own = list(b.columns)[: len(kept)]
            if carry:
                yield pa.RecordBatch.from_arrays([*own, pred, score], [*kept, *carry])
            else:
                yield pa.RecordBatch.from_arrays([*own, pred, score, pa.array(least / np.maximum(np.diff(offsets), 1))], [*kept, "lang_pred", "score", "bits_per_byte"])

    if carry:
        kept, where = docs.columns, docs.columns.index("text")
        schema = StructType([*docs.schema.fields, StructField(carry[0], StringType()), StructField(carry[1], DoubleType())])
        return docs.mapInArrow(run, schema)
    kept, where = ["doc_id", "held_out"], 2
    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string")).mapInArrow(run, PREDICTED)
