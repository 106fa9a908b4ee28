"""Secret scans (operator 9).

All rules are compiled into one automaton (see :mod:`.automaton`), which reads the bytes of all
texts once and reports each place where a rule has what every span of it must hold (its first
characters, up to its least length), and which rule that is. No span of a rule holds a byte that
the rule does not know, so a reported span lies within the run of the rule's bytes around the place,
and what happens outside of the run can't shift it. Only these runs, and only for the rules reported
in them, are matched by the rule's full expression: leftmost, non-overlapping, with those that fail
the rule's length dropped (a match that is too short still takes its characters away from the next).
Spans are in code points. Matching is linear in a run: no expression can try one stretch twice.

Kinds beyond the base (``assign``, ``access``, ``hex``) are ``jwt``, ``pem`` and ``token``
(prefixed access tokens; the last two as they stand, a jwt not from within a word); they only add to
``spans``.

Edge cases: null text counts as empty and has no spans; a null doc_id stays; repeated rows each
get their row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import BREAK, Automaton, compile_rules
from .common import blocks, utf8

#: kind: (pattern for spans, pattern of the automaton, bytes that a span may hold, group whose length counts, least length).
RULES: dict[str, tuple[str, str, str, int, int]] = {
    "assign": (
        r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=\-]{8})",
        r"[A-Za-z0-9+/_.=\-\"'\x20:]",
        2,
        8,
    ),
    "access": (r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{12}", "[A-Z0-9]", 0, 16),
    "hex": (r"[0-9a-f]+", r"[0-9a-f]{32}", "[0-9a-f]", 0, 32),
    "jwt": (r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++", r"eyJ[A-Za-z0-9_\-]{5}", r"[A-Za-z0-9_\-.]", 0, 30),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"PRIVATE KEY-----", r"[A-Z\x20\-]", 0, 1),
    "token": (r"gh[oprsu]_[A-Za-z0-9]+", r"gh[oprsu]_[A-Za-z0-9]{4}", "[A-Za-z0-9_]", 0, 36),
}
BASE = ("assign", "access", "hex")
SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, all_spans array<struct<kind: string, start: long, end: long>>"

_KINDS = list(RULES)
# over bytes, so case is folded for A-Z alone
_PATTERNS = [re.compile(v[0].encode()) for v in RULES.values()]
_MEMBERS = [np.array([bool(re.fullmatch(v[2].encode(), bytes([b]))) for b in range(256)]) for v in RULES.values()]
_COMPILED: list[Automaton] = []


def automaton() -> Automaton:
    if not _COMPILED:
        _COMPILED.append(compile_rules([v[1] for v in RULES.values()]))
    return _COMPILED[0]


def spans(rules: Automaton, buf: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[str, int, int]]]:
    """Of each text with any: (kind, start, end) in code points, by start and then by kind as listed."""
    n = len(offsets) - 1
    joined = np.full(len(buf) + n, BREAK, np.uint8)
    joined[np.arange(len(buf)) + np.repeat(np.arange(n), np.diff(offsets))] = buf
    places, states = rules.reports(joined)
    if not len(places):
        return {}
    begins = offsets[:-1] + np.arange(n)  # of the texts in the joined bytes
    points = np.concatenate(([0], np.cumsum((joined & 0xC0) != 0x80)))
    has = np.array([[k in e for k in range(len(RULES))] for e in rules.ends])
    out: dict[int, list[tuple[int, int, int]]] = {}
    for k, (_, _, _, group, least) in enumerate(RULES.values()):
        at = places[has[states, k]]
        if not len(at):
            continue
        other = np.flatnonzero(~_MEMBERS[k][joined])  # texts end with such a byte
        which = np.unique(np.searchsorted(other, at))
        for left, right in zip(np.where(which > 0, other[which - 1] + 1, 0).tolist(), other[which].tolist()):
            for m in _PATTERNS[k].finditer(joined[left:right].tobytes()):
                if m.end(group) - m.start(group) >= least:
                    text = int(np.searchsorted(begins, left, "right")) - 1
                    zero = points[begins[text]]
                    out.setdefault(text, []).append((int(points[left + m.start()] - zero), k, int(points[left + m.end()] - zero)))
    return {t: [(_KINDS[k], s, e) for s, k, e in sorted(x)] for t, x in out.items()}


def scan(docs: DataFrame) -> DataFrame:
    """A row for each document: counts and digest of base spans, and all spans."""
    rules = automaton()  # compiled once; its arrays go with the tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            buf, offsets = utf8(texts)
            every = {}
            for i, j in blocks(offsets, 4 << 20):
                every |= {i + t: x for t, x in spans(rules, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).items()}
            counts, digests, lists, structs = np.zeros((3, len(ids)), np.int64), [none] * len(ids), [""] * len(ids), [[]] * len(ids)
            for i, found in every.items():
                base = ",".join(f"{k}:{s}:{e}" for k, s, e in found if k in BASE)
                for k, kind in enumerate(BASE):
                    counts[k, i] = sum(x[0] == kind for x in found)
                digests[i] = hashlib.sha256(base.encode()).hexdigest()
                lists[i] = ",".join(f"{k}:{s}:{e}" for k, s, e in found)
                structs[i] = [{"kind": k, "start": s, "end": e} for k, s, e in found]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [ids, *map(pa.array, counts), pa.array(digests), pa.array(lists), pa.array(structs, kind)],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "all_spans"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCANNED)
