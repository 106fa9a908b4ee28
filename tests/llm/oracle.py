"""Slow, plain versions of the operators, for small tables."""

import base64
import hashlib
import re
from collections import defaultdict
from math import floor, isfinite, log2

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text):
    words = WORD.findall(lower(text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)])


def near_groups(rows):
    """{doc_id: (n_shingles, component)} of (doc_id, text) rows with ids of their own."""
    sets = {d: shingles(t) for d, t in rows}
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def substrings(rows, length=100):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256)}."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                cover[i : i + length] = b"\1" * length
            else:
                seen.add(w)
        kept = bytes(x for x, c in zip(b, cover) if not c)
        spans = sum(1 for i in range(len(cover)) if cover[i] and (i == 0 or not cover[i - 1]))
        out[d] = (len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest())
    return out


def ppm_bits(texts, text, order):
    """Bits of ``text`` after training on ``texts``: escape method C with exclusion, from raw counts."""
    counts = defaultdict(lambda: defaultdict(int))
    for t in texts:
        for i in range(len(t)):
            for k in range(min(order, i) + 1):
                counts[t[i - k : i]][t[i]] += 1

    def after(context):
        below = after(context[1:]) if context else [1 / 256] * 256
        seen = counts.get(context)
        if not seen:
            return below
        n, kinds = sum(seen.values()), len(seen)
        left = 1 - sum(below[x] for x in seen)
        return [seen[x] / (n + kinds) if x in seen else kinds / (n + kinds) * below[x] / left for x in range(256)]

    return -sum(log2(after(text[max(0, i - order) : i])[text[i]]) for i in range(len(text)))


ASSIGN = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def secrets(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def top(vectors, k=20):
    """[(query, rank, id, score)] of (id, list) rows."""
    ok = [(i, [floor(64 * x) for x in v]) for i, v in vectors if v is not None and all(x is not None and isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q is not None and q % 20 == 0:
            scored = sorted((-sum(map(int.__mul__, a, b)), i) for i, b in ok if i != q and len(a) == len(b))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def records(rows, least=0):
    """{page_id: (bytes, digest, type, refers)} of (page_id, html) rows."""
    by = defaultdict(list)
    for p, h in rows:
        by[(h or "").encode()].append(p)
    out = {}
    for body, ids in by.items():
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        first = min(ids)
        for p in ids:
            again = len(body) >= least and p != first
            out[p] = (len(body), digest, "revisit" if again else "response", first if again else None)
    return out


def edit_distance_inside(item, text):
    """Least edits between ``item`` and any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)
