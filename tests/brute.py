"""Slow twins over lists of dictionaries."""

from collections import defaultdict
from itertools import combinations
from math import ceil, comb


def schemas(features, widest):
    return [s for d in range(1, widest + 1) for s in combinations(features, d)]


def cells(rows, features, widest):
    out = {}
    for i, s in enumerate(schemas(features, widest)):
        held = defaultdict(lambda: [0, 0])
        for r in rows:
            c = held[tuple("missing" if r[f] is None else str(r[f]) for f in s)]
            c[0] += 1
            c[1] += r["z"]
        for cell, (n, k) in held.items():
            out[i, cell] = (n, k)
    return out


def tail(k, n, p):
    return 1.0 if k <= 0 else sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))


def pure(n, k, tau, least=1):
    return n >= least and k >= max(1, ceil(tau * n - 1e-9))
