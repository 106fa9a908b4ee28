"""SQL for the registered queries: one grouping per schema, written out."""

from __future__ import annotations

from itertools import combinations
from statistics import NormalDist

from ..sources.frames import EVENT_FEATURES, EVENTS_SQL, LINE_FEATURES, LINES_SQL, ORDER_FEATURES, ORDERS_SQL


def cells(frame: str, features: list[str], widest: int, only: list[tuple[str, ...]] | None = None, by: str = "") -> str:
    """CTEs f (frame) and cells (schema_id, d, features, cell, n, k)."""
    wanted = only or [c for d in range(1, widest + 1) for c in combinations(features, d)]
    one = []
    for i, s in enumerate(wanted):
        cell = ", ".join(f"coalesce({c}::VARCHAR, 'missing')" for c in s)
        one.append(f"SELECT {by}{i} AS schema_id, {len(s)} AS d, '{'+'.join(s)}' AS features, concat_ws('|', {cell}) AS cell, count(*) AS n, sum(z)::BIGINT AS k FROM f GROUP BY {by}{', '.join(s)}")
    return f"f AS ({frame}), cells AS ({' UNION ALL '.join(one)})"


def marked(tau: float, least: int = 1) -> str:
    return f"marked AS (SELECT *, (n >= {least} AND k >= greatest(1, ceil({tau} * n - 1e-9))) AS yes FROM cells)"


SCORES = """scores AS (SELECT schema_id, d, features, sum(CASE WHEN yes THEN k ELSE 0 END)::BIGINT AS k_sel, count(*) FILTER (yes) AS n_centers,
  sum(CASE WHEN yes THEN n ELSE 0 END)::BIGINT AS n_sel, sum(k)::BIGINT AS positives, sum(n)::BIGINT AS rows FROM marked GROUP BY ALL),
s AS (SELECT *, CASE WHEN positives > 0 THEN k_sel::DOUBLE / positives ELSE 0 END AS coverage, n_sel::DOUBLE / rows AS mass FROM scores)"""
#: Normal quantiles at 0.05 / cells: SQL has none.
Z = ", ".join(f"({c}, {NormalDist().inv_cdf(1 - 0.05 / c)!r}::DOUBLE)" for c in range(1, 471))
WILSON = f"""SELECT schema_id, max((n * k::DOUBLE / n / n + z * z / (2 * n) - z * sqrt((k::DOUBLE / n * (1 - k::DOUBLE / n) + z * z / (4 * n)) / n)) / (1 + z * z / n)) AS wilson
FROM (SELECT *, count(*) OVER (PARTITION BY schema_id) AS c FROM cells) JOIN (VALUES {Z}) q(c, z) USING (c) GROUP BY schema_id"""
BEST = f"""SELECT schema_id, d, features, k_sel, n_centers, n_sel, coverage, mass FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY coverage DESC, n_centers, mass, round(wilson, 12) DESC, schema_id) AS r
FROM s JOIN ({WILSON}) USING (schema_id)) WHERE r = 1"""
BIN = "greatest(0, least(9, ceil({} * 10 - 1e-9)::INT - 1))"


def search(frame: str, features: list[str], widest: int, tau: float, tail: str, only: list[tuple[str, ...]] | None = None) -> str:
    return f"WITH {cells(frame, features, widest, only)}, {marked(tau)}, {SCORES} {tail}"


def lines(tail: str, tau: float = 0.5, widest: int = 3) -> str:
    return search(LINES_SQL, LINE_FEATURES, widest, tau, tail)


def orders(tail: str, tau: float = 0.36, widest: int = 3) -> str:
    return search(ORDERS_SQL, ORDER_FEATURES, widest, tau, tail)


def events(tail: str, tau: float = 0.22, widest: int = 3) -> str:
    return search(EVENTS_SQL, EVENT_FEATURES, widest, tau, tail)


PLACED = f"""p AS (SELECT *, {BIN.format('coverage')} AS ix, {BIN.format('coalesce(n_centers::DOUBLE / nullif(max(n_centers) OVER (PARTITION BY d), 0), 0)')} AS iy FROM
  (SELECT * FROM s))"""


def keyed(frame: str, features: list[str], widest: int, ordered: tuple[str, ...] = (), only: list[tuple[str, ...]] | None = None, extra: str = "") -> str:
    """CTEs f and keyed (schema_id, d, features, id, cell, z, extra): rows by cell, schemas merged to capacity.

    The states of merging are counted one by one; the first that fits is taken.
    """
    wanted = only or [c for d in range(1, widest + 1) for c in combinations(features, d)]
    out = [f"f AS ({frame})"]
    for c in features:
        out.append(f"""w_{c} AS (SELECT v, code, row_number() OVER (ORDER BY cnt DESC, code) - 1 AS rk, coalesce(sum(cnt) OVER (ORDER BY code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
  (sum(cnt) OVER ())::BIGINT AS total, count(*) OVER () AS many FROM (SELECT {c} AS v, count(*) AS cnt, row_number() OVER (ORDER BY {c}) - 1 AS code FROM f GROUP BY {c}))""")
    parts = []
    for i, s in enumerate(wanted):
        ks = [f"k{j}" for j in range(len(s))]
        step = []
        for j, k in enumerate(ks):
            widest_here = " AND ".join([f"{k} > {o}" for o in ks[:j]] + [f"{k} >= {o}" for o in ks[j + 1 :]]) or "true"
            step.append(f"CASE WHEN {widest_here} THEN {k} - 1 ELSE {k} END")
        label = [f"CASE WHEN {k} >= w{j}.many THEN w{j}.v::VARCHAR ELSE '#' || {f'(w{j}.before * {k} // w{j}.total)' if c in ordered else f'least(w{j}.rk, {k} - 1)'}::VARCHAR END" for j, (k, c) in enumerate(zip(ks, s))]
        joins = " ".join(f"JOIN w_{c} w{j} ON w{j}.v = g.{c}" for j, c in enumerate(s))
        out.append(f"""st{i}(t, {', '.join(ks)}) AS (SELECT 0, {', '.join(f'(SELECT count(*) FROM w_{c})' for c in s)} UNION ALL SELECT t + 1, {', '.join(step)} FROM st{i} WHERE greatest({', '.join(ks)}) > 1)""")
        out.append(f"""fit{i} AS (SELECT st{i}.* FROM st{i} WHERE t = (SELECT min(t) FROM (SELECT t, count(DISTINCT concat_ws('|', {', '.join(label)})) AS c FROM (SELECT DISTINCT {', '.join(s)} FROM f) g {joins}, st{i} GROUP BY t)
  WHERE c <= greatest(1, (SELECT count(*) // 10 FROM f))))""")
        parts.append(f"SELECT {i} AS schema_id, {len(s)} AS d, '{'+'.join(s)}' AS features, g.id, concat_ws('|', {', '.join(label)}) AS cell, g.z{extra} FROM f g {joins}, fit{i}")
    return ", ".join([*out, f"keyed AS ({' UNION ALL '.join(parts)})"])


MERGED = "cells AS (SELECT schema_id, d, features, cell, count(*) AS n, sum(z)::BIGINT AS k FROM keyed GROUP BY ALL)"


def merged_search(frame: str, features: list[str], widest: int, tau: float, tail: str, ordered: tuple[str, ...] = (), only: list[tuple[str, ...]] | None = None) -> str:
    return f"WITH RECURSIVE {keyed(frame, features, widest, ordered, only)}, {MERGED}, {marked(tau)}, {SCORES} {tail}"


def folds(reps: int, k: int = 5) -> str:
    return f"folded AS (SELECT id, z, rep, (row_number() OVER (PARTITION BY rep, z ORDER BY md5('0:' || rep || ':' || id), id) - 1) % {k} AS fold FROM f, range(0, {reps}) r(rep))"


#: Every fold's cells with the training rows' counts beside the fold's own.
FOLD_CELLS = """t AS (SELECT rep, fold, schema_id, d, features, cell, count(*) AS n, sum(keyed.z)::BIGINT AS k FROM keyed JOIN folded USING (id) GROUP BY ALL),
a AS (SELECT rep, schema_id, d, features, cell, sum(n)::BIGINT AS na, sum(k)::BIGINT AS ka FROM t GROUP BY ALL),
g AS (SELECT a.*, p.fold, coalesce(t.n, 0)::BIGINT AS n, coalesce(t.k, 0)::BIGINT AS k FROM a JOIN (SELECT DISTINCT rep, fold FROM folded) p USING (rep) LEFT JOIN t ON t.rep = a.rep AND t.fold = p.fold AND t.schema_id = a.schema_id AND t.cell = a.cell)"""


def fold_marked(tau: float) -> str:
    return f"m AS (SELECT *, na - n AS nt, ka - k AS kt, na > n AND ka - k >= greatest(1, ceil({tau} * (na - n) - 1e-9)) AS yes FROM g)"


def nested(tau: float) -> str:
    """CTE held (rep, fold, d, schema_id, features, k_sel, coverage): what each fold's search covers on the fold."""
    return f"""{FOLD_CELLS}, {fold_marked(tau)},
tr AS (SELECT rep, fold, schema_id, d, features, coalesce(sum(kt) FILTER (yes), 0)::DOUBLE / sum(kt)::BIGINT AS coverage, count(*) FILTER (yes) AS n_centers, coalesce(sum(nt) FILTER (yes), 0)::DOUBLE / sum(nt)::BIGINT AS mass FROM m WHERE nt > 0 GROUP BY ALL),
wi AS (SELECT rep, fold, schema_id, max((nt * kt::DOUBLE / nt / nt + z * z / (2 * nt) - z * sqrt((kt::DOUBLE / nt * (1 - kt::DOUBLE / nt) + z * z / (4 * nt)) / nt)) / (1 + z * z / nt)) AS wilson
  FROM (SELECT *, count(*) OVER (PARTITION BY rep, fold, schema_id) AS c FROM m WHERE nt > 0) JOIN (VALUES {Z}) q(c, z) USING (c) GROUP BY ALL),
won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rep, fold, d ORDER BY coverage DESC, n_centers, mass, round(wilson, 12) DESC, schema_id) AS r FROM tr JOIN wi USING (rep, fold, schema_id)) WHERE r = 1),
held AS (SELECT m.rep::INT AS rep, m.fold::INT AS fold, m.d, m.schema_id, m.features, coalesce(sum(k) FILTER (yes), 0)::BIGINT AS k_sel, coalesce(sum(k) FILTER (yes), 0)::DOUBLE / sum(k)::BIGINT AS coverage FROM m JOIN won USING (rep, fold, schema_id) GROUP BY ALL)"""
