import random
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselight.functions import binomial as B
from tesselight.operators import capacity, cube, landscape, search, validation
from tesselight.operators.encoding import merge_states
from tesselight.spec import Rule, Target, certificate, framed, positive_value, resolve_target, void_reason

FEATURES = ["a", "b", "c", "d"]


def planted(n=700, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x = {"id": i, "a": r.choice("xyz"), "b": r.choice("01"), "c": r.choice("pqrs"), "d": r.choice([None, "m", "n"])}
        x["z"] = int((x["a"] == "z" and x["b"] == "1") or r.random() < 0.04)
        rows.append(x)
    return rows


@pytest.fixture(scope="module")
def rows():
    return planted()


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, a string, b string, c string, d string, z int").cache()


def table(df):
    return {(r["schema_id"], tuple(r["cell"])): (r["n"], r["k"]) for r in df.collect()}


def test_both_cube_forms_equal_brute_force(frame, rows):
    want = brute.cells(rows, FEATURES, 3)
    assert table(cube.cells(frame, FEATURES, 3)) == want
    assert table(cube.cells(frame, FEATURES, 3, form="grouping_sets")) == want


def test_winner_per_width(frame, rows):
    found = {r["d"]: r["features"] for r in search.branches(frame, FEATURES, Rule(tau=0.9), 4).collect()}
    assert found[2] == ["a", "b"]
    want = brute.cells(rows, FEATURES, 2)
    by = defaultdict(lambda: [0, 0, 0])
    total = sum(r["z"] for r in rows)
    for (i, _), (n, k) in want.items():
        if brute.pure(n, k, 0.9):
            by[i][0] += k
            by[i][1] += 1
            by[i][2] += n
    got = {r["schema_id"]: r for r in search.scores(cube.cells(frame, FEATURES, 2), Rule(tau=0.9)).collect()}
    for i, r in got.items():
        assert [r["k_sel"], r["n_centers"], r["n_sel"]] == by[i]
        assert r["coverage"] == by[i][0] / total


def test_absence_is_the_complement(spark, rows):
    df = spark.createDataFrame([{**x, "t": "yes" if x["z"] else "no"} for x in rows], "a string, b string, t string")
    absent = framed(df, Target("t", "yes"), direction="absence")
    other = framed(df, Target("t", "no"))
    assert table(cube.cells(absent, ["a", "b"], 2)) == table(cube.cells(other, ["a", "b"], 2))


def test_all_values_equal_one_by_one(spark, rows):
    df = spark.createDataFrame([{**x, "t": x["c"]} for x in rows], "a string, b string, t string")
    every = search.branches_by_value(df, ["a", "b"], "t", Rule(tau=0.3), 2)
    for v in "pqrs":
        one = search.branches(framed(df, Target("t", v)), ["a", "b"], Rule(tau=0.3), 2)
        cols = ["d", "schema_id", "k_sel", "n_centers", "n_sel"]
        assert sorted(map(tuple, every.where(F.col("value") == v).select(*cols).collect())) == sorted(map(tuple, one.select(*cols).collect()))


def test_report_agrees_with_winner(frame):
    rule = certificate("certified", tau=0.5, correction="bonferroni")
    won = {r["d"]: r for r in search.branches(frame, FEATURES, rule, 2).collect()}
    got = search.report(frame, won[2]["features"], rule).first()
    assert (got["k_sel"], got["n_centers"]) == (won[2]["k_sel"], won[2]["n_centers"])
    assert all(c["lower"] >= 0.5 for c in got["centers"])
    assert got["coverage_lower"] < got["coverage"]


def test_certified_cells_by_their_tails(frame, rows):
    rule = certificate("certified", tau=0.5, alpha=0.05, correction="bonferroni")
    cells = brute.cells(rows, FEATURES, 2)
    occupied = defaultdict(int)
    for i, _ in cells:
        occupied[i] += 1
    want = {key for key, (n, k) in cells.items() if k and brute.tail(k, n, 0.5) <= 0.05 / occupied[key[0]]}
    got = search.centres(cube.cells(frame, FEATURES, 2), rule).where("is_centre")
    assert set(table(got)) == want and want


def test_family_counts_row_sets(frame, rows):
    sets = set()
    for s in brute.schemas(FEATURES, 2):
        held = defaultdict(set)
        for r in rows:
            held[tuple(r[f] for f in s)].add(r["id"])
        sets |= {frozenset(x) for x in held.values()}
    assert capacity.family_size(frame, FEATURES, "id", 2) == len(sets)


def test_curves_meet_the_search_at_each_floor(frame):
    cells = cube.cells(frame, FEATURES, 2).cache()
    curve = {(r["d"], round(r["tau"], 2)): r for r in landscape.curves(cells, Rule(tau=0.9), 0.2).collect()}
    for tau in (0.5, 0.75, 1.0):
        for r in search.winners(search.scores(cells, Rule(tau=tau))).collect():
            assert abs(curve[r["d"], tau]["x"] - r["coverage"]) < 1e-12


def test_frontier_is_a_staircase(frame):
    scored = search.scores(cube.cells(frame, FEATURES, 3), Rule(tau=0.3)).cache()
    got = [(r["d"], r["cost"], r["x"]) for r in landscape.frontier(scored).orderBy("d", "cost").collect()]
    want = []
    for d in (1, 2, 3):
        best = -1.0
        some = sorted(((r["n_centers"], -r["coverage"], r["schema_id"]) for r in scored.collect() if r["d"] == d and r["n_centers"]))
        for cost, x, _ in some:
            if -x > best + 1e-12:
                want.append((d, cost, -x))
                best = -x
    assert got == want


def test_bounds_by_definition():
    n = np.array([10, 10, 10, 200])
    k = np.array([5, 0, 10, 150])
    low = B.exact_lower(k, n, 0.05)
    assert low[1] == 0 and abs(low[2] ** 10 - 0.05) < 1e-12
    for i in (0, 3):
        assert abs(brute.tail(int(k[i]), int(n[i]), low[i]) - 0.05) < 1e-9
    assert abs(B.exact_upper(k, n, 0.05)[2] - 1) < 1e-12
    for m in (1, 7, 40, 150):
        least = int(B.least_certified([m], 0.8, 0.05)[0])
        assert least == min([x for x in range(1, m + 1) if brute.tail(x, m, 0.8) <= 0.05], default=m + 1)
        assert B.least_certified([m], 0.8, 0.05, strict=True)[0] >= least


def test_benjamini_hochberg_worked_example():
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216]
    assert B.benjamini_hochberg(p, 0.05) == [True, True] + [False] * 8


@pytest.mark.parametrize("bad", [{"tau": 0}, {"alpha": 1}, {"kind": "certified", "tau": 1.0}, {"correction": "family"}, {"min_rows": 0}])
def test_rules_are_checked(bad):
    with pytest.raises(ValueError):
        Rule(**bad)


def test_targets_are_checked(spark):
    df = spark.createDataFrame([("x", "u", 1), ("y", "v", 2)], "a string, b string, c int")
    for q in ({"column": "no"}, {"column": "a", "value": "q"}, {"column": "a", "value": "x", "also": [("a", "x")]}, {"column": "a", "also": [("b", "u")]}):
        with pytest.raises(ValueError):
            resolve_target(df, **q)
    assert resolve_target(df, "a", "x", [("c", "1"), ("b", "u")]).also == (("b", "u"), ("c", "1"))
    assert positive_value(df, "a") == "y"
    assert void_reason(Rule(tau=0.5), 0.5) and not void_reason(Rule(tau=0.51), 0.5)


def test_empty_frame(spark):
    empty = spark.createDataFrame([], "a string, b string, z int")
    assert cube.cells(empty, ["a", "b"], 2).count() == 0
    assert search.branches(empty, ["a", "b"], Rule(), 2).count() == 0


def test_names_of_levels_stay_apart(spark):
    """A missing level, a text that reads like it, and texts that hold separators."""
    values = [None, "missing", "'missing'", "a\x1fb", "a", "b", "\x1e0", "\x1e", "\x1f", ""]
    rows = [(v, w, i % 2) for i, (v, w) in enumerate((v, w) for v in values for w in values)]
    frame = spark.createDataFrame(rows, "a string, b string, z int")
    for form in ("arrow", "grouping_sets"):
        got = cube.cells(frame, ["a", "b"], 2, form=form).collect()
        assert all(len(r["cell"]) == r["d"] for r in got) and [r["n"] for r in got if r["d"] == 2] == [1] * 100
        assert {r["n"] for r in got if r["d"] == 1} == {10}
        assert {tuple(r["cell"]) for r in got if r["schema_id"] == 0} == {("missing",), ("'missing'",), ("''missing''",), *((v,) for v in values[3:])}
    sizes, counted = cube.value_cells(frame.drop("z"), ["a"], "b", 1)
    assert {(r["cell"][0], r["n"]) for r in sizes.collect()} == {(x, 10) for x in ("missing", "'missing'", "''missing''", *values[3:])}
    assert {r["value"] for r in counted.collect()} == set(values) - {None}


def test_folds_merge_by_their_training_rows(spark):
    r = random.Random(7)
    rows = [(i, r.choice("abcdefghijklmnopqrstuvw"), r.randrange(14), r.randrange(2)) for i in range(300)]
    frame = spark.createDataFrame(rows, "id long, a string, b int, z int")
    folded = validation.folds(frame, "id", 5, 1).cache()
    fold = {x["id"]: x["fold"] for x in folded.collect()}
    got = {}
    for x in validation.fold_cells(folded, ["a", "b"], 2, encoding="train", ordered={"b": True}).collect():
        got[x["_part"], x["schema_id"], tuple(x["cell"])] = (x["n"], x["k"], x["n_train"], x["k_train"])
    want = {}
    for f in range(5):
        train = [x for x in rows if fold[x[0]] != f]
        count = [None, Counter(x[1] for x in train), Counter(x[2] for x in train)]
        every = [None, sorted({x[1] for x in rows}), sorted({x[2] for x in rows})]

        def level(c, k, count=count, every=every, train=train):
            if k >= len(count[c]):
                return {v: str(v) for v in every[c]}
            if c == 1:
                order = sorted(count[c], key=lambda v: (-count[c][v], v))
                return {v: f"#{min(order.index(v), k - 1) if v in count[c] else k - 1}" for v in every[c]}
            before, raw, last = 0, {}, 0
            for v in every[c]:
                if count[c][v]:
                    last = before * k // len(train)
                raw[v] = last
                before += count[c][v]
            dense = sorted(set(raw.values()))
            return {v: f"#{dense.index(g)}" for v, g in raw.items()}

        for i, s in enumerate([(1,), (2,), (1, 2)]):
            for state in merge_states([len(count[c]) for c in s]):
                maps = [level(c, k) for c, k in zip(s, state)]
                if len({tuple(m[x[c]] for m, c in zip(maps, s)) for x in train}) <= len(train) // 10:
                    break
            for x in rows:
                key = (f"0-{f}", i, tuple(m[x[c]] for m, c in zip(maps, s)))
                h = want.setdefault(key, [0, 0, 0, 0])
                at = 0 if fold[x[0]] == f else 2
                h[at] += 1
                h[at + 1] += x[3]
    assert got == {k: tuple(h) for k, h in want.items()}
    kept, gains = validation.select_width(folded, [["a"], ["a", "b"]], Rule(tau=0.6), "train", {"b": True})
    assert kept in (1, 2) and [(x["d"], x["against"]) for x in gains.collect()] == [(2, 1)]


def test_crowded_schemas_merge_like_brute_force(spark):
    r = random.Random(2)
    rows = [{"a": r.choice("abcdefghijkl"), "b": r.randrange(9), "c": r.choice("xy"), "z": r.randrange(2)} for _ in range(500)]
    frame = spark.createDataFrame(rows, "a string, b int, c string, z int")
    got = capacity.coarsened(cube.cells(frame, ["a", "b", "c"], 3), frame, ["a", "b", "c"], 500, {"b": True})
    count = {c: Counter(x[c] for x in rows) for c in "abc"}

    def level(c, k):
        order = sorted(count[c])
        if k >= len(order):
            return {v: str(v) for v in order}
        if c == "b":
            before, raw = 0, {}
            for v in order:
                raw[v] = before * k // 500
                before += count[c][v]
            dense = sorted(set(raw.values()))
            return {v: f"#{dense.index(raw[v])}" for v in order}
        return {v: f"#{min(i, k - 1)}" for i, v in enumerate(sorted(order, key=lambda v: (-count[c][v], v)))}

    want = {}
    for i, s in enumerate(brute.schemas("abc", 3)):
        for state in merge_states([len(count[c]) for c in s]):
            maps = [level(c, k) for c, k in zip(s, state)]
            held = defaultdict(lambda: [0, 0])
            for x in rows:
                h = held[tuple(m[x[c]] for m, c in zip(maps, s))]
                h[0] += 1
                h[1] += x["z"]
            if len(held) <= 50:
                break
        want.update({(i, cell): tuple(h) for cell, h in held.items()})
    assert table(got) == want
