import random
from collections import Counter
from itertools import product

from tesselight.operators import encoding as E


def test_missing_is_one_level_and_last(spark):
    df = spark.createDataFrame([(1.5,), (None,), (float("nan"),), (0.5,)], "x double")
    words = {r["value"]: (r["code"], r["cnt"]) for r in E.dictionary(df).collect()}
    assert words == {"0.5": (0, 1), "1.5": (1, 1), None: (2, 2)}
    assert sorted(r["x"] for r in E.encode(df, ["x"], E.dictionary(df)).collect()) == [0, 1, 2, 2]


def test_nominal_levels_by_frequency(spark):
    df = spark.createDataFrame([(c,) for c in "aaabbcd"], "x string")
    got = {r["value"]: r["merged"] for r in E.coarsen_nominal(E.dictionary(df), 3).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 2}
    assert {r["merged"] for r in E.coarsen_nominal(E.dictionary(df), 1).collect()} == {0}
    assert {r["value"]: r["merged"] for r in E.coarsen_nominal(E.dictionary(df), 9).collect()} == dict(zip("abcd", range(4)))


def test_ordered_levels_by_rows_before(spark):
    values = [1] * 5 + [2] * 1 + [3] * 1 + [4] * 3
    df = spark.createDataFrame([(v,) for v in values], "x int")
    got = {int(r["value"]): r["merged"] for r in E.coarsen_ordered(E.dictionary(df), 2).collect()}
    before, n, raw = 0, len(values), {}
    for v, c in sorted(Counter(values).items()):
        raw[v] = before * 2 // n
        before += c
    dense = {g: i for i, g in enumerate(sorted(set(raw.values())))}
    assert got == {v: dense[g] for v, g in raw.items()}


def test_unseen_levels(spark):
    fit = spark.createDataFrame([(v,) for v in [10, 10, 20, 30, 40, 40]], "x int")
    every = E.dictionary(spark.createDataFrame([(v,) for v in [5, 10, 25, 40]], "x int"))
    fitted = E.coarsen_ordered(E.dictionary(fit), 2)
    of = {int(r["value"]): r["merged"] for r in fitted.collect()}
    got = {int(r["value"]): r["merged"] for r in E.apply_fitted(fitted, every, True).collect()}
    assert (got[5], got[10], got[40]) == (0, of[10], of[40]) and got[25] >= of[10]
    nominal = E.coarsen_nominal(E.dictionary(fit), 2)
    assert {int(r["value"]): r["merged"] for r in E.apply_fitted(nominal, every, False).collect()}[25] == 1


def test_capacity_takes_the_first_state_that_fits(spark):
    r = random.Random(1)
    rows = [(r.choice("abcdefghij"), r.choice("uvwxyz"), r.randrange(8)) for _ in range(300)]
    df = spark.createDataFrame(rows, "a string, b string, c int")
    words = E.dictionary(df)
    names = ["a", "b", "c"]
    merged, state = E.coarsen_to_capacity(E.encode(df, names, words), names, words, {"c": True}, 300)

    def apply(state):
        maps = []
        for c, k in zip(range(3), state):
            count = Counter(x[c] for x in rows)
            order = sorted(count)
            if k >= len(order):
                maps.append({v: i for i, v in enumerate(order)})
            elif c == 2:
                before, raw = 0, {}
                for v in order:
                    raw[v] = before * k // 300
                    before += count[v]
                dense = {g: i for i, g in enumerate(sorted(set(raw.values())))}
                maps.append({v: dense[raw[v]] for v in order})
            else:
                top = sorted(order, key=lambda v: (-count[v], order.index(v)))
                maps.append({v: min(i, k - 1) for i, v in enumerate(top)})
        return Counter(tuple(m[x] for m, x in zip(maps, row)) for row in rows)

    want = next(s for s in E.merge_states([10, 6, 8]) if len(apply(s)) <= 30)
    assert state == want
    assert Counter(tuple(x) for x in merged.select(*names).collect()) == apply(want)


def test_merge_states_never_go_below_one():
    states = E.merge_states([3, 2])
    assert states == [[3, 2], [2, 2], [1, 2], [1, 1]]
    assert all(min(s) >= 1 for s in states) and list(product([1], repeat=2))[0] == tuple(states[-1])
