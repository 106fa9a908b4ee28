import hashlib
import json
import os
import random
import time
import urllib.request
from collections import Counter, defaultdict
from threading import Thread

import pytest
from pyspark.sql import functions as F

from tesselight.operators import baselines, comparison, cube, display, redundancy, rules, scan, screen, search, validation
from tesselight.service import Service, build_server, export_html
from tesselight.sources import readers
from tesselight.spec import Rule, Target

ROWS = 400


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    out = []
    for i in range(ROWS):
        x = {"id": i, "color": r.choice(["red", "blue", "green"]), "size": r.choice("sml"), "shape": r.choice("cq")}
        x["copy"] = x["color"][0]
        x["z"] = int(x["color"] == "red" and r.random() < 0.95)
        out.append(x)
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, color string, size string, shape string, copy string, z int").cache()


def test_dependencies(frame, rows):
    got = {(r["a"], r["b"]): r for r in screen.dependencies(frame.select("color", "copy", "size")).collect()}
    assert list(got) == [("color", "copy")] and got["color", "copy"]["kind"] == "equivalent"
    assert screen.exact_dependencies(frame.select("color", "copy", "size")) == {"color": {"copy"}, "copy": {"color"}}
    names, exact = ["color", "copy", "size"], {"color": {"copy"}, "copy": {"color"}}
    cells, left = cube.pruned_cells(frame, names, 3, exact, 100)
    assert left == [("color",), ("copy",), ("size",), ("color", "size"), ("copy", "size")]
    every = {(r["schema_id"], tuple(r["cell"])): r["n"] for r in cube.cells(frame, names, 3).collect()}
    kept = {(r["schema_id"], tuple(r["cell"])): r["n"] for r in cells.collect()}
    assert kept == {k: n for k, n in every.items() if cube.schemas(names, 3)[k[0]] in left}
    # beyond the capacity a schema is merged in its own way, so nothing repeats it
    assert cube.pruned_cells(frame, names, 3, exact, 1)[1] == cube.schemas(names, 3)
    assert search.searched_cells(frame, names, 3, exact=exact).select("schema_id").distinct().count() == 5


def test_profiles_and_leakage(spark):
    df = spark.createDataFrame([("unknown_deck", 1, "k")] * 7 + [("A", 2, "k")] * 2 + [(None, 3, "k")], "deck string, n int, one string")
    got = {r["col"]: r for r in screen.profiles(df).collect()}
    assert got["deck"]["placeholder"] == "unknown_deck" and got["deck"]["placeholder_level"] and got["deck"]["missing"] == 1
    assert got["one"]["constant"] and got["one"]["dominant"] and got["n"]["exceeds_capacity"]
    leak = screen.leakage(df, Target("n", "1")).collect()
    assert (leak[0]["col"], leak[0]["exceptions"], leak[0]["strength"]) == ("deck", 0, 1.0)


def test_catalogue_drops_nulls_but_shares_all_rows(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "x string")
    assert [(r["value"], r["n"], r["share"]) for r in screen.catalogue(df).orderBy("place").collect()] == [("a", 2, 0.5), ("b", 1, 0.25)]


def test_folds_are_stratified_and_partition(frame):
    folded = validation.folds(frame, "id", 5, 2).cache()
    assert folded.count() == 2 * ROWS
    sizes = [r["n"] for r in folded.groupBy("rep", "fold", "z").agg(F.count("*").alias("n")).where("z = 1").collect()]
    assert max(sizes) - min(sizes) <= 1


def test_cross_validation_by_hand(frame, rows):
    folded = validation.folds(frame, "id", 4, 1)
    fold = {r["id"]: r["fold"] for r in folded.collect()}
    got = {r["fold"]: (r["k_sel"], r["n_sel"]) for r in validation.cross_validated(folded, ["color", "size"], Rule(tau=0.8)).collect()}
    for f in range(4):
        train, test = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
        for r in rows:
            c = (test if fold[r["id"]] == f else train)[r["color"], r["size"]]
            c[0] += 1
            c[1] += r["z"]
        yes = [c for c, (n, k) in train.items() if k >= max(1, -(-n * 8 // 10))]
        assert got[f] == (sum(test[c][1] for c in yes), sum(test[c][0] for c in yes))


def test_nested_and_stability(frame):
    inner = validation.nested(validation.folds(frame, "id", 4, 1), ["color", "size", "shape"], Rule(tau=0.8), 2).cache()
    one = inner.where("d = 1").collect()
    assert len(one) == 4 and all(r["features"] == ["color"] for r in one)
    steady = {r["d"]: r for r in validation.stability(inner, ["color"]).collect()}
    assert steady[1]["mean_jaccard"] == 1.0 and steady[1]["is_reference"]


def test_split_certificates_and_width(frame):
    out = validation.certify_split(validation.halves(frame, "id").drop("id", "copy"), ["color", "size", "shape"], Rule(tau=0.6), 1).collect()
    assert any(r["certified"] and r["cell"] == ["red"] for r in out)
    assert validation.sufficient_width({1: (0.5, None), 2: (0.6, 3.0), 3: (0.61, 0.4)}) == 2


def test_nulls(frame, spark):
    null = validation.coverage_null([100, 100, 200], 60, Rule(tau=0.9), spark, 50).cache()
    assert null.count() == 50 and 0 < validation.p_value(null, "coverage", 0.5) <= 1
    assert validation.p_value(null, "coverage", 0.0) == 1.0
    family = validation.familywise_null(frame, ["color", "size"], Rule(tau=0.9), "id", 2, 5)
    assert family.count() == 5


def test_scan_finds_the_planted_value(frame):
    found = scan.scan(frame.drop("id", "z").withColumn("hit", F.col("color") == "red"), ["hit", "color", "size"], Rule(tau=0.9), 1)
    top = {(r["col"], r["value"]) for r in found.collect()}
    assert ("hit", "true") in top and ("size", "s") not in top


def test_rules_have_their_parents(frame, rows):
    got = rules.enumerate_rules(frame, [("color", "size")]).collect()
    for r in got:
        own = [x for x in rows if (x["color"], x["size"]) == tuple(r["cell"])]
        assert (r["n"], r["k"]) == (len(own), sum(x["z"] for x in own))
        parents = {tuple((c["feature"], c["value"]) for c in p["conditions"]): p["n"] for p in r["parents"]}
        assert parents == {((f, v),): sum(x[f] == v for x in rows) for f, v in zip(r["features"], r["cell"])}
    facet = {(r["feature"], r["value"]): r["rules"] for r in rules.facets(rules.enumerate_rules(frame, [("color", "size")])).collect()}
    assert facet["color", None] == 9 and facet["color", "red"] == 3
    assert rules.holding(rules.enumerate_rules(frame, [("color", "size")]), [("color", "red"), ("size", "s")]).count() == 1


def test_similar_sets_by_brute_force(frame, rows):
    named, sets, members = redundancy.collect(frame, ["color", "copy", "size"], Rule(tau=0.8), "id", 2)
    members, sets = members.cache(), sets.cache()
    held = defaultdict(dict)
    for r in members.collect():  # each row stands for w rows that agree with it in all features
        held[r["set_id"]][r["row"]] = r["w"]
    assert {r["set_id"]: r["n"] for r in sets.collect()} == {a: sum(x.values()) for a, x in held.items()}
    want = {}
    for a in held:
        for b in held:
            if a < b and (s := sum(w for row, w in held[a].items() if row in held[b]) / max(sum(held[a].values()), sum(held[b].values()))) >= 0.5:
                want[a, b] = s
    pairs = redundancy.similar(sets, members).cache()
    assert {(r["a"], r["b"]): r["similarity"] for r in pairs.collect()} == want
    first = sets.orderBy("set_id").first()
    assert first["centres"] == 3 and first["d"] == 1  # color, copy, and both name the same rows
    grouped = {r["set_id"]: r["leader"] for r in redundancy.groups(sets, pairs, 0.5).collect()}
    assert grouped[first["set_id"]] == first["set_id"]
    identical = redundancy.groups(sets, pairs, 1.0).where("set_id <> leader").count()
    assert identical == 0
    assert named.count() > sets.count()


def test_similar_sets_of_overlapping_kinds(spark):
    """Prefixes and bands of sizes lose no pair."""
    r = random.Random(5)
    rows = [(i, *(r.choice("abc") for _ in range(4)), r.randrange(2)) for i in range(300)]
    frame = spark.createDataFrame(rows, "id long, p string, q string, r string, s string, z int")
    _, sets, members = redundancy.collect(frame, ["p", "q", "r", "s"], Rule(tau=0.4), "id", 3)
    held = defaultdict(dict)
    for x in members.collect():
        held[x["set_id"]][x["row"]] = x["w"]
    for floor in (0.3, 0.5, 0.9):
        want = {}
        for a in held:
            for b in held:
                if a < b and (s := sum(w for row, w in held[a].items() if row in held[b]) / max(sum(held[a].values()), sum(held[b].values()))) >= floor - 1e-12:
                    want[a, b] = round(s, 9)
        assert {(x["a"], x["b"]): round(x["similarity"], 9) for x in redundancy.similar(sets, members, floor).collect()} == want


def test_display(frame):
    cells = display.grid(frame, ["color", "size"], Rule(tau=0.8))
    total = display.summary(cells).first()
    assert total["cells"] == 9 and total["rows"] == ROWS
    at = display.points(frame, ["color"], "id", 100).collect()
    assert len(at) == 100
    assert max(Counter((r["color"], r["dx"], r["dy"], r["dz"]) for r in at).values()) == 1


def test_baselines(frame, rows):
    k = sum(x["z"] for x in rows)
    got = baselines.held_out(frame, [{"color": "red"}, {"color": "red", "size": "s"}], 0.5).first()
    n = sum(x["color"] == "red" for x in rows)
    assert (got["n"], got["k"]) == (n, k) and got["net_coverage"] == (k - (n - k)) / k
    sets = {1: frozenset(range(6)), 2: frozenset(range(4, 9)), 3: frozenset({20})}
    assert baselines.greedy_cover(sets, {1: 2, 2: 2, 3: 1}, 4) == [1, 2]
    masks = frame.sparkSession.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3), (3, 9)], "mask int, row int")
    assert abs(baselines.description_stability(masks).first()["mean_jaccard"] - (1 / 3) / 3) < 1e-12
    leaves = baselines.tree_leaves(frame, ["color", "size"])
    assert leaves.agg(F.sum("n")).first()[0] == ROWS
    assert baselines.tarone_size(cube.cells(frame, ["color"], 1), 0.5, 0.05) == 3


def test_comparison(frame):
    out = comparison.compare(frame, ["color", "size", "shape"], Rule(tau=0.8), 4, "id", k=2).cache()
    assert out.count() == 6 and out.where("conditions > 4").count() == 0
    assert out.where("method = 'rules' and coverage < 0.9").count() == 0
    assert comparison.summarised(out, 0.8, 2).where("purity_holds = 1 and folds = 2").count() == 3


def test_readers(spark, tmp_path):
    path = tmp_path / "toy_set.csv"
    path.write_text("class,x\np,1\ne,\n")
    typed, text = readers.read_typed(spark, str(path)), readers.read_text(spark, str(path))
    assert typed.where("x is null").count() == 1 and text.where("x = ''").count() == 1
    assert readers.resolve("toy", readers.datasets(str(tmp_path))) == str(path)
    entry = readers.Entry("toy_set.csv", 2, 2, "class", hashlib.sha256(path.read_bytes()).hexdigest())
    assert readers.verify(spark, str(tmp_path), entry) == []
    assert readers.verify(spark, str(tmp_path), readers.Entry("toy_set.csv", 3, 2, "q", "0")) == ["sha256", "shape", "target"]
    assert readers.unlisted(str(tmp_path), []) == ["toy_set.csv"] and readers.size_text(2048) == "2.0 KB"


def test_service(frame, tmp_path):
    df = frame.drop("id", "copy").withColumn("hit", F.col("z").cast("string")).drop("z")
    service = Service(df)
    q = {"column": "hit", "value": "1", "tau": 0.8, "max_d": 2}
    status, answer = service.handle("/api/analyze", q)
    assert status == 200 and answer["branches"][0]["features"] == ["color"]
    assert service.handle("/api/analyze", q)[1] is answer
    assert service.handle("/api/target", {"column": "hit", "value": "7"})[0] == 400
    for path in ("landscape", "landscape/frontier", "landscape/curves", "screen", "rules", "centers/groups", "columns"):
        assert service.handle(f"/api/{path}", q)[0] == 200, path
    assert service.handle("/api/scan/start", {"drop": ["nope"]})[0] == 400
    assert service.handle("/api/scan/status", {})[1]["status"] == "idle"
    assert service.handle("/api/scan/start", {"tau": 0.8, "max_d": 1})[1]["accepted"]
    for _ in range(120):
        state = service.handle("/api/scan/status", {})[1]
        if state["status"] != "running":
            break
        time.sleep(0.5)
    assert state["status"] == "done"
    page = export_html(df, str(tmp_path / "out.html"), q)
    assert "color" in open(page).read()


def test_service_answers_whole(spark):
    n = 1700  # more than 500 for each of three columns
    df = spark.createDataFrame([(f"v{i}", str(int(i % 2 == 0)), "pq"[i % 2]) for i in range(n)], "aa string, hit string, zz string")
    service = Service(df)
    columns = {c["name"]: c["values"] for c in service.handle("/api/columns", {})[1]["columns"]}
    assert [len(columns[c]) for c in df.columns] == [n, 2, 2]
    q = {"column": "hit", "value": "1", "schemas": [["aa"], ["zz"]]}
    status, answer = service.handle("/api/rules", q)
    assert status == 200 and len({(tuple(r["features"]), tuple(r["cell"])) for r in answer["rules"]}) == len(answer["rules"]) == n + 2
    assert [r["purity"] for r in answer["rules"]] == sorted((r["purity"] for r in answer["rules"]), reverse=True)


def test_http(frame):
    server = build_server(frame.drop("id", "copy", "z"))
    Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/api/target"
        body = json.dumps({"column": "color", "value": "red"}).encode()
        with urllib.request.urlopen(urllib.request.Request(url, body)) as r:
            assert json.load(r)["rows"] == ROWS
    finally:
        server.shutdown()


def test_streamed_cells_add_up(spark, frame, tmp_path):
    from tesselight.streaming.cells import current, maintain

    source = str(tmp_path / "in")
    frame.select("color", "size", "z").repartition(3).write.parquet(source)
    stream = spark.readStream.schema("color string, size string, z int").option("maxFilesPerTrigger", 1).parquet(source)
    maintain(stream, ["color", "size"], str(tmp_path / "cells"), str(tmp_path / "ck")).awaitTermination()
    key = lambda df: sorted((r["schema_id"], tuple(r["cell"]), r["n"], r["k"]) for r in df.collect())
    assert key(current(spark, str(tmp_path / "cells"))) == key(cube.cells(frame, ["color", "size"], 2))


def test_entry_without_the_optional_part():
    import subprocess
    import sys

    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "tesselight.llm" or name.startswith(("tesselight.llm.", "corpus_pipeline")):
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as entry
names = set(entry.queries())
assert "branches_orders" in names and not any(n.startswith("op") for n in names) and "pipeline" not in names
assert set(entry.oracle_sql()) <= names
import tesselight.service, tesselight.streaming.cells
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
