"""Requests as dictionaries, answers as JSON-ready dictionaries; HTTP and HTML around them.

Each handler declares DataFrames and collects what a client shows: winners, bins, pages, and whole
lists of values, rules, dependencies, cells and scan hits. Only answers with an offset are cut.
Cell tables are cached by what they depend on and dropped in order of last use.
"""

from __future__ import annotations

import json
import math
import threading
from collections import OrderedDict
from collections.abc import Callable
from html import escape
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import capacity, cube, display, landscape, redundancy, rules, scan, screen, search, validation
from .spec import MAX_WIDTH, Rule, Target, base_rate, certificate, framed, ordered_columns, resolve_target, void_reason

CACHED_TABLES, CACHED_ANSWERS = 8, 16
#: Rows of a page, in answers that take an offset.
MOST_ROWS = 500
ROW = "_row"


class BadRequest(ValueError):
    """What a client must change."""


def plain(x: Any) -> Any:
    """Rows, arrays and NaN as JSON values."""
    if hasattr(x, "asDict"):
        return {k: plain(v) for k, v in x.asDict().items()}
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return None if isinstance(x, float) and math.isnan(x) else x


def listed(df: DataFrame) -> list[dict]:
    """All rows."""
    return [plain(r) for r in df.collect()]


class Job:
    """Work in the background, one at a time: state, progress, result."""

    def __init__(self, spark) -> None:
        self.spark, self.lock = spark, threading.Lock()
        self.state: dict[str, Any] = {"status": "idle"}
        self.group = f"job-{id(self)}"

    def start(self, work: Callable[[Callable[[int, int], None]], Any]) -> dict:
        with self.lock:
            if self.state["status"] == "running":
                return {**self.state, "accepted": False}
            self.state = {"status": "running", "done": 0, "of": 0}

        def progress(done: int, of: int) -> None:
            if self.state["status"] == "cancelled":
                raise InterruptedError
            self.state.update(done=done, of=of)

        def run() -> None:
            self.spark.sparkContext.setJobGroup(self.group, "background", True)
            try:
                result = work(progress)
                if self.state["status"] == "running":
                    self.state = {"status": "done", "result": result}
            except InterruptedError:
                pass
            except Exception as e:  # noqa: BLE001  the client polls for it
                if self.state["status"] == "running":
                    self.state = {"status": "failed", "error": str(e)}

        threading.Thread(target=run, daemon=True).start()
        return {**self.state, "accepted": True}

    def cancel(self) -> dict:
        with self.lock:
            if self.state["status"] == "running":
                self.state = {"status": "cancelled"}
                self.spark.sparkContext.cancelJobGroup(self.group)
            return self.state


class Service:
    """The engine over one table."""

    def __init__(self, df: DataFrame, translations: dict | None = None) -> None:
        self.df, self.names = df, translations or {"columns": {}, "values": {}}
        self.scan_job, self.validation = Job(df.sparkSession), Job(df.sparkSession)
        self._tables: OrderedDict[tuple, DataFrame] = OrderedDict()
        self._answers: OrderedDict[str, Any] = OrderedDict()
        self._pending: dict[str, threading.Event] = {}
        self._lock = threading.RLock()

    # parsing

    def _target(self, q: dict) -> Target:
        try:
            return resolve_target(self.df, q.get("column"), q.get("value"), [tuple(x) for x in q.get("also", [])])
        except ValueError as e:
            raise BadRequest(str(e)) from e

    def _rule(self, q: dict) -> Rule:
        try:
            return certificate(q.get("rule", "purity"), tau=float(q.get("tau", 0.9)), alpha=float(q.get("alpha", 0.05)), correction=q.get("correction"), min_rows=int(q.get("min_rows", 1)))
        except ValueError as e:
            raise BadRequest(str(e)) from e

    def _width(self, q: dict, default: int) -> int:
        widest = int(q.get("max_d", default))
        if not 1 <= widest <= MAX_WIDTH:
            raise BadRequest(f"max_d must lie between 1 and {MAX_WIDTH}")
        return widest

    def _frame(self, q: dict) -> tuple[DataFrame, list[str], Target]:
        target = self._target(q)
        drop = q.get("drop", [])
        if missing := [c for c in drop if c not in self.df.columns]:
            raise BadRequest(f"no such column: {missing}")
        frame = framed(self.df, target, drop, q.get("direction", "presence"))
        features = [c for c in frame.columns if c != "z"]
        if not features:
            raise BadRequest("no features are left")
        return frame, features, target

    def _cells(self, q: dict) -> tuple[DataFrame, DataFrame, list[str], Rule, float]:
        """The request's cell table, kept for later requests on the same target."""
        frame, features, _ = self._frame(q)
        rule, widest = self._rule(q), self._width(q, 3)
        _, _, share = base_rate(frame)
        if rule.correction == "family":
            keyed = frame.withColumn(ROW, F.monotonically_increasing_id())
            rule = rule.with_family(capacity.family_size(keyed, features, ROW, widest))
        exact = screen.exact_dependencies(frame.drop("z"), features) if q.get("prune") else None
        key = (json.dumps({k: q.get(k) for k in ("column", "value", "also", "drop", "direction", "prune")}, sort_keys=True), widest)
        with self._lock:
            if key not in self._tables:
                self._tables[key] = search.searched_cells(frame, features, widest, ordered=ordered_columns(frame), exact=exact).persist()
            self._tables.move_to_end(key)
            while len(self._tables) > CACHED_TABLES:
                self._tables.popitem(last=False)[1].unpersist()
            return self._tables[key], frame, features, rule, share

    def _scored(self, q: dict) -> tuple[DataFrame, dict, Rule]:
        cells, frame, _, rule, share = self._cells(q)
        return search.scores(cells, rule), {"base_rate": share, "void": void_reason(rule, share)}, rule

    # answers

    def columns(self, q: dict) -> dict:
        found: dict[str, list] = {}
        for r in screen.catalogue(self.df).orderBy("col", "place").collect():
            value = self.names["values"].get(r["value"], r["value"])
            found.setdefault(r["col"], []).append({"value": r["value"], "label": value, "n": r["n"], "share": r["share"]})
        return {"columns": [{"name": c, "label": display.humanised(c, self.names["columns"]), "values": found.get(c, [])} for c in self.df.columns]}

    def target(self, q: dict) -> dict:
        frame, features, target = self._frame(q)
        n, k, share = base_rate(frame)
        return {"columns": target.columns, "rows": n, "positives": k, "share": share, "features": features}

    def analyze(self, q: dict) -> dict:
        cells, frame, features, rule, share = self._cells(q)
        head = {"base_rate": share, "certificate": {"rule": rule.kind, "correction": rule.correction, "family": rule.family, "least_rows": rule.least_certifiable(rule.level(1)) if rule.kind == "certified" else 1}}
        if reason := void_reason(rule, share):
            return {**head, "void": reason, "branches": []}
        if q.get("features"):
            chosen = [list(q["features"])]
        else:
            chosen = [r["features"] for r in search.winners(search.scores(cells, rule)).orderBy("d").collect()]
        out = []
        for schema in chosen:
            one = plain(search.report(frame, schema, rule, ordered_columns(frame)).first())
            view = display.slices(frame, schema, rule) if len(schema) == 4 else display.grid(frame, schema, rule)
            out.append({**one, "prefixes": listed(search.prefix_series(frame, schema, rule, ordered_columns(frame)).orderBy("d").select("d", "features", "coverage", "n_centers")), "cells": listed(view.orderBy(F.desc("k"), "cell"))})
        return {**head, "void": None, "branches": out}

    def landscape(self, q: dict) -> dict:
        scored, head, _ = self._scored(q)
        return {**head, "bins": listed(landscape.histogram(scored, q.get("direction", "presence")).orderBy("d", "ix", "iy"))}

    def landscape_cell(self, q: dict) -> dict:
        scored, head, _ = self._scored(q)
        found = landscape.cell(scored, int(q["d"]), int(q["ix"]), int(q["iy"]), int(q.get("offset", 0)), min(MOST_ROWS, int(q.get("limit", 50))), q.get("direction", "presence"))
        return {**head, "schemas": listed(found)}

    def frontier(self, q: dict) -> dict:
        scored, head, _ = self._scored(q)
        return {**head, "frontier": listed(landscape.frontier(scored, q.get("cost", "centers"), q.get("direction", "presence")).orderBy("d", "cost"))}

    def curves(self, q: dict) -> dict:
        cells, _, _, rule, share = self._cells(q)
        curve = landscape.curves(cells, rule, share, int(q.get("step", 5)), q.get("direction", "presence"), q.get("exclude", [])).persist()
        out = {"base_rate": share, "curves": listed(curve.orderBy("d", "tau")), "leaders": listed(landscape.leaders(curve).orderBy("tau_from")), "changes": listed(landscape.winner_changes(curve).orderBy("d", "tau"))}
        curve.unpersist()
        return out

    def at(self, q: dict) -> dict:
        scored, head, _ = self._scored(q)
        return {**head, "schemas": listed(landscape.by_x(scored, int(q["d"]), int(q["ix"]), int(q.get("offset", 0)), min(MOST_ROWS, int(q.get("limit", 50)))))}

    def screen(self, q: dict) -> dict:
        _, features, target = self._frame(q)
        out = {"profiles": listed(screen.profiles(self.df, features).orderBy("col")), "dependencies": listed(screen.dependencies(self.df.select(*features)))}
        if target.value is not None:
            out["leakage"] = listed(screen.leakage(self.df, target, features))
        return out

    def rules(self, q: dict) -> dict:
        frame, features, _ = self._frame(q)
        wanted = [tuple(s) for s in q.get("schemas", [])] or cube.schemas(features, 2)
        if len(wanted) > rules.MOST_SCHEMAS:
            raise BadRequest(f"at most {rules.MOST_SCHEMAS} schemas")
        found = rules.enumerate_rules(frame, wanted, int(q.get("min_rows", 1))).persist()
        held = rules.holding(found, [tuple(c) for c in q.get("conditions", [])], q.get("widths"))
        out = {"rules": listed(held), "facets": listed(rules.facets(held)), "bars": listed(rules.bars(held))}
        found.unpersist()
        return out

    def centers(self, q: dict) -> dict:
        frame, features, _ = self._frame(q)
        rule = self._rule({**q, "correction": q.get("correction", "bonferroni")})
        keyed = frame.withColumn(ROW, F.monotonically_increasing_id()).persist()
        named, sets, members = (x.persist() for x in redundancy.collect(keyed, features, rule, ROW, self._width(q, 2), ordered_columns(frame)))
        pairs = redundancy.similar(sets, members).persist()
        grouped = redundancy.groups(sets, pairs, float(q.get("at", redundancy.GROUP_AT)))
        if "leader" in q:
            out = {"members": listed(redundancy.detail(grouped, sets, pairs, int(q["leader"]), keyed.count()))}
        elif "schema_id" in q:
            out = {"alternatives": listed(redundancy.alternatives(named, sets, pairs, int(q["schema_id"])).orderBy("a", "place"))}
        else:
            table = redundancy.group_table(sets, grouped, members, named)
            out = {"groups": listed(redundancy.page(table, q.get("sort", "coverage"), int(q.get("offset", 0)), min(MOST_ROWS, int(q.get("limit", 50))))), "nearest": listed(redundancy.histogram(redundancy.nearest(sets, pairs)))}
        for x in (keyed, named, sets, members, pairs):
            x.unpersist()
        return out

    def validate(self, q: dict) -> dict:
        frame, features, _ = self._frame(q)
        rule, widest = self._rule({**q, "correction": "bonferroni"}), self._width(q, 2)

        def work(progress: Callable[[int, int], None]) -> dict:
            keyed = frame.withColumn(ROW, F.xxhash64(*features, F.monotonically_increasing_id())).persist()
            progress(0, 2)
            split = listed(validation.certify_split(validation.halves(keyed, ROW).drop(ROW), features, rule, widest, ordered=ordered_columns(frame)))
            progress(1, 2)
            inner = validation.nested(validation.folds(keyed, ROW, 5, int(q.get("repeats", 1))), features, rule, widest, q.get("encoding", "train"), ordered_columns(frame)).persist()
            out = {"split": split, "nested": listed(inner.groupBy("d").agg(F.avg("coverage").alias("coverage"), F.count("*").alias("passes")).orderBy("d")), "stability": listed(validation.stability(inner).orderBy("d"))}
            progress(2, 2)
            keyed.unpersist()
            return out

        return self.validation.start(work)

    def scan_start(self, q: dict) -> dict:
        drop = q.get("drop", [])
        if missing := [c for c in drop if c not in self.df.columns]:
            raise BadRequest(f"no such column: {missing}")  # before the job counts as running
        rule = self._rule(q)
        columns, widest = [c for c in self.df.columns if c not in drop], self._width(q, 2)
        return self.scan_job.start(lambda progress: listed(scan.scan(self.df, columns, rule, widest, float(q.get("threshold", 0.2)), float(q.get("q", 0.05)), ordered_columns(self.df.select(*columns)))))

    ROUTES = {
        "/api/columns": "columns", "/api/target": "target", "/api/analyze": "analyze", "/api/landscape": "landscape", "/api/landscape/cell": "landscape_cell",
        "/api/landscape/frontier": "frontier", "/api/landscape/curves": "curves", "/api/landscape/at": "at", "/api/screen": "screen", "/api/rules": "rules",
        "/api/centers/groups": "centers", "/api/centers/group": "centers", "/api/centers/branch": "centers", "/api/validate": "validate", "/api/scan/start": "scan_start",
    }
    #: Answers that depend on the table and the request alone.
    KEPT = frozenset({"columns", "target", "analyze", "landscape", "landscape_cell", "frontier", "curves", "at", "screen", "rules", "centers"})

    def handle(self, path: str, q: dict) -> tuple[int, dict]:
        if path == "/api/scan/status":
            return 200, self.scan_job.state
        if path == "/api/validate/status":
            return 200, self.validation.state
        if path == "/api/scan/cancel":
            return 200, self.scan_job.cancel()
        name = self.ROUTES.get(path)
        if name is None:
            return 404, {"error": f"no such path: {path}"}
        key = f"{name} {json.dumps(q, sort_keys=True)}"
        while True:
            with self._lock:
                if key in self._answers:
                    self._answers.move_to_end(key)
                    return 200, self._answers[key]
                other = self._pending.get(key)
                if other is None or name not in self.KEPT:
                    self._pending[key] = mine = threading.Event()
                    break
            other.wait()  # the same request is being answered
        try:
            return self._answered(name, key, q)
        finally:
            with self._lock:
                self._pending.pop(key, None)
            mine.set()

    def _answered(self, name: str, key: str, q: dict) -> tuple[int, dict]:
        try:
            answer = getattr(self, name)(q)
        except (BadRequest, KeyError, TypeError, ValueError) as e:
            return 400, {"error": str(e)}
        if name in self.KEPT:
            with self._lock:
                self._answers[key] = answer
                while len(self._answers) > CACHED_ANSWERS:
                    self._answers.popitem(last=False)
        return 200, answer


def build_server(df: DataFrame, host: str = "127.0.0.1", port: int = 0, translations: dict | None = None) -> ThreadingHTTPServer:
    service = Service(df, translations)

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: bytes, kind: str = "application/json") -> None:
            self.send_response(status)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def _answer(self, q: dict) -> None:
            status, answer = service.handle(self.path.split("?")[0], q)
            self._send(status, json.dumps(answer).encode())

        def do_GET(self) -> None:  # noqa: N802
            if self.path == "/":
                self._send(200, PAGE.format(title="Patterns", data="null").encode(), "text/html")
            else:
                self._answer({})

        def do_POST(self) -> None:  # noqa: N802
            try:
                q = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}")
            except ValueError:
                self._send(400, b'{"error": "the body is no JSON"}')
                return
            self._answer(q)

        def log_message(self, *args: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


PAGE = '<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title></head><body><h1>{title}</h1><pre id="out"></pre><script>const data = {data};\ndocument.getElementById("out").textContent = JSON.stringify(data, null, 1);</script></body></html>'


def export_html(df: DataFrame, path: str, request: dict, title: str = "Patterns") -> str:
    """A page with the answers to one request inlined, so that it needs no server."""
    service = Service(df)
    data = {name: getattr(service, name)(request) for name in ("target", "analyze", "landscape", "curves", "screen")}
    # "</" would end the script element
    text = PAGE.format(title=escape(title), data=json.dumps(data).replace("</", "<\\/"))
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path
