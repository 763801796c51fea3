"""Serving surfaces over one knowledge table: a command line, request handlers and an HTTP server, and tool functions."""

from __future__ import annotations

import argparse
import json
import sys
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, fusion, graph
from ..session import session, ship
from ..storage import Snapshots, drop
from ..streaming.incremental import Target
from . import ingest, search

REVIEWS = "id bigint, action string, at timestamp"
MODES = ("auto", *fusion.MODES)


class Knowledge:
    """The chunk table at a path, its graph and its review log."""

    def __init__(self, spark: SparkSession, path: str, gate: float = 0.0):
        ship(spark)
        self.spark, self.path, self.gate = spark, path, gate
        self.reviews = Snapshots(spark, f"{path}/reviews", REVIEWS)

    def update(self, root: str, force: bool = False) -> dict[str, int]:
        return ingest.update(self.spark, root, self.path, force)

    def chunks(self) -> DataFrame:
        return ingest.chunks(self.spark, self.path)

    def graph(self) -> tuple[DataFrame, DataFrame]:
        log = self.reviews.read()
        return tuple(graph.overlay(df, log) for df in ingest.graph(self.chunks(), self.gate))

    def search(self, query: str, limit: int = 5, mode: str = "hybrid", **options) -> list[dict]:
        if mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        q = self.spark.createDataFrame([(1, query, mode)], "query_id bigint, query string, mode string")
        nodes, edges = self.graph() if mode in ("auto", "hybrid", "graph") else (None, None)
        hits = search.search(q, search.Corpus(self.chunks(), nodes, edges), search.Options(limit=limit, **options))
        return [r.asDict() for r in hits.orderBy("rank").collect()]

    def trace(self, query: str, limit: int = 5) -> dict:
        q = self.spark.createDataFrame([(1, query)], "query_id bigint, query string")
        counts, hits = search.trace(q, search.Corpus(self.chunks(), *self.graph()), search.Options(limit=limit))
        return {"candidates": {r.strategy: r.candidates for r in counts.collect()}, "hits": [r.asDict() for r in hits.orderBy("rank").collect()]}

    def lineage(self, file_path: str) -> list[dict]:
        return [r.asDict() for r in search.lineage(self.chunks(), file_path).collect()]

    def sources(self) -> list[dict]:
        return [r.asDict() for r in search.inventory(self.chunks()).orderBy("file_path").collect()]

    def neighbours(self, name: str, limit: int = 10) -> list[dict]:
        names = self.spark.createDataFrame([(1, name)], "query_id bigint, name string")
        return [r.asDict() for r in graph.neighbourhood(names, *self.graph(), limit).orderBy("rank").collect()]

    def concepts(self, prefix: str | None = None, limit: int = 20) -> list[dict]:
        return [r.asDict() for r in graph.concepts(*self.graph(), prefix, limit).orderBy(F.desc("confidence"), "name").collect()]

    def pending(self) -> dict[str, list[dict]]:
        nodes, edges = graph.pending(*ingest.graph(self.chunks(), self.gate), self.reviews.read())
        return {"entities": [r.asDict() for r in nodes.select("id", "name", "type", "confidence").collect()], "relations": [r.asDict() for r in edges.select("id", "subject", "predicate", "object", "confidence").collect()]}

    def review(self, action: str, ids: list[int] | None = None) -> int:
        """Approve or reject pending facts: all of them for None, none for an empty list."""
        if action not in ("approve", "reject"):
            raise ValueError("action is approve or reject")
        waiting = [x["id"] for part in self.pending().values() for x in part if ids is None or x["id"] in ids]
        if waiting:
            frame = self.spark.createDataFrame([(i,) for i in waiting], "id bigint")
            self.reviews.commit(graph.review(self.reviews.read(), None, action, frame, F.current_timestamp()))
        return len(waiting)

    def drop(self, file_path: str | None = None) -> None:
        """Forget a file, or the whole table."""
        if file_path is None:
            drop(self.spark, self.path)
        else:
            Target(self.spark, self.path, ingest.COLUMNS).drop_source(file_path)

    def evaluate(self, cases: list[dict], k: int = 5) -> dict[str, float]:
        """Mean metrics of gold cases, in one job."""
        frame = evaluate.cases_frame(self.spark, cases)
        q = frame.select(F.col("case_id").alias("query_id"), "query", "mode")
        hits = search.search(q, search.Corpus(self.chunks(), *self.graph()), search.Options(limit=k))
        found = hits.select(F.col("query_id").alias("case_id"), "rank", evaluate.basename(F.col("file_path")).alias("item"))
        rel = frame.select("case_id", F.explode("relevant_files").alias("f")).select("case_id", evaluate.basename(F.col("f")).alias("item"))
        return {m: v for m, v in evaluate.means(evaluate.case_metrics(found, rel, k)).first().asDict().items() if m != "cases"}


def handle(k: Knowledge, method: str, url: str, body: bytes = b"") -> tuple[int, object]:
    """Answer a request: (status, JSON value). Ids travel as text, as they exceed what JSON numbers hold exactly."""
    at = urlsplit(url)
    args = {key: v[-1] for key, v in parse_qs(at.query).items()}
    if body:
        try:
            args |= json.loads(body)
        except ValueError:
            return 400, {"error": "the body is not JSON"}
    try:
        limit = min(50, max(1, int(args.get("limit", 5))))
        if at.path == "/health":
            return 200, {"status": "ok"}
        if at.path in ("/search", "/trace"):
            if not str(args.get("query", args.get("q", ""))).strip():
                return 400, {"error": "query is needed"}
            query = str(args.get("query", args.get("q")))
            return 200, _texts({"results": k.search(query, limit, args.get("mode", "hybrid"))} if at.path == "/search" else k.trace(query, limit))
        if at.path == "/lineage":
            return (200, _texts(k.lineage(args["file"]))) if args.get("file") else (400, {"error": "file is needed"})
        if at.path == "/pending" and method == "GET":
            return 200, _texts(k.pending())
        if at.path.startswith("/pending/") and method == "POST":
            ids = args.get("ids")
            return 200, {"changed": k.review(at.path.rsplit("/", 1)[1], None if ids is None else [int(i) for i in ids])}
    except ValueError as e:
        return 400, {"error": str(e)}
    return 404, {"error": "no such path"}


def _texts(value):
    if isinstance(value, dict):
        return {key: str(v) if (key == "id" or key.endswith("_id")) and v is not None else _texts(v) for key, v in value.items()}
    return [_texts(v) for v in value] if isinstance(value, list) else value


def server(k: Knowledge, port: int = 8000) -> HTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            status, value = handle(k, self.command, self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            data = json.dumps(value).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _answer

        def log_message(self, *args) -> None:
            pass

    return HTTPServer(("127.0.0.1", port), Handler)


def tools(k: Knowledge) -> dict:
    """Functions for tool-calling protocols, by name."""
    return {"search_knowledge": k.search, "get_file_lineage": k.lineage, "list_concepts": k.concepts, "traverse_graph": k.neighbours}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="fathomer")
    p.add_argument("--table", default="fathomer-table")
    sub = p.add_subparsers(dest="command", required=True)
    for name, options in {"update": ["root"], "search": ["query"], "eval": ["cases"], "ls": [], "show": ["file"], "drop": ["--file"], "graph": ["name"], "review": ["action"], "serve": []}.items():
        s = sub.add_parser(name)
        for o in options:
            s.add_argument(o)
        if name == "search":
            s.add_argument("--limit", type=int, default=5)
            s.add_argument("--mode", default="hybrid", choices=MODES)
        if name == "update":
            s.add_argument("--force", action="store_true")
        if name == "serve":
            s.add_argument("--port", type=int, default=8000)
    a = p.parse_args(argv)
    k = Knowledge(spark or session(), a.table)
    if a.command == "serve":
        server(k, a.port).serve_forever()
    out = {
        "update": lambda: k.update(a.root, a.force),
        "search": lambda: k.search(a.query, a.limit, a.mode),
        "eval": lambda: k.evaluate(evaluate.load_cases(open(a.cases).read())),
        "ls": k.sources,
        "show": lambda: k.lineage(a.file),
        "drop": lambda: k.drop(a.file),
        "graph": lambda: k.neighbours(a.name),
        "review": lambda: k.review(a.action),
    }[a.command]()
    print(json.dumps(_texts(out), default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
