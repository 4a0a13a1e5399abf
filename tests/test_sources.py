import json

from pyspark.sql import functions as F

from graphloom.operators import graph
from graphloom.sources import extract, files
from graphloom.streaming import events

TREE = {
    "src/util.ts": "/** Helps. */\nexport function helper(a: number): number {\n  return a;\n}\n",
    "src/main.ts": 'import { helper } from "./util";\nexport const LIMIT = 3;\nexport class App extends Base implements Runs {\n  async start(): Promise<void> {\n    run();\n  }\n}\nexport function run() {\n  helper(1); // helper(2) {\n  return new Widget("}");\n}\nclass Widget {}\n',
    "pkg/mod.py": 'import os\nfrom . import sub\nMAX = 1\nclass A(Base):\n    """Doc."""\n    async def go(self):\n        B()\n        helper()\ndef _hidden():\n    return 1\n',
    "pkg/broken.py": "def good():\n    pass\ndef bad(:\n",
    "lib.rs": "pub struct Point { x: i32 }\nimpl Draw for Point {\n    fn draw(&self) { paint(); }\n}\npub trait Draw { }\nuse std::fmt;\n",
    "app.js": 'app.get("/health", healthHandler);\nfunction healthHandler(req) {}\n',
    "node_modules/x.js": "function no() {}",
    "package.json": json.dumps({"dependencies": {"react": "^17"}, "devDependencies": {"vite": "5"}, "scripts": {"test": "x"}}),
}


def tree(spark, tmp_path):
    for name, text in TREE.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return files.scan(spark, str(tmp_path), files.SOURCE_EXTENSIONS + ("json",))


def test_scan_and_build(spark, tmp_path):
    rows = tree(spark, tmp_path)
    assert {r["path"] for r in rows.collect()} == set(TREE) - {"node_modules/x.js"}
    assert {tuple(r) for r in files.manifest(rows).collect()} == {("react", "^17"), ("vite", "5")}
    assert [r[0] for r in files.scripts(rows).collect()] == ["test"]
    assert {tuple(r) for r in files.folders(rows).select("folder", "n").collect()} == {("src", 2), ("pkg", 2)}
    nodes, edges, refs = extract.build(rows.filter("language != 'unknown'"))
    n = {(r["file_path"], r["kind"], r["name"]): r for r in nodes.collect()}
    for want in (
        ("src/util.ts", "function", "helper"), ("src/main.ts", "class", "App"), ("src/main.ts", "method", "start"), ("src/main.ts", "function", "run"),
        ("src/main.ts", "constant", "LIMIT"), ("pkg/mod.py", "class", "A"), ("pkg/mod.py", "method", "go"), ("pkg/mod.py", "constant", "MAX"),
        ("pkg/mod.py", "function", "_hidden"), ("pkg/broken.py", "function", "good"), ("lib.rs", "class", "Point"), ("lib.rs", "method", "draw"), ("lib.rs", "interface", "Draw"),
    ):
        assert want in n, want
    assert n["src/main.ts", "function", "run"]["is_exported"] and not n["pkg/mod.py", "function", "_hidden"]["is_exported"]
    assert n["pkg/mod.py", "method", "go"]["is_async"] and n["pkg/mod.py", "class", "A"]["docstring"] == "Doc."
    name = {r["id"]: r["name"] for r in nodes.collect()}
    e = {(name[r["source"]], name[r["target"]], r["kind"]) for r in edges.collect()}
    assert {("run", "helper", "calls"), ("start", "run", "calls"), ("run", "Widget", "instantiates"), ("Point", "Draw", "implements"), ("src/main.ts", "src/util.ts", "imports")} <= e
    impacted = graph.impact(edges, nodes.filter("name = 'helper'").select("id"), 2).join(nodes, "id")
    assert {(r["name"], r["depth"]) for r in impacted.collect()} >= {("run", 1), ("start", 2)}
    assert [tuple(r) for r in extract.routes(rows).select("method", "route", "handler").collect()] == [("get", "/health", "healthHandler")]


def test_source_range(spark):
    f = spark.createDataFrame([("a", "1\n2\n3\n4")], "path string, text string")
    r = spark.createDataFrame([("a", 2, 4)], "path string, start_line int, end_line int")
    assert tuple(files.source_range(f, r, 2).select("source", "truncated").first()) == ("2\n3", True)
    assert tuple(files.source_range(f, r, 0).select("source", "truncated").first()) == ("2\n3\n4", False)


def test_commit_age(spark):
    c = spark.createDataFrame([(1, "2026-01-01", ["a", "b"]), (2, "2026-01-03", ["b"])], "id int, t string, files array<string>").withColumn("at", F.col("t").cast("timestamp"))
    got = {r["file"]: (r["days"], r["commits"]) for r in files.commit_age(c, F.lit("2026-01-11").cast("timestamp")).collect()}
    assert got == {"a": (10, 1), "b": (8, 0)}


def test_stream_equals_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    events.run_available(events.deduplicated(events.read(spark, src + "*")), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(src).count()
    events.run_available(events.tumbling(events.read(spark, src + "*")), str(tmp_path / "out2"), str(tmp_path / "ck2"))
    batch = spark.read.parquet(src).groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("start"), "event_type").agg(F.count("*").alias("n"))
    got = spark.read.parquet(str(tmp_path / "out2")).select("start", "event_type", "n")
    assert got.count() > 100 and got.exceptAll(batch).count() == 0
