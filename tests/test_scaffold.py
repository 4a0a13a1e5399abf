import json

from pyspark.sql import functions as F

from graphloom.functions.text import escapes_root, glob_regex
from graphloom.operators import drift, evaluate, grounding, scaffold
from graphloom.sources import extract, files as sources

ROUTER = """---
last_updated: 2026-01-01
edges:
  - target: context/stack.md
  - target: src/a.py
  - target: context/none.md
---
See `src/a.py`, `src/lost.py`, `@acme/ui/button`, `https://x.org/y.md` and [gone](lost.md). TODO
Run `npm run build` and `npm run nothing`.
"""
STACK = """---
last_updated: 2026-02-27
---
# Stack
**React 18**, **Lodash** and `src/ignored.py`
"""
TREE = {
    "package.json": json.dumps({"scripts": {"build": "x", "hidden": "y"}, "dependencies": {"react": "^17.0.0"}, "workspaces": ["packages/*"]}),
    "packages/ui/package.json": '{"name": "@acme/ui"}',
    "other/ui/package.json": '{"name": "@acme/other"}',
    "src/a.py": "", "CLAUDE.md": "one", "AGENTS.md": "two", "yarn.lock": "", "vite.config.js": "", "jest.config.js": "", "vitest.config.ts": "",
    "scaffold/ROUTER.md": ROUTER, "scaffold/context/stack.md": STACK, "scaffold/context/deep/x.md": "FIXME", "scaffold/patterns/.hidden.md": "FIXME",
    "scaffold/patterns/INDEX.md": "[a](a.md#x) `gone.md` <!-- `b.md` --> [s](../context/stack.md)", "scaffold/patterns/a.md": "", "scaffold/patterns/b.md": "",
    "memory/.last-cleanup.json": '{"lastCleanup": "2026-02-01T00:00:00Z"}', "memory/2026-02-01.md": "", "memory/2026-02-27.md": "", "memory/x.md": "",
}
NOW = "2026-03-01"


def tree(spark, more=()):
    return spark.createDataFrame([*TREE.items(), *more], "path string, text string")


def now():
    return F.lit(NOW).cast("timestamp")


def test_globs(spark):
    for pattern, path, want in (
        ("context/*.md", "context/a.md", True), ("context/*.md", "context/a/b.md", False), ("context/*.md", "context/.a.md", False), ("**/x+y.md", "a/b/x+y.md", True),
        ("**/x+y.md", "x+y.md", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("packages/**", "packages/a/b", True), ("a.md", "axmd", False),
    ):
        assert spark.range(1).select(F.regexp_like(F.lit(path), glob_regex(F.lit(pattern)))).first()[0] is want, (pattern, path)


def test_paths_that_escape(spark):
    for path, want in (("a/../b", False), ("../b", True), ("a/../../b/c", True), ("/a", True), ("./a//b", False), ("..", True), ("", False)):
        assert spark.range(1).select(escapes_root(F.lit(path))).first()[0] is want, path
    asked = spark.createDataFrame([("ROUTER.md",), ("../package.json",), ("context/../none.md",)], "file string")
    got = {r["file"]: (r["status"], r["text"]) for r in scaffold.read_files(tree(spark), asked).collect()}
    assert got == {"ROUTER.md": ("ok", ROUTER), "../package.json": ("escapes", None), "context/../none.md": ("missing", None)}


def test_whole_check(spark):
    issues, claims = scaffold.run(tree(spark), now())
    got = {(r["checker"], r["code"], r["severity"], r["file"], r["message"]) for r in issues.collect()}
    router = "scaffold/ROUTER.md"
    assert got == {
        ("edges", "DEAD_EDGE", "error", router, "no such document: context/none.md"),
        ("staleness", "STALE_FILE", "warning", router, "59 days since last update"),
        ("paths", "MISSING_PATH", "error", router, "no such path: src/lost.py"),
        ("commands", "DEAD_COMMAND", "error", router, "npm run nothing"),
        ("dependencies", "DEPENDENCY_MISSING", "warning", "scaffold/context/stack.md", "Lodash"),
        ("dependencies", "VERSION_MISMATCH", "warning", "scaffold/context/stack.md", "React 18"),
        ("index-sync", "INDEX_MISSING_ENTRY", "warning", "patterns/INDEX.md", "b.md"),
        ("index-sync", "INDEX_ORPHAN_ENTRY", "warning", "patterns/INDEX.md", "gone.md"),
        ("script-coverage", "UNDOCUMENTED_SCRIPT", "warning", "package.json", "hidden"),
        ("tool-config-sync", "TOOL_CONFIG_DRIFT", "warning", "AGENTS.md", "not equal to the first tool config"),
        ("todo-fixme", "TODO_FIXME", "warning", router, "TODO"),
        ("broken-link", "BROKEN_LINK", "error", router, "lost.md"),
    }
    counts = {(r["what"], r["name"]): r["n"] for r in scaffold.counts(issues, claims).collect()}
    assert counts["issues", "dependencies"] == 2 and counts["issues", "grounding"] == 0 and counts["claims", "dependency"] == 2
    assert drift.score(issues).first()["score"] == 100 - 4 * 10 - 8 * 3
    targets = {r["file"]: [i["code"] for i in r["issues"]] for r in scaffold.repair_targets(scaffold.in_order(issues)).collect()}
    assert targets == {router: ["DEAD_EDGE", "STALE_FILE", "MISSING_PATH", "DEAD_COMMAND", "TODO_FIXME", "BROKEN_LINK"]}
    assert scaffold.repair_targets(scaffold.in_order(issues), warnings=True).count() == 5


def test_check_of_an_empty_project(spark):
    issues, claims = scaffold.run(tree(spark).limit(0), now())
    assert issues.count() == 0 and claims.count() == 0 and drift.score(issues).first()["score"] == 100


def test_heartbeat_parts(spark):
    t = tree(spark)
    assert {r["key"]: str(r["last_updated"])[:10] for r in scaffold.heartbeat_files(t).collect() if r["last_updated"]} == {"scaffold/ROUTER.md": "2026-01-01", "scaffold/context/stack.md": "2026-02-27"}
    assert [tuple(r) for r in scaffold.old_memory(t, now()).collect()] == [("memory/2026-02-01.md", 28)]
    assert scaffold.cleanup_due(t, now()).first()["due"] is True and scaffold.cleanup_due(t.limit(0), now()).first()["due"] is False


def test_tools_and_workspaces(spark):
    t = tree(spark)
    assert {r["category"]: r["tool"] for r in sources.tooling(t).collect()} == {"test_runner": "vitest", "build_tool": "vite", "package_manager": "yarn"}
    assert [tuple(r) for r in sources.workspace_names(t).collect()] == [("packages/ui", "@acme/ui")]
    pnpm = spark.createDataFrame([("pnpm-workspace.yaml", "packages:\n  - 'other/*/'\n  - \"!x\"\n"), ("package.json", "{}"), ("other/ui/package.json", '{"name": "o"}')], "path string, text string")
    assert [r["name"] for r in sources.workspace_names(pnpm).collect()] == ["o"]


def test_thresholds():
    assert scaffold.thresholds(None) == scaffold.thresholds("[1") == scaffold.thresholds('{"staleness": 3}') == drift.STALE
    assert scaffold.thresholds('{"staleness": {"warnDays": 5, "errorDays": "x"}}') == drift.STALE | {"warn_days": 5}
    assert scaffold.thresholds('{"staleness": {"warnDays": 100}}') == drift.STALE


def test_variant_means(spark):
    runs = spark.createDataFrame([("a", 4.0), ("a", 2.0), ("b", 1.0), ("c", None)], "variant string, cost double")
    assert [tuple(r) for r in evaluate.variant_means(runs, ["cost"], "cost").orderBy("place").collect()] == [("b", 1, 1.0, 1), ("a", 2, 3.0, 2), ("c", 1, None, 3)]


BODY = "def {0}(rows, limit):\n    total = 0\n    for row in rows:\n        if row.value > limit:\n            total += row.value * 2\n        else:\n            total -= helper(row)\n    return [total, limit, 'x']\n"


def graph_of(spark, *named):
    rows = spark.createDataFrame([(p, t, "python") for p, t in named], "path string, text string, language string")
    n, e, _ = extract.build(rows)
    return n, grounding.code_prints(n, e, extract.leaves(rows))


def test_renamed_code_is_found_again_and_documents_follow(spark):
    helper = ("h.py", "def helper(row):\n    return row\n")
    n0, prints0 = graph_of(spark, ("a.py", BODY.format("work")), helper)
    n1, prints1 = graph_of(spark, ("b.py", BODY.format("labour")), helper)
    old, new = (n.filter(f"name = '{x}'").first()["id"] for n, x in ((n0, "work"), (n1, "labour")))
    by_id = {r["id"]: r for r in prints0.collect()}
    assert by_id[old]["token_count"] > 30 and len(by_id[old]["neighbors"]) == 1
    same = {r["id"]: r["minhash"] for r in prints1.collect()}
    assert same[new] == by_id[old]["minhash"]

    text = grounding.serialized(prints0).filter(F.col("id") == old).first()["fingerprint"]
    doc = f"---\ngrounds_to:\n  - node: {old}\n    fingerprint: {text}\n---\n[w](node://{old}) [v](node://{old}0)\n"
    docs = spark.createDataFrame([("d.md", doc), ("e.md", "plain")], "source string, text string")
    groundings = spark.createDataFrame([("d.md", old, text)], "file string, node_id string, fingerprint string")
    anchors = spark.createDataFrame([("d.md", old), ("d.md", old + "0")], "file string, node_id string")
    asked = grounding.wanted(groundings, anchors)
    first = grounding.capture(asked, n0, grounding.serialized(prints0))
    assert {(r["node_id"], r["state"]) for r in first.collect()} == {(old, "captured"), (old + "0", "unavailable")}
    baselines = first.filter("state = 'captured'").drop("state")

    found = grounding.verdicts(grounding.lost(asked, n1, baselines), prints1)
    assert [(r["id"], r["verdict"], r["node_id"]) for r in found.collect()] == [(old, "MOVED", new)]
    assert {(r["code"], r["message"]) for r in grounding.anchor_issues(anchors, n1, found).collect()} == {("GROUNDING_DRIFT", f"{old} -> {new}"), ("GROUNDING_GONE", old + "0")}
    assert grounding.grounding_issues(asked, n1, baselines, found).count() == 0

    now_ = grounding.serialized(prints1)
    moved = grounding.moves(asked, n1, found, now_)
    fresh = now_.filter(F.col("id") == new).first()["fingerprint"]
    assert [tuple(r) for r in moved.collect()] == [("d.md", old, new, fresh)]
    back = grounding.rebind(baselines, moved, n1)
    assert [(r["file"], r["node_id"], r["fingerprint"]) for r in back.collect()] == [("d.md", new, fresh)]
    texts = {r["source"]: r["text"] for r in grounding.rewrite(docs, moved).collect()}
    assert texts == {"d.md": f"---\ngrounds_to:\n  - node: {new}\n    fingerprint: {fresh}\n---\n[w](node://{new}) [v](node://{old}0)\n", "e.md": "plain"}


def test_changed_and_lost_bodies(spark):
    n, prints = graph_of(spark, ("a.py", BODY.format("work")))
    node = n.filter("name = 'work'").first()
    s = grounding.serialized(prints).first()["fingerprint"]
    asked = grounding.wanted(spark.createDataFrame([("d", node["id"], s), ("d", "function:none", s), ("d", "function:dark", "?")], "file string, node_id string, fingerprint string"), spark.createDataFrame([], "file string, node_id string"))
    baselines = spark.createDataFrame([("d", node["id"], "other", s)], "file string, node_id string, body_hash string, fingerprint string")
    found = grounding.verdicts(grounding.lost(asked, n, baselines), prints.limit(0))
    got = {(r["code"], r["severity"], r["message"]) for r in grounding.grounding_issues(asked, n, baselines, found).collect()}
    assert got == {("GROUNDING_DRIFT", "warning", node["id"]), ("GROUNDING_GONE", "error", "function:none")}
    kept = grounding.upsert_prints(prints, prints.withColumn("token_count", F.lit(1).cast("long")))
    assert kept.count() == prints.count() and {r["token_count"] for r in kept.collect()} == {1}
