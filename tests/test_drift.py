from pyspark.sql import functions as F

from graphloom.operators import drift, evaluate, events, identity
from graphloom.sources import documents


def issues(spark, *rows):
    return spark.createDataFrame([(s, f, c) for s, f, c in rows], "severity string, file string, code string")


def test_score(spark):
    assert drift.score(issues(spark)).first()[0] == 100
    assert drift.score(issues(spark, ("error", "a", "X"), ("warning", "a", "X"), ("info", "b", "X"))).first()[0] == 86
    assert drift.score(issues(spark, *[("error", "a", "X")] * 12)).first()[0] == 0


def test_issues_of_error_files_and_groundings(spark):
    rows = issues(spark, ("error", "a", "X"), ("info", "a", "Y"), ("info", "b", "Y"), ("warning", "c", "GROUNDING_DRIFT"))
    assert {(r["file"], r["code"]) for r in drift.in_error_files(rows).collect()} == {("a", "X"), ("a", "Y"), ("c", "GROUNDING_DRIFT")}


def test_staleness_is_inclusive_and_one_issue(spark):
    f = spark.createDataFrame([("a", 29, 49, None), ("b", 30, 0, None), ("c", 90, 200, 1), ("d", None, None, 90), ("e", None, None, None)], "file string, days int, commits int, updated_days int")
    got = {r["file"]: (r["severity"], r["message"]) for r in drift.staleness(f).collect()}
    assert got == {"b": ("warning", "30 days since last change"), "c": ("error", "90 days since last change; 200 commits since last change"), "d": ("error", "90 days since last update")}


DOC = """---
edges:
  - target: context/other.md
    condition: always
grounds_to:
  - node: function:1
    fingerprint: mh:64:00
---
# Stack
Run from `src/index.ts`, not `patterns/<name>.md`, `/voice/incoming`, `a = b/c`, `*_x.py` or `GET /api/x`.
**React 18** and **Lodash**, **Vue ^3**
## Do not use
`lib/old.py` and `npm run gone`
```
make all
[dead](x.md)
```
See [it](./guide.md#top "t"), `[no](y.md)`, [web](https://x.org), [node](node://function%3A1).
"""


def docs(spark, text=DOC):
    return spark.createDataFrame([("ROUTER.md", text)], "source string, text string")


def test_claims(spark):
    got = {(r["kind"], r["value"], r["negated"]) for r in documents.claims(docs(spark)).collect()}
    assert got == {
        ("path", "src/index.ts", False), ("dependency", "React", False), ("version", "React 18", False), ("dependency", "Lodash", False),
        ("dependency", "Vue", False), ("version", "Vue ^3", False), ("path", "lib/old.py", True), ("command", "npm run gone", True), ("command", "make all", True),
    }
    # a sign before the number other than v is claimed, and then not understood
    assert {r["dep"] for r in drift.versions(documents.claims(docs(spark))).collect()} == {"react"}


def test_front_matter_links_and_anchors(spark):
    d = docs(spark)
    assert [tuple(r) for r in documents.front_edges(d).collect()] == [("ROUTER.md", "context/other.md")]
    assert [tuple(r) for r in documents.groundings(d).collect()] == [("ROUTER.md", "function:1", "mh:64:00")]
    assert {r["target"] for r in documents.links(d).collect()} == {"./guide.md#top", "https://x.org", "node://function%3A1"}
    assert [r["node_id"] for r in documents.anchors(d).collect()] == ["function:1"]
    paths = spark.createDataFrame([("other.md",)], "path string")
    assert [r["message"] for r in drift.broken_links(documents.links(d), paths).collect()] == ["./guide.md#top"]


def test_checks_against_reality(spark):
    c = documents.claims(docs(spark)).withColumn("negated", F.lit(False))
    paths = spark.createDataFrame([("scaffold/src/index.ts",)], "path string")
    assert [r["message"] for r in drift.missing_paths(c, paths).collect()] == ["no such path: lib/old.py"]
    name = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert {r["message"] for r in drift.dead_commands(c, name("test"), name("all")).collect()} == {"npm run gone"}
    # no manifest, no check
    assert drift.dead_commands(c, name(), name("all")).count() == 0
    m = spark.createDataFrame([("react", "^17.0.2"), ("vue", "3")], "name string, version string")
    assert {(r["code"], r["message"]) for r in drift.dependencies(c, m).collect()} == {("DEPENDENCY_MISSING", "Lodash"), ("VERSION_MISMATCH", "React 18")}
    texts = spark.createDataFrame([("run lint first",)], "text string")
    assert [r["message"] for r in drift.undocumented_scripts(name("lint", "test", "pretest", "prepare"), texts).collect()] == ["test"]


def test_version_conflict_counts_whole_values(spark):
    rows = [("version", "React 18", "a", 1, False), ("version", "react 18", "b", 1, False), ("version", "Vue 3", "a", 2, False), ("version", "Vue 3", "b", 2, False)]
    c = spark.createDataFrame(rows, "kind string, value string, source string, line int, negated boolean")
    assert [r["message"].split(":")[0] for r in drift.version_conflicts(c).collect()] == ["react"]


def test_markers_fences_and_sections(spark):
    d = spark.createDataFrame([(1, "TODO a FIXME\n```\nTODO\n```\nxTODO")], "doc_id int, text string")
    assert [(r["line"], r["marker"]) for r in drift.markers(drift.lines(d)).collect()] == [(1, "TODO"), (1, "FIXME"), (3, "TODO")]
    f = {r["line"]: r["in_fence"] for r in drift.fenced(drift.lines(d)).collect()}
    assert f == {1: False, 2: True, 3: True, 4: False, 5: False}


def prints(spark, rows):
    return spark.createDataFrame(rows, "id string, minhash array<bigint>, neighbors array<string>, token_count long")


def test_reconcile_fixtures(spark):
    low = lambda k: [i if i < k else 10000 + i for i in range(64)]
    lost = prints(spark, [("m", low(64), ["n"], 40)])
    for matches, near, want in ((64, ["n"], "MOVED"), (40, ["n"], "AMBIGUOUS"), (2, ["o"], "GONE")):
        cand = prints(spark, [("c", low(matches), near, 40)])
        pairs = identity.bands(lost).withColumnRenamed("id", "a").join(identity.bands(cand).withColumnRenamed("id", "b"), ["band", "band_hash"]).select("a", "b").distinct()
        assert identity.reconcile(lost, cand, pairs).first()["verdict"] == want
    short = prints(spark, [("m", low(64), ["n"], 2)])
    assert identity.reconcile(short, lost, spark.createDataFrame([("m", "m")], "a string, b string")).first()["verdict"] == "GONE"
    s = F.struct(F.col("minhash"), F.col("neighbors"), F.col("token_count").cast("int").alias("tokenCount"))
    back = lost.select(identity.deserialize(identity.serialize(s)).alias("p"), identity.deserialize(F.lit("mh:63:00")).alias("q")).first()
    assert back["p"]["minhash"] == low(64) and back["q"] is None


def test_minhash_of_short_texts(spark):
    d = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b", "c"]), (3, ["a", "b", "c"])], "id int, w array<string>")
    got = {r["id"]: r for r in identity.minhash(d, F.col("w")).collect()}
    assert got[1]["minhash"] == [identity.EMPTY] * 64 and got[2]["minhash"] == got[3]["minhash"] and got[2]["token_count"] == 3
    import hashlib

    assert got[2]["minhash"][5] == int(hashlib.sha256(b"5\0a\0b\0c").hexdigest()[:8], 16)


def test_log(spark):
    lines = ['{"timestamp":"2026-05-01T00:00:00Z","kind":"note","message":"m","files":["a",1]}', "not-json", '{"timestamp":"t","kind":"other","message":"m"}', '{"timestamp":1,"kind":"note","message":"m"}']
    got = events.parse_log(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert len(got) == 1 and got[0]["files"] == ["a"] and got[0]["cwd"] == "." and got[0]["trace"] is None
    assert events.log_lines(events.parse_log(spark.createDataFrame([(lines[0],)], "value string"))).first()[0] == '{"timestamp":"2026-05-01T00:00:00Z","kind":"note","message":"m","files":["a"],"cwd":"."}'


def test_heartbeat_is_strict_and_activity_fills(spark):
    f = spark.createDataFrame([("a", "2026-05-01 00:00:00"), ("b", "2026-05-07 00:00:00"), ("c", None)], "key string, t string").withColumn("last_updated", F.col("t").cast("timestamp"))
    got = {r["key"]: r["stale"] for r in events.heartbeat(f, F.lit("2026-05-14 00:00:00").cast("timestamp"), 7).collect()}
    assert got == {"a": True, "b": False, "c": False}
    e = spark.createDataFrame([("2026-05-14 01:00:00",), ("2026-05-14 02:00:00",), ("2026-05-10 02:00:00",), (None,)], "t string").withColumn("at", F.col("t").cast("timestamp"))
    rows = events.activity(e, F.lit("2026-05-14 12:00:00").cast("timestamp")).orderBy("day").collect()
    assert [r["n"] for r in rows] == [0, 0, 1, 0, 0, 0, 2] and "".join(r["bar"] for r in rows) == "▁▁▅▁▁▁█"


def test_evaluation(spark):
    e = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "c")], "task string, name string")
    r = spark.createDataFrame([("t", "a"), ("t", "a"), ("u", "x")], "task string, name string")
    assert {x["task"]: x["recall"] for x in evaluate.expected_recall(e, r).collect()} == {"t": 0.5, "u": 0.0}
    t = spark.createDataFrame([("r", '{"type":"assistant","message":{"content":[{"type":"tool_use"},{"type":"text"}]}}'), ("r", '{"type":"result","num_turns":3,"total_cost_usd":0.2}'), ("r", "x")], "run string, value string")
    assert tuple(evaluate.transcript_counts(t).first()) == ("r", 3, 1, 0.2)


def test_scores_cover_all_issues(spark):
    from graphloom.plans import drift_queries, registry

    sf = "/root/testdata/sf0.001"
    cost = {"error": 10, "warning": 3, "info": 1}
    spent = {}
    for r in drift_queries._issues(spark, sf).select("day", "severity").collect():
        for k in (r["day"], None):
            spent[k] = spent.get(k, 0) + cost[r["severity"]]
    got = {r["day"]: r["score"] for r in registry.QUERIES["drift_score_every_day"](spark, sf).collect()}
    assert len(got) > 2 and got == {k: max(0, 100 - c) for k, c in spent.items()}
    told = {r["what"]: r["n"] for r in registry.QUERIES["doctor_all_issues"](spark, sf).collect()}
    assert told["drift"] == got[None]


def test_log_that_is_written_again_holds_nothing_twice(spark, tmp_path):
    from graphloom.operators import events

    row = "timestamp string, kind string, message string, files array<string>, cwd string, trace string, source string, status string"
    made = lambda *said: spark.createDataFrame([("2026-01-01T00:00:00Z", "note", m, ["a"], ".", None, None, None) for m in said], row)
    folder = str(tmp_path / "log")
    events.append(made("one", "two"), folder, 0)
    events.append(made("three\nlines \"q\""), folder, 1)
    # a batch that fails on its way, and is written again
    try:
        events.append(made("four").withColumn("message", F.raise_error(F.lit("lost"))), folder, 2)
    except Exception:  # noqa: BLE001, S110
        pass
    events.append(made("four"), folder, 2)
    events.append(made("three\nlines \"q\""), folder, 1)
    got = sorted((r["batch"], r["message"], r["trace"]) for r in events.read_log(spark, folder).collect())
    assert got == [(0, "one", None), (0, "two", None), (1, 'three\nlines "q"', None), (2, "four", None)]


def test_very_many_names_in_texts(spark, monkeypatch):
    from graphloom.operators import patterns

    names = [f"name{i}x" for i in range(3000)] + ["a", "aa", "b a", "", None, "ü"]
    texts = [("name7x name12x aa",), ("b a name7",), (None,), ("",), ("ünname2999x" * 3,)]
    n, t = spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame(texts, "text string")
    want = {x: k for x in names if x and (k := sum(x in (s or "") for (s,) in texts))}
    for size in (4_000_000, 5_000):
        monkeypatch.setattr(patterns, "CHARACTERS", size)
        got = patterns.occurring(n, t)
        assert {r["name"]: r["n_texts"] for r in got.collect()} == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert patterns.occurring(n.limit(0), t).count() == 0 and patterns.occurring(n, t.limit(0)).count() == 0
