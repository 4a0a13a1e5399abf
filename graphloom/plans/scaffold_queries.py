"""Queries of scaffolds, groundings and their upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, grounding, scaffold
from ..sources import bridge
from .drift_queries import ISSUES, _issues
from .graph_queries import CALLS, NODES
from .lookup_queries import LINKS
from .registry import query


def _text(column):
    return column.cast("string")


@query(
    """SELECT DISTINCT CASE WHEN c_nationkey % 5 = 0 THEN 'scaffold/context/c' || c_custkey || '.md' WHEN c_custkey % 2 = 0 THEN 'scaffold/ROUTER.md' ELSE 'CLAUDE.md' END AS source
    FROM customer WHERE c_nationkey % 5 IN (0, 4)"""
)
def scaffold_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files, some in deeper folders, hidden, or outside: those that are a scaffold's documents."""
    c = bridge.table(spark, sf_dir, "customer")
    own = F.concat(F.lit("c"), _text(F.col("c_custkey")), F.lit(".md"))
    n = F.col("c_nationkey") % 5
    path = (
        F.when(n == 0, F.concat(F.lit("scaffold/context/"), own))
        .when(n == 1, F.concat(F.lit("scaffold/patterns/deep/"), own))
        .when(n == 2, F.concat(F.lit("scaffold/context/."), own))
        .when(n == 3, F.concat(F.lit("src/"), own))
        .when(F.col("c_custkey") % 2 == 0, "scaffold/ROUTER.md")
        .otherwise("CLAUDE.md")
    )
    return scaffold.scaffold_files(c.select(path.alias("path"), F.lit("").alias("text"))).select("source")


@query(
    f"""WITH c AS (SELECT unnest({list(scaffold.CHECKERS)}) AS name)
    SELECT 'claims' AS what, event_type AS name, count(*) AS n FROM events GROUP BY event_type
    UNION ALL SELECT 'issues', c.name, count(event_id) FROM c LEFT JOIN (SELECT event_id, ({list(scaffold.CHECKERS)})[user_id % 9 + 1] AS name FROM events) USING (name) GROUP BY c.name"""
)
def check_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as claims by kind, and as issues of nine checkers of twelve."""
    e = bridge.table(spark, sf_dir, "events")
    at = (F.col("user_id") % 9 + 1).cast("int")
    issues = e.select(F.element_at(F.array(*map(F.lit, scaffold.CHECKERS)), at).alias("checker"))
    return scaffold.counts(issues, e.select(F.col("event_type").alias("kind")))


@query(
    f"""WITH {ISSUES}, d AS (SELECT code, severity, file || day AS file, ord FROM issues),
    k AS (SELECT * FROM d WHERE code LIKE 'GROUNDING%' OR file IN (SELECT file FROM d WHERE severity = 'error'))
    SELECT file, min(ord) AS first, string_agg(code || ' ' || severity, ',' ORDER BY ord) AS issues FROM k GROUP BY file"""
)
def repair_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to be mended, with their issues in order; a file is a user's day."""
    rows = _issues(spark, sf_dir).withColumn("file", F.concat("file", _text(F.col("day"))))
    told = F.array_join(F.transform("issues", lambda i: F.concat_ws(" ", i["code"], i["severity"])), ",")
    return scaffold.repair_targets(rows).select("file", "first", told.alias("issues"))


@query(
    """WITH d AS (SELECT DISTINCT ts::DATE AS day FROM events)
    SELECT 'memory/' || day || '.md' AS path, date_diff('day', day, DATE '2024-02-01')::INT AS days FROM d WHERE date_diff('day', day, DATE '2024-02-01') > 14"""
)
def old_daily_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day of the log as a daily note, and names that are none: notes older than a fortnight."""
    day = bridge.log(spark, sf_dir).select(_text(F.to_date("at")).alias("day")).distinct()
    forms = F.array(F.concat(F.lit("memory/"), "day", F.lit(".md")), F.concat(F.lit("memory/x"), "day", F.lit(".md")), F.concat(F.lit("notes/"), "day", F.lit(".md")))
    return scaffold.old_memory(day.select(F.explode(forms).alias("path")), F.lit("2024-02-01").cast("timestamp"))


@query(
    """WITH p AS (SELECT DISTINCT p_size AS s, p_size % 3 AS down, p_partkey % 5 AS up, p_partkey % 7 = 0 AS absolute FROM part), f AS (SELECT DISTINCT p_size AS s FROM part WHERE p_size < 25)
    SELECT CASE WHEN absolute THEN '/' ELSE '' END || repeat('a/', down) || repeat('../', up) || 'f' || s || '.md' AS file,
      CASE WHEN absolute OR up > down THEN 'escapes' WHEN up = down AND s IN (SELECT s FROM f) THEN 'ok' ELSE 'missing' END AS status FROM p"""
)
def read_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that go down and up again, from each part: which are read, missing, or lead out of the folder."""
    p = bridge.table(spark, sf_dir, "part")
    own = F.concat(F.lit("f"), _text(F.col("p_size")), F.lit(".md"))
    root = F.when(F.col("p_partkey") % 7 == 0, "/").otherwise("")
    asked = p.select(F.concat(root, F.repeat(F.lit("a/"), (F.col("p_size") % 3).cast("int")), F.repeat(F.lit("../"), (F.col("p_partkey") % 5).cast("int")), own).alias("file"))
    files = p.filter("p_size < 25").select(F.concat(F.lit("scaffold/"), own).alias("path"), F.lit("x").alias("text")).distinct()
    return scaffold.read_files(files, asked).select("file", "status")


@query(f"WITH {LINKS} SELECT file, string_agg(DISTINCT href, ' ' ORDER BY href) AS targets FROM links GROUP BY file")
def page_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page leads to."""
    found = scaffold.adjacency(bridge.page_links(spark, sf_dir).select("file", "target"))
    return found.select("file", F.array_join("targets", " ").alias("targets"))


@query(f"WITH {NODES} SELECT file_path, min(ord) AS first, string_agg(id, ' ' ORDER BY ord, id) AS ids FROM nodes GROUP BY file_path")
def nodes_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each file in order."""
    return graph.nodes_by_file(bridge.nodes(spark, sf_dir)).select("file_path", "first", F.array_join("ids", " ").alias("ids"))


@query(
    f"""WITH {CALLS}, roots AS (SELECT 'function:p' || p_partkey AS id FROM part WHERE p_size = 50),
    l1 AS (SELECT DISTINCT source AS id FROM calls WHERE target IN (SELECT id FROM roots)), l2 AS (SELECT DISTINCT source AS id FROM calls WHERE target IN (SELECT id FROM l1))
    SELECT id, min(depth) AS depth FROM (SELECT id, 0 AS depth FROM roots UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2) GROUP BY id"""
)
def affected_with_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest parts and all that a change of them affects over two steps."""
    roots = bridge.table(spark, sf_dir, "part").filter("p_size = 50").select(bridge.key("function:p", "p_partkey").alias("id"))
    return graph.affected(roots, graph.merged_impact(graph.impact(bridge.edges(spark, sf_dir), roots, 2)))


VERDICTS = """verdicts AS (SELECT 'function:p' || p_partkey * 2 AS id, CASE p_size % 4 WHEN 0 THEN 'MOVED' WHEN 1 THEN 'AMBIGUOUS' ELSE 'GONE' END AS verdict,
      CASE WHEN p_size % 4 < 2 THEN 'function:p' || p_partkey END AS candidate FROM part WHERE p_size % 4 < 3)"""


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on twice the number of each part, of which half are no nodes."""
    p = bridge.table(spark, sf_dir, "part").withColumn("k", F.col("p_size") % 4).filter("k < 3")
    verdict = F.when(F.col("k") == 0, "MOVED").when(F.col("k") == 1, "AMBIGUOUS").otherwise("GONE")
    old = F.concat(F.lit("function:p"), _text(F.col("p_partkey") * 2))
    return p.select(old.alias("id"), verdict.alias("verdict"), F.when(F.col("k") < 2, bridge.key("function:p", "p_partkey")).alias("node_id"))


@query(
    f"""WITH {VERDICTS}, a AS (SELECT 'supplier/' || l_suppkey AS file, 'function:p' || l_partkey * 2 AS node_id FROM lineitem WHERE l_partkey * 2 NOT IN (SELECT p_partkey FROM part))
    SELECT file, CASE verdict WHEN 'MOVED' THEN 'GROUNDING_DRIFT' WHEN 'AMBIGUOUS' THEN 'GROUNDING_AMBIGUOUS' ELSE 'GROUNDING_GONE' END AS code, 'warning' AS severity,
      node_id || coalesce(' -> ' || candidate, '') AS message FROM a LEFT JOIN verdicts ON id = node_id"""
)
def anchor_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line as an anchor of its supplier's document: those to nodes that are gone, by verdict."""
    t = bridge.table(spark, sf_dir, "lineitem")
    anchors = t.select(bridge.key("supplier/", "l_suppkey").alias("file"), F.concat(F.lit("function:p"), _text(F.col("l_partkey") * 2)).alias("node_id"))
    found = grounding.anchor_issues(anchors, bridge.parts(spark, sf_dir), _verdicts(spark, sf_dir))
    return found.select("file", "code", "severity", "message")


ASKED = """asked AS (SELECT file, node_id, max(fp) AS fp, bool_or(grounded) AS grounded FROM (
      SELECT 'customer/' || o_custkey AS file, 'function:p' || o_orderkey % 3000 AS node_id, 'f' || o_orderkey % 3 AS fp, true AS grounded FROM orders
      UNION ALL SELECT 'customer/' || o_custkey, 'function:p' || o_orderkey % 500, NULL, false FROM orders WHERE o_orderkey % 2 = 0) GROUP BY file, node_id)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What customers' documents rest on, by groundings and by anchors."""
    o = bridge.table(spark, sf_dir, "orders")
    at = lambda k: F.concat(F.lit("function:p"), _text(F.col("o_orderkey") % k)).alias("node_id")
    file = bridge.key("customer/", "o_custkey").alias("file")
    g = o.select(file, at(3000), F.concat(F.lit("f"), _text(F.col("o_orderkey") % 3)).alias("fingerprint"))
    return grounding.wanted(g, o.filter("o_orderkey % 2 = 0").select(file, at(500)))


def _bodies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = bridge.table(spark, sf_dir, "part")
    ids = bridge.key("function:p", "p_partkey").alias("id")
    prints = p.filter("p_size % 5 != 0").select(ids, F.concat(F.lit("f"), _text(F.col("p_size") % 3)).alias("fingerprint"))
    return p.select(ids, F.when(F.col("p_size") <= 40, F.col("p_type")).alias("body_hash")), prints


BODIES = """nodes AS (SELECT 'function:p' || p_partkey AS node_id, CASE WHEN p_size <= 40 THEN p_type END AS body_hash, CASE WHEN p_size % 5 <> 0 THEN 'f' || p_size % 3 END AS now FROM part)"""


@query(
    f"""WITH {ASKED}, {BODIES} SELECT file, node_id, now AS fingerprint, body_hash,
      CASE WHEN now IS NULL THEN 'unavailable' WHEN grounded AND fp IS DISTINCT FROM now THEN 'changed' WHEN body_hash IS NULL THEN 'bodiless' ELSE 'captured' END AS state
    FROM asked LEFT JOIN nodes USING (node_id)"""
)
def captured_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What documents rest on, by groundings and anchors, and whether a baseline of it is kept."""
    return grounding.capture(_asked(spark, sf_dir), *_bodies(spark, sf_dir)).select("file", "node_id", "fingerprint", "body_hash", "state")


@query(
    f"""WITH {ASKED}, {BODIES}, {VERDICTS},
    moves AS (SELECT DISTINCT file, asked.node_id AS old, candidate AS new FROM asked JOIN verdicts ON id = asked.node_id WHERE verdict = 'MOVED' AND asked.node_id NOT IN (SELECT node_id FROM nodes)),
    fresh AS (SELECT DISTINCT file, new AS node_id, body_hash, now AS fingerprint FROM moves JOIN nodes ON nodes.node_id = new)
    SELECT file, node_id, 'old' AS body_hash, fp AS fingerprint FROM asked WHERE (file, node_id) NOT IN (SELECT (file, old) FROM moves) AND (file, node_id) NOT IN (SELECT (file, node_id) FROM fresh)
    UNION ALL SELECT file, node_id, body_hash, fingerprint FROM fresh"""
)
def rebound_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baselines of customers' documents after what has surely moved is rebound."""
    asked, (nodes, prints) = _asked(spark, sf_dir), _bodies(spark, sf_dir)
    baselines = asked.select("file", "node_id", F.lit("old").alias("body_hash"), "fingerprint")
    moved = grounding.moves(asked, nodes, _verdicts(spark, sf_dir), prints)
    return grounding.rebind(baselines, moved, nodes)
