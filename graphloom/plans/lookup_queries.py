"""Queries of lookups, claims and imports over the bridge's graph and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, graph, lookup
from ..sources import bridge
from .graph_queries import CALLS, NODES, PARTS, REFS, _refs
from .registry import query

LINKS = r"""links AS (
  SELECT page_id, file, generate_subscripts(h, 1) - 1 AS line, unnest(h) AS href FROM (
    SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), '/+$', '') AS file, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages))"""


@query(
    f"""WITH {NODES}, asked AS (SELECT DISTINCT 'function:p' || l_partkey * 2 AS id FROM lineitem)
    SELECT asked.id, nodes.id IS NOT NULL AS found, kind, file_path FROM asked LEFT JOIN nodes USING (id)"""
)
def get_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes asked for by ids, half of which are unknown."""
    ids = bridge.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("function:p"), (F.col("l_partkey") * 2).cast("string")).alias("id"))
    return lookup.nodes_by_id(bridge.nodes(spark, sf_dir), ids).select("id", "found", "kind", "file_path")


@query(
    """SELECT 'method:c' || o_custkey AS source, 'function:o' || o_orderkey AS target, 'calls' AS kind FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)"""
)
def edges_of_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outgoing calls of customers well in credit."""
    ids = bridge.table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(bridge.key("method:c", "c_custkey").alias("id"))
    return lookup.edges_at(bridge.edges(spark, sf_dir), ids, "source", ("calls",))


@query(f"WITH {NODES} SELECT id, file_path FROM nodes WHERE file_path IN (SELECT 'brand/' || p_brand FROM part WHERE p_size = 50)")
def nodes_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the files that hold a part of the largest size, their paths written in different ways."""
    p = bridge.table(spark, sf_dir, "part").filter("p_size = 50")
    path = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("./brand/"), "p_brand")).otherwise(F.concat(F.lit("brand\\"), "p_brand"))
    return lookup.nodes_of_files(bridge.nodes(spark, sf_dir), p.select(path.alias("path"))).select("id", "file_path")


def _related_sql(near: str, far: str) -> str:
    return f"""WITH {PARTS}, {CALLS}, asked AS (SELECT name FROM parts GROUP BY name HAVING count(*) >= 2 UNION SELECT 'function:p' || p_partkey FROM part WHERE p_size = 1),
    target AS (SELECT id FROM parts WHERE name IN (SELECT name FROM asked) OR id IN (SELECT name FROM asked))
    SELECT DISTINCT {near} AS target, {far} AS id FROM calls WHERE {near} IN (SELECT id FROM target)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = bridge.parts(spark, sf_dir)
    small = bridge.table(spark, sf_dir, "part").filter("p_size = 1").select(bridge.key("function:p", "p_partkey").alias("name"))
    return p.groupBy("name").agg(F.count("*").alias("n")).filter("n >= 2").select("name").unionByName(small)


@query(_related_sql("target", "source"))
def who_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What calls the parts of repeated names, and some parts named by id."""
    return lookup.related(bridge.parts(spark, sf_dir), bridge.edges(spark, sf_dir), _asked(spark, sf_dir))


@query(
    f"""WITH {CALLS}, seed AS (SELECT 'function:o' || o_orderkey AS id FROM orders),
    up AS (SELECT target AS seed, source AS id, 'caller' AS relation, row_number() OVER (PARTITION BY target ORDER BY source) AS n FROM calls WHERE target IN (SELECT id FROM seed)),
    down AS (SELECT source AS seed, target AS id, 'callee' AS relation, row_number() OVER (PARTITION BY source ORDER BY target) AS n FROM calls WHERE source IN (SELECT id FROM seed))
    SELECT seed, id, relation FROM (FROM up UNION ALL FROM down) WHERE n <= 3"""
)
def hop_cap_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three callers and three callees of each order, which has both."""
    orders = bridge.table(spark, sf_dir, "orders").select(bridge.key("function:o", "o_orderkey").alias("id"))
    return graph.neighbourhood(bridge.edges(spark, sf_dir), orders, 3)


@query(
    f"""WITH {PARTS}, {REFS}, met AS (SELECT r.ref_id, p.id AS target, p.file_path = r.file_path AS same FROM refs r JOIN parts p ON p.name = substr(r.reference_name, 5)),
    fw AS (SELECT ref_id, coalesce(CASE WHEN count(*) FILTER (same) = 1 THEN max(target) FILTER (same) END, CASE WHEN count(*) = 1 THEN max(target) END) AS f FROM met GROUP BY ref_id),
    base AS (SELECT ref_id, 'base' AS target FROM refs WHERE ref_id % 3 = 0)
    SELECT coalesce(fw.ref_id, base.ref_id) AS ref_id, coalesce(f, target) AS target, CASE WHEN f IS NOT NULL THEN 'heuristic' ELSE 'tree-sitter' END AS provenance
    FROM (SELECT * FROM fw WHERE f IS NOT NULL) fw FULL JOIN base USING (ref_id)"""
)
def framework_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as routes whose handlers are parts: the framework's answer wins over the base one."""
    refs = _refs(spark, sf_dir).withColumn("reference_name", F.substring("reference_name", 5, 100))
    base = refs.filter("ref_id % 3 = 0").select("ref_id", F.lit("base").alias("target"))
    return graph.framework_first(base, graph.route_targets(refs, bridge.parts(spark, sf_dir)))


@query(
    """WITH refs AS (SELECT p_partkey AS ref_id, 'pkg/' || p_type || '/' || p_size % 5 || '/m.py' AS file_path,
      CASE p_size % 4 WHEN 0 THEN '.' || p_size % 7 WHEN 1 THEN '..' || p_type || '.' || p_size % 5 WHEN 2 THEN 'pkg.' || p_type || '.' || p_size % 9 ELSE '..' || p_size % 5 END AS s FROM part),
    files AS (SELECT DISTINCT 'pkg/' || p_type || '/' || p_size % 5 || CASE WHEN p_size % 2 = 0 THEN '/__init__.py' ELSE '.py' END AS path FROM part
      UNION SELECT DISTINCT 'pkg/' || p_type || '/' || p_size % 5 || '/' || p_size % 3 || '.py' FROM part),
    base AS (SELECT ref_id, file_path, CASE WHEN s LIKE '..%' THEN regexp_extract(file_path, '^(.*)/[^/]*/[^/]*$', 1) || '/' || replace(substr(s, 3), '.', '/')
      WHEN s LIKE '.%' THEN regexp_extract(file_path, '^(.*)/[^/]*$', 1) || '/' || replace(substr(s, 2), '.', '/') ELSE replace(s, '.', '/') END AS b FROM refs),
    c AS (SELECT ref_id, file_path, pos, b || x AS path FROM base, (VALUES (0, ''), (1, '.py'), (2, '/__init__.py')) v(pos, x))
    SELECT ref_id, file_path, arg_min(path, pos) AS imported_path FROM c JOIN files USING (path) GROUP BY ref_id, file_path"""
)
def python_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part is a module that imports by one dot, by two dots and from the root."""
    p = bridge.table(spark, sf_dir, "part")
    n = lambda k: (F.col("p_size") % k).cast("string")
    at = F.concat(F.lit("pkg/"), "p_type", F.lit("/"), n(5))
    said = (
        F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("."), n(7)))
        .when(F.col("p_size") % 4 == 1, F.concat(F.lit(".."), "p_type", F.lit("."), n(5)))
        .when(F.col("p_size") % 4 == 2, F.concat(F.lit("pkg."), "p_type", F.lit("."), n(9)))
        .otherwise(F.concat(F.lit(".."), n(5)))
    )
    refs = p.select(F.col("p_partkey").alias("ref_id"), F.concat(at, F.lit("/m.py")).alias("file_path"), said.alias("specifier"))
    first = p.select(F.concat(at, F.when(F.col("p_size") % 2 == 0, "/__init__.py").otherwise(".py")).alias("path"))
    return lookup.python_import_targets(refs, first.unionByName(p.select(F.concat(at, F.lit("/"), n(3), F.lit(".py")).alias("path"))))


@query(
    f"""WITH {LINKS}, files AS (SELECT DISTINCT file AS path FROM links), claims AS (SELECT DISTINCT file AS source, line, CASE line % 3 WHEN 0 THEN ltrim(href, '/') WHEN 1 THEN './' || ltrim(href, '/') ELSE regexp_extract(file, '[^/]*$') END AS v FROM links WHERE line % 5 <> 4),
    bare AS (SELECT DISTINCT regexp_extract(path, '([^/]+)$', 1) AS b FROM files)
    SELECT source AS file, line::INT AS line, 'no such path: ' || v AS message, CASE WHEN contains(source, 'patterns/') OR regexp_matches(v, '[<>\\[\\]{{}}]') THEN 'warning' ELSE 'error' END AS severity FROM claims
    WHERE v NOT IN (SELECT path FROM files) AND 'scaffold/' || v NOT IN (SELECT path FROM files) AND regexp_replace(v, '^\\./', '') NOT IN (SELECT path FROM files)
      AND NOT (NOT contains(v, '/') AND v IN (SELECT b FROM bare))"""
)
def missing_claimed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each link of a page as a claim of a path, some negated: those of which no alternative is a page."""
    links = bridge.page_links(spark, sf_dir)
    bare = F.regexp_replace("target", "^/+", "")
    value = F.when(F.col("line") % 3 == 0, bare).when(F.col("line") % 3 == 1, F.concat(F.lit("./"), bare)).otherwise(F.regexp_extract("file", "[^/]*$", 0))
    claims = links.select(F.lit("path").alias("kind"), (F.col("line") % 5 == 4).alias("negated"), F.col("file").alias("source"), "line", value.alias("value"))
    return drift.missing_paths(claims, links.select(F.col("file").alias("path"))).select("file", "line", "message", "severity")


@query(f"WITH {LINKS} SELECT file, 'no such document: ' || ltrim(href, '/') AS message FROM links WHERE ltrim(href, '/') NOT IN (SELECT file FROM links)")
def dead_front_matter_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each link of a page as an edge in its front matter: those to no page."""
    links = bridge.page_links(spark, sf_dir)
    edges = links.select("file", F.regexp_replace("target", "^/+", "").alias("target"))
    return drift.dead_edges(edges, links.select(F.col("file").alias("path")).distinct()).select("file", "message")


@query(
    """WITH said AS (SELECT 'user' || user_id AS file, event_id::INT AS line, CASE WHEN event_type IN ('view', 'click') THEN 'make ' ELSE 'yarn ' END || 's' || user_id % 40 AS value, event_type IN ('view', 'click') AS make, 's' || user_id % 40 AS name FROM events),
    scripts AS (SELECT DISTINCT 's' || c_custkey % 30 AS name FROM customer), targets AS (SELECT DISTINCT 's' || s_suppkey % 20 AS name FROM supplier)
    SELECT file, line, value AS message FROM said WHERE CASE WHEN make THEN name NOT IN (SELECT name FROM targets) ELSE name NOT IN (SELECT name FROM scripts) END"""
)
def dead_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a command in a user's document: those that name no script or target."""
    e = bridge.table(spark, sf_dir, "events")
    name = F.concat(F.lit("s"), (F.col("user_id") % 40).cast("string"))
    value = F.when(F.col("event_type").isin("view", "click"), F.concat(F.lit("make "), name)).otherwise(F.concat(F.lit("yarn "), name))
    claims = e.select(F.lit("command").alias("kind"), F.lit(False).alias("negated"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("source"), F.col("event_id").alias("line"), value.alias("value"))
    some = lambda t, c, k: bridge.table(spark, sf_dir, t).select(F.concat(F.lit("s"), (F.col(c) % k).cast("string")).alias("name"))
    return drift.dead_commands(claims, some("customer", "c_custkey", 30), some("supplier", "s_suppkey", 20)).select("file", "line", "message")


@query(
    """WITH m AS (SELECT upper(p_name) AS name, min(p_size) || '.1' AS version FROM part WHERE p_size > 20 AND p_type <> 'PROMO' GROUP BY p_name),
    v AS (SELECT p_brand AS file, p_partkey::INT AS line, p_name AS dep, p_size::VARCHAR AS said FROM part WHERE p_partkey % 2 = 0)
    SELECT 'DEPENDENCY_MISSING' AS code, p_brand AS file, p_partkey::INT AS line, p_name || ' ' || p_type AS message FROM part WHERE lower(p_name || ' ' || p_type) NOT IN (SELECT lower(name) FROM m)
    UNION ALL SELECT 'VERSION_MISMATCH', file, line, dep || ' v' || said FROM v JOIN m ON lower(name) = dep WHERE NOT contains(version, said)"""
)
def dependency_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a claimed dependency, every second with a version, against a manifest of some parts."""
    p = bridge.table(spark, sf_dir, "part")
    at = [F.lit(False).alias("negated"), F.col("p_brand").alias("source"), F.col("p_partkey").alias("line")]
    named = p.select(F.lit("dependency").alias("kind"), *at, F.concat_ws(" ", "p_name", "p_type").alias("value"))
    versions = p.filter("p_partkey % 2 = 0").select(F.lit("version").alias("kind"), *at, F.concat(F.col("p_name"), F.lit(" v"), F.col("p_size").cast("string")).alias("value"))
    manifest = p.filter("p_size > 20 and p_type <> 'PROMO'").groupBy("p_name").agg(F.concat(F.min("p_size").cast("string"), F.lit(".1")).alias("version"))
    return drift.dependencies(named.unionByName(versions), manifest.select(F.upper("p_name").alias("name"), "version")).select("code", "file", "line", "message")


@query(
    """WITH names AS (SELECT DISTINCT lang AS name FROM documents WHERE lang IS NOT NULL UNION SELECT DISTINCT 'the:' || source FROM documents WHERE source IS NOT NULL UNION SELECT DISTINCT 'zz' || source FROM documents WHERE source IS NOT NULL
      UNION SELECT DISTINCT 'prezz' || source FROM documents WHERE source IS NOT NULL UNION SELECT 'the' UNION SELECT 'postinstall'),
    own AS (SELECT name FROM names WHERE name <> 'postinstall' AND NOT (regexp_extract(name, '^(pre|post)(.+)$', 2) IN (SELECT name FROM names))),
    told AS (SELECT name FROM own WHERE EXISTS (SELECT 1 FROM documents WHERE contains(text, name)))
    SELECT name AS message FROM own WHERE name NOT IN (SELECT name FROM told) AND NOT (contains(name, ':') AND split_part(name, ':', 1) IN (SELECT name FROM told))"""
)
def undocumented_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of sources and languages as scripts, with variants: those that no document mentions."""
    d = bridge.table(spark, sf_dir, "documents")
    source = d.filter("source is not null").select("source").distinct()
    names = d.filter("lang is not null").select(F.col("lang").alias("name")).distinct()
    for p in ("the:", "zz", "prezz"):
        names = names.unionByName(source.select(F.concat(F.lit(p), "source").alias("name")))
    names = names.unionByName(spark.createDataFrame([("the",), ("postinstall",)], "name string"))
    return drift.undocumented_scripts(names, d.select("text").filter("text is not null")).select("message")


@query(
    f"""WITH {CALLS}, roots AS (SELECT 'function:p' || p_partkey AS id FROM part WHERE p_size = 50),
    l1 AS (SELECT DISTINCT source AS id FROM calls WHERE target IN (SELECT id FROM roots)), base AS (SELECT DISTINCT 'customer/' || o_custkey AS file, 'function:o' || o_orderkey AS node_id FROM orders)
    SELECT file, node_id, 1 AS depth FROM base WHERE node_id IN (SELECT id FROM l1)"""
)
def grounded_files_of_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents grounded in their orders: those that a change of the largest parts affects."""
    roots = bridge.table(spark, sf_dir, "part").filter("p_size = 50").select(bridge.key("function:p", "p_partkey").alias("id"))
    found = graph.merged_impact(graph.impact(bridge.edges(spark, sf_dir), roots, 1))
    base = bridge.table(spark, sf_dir, "orders").select(bridge.key("customer/", "o_custkey").alias("file"), bridge.key("function:o", "o_orderkey").alias("node_id"))
    return lookup.grounded_files(found, base)


@query(
    """WITH i AS (SELECT user_id, ts, CASE event_type WHEN 'error' THEN 10 WHEN 'signup' THEN 3 ELSE 1 END AS cost FROM events),
    b AS (SELECT user_id, greatest(0, least(100, 100 - sum(cost)))::BIGINT AS s FROM i WHERE ts < TIMESTAMP '2024-01-15' GROUP BY user_id), a AS (SELECT user_id, greatest(0, least(100, 100 - sum(cost)))::BIGINT AS s FROM i WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY user_id)
    SELECT user_id, coalesce(b.s, 100)::BIGINT AS before, coalesce(a.s, 100)::BIGINT AS after, (coalesce(a.s, 100) - coalesce(b.s, 100))::BIGINT AS delta FROM b FULL JOIN a USING (user_id)"""
)
def score_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as issues: the score of the first and the second half of the month."""
    severity = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "warning").otherwise("info")
    issues = bridge.table(spark, sf_dir, "events").select("user_id", "ts", severity.alias("severity"))
    half = F.lit("2024-01-15").cast("timestamp_ntz")
    return lookup.score_delta(drift.score(issues.filter(F.col("ts") < half), ["user_id"]), drift.score(issues.filter(F.col("ts") >= half), ["user_id"]), ["user_id"])


@query(
    f"""WITH {NODES} SELECT id FROM nodes WHERE kind IN ('class', 'namespace') AND split_part(file_path, '/', 1) = 'nation'"""
)
def filtered_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of two kinds in one language; a node's language is its top folder."""
    n = bridge.nodes(spark, sf_dir).withColumn("language", F.split_part("file_path", F.lit("/"), F.lit(1)))
    return lookup.filtered(n, ("class", "namespace"), ("nation",)).select("id")
