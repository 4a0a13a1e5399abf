"""Queries over the code graph that the bridge makes of the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import body_hash, node_id, token_estimate
from ..operators import graph
from ..sources import bridge
from .registry import query

CALLS = """calls AS (
  SELECT DISTINCT 'method:c' || o_custkey AS source, 'function:o' || o_orderkey AS target FROM orders
  UNION ALL SELECT DISTINCT 'function:o' || l_orderkey, 'function:p' || l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'class:s' || l_suppkey, 'function:p' || l_partkey FROM lineitem)"""
PARTS = """parts AS (
  SELECT 'function:p' || p_partkey AS id, p_name AS name, p_brand || '::' || p_name AS qualified_name, 'brand/' || p_brand AS file_path,
    p_type AS docstring, p_name || '(' || p_size || ')' AS signature, p_size > 25 AS is_exported, p_partkey AS ord FROM part)"""
NODES = """nodes AS (
  SELECT 'function:p' || p_partkey AS id, 'function' AS kind, p_name AS name, 'brand/' || p_brand AS file_path, p_size > 25 AS is_exported, p_partkey AS ord FROM part
  UNION ALL SELECT 'class:s' || s_suppkey, 'class', s_name, 'nation/' || s_nationkey, true, s_suppkey FROM supplier
  UNION ALL SELECT 'method:c' || c_custkey, 'method', c_name, 'tests/' || c_nationkey, true, c_custkey FROM customer
  UNION ALL SELECT 'namespace:n' || n_nationkey, 'namespace', n_name, 'region/' || n_regionkey, true, n_nationkey FROM nation
  UNION ALL SELECT 'function:o' || o_orderkey, 'function', 'order_' || o_orderkey, 'customer/' || o_custkey, true, o_orderkey FROM orders)"""


@query(
    """SELECT arg_max(p_partkey, p_partkey) AS part, 'function:' || left(sha256('brand/' || p_brand || ':function:' || p_name), 32) AS id, count(*) AS n
    FROM part GROUP BY p_brand, p_name"""
)
def node_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nodes: equal names in one file share an id, and the later one wins (M01, id rule)."""
    rows = bridge.table(spark, sf_dir, "part").select("p_partkey", node_id(F.lit("function"), F.concat(F.lit("brand/"), "p_brand"), F.col("p_name")).alias("id"), F.col("p_partkey").alias("ord"))
    sizes = rows.groupBy("id").agg(F.count("*").alias("n"))
    return graph.upsert_latest(rows).join(sizes, "id").select(F.col("p_partkey").alias("part"), "id", "n")


@query("SELECT p_partkey, 'function:' || left(sha256('brand/' || p_brand || ':function:' || p_name), 32) AS id FROM part")
def node_id_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node ids of all parts."""
    return bridge.table(spark, sf_dir, "part").select("p_partkey", node_id(F.lit("function"), F.concat(F.lit("brand/"), "p_brand"), F.col("p_name")).alias("id"))


@query(r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS body_hash FROM documents")
def body_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body hashes of all documents."""
    return bridge.table(spark, sf_dir, "documents").select("doc_id", body_hash(F.col("text")).alias("body_hash"))


@query(
    """SELECT 'function:o' || l_orderkey AS source, 'function:p' || l_partkey AS target FROM lineitem
    WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)"""
)
def edges_with_both_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-to-part edges where the order is finished and the part is exported."""
    t = lambda n: bridge.table(spark, sf_dir, n)
    e = t("lineitem").select(bridge.key("function:o", "l_orderkey").alias("source"), bridge.key("function:p", "l_partkey").alias("target"))
    nodes = t("orders").filter("o_orderstatus = 'F'").select(bridge.key("function:o", "o_orderkey").alias("id")).unionByName(t("part").filter("p_size > 25").select(bridge.key("function:p", "p_partkey").alias("id")))
    return graph.valid_edges(e, nodes)


@query(f"WITH {CALLS} SELECT target AS id, source AS caller FROM calls WHERE target LIKE 'function:p%'")
def callers_of_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who calls each part."""
    return graph.callers(bridge.edges(spark, sf_dir), bridge.parts(spark, sf_dir))


@query(f"WITH {CALLS} SELECT source AS id, target AS callee FROM calls WHERE source IN (SELECT 'function:o' || o_orderkey FROM orders)")
def callees_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each order calls."""
    orders = bridge.table(spark, sf_dir, "orders").select(bridge.key("function:o", "o_orderkey").alias("id"))
    return graph.callees(bridge.edges(spark, sf_dir), orders)


@query(
    f"""WITH {CALLS} SELECT id, sum(i)::BIGINT AS n_callers, sum(o)::BIGINT AS n_callees FROM (
    SELECT target AS id, 1 AS i, 0 AS o FROM calls UNION ALL SELECT source, 0, 1 FROM calls) GROUP BY id"""
)
def caller_callee_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers and callees of every node."""
    return graph.link_counts(bridge.edges(spark, sf_dir))


IMPACT = f"""WITH {CALLS},
l1 AS (SELECT target AS root, source AS id FROM calls WHERE target LIKE 'function:p%'),
l2 AS (SELECT DISTINCT l1.root, c.source AS id FROM l1 JOIN calls c ON c.target = l1.id ANTI JOIN l1 x ON x.root = l1.root AND x.id = c.source),
found AS (SELECT root, id, 1 AS depth FROM l1 UNION ALL SELECT root, id, 2 FROM l2 WHERE root <> id)"""


@query(IMPACT + " SELECT root, depth, count(*) AS n, min(id) AS first_id FROM found GROUP BY root, depth")
def impact_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes a change of each part affects, over two steps."""
    found = graph.impact(bridge.edges(spark, sf_dir), bridge.parts(spark, sf_dir), 2)
    return found.groupBy("root", "depth").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(
    IMPACT + """ SELECT p_brand AS brand, id, min(depth)::INT AS depth, (min({'d': depth, 'r': root})).r AS root
    FROM found JOIN part ON root = 'function:p' || p_partkey GROUP BY p_brand, id"""
)
def impact_multi_root_min_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a change of each brand's file affects: all its parts are roots; least depth, first root."""
    parts = bridge.table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"))
    found = graph.nearest_roots(bridge.calls(spark, sf_dir), "function:p", parts, 2, ["brand"], lambda r: F.concat(F.lit("function:p"), r.cast("string")))
    return reduce(DataFrame.unionByName, [rows.withColumn("id", bridge.key(kind, "id")) for kind, rows in found.items()])


@query(
    f"""WITH {CALLS}, big AS (SELECT 'function:o' || o_orderkey AS id FROM orders WHERE o_totalprice > 250000 UNION ALL SELECT 'method:c' || c_custkey FROM customer WHERE c_acctbal > 0)
    SELECT source, target FROM calls WHERE source IN (SELECT id FROM big) AND target IN (SELECT id FROM big)"""
)
def induced_subgraph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls among large orders and customers in credit."""
    t = lambda n: bridge.table(spark, sf_dir, n)
    ids = t("orders").filter("o_totalprice > 250000").select(bridge.key("function:o", "o_orderkey").alias("id")).unionByName(t("customer").filter("c_acctbal > 0").select(bridge.key("method:c", "c_custkey").alias("id")))
    return graph.induced(bridge.edges(spark, sf_dir).filter("kind = 'calls'"), ids).select("source", "target").distinct()


REFS = """refs AS (
  SELECT o_orderkey AS ref_id, 'function:o' || o_orderkey AS from_node_id, 'lib.' || n.p_name AS reference_name, 'brand/' || b.p_brand AS file_path
  FROM orders JOIN part b ON b.p_partkey = o_custkey JOIN part n ON n.p_partkey = o_orderkey % (SELECT count(*) FROM part)),
imports AS (SELECT DISTINCT 'brand/' || a.p_brand AS file_path, 'brand/' || b.p_brand AS imported_path FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_type = b.p_type AND a.p_name < b.p_name)"""


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order refers to a part's name from the file of another part."""
    p = bridge.table(spark, sf_dir, "part")
    n = p.count()
    o = bridge.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("b_key"), (F.col("o_orderkey") % n).alias("n_key"))
    o = o.join(p.select(F.col("p_partkey").alias("b_key"), "p_brand"), "b_key").join(p.select(F.col("p_partkey").alias("n_key"), "p_name"), "n_key")
    return o.select(
        F.col("o_orderkey").alias("ref_id"), bridge.key("function:o", "o_orderkey").alias("from_node_id"), F.concat(F.lit("lib."), "p_name").alias("reference_name"),
        F.lit("calls").alias("reference_kind"), F.concat(F.lit("brand/"), "p_brand").alias("file_path"),
    )


def _imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand imports another if some name of it comes before one of the other's, among parts of one size and type: then its least one before the other's greatest."""
    p = bridge.table(spark, sf_dir, "part").groupBy("p_size", "p_type", "p_brand").agg(F.min("p_name").alias("least"), F.max("p_name").alias("most"))
    a, b = p.select("p_size", "p_type", "least", F.col("p_brand").alias("b1")), p.select("p_size", "p_type", "most", F.col("p_brand").alias("b2"))
    j = a.join(b, ["p_size", "p_type"]).filter("least < most")
    return j.select(F.concat(F.lit("brand/"), "b1").alias("file_path"), F.concat(F.lit("brand/"), "b2").alias("imported_path")).distinct()


PICK = f"""WITH {PARTS}, {REFS},
met AS (
  SELECT r.ref_id, p.id AS target, p.file_path = r.file_path AS same, p.is_exported AS exp, p.ord, i.imported_path IS NOT NULL AS imp
  FROM refs r JOIN parts p ON p.name = substr(r.reference_name, 5) LEFT JOIN imports i ON i.file_path = r.file_path AND i.imported_path = p.file_path),
picked AS (
  SELECT ref_id, arg_min(target, ord) FILTER (same) AS p1,
    coalesce(CASE WHEN count(*) FILTER (imp) = 1 THEN max(target) FILTER (imp) END, CASE WHEN count(*) FILTER (imp AND exp) = 1 THEN max(target) FILTER (imp AND exp) END) AS p2,
    CASE WHEN count(*) = 1 THEN max(target) END AS p3, CASE WHEN count(*) FILTER (exp) = 1 THEN max(target) FILTER (exp) END AS p4
  FROM met GROUP BY ref_id)
SELECT ref_id, coalesce(p1, p2, p3, p4) AS target,
  CASE WHEN p1 IS NOT NULL THEN 'same_file' WHEN p2 IS NOT NULL THEN 'imported' WHEN p3 IS NOT NULL THEN 'unique' ELSE 'unique_exported' END AS rule
FROM picked WHERE coalesce(p1, p2, p3, p4) IS NOT NULL"""


@query(PICK)
def resolve_best_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names bound to parts: same file, imported, unique, unique exported."""
    return graph.resolve(_refs(spark, sf_dir), bridge.parts(spark, sf_dir), _imports(spark, sf_dir))


@query(
    """WITH met AS (SELECT o_orderkey AS ref_id, p_partkey, p_size > 48 AS exp FROM orders JOIN part ON p_name || p_type = (SELECT any_value(p_name || p_type) FROM part q WHERE q.p_partkey = o_custkey)),
    g AS (SELECT ref_id, count(*) AS n, count(*) FILTER (exp) AS e, max(p_partkey) FILTER (exp) AS x, max(p_partkey) AS y FROM met GROUP BY ref_id)
    SELECT ref_id, 'function:p' || CASE WHEN n = 1 THEN y ELSE x END AS target FROM g WHERE n = 1 OR e = 1"""
)
def resolve_unique_exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are unique, or have a single exported bearer (W06, last steps)."""
    p = bridge.table(spark, sf_dir, "part").withColumn("name", F.concat("p_name", "p_type"))
    nodes = p.select(bridge.key("function:p", "p_partkey").alias("id"), F.lit("function").alias("kind"), "name", F.lit("lib").alias("file_path"), (F.col("p_size") > 48).alias("is_exported"), F.col("p_partkey").alias("ord"))
    refs = bridge.table(spark, sf_dir, "orders").join(p.select(F.col("p_partkey").alias("o_custkey"), "name"), "o_custkey")
    refs = refs.select(F.col("o_orderkey").alias("ref_id"), F.lit("").alias("from_node_id"), F.col("name").alias("reference_name"), F.lit("references").alias("reference_kind"), F.lit("app").alias("file_path"))
    return graph.resolve(refs, nodes).select("ref_id", "target")


@query(
    """WITH links AS (
      SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), '/+$', '') AS file, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
    files AS (SELECT DISTINCT file AS path FROM links),
    cand AS (
      SELECT page_id, file, pos, rtrim(CASE WHEN contains(file, '/') THEN regexp_extract(file, '^(.*)/[^/]*$', 1) || '/' ELSE '' END || regexp_extract(split_part(file, '/', -1), '^[0-9]+') || s, '/') AS c
      FROM (SELECT DISTINCT page_id, file FROM links), (VALUES (0, ''), (1, '.html'), (2, '/index.html')) v(pos, s))
    SELECT page_id, file AS file_path, arg_min(c, pos) AS imported_path FROM cand JOIN files ON c = path GROUP BY page_id, file"""
)
def import_first_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page imports its own number, relative to its folder: as it is, as .html, or as an index."""
    links = bridge.page_links(spark, sf_dir).select("page_id", "file").distinct()
    number = F.regexp_extract(F.element_at(F.split("file", "/"), -1), "^[0-9]+", 0)
    refs = links.select(F.col("page_id").alias("ref_id"), F.col("file").alias("file_path"), F.concat(F.lit("./"), number).alias("specifier"))
    files = links.select(F.col("file").alias("path"))
    return graph.import_targets(refs, files, ("", ".html", "/index.html")).withColumnRenamed("ref_id", "page_id")


@query("SELECT l_orderkey, l_partkey, min(l_linenumber) AS first_line, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey")
def edge_dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-to-part edges once each, the first line's."""
    line = bridge.table(spark, sf_dir, "lineitem")
    e = line.select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), F.lit("calls").alias("kind"), F.col("l_linenumber").alias("ord"))
    n = e.groupBy("source", "target").agg(F.count("*").alias("n"))
    return graph.first_edges(e).join(n, ["source", "target"]).select(F.col("source").alias("l_orderkey"), F.col("target").alias("l_partkey"), F.col("ord").alias("first_line"), "n")


@query(
    f"""WITH {CALLS}, up AS (SELECT target AS seed, source AS id, row_number() OVER (PARTITION BY target ORDER BY source) AS n FROM calls WHERE target LIKE 'function:p%')
    SELECT seed, id, 'caller' AS relation FROM up WHERE n <= 3"""
)
def scope_hop_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three callers and callees of each part."""
    return graph.neighbourhood(bridge.edges(spark, sf_dir), bridge.parts(spark, sf_dir), 3)


@query(
    """WITH old AS (SELECT o_orderkey AS path, o_totalprice AS size FROM orders WHERE o_orderstatus <> 'O'),
    cur AS (SELECT o_orderkey AS path, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END AS size FROM orders WHERE o_orderpriority <> '5-LOW')
    SELECT coalesce(old.path, cur.path) AS path, CASE WHEN old.path IS NULL THEN 'added' WHEN cur.path IS NULL THEN 'deleted' ELSE 'edited' END AS change
    FROM old FULL JOIN cur ON old.path = cur.path WHERE old.path IS NULL OR cur.path IS NULL OR old.size <> cur.size"""
)
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files: those not open were known, those of low priority are gone, urgent ones were edited."""
    o = bridge.table(spark, sf_dir, "orders")
    row = lambda df, size: df.select(F.col("o_orderkey").alias("path"), size.alias("size"), F.lit(0.0).alias("modified_at"))
    price = F.col("o_totalprice")
    current = row(o.filter("o_orderpriority <> '5-LOW'"), F.when(F.col("o_orderpriority") == "1-URGENT", price + 1).otherwise(price))
    return graph.changed_files(row(o.filter("o_orderstatus <> 'O'"), price), current)


@query(
    f"""WITH {NODES}, {CALLS}, gone AS (SELECT id FROM nodes WHERE file_path IN (SELECT 'brand/' || p_brand FROM part GROUP BY p_brand HAVING avg(p_size) > 25.5))
    SELECT (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT id FROM gone)) AS n_nodes,
      (SELECT count(*) FROM calls WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone)) AS n_edges"""
)
def delete_files_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and calls left when the files of brands with large parts are deleted."""
    paths = bridge.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg("p_size").alias("a")).filter("a > 25.5").select(F.concat(F.lit("brand/"), "p_brand").alias("file_path"))
    nodes, edges = bridge.nodes(spark, sf_dir), bridge.edges(spark, sf_dir).filter("kind = 'calls'")
    refs = spark.createDataFrame([], "from_node_id string")
    n, e, _ = graph.delete_files(nodes, edges, refs, paths)
    # calls are taken once when they lie by target, after those of lost nodes have gone
    e = e.select("source", "target").distinct()
    both = n.select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(e.select(F.lit(0).alias("a"), F.lit(1).alias("b")))
    return both.agg(F.sum("a").alias("n_nodes"), F.sum("b").alias("n_edges"))


@query("SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens of every document (trap 2)."""
    return bridge.table(spark, sf_dir, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


@query(
    f"""WITH {CALLS}, n AS (SELECT target AS id, source AS caller, ceil((length(source) + 20) / 4.0)::BIGINT AS cost, row_number() OVER (PARTITION BY target ORDER BY source) AS rn FROM calls WHERE target LIKE 'function:p%'),
    s AS (SELECT *, sum(cost) OVER (PARTITION BY id ORDER BY caller) AS spent FROM n) SELECT id, caller, cost, spent::BIGINT AS spent FROM s WHERE spent <= 60"""
)
def budget_prefix_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers of each part, in order, as long as 60 tokens reach."""
    from ..operators.search import budget_prefix

    rows = graph.callers(bridge.edges(spark, sf_dir), bridge.parts(spark, sf_dir))
    return budget_prefix(rows, F.concat(F.col("caller"), F.lit(" " * 20)), 60, ["id"], "caller").select("id", "caller", "cost", "spent")


@query(
    """WITH RECURSIVE items AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS i, l_quantity::BIGINT AS cost FROM lineitem),
    fold AS (SELECT k, 0::BIGINT AS i, 0::BIGINT AS spent, 0::BIGINT AS n FROM (SELECT DISTINCT k FROM items)
      UNION ALL SELECT f.k, t.i, CASE WHEN spent + cost <= 60 THEN spent + cost ELSE spent END, CASE WHEN spent + cost <= 60 THEN n + 1 ELSE n END FROM fold f JOIN items t ON t.k = f.k AND t.i = f.i + 1)
    SELECT k AS l_orderkey, arg_max(spent, i) AS spent, arg_max(n, i) AS n_kept FROM fold GROUP BY k"""
)
def budget_skip_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each order that fit in 60 units when those too large are skipped."""
    from ..operators.search import budget_fold

    line = bridge.table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("int"))
    out = budget_fold(line, F.repeat(F.lit("x"), F.col("q") * 4), 60, ["l_orderkey"], "l_linenumber", "l_partkey")
    return out.select("l_orderkey", "spent", F.size("kept").cast("long").alias("n_kept"))


@query(
    f"""WITH {NODES}, {CALLS} SELECT kind, count(*) AS n_nodes, count(DISTINCT file_path) AS n_files, sum(coalesce(o.n, 0))::BIGINT AS n_calls
    FROM nodes LEFT JOIN (SELECT source AS id, count(*) AS n FROM calls GROUP BY source) o USING (id) GROUP BY kind"""
)
def build_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, files and outgoing calls by kind of node."""
    out = graph.link_counts(bridge.edges(spark, sf_dir)).select("id", "n_callees")
    n = bridge.nodes(spark, sf_dir).join(out, "id", "left")
    return n.groupBy("kind").agg(F.count("*").alias("n_nodes"), F.count_distinct("file_path").alias("n_files"), F.sum(F.coalesce("n_callees", F.lit(0))).alias("n_calls"))


@query(
    """WITH p AS (SELECT string_split(regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/+$', ''), '/') AS s FROM pages)
    SELECT s[1] AS folder, count(*) FILTER (len(s) - 1 <= 4) AS n, 'other' AS category FROM p WHERE len(s) > 1 GROUP BY s[1]"""
)
def page_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts as top folders by number of pages."""
    from ..sources import files

    path = F.regexp_replace(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1), "/+$", "")
    return files.folders(bridge.table(spark, sf_dir, "pages").select(path.alias("path")))
