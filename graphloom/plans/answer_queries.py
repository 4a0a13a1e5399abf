"""Answers under a token budget, as JSON lines: impact, scope, get, and what can't be answered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import composite, graph, lookup, search
from ..sources import bridge
from .graph_queries import CALLS, NODES
from .registry import query
from .search_queries import TASK, parts_index, scope_sql

ALL_EDGES = f"""{CALLS}, every_edge AS (SELECT source, target, 'calls' AS kind FROM calls
  UNION SELECT 'namespace:n' || c_nationkey, 'method:c' || c_custkey, 'contains' FROM customer UNION SELECT 'namespace:n' || s_nationkey, 'class:s' || s_suppkey, 'contains' FROM supplier)"""


def _answer_sql(ctes: str, facts: str, command: str, budget: int, max_nodes: int, sections: tuple[str, ...] = ()) -> str:
    """facts: a query for ord, id, record; sections: queries for ord, record; records are JSON texts. The edges are those of ALL_EDGES."""
    most = max(budget, 2 * composite.RESERVE)
    room = most - composite.RESERVE
    more = "".join(f" UNION ALL SELECT {k}, ord, record FROM ({s})" for k, s in enumerate(sections, 1))
    cost = lambda c: f"ceil(length({c}) / 4.0)::BIGINT"
    meta = f"to_json({{'type': 'meta', 'schemaVersion': {composite.SCHEMA_VERSION}, 'command': '{command}', 'maxNodes': {max_nodes}, 'maxOutputTokens': {most}}})::VARCHAR"
    return f"""WITH RECURSIVE {ctes}, f AS ({facts}),
    ranked AS (SELECT *, row_number() OVER (ORDER BY ord, id) AS n FROM f), run AS (SELECT *, sum({cost('record')}) OVER (ORDER BY n) AS spent FROM ranked WHERE n <= {max_nodes}),
    kept AS (SELECT * FROM run WHERE spent <= {room}),
    rest AS (SELECT 0 AS section, '' AS ord, to_json({{'type': 'edge', 'kind': kind, 'source': source, 'target': target, 'provenance': 'static'}})::VARCHAR AS record FROM every_edge
      WHERE source IN (SELECT id FROM kept) AND target IN (SELECT id FROM kept){more}),
    others AS (SELECT *, row_number() OVER (ORDER BY section, ord, record) AS i FROM rest),
    fold(i, spent, took) AS (SELECT 0::BIGINT, coalesce(max(spent), 0)::BIGINT, false FROM kept UNION ALL
      SELECT o.i, CASE WHEN fold.spent + {cost('o.record')} <= {room} THEN fold.spent + {cost('o.record')} ELSE fold.spent END, fold.spent + {cost('o.record')} <= {room} FROM fold JOIN others o ON o.i = fold.i + 1),
    taken AS (SELECT section, record, row_number() OVER (PARTITION BY section ORDER BY i) - 1 AS n FROM others JOIN fold USING (i) WHERE took),
    sums AS (SELECT (SELECT count(*) FROM f) AS matched, (SELECT count(*) FROM kept) AS facts, (SELECT count(*) FROM taken WHERE section = 0) AS edges, (SELECT count(*) FROM taken) AS took,
      (SELECT count(*) FROM others) AS others, (SELECT max(spent) FROM fold) AS spent)
    SELECT 0 AS part, 0::BIGINT AS n, {meta} AS record UNION ALL SELECT 1, n - 1, record FROM kept UNION ALL SELECT section + 2, n, record FROM taken
    UNION ALL SELECT {3 + len(sections)}, 0, to_json({{'type': 'summary', 'matchedNodes': matched, 'returnedNodes': facts, 'returnedEdges': edges, 'maxOutputTokens': {most},
      'truncated': facts < matched OR took < others OR {str(most > budget).lower()}, 'estimatedOutputTokens': spent + {composite.RESERVE}}})::VARCHAR FROM sums"""


_IMPACT = f"""{ALL_EDGES}, root AS (SELECT target AS id FROM calls WHERE target LIKE 'function:p%' GROUP BY target ORDER BY count(DISTINCT source) DESC, target LIMIT 1),
    l1 AS (SELECT DISTINCT source AS id FROM calls JOIN root ON target = root.id), l2 AS (SELECT DISTINCT source AS id FROM calls JOIN l1 ON target = l1.id WHERE source NOT IN (SELECT id FROM l1)),
    found AS (SELECT id, 1 AS depth FROM l1 UNION ALL SELECT id, 2 FROM l2)"""
_GROUNDED = """SELECT 'customer/' || o_custkey || ' function:o' || o_orderkey AS ord, to_json({'type': 'grounding', 'file': 'customer/' || o_custkey, 'node': 'function:o' || o_orderkey, 'depth': depth})::VARCHAR AS record
    FROM orders JOIN found ON found.id = 'function:o' || o_orderkey"""


@query(_answer_sql(_IMPACT, "SELECT depth * 1000000 AS ord, found.id, to_json({'type': 'fact', 'id': found.id, 'depth': depth, 'root': root.id})::VARCHAR AS record FROM found, root", "impact", 1200, 20, (_GROUNDED,)))
def impact_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer, as JSON lines within 1,200 tokens, to: what does a change of the most called part affect, and which documents rest on that."""
    edges = bridge.edges(spark, sf_dir)
    roots = graph.link_counts(edges).filter("id like 'function:p%'").orderBy(F.desc("n_callers"), "id").limit(1).select("id")
    found = composite.checkpoint(graph.merged_impact(graph.impact(edges, roots, 2)))
    facts = found.select("id", (F.col("depth") * 1_000_000).alias("ord"), F.struct("id", "depth", "root").alias("record"))
    base = bridge.table(spark, sf_dir, "orders").select(bridge.key("customer/", "o_custkey").alias("file"), bridge.key("function:o", "o_orderkey").alias("node_id"))
    grounded = lookup.grounded_files(found, base).select(F.concat_ws(" ", "file", "node_id").alias("ord"), F.struct("file", F.col("node_id").alias("node"), "depth").alias("record"))
    return composite.answer(facts, edges, "impact", 1200, 20, [("grounding", grounded)])


_ASKED = ("function:p1", "class:s2", "function:nowhere", "namespace:n3", "method:gone", "method:c4")


@query(
    _answer_sql(
        f"{ALL_EDGES}, {NODES}, asked AS (SELECT unnest({list(_ASKED)}) AS id)",
        "SELECT id AS ord, id, to_json({'type': 'fact', 'id': id, 'kind': kind, 'name': name, 'file': file_path})::VARCHAR AS record FROM asked JOIN nodes USING (id)", "get", 600, 10,
        ("SELECT id AS ord, to_json({'type': 'error', 'code': 'NODE_NOT_FOUND', 'target': id})::VARCHAR AS record FROM asked WHERE id NOT IN (SELECT id FROM nodes)",),
    )
)
def get_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer to a request for six nodes, two of which don't exist."""
    asked = lookup.nodes_by_id(bridge.nodes(spark, sf_dir), spark.createDataFrame([(i,) for i in _ASKED], "id string"))
    asked = composite.checkpoint(asked)
    facts = asked.filter("found").select("id", F.col("id").alias("ord"), F.struct("id", "kind", "name", F.col("file_path").alias("file")).alias("record"))
    return composite.answer(facts, bridge.edges(spark, sf_dir), "get", 600, 10, [("error", composite.not_found(asked))])


@query(
    _answer_sql(
        f"{ALL_EDGES}, scoped AS ({scope_sql()})",
        "SELECT -score AS ord, id, to_json({'type': 'fact', 'id': id, 'category': category, 'score': score::VARCHAR, 'reasons': reasons})::VARCHAR AS record FROM scoped", "scope", 500, 6,
    )
)
def scope_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer to a task within 500 tokens: what it is about, and the calls between."""
    nodes = bridge.parts(spark, sf_dir)
    every = bridge.nodes(spark, sf_dir).filter("kind != 'method'")
    found = composite.checkpoint(search.scope(nodes.select(*every.columns), bridge.edges(spark, sf_dir), TASK, neighbours=every, index=parts_index(spark, sf_dir)))
    record = F.struct("id", "category", F.col("score").cast("string").alias("score"), F.array_join("reasons", ",").alias("reasons"))
    return composite.answer(found.select("id", (-F.col("score")).alias("ord"), record.alias("record")), bridge.edges(spark, sf_dir), "scope", 500, 6)


@query(
    _answer_sql(
        f"{ALL_EDGES}, {NODES}, meant AS (SELECT id FROM nodes WHERE name = 'red widget')", "SELECT id AS ord, id, '' AS record FROM meant WHERE false", "impact", 400, 10,
        ("SELECT 'red widget' AS ord, to_json({'type': 'error', 'code': 'TARGET_AMBIGUOUS', 'target': 'red widget', 'candidates': count(*)})::VARCHAR AS record FROM meant HAVING count(*) > 1",),
    )
)
def ambiguous_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer to a request for the impact of a name that many parts bear: an error that tells how many."""
    meant = bridge.nodes(spark, sf_dir).filter("name = 'red widget'").select("id")
    none = meant.limit(0).select("id", F.col("id").alias("ord"), F.struct("id").alias("record"))
    return composite.answer(none, bridge.edges(spark, sf_dir), "impact", 400, 10, [("error", composite.ambiguous("red widget", meant))])
