"""Work that grows with the input and not with the square of what shares a name."""

import re
from hashlib import sha256

import duckdb
import oracle
import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph, identity
from graphloom.operators.index import Index
from graphloom.plans import drift_queries, graph_queries, identity_queries, registry
from graphloom.sources import bridge


@pytest.fixture
def plain(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")


def most_rows(df):
    """The rows that df returns, and the most that a step of its plan makes."""
    rows, most = df.collect(), 0
    steps = [df._jdf.queryExecution().executedPlan()]
    while steps:
        step = steps.pop()
        steps += [step.children().apply(k) for k in range(step.children().size())]
        n = step.metrics().get("numOutputRows")
        most = max(most, n.get().value() if n.isDefined() else 0)
    return rows, most


def test_routes_meet_names_not_their_bearers(plain):
    """F3."""
    refs = plain.range(500).select(F.col("id").alias("ref_id"), F.lit("f").alias("reference_name"), F.concat(F.lit("file"), "id").alias("file_path"))
    nodes = plain.range(400).select(F.concat(F.lit("n"), "id").alias("id"), F.lit("function").alias("kind"), F.lit("f").alias("name"), F.concat(F.lit("file"), F.greatest(F.lit(100), "id")).alias("file_path"))
    rows, most = most_rows(graph.route_targets(refs, nodes))
    assert {(r["ref_id"], r["target"]) for r in rows} == {(k, f"n{k}") for k in range(101, 400)} and most <= 1000


def test_imports_of_brands_meet_brands_not_parts(plain, tmp_path):
    """F5."""
    parts = plain.range(600).select(F.col("id").alias("p_partkey"), F.concat(F.lit("n"), F.col("id") % 3).alias("p_name"), F.concat(F.lit("b"), F.col("id") % 2).alias("p_brand"), F.lit("t").alias("p_type"), F.lit(1).alias("p_size"))
    parts.write.parquet(f"{tmp_path}/part.parquet")
    rows, most = most_rows(graph_queries._imports(plain, str(tmp_path)))
    assert sorted(map(tuple, rows)) == [("brand/b0", "brand/b0"), ("brand/b0", "brand/b1"), ("brand/b1", "brand/b0"), ("brand/b1", "brand/b1")] and most <= 600


def test_imported_candidates_are_counted_by_file(plain):
    """F5."""
    nodes = plain.range(300).select(F.concat(F.lit("n"), "id").alias("id"), F.lit("function").alias("kind"), F.lit("f").alias("name"), F.concat(F.lit("m"), F.when(F.col("id") == 7, 1).otherwise(0)).alias("file_path"), F.lit(True).alias("is_exported"), F.col("id").alias("ord"))
    refs = plain.range(50).select(F.col("id").alias("ref_id"), F.lit("x").alias("from_node_id"), F.lit("f").alias("reference_name"), F.lit("calls").alias("reference_kind"), F.concat(F.lit("a"), "id").alias("file_path"))
    imports = refs.select("file_path", F.concat(F.lit("m"), F.col("ref_id") % 2).alias("imported_path"))
    rows, most = most_rows(graph.resolve(refs, nodes, imports))
    assert {tuple(r) for r in rows} == {(k, "n7", "imported") for k in range(1, 50, 2)} and most <= 1000


def test_seconds_are_rounded_as_by_sql(spark, tmp_path, monkeypatch):
    """a half second before a unit's end."""
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT * FROM (VALUES (1, TIMESTAMP '2024-01-01 00:09:59.7', 7, 'signup', 0.0, '{{}}'), (2, TIMESTAMP '2024-01-01 00:09:59.2', 7, 'view', 0.0, '{{}}'),
      (3, TIMESTAMP '2024-01-03 02:19:59.9', 7, 'view', 0.0, '{{}}'), (4, TIMESTAMP '2024-01-03 02:10:00', 7, 'view', 0.0, '{{}}'), (5, TIMESTAMP '2024-01-01 00:09:59.5', 7, 'signup', 0.0, '{{}}'), (6, TIMESTAMP '2024-01-03 02:11:00', 7, 'view', 0.0, '{{}}'))
      v(event_id, ts, user_id, event_type, value, props)) TO '{tmp_path}/events.parquet'""")
    monkeypatch.setattr(oracle, "SF", str(tmp_path))
    oracle.compare(spark, drift_queries.range_containment, registry.ORACLES["range_containment"])
    assert {(r["id"], r["n"]) for r in drift_queries.range_containment(spark, str(tmp_path)).collect()} == {(1, 2), (5, 2)}


def test_rows_of_one_file_are_dealt_out_before_their_postings_are_made(plain, tmp_path):
    """F7, F8, F9, F15, F18, F19."""
    rows = plain.range(0, 300, 1, 1).select(F.col("id").cast("string").alias("id"), F.lit("red red bolt").alias("name"))
    index = Index(plain, str(tmp_path), ("id", "name"))
    parts = index._parts(rows)
    assert parts["rows"].rdd.getNumPartitions() > 1
    index.build(rows)
    assert {tuple(r) for r in index.postings(["red"]).select("id", "n_tokens", "h_id", "h_name").collect()} == {(str(k), 4, 0, 2) for k in range(300)}


def test_parts_are_read_from_their_own_table(spark):
    """F7, F8, F9, F15, F18, F19."""
    assert {f.rsplit("/", 1)[1] for f in bridge.parts(spark, oracle.SF).inputFiles()} == {"part.parquet"}


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_edges_are_shuffled_once_for_each_direction(plain):
    """what is joined, taken once and cut by one end is shuffled by it once; the rest is one shuffle of the seeds or lost nodes each time."""
    plain.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ends = plain.range(60).select(F.concat(F.lit("n"), F.col("id") % 7).alias("source"), F.concat(F.lit("n"), F.col("id") % 5).alias("target"), F.lit("calls").alias("kind"))
        seeds = plain.range(3).select(F.concat(F.lit("n"), "id").alias("id"))
        near = graph.neighbourhood(ends, seeds, 2)
        assert shuffles(near) <= 6
        assert sorted(map(tuple, near.select("seed", "relation", "id").collect())) == [(f"n{s}", r, f"n{k}") for s in range(3) for r in ("callee", "caller") for k in range(2)]
        found = graph.impact(ends, seeds, 1)
        assert shuffles(found) <= 4
        assert {tuple(x) for x in found.collect()} == {(f"n{s}", f"n{k}", 1) for s in range(3) for k in range(7) if k != s}
        _, left, _ = graph.delete_files(seeds.withColumn("file_path", F.lit("f")), ends, seeds.toDF("from_node_id"), plain.createDataFrame([("f",)], "file_path string"))
        assert shuffles(left.select("source", "target").distinct()) == shuffles(left)
    finally:
        plain.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_impact_of_groups_shuffles_numbers_and_each_level_once(plain):
    """F2 of round 4: the three kinds of call, the roots and three levels, as numbers, and nothing written beside them."""
    plain.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        steps = graph_queries.impact_multi_root_min_depth(plain, oracle.SF)._jdf.queryExecution().executedPlan().toString().splitlines()
        assert not any("ExistingRDD" in x for x in steps)
        shuffled = [x for x in steps if "- Exchange hashpartitioning" in x]
        assert len(shuffled) <= 7 and all(re.search(r"hashpartitioning\(id#\d+L, \d+\)", x) for x in shuffled) and sum("ReusedExchange" in x for x in steps) >= 2
    finally:
        plain.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_impact_of_groups_makes_no_row_for_each_root(plain):
    """F2 of round 4: 50 roots of one group under 40 nodes, which call one another."""
    under, among = [(b, a) for a in range(40) for b in range(50)], [(b, a) for a in range(40) for b in range(40)]
    calls = {("r", "n"): plain.createDataFrame(under, "id long, caller long"), ("n", "n"): plain.createDataFrame(among, "id long, caller long")}
    roots = plain.range(50).select(F.lit("g").alias("g"), "id")
    rows, most = most_rows(graph.nearest_roots(calls, "r", roots, 2, ["g"])["n"])
    assert {tuple(r) for r in rows} == {("g", a, 1, 0) for a in range(40)} and most <= len(under) + 2 * len(among)


def test_impact_of_odd_keys_equals_sql(spark, tmp_path, monkeypatch):
    """F2 of round 4: parts twice, of no brand, of no key, keys below none and at the ends of their range, and calls of what isn't there."""
    con, top = duckdb.connect(), 2**63 - 1
    tables = {
        "part": f"VALUES (10, 'b1'), (10, 'b2'), (9, 'b1'), (9, 'b1'), (-3, 'b1'), ({top}, 'b2'), (4, NULL), (NULL, 'b1')|p_partkey, p_brand",
        "orders": f"VALUES (1, 7), ({top}, 7), ({-top}, 8), (3, NULL), (NULL, 9), (4, {top})|o_orderkey, o_custkey",
        "lineitem": f"VALUES (1, 10, 5), (1, 9, 5), (1, 9, 6), ({top}, -3, 5), ({-top}, {top}, 6), (3, 4, {top}), (4, 9, 9), (4, 77, 9), (2, NULL, 5)|l_orderkey, l_partkey, l_suppkey",
        "customer": "VALUES (7, 1)|c_custkey, c_nationkey", "supplier": "VALUES (5, 1)|s_suppkey, s_nationkey",
    }
    for name, said in tables.items():
        rows, columns = said.split("|")
        con.execute(f"COPY (SELECT {', '.join(c if c == ' p_brand' else c + '::BIGINT AS ' + c for c in columns.split(','))} FROM ({rows}) v({columns})) TO '{tmp_path}/{name}.parquet'")
    monkeypatch.setattr(oracle, "SF", str(tmp_path))
    oracle.compare(spark, graph_queries.impact_multi_root_min_depth, registry.ORACLES["impact_multi_root_min_depth"])


def test_hashes_are_made_where_the_trigrams_are(spark):
    """No trigram is handed to Python, and the values are those of hashlib."""
    texts = [["a", "b", "c", "d"], ["\u00e9\U0001f600", "\u00df" * 40, "x" * 200], ["r"] * 5, ["a", "b"], [], None]
    got = identity.minhash(spark.createDataFrame(list(enumerate(texts)), "id long, w array<string>"), F.col("w"))
    assert "Python" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "MapInArrow" not in plan
    for k, values, n in got.collect():
        w = texts[k] or []
        grams = ["\0".join(w[i : i + 3]) for i in range(len(w) - 2)]
        assert n == len(w) and values == [min([int(sha256(f"{i}\0{g}".encode()).hexdigest()[:8], 16) for g in grams], default=identity.EMPTY) for i in range(64)]


def test_missing_documents_meet_one_of_equal_ones(plain, tmp_path):
    """F10."""
    text = F.when(F.col("id") % 2 == 0, "").otherwise(F.repeat(F.lit("all is one text "), 9))
    source = F.when(F.col("id") >= 600, "src3").otherwise("src1")
    plain.range(900).select(F.col("id").alias("doc_id"), text.alias("text"), F.when(F.col("id") % 3 == 0, "en").otherwise("de").alias("lang"), source.alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    rows, most = most_rows(identity_queries.reconcile_verdict(plain, str(tmp_path)))
    # of equal ones the first by id, of the same language: 0 and 2 are empty, 1 and 3 are not
    want = {k: ("GONE", None) if k % 2 == 0 else ("MOVED", 3 if k % 3 == 0 else 1) for k in range(600, 900)}
    assert {r["id"]: (r["verdict"], r["node_id"]) for r in rows} == want and {r["score"] for r in rows} == {1.0} and most <= 20000


def test_near_copies_meet_once_for_each_pair(plain):
    """prints that share many bands make a row for each pair, not for each band of each pair."""
    top = 2**32 - 1
    prints = {k: [top - i for i in range(63)] + [k] for k in range(100)}
    prints |= {100: prints[7], 101: [1000 + i for i in range(62)] + [1, 2], 102: [2000 + i for i in range(62)] + [1, 2], 103: [3000 + i for i in range(63)] + [2]}
    d = plain.createDataFrame(list(prints.items()), "id long, minhash array<bigint>")
    rows, most = most_rows(identity.lsh_similarity(d))
    want = {(a, b, 63 / 64) for a in range(100) for b in range(a + 1, 100)} | {(7, 100, 1.0), (101, 102, 2 / 64)}
    assert set(map(tuple, rows)) == want and len(rows) == len(want) and most <= len(want)
    rows, most = most_rows(identity.lsh_pairs(d))
    assert sorted(map(tuple, rows)) == sorted(x[:2] for x in want) and most <= len(want)


def test_trigrams_are_made_where_they_are_hashed(spark):
    """no array of trigrams is handed over, and the values are those of the distinct trigrams, by themselves."""
    texts = ["a b c d", "\té\U0001f600\x0b\x0c" + "ß" * 40 + "\r\n" + "x" * 300 + " ", "r r r r r", "a\0b c\xa0d\x1fe f g h", "a b", " ", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("w", identity_queries.words())
    got = identity.minhash(rows, F.col("w"))
    assert "concat_ws" not in got._jdf.queryExecution().executedPlan().toString()
    least = {r["id"]: r["minhash"] for r in got.collect()}
    for k, grams in rows.select("id", identity.trigrams(F.col("w"))).collect():
        assert least[k] == [min([int(sha256(f"{i}\0{g}".encode()).hexdigest()[:8], 16) for g in grams], default=identity.EMPTY) for i in range(64)]
