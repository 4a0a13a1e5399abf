"""The pipeline against plain versions of its stages, each on what the one before it kept."""

import re

import duckdb
import xxhash

import corpus_pipeline
from graphloom.llm import quality, queries, sharding, sql

SF = "/root/testdata/sf0.001"


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def one_of_each(rows):
    """Ids of the documents that stay: of those that links of 75 % join, the smallest."""
    sets = {}
    for i, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", low(text))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return {i for i in ids if root(i) == i}


def no_benchmark(rows, items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
    windows = set()
    for t in items:
        w = words(t)
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
    sizes, kept = {len(x) for x in windows}, set()
    for i, text in rows:
        w = words(text)
        hit = {p for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for p in range(k, k + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            kept.add(i)
    return kept


def mixture(folder):
    """Ids that op5's SQL selects with the stage's parameters: 90 % of the tokens, one epoch."""
    text = sql.ORACLES["op5_mixing"]
    for old, new in (("sum(n_tokens) * 2)", "sum(n_tokens) * 1)"), ("* 600 // 1000", "* 900 // 1000")):
        assert text.count(old) == 1
        text = text.replace(old, new)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/*.parquet')")
    return {r[0] for r in con.execute(f"SELECT DISTINCT doc_id FROM ({text})").fetchall()}


def test_run_equals_plain_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    given = {r["doc_id"]: r for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        if name == "quality":
            want = {r["doc_id"] for r in quality.classify(docs).collect() if r["kept"]}
        elif name == "near_duplicates":
            want = one_of_each(rows)
        elif name == "decontamination":
            want = no_benchmark(rows, items)
        elif name == "mixture":
            want = mixture(f"{tmp_path}/{k - 1}")
        else:
            want = {i for i, _ in rows}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        columns, docs = docs.columns, spark.read.parquet(f"{tmp_path}/{k}")
        got = docs.collect()
        assert {r["doc_id"] for r in got} == want and len(got) == len(want), name
        # a stage narrows what it is given, and changes nothing in what it keeps
        assert name == "sharding" or docs.columns == columns and 0 < len(got) <= len(rows)
        assert name in ("sharding", "decontamination") or len(got) < len(rows), name
        assert all(r[c] == given[r["doc_id"]][c] for r in got for c in given[r["doc_id"]].asDict())
    owner = sharding.lookup_table(sharding.SHARDS)
    for r in got:
        h = xxhash.xxh64_intdigest(str(r["doc_id"]).encode(), seed=42)
        slot = (h - (1 << 64) if h >> 63 else h) % sharding.TABLE_SIZE
        assert (r["slot"], r["shard"]) == (slot, sharding.SHARDS[owner[slot]])
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, got))


def test_every_query_has_a_name_of_its_operator():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
