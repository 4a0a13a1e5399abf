"""The kept index and the versioned store against plain versions."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.functions.store import Versions
from graphloom.operators import index as ix
from graphloom.operators import search
from graphloom.operators.index import Index

ROW = "id string, name string, qualified_name string, docstring string, signature string"


def row(i, name, doc=None):
    return (f"function:{i}", name, f"m::{name}", doc, f"{name}(x)")


def frame(spark, rows):
    return spark.createDataFrame(rows, ROW)


def scores(df):
    return {r["id"]: round(r["score"], 12) for r in df.collect()}


def random_rows(rng, n, start=0):
    words = ["red", "redo", "reddish", "blue", "bolt", "bo", "b", "x9", "99", "zebra"]
    return [row(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))), rng.choice([None, "", "Red bolt, BLUE?", " ".join(rng.choice(words) for _ in range(9))])) for i in range(start, start + n)]


def test_index_equals_a_scan_through_updates(spark, tmp_path):
    rng = random.Random(1)
    rows = {r[0]: r for r in random_rows(rng, 60)}
    index = Index(spark, str(tmp_path), tuple(search.WEIGHTS)).build(frame(spark, list(rows.values())))
    for step in range(4):
        if step:
            changed = random_rows(rng, 8, rng.randrange(60)) + [row(1000 + step, "red new")]
            gone = [x for x in rng.sample(sorted(rows), 5) if x not in {r[0] for r in changed}]
            index.update(frame(spark, changed), spark.createDataFrame([(g,) for g in gone], "id string"))
            rows = {k: r for k, r in rows.items() if k not in gone} | {r[0]: r for r in changed}
        for q in ("red", "re bo", "b 99*", "nothing", "RED AND x9"):
            assert scores(search.bm25(index, q)) == scores(search.bm25(frame(spark, list(rows.values())), q)), (step, q)
        seen = {r["term"]: r["n_rows"] for r in index.frequencies().collect()}
        words = [set(re.findall("[a-z0-9]+", " ".join(x or "" for x in r).lower())) for r in rows.values()]
        assert seen == {w: sum(w in x for x in words) for w in set().union(*words)}
    assert Index(spark, str(tmp_path), tuple(search.WEIGHTS)).size() == index.size()


def test_only_the_terms_own_files_are_read(spark, tmp_path):
    rng = random.Random(2)
    index = Index(spark, str(tmp_path), tuple(search.WEIGHTS)).build(frame(spark, random_rows(rng, 200)))
    read = index.postings(["red", "99"]).select(F.col("_metadata.file_path").alias("f")).distinct().collect()
    assert {re.search("/p=([^/]+)/", r["f"])[1] for r in read} == {"re", "99"}
    assert {r["term"] for r in index.postings(["b"]).collect()} == {"b", "bo", "bolt", "blue"}


def test_an_empty_index(spark, tmp_path):
    index = Index(spark, str(tmp_path), tuple(search.WEIGHTS)).build(frame(spark, []))
    assert index.size() == (0, 0) and search.bm25(index, "red").count() == 0
    tasks = spark.createDataFrame([(1, ["red"])], "task int, terms array<string>")
    assert index.retrieve(tasks, 3, search.WEIGHTS).count() == 0
    index.update(frame(spark, [row(1, "red")]))
    assert search.bm25(index, "red").count() == 1


@pytest.mark.parametrize("first", [1, 2])
def test_tasks_get_their_best_rows(spark, tmp_path, monkeypatch, first):
    monkeypatch.setattr(ix, "BLOCK", 2)
    monkeypatch.setattr(ix, "FIRST", first)
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(40)] + ["common"] * 30
    rows = [(f"{i:04}", " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 60)))) for i in range(400)]
    rows += [(f"{1000 + i}", rows[5][1]) for i in range(30)] + [("none", None), ("empty", "")]
    index = Index(spark, str(tmp_path), ("text",)).build(spark.createDataFrame(rows, "id string, text string"))
    tasks = [(t, rng.sample([f"w{i}" for i in range(40)] + ["common", "w", "w1", "absent"], rng.randrange(1, 7))) for t in range(25)] + [(99, []), (98, ["absent"]), (97, ["w39", "common"])]
    df = spark.createDataFrame(tasks, "task int, terms array<string>")
    got = sorted((r["task"], r["rank"], r["id"], round(r["score"], 6)) for r in index.retrieve(df, 7, {"text": 1.0}).collect())
    toks = {i: (t or "").split() for i, t in rows}
    mean, n, want = sum(map(len, toks.values())) / len(toks), len(toks), []
    for t, terms in tasks:
        s = {}
        for p in terms:
            f = {i: sum(w.startswith(p) for w in x) for i, x in toks.items()}
            d = sum(v > 0 for v in f.values())
            idf = max(math.log((n - d + 0.5) / (d + 0.5)), 1e-6)
            for i, v in f.items():
                if v:
                    s[i] = s.get(i, 0) + idf * v * 2.2 / (v + 1.2 * (0.25 + 0.75 * len(toks[i]) / mean))
        best = sorted((-round(v, 9), i) for i, v in s.items())[:7]
        want += [(t, k + 1, i, round(v, 6)) for k, (v, i) in enumerate(best)]
    assert got == sorted(want)


def test_readers_see_one_version(spark, tmp_path):
    store = Versions(spark, str(tmp_path))
    assert store.current() is None
    table = lambda n: {"a": spark.range(n).toDF("x"), "b": spark.range(n).toDF("y")}
    store.write(table(3))
    old = store.current()
    store.write(table(5), numbers={"n": 5})
    # a writer that fails before the end changes nothing
    with pytest.raises(Exception):  # noqa: B017
        store.write({"a": spark.range(9), "b": spark.range(1).select(F.raise_error(F.lit("broken")).alias("y"))})
    now = Versions(spark, str(tmp_path)).current()
    read = lambda v: [sum(spark.read.parquet(f).count() for f in v["folders"][t]) for t in ("a", "b")]
    assert read(old) == [3, 3] and read(now) == [5, 5] and now["numbers"] == {"n": 5}
    store.write(table(2), keep=True)
    assert read(store.current()) == [7, 7] and read(now) == [5, 5]
