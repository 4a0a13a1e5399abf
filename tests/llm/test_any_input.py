"""Every operator and stage on empty tables, nulls, repeated rows and columns that are named like its own helpers."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import chat, common, decontaminate, language, licences, line_rules, mixing, ngram_join, quality, sharding, warc

NAMES = "gone bad_id bad_key cut cut_id cut_key chosen_id key w n doc rep pos nr row host size word head label block items value u slice found comp cls kind a b id again_id GONE_ first anchor gram".split()
LONG = "word and the rest of it " * 4000
ITEM = " ".join(f"b{i}" for i in range(13))
ROWS = [
    (1, "The first of the clean texts says that it is good, and that there is no more to it. " * 3, "en", "s"), (1, "The first of the clean texts says that it is good, and that there is no more to it. " * 3, "en", "s"),
    (1, "other text under the same id", "de", "t"), (None, "a text without an id, of which there are two", "en", None), (None, "a text without an id, of which there are two", "en", None),
    (2, None, "en", "s"), (3, "", None, "s"), (4, " \n\t", "en", "s"), (None, None, None, None), (5, LONG, "en", "s"), (6, LONG + "x", "en", "s"), (7, ITEM, "en", "s"), (None, ITEM, "en", "s"),
]
DOCUMENT = "doc_id long, text string, lang string, source string"


def with_helpers(df):
    for i, c in enumerate(NAMES):
        df = df.withColumn(c, F.lit(i))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, DOCUMENT).withColumn("n_chars", F.lit(0))
    return with_helpers(df).cache()


@pytest.fixture(scope="module")
def bench(spark):
    return with_helpers(spark.createDataFrame([(0, ITEM), (None, ITEM), (1, None), (2, "")], "item_id long, text string").drop("items"))


OPERATORS = {
    "quality": lambda d, b: quality.classify(d),
    "near_duplicates": lambda d, b: ngram_join.similarity_components(d),
    "line_rules": lambda d, b: line_rules.line_rules(d),
    "decontamination": lambda d, b: decontaminate.report(d, b),
    "spans": lambda d, b: decontaminate.remove_spans(d, b),
    "language": lambda d, b: language.identify(d),
    "sharding": lambda d, b: sharding.place(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(docs, bench, name):
    out = OPERATORS[name](docs, bench)
    assert out.count() == len(ROWS)
    assert OPERATORS[name](docs.limit(0), bench).count() == 0
    if name in ("spans", "sharding"):
        assert set(docs.columns) <= set(out.columns)


def test_operators_with_results_of_another_shape(spark, docs, bench):
    assert licences.scan(docs).count() == len(ROWS) and licences.scan(docs.limit(0)).count() == 0
    mixed = mixing.mix(docs, {"lang": F.col("lang"), "source": F.col("source")}, ({}, {}), per_mille=1000, max_epochs=1)
    assert mixed.count() == sum(bool((r[1] or "").split()) for r in ROWS)
    assert mixing.mix(docs.limit(0), {"lang": F.col("lang")}, ({},)).count() == 0
    turns = with_helpers(spark.createDataFrame([(None, None, None, None), (1, 0, "user", ""), (1, 0, "user", "")], "conv_id long, turn long, role string, text string"))
    assert chat.chat_digest(turns).count() == 2 and chat.chat_digest(turns.limit(0)).count() == 0
    records = spark.createDataFrame([(1, None, None, "revisit", None, None, None, None, None), (None, "http://a", 1, "response", None, None, None, None, None), (2, "http://a", 2, "revisit", None, None, None, None, None)], warc.RECORD)
    records = records.select("*", *[F.lit(1).alias(c) for c in NAMES if c != "kind"])
    assert {r["record_id"]: r["verdict"] for r in warc.resolve_revisits(records).collect()} == {1: "no_base", 2: "unverified"}
    assert warc.resolve_revisits(records.limit(0)).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, tmp_path, docs, bench, name, stage):
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = stage(spark, docs, str(tmp_path))
    assert out.columns[: len(docs.columns)] == docs.columns
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    if name == "quality":
        assert not [1 for _, t in got if not (t or "").strip()] and len({got.count(r) for r in (ROWS[0][:2],)} & {0, 2}) == 1
    elif name == "near_duplicates":
        # one of each text, those with a doc_id first; texts without a word stay
        want = [(1, ROWS[0][1]), ROWS[2][:2], ROWS[3][:2], (2, None), (3, ""), (4, " \n\t"), (None, None), (5, LONG), (7, ITEM)]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    elif name == "decontamination":
        assert sorted(got, key=repr) == sorted([r[:2] for r in ROWS if r[1] != ITEM], key=repr)
    elif name == "mixture":
        assert got and not [1 for _, t in got if not (t or "").strip()] or (None, None) in got
    else:
        assert len(got) == len(ROWS) and all(r["shard"] for r in out.collect())


BIG = 2**60


def test_large_ids_beside_null_ones(spark):
    """Ids above 2 ** 53 come back as they are, and links among them are found, in a batch with a null id."""
    one = " ".join(f"w{i}" for i in range(60))
    rows = [(BIG + 1, one, "en", "s"), (None, "some text of its own " * 20, "en", "s"), (BIG + 1001, one.replace("w59", "x"), "en", "s"), (BIG + 3, "another one " * 30, "de", "t")]
    df = spark.createDataFrame(rows, DOCUMENT).coalesce(1)
    want = sorted(r[0] or 0 for r in rows)
    for name, f in OPERATORS.items():
        bench = spark.createDataFrame([(0, ITEM)], "item_id long, text string")
        assert sorted(r["doc_id"] or 0 for r in f(df, bench).collect()) == want, name
    assert sorted(r["doc_id"] or 0 for r in line_rules.line_rules(df, min_docs=1, min_per_mille=0, broadcast_lines=0).collect()) == want
    assert sorted(r["doc_id"] or 0 for r in licences.scan(df).collect()) == want
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.similarity_components(df).collect()}
    assert found == {BIG + 1: BIG + 1, BIG + 1001: BIG + 1, BIG + 3: BIG + 3, None: None}


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_large_ids_in_stages(spark, tmp_path, bench, name, stage):
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(BIG + 2 * i + 1, f"Sentence number {i} of the clean texts says that it is good, and the {i * 7} others do so too. " * 4, "en", f"src{i % 3}") for i in range(30)] + [(None, "A text without an id, which is as good as the others are. " * 4, "en", "src1")]
    got = stage(spark, spark.createDataFrame(rows, DOCUMENT).withColumn("n_chars", F.lit(0)).coalesce(1), str(tmp_path)).collect()
    assert {(r["doc_id"], r["text"]) for r in got} <= {r[:2] for r in rows}


def test_names_that_no_column_has(spark):
    df = spark.createDataFrame([(1, 2, 3)], "A int, a_ int, b int")
    assert common.fresh(df, "a") == "a__" and common.fresh(df, "c") == "c"
