"""A kept inverted index: postings by term, merged as rows change, and retrieval for a table of tasks."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import Versions, checkpoint
from ..functions.text import tokens
from . import batch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Partitions that rows are dealt out to at most, and rows whose tokens are counted together.
DEALT, ROWS = 200, 256
#: Rows that are scored together, and blocks of them after which each task keeps its best.
BLOCK, FIRST = 256, 2
#: Scores count to so many places, so that the order in which terms are added up doesn't matter.
PLACES = 9


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, id, n_tokens and the term's hits in each column, of rows with id and each column's tokens."""
    for batch in batches:
        for part in (batch.slice(k, ROWS) for k in range(0, batch.num_rows, ROWS)):
            ids, columns = part.column(0).to_pylist(), [c.to_pylist() for c in part.columns[1:]]
            out: list[tuple] = []
            for i, row in zip(ids, zip(*columns, strict=True), strict=True):
                hits: dict[str, list[int]] = {}
                for at, terms in enumerate(row):
                    for t in terms:
                        hits.setdefault(t, [0] * len(row))[at] += 1
                n = sum(map(len, row))
                out += [(t, i, n, *h) for t, h in hits.items()]
            names = ["term", "id", "n_tokens", *[f"h_{c.removeprefix('t_')}" for c in part.schema.names[1:]]]
            kinds = [pa.string(), pa.string()] + [pa.int32()] * (1 + len(columns))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=names)


class Index:
    """Postings of rows (id and text columns) in the folder path, in versions.

    postings: term, id, n_tokens (tokens of the row in all columns) and for each column h_<column>, the term's hits in it; partitioned
    by p, the term's first two characters, and within that ranged by term and id, so that a prefix is read
    from few files and a term that many rows have is in several. dictionary: term and how many rows have it. rows: id, n_tokens. dead: ids
    that a version changed or removed; what earlier versions say of them doesn't count.
    """

    def __init__(self, spark: SparkSession, path: str, columns: Sequence[str]):
        self.spark, self.columns, self.versions = spark, tuple(columns), Versions(spark, path)
        self.now = self.versions.current()

    def _parts(self, rows: DataFrame) -> dict[str, DataFrame]:
        """What is written of rows, which are dealt out by id first: a small file may hold very many, whose postings no task should hold at once."""
        dealt = min(DEALT, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        base = rows.select(F.col("id").cast("string").alias("key"), *self.columns).repartition(dealt, "key")
        base = base.select(F.col("key").alias("id"), *[tokens(F.col(c)).alias(f"t_{c}") for c in self.columns])
        found = base.mapInArrow(_counted, self._schema("postings").removesuffix(", p string"))
        base = base.withColumn("n_tokens", sum((F.size(f"t_{c}") for c in self.columns), F.lit(0)))
        found = checkpoint(found.withColumn("p", F.substring("term", 1, 2)))
        return {
            "postings": found.repartitionByRange("p", "term", "id").sortWithinPartitions("p", "term", "id"),
            "dictionary": found.groupBy("term").agg(F.count("*").alias("n_rows")),
            "rows": base.select("id", "n_tokens"),
        }

    def build(self, rows: DataFrame) -> Index:
        """The index of these rows and no others; ids must be different."""
        parts = self._parts(rows)
        n, total = parts["rows"].agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
        dead = self.spark.createDataFrame([], "id string")
        self.versions.write(parts | {"dead": dead}, {"postings": "p"}, numbers={"n_rows": n, "n_tokens": total})
        self.now = self.versions.current()
        return self

    def update(self, changed: DataFrame, removed: DataFrame | None = None) -> Index:
        """Put changed rows (new ones too) in the place of those with their ids, and take away those whose id is in removed.

        Only the changed rows are read and written; of the rest their ids and lengths are looked up.
        """
        if self.now is None:
            return self.build(changed)
        parts = self._parts(changed)
        dead = parts["rows"].select("id")
        dead = checkpoint((dead if removed is None else dead.unionByName(removed.select(F.col("id").cast("string").alias("id")))).distinct())
        gone = self._live("rows").join(dead, "id", "left_semi").agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
        more = parts["rows"].agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
        was = self.now["numbers"]
        numbers = {"n_rows": was["n_rows"] - gone[0] + more[0], "n_tokens": was["n_tokens"] - gone[1] + more[1]}
        self.versions.write(parts | {"dead": dead}, {"postings": "p"}, keep=True, numbers=numbers)
        self.now = self.versions.current()
        return self

    def _schema(self, name: str) -> str:
        hits = "".join(f", h_{c} int" for c in self.columns)
        return {"postings": f"term string, id string, n_tokens int{hits}, p string", "dictionary": "term string, n_rows long", "rows": "id string, n_tokens int"}[name]

    def _read(self, name: str, place: int) -> DataFrame:
        return self.spark.read.schema(self._schema(name)).parquet(self.now["folders"][name][place])

    def _live(self, name: str, keep: Column | None = None) -> DataFrame:
        """A table's rows that no later version has changed; keep is applied where it is read."""
        return self.versions.layers(self.now, name, "dead", "id", self._schema(name), keep)

    def size(self) -> tuple[int, int]:
        """Rows, and tokens in all of them."""
        return self.now["numbers"]["n_rows"], self.now["numbers"]["n_tokens"]

    def postings(self, terms: Sequence[str] | None = None) -> DataFrame:
        """Postings of the terms that begin with any of those given; only their partitions are listed."""
        if terms is None:
            return self._live("postings")
        near = F.lit(False)
        for t in terms:
            near = near | ((F.col("p") == t[:2] if len(t) > 1 else F.col("p").startswith(t)) & F.col("term").startswith(t))
        return self._live("postings", near)

    def counts(self, terms: Sequence[str], weights: Mapping[str, float]) -> DataFrame:
        """id, n_tokens, and for each term i: f_i (weighted hits) and h_i (hits), of the rows that any term hits."""
        f = sum((F.lit(w) * F.col(f"h_{c}") for c, w in weights.items()), F.lit(0.0))
        h = sum((F.col(f"h_{c}") for c in weights), F.lit(0))
        mine = lambda t, x: F.sum(F.when(F.col("term").startswith(t), x).otherwise(0))
        out = [x for i, t in enumerate(terms) for x in (mine(t, f).alias(f"f_{i}"), mine(t, h).cast("int").alias(f"h_{i}"))]
        return self.postings(terms).groupBy("id", "n_tokens").agg(*out) if terms else self._live("rows").limit(0)

    def frequencies(self) -> DataFrame:
        """term, n_rows (Q05)."""
        if len(self.now["folders"]["dictionary"]) == 1:
            return self._read("dictionary", 0)
        return self._live("postings").groupBy("term").agg(F.count("*").alias("n_rows"))

    # a table of tasks

    def vectors(self, prefixes: DataFrame, weights: Mapping[str, float]) -> DataFrame:
        """id, n_tokens, terms, f: of the rows that any prefix hits, the terms that begin with one and their weighted hits."""
        most = prefixes.agg(F.coalesce(F.max(F.length("prefix")), F.lit(0))).first()[0]
        begins = F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("term"), F.lit(max(1, most)))), lambda k: F.left("term", k)))
        words = self.frequencies().select("term", F.substring("term", 1, 2).alias("p"), begins.alias("prefix")).join(prefixes, "prefix", "left_semi")
        f = sum((F.lit(w) * F.col(f"h_{c}") for c, w in weights.items()), F.lit(0.0))
        found = self.postings().join(words.select("p", "term").distinct(), ["p", "term"]).groupBy("id", "n_tokens").agg(F.collect_list(F.struct("term", f.alias("f"))).alias("x"))
        return found.select("id", "n_tokens", F.col("x.term").alias("terms"), F.col("x.f").alias("f"))

    def retrieve(self, tasks: DataFrame, k: int, weights: Mapping[str, float]) -> DataFrame:
        """task, rank (from 1), id, score (negative, the smaller the better): the k best rows for each task (task, terms: an array of different prefixes).

        The postings of the tasks' terms are gathered by row once, and all tasks are scored as these rows pass by (batch.retrieve).
        """
        prefixes = tasks.select(F.explode("terms").alias("prefix")).distinct()
        rows = checkpoint(self.vectors(prefixes, weights))
        return batch.retrieve(rows, tasks, k, PLACES, BLOCK, FIRST, self.size())
