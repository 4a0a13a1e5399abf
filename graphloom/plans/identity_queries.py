"""Identity queries: MinHash, bands, reconciliation, drift of bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import checkpoint
from ..functions.text import body_hash
from ..operators import identity
from ..sources import bridge
from .registry import query

TOKS = r"""toks AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
grams AS (SELECT DISTINCT id, w[i + 1] || chr(0) || w[i + 2] || chr(0) || w[i + 3] AS g FROM toks, unnest(range(greatest(len(w) - 2, 0))) u(i))"""
MINHASH = (
    TOKS
    + ",\nlows AS (SELECT id, "
    + ", ".join(f"min(substr(sha256('{i}' || chr(0) || g), 1, 8)) AS h{i}" for i in range(64))
    + " FROM grams GROUP BY id),\nprints AS (SELECT toks.id, len(w)::BIGINT AS token_count, ["
    + ", ".join(f"coalesce(('0x' || h{i})::BIGINT, 4294967295)" for i in range(64))
    + "] AS m FROM toks LEFT JOIN lows USING (id))"
)
PAIRS = """,
reps AS (SELECT *, min(id) OVER (PARTITION BY m) AS rep FROM prints),
bands AS (SELECT id, b, m[2 * b + 1] AS x, m[2 * b + 2] AS y FROM reps, unnest(range(32)) u(b) WHERE id = rep),
pairs AS (SELECT DISTINCT a.id AS a, b.id AS b FROM bands a JOIN bands b USING (b, x, y) WHERE a.id < b.id UNION ALL SELECT rep, id FROM reps WHERE rep <> id)"""


def words(column: str = "text"):
    return F.filter(F.split(F.lower(F.coalesce(column, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _prints(spark: SparkSession, sf_dir: str, name: str = "benchmark", key: str = "item_id") -> DataFrame:
    rows = bridge.table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    # the table may be one small file; the hashing is worth spreading
    rows = rows.select(F.col(key).alias("id"), "text").repartition(cores)
    return identity.minhash(rows, words(), "id")


@query(
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents)
    SELECT doc_id, len(list_distinct(list_transform(range(greatest(len(w) - 2, 0)), lambda i: w[i + 1] || chr(0) || w[i + 2] || chr(0) || w[i + 3])))::INT AS n FROM w"""
)
def doc_trigram_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct token trigrams of every document."""
    d = bridge.table(spark, sf_dir, "documents").select("doc_id", words().alias("w"))
    return d.select("doc_id", F.size(identity.trigrams(F.col("w"))).alias("n"))


@query(f"WITH {MINHASH} SELECT id, token_count, array_to_string(m, ',') AS minhash FROM prints")
def minhash64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all benchmark items (A10)."""
    return _prints(spark, sf_dir).select("id", "token_count", F.array_join(F.col("minhash").cast("array<string>"), ",").alias("minhash"))


@query(f"WITH {MINHASH.replace('item_id AS id', 'doc_id AS id').replace('FROM benchmark', 'FROM documents')} SELECT id, token_count, array_to_string(m, ',') AS minhash FROM prints")
def minhash64_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents (A10)."""
    return _prints(spark, sf_dir, "documents", "doc_id").select("id", "token_count", F.array_join(F.col("minhash").cast("array<string>"), ",").alias("minhash"))


@query(f"WITH {MINHASH.replace('item_id AS id', 'doc_id AS id').replace('FROM benchmark', 'FROM documents')}{PAIRS} SELECT a, b FROM pairs")
def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that share a band of their fingerprints."""
    return identity.lsh_pairs(checkpoint(_prints(spark, sf_dir, "documents", "doc_id")))


@query(
    f"""WITH {MINHASH.replace('item_id AS id', 'doc_id AS id').replace('FROM benchmark', 'FROM documents')}{PAIRS}
    SELECT a, b, len(list_filter(range(64), lambda i: p.m[i + 1] = q.m[i + 1])) / 64.0 AS similarity FROM pairs JOIN prints p ON p.id = a JOIN prints q ON q.id = b"""
)
def minhash_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of the candidates."""
    return identity.lsh_similarity(checkpoint(_prints(spark, sf_dir, "documents", "doc_id")))


@query(
    """WITH s AS (SELECT l_suppkey AS k, list(DISTINCT l_partkey) AS n FROM lineitem GROUP BY ALL), p AS (SELECT s_suppkey AS k, (s_suppkey + 1) AS k2 FROM supplier)
    SELECT p.k AS a, k2 AS b, round(CASE WHEN len(list_distinct(x.n || y.n)) = 0 THEN 1 ELSE len(list_intersect(x.n, y.n)) / len(list_distinct(x.n || y.n)) END, 6) AS overlap
    FROM p JOIN s x ON x.k = p.k JOIN s y ON y.k = k2"""
)
def neighbor_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of what each supplier and the next one call."""
    n = bridge.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_set("l_partkey").alias("n"))
    a = n.select(F.col("l_suppkey").alias("a"), F.col("n").alias("na"), (F.col("l_suppkey") + 1).alias("b"))
    b = n.select(F.col("l_suppkey").alias("b"), F.col("n").alias("nb"))
    return a.join(b, "b").select("a", "b", F.round(identity.overlap(F.col("na"), F.col("nb")), 6).alias("overlap"))


@query(
    f"""WITH {MINHASH.replace('item_id AS id', 'doc_id AS id').replace('FROM benchmark', 'FROM documents')},
    lost AS (SELECT * FROM prints JOIN documents ON id = doc_id WHERE source = 'src3'), kept AS (SELECT id, m, lang FROM prints JOIN documents ON id = doc_id WHERE source <> 'src3'),
    lb AS (SELECT id, b, m[2 * b + 1] AS x, m[2 * b + 2] AS y FROM lost, unnest(range(32)) u(b)), kb AS (SELECT id, b, m[2 * b + 1] AS x, m[2 * b + 2] AS y FROM kept, unnest(range(32)) u(b)),
    met AS (SELECT DISTINCT lb.id AS a, kb.id AS b FROM lb JOIN kb USING (b, x, y)),
    s AS (SELECT a, b, 0.7 * (len(list_filter(range(64), lambda i: p.m[i + 1] = q.m[i + 1])) / 64.0)::DOUBLE + 0.3::DOUBLE * (CASE WHEN p.lang = q.lang THEN 1.0 ELSE 0.0 END)::DOUBLE AS score FROM met JOIN lost p ON p.id = a JOIN kept q ON q.id = b),
    best AS (SELECT a, max(score) AS score, (min({{'s': -score, 'b': b}})).b AS b FROM s GROUP BY a),
    v AS (SELECT lost.id, round(score, 6) AS score, b, CASE WHEN token_count < 30 OR score IS NULL OR score < 0.55 THEN 'GONE' WHEN score >= 0.85 THEN 'MOVED' ELSE 'AMBIGUOUS' END AS verdict FROM lost LEFT JOIN best ON a = lost.id)
    SELECT id, verdict, CASE WHEN verdict <> 'GONE' THEN b END AS node_id, score FROM v"""
)
def reconcile_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source's documents went missing: which others are they now? A document's neighbour is its language."""
    d = bridge.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.array("lang").alias("neighbors"))
    p = checkpoint(_prints(spark, sf_dir, "documents", "doc_id").join(d, "id"))
    lost, kept = p.filter("source = 'src3'"), identity.first_copies(p.filter("source != 'src3'"))
    lb, kb = identity.bands(lost).withColumnRenamed("id", "a"), identity.bands(kept).withColumnRenamed("id", "b")
    pairs = lb.join(kb, ["band", "band_hash"]).select("a", "b").distinct()
    return identity.reconcile(lost, kept, pairs)


@query(
    r"""WITH h AS (SELECT page_id, sha256(trim(regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '\s+', ' ', 'g'))) AS now,
      sha256(trim(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1), '\s+', ' ', 'g'))) AS was FROM pages)
    SELECT 'doc' || page_id % 7 AS file, page_id AS node_id, CASE WHEN now = was THEN 'clean' ELSE 'drifted' END AS state FROM h"""
)
def body_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each page's heading still is what its title recorded."""
    p = bridge.table(spark, sf_dir, "pages")
    hashed = lambda tag: body_hash(F.regexp_extract("html", f"<{tag}>(.*?)</{tag}>", 1))
    file = F.concat(F.lit("doc"), (F.col("page_id") % 7).cast("string")).alias("file")
    nodes = p.select(F.col("page_id").alias("id"), hashed("h1").alias("body_hash"))
    grounded = p.select(file, F.col("page_id").alias("node_id"))
    return identity.body_drift(grounded, nodes, p.select(file, F.col("page_id").alias("node_id"), hashed("title").alias("body_hash")))
