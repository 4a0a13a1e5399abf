"""Benchmark decontamination with DataFrame operations only.

A window is 13 consecutive words of a benchmark item, or all words of an item that
has fewer. The distinct windows form a hash set that is broadcast; it is keyed by
one word of the window, its longest, so that a training document's words probe
it in the same pass in which the text is split. Where a word hits, the hash of the
document's window around it is compared, and then the words themselves. Texts are
neither shuffled nor sorted; what leaves the scan is a row per verified window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh, text_key, words_of

WINDOW = 13
#: The window set is broadcast up to this number of bytes of text; beyond it the join is shuffled.
BROADCAST_BYTES = 64 << 20


def windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Distinct windows with the items that they occur in: gram, words, n_gram, anchor, at, items.

    at is the place of the anchor, the longest word (of equals the first in
    order of the strings, and its first place).
    """
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.size("w") - n, F.lit(0))
    grams = items.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(F.col("w"), i + 1, n))).alias("gram_words"))
    grams = grams.groupBy("gram_words").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    ranked = F.transform("gram_words", lambda w, i: F.struct((-F.length(w)).alias("l"), w.alias("w"), i.alias("i")))
    return grams.withColumn("a", F.array_min(ranked)).select(
        F.xxhash64("gram_words").alias("gram"),
        "gram_words",
        F.size("gram_words").alias("n_gram"),
        F.col("a.w").alias("anchor"),
        F.col("a.i").alias("at"),
        "items",
    )


def hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """A row (doc_id, key, first, n_gram, items) for each occurrence of a window; first counts words from 0, key is the text's hash."""
    grams = windows(benchmark, n)
    size = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    words = docs.filter("text is not null").select("doc_id", text_key(F.col("text")).alias("key"), words_of(F.col("text")).alias("w"))
    seen = words.select("doc_id", "key", "w", F.posexplode("w").alias("pos", "anchor"))
    # each character of an item is in at most n windows
    if size * n <= BROADCAST_BYTES:
        found = seen.join(F.broadcast(grams), "anchor").withColumn("first", F.col("pos") - F.col("at"))
        here = F.slice("w", F.greatest(F.col("first"), F.lit(0)) + 1, F.col("n_gram"))
        found = found.filter((F.col("first") >= 0) & (F.xxhash64(here) == F.col("gram")) & (here == F.col("gram_words")))
        return found.select("doc_id", "key", "first", "n_gram", "items")
    # beyond it windows are shuffled by their hashes, and their words are sent only for those that agree
    lengths = [r["n_gram"] for r in grams.select("n_gram").distinct().collect()]
    own = [F.when(F.size("w") - F.col("pos") >= k, F.struct(F.xxhash64(F.slice("w", F.col("pos") + 1, k)).alias("gram"), F.lit(k).alias("n_gram"))) for k in lengths]
    own = seen.select("doc_id", "key", F.col("pos").alias("first"), F.explode(F.filter(F.array(*own), lambda x: x.isNotNull())).alias("x")) if own else seen.limit(0)
    if not lengths:
        return seen.join(grams, "anchor").select("doc_id", "key", F.col("pos").alias("first"), "n_gram", "items")
    met = checkpoint(own.select("doc_id", "key", "first", "x.gram", "x.n_gram").join(grams.select("gram", "n_gram").distinct(), ["gram", "n_gram"]))
    texts = met.groupBy(F.col("doc_id").alias("met_id"), "key").agg(F.collect_set(F.struct("first", "gram", "n_gram")).alias("places"))
    texts = words.dropDuplicates(["doc_id", "key"]).join(texts.withColumnRenamed("key", "met_key"), F.col("doc_id").eqNullSafe(F.col("met_id")) & (F.col("key") == F.col("met_key")))
    texts = texts.select("doc_id", "key", "w", F.explode("places").alias("x")).select("doc_id", "key", "x.*", F.slice("w", F.col("x.first") + 1, F.col("x.n_gram")).alias("gram_words"))
    return texts.join(grams.select("gram", "gram_words", "items"), ["gram", "gram_words"]).select("doc_id", "key", "first", "n_gram", "items")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")


def hit_words(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """hit_id, hit_key, places (of the hit words), items (sorted) for each doc_id and text with a hit; rows that are equal in both are hit alike."""
    h = hits(docs, benchmark, n).groupBy(F.col("doc_id").alias("hit_id"), F.col("key").alias("hit_key"))
    h = h.agg(F.collect_set(F.struct("first", "n_gram")).alias("spans"), F.collect_set("items").alias("named"))
    places = F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["first"] + s["n_gram"] - 1)))
    return h.select("hit_id", "hit_key", F.array_distinct(places).alias("places"), F.array_sort(F.array_distinct(F.flatten("named"))).alias("items"))


def judged(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, per_cent: int = 5) -> DataFrame:
    """report() with key, the text's hash."""
    found = hit_words(docs, benchmark, n).select("hit_id", "hit_key", F.size("places").alias("n_hit"), "items")
    counts = docs.select("doc_id", text_key(F.col("text")).alias("key"), n_words(F.col("text")).alias("n_words"))
    out = counts.join(found, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        "key",
        "n_words",
        hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((hit > 0) & (hit * 100 >= F.col("n_words") * per_cent)).alias("contaminated"),
    )


def report(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, per_cent: int = 5) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted strings), contaminated, for each row of docs.

    A word within any occurrence of a window is hit; contaminated: at least one
    is, and at least per_cent of a hundred of the document's words. Null, empty and
    blank texts have no words. Every row is a document and is judged by its own
    text, also where rows share a doc_id or have none. Nothing in benchmark
    means no hits. Other columns are ignored.
    """
    return judged(docs, benchmark, n, per_cent).drop("key")


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, per_cent: int = 5) -> DataFrame:
    """docs without the contaminated rows; all columns stay, whatever their names.

    Rows are judged as in report(): each by its own text, null and empty texts are never
    contaminated, equal rows are judged alike, an empty table stays empty.
    """
    bad_id, bad_key = fresh(docs, "bad_id"), fresh(docs, "bad_key")
    bad = judged(docs, benchmark, n, per_cent).filter("contaminated").select(F.col("doc_id").alias(bad_id), F.col("key").alias(bad_key))
    same = docs["doc_id"].eqNullSafe(F.col(bad_id)) & (text_key(docs["text"]) == F.col(bad_key))
    return docs.join(bad.hint("shuffle_hash"), same, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """docs with the hit words, and what stands between each and the next word, cut out of text; other columns stay, whatever their names.

    Each row loses its own hits, equal rows the same; a null, empty or clean text stays as it is, and an empty table empty.
    """
    cut, cut_id, cut_key = (fresh(docs, c) for c in ("cut", "cut_id", "cut_key"))
    cuts = hit_words(docs, benchmark, n).select(F.col("hit_id").alias(cut_id), F.col("hit_key").alias(cut_key), F.array_sort("places").alias(cut))
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    head = F.regexp_extract("text", r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    rest = F.filter(F.regexp_extract_all("text", F.lit(word), F.lit(0)), lambda w, i: ~F.array_contains(F.col(cut), i))
    joined = docs.join(cuts, docs["doc_id"].eqNullSafe(F.col(cut_id)) & (text_key(docs["text"]) == F.col(cut_key)), "left")
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.concat(head, F.array_join(rest, "")))
    return joined.withColumn("text", text).drop(cut, cut_id, cut_key)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = report(docs, benchmark)
    return out.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


