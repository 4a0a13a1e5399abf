"""Language identification by prediction by partial matching over bytes.

For each language a context tree counts which byte follows which context of up to
ORDER bytes. A byte is coded in the longest context that the tree knows; a byte not
seen there costs an escape and is coded in the next shorter one, down to a
uniform code over 256 bytes. Escapes follow method C: a context seen t times with u
different successors escapes with probability u / (t + u). The statistics are frozen
after learning, so that the code length of a text is a sum over its bytes of a
number that depends on ORDER + 1 bytes only; all of these are worked out once
and looked up. The language with the shortest code is the prediction.

The trees are learnt from a sample of whole texts, about DOCS_PER_LANG documents of
each language, chosen by a hash of doc_id and text; every text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, ship, spread, told, untold

ship(__name__)

ORDER = 3
#: Expected number of documents of each language that the trees are learnt from.
DOCS_PER_LANG = 1_500
#: Languages whose trees are held together; with more, texts are scored with one group of languages after another.
TOGETHER = 400
#: Bytes of text that are scored at a time.
CHUNK = 1 << 19
PAD = 10


def grams(raw: bytes) -> np.ndarray:
    """For each byte the number made of it and the ORDER bytes before; a text starts after newlines."""
    a = np.frombuffer(bytes([PAD]) * ORDER + raw, dtype=np.uint8).astype(np.uint32)
    g = a[ORDER:].copy()
    for k in range(1, ORDER + 1):
        g |= a[ORDER - k : len(a) - k] << np.uint32(8 * k)
    return g


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lang, part in pdf.groupby("lang"):
            g, n = np.unique(np.concatenate([grams(t.encode("utf-8", "surrogatepass")) for t in part["text"]]), return_counts=True)
            yield pd.DataFrame({"lang": lang, "gram": g.astype(np.int64), "n": n})


def gram_counts(labelled: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> DataFrame:
    """lang, gram, n over the sample; labelled: doc_id, text, lang, none of them null but doc_id. Equal rows are drawn together, as one."""
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("size"))
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id"), F.col("text")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # with fewer documents than docs_per_lang all are taken
    chosen = labelled.join(F.broadcast(sizes), "lang").filter(draw * F.col("size") < F.lit(float(docs_per_lang)))
    chosen = chosen.dropDuplicates(["doc_id", "lang", "text"])
    return chosen.select("lang", "text").mapInPandas(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Trees:
    """For each language the code lengths of bytes after contexts.

    symbol: bytes renumbered, those never learnt share the last number. context: for each triple of symbols a number
    that says what all languages know of it. rows: for each language and such number a row of its own table. length:
    for each language its table of bits, a row of n_symbols for each context that it knows.
    """

    langs: list[str]
    symbol: np.ndarray
    n_symbols: int
    context: np.ndarray
    rows: list[np.ndarray]
    length: list[np.ndarray]

    def score(self, raw: bytes) -> np.ndarray:
        """Bits of the whole text in each language."""
        return self.scores([raw])[0]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.langs)))
        n, pad = self.n_symbols, bytes([PAD]) * ORDER
        for i, raw in enumerate(texts):
            for at in range(0, len(raw), CHUNK):
                before = (pad + raw[max(0, at - ORDER) : at])[-ORDER:]
                a = self.symbol[np.frombuffer(before + raw[at : at + CHUNK], dtype=np.uint8)]
                c = a[: -ORDER]
                for k in range(1, ORDER):
                    c = c * n + a[k : len(a) - ORDER + k]
                c, last = self.context[c], a[ORDER:]
                for j, (rows, length) in enumerate(zip(self.rows, self.length, strict=True)):
                    out[i, j] += length[rows[c] + last].sum(dtype=np.float64)
        return out


def one_tree(part: list[np.ndarray], count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For one language: for each triple of symbols a row, and the rows of code lengths in bits.

    part: for each gram the symbol and those before it, the nearest first; count: how often it occurs.
    """
    # order -1: uniform over bytes
    row_of = np.zeros(1, dtype=np.int32)  # of a context of the order below, by its number
    prob = np.full((1, n), 1 / 256, dtype=np.float32)
    for order in range(ORDER + 1):
        key = np.zeros(len(count), dtype=np.int64)
        for k in range(order, 0, -1):
            key = key * n + part[k]
        contexts, where = np.unique(key, return_inverse=True)
        table = np.zeros((len(contexts), n), dtype=np.float32)
        np.add.at(table, (where, part[0]), count)
        total, kinds = table.sum(axis=1, keepdims=True), (table > 0).sum(axis=1, keepdims=True, dtype=np.float32)
        # what was not seen here is coded below, after an escape
        fresh = prob[row_of[contexts % n ** max(order - 1, 0)]]
        fresh *= kinds / (total + kinds)
        np.copyto(fresh, table / (total + kinds), where=table > 0)
        # contexts that the language has not seen keep the row of the order below
        row_of = np.tile(row_of, n) if order else row_of.copy()
        row_of[contexts] = len(prob) + np.arange(len(contexts), dtype=np.int32)
        prob = np.concatenate([prob, fresh])
    # a byte outside the renumbered ones is coded like any one of them, all in the last number
    return row_of, -np.log2(prob)


def build(counts: pd.DataFrame) -> Trees:
    """Trees from rows lang, gram, n. Their size is the sum of the languages' own trees, which the sample bounds, and a table of triples of symbols."""
    langs = sorted(counts["lang"].unique())
    gram = counts["gram"].to_numpy(dtype=np.uint32)
    seen = np.unique(np.concatenate([(gram >> np.uint32(8 * k)) & np.uint32(255) for k in range(ORDER + 1)] + [np.array([PAD], dtype=np.uint32)]))
    n = len(seen) + 1
    symbol = np.full(256, n - 1, dtype=np.int32)
    symbol[seen] = np.arange(len(seen))
    part = [symbol[(gram >> np.uint32(8 * k)) & np.uint32(255)].astype(np.int64) for k in range(ORDER + 1)]
    lang, count = counts["lang"].to_numpy(), counts["n"].to_numpy(dtype=np.float32)
    context, rows, lengths = np.zeros(n**ORDER, dtype=np.int32), [], []
    for x in langs:
        own = lang == x
        row_of, bits = one_tree([p[own] for p in part], count[own], n)
        # triples that were alike in all languages so far and differ in this one are told apart
        both, context = np.unique(context.astype(np.int64) * len(bits) + row_of, return_inverse=True)
        context = context.astype(np.int32)
        rows = [r[both // len(bits)] for r in rows] + [((both % len(bits)) * n).astype(np.int32)]
        lengths.append(bits.ravel())
    return Trees(langs, symbol, n, context, rows, lengths)


def predict(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, lang_pred, score, bits for every row of docs.

    und, with score 0 and no bits, for a null text or one without a letter, and
    for every text if no language was learnt. score: 1 over the sum of 2 to the
    power of how many bits shorter the best code is than each. Of equal
    codes the language whose name comes first wins. Only text is looked at.
    """
    return _named(_scored(_unscored(docs), trees))


STATE = "doc_id string, text string, lang_pred string, rest double, bits double"


def _unscored(docs: DataFrame) -> DataFrame:
    """Rows of STATE before any language: rest is the sum of which score is the reciprocal."""
    return spread(docs.select(told("doc_id"), "text")).selectExpr("doc_id", "text", "string(null) lang_pred", "double(null) rest", "double(null) bits")


def _scored(rows: DataFrame, trees: Trees) -> DataFrame:
    """Rows of STATE with further languages, whose names come after those before."""
    shared = rows.sparkSession.sparkContext.broadcast(tuple(getattr(trees, f.name) for f in fields(trees)))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = Trees(*shared.value)
        for pdf in batches:
            known = np.array([x is not None and any(map(str.isalpha, x)) and bool(t.langs) for x in pdf["text"]], dtype=bool)
            pred, rest, most = pdf["lang_pred"].to_numpy(dtype=object), pdf["rest"].to_numpy(dtype=float, copy=True), pdf["bits"].to_numpy(dtype=float, copy=True)
            found = t.scores([x.encode("utf-8", "surrogatepass") for x in pdf["text"][known]])
            for i, b in zip(np.flatnonzero(known), found, strict=True):
                best = float(b.min())
                total = float(np.exp2(np.maximum(best - b, -1000)).sum())
                if np.isnan(most[i]):
                    pred[i], rest[i], most[i] = t.langs[int(b.argmin())], total, best
                else:
                    least = min(best, most[i])
                    rest[i] = rest[i] * np.exp2(max(least - most[i], -1000)) + total * np.exp2(max(least - best, -1000))
                    pred[i], most[i] = (t.langs[int(b.argmin())] if best < most[i] else pred[i]), least
            # NaN is null
            df = pd.DataFrame({"lang_pred": pred, "rest": pd.array(rest, dtype="Float64"), "bits": pd.array(most, dtype="Float64")})
            df.insert(0, "doc_id", pdf["doc_id"].astype(object))
            df.insert(1, "text", pdf["text"].astype(object))
            yield df

    return rows.mapInPandas(judge, STATE)


def _named(rows: DataFrame) -> DataFrame:
    return untold(rows.select("doc_id", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), F.coalesce(1 / F.col("rest"), F.lit(0.0)).alias("score"), "bits"))


def held_out(doc_id: str = "doc_id"):
    """Whether a document belongs to the fifth that is not learnt from; a null doc_id is learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, together: int = TOGETHER) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits: learnt from the documents that aren't held out, applied to all.

    One row for each row of docs, in which repeated rows are judged alike. Null, empty and letterless texts are und; a
    null lang is not learnt from; a row with a null doc_id isn't held out. Of equal code lengths the language
    whose name comes first wins. An empty table, or one without a usable lang, learns nothing, and all it has is und. More
    languages than may be held together are learnt and scored in groups, with the same result.
    Whole texts are used, however long. Other columns, whatever their names, are ignored.
    """
    known = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = gram_counts(spread(known), docs_per_lang)
    names = known.select("lang").distinct()
    some = [r["lang"] for r in names.orderBy("lang").limit(together + 1).collect()]
    if len(some) <= together:
        return predict(docs, build(counts.toPandas())).withColumn("held_out", held_out())
    # as many languages at a time as may be held together, each group with the rows as the one before left them
    counts, names, rows = checkpoint(counts), checkpoint(names), _unscored(docs)
    while some := some[:together]:
        rows = checkpoint(_scored(rows, build(counts.filter(F.col("lang").between(some[0], some[-1])).toPandas())))
        some = [r["lang"] for r in names.filter(F.col("lang") > some[-1]).orderBy("lang").limit(together).collect()]
    return _named(rows).withColumn("held_out", held_out())
