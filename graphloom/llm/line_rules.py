"""Quality rules with cross-document line frequency.

Lines are normalised and hashed; for each host and line the distinct documents
are counted over the whole corpus. A line that too many documents of a host hold
is boilerplate there and is removed; a document that loses most of its words
that way is depleted and rejected, besides those that fail the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, ship, spread, told, untold

ship(__name__)

#: A line is boilerplate when at least MIN_DOCS documents of a host hold it, and these are MIN_PER_MILLE of the host's or
#: MANY_DOCS, so that the largest hosts have no other rule than small ones.
MIN_DOCS, MIN_PER_MILLE, MANY_DOCS = 10, 10, 100
#: A document is depleted when less than this per cent of its words remain.
MIN_LEFT = 30
#: Boilerplate lines up to this number are broadcast as hashes; beyond it they are joined with all lines.
BROADCAST_LINES = 500_000

FIELDS = "doc_id string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_removed long"
SPACES = b" \t\n\x0b\x0c\r"


def normal(line: bytes) -> bytes:
    """Lower-cased A-Z, white space squeezed; empty for a line without a word."""
    return b" ".join(line.lower().split())


def line_key(host: str | None, line: bytes) -> int:
    """A signed 64-bit hash of a host and a normalised line."""
    h = xxhash.xxh3_64_intdigest((host or "").encode("utf-8", "surrogatepass") + b"\n" + line)
    return h - (1 << 64) if h >> 63 else h


def repeated_words(words: list[bytes]) -> int:
    """Words within a window of three words that is found twice or more, the first one included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    m = len(ids)
    # exact for up to two million different words; beyond it pairs are numbered first
    pair = a[:-1] * m + a[1:]
    if m > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    _, inverse, count = np.unique(pair[:-1] * m + a[2:], return_inverse=True, return_counts=True)
    twice = count[inverse] > 1
    hit = np.zeros(n, dtype=bool)
    hit[:-2] |= twice
    hit[1:-1] |= twice
    hit[2:] |= twice
    return int(hit.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; null text has none."""
    if text is None:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    solid = raw.translate(None, SPACES)
    chars = len(solid) if solid.isascii() else len(solid.decode("utf-8", "surrogatepass"))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def line_rows(text: str | None, host: str | None) -> dict[int, int]:
    """For each distinct line of a text its key and the words in all its occurrences."""
    out: dict[int, int] = {}
    if text is not None:
        for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
            if n := len(line.split()):
                k = line_key(host, normal(line))
                out[k] = out.get(k, 0) + n
    return out


def without(text: str | None, host: str, bad: set[int]) -> tuple[int, str | None]:
    """The words in a text's boilerplate lines, and the text without these."""
    if text is None or not bad:
        return 0, text
    gone, kept = 0, []
    for line in text.split("\n"):
        raw = line.encode("utf-8", "surrogatepass")
        n = len(raw.split())
        if n and line_key(host, normal(raw)) in bad:
            gone += n
        else:
            kept.append(line)
    return gone, "\n".join(kept)


def _measured(rows: list[tuple], texts: bool) -> pd.DataFrame:
    """rows: doc_id, text, words gone, text left."""
    df = pd.DataFrame(
        [(*base_counts(t), gone) + (clean,) * texts for _, t, gone, clean in rows],
        columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed"] + ["clean_text"] * texts,
    )
    df.insert(0, "doc_id", pd.array([r[0] for r in rows], dtype=object))
    return df


def _count_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keys: list[int] = []
        hosts: list[str] = []
        for text, host in zip(pdf["text"], pdf["host"], strict=True):
            found = line_rows(text, host)
            keys += found
            hosts += [host] * len(found)
        if keys:
            df = pd.DataFrame({"host": hosts, "key": keys}).groupby(["host", "key"], sort=False).size().rename("n").reset_index()
            # strings as objects: in its own type pandas may hold them in several pieces, which Spark doesn't take
            yield df.astype({"host": object})


def _explode_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(i, h, k, n) for i, t, h in zip(pdf["doc"], pdf["text"], pdf["host"], strict=True) for k, n in line_rows(t, h).items()]
        if rows:
            yield pd.DataFrame(rows, columns=["doc", "host", "key", "n"]).astype({"host": object})


def frequent_lines(rows: DataFrame, min_docs: int = MIN_DOCS, min_per_mille: int = MIN_PER_MILLE, many_docs: int = MANY_DOCS) -> DataFrame:
    """host, key, n_docs of the lines above the limits; rows: doc_id, text, host. Rows that share a doc_id are one document here."""
    again = checkpoint(rows.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").select(F.col("doc_id").alias("again_id")))
    single = several = rows
    if repeated := not again.isEmpty():
        same = rows["doc_id"] == again["again_id"]
        single, several = rows.join(again, same, "left_anti"), rows.join(again, same, "left_semi")
    # each batch has counted its own documents, so a hot line comes as one row a batch
    lines = single.select("text", "host").mapInPandas(_count_lines, "host string, key long, n long")
    if repeated:
        more = several.select(F.col("doc_id").alias("doc"), "text", "host").mapInPandas(_explode_lines, "doc long, host string, key long, n long")
        lines = lines.union(more.select("doc", "host", "key").distinct().select("host", "key", F.lit(1).cast("long")))
    lines = lines.groupBy("host", "key").agg(F.sum("n").alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    alone = F.count(F.when(F.col("doc_id").isNull(), 1))
    sizes = rows.groupBy("host").agg((F.countDistinct("doc_id") + alone if repeated else F.count("*")).alias("host_docs"))
    enough = (F.col("n_docs") * 1000 >= F.col("host_docs") * min_per_mille) | (F.col("n_docs") >= many_docs)
    return lines.join(sizes, "host").filter(enough).drop("host_docs")


def line_rules(
    docs: DataFrame,
    host: Column | None = None,
    min_docs: int = MIN_DOCS,
    min_per_mille: int = MIN_PER_MILLE,
    min_left: int = MIN_LEFT,
    broadcast_lines: int = BROADCAST_LINES,
    texts: bool = True,
    many_docs: int = MANY_DOCS,
) -> DataFrame:
    """doc_id, text, base counts, base_failed, n_removed (words in boilerplate lines), clean_text, kept.

    One row for each row of docs. Where documents are counted, rows that share a doc_id
    are one, and each row without a doc_id is one. host: by default the column source; null is a host named "". Null,
    empty and blank texts have no words and fail the base rules. clean_text is
    text without its boilerplate lines (null for null), left out without texts. Other columns are ignored;
    an empty table gives no rows. Whole texts are used, whatever their length.
    """
    rows = spread(docs.select("doc_id", "text", F.coalesce((F.col("source") if host is None else host).cast("string"), F.lit("")).alias("host")))
    often = frequent_lines(rows, min_docs, min_per_mille, many_docs)
    some = often.select("key").limit(broadcast_lines + 1).toPandas()["key"].to_numpy()
    sc = docs.sparkSession.sparkContext
    if len(some) <= broadcast_lines:
        shared = sc.broadcast(set(some.tolist()))

        def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = zip(pdf["doc_id"], pdf["text"], pdf["host"], strict=True)
                yield _measured([(i, t, *without(t, h, shared.value)) for i, t, h in rows], texts)

        out = untold(rows.select(told("doc_id"), "text", "host").mapInPandas(measure, FIELDS + ", clean_text string" * texts))
    else:
        out = _joined(rows, often, texts)
    fine = (F.col("n_words") >= 50) & (F.col("n_repeat_words") * 100 <= F.col("n_words") * 50)
    left = (F.col("n_words") - F.col("n_removed")) * 100 >= F.col("n_words") * min_left
    return out.withColumn("base_failed", ~fine).withColumn("kept", fine & left)


def _joined(rows: DataFrame, often: DataFrame, texts: bool) -> DataFrame:
    """As the pass with broadcast hashes, by joins with all lines; for corpora with very many boilerplate lines."""
    # numbers given once and written out, so that a lost executor can't change them
    numbered = checkpoint(rows.withColumn("doc", F.monotonically_increasing_id()))
    lines = numbered.select("doc", "text", "host").mapInPandas(_explode_lines, "doc long, host string, key long, n long")
    hit = lines.join(often.select("host", "key"), ["host", "key"]).groupBy("doc").agg(F.collect_set("key").alias("gone"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = zip(pdf["doc_id"], pdf["text"], pdf["host"], pdf["gone"], strict=True)
            yield _measured([(i, t, *without(t, h, set() if g is None else {int(x) for x in g})) for i, t, h, g in rows], texts)

    joined = numbered.join(hit, "doc", "left").select(told("doc_id"), "text", "host", "gone")
    return untold(joined.mapInPandas(measure, FIELDS + ", clean_text string" * texts))


def digest(docs: DataFrame) -> DataFrame:
    return line_rules(docs, texts=False)
