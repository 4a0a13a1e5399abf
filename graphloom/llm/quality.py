"""Quality classifier learnt from weak labels.

Heuristic labellers vote good or bad on a document, or abstain. They overlap and
err; expectation-maximisation over the counts of vote patterns estimates how often
each is right on good and on bad documents, and from that each document's
probability of being good. These posteriors, as soft labels, train a linear
scorer over hashed features, which decides.

The pattern counts cover all documents; there are at most 3 ** 10 patterns, which
bounds what the driver receives. The scorer is fitted on a sample of about
TRAIN_ROWS documents, those whose hash of doc_id and text is below a bound that
follows from the number of documents; equal rows of the sample come as one with a weight.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh, ship, spread, text_key, told, untold
from .line_rules import repeated_words

ship(__name__)

TRAIN_ROWS = 8_000
BUCKETS = 1 << 12
KEEP_FROM = 0.5
LABELLERS = ("symbols", "capitals", "repeats", "stutter", "lengths", "marks", "sentences", "separators", "connectives", "variety")
#: Texts of fewer words say too little for most labellers.
SHORT = 20

_LOW, _UP, _NUM = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[A-Z]+"), re.compile(rb"[0-9]+")
_MARKS = re.compile(rb"([^\w\s])\1(?:\s|$)", re.ASCII)
_END = re.compile(rb"[.!?:;\"')\]][ \t\r]*$", re.MULTILINE)
_ALONE = re.compile(rb"(?:^|(?<=\s))[!-/:-@\[-`{-~]+(?=\s|$)")
_BRIEF = re.compile(rb"(?:^|(?<=\s))[A-Za-z\x80-\xff]{1,3}(?=[,.;:!?]*(?:\s|$))")
_UPPER, _LETTERS = bytes(range(65, 91)), bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_SYMBOLS = b"#*$%&|<>{}[]\\^~=_@"


def ratios(raw: bytes, words: list[bytes]) -> tuple[float, ...]:
    """Shares that the labellers judge, in the order of LABELLERS."""
    n = max(1, len(words))
    solid = max(1, sum(map(len, words)))
    letters = len(raw) - len(raw.translate(None, _LETTERS))
    lines = max(1, sum(1 for x in raw.split(b"\n") if x.strip()))
    return (
        (len(raw) - len(raw.translate(None, _SYMBOLS))) / solid,
        (len(raw) - len(raw.translate(None, _UPPER))) / max(1, letters),
        repeated_words(words) / n,
        sum(map(bytes.__eq__, words[1:], words)) / n,
        solid / n,
        len(_MARKS.findall(raw)) / n,
        len(_END.findall(raw)) / lines,
        len(_ALONE.findall(raw)) / n,
        len(_BRIEF.findall(raw)) / n,
        len(set(words)) / n,
    )


def votes(n: int, r: tuple[float, ...]) -> tuple[int, ...]:
    """1 for good, 0 for bad, 2 for no vote, in the order of LABELLERS; n: number of words."""
    long = n >= SHORT

    def rising(x: float, good: float, bad: float) -> int:
        return 1 if x <= good else 0 if x >= bad else 2

    return (
        rising(r[0], 0.01, 0.04),
        rising(r[1], 0.10, 0.30) if long else 2,
        rising(r[2], 0.20, 0.45) if n >= 50 else 2,
        rising(r[3], 0.03, 0.15) if long else 2,
        1 if 3 <= r[4] <= 9 else 0 if r[4] > 14 or r[4] < 1.5 else 2,
        rising(r[5], 0.03, 0.15),
        1 if r[6] >= 0.6 else 2,
        rising(r[7], 0.03, 0.15) if long else 2,
        (1 if r[8] >= 0.15 else 0 if r[8] < 0.06 else 2) if long else 2,
        # the longer a text, the more often its words come again
        (1 if r[9] >= 0.35 else 0 if r[9] < 0.2 else 2) if 50 <= n <= 3_000 else 2,
    )


def bucket(name: bytes) -> int:
    return xxhash.xxh3_64_intdigest(name) % BUCKETS


def features(raw: bytes, words: list[bytes], r: tuple[float, ...]) -> dict[int, float]:
    """Hashed features: shares of word shapes, and the ratios in steps."""
    shapes = Counter(_NUM.sub(b"0", _UP.sub(b"A", _LOW.sub(b"a", raw))).split())
    out: dict[int, float] = {}
    for shape, k in shapes.items():
        i = bucket(b"shape " + shape)
        out[i] = out.get(i, 0.0) + k / len(words)
    for name, x, width in zip(LABELLERS, r, (0.02, 0.1, 0.1, 0.05, 1.0, 0.05, 0.2, 0.05, 0.05, 0.1), strict=True):
        i = bucket(f"{name} {min(int(x / width), 12)} {len(words) >= SHORT}".encode())
        out[i] = out.get(i, 0.0) + 1.0
    return out


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for t in pdf["text"]:
            raw = b"" if t is None else t.encode("utf-8", "surrogatepass")
            words = raw.split()
            if not words:
                rows.append((0, -1, [], []))
                continue
            r = ratios(raw, words)
            f = features(raw, words, r)
            rows.append((len(words), sum(v * 3**j for j, v in enumerate(votes(len(words), r))), list(f), list(f.values())))
        df = pd.DataFrame(rows, columns=["n_words", "pattern", "idx", "val"])
        df.insert(0, "doc_id", pdf["doc_id"].astype(object))
        df["key"] = pdf["key"].astype(object)
        yield df


def measured(docs: DataFrame) -> DataFrame:
    """doc_id (as text), n_words, pattern (votes as digits to base 3; -1 without words), idx and val (hashed features), key (the text's hash)."""
    given = docs.select(told("doc_id"), "text", text_key(F.col("text")).alias("key"))
    return spread(given).mapInPandas(_measure, "doc_id string, n_words long, pattern long, idx array<int>, val array<float>, key string")


@dataclass
class LabelModel:
    """prior: share of good documents; right: for each labeller its accuracy on good and on bad documents."""

    prior: float
    right: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        v = digits(patterns)
        g, b = np.log(self.right[:, 0]), np.log(self.right[:, 1])
        ng, nb = np.log1p(-self.right[:, 0]), np.log1p(-self.right[:, 1])
        odds = np.log(self.prior) - np.log1p(-self.prior) + (v == 1) @ (g - nb) + (v == 0) @ (ng - b)
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def digits(patterns: np.ndarray) -> np.ndarray:
    return np.asarray(patterns)[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation, started from: bad is what any labeller calls bad. No documents: an even prior."""
    v, c = digits(patterns), np.asarray(counts, dtype=float)
    q = np.where((v == 0).any(axis=1), 0.1, 0.9)
    model = LabelModel(0.5, np.full((len(LABELLERS), 2), 0.5))
    for _ in range(rounds if len(c) else 0):
        good, bad = c * q, c * (1 - q)
        right = np.stack(
            [
                (good @ (v == 1) + 1) / (good @ (v != 2) + 2),
                (bad @ (v == 0) + 1) / (bad @ (v != 2) + 2),
            ],
            axis=1,
        )
        model = LabelModel(float((good.sum() + 1) / (c.sum() + 2)), right)
        new = model.posterior(patterns)
        if np.abs(new - q).max() < 1e-9:
            break
        q = new
    return model


def fit_scorer(idx: list[np.ndarray], val: list[np.ndarray], soft: np.ndarray, times: np.ndarray | None = None, rounds: int = 400, l2: float = 1e-5) -> np.ndarray:
    """Weights and, last, a bias of a logistic scorer, by accelerated full gradients over the sample; times: how often each row counts."""
    w = np.zeros(BUCKETS + 1)
    if not len(soft):
        return w
    n = np.array([len(i) for i in idx])
    row = np.repeat(np.arange(len(idx)), n)
    col, x = np.concatenate(idx).astype(np.int64), np.concatenate(val).astype(float)
    # features in their own scale: rare ones learn as fast as common ones
    share = np.full(len(soft), 1 / len(soft)) if times is None else np.asarray(times, dtype=float) / np.sum(times)
    scale = 1 / np.sqrt(np.bincount(col, x * x * share[row], BUCKETS) + 1e-3)
    x = x * scale[col]
    mean = w.copy()
    for k in range(rounds):
        look = mean + k / (k + 3) * (mean - w)
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, look[col] * x, len(soft)) + look[-1], -50, 50)))
        e = (p - soft) * share
        grad = np.append(np.bincount(col, e[row] * x, BUCKETS) + l2 * look[:-1], e.sum())
        w, mean = mean, look - 0.5 * grad
    return np.append(mean[:-1] * scale, mean[-1])


def classify(docs: DataFrame, train_rows: int = TRAIN_ROWS, keep_from: float = KEEP_FROM, keys: bool = False) -> DataFrame:
    """doc_id, n_words, posterior, score, kept for every row of docs, with keys also key (the text's hash).

    score is the scorer's probability that the document is good, posterior the
    label model's. kept: score >= keep_from. Null, empty and blank texts have
    score and posterior 0 and are not kept; they take no part in the fit. Repeated
    rows are judged alike and counted as often as they occur. An empty table gives
    no rows. Other columns, whatever their names, are ignored. Whole texts are used, however long.
    """
    rows = checkpoint(measured(docs))
    seen = rows.filter("pattern >= 0")
    table = seen.groupBy("pattern").agg(F.count("*").alias("n")).toPandas()
    model = fit_labels(table["pattern"].to_numpy(dtype=np.int64), table["n"].to_numpy())
    # expected size train_rows; with fewer documents all are taken
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id").cast("long"), F.col("key")), F.lit(1 << 40))
    bound = min(1 << 40, (train_rows << 40) // max(1, int(table["n"].sum())))
    sample = seen.filter(draw < F.lit(bound)).groupBy("doc_id", "key").agg(
        F.first("pattern").alias("pattern"), F.first("idx").alias("idx"), F.first("val").alias("val"), F.count("*").alias("times")
    )
    # in a fixed order, so that the sums of floats are the same each time
    sample = sample.toPandas().sort_values(["key", "doc_id"], kind="stable")
    soft = model.posterior(sample["pattern"].to_numpy(dtype=np.int64)) if len(sample) else np.zeros(0)
    weights = fit_scorer(list(sample["idx"]), list(sample["val"]), soft, sample["times"].to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast((model.prior, model.right, weights))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        *learnt, w = shared.value
        label = LabelModel(*learnt)
        for pdf in batches:
            z = np.array([w[np.asarray(i, dtype=np.int64)] @ np.asarray(v) + w[-1] if len(i) else -np.inf for i, v in zip(pdf["idx"], pdf["val"], strict=True)])
            s = np.where(np.isneginf(z), 0.0, 1 / (1 + np.exp(-np.clip(z, -50, 50))))
            some = pdf["pattern"].to_numpy() >= 0
            p = np.where(some, label.posterior(np.maximum(pdf["pattern"].to_numpy(), 0)), 0.0)
            df = pd.DataFrame({"doc_id": pdf["doc_id"].astype(object), "n_words": pdf["n_words"], "posterior": p, "score": s, "kept": some & (s >= keep_from)})
            if keys:
                df["key"] = pdf["key"].astype(object)
            yield df

    return untold(rows.mapInPandas(score, "doc_id string, n_words long, posterior double, score double, kept boolean" + ", key string" * keys))


def keep_good(docs: DataFrame) -> DataFrame:
    """docs without the rows that classify() rejects; all columns stay, whatever their names.

    Each row is judged by its own text, also where rows share a doc_id or have none; equal rows are judged alike. Null,
    empty and blank texts are rejected. An empty table stays empty. Very long texts are used whole.
    """
    bad_id, bad_key = fresh(docs, "bad_id"), fresh(docs, "bad_key")
    bad = classify(docs, keys=True).filter("not kept").select(F.col("doc_id").alias(bad_id), F.col("key").alias(bad_key)).distinct()
    same = docs["doc_id"].eqNullSafe(F.col(bad_id)) & (text_key(docs["text"]) == F.col(bad_key))
    return docs.join(bad.hint("shuffle_hash"), same, "left_anti")
