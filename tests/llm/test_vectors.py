"""Search by vector-approximation files and whitening against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import vafile, whitening
from graphloom.llm.vectors import LIMIT

VECTORS = "vec_id long, embedding array<float>, cls int, row int"
NAN, INF = float("nan"), float("inf")
BAD = [None, [1.0, None], [NAN, 1.0], [1.0, -INF]]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], VECTORS)


def plain_top(rows, divisor, k, scale=256):
    ok = [(i, [max(-LIMIT, min(LIMIT, math.floor(scale * c))) for c in map(float, map(np.float32, v))]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, (q, x) in enumerate(ok):
        if q is not None and q % divisor == 0:
            score = lambda y: max(-(1 << 63), min((1 << 63) - 1, sum(p * r for p, r in zip(x, y, strict=False))))  # noqa: E731, B023
            found = sorted((-score(y), i is None, i or 0) for b, (i, y) in enumerate(ok) if a != b)[:k]
            out += [(q, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(found)]
    return sorted(out, key=repr)


def top_rows(df):
    return sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()), key=repr)


def test_search_against_plain_version(spark, monkeypatch):
    monkeypatch.setattr(vafile, "CHUNK", 50)
    monkeypatch.setattr(vafile, "BLOCK", 7)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 8)).astype(np.float32)
    rows = [(2**60 + i, v.tolist()) for i, v in enumerate(base)]
    # copies: a third of all rows is one vector, some ids repeat, some are null; shorter, empty and unusable vectors
    rows += [(2**60 + 1000 + i, base[0].tolist()) for i in range(150)] + [(2**60 + 4, base[4].tolist())] * 3 + [(None, base[1].tolist())] * 4
    rows += [(20, [1.0, 2.0]), (40, []), (None, [0.5])] + [(60 + 20 * i, v) for i, v in enumerate(BAD)]
    assert top_rows(vafile.top_k(frame(spark, rows), F.col("vec_id") % 10 == 0)) == plain_top(rows, 10, 5)


@pytest.mark.parametrize("rows", [[], [(0, [1.0])], [(0, None)], [(0, [1.0]), (5, [3e38, 1.0]), (10, [2.0, -3e38])], [(0, [3e38] * 3), (1, [3e38] * 3), (2, [-3e38] * 3)]])
def test_search_at_the_edges(spark, rows):
    assert top_rows(vafile.top_k(frame(spark, rows), F.col("vec_id") % 5 == 0)) == plain_top(rows, 5, 5)


def test_few_vectors_are_read():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(4096, 64)) * 32).astype(np.int64)
    cells, low, high = vafile.approximate(x)
    assert (np.take_along_axis(low, cells.astype(np.int64), 0) <= x).all() and (x <= np.take_along_axis(high, cells.astype(np.int64), 0)).all()
    ids = np.arange(len(x))
    chunk = {"n": len(x), "dim": 64, "cls": ids.tobytes(), "first": ids.tobytes(), "none": (ids < 0).tobytes(), "cells": cells.tobytes(), "low": low.tobytes(), "high": high.tobytes(), "x": x.tobytes()}
    best = [vafile.Best(6) for _ in range(20)]
    assert vafile.search(chunk, x[:20], best) < 20 * 200
    for q, b in zip(x, best, strict=False):
        s = x @ q
        assert b.rows[3].tolist() == np.lexsort((ids, -s))[:6].tolist()


# whitening


def matrices():
    rng = np.random.default_rng(11)
    orth = lambda n: np.linalg.qr(rng.normal(size=(n, n)))[0]
    yield rng.normal(size=(40, 40))
    yield np.triu(rng.normal(size=(64, 64)))
    yield orth(20) * np.logspace(0, -8, 20) @ orth(20)
    # clusters and equal values, within rounding and exactly
    yield orth(30) @ np.diag([5.0] * 10 + [3.0, 3.0 + 1e-12] + [1.0] * 18) @ orth(30)
    yield np.diag([3.0, 3.0, 2.0, 2.0, 0.0])
    yield np.zeros((4, 4))
    yield np.array([[2.0]])
    yield orth(12)[:, :5] @ rng.normal(size=(5, 12))
    wilkinson = np.diag(np.abs(np.arange(-10.0, 11))) + np.eye(21, k=1) + np.eye(21, k=-1)
    yield np.linalg.cholesky(wilkinson + 2 * np.eye(21)).T


@pytest.mark.parametrize("k", range(9))
def test_singular_values_and_vectors(k):
    m = list(matrices())[k]
    s, v = whitening.right_vectors(m, 16)
    want = np.linalg.svd(m, compute_uv=False)[:16]
    top = max(want[0], 1e-300)
    assert np.abs(s - want).max() <= 1e-14 * top * len(m)
    assert np.abs(np.linalg.norm(v, axis=1) - 1).max() < 1e-12
    some = v[s > 1e-12 * top]
    assert np.abs(some @ some.T - np.eye(len(some))).max(initial=0) < 1e-11
    # each is a right singular vector
    assert np.abs(np.linalg.norm(m @ v.T, axis=0) - want).max() <= 1e-13 * top * len(m)
    assert np.abs(m.T @ (m @ v.T) - v.T * s**2).max() <= 1e-13 * top**2 * len(m)


def test_values_are_accurate_one_by_one():
    rng = np.random.default_rng(2)
    for n in (2, 3, 10, 60):
        a, b = np.exp(rng.uniform(-9, 9, n)), np.exp(rng.uniform(-9, 9, n - 1))
        got = np.sqrt(whitening.dqds((a * a).tolist(), (b * b).tolist()))
        # the determinant is the product of all, which an inaccurate small one would change
        assert abs(np.log(got).sum() - np.log(a).sum()) < 1e-11 * n
        assert np.allclose(got[: n // 2], np.linalg.svd(np.diag(a) + np.diag(b, 1), compute_uv=False)[: n // 2], rtol=1e-12)


def plain_whitening(rows, scale=64, offset=1_000_000):
    ok = [(i, [math.floor(scale * float(np.float32(c))) + offset for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(x) for _, x in ok)
    ok = [(i, x + [offset] * (d - len(x))) for i, x in ok]
    fit = sorted({tuple(x) for _, x in ok})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array([[n * c - t for c, t in zip(x, s, strict=True)] for x in fit], dtype=float) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    return ok, n, s, e[::-1], v[:, ::-1]


def check_whitening(rows, got):
    ok, n, s, e, v = plain_whitening(rows)
    k = min(16, len(e))
    assert len(got) == len(ok) * k and {r["n"] for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    signs = {}
    for i, x in ok:
        dev = sum((n * c - t) ** 2 for c, t in zip(x, s, strict=True))
        y = np.array([n * c - t for c, t in zip(x, s, strict=True)]) / n
        for c in range(1, k + 1):
            r = by[i, dev][c][0]
            if e[c - 1] > 1e-12 * e[0]:
                assert abs(r["explained"] - e[c - 1] / e.sum()) <= 1e-9
                want = y @ v[:, c - 1] / math.sqrt(e[c - 1])
                if abs(want) > 1e-3:
                    signs.setdefault(c, set()).add(math.copysign(1, want * r["whitened"]))
                assert abs(abs(want) - abs(r["whitened"])) < 1e-6
            else:
                assert r["whitened"] is None and not r["explained"]
    assert all(len(x) == 1 for x in signs.values())
    assert max(r["identity_error"] for r in got) < 1e-9


@pytest.mark.parametrize("case", ["many", "narrow", "alone", "dependent"])
def test_whitening_against_plain_version(spark, case):
    rng = np.random.default_rng(4)
    if case == "many":
        x = rng.normal(size=(400, 24)) * np.linspace(1, 9, 24) + rng.normal(size=24)
        rows = [(2**60 + i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
        # a third is one vector; rows without an id, with the same id, and unusable ones
        rows += [(2**60 + 5000 + i, rows[7][1]) for i in range(200)] + [(None, rows[3][1])] * 3 + [(2**60, rows[0][1])] * 2 + [(i, v) for i, v in enumerate(BAD)]
        rows += [(9, rows[5][1][:3]), (10, [])]
    elif case == "narrow":
        rows = [(i, v) for i, v in enumerate(rng.normal(size=(90, 3)).astype(np.float32).tolist())]
    elif case == "alone":
        rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)]
    else:
        x = np.round(rng.normal(size=(200, 4)) * 8)
        rows = [(i, v) for i, v in enumerate(np.column_stack([x, x[:, :2], np.ones(200)]).tolist())]
    df = frame(spark, rows).repartition(11)
    got = whitening.whiten(df).collect()
    if case == "alone":
        assert len(got) == 4 and all((r["whitened"], r["explained"], r["deviation"], r["n"]) == (None, None, 0, 1) for r in got)
    else:
        check_whitening(rows, got)


def test_whitening_at_the_edges(spark):
    for rows in ([], [(1, None)], [(1, []), (None, [])]):
        assert whitening.whiten(frame(spark, rows)).count() == 0
    # sums of squares that long doesn't hold are null, and nothing overflows
    got = whitening.whiten(frame(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 0.0])])).collect()
    assert len(got) == 6 and {r["deviation"] for r in got if r["vec_id"] == 1} == {None} and all(math.isfinite(r["identity_error"]) for r in got)


def test_whitening_query_against_plain_version(spark):
    from graphloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check_whitening(rows, QUERIES["op11_whitening"](spark, sf).collect())
