"""Whitening against plain exact and numpy versions."""

import math
from fractions import Fraction

import numpy as np
import pytest

from roomledger.llm import whitening
from roomledger.llm.queries import op12_whitening

FIELDS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def plain(rows):
    """n, S, exact covariance and deviations of (id, vector) rows that count."""
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows]
    n, d = len(kept), len(kept[0][1])
    sums = [sum(x[k] for _, x in kept) for k in range(d)]
    off = [[n * x[k] - sums[k] for k in range(d)] for _, x in kept]
    matrix = [[Fraction(sum(o[a] * o[b] for o in off), n ** 3) for b in range(d)] for a in range(d)]
    return n, sums, np.array([[float(x) for x in row] for row in matrix]), [sum(y * y for y in o) for o in off], np.array(off, object)


def check(found, rows, most=32):
    n, _, matrix, deviations, off = plain(rows)
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1], vectors[:, ::-1]
    size = min(most, int((values > len(matrix) * 2.3e-16 * values[0]).sum()))
    assert len(found) == len(rows) * size
    by_row = {}
    for r in found:
        by_row.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
        assert r.n == n and r.identity_error < 1e-4
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(matrix), rel=1e-6)
    expected = (off / n).astype(float) @ vectors[:, :size] / np.sqrt(values[:size])
    for (i, _), deviation, wanted in zip(rows, deviations, expected, strict=True):
        got = by_row[i, deviation]
        assert sorted(got) == list(range(1, size + 1))
        for k in range(size):
            assert min(abs(abs(w) - abs(wanted[k])) for w in got[k + 1]) < 1e-6


def test_covariance_is_exact(spark):
    pick = np.random.default_rng(1)
    rows = [(i, (pick.standard_normal(7) * [1, 2, 3, 1, 100, 0.1, 5] + 9).tolist()) for i in range(333)]
    frame = table(spark, rows).withColumnRenamed("embedding", "vector")
    known = whitening.moments(frame)
    n, sums, matrix, _, _ = plain(rows)
    assert (known.n, known.sums) == (n, sums)
    assert (whitening.covariance(whitening.squares(frame, known), known) == matrix).all()


def test_large_entries_stay_exact(spark):
    rows = [(i, [1e15 * (-1) ** i + i, 5.0 * i, 3e16 + i * 1e13]) for i in range(40)]
    frame = table(spark, rows).withColumnRenamed("embedding", "vector")
    known = whitening.moments(frame)
    n, sums, matrix, deviations, _ = plain(rows)
    assert (known.n, known.sums) == (n, sums)
    assert (whitening.covariance(whitening.squares(frame, known), known) == matrix).all()
    found = whitening.whitened(table(spark, rows)).collect()
    assert {r.vec_id: r.deviation for r in found} == {i: (d if d < 2**63 else None) for (i, _), d in zip(rows, deviations, strict=True)}


def test_whitened_rows(spark):
    pick = np.random.default_rng(2)
    mix = pick.standard_normal((6, 6))
    rows = [(i, (pick.standard_normal(6) @ mix).tolist()) for i in range(500)]
    found = whitening.whitened(table(spark, rows)).collect()
    check(found, rows)
    w = np.array([[r.component, r.whitened] for r in sorted(found, key=lambda r: (r.component, r.vec_id))])[:, 1].reshape(6, 500)
    assert np.abs(w @ w.T / 500 - np.eye(6)).max() < 1e-9


def test_what_is_dropped(spark):
    good = [(i, [float(i % 7), float(i * i % 11), 0.5 * i]) for i in range(30)] + [(3, [3.0, 9.0, 1.5])] * 2
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [1.0, float("inf"), 2.0]),
           (105, [1.0, 2.0]), (106, [1e300, 1.0, 1.0])]
    given = table(spark, good + bad).selectExpr("*", "1 AS component", "'x' AS n")
    found = whitening.whitened(given)
    assert found.columns == FIELDS
    assert {r.vec_id for r in found.collect()} == {i for i, _ in good}
    check(found.collect(), good)
    nobody = table(spark, good).selectExpr("CAST(NULL AS LONG) AS vec_id", "embedding")
    assert whitening.whitened(nobody).filter("vec_id IS NULL").count() == len(good) * 3


def test_nothing_to_whiten(spark):
    assert whitening.whitened(table(spark, [])).collect() == []
    assert whitening.whitened(table(spark, [(1, [1.0, 2.0])] * 5)).collect() == []
    flat = whitening.whitened(table(spark, [(i, [float(i), 7.0]) for i in range(9)])).collect()
    assert {r.component for r in flat} == {1} and {round(r.explained, 12) for r in flat} == {1.0}


def test_width_is_the_most_frequent(spark):
    rows = [(i, [float(i), float(i % 3)]) for i in range(6)] + [(10 + i, [float(i), 1.0 * (i % 2), float(i % 3)]) for i in range(6)]
    assert {r.vec_id for r in whitening.whitened(table(spark, rows)).collect()} == set(range(10, 16))


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(op12_whitening(spark, folder).collect(), rows)
