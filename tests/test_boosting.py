"""Histogram boosting against a plain version that sorts rows and tries every split."""

import math
import random

import numpy as np
import pytest

from roomledger.operators import boosting
from roomledger.operators.boosting import Growth, boost, ensemble

NUMERIC = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    pick = random.Random(5)
    made = []
    for _ in range(600):
        kind, a, b = pick.randrange(4), pick.randrange(12), pick.random()
        odds = (2 if kind in (1, 3) else -1) + (1.5 if a > 6 else -1) + 2 * b - 1
        made.append((float(kind), float(a), round(b, 1), float(pick.random() < 1 / (1 + math.exp(-odds)))))
    return spark.createDataFrame(made, "kind__index double, a double, b double, y double")


def plain_tree(x, g, h, kinds, growth):
    """Leaves as (rows, value): the best split of each node over sorted values or sets of categories."""
    def best(at):
        found = (1e-9, None)
        whole = g[at].sum() ** 2 / h[at].sum()
        for f in range(x.shape[1]):
            values = x[at, f]
            if f < kinds:
                sums = {v: g[at][values == v].sum() / h[at][values == v].sum() for v in set(values)}
                place = {v: i for i, v in enumerate(sorted(sums, key=lambda v: (sums[v], v)))}
                values = np.array([place[v] for v in values])
            for cut in sorted(set(values))[:-1]:
                left = values <= cut
                if min(left.sum(), (~left).sum()) < growth.min_leaf:
                    continue
                gain = g[at][left].sum() ** 2 / h[at][left].sum() + g[at][~left].sum() ** 2 / h[at][~left].sum() - whole
                if gain > found[0] + 1e-9:
                    found = (gain, (at[left], at[~left]))
        return found

    done, front = [], [np.arange(len(g))]
    for _ in range(growth.depth):
        cuts = [best(at) for at in front]
        room = growth.leaves - len(done) - len(front)
        chosen = sorted((i for i, c in enumerate(cuts) if c[1]), key=lambda i: -cuts[i][0])[: max(0, room)]
        done += [at for i, at in enumerate(front) if i not in chosen]
        front = [part for i in chosen for part in cuts[i][1]]
    return [(at, -growth.learning_rate * g[at].sum() / h[at].sum()) for at in done + front]


@pytest.mark.parametrize("growth", [Growth(6, 0.3, 3, 31, 20, 255), Growth(4, 0.1, 6, 7, 5, 255)])
def test_scores_equal_a_plain_version(spark, rows, growth):
    given = np.array([tuple(r) for r in rows.collect()])
    x, y = given[:, :3], given[:, 3]
    base, trees, how = boost(rows, ["kind__index"], [5], NUMERIC, "y", growth)
    score = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    assert base == pytest.approx(score[0])
    bins = how.bins([x[:, i] for i in range(3)]).T
    got = np.full(len(y), base)
    for tree in trees:
        p = 1 / (1 + np.exp(-score))
        for at, value in plain_tree(x, p - y, p * (1 - p), 1, growth):
            score[at] += value
        got += np.array(tree.value)[tree.places(bins, growth.depth)]
        assert got == pytest.approx(score, abs=1e-9)
        assert sum(f < 0 for f in tree.feature) <= growth.leaves


def test_spark_scores_what_the_trees_say(spark, rows):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    base, trees, how = boost(rows, ["kind__index"], [5], NUMERIC, "y", Growth(8, 0.2, 4, 31, 10, 16))
    model = ensemble(spark, base, trees, how, "v", "y")
    given = VectorAssembler(inputCols=["kind__index", *NUMERIC], outputCol="v").transform(rows)
    scored = model.transform(given).select("kind__index", *NUMERIC, vector_to_array("probability")[1].alias("p")).collect()
    x = np.array([tuple(r) for r in scored])
    bins = how.bins([x[:, i] for i in range(3)]).T
    score = base + sum(np.array(t.value)[t.places(bins, 4)] for t in trees)
    assert x[:, 3] == pytest.approx(1 / (1 + np.exp(-score)), abs=1e-12)


def test_workers_agree_and_share_the_work(spark, rows, monkeypatch):
    growth = Growth(5, 0.3, 4, 31, 10, 255)
    alone = boost(rows, ["kind__index"], [5], NUMERIC, "y", growth, workers=1)[1]
    shared = boost(rows, ["kind__index"], [5], NUMERIC, "y", growth, workers=3)[1]
    for one, other in zip(alone, shared, strict=True):
        assert (one.feature, one.left, one.rows) == (other.feature, other.left, other.rows)
        assert one.value == pytest.approx(other.value, abs=1e-12)
    assert boosting.workers_for(spark, 10) == 1


def test_a_fit_goes_on_from_saved_rounds(spark, rows, folder, monkeypatch):
    monkeypatch.setattr(boosting, "SAVE_EVERY", 3)
    growth = Growth(7, 0.3, 3, 31, 20, 255)
    whole = boost(rows, ["kind__index"], [5], NUMERIC, "y", growth)[1]
    calls, rounds = [], boosting._rounds

    def failing(*args):
        calls.append(args[4])
        if len(calls) == 2:
            raise RuntimeError("executor lost")
        return rounds(*args)

    monkeypatch.setattr(boosting, "_rounds", failing)
    with pytest.raises(RuntimeError):
        boost(rows, ["kind__index"], [5], NUMERIC, "y", growth, saved=f"{folder}/trees")
    again = boost(rows, ["kind__index"], [5], NUMERIC, "y", growth, saved=f"{folder}/trees")[1]
    assert calls == [3, 3, 3, 1]  # the first three rounds were not grown again
    for one, other in zip(again, whole, strict=True):  # rows come in another order, so sums round differently
        assert one.feature == other.feature and one.value == pytest.approx(other.value, abs=1e-12)


def test_edges(spark, rows):
    growth = Growth(3, 0.3, 3, 31, 20, 255)
    always = rows.selectExpr("kind__index", "a", "b", "1.0D AS y")
    base, trees, how = boost(always, ["kind__index"], [5], NUMERIC, "y", growth)
    assert trees == [] and base > 10
    assert ensemble(spark, base, trees, how, "v", "y").getNumTrees == 1
    with pytest.raises(ValueError):
        boost(rows.limit(0), ["kind__index"], [5], NUMERIC, "y", growth)
    with pytest.raises(ValueError):
        boost(rows, [], [], NUMERIC, "y", Growth(-1, 0.3, 3, 31, 20, 255))
    odd = rows.selectExpr("a", "CASE WHEN a > 6 THEN double('NaN') ELSE b END AS b", "y")
    many = rows.selectExpr("CAST(a * 100 AS DOUBLE) AS many__index", "b", "y")
    assert len(boost(odd, [], [], NUMERIC, "y", growth)[1]) == 3
    wide = boost(many, ["many__index"], [1200], ["b"], "y", growth)
    assert wide[2].kind == np.uint16 and len(wide[1]) == 3


def test_joint_counts_are_the_sums_of_each_feature():
    from roomledger.operators import boosting as b

    rng, how = np.random.default_rng(3), b.Binning((3, 9, 300), ((0.5,), tuple(map(float, range(254))), ()))
    bins = np.array([rng.integers(0, size, 500) for size in how.sizes], how.kind)
    worker = b._Worker(np.zeros(500), bins, how, b.Growth(1, 0.1, 2, 4, 1, 255), lambda own: own)
    worker.g, worker.h = rng.random(500), rng.random(500)
    rows, slot = np.arange(0, 500, 2), rng.integers(0, 3, 250)
    got = worker.histogram(rows, slot, 3)
    for f, size in enumerate(how.sizes):
        for kind, of in enumerate((worker.g, worker.h, np.ones(500))):
            expected = np.zeros((3, size))
            np.add.at(expected, (slot, bins[f, rows]), of[rows])
            assert np.allclose(got[kind, :, worker.offsets[f] : worker.offsets[f + 1]], expected)
    assert len(worker.groups) < len(how.sizes) and sorted(f for g in worker.groups for f in g) == list(range(len(how.sizes)))


def _large(rng, how, count):
    bins = np.array([rng.integers(0, size, count) for size in how.sizes], how.kind)
    return boosting._Worker((rng.random(count) < 0.4).astype(float), bins, how, Growth(1, 0.3, 6, 31, 5, 255), lambda own: own), bins


def test_trees_are_added_without_a_walk(monkeypatch):  # F1, F3
    """Scores that a fit goes on from are those of a walk through every tree, also of one with many leaves."""
    worker, bins = _large(np.random.default_rng(7), boosting.Binning((4, 9), (tuple(map(float, range(30))), (0.5,))), 3000)
    made = [worker.grow(np.zeros(3000)) for _ in range(2)]
    walked = sum(np.array(t.value)[t.places(bins, 6)] for t in made)
    for most in (62, 2):
        monkeypatch.setattr(boosting.LeafSets, "MOST", most)
        score = np.zeros(3000)
        worker.add(score, made)
        assert score == pytest.approx(walked, abs=1e-12)


def test_packed_rows_are_narrow_and_few(spark, rows):  # F1, F3
    how = boosting.binning(rows, ["kind__index"], [5], NUMERIC, 255)
    packed = boosting._packed(rows.coalesce(1), ["kind__index", *NUMERIC], "y", how).collect()
    assert len(packed) < 10 and sum(r.row_count for r in packed) == 600
    assert sum(r.positive for r in packed) == sum(r.y for r in rows.collect())
    kept = [np.frombuffer(r.cells, boosting.cell_kind(how.sizes, boosting.joint_groups(how.sizes))) for r in packed]
    assert sum(map(len, kept)) == 600 * len(boosting.joint_groups(how.sizes))


def test_chunks_and_mapped_arrays_change_nothing(monkeypatch):  # F9
    how = boosting.Binning((4, 9), (tuple(map(float, range(30))), (0.5,)))
    whole, _ = _large(np.random.default_rng(3), how, 3000)
    monkeypatch.setattr(boosting, "CHUNK_ROWS", 700)
    monkeypatch.setattr(boosting, "MAPPED_BYTES", 100)
    parts, _ = _large(np.random.default_rng(3), how, 3000)
    assert isinstance(parts.g.base, np.memmap) and not isinstance(whole.g.base, np.memmap)
    a, b = np.zeros(3000), np.zeros(3000)
    one, other = whole.grow(a), parts.grow(b)
    assert (one.feature, one.left, one.rows) == (other.feature, other.left, other.rows) and a == pytest.approx(b, abs=1e-12)


def test_exchanged_values_are_scored_by_look_ups(spark, rows, monkeypatch):  # F2
    """Margins with one value taken from another row equal those of Spark's model on such rows."""
    from pyspark.ml.linalg import Vectors

    base, trees, how = boost(rows, ["kind__index"], [5], NUMERIC, "y", Growth(6, 0.3, 4, 31, 10, 16))
    model = ensemble(spark, base, trees, how, "v", "y")
    held = boosting.grown(spark, model)
    x = np.array([tuple(r)[:3] for r in rows.limit(60).collect()]).T
    others, trees_of = x[:, ::-1], [[t for t, tree in enumerate(held.trees) if f in tree.feature] for f in range(3)]
    margin = lambda x: np.array([model.predictRaw(Vectors.dense(row))[1] for row in x.T])
    for most in (62, 2):
        monkeypatch.setattr(boosting.LeafSets, "MOST", most)
        own, moved = boosting.exchanged_margins(held, list(x), list(others), trees_of)
        assert own == pytest.approx(margin(x), abs=1e-9)
        for f in range(3):
            mixed = x.copy()
            mixed[f] = others[f]
            assert moved[f] == pytest.approx(margin(mixed), abs=1e-9)
    with pytest.raises(ValueError):
        boosting.exchanged_margins(held, [x[0], x[1] * np.nan, x[2]], [], trees_of)
