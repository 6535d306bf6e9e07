"""Near-duplicates of the pipeline: copies cut, extended and edited, against the exact similarity."""

import random

import brute
import numpy as np
from pyspark.sql import functions as F

from roomledger.llm import simhash


def cut_copies(share, count=40):
    """(id, text) of texts and of copies without their end, without their begin, and with a new end."""
    pick, rows = random.Random(12), []
    for g in range(count):
        words = [f"w{pick.randint(0, 10**6)}" for _ in range(pick.choice([60, 200, 700]))]
        kept = round(len(words) * share)
        more = [f"n{pick.randint(0, 10**6)}" for _ in range(round(len(words) / share) - len(words))]
        rows += [(10 * g + i, " ".join(w)) for i, w in enumerate([words, words[:kept], words[-kept:], words + more])]
    return rows


def test_cut_and_extended_copies_meet():
    for share in (0.82, 0.9):
        rows = cut_copies(share, 100)
        keys = [set(simhash.band_keys(simhash.signature(simhash.elements(t)))) for _, t in rows]
        met = [not keys[4 * g].isdisjoint(keys[4 * g + i]) for g in range(100) for i in (1, 2, 3)]
        assert sum(met) >= 298


def test_cut_and_extended_copies_go(spark):
    rows = cut_copies(0.9)
    found = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i for i, _ in rows if i % 10 == 0}


def test_elements_have_the_weighted_similarity():
    pick = random.Random(4)
    for _ in range(200):
        words = [pick.choice("abc") for _ in range(pick.choice([0, 1, 3, 5, 9, 60]))]
        a, b = " ".join(words), " ".join(words[pick.randint(0, 2) :] + [pick.choice("aB") for _ in range(3)])
        x, y = simhash.elements(a), simhash.elements(b)
        common = len(np.intersect1d(x, y))
        assert len(set(x.tolist())) == len(x)
        assert common / (len(x) + len(y) - common) == brute.similar(a, b) or not words


def test_a_key_of_many_is_cut_into_blocks(spark):
    rows = cut_copies(0.9, 12) + [(1000 + i, f"same words in all of these texts but for the last one of them which is {i} and " * 8) for i in range(30)]
    docs = spark.createDataFrame(rows, "node long, text string").withColumns({"__id": F.col("node"), "__text": F.xxhash64("text")})
    texts = docs.select("__id", "__text", "text")
    hashed = simhash.materialize(simhash.banded(docs, ["node", "__id", "__text"]), "banded")
    whole = sorted(map(tuple, simhash.similar_groups(hashed, texts).collect()))
    assert sorted(map(tuple, simhash.similar_groups(hashed, texts, shard=3, split=4).collect())) == whole


def test_exactly_the_similarity_decides(spark):
    """Copies of 0.8 and a little more go, those of a little less stay."""
    pick, rows, want = random.Random(6), [], set()
    for g in range(40):
        words = [f"w{pick.randint(0, 10**6)}" for _ in range(pick.choice([84, 204, 1004]))]
        grams = len(words) - 4
        for i, kept in enumerate([grams, grams * 4 // 5, grams * 4 // 5 - 1]):
            rows.append((10 * g + i, " ".join(words[: kept + 4] if g % 2 else words[-kept - 4 :])))
        rows.append((10 * g + 5, " ".join(words + ["again and again and again"] * (grams // 20 + 1))))  # the weights count
    for similarity in (0.8, 0.85):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        found = {r.doc_id for r in simhash.one_of_each(docs, similarity=similarity).collect()}
        assert found == brute.kept_of_similar(rows, similarity)


def test_table_is_deduplicated_at_the_similarity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == brute.kept_of_similar(rows, 0.8)


def test_a_group_is_compared_in_blocks(spark):
    """Blocks of a few documents, and of less than one, give what one task gives."""
    pick = random.Random(3)
    words, rows = [f"w{i}" for i in range(300)], []
    for i in range(25):  # a chain: neighbours are similar, the ends are not
        rows.append((i, " ".join(words[6 * i : 6 * i + 150])))
    rows += [(100 + i, " ".join([f"v{pick.randint(0, 9)}" for _ in range(i)])) for i in range(12)]
    docs = spark.createDataFrame(rows, "node long, text string").withColumns({"__id": F.col("node"), "__text": F.xxhash64("text")})
    texts = docs.select("__id", "__text", "text")
    hashed = simhash.materialize(simhash.banded(docs, ["node", "__id", "__text"]), "banded")
    whole = sorted(map(tuple, simhash.similar_groups(hashed, texts).collect()))
    assert {root for node, root in whole if node < 25} == {0}
    for held in (500, 50):
        assert sorted(map(tuple, simhash.similar_groups(hashed, texts, held=held).collect())) == whole


def test_near_fingerprints_meet_in_the_tree(spark):
    """Documents whose fingerprints differ in three bits or fewer are linked before any band is read."""
    pick, rows = random.Random(5), []
    for g in range(30):
        words = [f"w{pick.randint(0, 10**6)}" for _ in range(400)]
        rows += [(10 * g, " ".join(words)), (10 * g + 1, " ".join(words[:-1])), (10 * g + 2, " ".join(words[:300]))]
    hashed = simhash.materialize(simhash.banded(spark.createDataFrame(rows, "node long, text string"), ["node"]), "banded")
    fps = {r.node: np.uint64(r.fp & (1 << 64) - 1) for r in hashed.collect()}
    assert all(int(fps[i]) == simhash.fingerprint(t, 5) for i, t in rows)
    near = [(a, b) for a in fps for b in fps if a < b and int(fps[a] ^ fps[b]).bit_count() <= simhash.RADIUS]
    linked = {tuple(sorted(r)) for r in simhash._near_prints(hashed, simhash.SHARD, simhash.SPLIT).collect()}
    assert len(near) > 20 and linked <= set(near)
    assert {n for pair in near for n in pair} == {n for pair in linked for n in pair}
