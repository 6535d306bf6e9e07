"""SimHash, components, repeated strings and decontamination against plain versions."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from roomledger.llm import components, decontam, repeats, simhash

PICK = random.Random(5)
BASE = "".join(PICK.choice("abcdef ") for _ in range(4000))
EXTRA = [
    (9001, "a" * 3000), (9002, "ab" * 1500), (9003, "x" + "a" * 700 + "y"), (9004, None), (9005, ""), (9006, BASE[:199]), (9007, BASE[:200]),
    (9008, BASE[100:700] + "Z" + BASE[701:1500]), (9009, BASE), (9009, BASE), (None, BASE[50:900]), (9011, "é" * 250), (9012, "é" * 60 + BASE[:250]),
    (9013, " \n"), (9014, "ONE two\tthree"), (9015, "one two three"),
]


@pytest.fixture(scope="module")
def documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame(EXTRA, docs.schema)).withColumn("fingerprint", F.lit("clash"))
    return docs, [(r.doc_id, r.text) for r in docs.collect()]


def test_near_duplicates(documents):
    docs, rows = documents
    prints = [(i, brute.fingerprint(t)) for i, t in rows]
    want = [(i, f"{p:016x}", c) for (i, p), c in zip(prints, brute.component_ids(prints), strict=True)]
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str) == sorted(want, key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def edited(words, edits, seed):
    pick = random.Random(seed)
    places = set(pick.sample(range(len(words)), edits))
    return " ".join(f"w{pick.randint(10**6, 10**7)}" if i in places else w for i, w in enumerate(words))


def test_one_of_each_group_of_similar_documents(spark):
    """Copies with few edits go, half-changed ones and unrelated ones stay."""
    pick, rows, want = random.Random(8), [], set()
    for g in range(25):
        words = [f"w{pick.randint(0, 10**6)}" for _ in range(pick.choice([100, 200, 500]))]
        first = 1000 * g
        rows += [(first, " ".join(words)), (first + 1, " ".join(words).upper().replace(" ", " \n")), (first + 2, " ".join(words))]
        rows += [(first + 10 + i, edited(words, len(words) // 100, first + i)) for i in range(6)]
        rows += [(first + 20 + i, edited(words, len(words) // 4, first + i)) for i in range(3)]
        want |= {first, first + 20, first + 21, first + 22}
    rows += [(90_000, None), (90_001, ""), (90_002, " \t"), (90_003, "two words"), (90_004, "Two  words"), (90_005, "two word"), (90_006, "x"), (90_006, "x")]
    rows += [(None, "nobody's text"), (None, "two words")]
    want |= {90_000, 90_003, 90_005, 90_006, None}
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, root string")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    found = [r.doc_id for r in kept.collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_similar_documents_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    assert found == brute.kept_of_similar(rows, 0.8)


def test_long_text_is_hashed_in_steps(monkeypatch):
    text = " ".join(PICK.choice(["a", "b", "c"]) for _ in range(500))
    monkeypatch.setattr(simhash, "_STEP", 7)
    for shingle in (1, 3, 5):
        assert simhash.fingerprint(text, shingle) == brute.fingerprint(text, shingle)


def clustered(count, seed):
    """Fingerprints in dense groups and alone."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 64, 12, dtype=np.uint64)
    out = set(rng.integers(0, 1 << 64, count, dtype=np.uint64).tolist())
    for c in centres.tolist():
        for _ in range(60):
            p = c
            for bit in rng.integers(0, 64, int(rng.integers(0, 5))).tolist():
                p ^= 1 << bit
            out.add(p)
    return np.array(sorted(out), np.uint64)


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        parent[find(a)] = find(b)
    out = {}
    for n in nodes:
        out.setdefault(find(n), set()).add(n)
    return sorted(map(frozenset, out.values()), key=min)


@pytest.mark.parametrize("block", [4, 32, 1024])
def test_tree_keeps_every_link(monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    prints = clustered(500, block)
    listed = prints.tolist()
    want = groups([(a, b) for i, a in enumerate(listed) for b in listed[i + 1 :] if (a ^ b).bit_count() <= 3], listed)
    a, b = simhash.links_within(prints, 3)
    pairs = list(zip(prints[a].tolist(), prints[b].tolist(), strict=True))
    assert len(pairs) < 40 * len(listed)
    assert groups(pairs, listed) == want


def test_long_fingerprints_decide(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    prints = clustered(100, 3)
    wide = np.random.default_rng(2).integers(0, 1 << 64, (len(prints), 2), dtype=np.uint64)
    wide[::2] = wide[0]
    a, b = simhash.links_within(prints, 3, wide, 5)
    assert len(a) and set(a.tolist()) | set(b.tolist()) <= set(range(0, len(prints), 2))


@pytest.mark.parametrize(("shard", "split"), [(64, 10**9), (64, 100), (10**9, 10**9)])
def test_shards_and_blocks_keep_every_link(spark, shard, split):
    prints = clustered(400, 9)
    listed = prints.view(np.int64).tolist()
    fps = spark.createDataFrame([(p,) for p in listed], "fp long")
    links = simhash.linked_fingerprints(fps, 3, shard, split)
    roots = {r.node: r.root for r in components.components(links).collect()}
    unsigned = prints.tolist()
    want = groups([(a, b) for i, a in enumerate(unsigned) for b in unsigned[i + 1 :] if (a ^ b).bit_count() <= 3], unsigned)
    got = {}
    for signed, plain in zip(listed, unsigned, strict=True):
        got.setdefault(roots.get(signed, signed), set()).add(plain)
    assert sorted(map(frozenset, got.values()), key=min) == want


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5000, 5000), (6001, 6000), (6000, 6001)]
    roots = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {roots[i] for i in range(61)} == {0} and {roots[1000 + i] for i in range(80)} == {1000}
    assert roots[6000] == roots[6001] == 6000 and 5000 not in roots


@pytest.mark.parametrize("group", [0, repeats.GROUP])
def test_repeats(documents, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    docs, rows = documents
    want = [(i, *w) for (i, _), w in zip(rows, brute.without_repeats([t for _, t in rows]), strict=True)]
    assert sorted(map(tuple, repeats.without_repeats(docs).collect()), key=str) == sorted(want, key=str)


def test_first_copies_stay(documents, monkeypatch):
    docs, rows = documents
    rows = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    docs = docs.distinct()
    want = [(i, *w) for (i, _), w in zip(rows, brute.without_repeats([t for _, t in rows], keep_first=True), strict=True)]
    for group in (repeats.GROUP, 0):
        monkeypatch.setattr(repeats, "GROUP", group)
        got = repeats.without_repeats(docs, keep_first=True).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_kept_bytes_and_empty_table(documents):
    docs, _ = documents
    kept = {r.doc_id: bytes(r.kept) for r in repeats.without_repeats(docs.filter("doc_id = 9001"), with_kept=True).collect()}
    assert kept == {9001: b""}
    assert repeats.without_repeats(docs.limit(0)).count() == 0


def test_long_documents_give_the_same_runs(monkeypatch):
    raw = ("".join(PICK.choice("ab ") for _ in range(9000)) + "x" * 5000 + "".join(PICK.choice("ab ") for _ in range(3000))).encode()
    data = np.frombuffer(raw, np.uint8)
    whole = repeats.runs(data, np.array([len(raw)]))
    monkeypatch.setattr(repeats, "STEP", 4 * repeats.RUN)
    parts = [np.concatenate(x) for x in zip(*repeats._document_runs(raw, 200, repeats.GRAM), strict=True)]
    covered = np.concatenate([np.arange(a, a + n) for a, n in zip(parts[0].tolist(), parts[1].tolist(), strict=True)])
    assert (covered == np.arange(len(raw) - 199)).all()
    strings = lambda r: {raw[a : a + n + 199] for a, n in zip(r[0].tolist(), r[1].tolist(), strict=True)}
    assert strings(parts) == strings(whole)


def test_suffix_classes():
    data = np.frombuffer(("abcabcabc" * 10 + "zz" + "abcabcabc" * 10).encode(), np.uint8)
    places = np.arange(len(data) - 29)
    classes = repeats.suffix_classes(data, places, 30)
    strings = [bytes(data[p : p + 30]) for p in places]
    order = sorted(set(strings))
    assert classes.tolist() == [order.index(s) for s in strings]
    earlier, later = repeats.factors(classes)
    assert earlier.tolist() == [s in strings[:i] for i, s in enumerate(strings)]
    assert later.tolist() == [s in strings[i + 1 :] for i, s in enumerate(strings)]


def test_contaminations(spark, documents):
    docs, rows = documents
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    more = [(500, None), (501, ""), (502, "one two three"), (503, "One  Two, three."), (None, items[0][1])]
    words = items[1][1].split()
    near = [(9101, "Start " + " ".join(words) + " end"), (9102, " ".join(words[:-1])), (9103, " ".join([*words[:10], "odd", *words[11:]])),
            (9104, " ".join(words).upper()), (9105, " ".join(words[: len(words) // 2])), (9106, "x, " + items[0][1])]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    bench = spark.createDataFrame(items + more, "item_id long, text string")
    got = decontam.contaminations(docs, bench).collect()
    want = brute.contaminations(rows + near, items + more)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert {9101, 9104, 9106, 9014, 9015} <= {r.doc_id for r in got} and 9105 not in {r.doc_id for r in got}
    clean = decontam.decontaminated(docs.withColumn("item_id", F.lit(1)), bench)
    assert clean.columns == ["doc_id", "text", "item_id"]
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows + near} - {k[0] for k in want}
    assert decontam.contaminations(docs.limit(0), bench).count() == decontam.contaminations(docs, bench.limit(0)).count() == 0


def test_items_in_blocks_and_windows_in_steps(spark, documents, monkeypatch):
    docs, _ = documents
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = sorted(map(tuple, decontam.contaminations(docs, bench).collect()))
    monkeypatch.setattr(decontam, "ITEM_BLOCK", 15)
    assert sorted(map(tuple, decontam.contaminations(docs, bench).collect())) == whole
    index = decontam.Index([(1, "a b c d e f g h i j")])
    text = "a b c d e f g h i j " * 3 + "x " * 50 + "a b c d e f g h i j"
    once = index.matches(text)
    monkeypatch.setattr(decontam, "_STEP", 2)
    assert index.matches(text) == once and once[0][1] == 1.0


def test_decontamination_equals_its_sql(spark):
    from oracle import compare, connect

    from roomledger.llm.oracles import ORACLES
    from roomledger.llm.queries import QUERIES

    sf_dir = "/root/testdata/sf0.01"
    assert compare(QUERIES["op10_decontamination"](spark, sf_dir), connect(sf_dir), ORACLES["op10_decontamination"]) is None
