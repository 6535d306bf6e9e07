"""Near-duplicates by SimHash, searched with vantage-point trees.

Different fingerprints are dealt out by a tree of vantage points: those within the median Hamming
distance go inside, the others outside, and by the triangle inequality only fingerprints whose distance
is within the radius of the border can have partners across it, so those are copied inside as well. All
pairs within the radius thus meet in some shard. A shard goes on dividing the same way in its task.

Triangle bounds prune only at a small radius: unrelated fingerprints of 64 bits are some 32 bits apart, give
or take 4. Documents of a given similarity are further apart than that allows, so ``similar_groups`` seeks them
by bands of minimum hashes of their shingles, whose chance to meet follows from the similarity alone, whatever
the edit was, and compares the shingles themselves of those that meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_intdigest

from roomledger.llm.arrow import bounded_batches, handed_back, in_batches
from roomledger.llm.components import components
from roomledger.session import work_dir
from roomledger.sources.tables import materialize

SEED = 42
SHINGLE = 3
RADIUS = 3
SIMILARITY, SIMILAR_SHINGLE = 0.8, 5
BANDS, BAND = 20, 5  # keys by which similar documents meet, of so many minimum hashes each: 0.04 % of pairs at 0.8 share none
LOOSE = 5  # deviations below the average of equal minimum hashes that a pair may have and still be compared
HELD = 4 << 20  # elements of a block of documents; a task compares two blocks. Results don't depend on it
SHARD = 131_072  # fingerprints a shard is meant to hold
SPLIT = 4 * SHARD  # a shard above this is compared block by block, in tasks of their own
TREE_SAMPLE = 65_536  # fingerprints, on average, that vantage points and borders are chosen from; results don't depend on it
BLOCK = 512  # fingerprints compared at once, few enough for a processor's cache
_TRIED = 6  # vantage points tried for one division
_ALL = (1 << 64) - 1
_TASK = ("turn", "shard", "i", "j")
_STEP = 1 << 16  # shingles hashed at once


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a whole text; a text without words has 0."""
    return int(_majority(*_shingle_hashes(_words(text), shingle), 1)[0])


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII spaces


def _shingle_hashes(words: list[bytes], shingle: int) -> tuple[int, Iterator[np.ndarray]]:
    """How many shingles there are, and their hashes a step at a time; too few words are one shingle."""
    if not words:
        return 0, iter(())
    count = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:count].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    steps = (
        _hashes([joined[a:b] for a, b in zip(starts[at : at + _STEP], ends[at : at + _STEP], strict=True)])
        for at in range(0, count, _STEP)
    )
    return count, steps


def _hashes(pieces: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(pieces))


def _again(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Another hash of what was hashed; turn 0 leaves it."""
    if turn:
        hashes = (hashes + np.uint64(turn * 0x9E3779B97F4A7C15 & _ALL)) * np.uint64(0xBF58476D1CE4E5B9)
        hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        hashes ^= hashes >> np.uint64(32)
    return hashes


def _majority(count: int, steps: Iterator[np.ndarray], longs: int) -> np.ndarray:
    """SimHash of so many longs: a bit is set where it is in over half of the hashes."""
    ones = np.zeros((longs, 64), np.int64)
    for hashes in steps:
        for turn in range(longs):
            bits = np.unpackbits(_again(hashes, turn).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[turn] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > count, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def elements(text: str | None, shingle: int = SIMILAR_SHINGLE) -> np.ndarray:
    """Sorted hashes of a text's shingles, a shingle's second, third ... occurrence being elements of their own.

    So the weighted similarity of two texts is that of the sets of their elements.
    """
    return _elements(_all_hashes(_words(text), shingle))


def _all_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    return np.concatenate([np.empty(0, np.uint64), *_shingle_hashes(words, shingle)[1]])


def _elements(hashes: np.ndarray) -> np.ndarray:
    found = np.sort(hashes)
    if len(found):
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        nth = np.arange(len(found)) - np.repeat(first, np.diff(np.append(first, len(found))))
        if nth.any():
            found = np.sort(np.where(nth > 0, _again(found + nth.astype(np.uint64) * _ODD[0], 1), found))
    return found


_ODD, _FLIP = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * BAND), dtype=np.uint64)
_ODD |= np.uint64(1)


def signature(found: np.ndarray) -> np.ndarray:
    """Minimum hashes of a set: each is equal in two sets with the probability of their similarity."""
    least = np.full(len(_ODD), _ALL, np.uint64)
    for at in range(0, len(found), BLOCK):
        np.minimum(least, ((found[at : at + BLOCK, None] ^ _FLIP) * _ODD).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> list[int]:
    """A key per band of a signature."""
    return [xxh64_intdigest(least[i * BAND : (i + 1) * BAND].tobytes(), i) for i in range(BANDS)]


def sketch(least: np.ndarray) -> bytes:
    """The lowest byte of each minimum hash: about as many are equal as the similarity says."""
    return (least & np.uint64(255)).astype(np.uint8).tobytes()


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (as a signed long) of every row."""

    def hash_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    bounded_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(in_batches(hash_batch), f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, fp long")


def _distance(a, b) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b))


def _vantage(fps: np.ndarray, radius: int) -> tuple[np.uint64, int]:
    """The vantage point and border that divide the fingerprints with the least work left.

    A few of them are tried, as the one that divided the parent can't divide its halves again. The work
    of a side grows as the square of its size.
    """
    some = fps[:: max(1, len(fps) // 4096)]
    best = (np.inf, fps[0], 64)
    for point in fps[(np.arange(1, _TRIED + 1) * len(fps)) // (_TRIED + 1)]:
        at_most = np.cumsum(np.bincount(_distance(some, point), minlength=65)) / len(some)
        inside = at_most[np.minimum(np.arange(65) + radius, 64)]
        work = inside**2 + (1 - at_most) ** 2
        if work.min() < best[0]:
            best = (work.min(), point, int(work.argmin()))
    return best[1], best[2]


def vantage_tree(sample: np.ndarray, depth: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and borders of a full tree, node i having children 2i and 2i + 1."""
    points = np.zeros(1 << depth, np.uint64)
    borders = np.full(1 << depth, 64, np.int64)
    inside: dict[int, np.ndarray] = {1: sample}
    for node in range(1, 1 << depth):
        own = inside.pop(node)
        if len(own):
            points[node], borders[node] = _vantage(own, radius)
            d = _distance(own, points[node])
            inside[2 * node], inside[2 * node + 1] = own[d <= borders[node] + radius], own[d > borders[node]]
        else:
            inside[2 * node] = inside[2 * node + 1] = own
    return points, borders


def shards_of(fps: np.ndarray, points: np.ndarray, borders: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, place) rows: each fingerprint goes to its own shard and to those it overlaps."""
    node, at = np.ones(len(fps), np.int64), np.arange(len(fps))
    for _ in range(len(points).bit_length() - 1):
        d, border = _distance(fps[at], points[node]).astype(np.int64), borders[node]
        inside, outside = d <= border + radius, d > border
        at = np.concatenate([at[inside], at[outside]])
        node = np.concatenate([2 * node[inside], 2 * node[outside] + 1])
    return node, at


class _Search:
    """Fingerprints of one shard and, if the near ones are to be judged further, their long fingerprints."""

    def __init__(self, fps: np.ndarray, radius: int, wide: np.ndarray | None = None, most: int = 0):
        self.fps, self.radius, self.wide, self.most = fps, radius, wide, most

    def near(self, one: int, others: np.ndarray) -> np.ndarray:
        """Which of the others link to one."""
        found = _distance(self.fps[others], self.fps[one]) <= self.radius
        if self.wide is not None and found.any():
            at = np.flatnonzero(found)
            found[at] = _distance(self.wide[others[at]], self.wide[one]).sum(axis=1) <= self.most
        return found

    def spanning(self, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Links that join whatever links join, one per fingerprint at most.

        A found fingerprint is searched once, among those not found yet: a dense group of n makes n - 1
        links, to its first member, and never n * n pairs.
        """
        links = []
        while len(at) > 1:
            first, queue, at = at[0], [at[0]], at[1:]
            while queue and len(at):
                near = self.near(queue.pop(), at)
                if near.any():
                    found, at = at[near], at[~near]
                    links.append((np.full(len(found), first), found))
                    queue.extend(found)
        return links

    def links(self, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Links among the fingerprints there, dividing them until few are left."""
        fps = self.fps[at]
        if len(at) <= BLOCK:
            near = _distance(fps[:, None], fps[None, :]) <= self.radius
            return self.spanning(at[near.sum(axis=1) > 1])
        point, border = _vantage(fps, self.radius)
        d = _distance(fps, point)
        inside, outside = at[d <= border + self.radius], at[d > border]
        if max(len(inside), len(outside)) > 0.95 * len(at):
            return self.spanning(at)  # all are about as far from each other; the tree can't divide them
        return self.links(inside) + self.links(outside)


def links_within(fps: np.ndarray, radius: int, wide: np.ndarray | None = None, most: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of links that connect exactly what the pairs within the radius connect.

    With long fingerprints, only pairs that differ in ``most`` of their bits or fewer count.
    """
    found = _Search(fps, radius, wide, most).links(np.arange(len(fps)))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = (np.concatenate(side) for side in zip(*found, strict=True))
    return a, b


def _dealt(rows: DataFrame, turns: int, radius: int, shard: int, split: int, path: str) -> DataFrame:
    """The rows (turn, node, fp, and maybe more) with their task (turn, shard, i, j), copied where they overlap.

    Each turn is a search of its own; one tree serves all, since any vantage points are right.

    They are written to the path on the way.

    How deep the tree is follows from the number of fingerprints. A shard that came out too large, as
    fingerprints close to each other do, is cut into blocks and every pair of blocks is a task.
    """
    spark = rows.sparkSession
    total = rows.count()
    depth, size = 0, total / turns
    while size > shard and depth < 24:
        depth, size = depth + 1, size * 0.65  # half of them, and three tenths more for the overlap
    chosen = F.pmod(F.xxhash64("fp"), F.lit(max(total, 1))) < TREE_SAMPLE  # about that many, whatever the total
    sample = rows.select("fp").filter(chosen if depth else F.lit(False)).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    points, borders = vantage_tree(sample, depth, radius)
    at = rows.columns.index("fp")

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = batch.column(at).to_numpy(zero_copy_only=False).view(np.uint64)
        node, copied = shards_of(own, points, borders, radius)
        take = pa.array(copied)
        return pa.RecordBatch.from_arrays(
            [pa.array(node), *(c.take(take) for c in batch.columns)], names=["shard", *batch.schema.names])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    rows.mapInArrow(in_batches(deal), f"shard long, {fields}").write.parquet(path)
    dealt = spark.read.schema(f"shard long, {fields}").parquet(path)
    large = dealt.groupBy("turn", "shard").agg(F.count("*").alias("n")).filter(F.col("n") > split)
    large = large.select("turn", "shard", F.ceil(F.col("n") / F.lit(shard)).cast("int").alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    placed = dealt.join(large, ["turn", "shard"], "left").select(
        "shard", *rows.columns, own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    placed = placed.select(
        "shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *rows.columns)
    # few bytes and much work: the number of tasks must not follow the size of the data
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * total // shard)
    return placed.repartition(tasks, *_TASK)


def _compare(radius: int):
    """Function for applyInPandas that finds the links (a, b) among the nodes of a task."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        node = group["node"].to_numpy(np.int64)
        a, b = links_within(group["fp"].to_numpy(np.int64).view(np.uint64), radius)
        return pd.DataFrame({"a": node[a], "b": node[b]})

    return compare


def linked_fingerprints(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD, split: int = SPLIT) -> DataFrame:
    """Links (a, b) among the different fingerprints of a written table (fp)."""
    rows = fps.select(F.lit(0).alias("turn"), F.col("fp").alias("node"), "fp")
    placed = _dealt(rows, 1, radius, shard, split, work_dir(fps.sparkSession, "shards"))
    return placed.groupBy(*_TASK).applyInPandas(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id of the row's component.

    Texts without words, null ones too, have fingerprint zero and are linked like any other. Repeated
    rows come out repeated. A null id is passed over when the least is sought; component_id is null
    only where a whole component has none. Other columns are ignored.
    """
    hashed = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    groups = materialize(hashed.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(linked_fingerprints(groups, radius))
    rooted = groups.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(ids, "root").select("fp", "component_id")
    return hashed.join(of_fp, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def banded(docs: DataFrame, keep: list[str], shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """Kept columns of documents (with text) and what they meet by.

    These are same (a digest of the words in order), fp (SimHash of the shingles), keys of the bands, sketch (a byte
    of each minimum hash) and n, the number of elements.
    """

    def hash_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        same, fps, keys, sketches, counts = [], [], [], [], []
        for text in batch.column(batch.num_columns - 1).to_pylist():
            words = _words(text)
            hashes = _all_hashes(words, shingle)
            least = signature(_elements(hashes))
            same.append(xxh3_128_digest(b" ".join(words)))
            fps.append(_majority(len(hashes), (hashes[i : i + _STEP] for i in range(0, len(hashes), _STEP)), 1)[0])
            keys.append(np.array(band_keys(least), np.uint64).view(np.int64).tolist())
            sketches.append(sketch(least))
            counts.append(len(hashes))
        return pa.RecordBatch.from_arrays([
            *batch.columns[:-1], pa.array(same, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)),
            pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(counts, pa.int64()),
        ], names=[*batch.schema.names[:-1], "same", "fp", "keys", "sketch", "n"])

    bounded_batches(docs.sparkSession)
    chosen = docs.select(*keep, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(in_batches(hash_batch), f"{fields}, same binary, fp long, keys array<long>, sketch binary, n long")


class _Sketched(_Search):
    """Documents that may be similar, judged by their sketches with so much slack that similar ones pass."""

    def __init__(self, sketches: list[bytes], similarity: float):
        self.sketches = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
        count = self.sketches.shape[1]
        self.enough = count * similarity - LOOSE * np.sqrt(count * similarity * (1 - similarity))

    def near(self, one: int, others: np.ndarray) -> np.ndarray:
        found = np.zeros(len(others), bool)
        for at in range(0, len(others), _STEP):
            some = slice(at, at + _STEP)
            found[some] = (self.sketches[others[some]] == self.sketches[one]).sum(axis=1) >= self.enough
        return found


class _Exact(_Sketched):
    """Documents that are similar by their elements."""

    def __init__(self, sketches: list[bytes], similarity: float, elements_of: list[np.ndarray]):
        super().__init__(sketches, similarity)
        self.similarity, self.elements, self.sizes = similarity, elements_of, np.array([len(own) for own in elements_of])

    def near(self, one: int, others: np.ndarray) -> np.ndarray:
        found = super().near(one, others)
        size, sizes = self.sizes[one], self.sizes[others]
        found &= np.minimum(size, sizes) >= self.similarity * np.maximum(size, sizes) - 1e-6
        own = self.elements[one]
        for at in np.flatnonzero(found).tolist():
            found[at] = similarity_of(own, self.elements[others[at]]) >= self.similarity
        return found


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the elements of two sorted sets that are in both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return common / (len(a) + len(b) - common)


def _met(kinds: DataFrame, shard: int, split: int) -> DataFrame:
    """Rows (key, node, sketch) of keys that several nodes have, with their task (shard, i, j).

    A key of too many nodes is cut into blocks, and every pair of blocks is a task.
    """
    rows = kinds.select(F.explode("keys").alias("key"), "node")
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    rows = materialize(rows.join(shared, "key"), "met")
    total = rows.count()
    blocks = F.when(F.col("n") > split, F.ceil(F.col("n") / F.lit(shard))).otherwise(1).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    placed = rows.join(kinds.select("node", "sketch"), "node").select(
        F.pmod(F.xxhash64("key"), F.lit(total // shard + 16)).alias("shard"), "key", "node", "sketch", own.alias("own"),
        F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    placed = placed.select("shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "key", "node", "sketch")
    tasks = max(int(kinds.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * total // shard)
    return placed.repartition(tasks, "shard", "i", "j")


def _compare_met(similarity: float):
    """Function for applyInPandas that finds the links (a, b) among the nodes that share a key and may be similar."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key", kind="stable")
        node, key = group["node"].to_numpy(np.int64), group["key"].to_numpy(np.int64)
        search, found = _Sketched(group["sketch"].tolist(), similarity), []
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])).tolist()
        for first, last in zip(edges, edges[1:], strict=False):
            found += search.spanning(np.arange(first, last))
        a, b = (np.concatenate([np.empty(0, np.int64), *side]) for side in (zip(*found, strict=True) if found else ((), ())))
        return pd.DataFrame({"a": node[a], "b": node[b]}).drop_duplicates()

    return compare


def _near_prints(kinds: DataFrame, shard: int, split: int) -> DataFrame:
    """Links (a, b) of nodes whose fingerprints are equal or within the radius, found by the tree."""
    prints = materialize(kinds.groupBy("fp").agg(F.min("node").alias("holder")), "prints")
    equal = kinds.join(prints, "fp").filter("node != holder").select(F.col("holder").alias("a"), F.col("node").alias("b"))
    holder = lambda side: prints.select(F.col("fp").alias(side), F.col("holder").alias(f"of_{side}"))
    near = linked_fingerprints(prints.select("fp"), RADIUS, shard, split)
    near = near.join(holder("a"), "a").join(holder("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    return equal.unionByName(near)


def _in_blocks(members: DataFrame, held: int) -> DataFrame:
    """The rows (root, node, n and more) with their tasks (root, i, j).

    A root with more elements than a block may hold is cut into blocks by node, and every pair of different blocks
    is a task.
    """
    size = F.sum(F.col("n") + 16)  # a document's other columns take memory too
    large = members.groupBy("root").agg(F.ceil(size / F.lit(held)).cast("int").alias("blocks")).filter("blocks > 1")
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    placed = members.join(large, "root", "left").select(
        *members.columns, "blocks", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    placed = placed.filter("blocks IS NULL OR own != other")
    return placed.select(*members.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _compare_groups(similarity: float):
    """Function for mapInArrow that finds the links (a, b) in rows (root, i, j, node, sketch, text) in order of the first four."""

    def links(nodes: list[int], sketches: list[bytes], found: list[np.ndarray]) -> pa.RecordBatch:
        pairs = _Exact(sketches, similarity, found).spanning(np.arange(len(nodes)))
        a, b = (np.concatenate([np.empty(0, np.int64), *side]) for side in (zip(*pairs, strict=True) if pairs else ((), ())))
        named = np.array(nodes, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(named[a]), pa.array(named[b])], names=["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, sketches, found = None, [], [], []
        for batch in batches:
            for *task, node, own, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if task != group:
                    if len(nodes) > 1:
                        yield links(nodes, sketches, found)
                    group, nodes, sketches, found = task, [], [], []
                if not nodes or nodes[-1] != node:  # rows that repeat exactly come as often as they are there
                    nodes.append(node)
                    sketches.append(own)
                    found.append(elements(text))
        if len(nodes) > 1:
            yield links(nodes, sketches, found)

    return compare


def similar_groups(
    hashed: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, shard: int = SHARD, split: int = SPLIT, held: int = HELD,
) -> DataFrame:
    """node, root of every row of a written table of banded documents with a number (node): groups of similar ones.

    ``texts`` has the text for each (__id, __text) of the table. Documents with the same words in the same order
    are one from the start. Others meet where their fingerprints are within the radius, or where they share the key
    of a band and their sketches are alike enough: of pairs with similarity s, (1 - s ** BAND) ** BANDS share no key.
    What meets is linked for a while. Linked documents come together with their texts, in pairs of blocks where they
    are many, and two of them are similar by the weighted similarity of their shingles itself, known by 64-bit
    hashes. A task holds two blocks in memory, and never less than one text.
    """
    first = materialize(hashed.groupBy("same").agg(F.min("node").alias("first")), "firsts")
    kinds = materialize(hashed.join(first.select(F.col("first").alias("node")), "node", "left_semi").drop("same"), "kinds")
    banded_links = _met(kinds, shard, split).groupBy("shard", "i", "j").applyInPandas(_compare_met(similarity), "a long, b long")
    loose = materialize(_near_prints(kinds, shard, split).unionByName(banded_links), "loose")
    members = materialize(kinds.join(components(loose), "node").select("__id", "__text", "root", "node", "sketch", "n"), "members")
    bounded_batches(hashed.sparkSession)
    task = ["root", "i", "j"]
    placed = texts.select("__id", "__text", "text").join(_in_blocks(members, held), ["__id", "__text"])
    placed = placed.select(*task, "node", "sketch", "text").repartition(*task).sortWithinPartitions(*task, "node")
    links = materialize(placed.mapInArrow(handed_back(_compare_groups(similarity)), "a long, b long"), "similar")
    roots = components(links).withColumnRenamed("node", "first")
    return hashed.select("node", "same").join(first, "same").join(roots, "first", "left").select(
        "node", F.coalesce("root", "first").alias("root"))


def one_of_each(docs: DataFrame, id_col="doc_id", text_col="text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs without near-duplicates: of each group of similar ones, the one with the least id stays.

    A row is known by the hashes of its id and its text. Of rows that repeat exactly one stays; a row
    without an id stays only if its whole group has none. A null text counts as empty, and texts without
    words are copies of each other. Own columns may have any names.
    """
    own = docs.columns
    docs = docs.toDF(*[f"c{i}" for i in range(len(own))])
    id_col, text_col = (f"c{own.index(c)}" for c in (id_col, text_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({"__id": F.xxhash64(id_col), "__text": F.xxhash64(text)})
    rows = keyed.select(
        F.monotonically_increasing_id().alias("node"), F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"),
        "__id", "__text", text.alias("text"))
    hashed = materialize(banded(rows, rows.columns[:-1]), "banded")
    groups = similar_groups(hashed, keyed.select("__id", "__text", text.alias("text")), similarity)
    named = hashed.select("node", F.struct("none", "id", "__id", "__text").alias("name"))
    best = groups.join(named, "node").groupBy("root").agg(F.min("name").alias("name"))
    kept = keyed.join(best.select("name.__id", "name.__text"), ["__id", "__text"], "left_semi")
    return kept.dropDuplicates(["__id", "__text"]).drop("__id", "__text").toDF(*own)
