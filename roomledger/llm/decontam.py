"""Benchmark decontamination: item-sized windows of documents that resemble a benchmark item.

Every item has a SimHash of its weighted shingles. Windows of an item's size get theirs from running bit
counts. The fingerprint is cut into radius + 1 blocks, and two fingerprints within the radius agree in at
least one of them, so lookups by block find every item within the radius. Candidates are then verified by
the exact weighted similarity of shingles.

Before that, windows are passed over that hold too few shingles of items of their size to reach the
similarity at all; this is an exact bound, not a sample.

An item of fewer words than a shingle has no window that tells anything: such words are in any text. It is
found only where a document is the item, word for word.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh64_intdigest

from roomledger.llm.arrow import bounded_batches, handed_back

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20  # bits; two windows of similarity 0.8 differ in 10 of 64 on average, 20 is over three deviations more
ITEM_BLOCK = 50_000  # items, and
TEXT_BLOCK = 16 << 20  # characters of items, that one pass over the documents looks for
_STEP = 4096  # windows fingerprinted at once

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-case words of letters and digits; punctuation doesn't count."""
    return _WORD.findall((text or "").lower())


def gram_hashes(words: list[str], size: int) -> np.ndarray:
    """64-bit hash of each run of so many words."""
    count = len(words) - size + 1
    if count < 1:
        return np.empty(0, np.uint64)
    joined = " ".join(words).encode()
    ends = np.cumsum(np.fromiter((len(w.encode()) for w in words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: count - 1] + 1).tolist()]
    pieces = [joined[a:b] for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]
    return np.fromiter(map(xxh64_intdigest, pieces, repeat(0)), np.uint64, count)


def similarity(a: Counter, b: Counter) -> float:
    """Weighted similarity: the smaller weights' sum over the larger weights' sum."""
    common = sum(min(n, b[k]) for k, n in a.items() if k in b)
    total = a.total() + b.total() - common
    return common / total if total else 0.0


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _fingerprints(ones: np.ndarray, count: int) -> np.ndarray:
    return np.packbits(2 * ones > count, axis=1, bitorder="little").view(np.uint64).reshape(-1)


class Index:
    """Items by size, with their shingles and the blocks of their fingerprints."""

    def __init__(self, items: list[tuple], radius: int = RADIUS, least: float = SIMILARITY):
        self.radius, self.least = radius, least
        self.items: list[tuple] = []  # id, shingle weights, fingerprint
        self.sizes: dict[int, list[int]] = defaultdict(list)
        edges = np.linspace(0, 64, radius + 2).astype(int).tolist()
        self.blocks = [(np.uint64(a), np.uint64((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)]
        self.by_block: dict[tuple[int, int, int], list[int]] = defaultdict(list)
        self.whole: dict[tuple[str, ...], list[int]] = defaultdict(list)  # items shorter than a shingle
        self.known: dict[int, dict[int, list[int]]] = defaultdict(dict)  # shingle length: hash: sizes of its items
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            if len(words) < SHINGLE:
                self.whole[tuple(words)].append(len(self.items))
                self.items.append((item_id, Counter(), 0))
                continue
            length = SHINGLE
            hashes = gram_hashes(words, length)
            print_ = int(_fingerprints(_bits(hashes).sum(axis=0, dtype=np.int64)[None, :], len(hashes))[0])
            at = len(self.items)
            self.items.append((item_id, Counter(hashes.tolist()), print_))
            self.sizes[len(words)].append(at)
            for block, key in enumerate(self._keys(np.array([print_], np.uint64))[0]):
                self.by_block[len(words), block, key].append(at)
            for h in set(hashes.tolist()):
                sizes = self.known[length].setdefault(h, [])
                if len(words) not in sizes:
                    sizes.append(len(words))
        self.hashes = {length: frozenset(known) for length, known in self.known.items()}

    def _keys(self, prints: np.ndarray) -> list[list[int]]:
        return np.stack([(prints >> shift) & mask for shift, mask in self.blocks], axis=1).tolist()

    def _candidates(self, size: int, fingerprint: int, keys: list[int]) -> set[int]:
        near = set()
        for block, key in enumerate(keys):
            near.update(self.by_block.get((size, block, key), ()))
        return {at for at in near if (self.items[at][2] ^ fingerprint).bit_count() <= self.radius}

    def matches(self, text: str | None) -> list[tuple]:
        """(item id, similarity, first word, words) of the best window for each item that has one."""
        words = words_of(text)
        best: dict[int, tuple[float, int, int]] = {}
        if len(words) < SHINGLE:
            best = {at: (1.0, 0, len(words)) for at in self.whole.get(tuple(words), ())}
        for length, known in self.known.items():
            hashes = gram_hashes(words, length)
            listed = hashes.tolist()
            if self.hashes[length].isdisjoint(listed):
                continue
            hits: dict[int, list[int]] = defaultdict(list)
            for at, h in enumerate(listed):
                for size in known.get(h, ()):
                    hits[size].append(at)
            for size, places in hits.items():
                self._windows(size, length, len(words), hashes, places, best)
        return [(self.items[i][0], s, start, size) for i, (s, start, size) in sorted(best.items())]

    def _windows(self, size, length, total, hashes, places, best) -> None:
        """Windows of one size that hold enough shingles of its items."""
        own = min(size, total)  # a shorter text is one window
        count, wanted = own - length + 1, size - length + 1
        enough = int(np.ceil((count + wanted) * self.least / (1 + self.least) - 1e-9))
        if len(places) < enough:
            return
        mark = np.zeros(len(hashes) + 1, np.int64)
        mark[np.array(places) + 1] = 1
        running = np.cumsum(mark)
        starts = np.flatnonzero(running[count:] - running[: len(hashes) - count + 1] >= enough)
        for at in range(0, len(starts), _STEP):
            some = starts[at : at + _STEP]
            low, high = int(some[0]), int(some[-1]) + count
            if high - low > 4 * _STEP:  # far apart: count each window on its own
                ones = np.stack([_bits(hashes[s : s + count]).sum(axis=0, dtype=np.int64) for s in some.tolist()])
            else:
                bits = np.zeros((high - low + 1, 64), np.int32)
                np.cumsum(_bits(hashes[low:high]), axis=0, out=bits[1:], dtype=np.int32)
                ones = bits[some - low + count] - bits[some - low]
            prints = _fingerprints(ones, count)
            for start, fingerprint, keys in zip(some.tolist(), prints.tolist(), self._keys(prints), strict=True):
                near = self._candidates(size, fingerprint, keys)
                if not near:
                    continue
                window = Counter(hashes[start : start + count].tolist())
                for item in near:
                    s = similarity(window, self.items[item][1])
                    if s >= self.least and s > best.get(item, (0.0,))[0]:
                        best[item] = (s, start, own)


_INDEXES: dict[str, Index] = {}


def _index(name: str, items) -> Index:
    """The index of a broadcast block of items; built once per worker."""
    if name not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[name] = Index(items.value)
    return _INDEXES[name]


def item_blocks(benchmark: DataFrame, id_col="item_id", text_col="text") -> Iterator[list[tuple]]:
    """The items in blocks of bounded size; they are the query set, and come to the driver a block at a time."""
    block, size = [], 0
    for row in benchmark.select(id_col, text_col).filter(F.col(text_col).isNotNull()).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1])
        if len(block) >= ITEM_BLOCK or size >= TEXT_BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words: the best window per row of docs and item it resembles.

    Clean documents have no row. Null and empty texts are clean; a null item is none; an item of fewer than
    five words is found only in documents that are the item. Repeated rows and repeated items come out
    repeated; ids keep their type and may be null. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = chosen.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    item_kind = to_arrow_type(benchmark.schema["item_id"].dataType)
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, start_word long, n_words long"
    out = spark.createDataFrame([], schema)
    for number, block in enumerate(item_blocks(benchmark)):
        name, items = uuid4().hex, spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], name=name, items=items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(at, *m) for at, text in enumerate(batch.column(1).to_pylist()) for m in _index(name, items).matches(text)]
                if found:
                    at, ids, scores, starts, sizes = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(at)), pa.array(ids, item_kind), pa.array(scores, pa.float64()),
                        pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()),
                    ], names=["doc_id", "item_id", "similarity", "start_word", "n_words"])

        hits = chosen.mapInArrow(handed_back(search), schema)
        out = hits if number == 0 else out.union(hits)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text resembles no benchmark item, with all their columns."""
    spark = docs.sparkSession
    bounded_batches(spark)
    at, schema = docs.columns.index(text_col), docs.schema
    for block in item_blocks(benchmark):
        name, items = uuid4().hex, spark.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], name=name, items=items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [not _index(name, items).matches(text) for text in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(handed_back(clean), schema)
    return docs
