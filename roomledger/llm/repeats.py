"""Repeated byte strings across documents, by suffix order and longest previous factors.

Strings of ``least`` bytes are dealt out by the smallest hash of the short grams inside them, which equal
strings share. Consecutive starts with the same smallest hash make one run, so a run is a piece of text
with some 80 starts, and only its hashes are counted. Runs that occur twice are settled as a whole. Runs
that share the smallest hash and differ are sorted as suffixes: in suffix order, ties by position, the
previous smaller position of a suffix gives its longest previous factor, the next larger one its match
further on. Groups with too many different runs for one task are dealt out anew by longer grams.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.llm.arrow import bounded_batches, in_batches
from roomledger.sources.tables import materialize

LEAST = 200  # bytes
GRAM = 40  # bytes of the grams whose hashes deal strings out
RUN = 1024  # most starts in a run, so that periodic texts make short runs
STEP = 1 << 20  # bytes hashed at once; a multiple of RUN
GROUP = 16_384  # different runs with one smallest hash, some 5 MB of text, that are sorted as suffixes in one task
SUFFIXES = 1 << 20  # bytes whose suffixes are sorted at once

_MASK = (1 << 64) - 1


def _byte_hashes() -> np.ndarray:
    """A fixed random number for each byte value."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


_BYTES = _byte_hashes()
_BASE = 0x9E3779B97F4A7C15 | 1


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the gram at each position, made from hashes of its powers of two."""
    h, size, parts = _BYTES[data], 1, []
    rest = gram
    while rest:
        if rest & 1:
            parts.append((size, h))
        rest >>= 1
        if rest:
            h = h[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + h[size:]
            size *= 2
    out, done = None, 0
    count = len(data) - gram + 1
    for size, h in reversed(parts):
        piece = h[done : done + count]
        out = piece if out is None else out * np.uint64(pow(_BASE, size, 1 << 64)) + piece
        done += size
    out = out ^ (out >> np.uint64(31))
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """Minimum or maximum of each window."""
    size = 1
    out = values
    while 2 * size <= width:
        out = best(out[:-size], out[size:])
        size *= 2
    return best(out[: len(values) - width + 1], out[width - size : width - size + len(values) - width + 1])


def runs(data: np.ndarray, ends: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of starts in documents that lie side by side: first start, starts, smallest hash, may hold a repeat itself.

    ``ends`` has each document's end; a start counts if its string ends within the document.
    """
    width = least - gram + 1
    if len(data) < least:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, bool))
    h = gram_hashes(data, gram)
    low = _sliding(h, width, np.minimum)
    owner = np.searchsorted(ends, np.arange(len(low)), side="right")
    valid = np.arange(len(low)) + least <= ends[owner]
    change = np.ones(len(low), bool)
    change[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(change)
    size = np.diff(np.append(first, len(low)))
    first, size = first[valid[first]], size[valid[first]]
    # grams that are the smallest of some string; two neighbours with one hash may lie in one run
    high = np.zeros(len(h) + width - 1, np.uint64)
    high[width - 1 : width - 1 + len(low)] = np.where(valid, low, 0)
    anchors = np.flatnonzero(_sliding(high, width, np.maximum) == h)
    twice = (h[anchors[1:]] == h[anchors[:-1]]) & (np.diff(anchors) <= width)
    own = np.isin(low[first], np.unique(h[anchors[1:][twice]]))
    pieces = -(-size // RUN)
    rank = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first, size, own = np.repeat(first, pieces) + rank * RUN, np.repeat(size, pieces) - rank * RUN, np.repeat(own, pieces)
    own |= np.repeat(pieces, pieces) > 1
    return first, np.minimum(size, RUN), low[first], own


def _blocks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Consecutive documents that fill about a STEP; a longer one is alone."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > STEP:
            yield start, i
            start, total = i, 0
        total += size
    yield start, len(sizes)


def _document_runs(raw: bytes, least: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of one long document, a STEP of starts at a time.

    The last run of a step may go on, so the next step begins where it began.
    """
    at = 0
    while len(raw) - at >= least:
        data = np.frombuffer(raw, np.uint8, min(STEP + least - 1, len(raw) - at), at)
        first, size, low, own = runs(data, np.array([len(data)]), least, gram)
        final = at + len(data) == len(raw)
        keep = len(first)
        if not final:
            keep = int(np.searchsorted(first, first[low != low[-1]][-1], side="right")) if (low != low[-1]).any() else keep
        yield first[:keep] + at, size[:keep], low[:keep], own[:keep]
        if final:
            break
        at += int(first[keep - 1] + size[keep - 1])


def _runs_of(texts: list[bytes], least: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, start in its text, starts, smallest hash, hash of the run's text and the own-repeat mark."""
    for begin, end in _blocks([len(t) for t in texts]):
        found, rows = [], []
        if end - begin == 1 and len(texts[begin]) > STEP:
            raw, offset = texts[begin], np.zeros(1, np.int64)
            for part in _document_runs(raw, least, gram):
                found.append(part)
                rows.append(np.full(len(part[0]), begin))
        else:
            raw = b"".join(texts[begin:end])
            ends = np.cumsum([len(t) for t in texts[begin:end]])
            found.append(runs(np.frombuffer(raw, np.uint8), ends, least, gram))
            owner = np.searchsorted(ends, found[0][0], side="right")
            rows.append(owner + begin)
            offset = np.concatenate([[0], ends])[owner]
        if not found:
            continue
        first, size, low, own = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(first):
            stops = (first + least + (size - 1 if gram < least else 0)).tolist()  # runs of whole strings hold one string only
            whole = np.fromiter(
                (xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(first.tolist(), stops, strict=True)), np.uint64, len(first))
            yield np.concatenate(rows), first - offset, size, low, whole, own


def run_table(texts: DataFrame, least: int, gram: int, with_text: bool) -> DataFrame:
    """low, whole, doc_id, key, start, n, own and, if asked for, text: a row per run of the texts.

    ``texts`` has doc_id, key, start (where the text begins in its document) and text.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [t.encode() if isinstance(t, str) else t for t in batch.column(3).to_pylist()]
            begins = batch.column(2).to_numpy(zero_copy_only=False)
            for row, first, size, low, whole, own in _runs_of(raws, least, gram):
                take = pa.array(row)
                columns = [
                    pa.array(low.view(np.int64)), pa.array(whole.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take),
                    pa.array((first + begins[row]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(own),
                ]
                if with_text:
                    columns.append(pa.array([
                        raws[r][a : a + n + least - 1] for r, a, n in zip(row.tolist(), first.tolist(), size.tolist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["low", "whole", "doc_id", "key", "start", "n", "own", "text"][: 8 if with_text else 7]
    kind = texts.schema["doc_id"].dataType.simpleString()
    fields = f"low long, whole long, doc_id {kind}, key long, start int, n int, own boolean" + ", text binary" * with_text
    return texts.select("doc_id", "key", "start", "text").mapInArrow(find, fields)


def suffix_classes(data: np.ndarray, places: np.ndarray, least: int) -> np.ndarray:
    """A number for each place that orders the strings of ``least`` bytes there; equal strings share it.

    Prefix doubling: strings of twice the length are ordered by the pair of the ranks of their halves.
    """
    padded = np.concatenate([data, np.zeros(least, np.uint8)]).astype(np.int64)
    rank, size = np.zeros(len(data) + least - 7, np.int64), 8
    word = padded[: len(rank)].astype(np.uint64)
    for j in range(1, 8):
        word = (word << np.uint64(8)) | padded[j : j + len(rank)].astype(np.uint64)
    rank = np.unique(word, return_inverse=True)[1].astype(np.int64)
    while 2 * size <= least:
        rank = np.unique(rank[:-size] * len(rank) + rank[size:], return_inverse=True)[1].astype(np.int64)
        size *= 2
    return np.unique(rank[places] * len(rank) + rank[places + least - size], return_inverse=True)[1]


def factors(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each place, in text order, has an earlier match and a later one.

    In suffix order with ties by position, the previous smaller position of a place is its left
    neighbour if that is in its class, and the next larger one its right neighbour; any other has a
    common prefix that is too short.
    """
    order = np.argsort(classes, kind="stable")
    same = classes[order][1:] == classes[order][:-1]
    earlier, later = np.zeros(len(classes), bool), np.zeros(len(classes), bool)
    earlier[order[1:]] = same
    later[order[:-1]] = same
    return earlier, later


def _settle(rows: list[tuple], least: int, keep_first: bool) -> Iterator[tuple]:
    """(doc_id, key, start, end) to remove, from runs (low, doc_id, key, start, text) in text order."""
    sizes = np.array([len(r[4]) for r in rows])
    data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
    begin = np.cumsum(sizes) - sizes
    starts = sizes - least + 1
    owner = np.repeat(np.arange(len(rows)), starts)
    inner = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
    earlier, later = factors(suffix_classes(data, begin[owner] + inner, least))
    hit = earlier if keep_first else earlier | later
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])) | np.concatenate([[1], owner[1:] != owner[:-1], [1]]))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if hit[a]:
            r = rows[owner[a]]
            yield r[1], r[2], r[3] + int(inner[a]), r[3] + int(inner[b - 1]) + least


def _suffix_spans(texts: DataFrame, least: int, keep_first: bool) -> DataFrame:
    """Spans to remove among runs that share their smallest hash; no group is larger than GROUP runs."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            waiting.sort(key=lambda r: (r[1] is not None, r[1], r[2], r[3]))
            found = list(_settle(waiting, least, keep_first)) if waiting else []
            ids, keys, starts, ends = zip(*found, strict=True) if found else ([], [], [], [])
            return pa.RecordBatch.from_arrays([
                pa.array(ids, kind), pa.array(keys, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()),
            ], names=["doc_id", "key", "start", "end"])

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > SUFFIXES and row[0] != last:
                    yield flush()
                    waiting, size = [], 0
                waiting.append(row)
                size += len(row[4])
                last = row[0]
        if waiting:
            yield flush()

    kind = texts.schema["doc_id"].dataType.simpleString()
    dealt = texts.select("low", "doc_id", "key", "start", "text").repartition("low").sortWithinPartitions("low")
    return dealt.mapInArrow(settle, f"doc_id {kind}, key long, start int, end int")


_PLACE = ("doc_id", "key", "start")


def _sorted_out(found: DataFrame, least: int, keep_first: bool, name: str) -> tuple[DataFrame, DataFrame]:
    """Spans of runs that are repeated as a whole, and what is left: one of each run in groups of different ones.

    Groups are runs with one smallest hash. The rows left have ``large``, whether theirs has more than
    GROUP different runs. Everything is counted on the map side first, so a run or a hash that a third
    of the documents share is one row per task; rows are then matched by joins that Spark can split.
    """
    with_text = "text" in found.columns
    groups = found.groupBy("low").agg(
        F.count("*").alias("rows"), F.min("whole").alias("w1"), F.max("whole").alias("w2"), F.max("own").alias("own"))
    mixed = (F.col("w1") != F.col("w2")) | F.col("own")
    groups = groups.filter((F.col("rows") > 1) | F.col("own")).select("low", mixed.alias("mixed"))
    hits = materialize(found.drop("own").join(groups, "low"), name)
    _release(found.sparkSession)

    first = F.min(F.struct(*_PLACE, "n")).alias("first")
    text = [F.min("text").alias("text")] if with_text else []
    shared = hits.filter("mixed")
    kinds = materialize(
        shared.groupBy("low", "whole").agg(F.count("*").alias("copies"), first, *text)
        .select("low", "whole", "copies", "first.*", *(["text"] if with_text else [])), f"{name}-kinds")
    plain = hits.filter("NOT mixed")
    if keep_first:
        firsts = plain.groupBy("low", "whole").agg(first).select("low", "whole", "first.doc_id", "first.key", "first.start")
        firsts = firsts.union(kinds.select("low", "whole", *_PLACE))
        firsts = firsts.select("low", "whole", F.struct(*_PLACE).alias("first"))
        full = hits.join(firsts, ["low", "whole"]).filter(~F.struct(*_PLACE).eqNullSafe(F.col("first")))
    else:
        twice = kinds.filter("copies > 1").select("low", "whole")
        full = plain.select(*_PLACE, "n").union(shared.join(twice, ["low", "whole"]).select(*_PLACE, "n"))
    large = kinds.groupBy("low").agg(F.count("*").alias("different")).filter(F.col("different") > GROUP)
    left = kinds.drop("copies").join(large.select("low", F.lit(True).alias("large")), "low", "left")
    return _spans(full, least), left.withColumn("large", F.coalesce("large", F.lit(False)))


def _spans(rows: DataFrame, least: int) -> DataFrame:
    return rows.select(*_PLACE, (F.col("start") + F.col("n") + F.lit(least - 1)).cast("int").alias("end"))


def _with_texts(left: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """The runs with their texts, fetched from the documents."""
    by_doc = left.groupBy("doc_id", "key").agg(F.collect_list(F.struct("low", "start", "n", "large")).alias("runs"))
    named = docs.select(F.col("doc_id").alias("own_id"), F.col("key").alias("own_key"), F.col("text").alias("own_text"))
    joined = named.join(
        by_doc.hint("shuffle_hash"), F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("key")))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc_id, key, listed, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = text.encode()
            out += [(r["low"], doc_id, key, r["start"], raw[r["start"] : r["start"] + r["n"] + least - 1], r["large"]) for r in listed]
        low, ids, keys, starts, texts, large = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([
            pa.array(low, pa.int64()), pa.array(ids, batch.schema.field("doc_id").type), pa.array(keys, pa.int64()),
            pa.array(starts, pa.int32()), pa.array(texts, pa.binary()), pa.array(large, pa.bool_()),
        ], names=["low", "doc_id", "key", "start", "text", "large"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "key", "runs", "own_text").mapInArrow(
        in_batches(cut), f"low long, doc_id {kind}, key long, start int, text binary, large boolean")


def repeated_spans(docs: DataFrame, least: int = LEAST, keep_first: bool = False) -> DataFrame:
    """doc_id, key, start, end: byte ranges of documents (doc_id, key, text) that strings occurring elsewhere cover.

    With keep_first, the first copy in the order of (doc_id, key, start) stays and later ones are listed.

    Groups too large for one task are dealt out anew by longer grams, which make shorter runs: what is
    inside a common passage becomes equal runs, what is outside becomes runs of its own, and only the
    runs on a passage's edge stay different. The last grams are the strings themselves.
    """
    spark = docs.sparkSession
    found = run_table(docs.withColumn("start", F.lit(0)), least, min(GRAM, least), False)
    spans, left = _sorted_out(found, least, keep_first, "runs")
    texts = _with_texts(left, docs, least)
    if keep_first:  # a row that repeats must not be its own earlier copy
        texts = texts.dropDuplicates(["low", *_PLACE])
    left = materialize(texts, "run-texts")
    _release(spark)
    for gram in (least * 4 // 5, least * 24 // 25, least):
        spans = spans.union(_suffix_spans(left.filter("NOT large"), least, keep_first))
        left = left.filter("large")
        if left.isEmpty():
            return spans
        found = run_table(left, least, gram, gram < least)
        if gram == least:
            return spans.union(_equal_strings(found, least, keep_first))
        more, left = _sorted_out(found, least, keep_first, "edge-runs")
        spans, left = spans.union(more), materialize(left, "edge-texts")
    return spans


def _equal_strings(found: DataFrame, least: int, keep_first: bool) -> DataFrame:
    """Spans of runs of which each is one string, again and again, known by its two hashes."""
    place = F.struct(*_PLACE)
    one = found.groupBy("low", "whole").agg(F.sum("n").alias("strings"), F.min(place).alias("first")).filter("strings > 1")
    rows = found.select("low", "whole", *_PLACE, "n").join(one, ["low", "whole"])
    if keep_first:
        rows = rows.withColumn("skip", place.eqNullSafe(F.col("first")).cast("int"))
        rows = rows.withColumns({"start": F.col("start") + F.col("skip"), "n": F.col("n") - F.col("skip")}).filter("n > 0")
    return _spans(rows, least)


def _release(spark) -> None:
    """Let Spark's cleaner remove the shuffle files of what has been written."""
    gc.collect()
    spark._jvm.System.gc()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal ranges covered by ranges."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def keyed(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, key and text; a document is known by its id and a hash of its text, as ids may repeat or be null."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def without_repeats(
    docs: DataFrame, id_col="doc_id", text_col="text", least: int = LEAST, keep_first: bool = False, with_kept: bool = False
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) of every row.

    A null text counts as empty. Rows that repeat are copies of each other and come out repeated, a
    null id stays null, other columns are ignored. With keep_first, rows that repeat exactly count as
    one document, since nothing tells which is first.
    """
    bounded_batches(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    spans = repeated_spans(rows, least, keep_first)
    by_doc = spans.groupBy(F.col("doc_id").alias("span_id"), F.col("key").alias("span_key")).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    joined = rows.join(
        by_doc.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("span_id")) & (F.col("key") == F.col("span_key")), "left")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, removed, ranges, digests, kept = [], [], [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            raw = text.encode()
            out = merged([(s["start"], s["end"]) for s in spans or ()])
            edges = [0, *(x for r in out for x in r), len(raw)]
            rest = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            sizes.append(len(raw))
            removed.append(len(raw) - len(rest))
            ranges.append(len(out))
            digests.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        columns = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, removed, ranges)), pa.array(digests, pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_kept:
            columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "kept"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "text", "spans").mapInArrow(
        in_batches(cut),
        f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept)
