"""Histogram gradient boosting of a binary outcome, trained on Spark (M3).

Rows are binned once, features with few bins as one joint cell, and written. Training is a few jobs: in a barrier
stage every worker keeps its rows' cells, gradients and places in the tree, large arrays in mapped files, and goes
through them in chunks. For each level the workers exchange, in the shared folder, what their rows add to the
histograms of gradients and hessians. All of them then find the
same splits. (The barrier's own all-gather answers once a second, which is too slow for 2,400 levels.) Of two
siblings only the smaller one's histogram is summed up, the other is what remains of their parent's.
Every so many rounds a job ends and its trees are saved, so that a lost executor costs no more than those.
The result is Spark's own ensemble model, which scores in the JVM, batch or stream.
"""

from __future__ import annotations

import json
import math
import tempfile
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import BarrierTaskContext
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomledger.session import work_dir
from roomledger.sources.tables import exists, remove, scratch

SAVE_EVERY = 100  # rounds per job
WORKER_ROWS = 50_000  # rows for which another worker pays
PATIENCE = 600  # seconds that a worker waits for the others' sums
MOST_WORKERS = 32  # each sends its histograms to all others, so traffic grows with their square
JOINT_CELLS = 2_048  # of features that are counted together
PACKED_ROWS = 128  # rows whose cells travel as one value
CHUNK_ROWS = 262_144  # rows that a worker has temporary arrays of
MAPPED_BYTES = 32 << 20  # a worker's larger arrays are in a mapped file, which the system may write out
ACCURACY = 10_000  # of the quantiles that numbers are cut at


@dataclass(frozen=True)
class Growth:
    """Settings of one fit."""

    iterations: int
    learning_rate: float
    depth: int
    leaves: int
    min_leaf: int
    bins: int


@dataclass(frozen=True)
class Binning:
    """Categories (as indexes, the number of them) come first, then numbers (cut at their thresholds)."""

    categories: tuple[int, ...]
    cuts: tuple[tuple[float, ...], ...]

    @property
    def sizes(self) -> list[int]:
        return [*self.categories, *(len(c) + 1 for c in self.cuts)]

    @property
    def kind(self) -> np.dtype:
        return np.min_scalar_type(max(self.sizes, default=1) - 1)

    def bins(self, columns: list[np.ndarray]) -> np.ndarray:
        """A row of bins for each row of the columns."""
        out = np.empty((len(columns[0]) if columns else 0, len(columns)), self.kind)
        for i, values in enumerate(columns):
            k = i - len(self.categories)
            out[:, i] = values if k < 0 else np.searchsorted(np.array(self.cuts[k]), values, side="left")
        return out


def binning(rows: DataFrame, indexed: list[str], categories: list[int], numeric: list[str], bins: int) -> Binning:
    """Cuts at quantiles of every number, found in one pass that keeps a bounded summary per column."""
    if not numeric:
        return Binning(tuple(categories), ())
    shares = [k / bins for k in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(c, shares, ACCURACY).alias(c) for c in numeric]).first()
    cuts = tuple(tuple(sorted({v for v in found[c] or () if not math.isnan(v)})) for c in numeric)
    return Binning(tuple(categories), cuts)


_PACKED = "row_count long, positive double, y binary, cells binary"


def _packed(rows: DataFrame, inputs: list[str], label: str, how: Binning) -> DataFrame:
    """So many rows at a time: their number, the sum of y, and as bytes y and each row's cells in the joint groups."""
    sizes = how.sizes
    groups = joint_groups(sizes)
    kind = cell_kind(sizes, groups)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            bins = how.bins([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(inputs))]).T
            cells = np.empty((len(y), len(groups)), kind)
            for g, group in enumerate(groups):
                cells[:, g] = joint_bins(bins, sizes, group)
            begins = range(0, len(y), PACKED_ROWS)
            yield pa.RecordBatch.from_arrays([
                pa.array([len(y[i : i + PACKED_ROWS]) for i in begins], pa.int64()),
                pa.array([float(y[i : i + PACKED_ROWS].sum()) for i in begins], pa.float64()),
                pa.array([y[i : i + PACKED_ROWS].tobytes() for i in begins], pa.binary()),
                pa.array([cells[i : i + PACKED_ROWS].tobytes() for i in begins], pa.binary()),
            ], names=[f.split(" ")[0] for f in _PACKED.split(", ")])

    return rows.select(F.col(label).cast("double").alias("y"), *inputs).mapInArrow(pack, _PACKED)


def joint_groups(sizes: list[int]) -> list[list[int]]:
    """Features in groups whose bins together number few cells, so that one count serves a whole group."""
    groups: list[list[int]] = []
    for f in sorted(range(len(sizes)), key=lambda f: -sizes[f]):
        room = [g for g in groups if math.prod(sizes[i] for i in g) * sizes[f] <= JOINT_CELLS]
        if room:
            room[0].append(f)
        else:
            groups.append([f])
    return groups


def cell_kind(sizes: list[int], groups: list[list[int]]) -> np.dtype:
    """Type that holds a cell of any of the groups."""
    return np.min_scalar_type(max((math.prod(sizes[f] for f in g) for g in groups), default=1) - 1)


def joint_bins(bins: np.ndarray, sizes: list[int], group: list[int]) -> np.ndarray:
    """The cell of each row among the joint bins of a group; ``bins`` has a row per feature."""
    cells = math.prod(sizes[f] for f in group)
    out = np.zeros(bins.shape[1], np.min_scalar_type(max(cells - 1, 0)))
    for f in group:
        out *= out.dtype.type(sizes[f] if sizes[f] <= np.iinfo(out.dtype).max else 0)
        out += bins[f].astype(out.dtype)
    return out


class Exchange:
    """Sums of arrays over the workers of one attempt, through files in the shared folder.

    A file is renamed into place, so no worker reads half of one. A worker that has seen all files of a
    step knows that all others have read those of the step before, and removes its own.
    """

    def __init__(self, folder: str, rank: int, workers: int):
        self.store, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        self.path, self.rank, self.workers, self.step = path, rank, workers, 0
        if workers > 1:
            self.store.create_dir(path, recursive=True)

    def _name(self, step: int, rank: int) -> str:
        return f"{self.path}/{step}-{rank}"

    def _read(self, rank: int) -> bytes:
        waited, pause = 0.0, 0.0005
        while True:
            try:
                with self.store.open_input_stream(self._name(self.step, rank)) as file:
                    return file.read()
            except FileNotFoundError:
                if waited > PATIENCE:
                    raise
            time.sleep(pause)
            waited += pause
            pause = min(max(pause, waited / 8), 0.05)  # waits little longer than the others take

    def __call__(self, own: np.ndarray) -> np.ndarray:
        if self.workers == 1:
            return own
        name = self._name(self.step, self.rank)
        with self.store.open_output_stream(f"{name}.part") as file:
            file.write(own.tobytes())
        self.store.move(f"{name}.part", name)
        out = np.zeros(own.shape)
        for rank in range(self.workers):
            out += own if rank == self.rank else np.frombuffer(self._read(rank)).reshape(own.shape)
        if self.step:
            self.store.delete_file(self._name(self.step - 1, self.rank))
        self.step += 1
        return out


class Tree:
    """A tree over bins: per node feature, the bins that go left, children and value; -1 for a leaf's feature."""

    def __init__(self, width: int):
        self.width = width
        self.feature, self.left, self.right, self.value, self.rows, self.gain = [], [], [], [], [], []
        self.goes_left: list[np.ndarray] = []

    def add(self, value: float, rows: int) -> int:
        self.feature.append(-1)
        self.left.append(-1)
        self.right.append(-1)
        self.value.append(value)
        self.rows.append(rows)
        self.gain.append(-1.0)
        self.goes_left.append(np.zeros(self.width, bool))
        return len(self.feature) - 1

    def places(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The leaf of each row; ``bins`` has a row per feature."""
        at = np.zeros(bins.shape[1], np.int32)
        feature, left, right = (np.array(x, np.int32) for x in (self.feature, self.left, self.right))
        goes_left, all_rows = np.array(self.goes_left), np.arange(bins.shape[1])
        for _ in range(depth):
            on = feature[at]
            bin_of = bins[np.maximum(on, 0), all_rows]
            at = np.where(on < 0, at, np.where(goes_left[at, bin_of], left[at], right[at]))
        return at


class LeafSets:
    """Which leaves of a tree a feature's bin leaves possible, a bit each; all features together leave one.

    The leaf of a row is found without a walk: by one look-up per feature that the tree splits by.
    """

    MOST = 62

    def __init__(self, feature: list[int], goes_left: list[np.ndarray], left: list[int], right: list[int], value: list[float], sizes: list[int]):
        leaves = [n for n, f in enumerate(feature) if f < 0]
        self.values = np.array([value[n] for n in leaves])
        below = {n: 1 << i for i, n in enumerate(leaves)}
        for n in reversed(range(len(feature))):  # children come after their parent
            if feature[n] >= 0:
                below[n] = below[left[n]] | below[right[n]]
        self.of: dict[int, np.ndarray] = {}
        every = (1 << len(leaves)) - 1
        for n, f in enumerate(feature):
            if f >= 0:
                own = self.of.setdefault(f, np.full(sizes[f], every, np.int64))
                own &= np.where(goes_left[n][: sizes[f]], every ^ below[right[n]], every ^ below[left[n]])

    def value(self, possible: np.ndarray) -> np.ndarray:
        """Values of the leaves of rows for which one leaf is left: the exponent of its bit is its place."""
        return self.values.take((possible.astype(np.float64).view(np.int64) >> 52) - 1023)


class _Best:
    """The best split of each of some nodes, from their histograms (3, nodes, bins)."""

    def __init__(self, how: Binning, offsets: np.ndarray, growth: Growth):
        self.how, self.offsets, self.growth = how, offsets, growth

    def find(self, hist: np.ndarray) -> list[tuple[float, int, np.ndarray, np.ndarray] | None]:
        """Gain, feature, bins that go left, and sums that go left (gradient, hessian, rows); None without a split."""
        nodes = hist.shape[1]
        best = np.zeros(nodes)
        chosen: list[tuple | None] = [None] * nodes
        for f, size in enumerate(self.how.sizes):
            part = hist[:, :, self.offsets[f] : self.offsets[f] + size]
            order = None
            if f < len(self.how.categories):  # categories in order of the value that each alone would get
                with np.errstate(divide="ignore", invalid="ignore"):
                    ratio = np.where(part[2] > 0, part[0] / np.maximum(part[1], 1e-12), np.inf)
                order = np.argsort(ratio, axis=1, kind="stable")
                part = np.take_along_axis(part, order[None], axis=2)
            total = part.sum(axis=2, keepdims=True)
            left = np.cumsum(part, axis=2)[:, :, :-1]
            right = total - left
            fits = (left[2] >= self.growth.min_leaf) & (right[2] >= self.growth.min_leaf) & (left[1] > 1e-3) & (right[1] > 1e-3)
            if not fits.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = left[0] ** 2 / left[1] + right[0] ** 2 / right[1] - total[0] ** 2 / total[1]
            gain = np.where(fits, gain, -np.inf)
            at = gain.argmax(axis=1)
            for n in np.flatnonzero(gain[np.arange(nodes), at] > best + 1e-9).tolist():
                best[n] = gain[n, at[n]]
                goes = np.zeros(max(self.how.sizes), bool)
                goes[order[n, : at[n] + 1] if order is not None else slice(0, at[n] + 1)] = True
                chosen[n] = (float(best[n]), f, goes, left[:, n, at[n]])
        return chosen


def _room(shape: int | tuple[int, ...], kind: np.dtype) -> np.ndarray:
    """An array of zeros; a large one is in a file without a name, so that it need not stay in memory."""
    size = math.prod(shape if isinstance(shape, tuple) else (shape,)) * np.dtype(kind).itemsize
    if size <= MAPPED_BYTES:
        return np.zeros(shape, kind)
    with tempfile.TemporaryFile() as file:
        file.truncate(size)
        return np.asarray(np.memmap(file, kind, "r+", shape=shape))


class _Worker:
    """The rows of one worker and the rounds it takes part in, a chunk of rows at a time.

    Rows are kept as their cells in the joint groups, two bytes a group; a feature's bin follows from its cell.
    """

    def __init__(self, y: np.ndarray, bins: np.ndarray | None, how: Binning, growth: Growth, exchange, joint: list[np.ndarray] | None = None):
        self.y, self.how, self.growth, self.exchange = y, how, growth, exchange
        self.sizes = how.sizes
        self.offsets = np.cumsum([0, *self.sizes])
        self.groups = joint_groups(self.sizes)
        self.joint = joint if joint is not None else [joint_bins(bins, self.sizes, group) for group in self.groups]
        self.group_of = {f: i for i, group in enumerate(self.groups) for f in group}
        self.best = _Best(how, self.offsets, growth)
        self.g, self.h = _room(len(y), np.float64), _room(len(y), np.float64)
        self.place = np.zeros(len(y), np.min_scalar_type(2 * growth.leaves))

    def chunks(self) -> Iterator[slice]:
        return (slice(i, min(i + CHUNK_ROWS, len(self.y))) for i in range(0, len(self.y), CHUNK_ROWS))

    def bins_of(self, f: int, cells: np.ndarray) -> np.ndarray:
        """The feature's bins of cells of its group."""
        group = self.groups[self.group_of[f]]
        after = math.prod(self.sizes[i] for i in group[group.index(f) + 1 :])
        return cells // after % self.sizes[f]

    def by_cell(self, f: int, table: np.ndarray) -> np.ndarray:
        """What a table by the feature's bins says, by the cells of its group."""
        cells = math.prod(self.sizes[i] for i in self.groups[self.group_of[f]])
        return table[self.bins_of(f, np.arange(cells))]

    def add(self, score: np.ndarray, trees: list[Tree]) -> None:
        """Adds the trees' values of the rows to the scores."""
        for tree in trees:
            if len(tree.feature) // 2 < LeafSets.MOST:
                sets = LeafSets(tree.feature, tree.goes_left, tree.left, tree.right, tree.value, self.sizes)
                tables: dict[int, np.ndarray] = {}
                for f, own in sets.of.items():
                    tables[self.group_of[f]] = tables.get(self.group_of[f], -1) & self.by_cell(f, own)
                for at in self.chunks():
                    possible = np.full(at.stop - at.start, (1 << len(sets.values)) - 1, np.int64)
                    for group, table in tables.items():
                        possible &= table.take(self.joint[group][at])
                    score[at] += sets.value(possible)
            else:
                for at in self.chunks():
                    bins = np.stack([self.bins_of(f, self.joint[self.group_of[f]][at]) for f in range(len(self.sizes))])
                    score[at] += np.array(tree.value)[tree.places(bins, self.growth.depth)]

    def _counted(self, out: np.ndarray, at: slice, rows: np.ndarray | slice, slot: np.ndarray | None, slots: int) -> None:
        """Adds the sums over some rows of a chunk."""
        g, h = self.g[at][rows], self.h[at][rows]
        for group, joint in zip(self.groups, self.joint, strict=True):
            shape = [self.sizes[f] for f in group]
            cells = math.prod(shape)
            key = joint[at][rows].astype(np.int64)
            if slot is not None:
                key += slot * cells
            for kind, weights in enumerate((g, h, None)):
                sums = np.bincount(key, weights, slots * cells).reshape(slots, *shape)
                for axis, f in enumerate(group, start=1):
                    others = tuple(a for a in range(1, len(shape) + 1) if a != axis)
                    out[kind, :, self.offsets[f] : self.offsets[f + 1]] += sums.sum(axis=others)

    def histogram(self, rows: np.ndarray, slot: np.ndarray, slots: int) -> np.ndarray:
        """Sums of gradient, hessian and rows by slot and bin, over all workers."""
        out = np.zeros((3, slots, self.offsets[-1]))
        self._counted(out, slice(None), rows, slot if slots > 1 else None, slots)
        return self.exchange(out)

    def _root(self, score: np.ndarray) -> np.ndarray:
        """Gradients and hessians for the scores, and their sums by bin."""
        out = np.zeros((3, 1, self.offsets[-1]))
        for at in self.chunks():
            p = 1.0 / (1.0 + np.exp(-score[at]))
            self.g[at], self.h[at] = p - self.y[at], p * (1 - p)
            self._counted(out, at, slice(None), None, 1)
        return self.exchange(out)

    def _divide(self, tree: Tree, nodes: list[int], small: list[int]) -> np.ndarray | None:
        """Rows of the nodes move to their children; sums by bin over those in the small ones, if there are any."""
        out = np.zeros((3, len(small), self.offsets[-1])) if small else None
        slot_of = {node: s for s, node in enumerate(small)}
        tables = {n: self.by_cell(tree.feature[n], tree.goes_left[n][: self.sizes[tree.feature[n]]]) for n in nodes}
        for at in self.chunks():
            place = self.place[at]
            order = np.argsort(place, kind="stable")
            ends = np.cumsum(np.bincount(place, minlength=len(tree.feature)))
            rows, slots = [], []
            for n in nodes:
                own = order[ends[n - 1] if n else 0 : ends[n]]
                goes = tables[n].take(self.joint[self.group_of[tree.feature[n]]][at].take(own))
                for child, there in ((tree.left[n], own[goes]), (tree.right[n], own[~goes])):
                    place[there] = child
                    if child in slot_of:
                        rows.append(there)
                        slots.append(slot_of[child])
            if small:
                self._counted(out, at, np.concatenate(rows), np.repeat(np.array(slots, np.int64), [len(r) for r in rows]), len(small))
        return self.exchange(out) if small else None

    def grow(self, score: np.ndarray) -> Tree:
        """One tree for the scores as they are; adds its values to them."""
        growth, tree = self.growth, Tree(max(self.sizes))
        self.place[:] = 0
        hist = self._root(score)
        first = slice(0, self.sizes[0])
        value = lambda sums: -growth.learning_rate * sums[0] / max(sums[1], 1e-12)
        root = hist[:, 0, first].sum(axis=1)
        front = [(tree.add(value(root), int(root[2])), hist[:, 0], root)]
        leaves = 1
        for level in range(growth.depth):
            found = self.best.find(np.stack([h for _, h, _ in front], axis=1)) if front else []
            order = sorted((i for i, b in enumerate(found) if b), key=lambda i: -found[i][0])[: growth.leaves - leaves]
            if not order:
                break
            pairs = []
            for i in order:
                (node, parent, sums), (gain, feature, goes, left) = front[i], found[i]
                right = sums - left
                tree.feature[node], tree.goes_left[node], tree.gain[node] = feature, goes, gain
                tree.left[node], tree.right[node] = tree.add(value(left), int(left[2])), tree.add(value(right), int(right[2]))
                pairs.append((tree.left[node], tree.right[node], parent, left, right))
            leaves += len(order)
            last = level + 1 == growth.depth or leaves == growth.leaves
            small = [] if last else [a if left[2] <= right[2] else b for a, b, _, left, right in pairs]
            sums = self._divide(tree, [front[i][0] for i in order], small)
            if last:
                break
            front = []
            for s, (a, b, parent, left, right) in enumerate(pairs):
                own, rest = sums[:, s], parent - sums[:, s]
                front += [(a, own, left), (b, rest, right)] if small[s] == a else [(a, rest, left), (b, own, right)]
            front = [n for n in front if n[2][2] >= 2 * growth.min_leaf]
        values = np.array(tree.value)
        for at in self.chunks():
            score[at] += values.take(self.place[at])
        return tree


_NODES = (
    "tree int, node int, feature int, goes_left binary, left_node int, right_node int, value double, row_count long, gain double"
)


def _held(batches: Iterator[pa.RecordBatch], kind: np.dtype, groups: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """y of the packed rows and, by joint group, their cells; not all of it needs to be in memory at any time."""
    with tempfile.TemporaryFile() as ys, tempfile.TemporaryFile() as cells:
        for batch in batches:
            for own, wide in zip(batch.column(2), batch.column(3), strict=True):
                ys.write(own.as_buffer())
                cells.write(wide.as_buffer())
        count = ys.tell() // np.dtype(np.float64).itemsize
        ys.seek(0)
        cells.seek(0)
        y, joint = _room(count, np.float64), [_room(count, kind) for _ in range(groups)]
        for i in range(0, count, CHUNK_ROWS):
            rows = min(CHUNK_ROWS, count - i)
            y[i : i + rows] = np.fromfile(ys, np.float64, rows)
            wide = np.fromfile(cells, kind, rows * groups).reshape(rows, groups)
            for g in range(groups):
                joint[g][i : i + rows] = wide[:, g]
    return y, joint


def _rounds(packed: DataFrame, workers: int, base: float, trees: list[Tree], rounds: int, how: Binning, growth: Growth) -> list:
    """Nodes of so many more trees. One barrier stage; the first worker returns what all of them found."""
    begin, groups = len(trees), joint_groups(how.sizes)
    kind = cell_kind(how.sizes, groups)
    shared = work_dir(packed.sparkSession, "boosting")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        y, joint = _held(batches, kind, len(groups))
        # an attempt has a folder of its own, so files of one that failed are not read
        attempt = context.allGather(uuid.uuid4().hex)[0] if workers > 1 else "alone"
        exchange = Exchange(f"{shared}/{attempt}", context.partitionId(), workers)
        worker = _Worker(y, None, how, growth, exchange, joint)
        score = _room(len(y), np.float64)
        score += base
        worker.add(score, trees)
        made = [worker.grow(score) for _ in range(rounds)]
        if context.partitionId() == 0:
            rows = [
                (begin + t, n, tree.feature[n], tree.goes_left[n].tobytes(), tree.left[n], tree.right[n], tree.value[n], tree.rows[n], tree.gain[n])
                for t, tree in enumerate(made) for n in range(len(tree.feature))
            ]
            kinds = [pa.int32()] * 3 + [pa.binary()] + [pa.int32()] * 2 + [pa.float64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                names=[f.split(" ")[0] for f in _NODES.split(", ")])

    try:
        return packed.repartition(workers).mapInArrow(train, _NODES, barrier=True).collect()
    finally:
        remove(packed.sparkSession, shared)


def _trees(rows: list, width: int) -> list[Tree]:
    trees: dict[int, Tree] = {}
    for r in sorted(rows, key=lambda r: (r["tree"], r["node"])):
        tree = trees.setdefault(r["tree"], Tree(width))
        at = tree.add(r["value"], r["row_count"])
        tree.feature[at], tree.left[at], tree.right[at], tree.gain[at] = r["feature"], r["left_node"], r["right_node"], r["gain"]
        tree.goes_left[at] = np.frombuffer(r["goes_left"], bool)
    return [trees[t] for t in sorted(trees)]


def workers_for(spark: SparkSession, rows: int) -> int:
    """Workers that train so many rows; a barrier stage needs a free core for each."""
    return max(1, min(spark.sparkContext.defaultParallelism, MOST_WORKERS, rows // WORKER_ROWS))


def boost(
    rows: DataFrame, indexed: list[str], categories: list[int], numeric: list[str], label: str, growth: Growth,
    saved: str | None = None, workers: int | None = None,
) -> tuple[float, list[Tree], Binning]:
    """Log-odds to start from, the trees, and the binning they are over.

    With ``saved``, the trees of every job are kept in that folder, and a fit that was cut short goes on
    from there; it must be of the same rows and settings. An outcome that never or always happens gives
    the constant and no trees.
    """
    if growth.iterations < 1 or growth.depth < 1 or not 2 <= growth.bins:
        raise ValueError(f"settings that grow nothing: {growth}")
    spark = rows.sparkSession
    how = binning(rows, indexed, categories, numeric, growth.bins)
    with scratch(spark, "binned") as path:
        _packed(rows, [*indexed, *numeric], label, how).write.parquet(path)
        packed = spark.read.schema(_PACKED).parquet(path)
        count, positive = packed.agg(F.sum("row_count"), F.sum("positive")).first()
        if not count:
            raise ValueError("no labelled rows to train on")
        share = min(max(positive / count, 1e-6), 1 - 1e-6)
        base = math.log(share / (1 - share))
        if positive in (0, count) or not how.sizes:
            return base, [], how
        workers = workers or workers_for(spark, count)
        found: list = []
        if saved and exists(spark, saved):
            found = spark.read.schema(_NODES).parquet(saved).collect()
        trees = _trees(found, max(how.sizes))
        while len(trees) < growth.iterations:
            made = _rounds(packed, workers, base, trees, min(SAVE_EVERY, growth.iterations - len(trees)), how, growth)
            if saved:
                spark.createDataFrame(made, _NODES).coalesce(1).write.mode("append").parquet(saved)
            trees += _trees(made, max(how.sizes))
    return base, trees, how


def _nodes(base: float, trees: list[Tree], how: Binning) -> Iterator[tuple]:
    """(tree, node) rows in the form that Spark saves ensembles in; the first tree is the log-odds."""
    leaf = (-1, [], -1)
    yield 0, (0, base, 0.0, [1.0, 0.0, 0.0], 1, -1.0, -1, -1, leaf)
    for t, tree in enumerate(trees, start=1):
        for n, feature in enumerate(tree.feature):
            split, k = leaf, feature - len(how.categories)
            if feature >= 0 and k < 0:
                split = (feature, [float(b) for b in np.flatnonzero(tree.goes_left[n])], how.categories[feature])
            elif feature >= 0:
                split = (feature, [how.cuts[k][int(tree.goes_left[n].sum()) - 1]], -1)
            stats = [float(tree.rows[n]), 0.0, 0.0]
            yield t, (n, tree.value[n], 0.0, stats, tree.rows[n], tree.gain[n], tree.left[n], tree.right[n], split)


_SAVED = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, "
    "gain: double, leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)


def ensemble(
    spark: SparkSession, base: float, trees: list[Tree], how: Binning, features_col: str, label: str
) -> GBTClassificationModel:
    """Spark's model of the trees: written as Spark writes one, and loaded.

    Its probability is 1 / (1 + exp(-2 m)) of the weighted sum m, so every tree has the weight one half.
    """
    def described(kind: str, uid: str, **more) -> str:
        return json.dumps({
            "class": f"org.apache.spark.ml.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid,
            "paramMap": {"featuresCol": features_col, "labelCol": label, "impurity": "variance"}, "defaultParamMap": {}, **more,
        })

    name = f"GBTClassifier_{uuid.uuid4().hex[:12]}"
    with scratch(spark, "ensemble") as path:
        whole = described(
            "classification.GBTClassificationModel", name, numFeatures=len(how.sizes), numTrees=len(trees) + 1)
        spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
        each = [(t, described("regression.DecisionTreeRegressionModel", f"dtr_{uuid.uuid4().hex[:12]}"), 0.5) for t in range(len(trees) + 1)]
        spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        spark.createDataFrame(list(_nodes(base, trees, how)), _SAVED).coalesce(1).write.parquet(f"{path}/data")
        return GBTClassificationModel.load(path)


@dataclass(frozen=True)
class Grown:
    """The trees of an ensemble over bins; a feature's bins are its categories where it has no cuts."""

    cuts: list[np.ndarray | None]
    sizes: list[int]
    trees: list[Tree]
    weights: list[float]
    depth: int

    def bins(self, f: int, values: np.ndarray) -> np.ndarray:
        if np.isnan(values).any():
            raise ValueError("a feature is not a number")
        if self.cuts[f] is None:
            return np.minimum(values, self.sizes[f] - 1).astype(np.intp)
        return np.searchsorted(self.cuts[f], values, side="left")


def grown(spark: SparkSession, model: GBTClassificationModel) -> Grown:
    """What Spark's model says of its trees, from its saved form."""
    with scratch(spark, "grown") as path:
        model.write().overwrite().save(path)
        nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()  # some 60 a tree
    splits = [n["split"] for n in nodes if n["leftChild"] >= 0]
    cuts, sizes = [], []
    for f in range(model.numFeatures):
        own = [s for s in splits if s["featureIndex"] == f]
        categories = max((s["numCategories"] for s in own), default=-1)
        at = None if categories >= 0 else np.unique([s["leftCategoriesOrThreshold"][0] for s in own])
        cuts.append(at)
        sizes.append(categories if at is None else len(at) + 1)
    trees, width = [Tree(max(sizes, default=1)) for _ in range(model.getNumTrees)], max(sizes, default=1)
    for n in sorted(nodes, key=lambda n: (n["treeID"], n["id"])):
        tree = trees[n["treeID"]]
        at = tree.add(n["prediction"], 0)
        if n["leftChild"] >= 0:
            f, values = n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"]
            goes = np.zeros(width, bool)
            if cuts[f] is None:
                goes[np.array(values, np.intp)] = True
            else:
                goes[: np.searchsorted(cuts[f], values[0], side="left") + 1] = True
            tree.feature[at], tree.goes_left[at], tree.left[at], tree.right[at] = f, goes, n["leftChild"], n["rightChild"]
    return Grown(cuts, sizes, trees, list(model.treeWeights), max(t.depth for t in model.trees))


def exchanged_margins(
    model: Grown, own: list[np.ndarray], others: list[np.ndarray], trees_of: list[list[int]]
) -> tuple[np.ndarray, np.ndarray]:
    """Margins of rows, and for each feature those with that feature's value taken from the other row.

    ``trees_of`` has for each feature the trees that split by it; of those alone the leaf is found again.
    """
    at, there = ([model.bins(f, values) for f, values in enumerate(x)] for x in (own, others))
    margin, change = np.zeros(len(own[0])), np.zeros((len(trees_of), len(own[0])))
    for t, (tree, weight) in enumerate(zip(model.trees, model.weights, strict=True)):
        used = [f for f, numbers in enumerate(trees_of) if t in numbers]
        if len(tree.feature) // 2 >= LeafSets.MOST:
            bins, values = np.stack(at), np.array(tree.value)
            before = values[tree.places(bins, model.depth)]
            for f in used if others else ():
                moved = bins.copy()
                moved[f] = there[f]
                change[f] += weight * (values[tree.places(moved, model.depth)] - before)
        else:
            sets = LeafSets(tree.feature, tree.goes_left, tree.left, tree.right, tree.value, model.sizes)
            looked = [sets.of[f].take(at[f]) for f in used]
            above = [np.full(len(margin), (1 << len(sets.values)) - 1, np.int64)]  # what the features so far leave
            for own_set in looked:
                above.append(above[-1] & own_set)
            before, below = sets.value(above[-1]), above[0]
            for i in reversed(range(len(used) if others else 0)):
                f = used[i]
                change[f] += weight * (sets.value(above[i] & below & sets.of[f].take(there[f])) - before)
                below = below & looked[i]
        margin += weight * before
    return margin, margin + change
