"""Whitening of embeddings, its covariance by polarisation.

The covariance of two dimensions is half of what the variance of their sum exceeds their own variances by.
So tasks only sum squares: of every centred dimension and of the sum of every two, in whole numbers. Spark
adds these up exactly, and the variances' differences give the matrix whose eigenvectors whiten.

Values are centred in two steps that lose nothing. A task takes off the whole number nearest the mean, which
keeps squares small however many rows there are; what the mean has beyond it is taken off the exact totals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.llm.arrow import bounded_batches

SCALE, SHIFT = 64, 1_000_000  # an entry c counts as floor(64 c) + 1,000,000
COMPONENTS = 32
ROWS = 2048  # vectors that are multiplied at once
_LIMB = 30  # bits of the parts that exact totals travel in
_LIMBS = 6
_EXACT = 1 << 62


def whole_numbers(batch: pa.Array, width: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in the batch and their vectors as whole numbers, all of one width at a time.

    Left out are vectors that are null or empty, hold null or non-finite entries, or entries whose
    number doesn't fit a long.
    """
    sizes = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = batch.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for size in [width] if width is not None else np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        for part in np.array_split(at, -(-len(at) // ROWS)) if len(at) else ():
            with np.errstate(invalid="ignore", over="ignore"):
                scaled = np.floor(flat[starts[part][:, None] + np.arange(size)] * SCALE)
                fine = (np.abs(scaled) < float(_EXACT)).all(axis=1)
            if fine.any():
                yield part[fine], scaled[fine].astype(np.int64) + SHIFT


def _limbs(total: int) -> list[int]:
    """A whole number in parts that may be added up one by one; only the last is signed."""
    return [total >> (_LIMB * i) & ((1 << _LIMB) - 1) for i in range(_LIMBS - 1)] + [total >> (_LIMB * (_LIMBS - 1))]


def _total(limbs) -> int:
    return sum(int(x) << (_LIMB * i) for i, x in enumerate(limbs))


def _column_sums(values: np.ndarray) -> list[int]:
    """Exact sums of the columns."""
    if len(values) and int(np.abs(values).max()) * len(values) >= _EXACT:
        values = values.astype(object)
    return [int(x) for x in values.sum(axis=0)]


def _added(frame: DataFrame, keys: list[str]) -> list:
    """Totals by key, added up in Spark; as many rows as there are keys, never more than dimensions squared."""
    sums = [F.sum(f"limb{i}").alias(f"limb{i}") for i in range(_LIMBS)]
    return frame.groupBy(*keys).agg(F.sum("n").alias("n"), *sums).collect()


def _partial(frame: DataFrame, keys: dict[str, pa.DataType], gather: Callable[[Iterator[pa.RecordBatch]], dict[tuple, list[int]]]) -> DataFrame:
    """One row per key and task: the number of vectors and a total in limbs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = gather(batches)
        if found:
            columns = [pa.array([k[i] for k in found], kind) for i, kind in enumerate(keys.values())]
            limbs = [_limbs(total) for _, total in found.values()]
            columns.append(pa.array([n for n, _ in found.values()], pa.int64()))
            columns += [pa.array([x[i] for x in limbs], pa.int64()) for i in range(_LIMBS)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "n", *(f"limb{i}" for i in range(_LIMBS))])

    fields = ", ".join([*(f"{k} int" for k in keys), "n long", *(f"limb{i} long" for i in range(_LIMBS))])
    return frame.mapInArrow(run, fields)


@dataclass(frozen=True)
class Moments:
    """Number of vectors, and for each dimension the exact sum and the whole number nearest the mean."""

    n: int
    sums: list[int]

    @property
    def width(self) -> int:
        return len(self.sums)

    @property
    def near(self) -> list[int]:
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    @property
    def rest(self) -> list[int]:
        """n times what the mean exceeds that number by; at most n / 2."""
        return [s - self.n * m for s, m in zip(self.sums, self.near, strict=True)]


def moments(vectors: DataFrame) -> Moments | None:
    """Moments of the vectors (column ``vector``) of the most frequent width, the larger of two; None without any."""

    def gather(batches: Iterator[pa.RecordBatch]) -> dict[tuple, list[int]]:
        found: dict[tuple, list[int]] = {}
        for batch in batches:
            for _, x in whole_numbers(batch.column("vector")):
                for d, s in enumerate(_column_sums(x)):
                    total = found.setdefault((x.shape[1], d), [0, 0])
                    total[0] += len(x)
                    total[1] += s
        return found

    rows = _added(_partial(vectors.select("vector"), {"width": pa.int32(), "d": pa.int32()}, gather), ["width", "d"])
    if not rows:
        return None
    _, width = max((r["n"], r["width"]) for r in rows)
    by_place = {r["d"]: r for r in rows if r["width"] == width}
    sums = [_total(by_place[d][f"limb{i}"] for i in range(_LIMBS)) for d in range(width)]
    return Moments(by_place[0]["n"], sums)


def squares(vectors: DataFrame, known: Moments) -> dict[tuple[int, int], int]:
    """Exact sums over all vectors of (n x - S) squared, and of that of two dimensions' sum, times n to the -2.

    The key (i, i) is dimension i, (i, j) the sum of i and j. The values are whole numbers over n: given
    here times n.
    """
    n, near, rest, width = known.n, known.near, known.rest, known.width

    def gather(batches: Iterator[pa.RecordBatch]) -> dict[tuple, list[int]]:
        sums = [[0] * (width - i) for i in range(width)]
        count = 0
        for batch in batches:
            for _, x in whole_numbers(batch.column("vector"), width):
                c = _minus(x, near)
                if c.dtype != object and 4 * int(np.abs(c).max()) ** 2 * len(c) >= _EXACT:
                    c = c.astype(object)
                count += len(c)
                for i in range(width):
                    both = c[:, i:] + c[:, i : i + 1]
                    both[:, 0] = c[:, i]
                    sums[i] = [a + int(b) for a, b in zip(sums[i], (both * both).sum(axis=0), strict=True)]
        return {(i, i + j): [count, s] for i, listed in enumerate(sums) for j, s in enumerate(listed)} if count else {}

    rows = _added(_partial(vectors.select("vector"), {"i": pa.int32(), "j": pa.int32()}, gather), ["i", "j"])
    # sum (n c - r)^2 = n (n sum c^2 - r^2), as the sum of c is r
    return {
        (r["i"], r["j"]): n * _total(r[f"limb{i}"] for i in range(_LIMBS)) - (rest[r["i"]] + (rest[r["j"]] if r["i"] != r["j"] else 0)) ** 2
        for r in rows
    }


def _minus(x: np.ndarray, near: list[int]) -> np.ndarray:
    """The vectors less whole numbers, in Python's own numbers where longs would overflow."""
    if int(np.abs(x).max()) + max(map(abs, near)) < _EXACT:
        return x - np.array(near, np.int64)
    return x.astype(object) - np.array(near, object)


def covariance(found: dict[tuple[int, int], int], known: Moments) -> np.ndarray:
    """The covariance matrix with divisor n; every entry is exact before it is rounded once."""
    n, width = known.n, known.width
    out = np.empty((width, width))
    for i in range(width):
        for j in range(i, width):
            twice = found[i, j] - found[i, i] - found[j, j] if i != j else 2 * found[i, i]
            out[i, j] = out[j, i] = float(Fraction(twice, 2 * n * n))
    return out


def components(matrix: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues and their unit eigenvectors (as columns), the largest first.

    Eigenvalues that are zero to within rounding have no whitened values and are left out. An
    eigenvector's largest entry is positive.
    """
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > len(matrix) * np.finfo(float).eps * max(values[-1], 0.0)]
    chosen = vectors[:, order]
    signs = np.sign(chosen[np.abs(chosen).argmax(axis=0), np.arange(len(order))]) if len(order) else np.ones(0)
    return values[order], chosen * signs


@dataclass(frozen=True)
class Whitening:
    """What whitens a vector: the moments, and the components scaled by one over their deviation."""

    known: Moments
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        c, n = _minus(x, self.known.near), self.known.n
        if c.dtype != object and (int(np.abs(c).max()) + 1) * n >= _EXACT:
            c = c.astype(object)
        return c * n - np.array(self.known.rest, c.dtype)

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        """Sum of the squares over the dimensions, exact; None where it doesn't fit a long."""
        if centred.dtype != object and int(np.abs(centred).max()) ** 2 * centred.shape[1] >= _EXACT:
            centred = centred.astype(object)
        return [int(v) if v < 1 << 63 else None for v in (centred * centred).sum(axis=1)]

    def project(self, centred: np.ndarray) -> np.ndarray:
        # a mean of the same n for all: division by it loses nothing that the products keep
        return (centred / self.known.n).astype(np.float64) @ self.vectors / np.sqrt(self.values)


def fit(vectors: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """The whitening of the vectors (column ``vector``); None without any. Two passes."""
    known = moments(vectors)
    if known is None:
        return None
    matrix = covariance(squares(vectors, known), known)
    values, chosen = components(matrix, most)
    return Whitening(known, values, chosen, float(np.trace(matrix)))


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity; one pass.

    The whitened vectors are centred to begin with; what rounding leaves of their mean is taken off again.
    """
    size, width = len(model.values), model.known.width

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            for _, x in whole_numbers(batch.column("vector"), width):
                w = model.project(model.centred(x))
                products += w.T @ w
                sums += w.sum(axis=0)
        place = np.indices((size + 1, size))
        yield pa.RecordBatch.from_arrays([
            pa.array(place[0].ravel(), pa.int32()), pa.array(place[1].ravel(), pa.int32()), pa.array(np.vstack([products, sums]).ravel()),
        ], names=["i", "j", "total"])

    rows = vectors.select("vector").mapInArrow(gather, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    out = np.zeros((size + 1, size))
    for r in rows:
        out[r["i"], r["j"]] = r["total"] / model.known.n
    return float(np.abs(out[:size] - np.outer(out[size], out[size]) - np.eye(size)).max())


def whitened(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of every vector and component.

    Vectors that are null or empty or hold null or non-finite entries are dropped, and so are those with
    entries beyond longs and those not as wide as the most frequent (of two equal ones, the larger).
    Components without variance are left out, so copies of one vector give no rows. Repeated rows count
    and come out repeated, a null id stays null, other columns are ignored. A deviation beyond a long is
    null. What the driver holds grows with the square of the vectors' width, not with the rows.
    """
    spark = embeddings.sparkSession
    bounded_batches(spark)
    rows = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    fields = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(rows, most)
    if model is None or not len(model.values):
        return spark.createDataFrame([], fields)
    error = identity_error(rows, model)
    size, width = len(model.values), model.known.width
    explained = model.values / model.trace

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in whole_numbers(batch.column("vector"), width):
                centred = model.centred(x)
                repeat = pa.array(np.repeat(np.arange(len(at)), size))
                count = len(at) * size
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").take(pa.array(at)).take(repeat), pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(count, model.known.n)), pa.array(model.deviations(centred), pa.int64()).take(repeat),
                    pa.array(model.project(centred).ravel()), pa.array(np.tile(explained, len(at))), pa.array(np.full(count, error)),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(apply, fields)
