"""Whitening of embeddings from an exact scatter matrix, summed by bit planes.

Each entry c becomes the integer x = floor(1024 c) + 100000. For a block of rows, the entries of a dimension are shifted by
their minimum, and bit a of all rows is packed into 64-bit words: the bit plane P[i, a]. Then

    sum over rows of y_i y_j = sum over bits a, b of 2^(a+b) popcount(P[i, a] and P[j, b])

is exact, and so is the sum of x_i x_j after the shift is taken back. Blocks are summed in each task, tasks by
Spark as decimals; the driver gets one number per pair of dimensions, whatever the number of rows, centres them as
integers, n S_ij - S_i S_j, and only then rounds to doubles for the eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import slices

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Rows whose planes are packed together.
BLOCK_ROWS = 4096
#: Words that are combined at a time.
PRODUCT_WORDS = 1 << 18
#: Components with a smaller share of the largest variance are rounding errors of dependent dimensions.
LEAST_SHARE = 1e-12


def integer_vectors(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x) for each length of vector in a list array, without unusable ones: x[k] belongs to row rows[k].

    Unusable are null and empty vectors, those with an entry that is null or not finite, and those with an
    entry so large that x is no 64-bit integer.
    """
    if not len(vectors):
        return
    lengths = np.asarray(vectors.value_lengths().fill_null(0))
    flat = vectors.flatten().cast(pa.float64())
    values = np.floor(flat.to_numpy(zero_copy_only=False) * SCALE) if len(flat) else np.zeros(0)  # null entries are NaN
    begins = np.cumsum(lengths) - lengths
    for length in np.unique(lengths[lengths > 0]).tolist():
        rows = (lengths == length).nonzero()[0]
        found = values[begins[rows][:, None] + np.arange(length)]
        good = (np.abs(found) < 2.0**62).all(axis=1)  # false for NaN and infinities
        yield rows[good], found[good].astype(np.int64) + SHIFT


def bit_planes(y: np.ndarray, bits: int) -> np.ndarray:
    """[bit, dimension, word] with bit ``bit`` of 64 rows to a word, of non-negative ``y`` [row, dimension]."""
    padded = np.zeros((-(-len(y) // 64) * 64, y.shape[1]), np.uint64)
    padded[: len(y)] = y
    planes = [np.packbits(((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T, axis=1) for b in range(bits)]
    return np.ascontiguousarray(np.stack(planes)).view(np.uint64)


def cross_products(y: np.ndarray) -> np.ndarray:
    """Sums over rows of y_i y_j as Python integers, for non-negative ``y``; [i, j]."""
    dimensions = y.shape[1]
    bits = max(1, int(y.max(initial=0)).bit_length())
    planes = bit_planes(y, bits)
    # Counts of a weight are at most rows x bits: sums of them fit until the weights themselves do not.
    kind = np.int64 if 2 * bits + len(y).bit_length() <= 62 else object
    total = np.zeros((dimensions, dimensions), kind)
    step = max(1, PRODUCT_WORDS // max(1, planes[0].size))
    for a in range(bits):
        for b in range(a, bits):
            counts = np.empty((dimensions, dimensions), np.int64)
            for i in range(0, dimensions, step):
                both = planes[a][i : i + step, None, :] & planes[b][None, :, :]
                counts[i : i + step] = np.bitwise_count(both).sum(axis=2, dtype=np.int64)
            counts = counts if a == b else counts + counts.T
            total += counts.astype(kind) * (1 << (a + b))
    return total.astype(object)


class Scatter:
    """Number of rows, sums and cross-products of integer vectors of one length, exactly."""

    def __init__(self, dimensions: int):
        self.n, self.sums = 0, np.zeros(dimensions, object)
        self.products = np.zeros((dimensions, dimensions), object)

    def add(self, x: np.ndarray) -> None:
        for begin in range(0, len(x), BLOCK_ROWS):
            part = x[begin : begin + BLOCK_ROWS]
            low = part.min(axis=0)
            y = part.view(np.uint64) - low.view(np.uint64)  # right even where the difference exceeds a signed number
            shift = low.astype(object)
            y_sums = (y & np.uint64(0xFFFFFFFF)).sum(axis=0).astype(object) + (y >> np.uint64(32)).sum(axis=0).astype(object) * 2**32
            cross = np.outer(shift, y_sums)
            self.products += cross_products(y) + cross + cross.T + len(part) * np.outer(shift, shift)
            self.sums += y_sums + len(part) * shift
            self.n += len(part)


@dataclass(frozen=True)
class Whitening:
    """What the fit gives: x is whitened by ``axes`` (components by rows, over the root of their variance)."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    explained: np.ndarray
    identity_error: float


def scatter(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """length, i, j, total: sums of x_i x_j for i <= j, of x_i for j = -1, and the number of rows for i = j = -1."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Scatter] = {}
        for batch in slices(batches, BLOCK_ROWS):
            for _, x in integer_vectors(batch.column("vector")):
                if len(x):
                    found.setdefault(x.shape[1], Scatter(x.shape[1])).add(x)
        for length, s in found.items():
            i, j = np.triu_indices(length)
            total = [*map(str, s.products[i, j]), *map(str, s.sums), str(s.n)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([length] * len(total), pa.int32()),
                    pa.array([*i.tolist(), *range(length), -1], pa.int32()),
                    pa.array([*j.tolist(), *[-1] * length, -1], pa.int32()),
                    pa.array(total),
                ],
                ["length", "i", "j", "total"],
            )

    sums = rows.select(rows[vector].alias("vector")).mapInArrow(partial, "length int, i int, j int, total string")
    return sums.groupBy("length", "i", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the usable vectors of ``rows``; None if there are none.

    If lengths differ, the most frequent one counts (of equally frequent ones the longest).
    """
    sums = scatter(rows, vector).persist()  # small, and computed again from the rows if lost
    try:
        counted = sums.filter("i = -1").orderBy(F.col("total").desc(), F.col("length").desc()).first()
        if counted is None:
            return None
        length, n = counted["length"], int(counted["total"])
        total = np.zeros((length, length), object)
        first = np.zeros(length, object)
        # One row per pair of dimensions.
        for row in sums.filter((F.col("length") == length) & (F.col("i") >= 0)).toLocalIterator():
            if row["j"] < 0:
                first[row["i"]] = int(row["total"])
            else:
                total[row["i"], row["j"]] = total[row["j"], row["i"]] = int(row["total"])
    finally:
        sums.unpersist()
    centred = n * total - np.outer(first, first)
    covariance = np.array([[value / n**2 for value in row] for row in centred.tolist()], float)
    variances, axes = np.linalg.eigh(covariance)
    order = np.argsort(-variances, kind="stable")[:components]
    order = order[variances[order] > LEAST_SHARE * max(variances.max(), 0.0)]
    axes = axes[:, order].T
    largest = axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)]  # either sign will do; this one is always the same
    axes = axes * np.sign(largest)[:, None] / np.sqrt(variances[order])[:, None]
    error = np.abs(axes @ covariance @ axes.T - np.eye(len(axes))).max(initial=0.0)
    return Whitening(n, tuple(first.tolist()), axes, variances[order] / max(np.trace(covariance), 1e-300), float(error))


def deviations(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, list[int | None]]:
    """(x - S / n) and the exact sum of (n x - S)^2 of each row, None where that is no 64-bit integer."""
    largest = model.n * int(np.abs(x).max(initial=0)) + max(map(abs, model.sums))
    if largest < 2**62:
        centred = x * model.n - np.array(model.sums, np.int64)
    else:
        centred = x.astype(object) * model.n - np.array(model.sums, object)
    if x.shape[1] * int(np.abs(centred).max(initial=0)) ** 2 < 2**63:
        exact = (centred**2).sum(axis=1).tolist()
    else:
        exact = [int(total) if total < 2**63 else None for total in (centred.astype(object) ** 2).sum(axis=1)]
    return centred.astype(float) / model.n, exact


def whitened(rows: DataFrame, *, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error for each usable row and component.

    Components are numbered from 1 by falling variance; those without variance (all rows equal in that direction, a single
    row, fewer dimensions than ``components``) are left out. Rows whose vector is null, empty, of another length than the most
    frequent one, or has a null, infinite or too large entry give no rows. Repeated rows and null ids count as rows
    of their own. ``deviation`` is null where the exact value exceeds 64 bits. Only ``id`` and ``vector`` are read.
    """
    pair = rows.select(rows[id].alias("id"), rows[vector].alias("vector"))
    kind = pair.schema["id"].dataType.simpleString()
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(pair, "vector", components)
    if model is None or not len(model.axes):
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.axes)
        for batch in slices(batches, BLOCK_ROWS):
            for at, x in integer_vectors(batch.column("vector")):
                if x.shape[1] != len(model.sums) or not len(x):
                    continue
                centred, exact = deviations(x, model)
                each = pa.array(np.repeat(at, k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(k * len(x), model.n)),
                        pa.array(exact, pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                        pa.array((centred @ model.axes.T).ravel()),
                        pa.array(np.tile(model.explained, len(x))),
                        pa.array(np.full(k * len(x), model.identity_error)),
                    ],
                    names,
                )

    return pair.mapInArrow(apply, schema).withColumnRenamed("id", id)
