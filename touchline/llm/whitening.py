"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Each entry c becomes the whole number x = floor(256 c), and every distinct x vector
is fitted once, so copies do not weigh.  The fit list is a Parquet table of packed
vectors in the shared folder; all passes read it.

The bidiagonalisation works on the centred rows X.  Step k makes u_k from X v_k and
v_{k+1} from X' u_k.  Right vectors (one number a dimension) are on the driver.  A
left vector has one number a row and is never gathered or stored: it lies in the
column space of X, so it is kept as the coefficients c with u = X c, and tasks make
it again from their rows.  A pass gives X' u, and the products of u with itself and
with all left vectors before it, which is what full reorthogonalisation needs; the
right vectors are orthogonalised on the driver, twice.  When a pass shows that much
of u went away, it is repeated on what is left.  If a direction is exhausted, the
next one starts from a new vector orthogonal to all before.  The steps go on to the
full dimension, so repeated eigenvalues are all found.  The singular values and
right vectors of the small bidiagonal matrix then give deviations and components.

Partial sums of tasks are added up by Spark by key, so that the driver gets a few
numbers a pass whatever the number of rows and tasks.  Sums of x, and ``deviation``,
are exact integers.

Defined results: rows with a null vector, or with null or non-finite entries, are
dropped, and so are vectors that do not have the table's length (the one that most
remaining vectors have; of equally common ones the longest); a row with a null id
stays; repeated rows are each reported.  Entries beyond 64 bits are held at the
ends of the range.  A component whose deviation is zero up to rounding (as with a
single vector, or fewer dimensions) is left out, so a table without any gives an
empty result, as an empty one does.  A ``deviation`` beyond 64 bits is null.  Each
component's sign is chosen so that its largest entry is positive.  Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import frames

SCALE = 256
COMPONENTS = 4
SEED = 20
#: Singular values below this share of the largest are zero up to rounding.
ZERO = 1e-12
#: A left vector is worked out again if it lost this share of its length.
LOST = 0.1

RESULT = ("vec_id long, component int, n long, deviation long, whitened double, "
          "explained double, identity_error double")
INT64 = np.iinfo(np.int64)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v: vectors without null or non-finite entries, of one length."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).filter(
        (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < float("inf"))))
    lengths = rows.groupBy(F.size("v").alias("d")).count()
    common = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("v") == (common["d"] if common else 0))


def packed(rows: DataFrame) -> DataFrame:
    """vec_id, x: the whole numbers of each vector, eight bytes each."""
    def work(batch):
        v = batch.column(1)
        flat = v.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        x = np.floor(flat * SCALE)
        # The largest double below 2 ** 63 is not the largest integer.
        x = np.where(x >= 2.0 ** 63, INT64.max, np.clip(x, -2.0 ** 63, 2.0 ** 62 * 1.999).astype(np.int64))
        return {"x": [row.tobytes() for row in x.astype("<i8")]}

    return frames.arrow_map(rows, work, "x binary", ("vec_id",))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The packed vectors of a batch, a row each."""
    x = batch.column(batch.schema.get_field_index("x")).to_pylist()
    return np.frombuffer(b"".join(x), "<i8").reshape(len(x), -1)


def added(fit: DataFrame, work: Callable[[np.ndarray], np.ndarray], size: int,
          kind: str = "double") -> list:
    """The sums over all tasks of the ``size`` numbers that ``work`` makes of a
    block of rows."""
    numbers = np.float64 if kind == "double" else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in frames.slices(batches):
            if batch.num_rows:
                part = work(matrix(batch))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(size, dtype=np.int32)), pa.array(total.astype(numbers))],
                ["k", "x"])

    value = F.col("x") if kind == "double" else F.col("x").cast("decimal(38,0)")
    rows = fit.mapInArrow(run, f"k int, x {kind}").groupBy("k").agg(F.sum(value).alias("x")).collect()
    out = [0] * size
    for k, x in rows:
        out[k] = x if kind == "double" else int(x)
    return out


def exact_sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of vectors, and the sum of each dimension."""
    def work(x):
        # High and low halves, so that no sum of a block leaves 64 bits.
        return np.concatenate(([len(x)], (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)))

    found = added(fit, work, 1 + 2 * size, "long")
    return found[0], [(a << 32) + b for a, b in zip(found[1:size + 1], found[size + 1:])]


def bidiagonalised(fit: DataFrame, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right singular vectors (as rows) of the centred rows."""
    d = len(mean)
    rng = np.random.default_rng(SEED)
    right, left, images = np.zeros((0, d)), np.zeros((0, d)), np.zeros((0, d))
    alphas, betas = [], []

    def orthogonal(v):
        for _ in range(2):
            v = v - right.T @ (right @ v)
        return v

    def fresh():
        """A new direction, or none if all are taken."""
        v = orthogonal(rng.standard_normal(d))
        return v / np.linalg.norm(v)

    def products(c):
        """For u = X c: u with the left vectors, with itself, and X' u."""
        basis = np.vstack((left, c))

        def work(x):
            centred = x - mean
            z = centred @ basis.T
            return np.concatenate((z[:, -1] @ z, z[:, -1] @ centred))

        found = np.array(added(fit, work, len(basis) + d))
        return found[:len(left)], found[len(left)], found[len(basis):]

    v, beta = fresh(), 0.0
    for _ in range(d):
        right = np.vstack((right, v))
        c = v - beta * left[-1] if len(left) else v
        while True:
            along, square, image = products(c)
            c, image = c - left.T @ along, image - images.T @ along
            rest = max(square - along @ along, 0.0)
            # At most once more after most of it went: then it is nothing.
            if along @ along <= LOST ** 2 * square or rest <= (ZERO * max([1e-300, *alphas])) ** 2:
                break
        alpha = rest ** 0.5
        if alpha <= ZERO * max([0.0, *alphas, *betas]):
            alpha, c, image = 0.0, np.zeros(d), np.zeros(d)
        else:
            c, image = c / alpha, image / alpha
        left, images = np.vstack((left, c)), np.vstack((images, image))
        alphas.append(alpha)
        if len(right) == d:
            break
        following = orthogonal(image - alpha * v)
        beta = float(np.linalg.norm(following))
        if beta <= ZERO * max([1e-300, *alphas, *betas]):
            following, beta = fresh(), 0.0
        else:
            following = following / beta
        betas.append(beta)
        v = following
    small = np.diag(alphas) + np.diag(betas, 1) if betas else np.diag(alphas)
    _, values, rotated = np.linalg.svd(small)
    return values, rotated @ right


def components(fit: DataFrame, mean: np.ndarray, n: int, wanted: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Unit components (rows) by falling eigenvalue, those values, and the trace."""
    values, vectors = bidiagonalised(fit, mean)
    keep = int((values[:wanted] > ZERO * values[0]).sum()) if values[0] > 0 else 0
    vectors = vectors[:keep]
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    largest = np.abs(vectors).argmax(1)
    vectors *= np.sign(vectors[np.arange(keep), largest])[:, None]
    return vectors, values[:keep] ** 2 / n, float((values ** 2).sum() / n)


def identity_gap(fit: DataFrame, mean: np.ndarray, n: int, onto: np.ndarray) -> float:
    """Largest entry of the whitened rows' covariance less the identity."""
    k = len(onto)
    means = np.array(added(fit, lambda x: ((x - mean) @ onto.T).sum(0), k)) / n

    def work(x):
        z = (x - mean) @ onto.T - means
        return (z.T @ z).ravel()

    return float(np.abs(np.array(added(fit, work, k * k)).reshape(k, k) / n - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Of each row, the sum over dimensions of (n x - S) ** 2, or null beyond 64 bits."""
    largest = n * int(np.abs(x.astype(float)).max()) + max(map(abs, sums))
    if x.shape[1] * largest * largest <= INT64.max:
        gaps = n * x - np.array(sums)
        return (gaps * gaps).sum(1).tolist()
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
    return [e if e <= INT64.max else None for e in exact]


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
             wanted: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component: ``RESULT``."""
    spark = vectors.sparkSession
    rows = packed(usable(vectors, id_col, vector_col))
    fit = frames.staged(rows.select("x").distinct())
    one = fit.first()
    if one is None:
        return spark.createDataFrame([], RESULT)
    n, sums = exact_sums(fit, len(one["x"]) // 8)
    mean = np.array([s / n for s in sums])
    axes, values, trace = components(fit, mean, n, wanted)
    k = len(axes)
    if not k:
        return spark.createDataFrame([], RESULT)
    onto = axes / np.sqrt(values)[:, None]
    gap = identity_gap(fit, mean, n, onto)
    explained = values / trace

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames.slices(batches):
            if not batch.num_rows:
                continue
            x, size = matrix(batch), batch.num_rows
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(np.repeat(np.arange(size), k)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                pa.array(np.full(size * k, n)),
                pa.array(deviations(x, n, sums), pa.int64()).take(np.repeat(np.arange(size), k)),
                pa.array(((x - mean) @ onto.T).ravel()),
                pa.array(np.tile(explained, size)),
                pa.array(np.full(size * k, gap))], [c.split()[0] for c in RESULT.split(", ")])

    return rows.mapInArrow(work, RESULT)
