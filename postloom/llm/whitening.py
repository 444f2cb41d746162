"""Embedding whitening by spectrum slicing.

The covariance of the integer vectors is made exactly: tasks add up integer products of centred entries, and the driver gets
one number for each pair of dimensions, whatever the number of rows. Inertia counts of the shifted covariance (the positive
pivots of its LDL' factors, by Sylvester's law) say how many eigenvalues lie above a shift; bisection by counts isolates each
leading one, Rayleigh quotient iteration takes it to double precision, and counts on both sides of the result certify its
number. The rows are then centred, projected and scaled where they lie: nothing is shuffled but the sums.

Defined results: vectors that are null, empty, or hold null or non-finite entries are dropped, and so are those with an entry of
2**42 or more, which integers in doubles can't hold. Of vectors of several lengths, those of the most frequent length stay
(the greater of equally frequent ones). Repeated rows and null ids count and return row by row. A component without variance
(rank of the covariance, or equal vectors) has no whitened value and is not returned; equal eigenvalues have any orthonormal
basis of their space. deviation is null where it exceeds a long; deviation_exact has it then, too. Other columns are not read.
docs must give the same rows when it is read again.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import cut, table

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LARGEST = 2.0**42
_EPS = np.finfo(float).eps
#: Bunch and Parlett's bound: a pivot of one row is taken if it is so large a part of the largest entry.
_PIVOT = (1 + 17**0.5) / 8


class Factors:
    """P A P' = L D L' of a symmetric matrix, with pivots of one or two rows: solves, and counts positive eigenvalues."""

    def __init__(self, a: np.ndarray) -> None:
        a, n, k, self.positive = a.copy(), len(a), 0, 0
        self.order, self.lower, self.pivots = np.arange(n), np.eye(n), np.zeros((n, n))
        while k < n:
            rest = np.abs(a[k:, k:])
            one = int(np.argmax(np.diagonal(rest)))
            i, j = sorted(divmod(int(np.argmax(rest)), n - k))
            if not rest[i, j]:
                break  # what is left is zero: its eigenvalues are at the shift
            places = [one] if rest[one, one] >= _PIVOT * rest[i, j] else [i, j]
            for to, at in enumerate(places):
                swap, back = [k + to, k + at], [k + at, k + to]
                a[swap] = a[back]
                a[:, swap] = a[:, back]
                self.lower[swap, :k] = self.lower[back, :k]
                self.order[swap] = self.order[back]
            z = k + len(places)
            block, below = a[k:z, k:z].copy(), a[z:, k:z].copy()
            factor = np.linalg.solve(block, below.T).T
            a[z:, z:] -= factor @ below.T
            self.lower[z:, k:z], self.pivots[k:z, k:z] = factor, block
            self.positive += 1 if len(places) == 2 else int(block[0, 0] > 0)  # a pivot of two rows has one of each sign
            k = z
        self.rank = k

    def solve(self, b: np.ndarray) -> np.ndarray:
        """x of A x = b; directions of no pivot are followed far, as inverse iteration wants it."""
        n, d = len(self.order), self.pivots.copy()
        for k in range(self.rank, n):
            d[k, k] = _EPS**2
        half = np.linalg.solve(d, np.linalg.solve(self.lower, b[self.order]))
        out = np.empty_like(half)
        out[self.order] = np.linalg.solve(self.lower.T, half)
        return out


class Spectrum:
    """The leading eigenvalues of a symmetric matrix without negative ones, each with its unit vector and its certified number."""

    def __init__(self, matrix: np.ndarray) -> None:
        self.scale = float(np.trace(matrix)) or 1.0
        self.a, self.counts = (matrix + matrix.T) / (2 * self.scale), {}
        self.random = np.random.default_rng(7)

    def above(self, shift: float) -> int:
        """How many eigenvalues are greater than the shift."""
        if shift not in self.counts:
            self.counts[shift] = Factors(self.a - shift * np.eye(len(self.a))).positive
        return self.counts[shift]

    def bounds(self, number: int) -> tuple[float, float]:
        """The narrowest interval known to hold the eigenvalue of a number: counts taken for one serve the others."""
        low = max((s for s, n in self.counts.items() if n >= number), default=0.0)
        return low, min((s for s, n in self.counts.items() if n < number and s > low), default=2.0)

    def halve(self, number: int) -> bool:
        low, high = self.bounds(number)
        middle = (low + high) / 2
        if high - low <= 8 * _EPS or middle in (low, high):
            return False
        self.above(middle)
        return True

    def vectors(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Eigenvalues, falling, and their vectors as columns; those that are zero for double precision are left out."""
        values: list[float] = []
        found = np.zeros((len(self.a), 0))
        floor = 16 * len(self.a) * _EPS
        while len(values) < min(most, len(self.a)):
            number = len(values) + 1
            while True:
                low, high = self.bounds(number)
                if high <= floor:
                    return np.array(values) * self.scale, found
                inside = self.above(low) - number + 1 if low else 2  # how many are in (low, high]
                if inside == 1 and high - low <= 0.5 * high:
                    pair = self.iterate(number, low, high, found)
                    if pair:
                        values, found = [*values, pair[0]], np.column_stack([found, pair[1]])
                        break
                if not self.halve(number):  # as many equal eigenvalues as the interval has
                    together = max(1, self.above(low) - number + 1) if low else 1
                    space = self.space(high, together, found)
                    values, found = [*values, *[(low + high) / 2] * together], np.column_stack([found, space])
                    break
        return np.array(values[:most]) * self.scale, found[:, :most]

    def iterate(self, number: int, low: float, high: float, found: np.ndarray) -> tuple[float, np.ndarray] | None:
        """Rayleigh quotient iteration inside an interval that holds one eigenvalue; nothing if it leads out of it."""
        x = self.apart(Factors(self.a - (low + high) / 2 * np.eye(len(self.a))).solve(self.random.standard_normal(len(self.a))), found)
        best = None
        for _ in range(12):
            value = float(x @ self.a @ x)
            error = float(np.linalg.norm(self.a @ x - value * x))
            if best and error >= best[0]:
                break
            best = error, value, x
            x = self.apart(Factors(self.a - value * np.eye(len(self.a))).solve(x), found)
        error, value, x = best
        near = max(4 * error, 32 * _EPS)
        if low <= value <= high and self.above(value - near) >= number > self.above(value + near):
            return value, x
        return None

    def space(self, shift: float, size: int, found: np.ndarray) -> np.ndarray:
        """An orthonormal basis of the space of eigenvalues that doubles can't tell apart."""
        x, factors = self.random.standard_normal((len(self.a), size)), Factors(self.a - shift * np.eye(len(self.a)))
        for _ in range(4):
            x = factors.solve(x)
            x = np.linalg.qr(x - found @ (found.T @ x))[0]
        return x

    @staticmethod
    def apart(x: np.ndarray, found: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x / np.linalg.norm(x)
            x = x - found @ (found.T @ x)
        return x / np.linalg.norm(x)


def usable(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a batch that have a usable vector; by row of the batch, the vectors' lengths; all entries of the batch in a row."""
    column = batch.column("embedding")
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    with np.errstate(invalid="ignore"):
        bad = np.concatenate([[0], np.cumsum(~(np.abs(entries) < LARGEST))])
    ends = np.cumsum(size)
    return np.flatnonzero((size > 0) & (bad[ends] == bad[ends - size])), size, entries


def integers(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have a usable vector of the length, and their x."""
    rows, size, entries = usable(batch)
    rows = rows[size[rows] == length]
    at = (np.cumsum(size) - size)[rows][:, None] + np.arange(length)
    return rows, np.floor(SCALE * entries[at]).astype(np.int64) + SHIFT


def exact_total(x: np.ndarray) -> np.ndarray:
    """Sums of columns as Python's integers."""
    safe = len(x) * (int(np.abs(x).max(initial=0)) + 1) < 1 << 62
    return (x if safe else x.astype(object)).sum(0).astype(object)


def exact_products(y: np.ndarray) -> np.ndarray:
    """y' y as Python's integers: in doubles, by as many rows as they hold exactly, or in whole integers."""
    largest, out = int(np.abs(y).max(initial=0)) ** 2 + 1, np.zeros((y.shape[1],) * 2, object)
    rows = (1 << 53) // largest
    if not rows:
        y = y.astype(object)
        return y.T @ y
    for k in range(0, len(y), rows):
        part = y[k : k + rows].astype(float)
        out += (part.T @ part).astype(np.int64).astype(object)
    return out


_DECIMAL = pa.decimal128(38, 0)


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], _DECIMAL)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's vectors by length: their count (place -1) and the sums of x by dimension."""
    held: dict[int, tuple[int, np.ndarray]] = {}
    for b in batches:
        rows, size, _ = usable(b)
        for length in np.unique(size[rows]).tolist():
            x = integers(b, length)[1]
            n, total = held.get(length, (0, 0))
            held[length] = n + len(x), total + exact_total(x)
    for length, (n, total) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([length] * (length + 1), pa.int32()), pa.array(range(-1, length), pa.int32()), _decimals([n, *total])], ["length", "place", "total"])


def _products(length: int, centre: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            y = integers(b, length)[1] - centre
            held = exact_products(y) + (0 if held is None else held)
        if held is not None:
            i, j = np.triu_indices(length)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), _decimals(held[i, j])], ["i", "j", "total"])

    return run


class Whitening:
    """What makes whitened rows of vectors: fitted on all usable vectors of a frame."""

    def __init__(self, vectors: DataFrame, components: int = COMPONENTS) -> None:
        self.vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        only = self.vectors.select("embedding")
        sums = cut(only.mapInArrow(_sums, "length int, place int, total decimal(38,0)").groupBy("length", "place").agg(F.sum("total").alias("total")))
        most = sums.where("place = -1").orderBy(F.desc("total"), F.desc("length")).first()
        self.n, self.length = (int(most["total"]), most["length"]) if most else (0, 0)
        self.eigenvalues, self.axes = np.zeros(0), np.zeros((self.length, 0))
        if not self.n:
            return
        total = [int(r["total"]) for r in sums.where((F.col("length") == self.length) & (F.col("place") >= 0)).orderBy("place").collect()]
        self.centre = np.array([s // self.n for s in total], np.int64)  # the means, rounded down: what is left is added exactly below
        self.left = [s - self.n * c for s, c in zip(total, self.centre.tolist())]
        made = only.mapInArrow(_products(self.length, self.centre), "i int, j int, total decimal(38,0)").groupBy("i", "j").agg(F.sum("total").alias("total"))
        covariance = np.zeros((self.length,) * 2)
        trace = 0
        for r in made.collect():  # a number for each pair of dimensions
            exact = self.n * int(r["total"]) - self.left[r["i"]] * self.left[r["j"]]
            covariance[r["i"], r["j"]] = covariance[r["j"], r["i"]] = exact / self.n**2
            trace += exact if r["i"] == r["j"] else 0
        self.trace = trace / self.n**2
        if trace:
            self.eigenvalues, self.axes = Spectrum(covariance).vectors(components)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([s / self.n for s in self.left])
        return ((x - self.centre) - mean) @ (self.axes / np.sqrt(self.eigenvalues))

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """The sum over dimensions of (n x - S)^2, exact."""
        y = x - self.centre
        if (self.n * (int(np.abs(y).max(initial=0)) + 1)) ** 2 * max(1, self.length) >= 1 << 62:
            y = y.astype(object)
        off = y * self.n - np.array(self.left, object if y.dtype == object else np.int64)
        return (off * off).sum(1)

    def identity_error(self) -> float:
        """The largest absolute entry of the whitened rows' covariance minus the identity, measured on all rows."""
        k = len(self.eigenvalues)
        if not k:
            return 0.0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k + 1, k))
            for b in batches:
                w = self.whitened(integers(b, self.length)[1])
                total += np.vstack([w.T @ w, w.sum(0)])
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "total"])

        total = np.zeros((k + 1, k))
        for r in self._rows("embedding").mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
            total[r["i"], r["j"]] = r["total"]
        mean = total[k] / self.n
        return float(np.abs(total[:k] / self.n - np.outer(mean, mean) - np.eye(k)).max())

    def _rows(self, *columns: str) -> DataFrame:
        return self.vectors.select(*columns)

    def rows(self) -> DataFrame:
        """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact: a row for each vector and component."""
        k, error = len(self.eigenvalues), self.identity_error()
        explained = self.eigenvalues / self.trace if k else self.eigenvalues
        schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
        if not k:
            return self.vectors.sparkSession.createDataFrame([], schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows, x = integers(b, self.length)
                if not len(rows):
                    continue
                deviation, each = self.deviations(x), np.repeat(np.arange(len(rows)), k)
                fits = np.array([d < 1 << 63 for d in deviation.tolist()])
                exact = pa.array([Decimal(d) if d < 10**38 else None for d in deviation.tolist()], _DECIMAL)
                short = pa.array(np.where(fits, deviation, 0).astype(np.int64), pa.int64(), mask=~fits)
                m = len(each)
                yield pa.RecordBatch.from_arrays([
                    b.column("vec_id").take(pa.array(rows[each])), pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()), pa.array(np.full(m, self.n, np.int64)), short.take(pa.array(each)),
                    pa.array(self.whitened(x).ravel()), pa.array(np.tile(explained, len(rows))), pa.array(np.full(m, error)), exact.take(pa.array(each)),
                ], [c.split()[0] for c in schema.split(", ")])

        return self._rows("vec_id", "embedding").mapInArrow(run, schema)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "vectors"}  # tasks need the numbers only


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """The leading whitened components of vectors (vec_id, embedding), fitted on all of them."""
    return Whitening(vectors, components).rows()


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_embedding_whitening": op13_embedding_whitening}
#: Eigenvectors have no SQL; tests compare with a full eigendecomposition.
ORACLE_SQL: dict[str, str] = {}
