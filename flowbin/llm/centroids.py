"""Integer k-means by PCA-rotated filtering.

A vector is stored once as its integers floor(SCALE * x), its LEAD leading coordinates in the
principal axes of all vectors, and the length of the rest.  The distance in the leading
coordinates plus the squared difference of the two rest lengths is never above the true
distance, so of the centroids only those can be nearest whose bound is not above the exact
distance of one of them.  The survivors are compared in integers.  Every round is one pass
over the stored table; a task hands back a count and a sum for each centroid, which Spark adds
as decimals.  Centroids are the mean of their vectors, rounded down by component, also for
negative sums.

The axes come from MLlib's PCA over all vectors.  They only steer the filter: the bound holds
for any orthogonal axes, and its own rounding is allowed for.

Defined results: vectors that are null, of another length than ``dim``, or hold a null or
non-finite component have no row.  Vectors with a null id take part; they are seeds last.
Repeated rows are vectors of their own; seeds with one hash (one id) go by their components.
Fewer vectors than ``k`` give fewer centroids, an empty table an empty result.  Integers whose
squared distances might not fit a long (beyond 2**27 at 64 components) are computed in Python
integers; a distance beyond a long fails.
An input column with the result's name is replaced.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbin.llm.frames import settle

K = 8
ROUNDS = 10
SCALE = 1024
DIM = 64
LEAD = 12        # leading coordinates that are stored
SEED = "3"       # seeds: the smallest hashes of SEED:id
PART = 4096      # vectors of one matrix product


def _safe(dim: int) -> int:
    """Components below this have squared distances below 2**62, and fit four bytes."""
    return int(2**30 / math.sqrt(max(dim, 1)))


def _integers(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of integers; Python integers where a row of longs would be too narrow."""
    x = np.floor(SCALE * column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim))
    if x.size and np.abs(x).max() >= _safe(dim):
        return np.array([[int(v) for v in row] for row in x], object)
    return x.astype(np.int64)


def _as_lists(ints: np.ndarray) -> pa.Array:
    flat = pa.array([int(v) for v in ints.ravel()], pa.decimal128(38, 0)) if ints.dtype == object else pa.array(ints.ravel()).cast(pa.decimal128(38, 0))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(ints) + 1) * ints.shape[1], pa.int32()), flat)


class Filter:
    """The principal axes, and bounds for vectors in them."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray):
        self.mean, self.axes = mean, axes

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates, and the length of the rest."""
        off = x.astype(np.float64) - self.mean
        lead = off @ self.axes
        return lead, np.sqrt(np.maximum((off * off).sum(axis=1) - (lead * lead).sum(axis=1), 0.0))

    def bounds(self, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """Never above the squared distance of each vector to each centroid."""
        c_lead, c_rest = self.place(centroids)
        near = ((lead[:, None, :] - c_lead[None, :, :]) ** 2).sum(axis=2) + (rest[:, None] - c_rest[None, :]) ** 2
        size = (lead * lead).sum(axis=1) + rest * rest
        c_size = (c_lead * c_lead).sum(axis=1) + c_rest * c_rest
        # the rest lengths come from differences of squares: their rounding goes with the root
        slack = 1e-6 * np.sqrt(np.outer(size + 1, c_size + 1)) + 1e-6 * (size[:, None] + c_size[None, :]) + 1.0
        return near - slack


def exact(ints: np.ndarray, at: np.ndarray, centroids: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Squared distances in integers of some vectors to a centroid each."""
    wide = ints.dtype == object or centroids.dtype == object
    off = ints[at].astype(object if wide else np.int64) - centroids[which]
    return (off * off).sum(axis=1)


def nearest(ints: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, axes: Filter) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid (ties: the smaller) and its distance; how many were compared in integers."""
    bound = axes.bounds(lead, rest, centroids)
    best = bound.argmin(axis=1)
    far = exact(ints, np.arange(len(ints)), centroids, best)
    compared = len(ints)
    for c in range(len(centroids)):
        at = np.flatnonzero((best != c) & (bound[:, c] <= far.astype(np.float64) * (1 + 1e-12)))
        if len(at):
            d = exact(ints, at, centroids, np.full(len(at), c))
            better = (d < far[at]) | ((d == far[at]) & (c < best[at]))
            best[at[better]], far[at[better]] = c, d[better]
            compared += len(at)
    return best, far, compared


_STORED = "node long, wide boolean, ints binary, lead binary, rest double"


def _store(axes: Filter, dim: int):
    """Integers (four bytes each, or as text where they are wide), leading coordinates and rest length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, PART):
                part = batch.slice(begin, PART)
                ints = _integers(part.column("vec"), dim)
                lead, rest = axes.place(ints)
                wide = ints.dtype == object
                rows = [" ".join(map(str, r)).encode() for r in ints] if wide else [r.tobytes() for r in ints.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([wide] * len(ints)), pa.array(rows, pa.binary()),
                                                  pa.array([r.tobytes() for r in lead], pa.binary()), pa.array(rest)], names=["node", "wide", "ints", "lead", "rest"])
    return run


def _load(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    wide = batch.column("wide").to_numpy(zero_copy_only=False)
    for flag in np.unique(wide):
        part = batch.take(pa.array(np.flatnonzero(wide == flag)))
        raw = part.column("ints").to_pylist()
        if flag:
            ints = np.array([[int(v) for v in r.split()] for r in raw], object).reshape(-1, dim)
        else:
            ints = np.frombuffer(b"".join(raw), np.int32).reshape(-1, dim).astype(np.int64)
        lead = np.frombuffer(b"".join(part.column("lead").to_pylist()), np.float64).reshape(len(raw), -1)
        yield part, ints, lead, part.column("rest").to_numpy()


def _sums(centroids: np.ndarray, axes: Filter, dim: int):
    """Of a task, the count and the sum of the vectors of each centroid."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dim), object)
        for batch in batches:
            for _, ints, lead, rest in _load(batch, dim):
                best, _, _ = nearest(ints, lead, rest, centroids, axes)
                for c in np.unique(best):
                    mine = ints[best == c]
                    count[c] += len(mine)
                    total[c] += mine.sum(axis=0).astype(object)
        at = np.flatnonzero(count)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at]), _as_lists(total[at])], names=["cluster", "n", "total"])
    return run


def _assign(centroids: np.ndarray, axes: Filter, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, ints, lead, rest in _load(batch, dim):
                best, far, _ = nearest(ints, lead, rest, centroids, axes)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(best.astype(np.int32)), pa.array([int(d) for d in far], pa.int64())], names=["node", "cluster", "distance"])
    return run


def _narrow(rows: list[list[int]]) -> np.ndarray:
    out = np.array(rows, object)
    return out.astype(np.int64) if all(abs(int(v)) < _safe(out.shape[1]) for v in out.ravel()) else out


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, rounds: int = ROUNDS,
                    dim: int = DIM, lead: int = LEAD, seed: str = SEED, result: str = "clustering") -> DataFrame:
    """The clustered rows of the input with a struct ``result``: cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    names = [c for c in vectors.columns if c != result]
    x = F.col(f"`{vec_col}`")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    fit = vectors.where((F.size(x) == dim) & F.coalesce(fine, F.lit(False)))
    numbered = fit.select(F.monotonically_increasing_id().alias("node"), F.col(f"`{id_col}`").alias("id"), x.alias("vec"),
                          F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c not in (id_col, vec_col)], F.lit(0).alias("fill")).alias("row"))
    rows = settle(numbered)  # written once: the numbers of the rows must not change between jobs
    ints = F.transform("vec", lambda v: F.floor(v.cast("double") * SCALE).cast("double"))
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.col("id").cast("string")), 256)
    seeds = rows.select("vec", digest.alias("h")).orderBy(F.col("h").asc_nulls_last(), "vec").limit(k).collect()
    kinds = {c: vectors.schema[c].dataType for c in names}
    schema = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not seeds:
        empty = F.from_json(F.lit(None).cast("string"), schema)
        return rows.select(*[F.lit(None).cast(kinds[c]).alias(c) for c in names], empty.alias(result)).limit(0)
    centroids = _narrow([[math.floor(SCALE * float(v)) for v in s["vec"]] for s in seeds])
    n, *mean = rows.select(F.count("*"), *[F.avg(F.get(ints, F.lit(i))) for i in range(dim)]).first()
    main = np.eye(dim)[:, : min(lead, dim)]
    if n > 1:  # one vector has no covariance
        main = PCA(k=min(lead, dim), inputCol="v", outputCol="w").fit(rows.select(array_to_vector(ints).alias("v"))).pc.toArray()
    axes = Filter(np.array(mean), np.linalg.qr(main)[0])
    stored = settle(rows.select("node", "vec").mapInArrow(_store(axes, dim), _STORED))
    for _ in range(rounds):
        parts = stored.mapInArrow(_sums(centroids, axes, dim), "cluster int, n long, total array<decimal(38,0)>")
        total = parts.select("cluster", "n", F.posexplode("total").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        new = [list(map(int, c)) for c in centroids]
        for r in total.collect():  # k * dim rows
            new[r["cluster"]][r["i"]] = int(r["s"]) // int(r["n"])
        centroids = _narrow(new)
    found = settle(stored.mapInArrow(_assign(centroids, axes, dim), "node long, cluster int, distance long"))
    per = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    whole = sum(int(r["s"]) for r in per)
    sha = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centroids]
    about = spark.createDataFrame([(r["cluster"], int(r["s"]), whole, sha[r["cluster"]]) for r in per], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = rows.join(found.join(F.broadcast(about), "cluster"), "node")  # k rows are broadcast
    columns = {id_col: F.col("id"), vec_col: F.col("vec")}
    kept = [columns.get(c, F.col(f"row.c{i}")).alias(c) for i, c in enumerate(names)]
    return out.select(*kept, F.struct("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").alias(result))
