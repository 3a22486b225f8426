"""Centroid clustering of integer vectors, filtered by N-simplex projection.

Vectors of exactly ``dim`` finite components become integers,
floor(``scale`` * x).  The rounds are Lloyd's, in integers throughout: every
vector goes to its nearest centroid (squared Euclidean distance, ties to the
smaller number), every centroid that has vectors moves to the componentwise
floor of their mean, an empty one stays.

Most of the comparisons are spared by an N-simplex projection.  A few of the
vectors are pivots; the simplex that they span is laid out once from the
distances between them.  The distances of a vector to the pivots place it as the
apex of a simplex over that base: its coordinates in the base and its altitude.
They are computed once and stored beside the vector.  Of two apexes the distance
is a lower bound of the true one, and with one altitude turned over an upper
bound.  A centroid whose lower bound exceeds the least upper bound cannot be the
nearest; where one is left it is taken unseen, and where several are left they
are compared exactly, as integers.  The bounds are loosened by more than the
error of their floating-point numbers, so a filter never decides a tie.

At scale: one narrow table (vector and apex) is written, and each round is one
scan of it whose tasks return sums per centroid; what reaches the driver is
``k`` centroids and the sums per centroid and component, whatever the input.
Sums travel in digits of 40 bits, so they never overflow.

Defined results: a vector of another length, NULL, or with a NULL, NaN or
infinite component is left out; a NULL id is written as an empty text in the
hash that orders the first centroids, equal hashes (repeated ids) are ordered
by their vectors, and repeated rows are vectors like any other; with fewer
vectors than ``k`` there are as many centroids as vectors; an empty table gives
an empty result.  Components of any finite size are compared exactly; a distance
or inertia that no long can hold is NULL.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship_package, written

DIM, SCALE, CLUSTERS, ROUNDS = 64, 1024, 8, 10
#: Vectors that serve as pivots, those that come first in hash order.
PIVOTS = 16
#: Integers up to this size have squared distances that fit in 64 bits.
NARROW = 1 << 27
#: A pivot that would make the base's matrix worse conditioned is not used.
CONDITION = 1e4
DIGIT = 40
LONG = (1 << 63) - 1


def to_integer(x: float, scale: int) -> int:
    """floor(scale * x) for any finite x."""
    return math.floor(scale * x) if abs(x) < 2.0 ** 900 else int(x) * scale


def digits(value: int) -> list[int]:
    """``value`` in digits of DIGIT bits, the last one signed."""
    out = []
    while not -(1 << DIGIT) <= value < 1 << DIGIT:
        out.append(value & (1 << DIGIT) - 1)
        value >>= DIGIT
    return [*out, value]


class Simplex:
    """The base that the pivots span, and apexes over it."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots[:1]
        self.base = np.zeros((0, 0))  # coordinates of the pivots after the first, lower triangle
        for p in pivots[1:]:
            apex = self.apex(self.distances(p[None]))[0]
            n = len(self.base)
            base = np.zeros((n + 1, n + 1))
            base[:n, :n], base[n] = self.base, apex
            if apex[-1] > 0 and np.linalg.cond(base) <= CONDITION:
                self.pivots, self.base = np.vstack([self.pivots, p]), base
        self.least = np.linalg.svd(self.base, compute_uv=False).min() if len(self.base) else 1.0
        self.reach = np.linalg.norm(self.base, axis=1).max() if len(self.base) else 0.0

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in self.pivots], axis=1)

    def apex(self, d: np.ndarray) -> np.ndarray:
        """Coordinates in the base, then the altitude, from distances to the pivots."""
        first = d[:, 0] ** 2
        coordinates = np.zeros((len(d), len(self.base)))
        for i, v in enumerate(self.base):  # forward substitution
            inner = (first + v @ v - d[:, i + 1] ** 2) / 2
            coordinates[:, i] = (inner - coordinates[:, :i] @ v[:i]) / v[i]
        altitude = np.sqrt(np.maximum(first - (coordinates ** 2).sum(1), 0))
        return np.column_stack([coordinates, altitude])

    def may_be_nearest(self, apex: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """Which centroids (columns) the bounds leave to each vector (rows), both
        given by their apexes."""
        flat = (apex[:, None, :-1] - centroids[None, :, :-1]) ** 2
        base = flat.sum(2)
        low = base + (apex[:, None, -1] - centroids[None, :, -1]) ** 2
        high = base + (apex[:, None, -1] + centroids[None, :, -1]) ** 2
        size = np.maximum(np.sqrt((apex ** 2).sum(1)),
                          max(np.sqrt((centroids ** 2).sum(1)).max(), self.reach))
        # error of a coordinate: n eps D^2 / least; of an altitude, its root times sqrt(D)
        error = size ** 2 * np.sqrt(
            256 * len(self.pivots) * np.finfo(float).eps * np.maximum(size / self.least, 1))
        return low <= (high.min(1) + error)[:, None]


@dataclass
class Centroids:
    """What a task needs to assign vectors: the centroids and the projection."""
    values: list[list[int]]
    simplex: Simplex
    scale: int
    array: np.ndarray | None = field(default=None)
    apexes: np.ndarray | None = field(default=None)

    def __post_init__(self):
        if all(abs(c) <= NARROW for v in self.values for c in v):
            self.array = np.array(self.values, np.int64)
            self.apexes = self.simplex.apex(self.simplex.distances(self.array.astype(float)))

    def _exact(self, vector: list[int]) -> tuple[int, int]:
        d, c = min((sum((a - b) ** 2 for a, b in zip(vector, v)), i)
                   for i, v in enumerate(self.values))
        return c, d

    def assign(self, x: np.ndarray, apex: np.ndarray, measure: bool):
        """(rows, clusters, distances, integers) for narrow vectors at once, then
        the same for each of the others.  Distances only if ``measure``."""
        narrow = np.abs(x).max(1, initial=0) * self.scale < NARROW
        if self.array is None:
            narrow[:] = False
        rows = np.flatnonzero(narrow)
        if len(rows):
            v = np.floor(x[rows] * self.scale).astype(np.int64)
            may = self.simplex.may_be_nearest(apex[rows], self.apexes)
            cluster = may.argmax(1)
            distance = np.zeros(len(rows), np.int64)
            open_ = np.arange(len(rows)) if measure else np.flatnonzero(may.sum(1) > 1)
            best = np.full(len(rows), LONG)
            for c in range(len(self.values)):  # ascending: ties stay with the smaller number
                at = open_[may[open_, c]]
                d = ((v[at] - self.array[c]) ** 2).sum(1)
                closer = d < best[at]
                cluster[at[closer]], best[at[closer]] = c, d[closer]
            if measure:
                distance = best
            yield rows, cluster, distance, v
        for row in np.flatnonzero(~narrow):
            v = [to_integer(c, self.scale) for c in x[row].tolist()]
            c, d = self._exact(v)
            yield [row], [c], [d], [v]


def _whole(batch: pa.RecordBatch, dim: int) -> pa.RecordBatch:
    """The rows whose vector has ``dim`` finite components."""
    batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch["vector"]), dim), False))
    if not batch.num_rows:
        return batch
    flat = batch["vector"].flatten()
    good = pc.fill_null(pc.is_finite(flat), False).to_numpy(zero_copy_only=False)
    return batch.filter(pa.array(good.reshape(-1, dim).all(1)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def vectors(table: DataFrame, dim: int = DIM, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """vec_id, vector of the rows that are clustered."""
    kind = table.schema[vector_col].dataType
    exact = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    kind = "array<float>" if exact else "array<double>"

    def run(batches):
        for batch in batches:
            yield _whole(batch, dim)

    ship_package(table.sparkSession)
    return table.select(F.col(id_col).cast("long").alias("vec_id"),
                        F.col(vector_col).cast(kind).alias("vector")) \
        .mapInArrow(run, f"vec_id long, vector {kind}")


def in_hash_order(kept: DataFrame, n: int, salt: str = "3:") -> list[list[float]]:
    """The ``n`` vectors whose ids have the smallest hashes."""
    name = F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    return [r["vector"] for r in
            kept.orderBy(F.sha2(name.cast("binary"), 256), "vector").limit(n).collect()]


def projected(kept: DataFrame, simplex: Simplex, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """``kept`` with the apex of each vector."""
    schema = T.StructType([*kept.schema.fields, T.StructField("apex", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.clip(np.floor(_matrix(batch["vector"], dim) * scale), -NARROW, NARROW)
                apex = simplex.apex(simplex.distances(x))
                yield pa.RecordBatch.from_arrays(
                    [batch["vec_id"], batch["vector"], pa.ListArray.from_arrays(
                        np.arange(len(apex) + 1, dtype=np.int32) * apex.shape[1], apex.reshape(-1))],
                    ["vec_id", "vector", "apex"])

    return kept.mapInArrow(run, schema)


def _moved(points: DataFrame, now: Centroids, dim: int) -> list[list[int]]:
    """The centroids after one round."""
    width = len(now.simplex.pivots)

    def run(batches):
        total = [[0] * (dim + 1) for _ in now.values]  # the last is the count
        for batch in batches:
            if not batch.num_rows:
                continue
            x, apex = _matrix(batch["vector"], dim), _matrix(batch["apex"], width)
            for _, cluster, _, v in now.assign(x, apex, measure=False):
                for c in set(np.asarray(cluster).tolist()):
                    if isinstance(v, np.ndarray):
                        mine = v[cluster == c]
                        some, n = mine.sum(0).tolist(), len(mine)
                    else:
                        some, n = v[0], 1
                    total[c] = [a + b for a, b in zip(total[c], [*some, n])]
        rows = [(c, part, place, digit) for c, sums in enumerate(total)
                for part, value in enumerate(sums) if value
                for place, digit in enumerate(digits(value))]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(col, pa.int32()) for col in list(zip(*rows))[:3]],
                 pa.array([r[3] for r in rows], pa.int64())], ["cluster", "part", "place", "digit"])

    sums = [[0] * (dim + 1) for _ in now.values]
    # centroids x components x digits rows
    for r in points.mapInArrow(run, "cluster int, part int, place int, digit long") \
            .groupBy("cluster", "part", "place").agg(F.sum("digit").alias("digit")).collect():
        sums[r["cluster"]][r["part"]] += r["digit"] << (DIGIT * r["place"])
    return [[s // row[-1] for s in row[:-1]] if row[-1] else old
            for row, old in zip(sums, now.values)]


def _assigned(points: DataFrame, now: Centroids, dim: int) -> DataFrame:
    width = len(now.simplex.pivots)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cluster, distance = np.zeros(batch.num_rows, np.int32), [None] * batch.num_rows
            for rows, c, d, _ in now.assign(_matrix(batch["vector"], dim),
                                            _matrix(batch["apex"], width), measure=True):
                cluster[rows] = c
                for row, value in zip(np.asarray(rows).tolist(), np.asarray(d).tolist()):
                    distance[row] = value if value <= LONG else None
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], pa.array(cluster), pa.array(distance, pa.int64())],
                ["vec_id", "cluster", "distance"])

    return points.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(table: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM,
            scale: int = SCALE, pivots: int = PIVOTS, id_col: str = "vec_id",
            vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance of every vector; the final centroids)."""
    kept = vectors(table, dim, id_col, vector_col)
    first = in_hash_order(kept, max(k, pivots))
    values = [[to_integer(c, scale) for c in v] for v in first]
    if not values:
        return table.sparkSession.createDataFrame(
            [], "vec_id long, cluster int, distance long"), []
    narrow = [v for v in values[:pivots] if all(abs(c) <= NARROW for c in v)]
    simplex = Simplex(np.array(narrow or [[0] * dim], float))
    points = written(projected(kept, simplex, dim, scale), "points")
    values = values[:k]
    for _ in range(rounds):
        moved = _moved(points, Centroids(values, simplex, scale), dim)
        if moved == values:  # every further round would repeat this one
            break
        values = moved
    return _assigned(points, Centroids(values, simplex, scale), dim), values


def cluster_report(table: DataFrame, **options) -> DataFrame:
    """Every vector: vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256."""
    spark = table.sparkSession
    found, values = cluster(table, **options)
    found = written(found, "clustered")
    wide = F.col("distance").cast("decimal(38,0)")
    # one row a centroid
    sums = {r["cluster"]: r for r in found.groupBy("cluster").agg(
        F.sum(wide).alias("total"), F.count(F.when(wide.isNull(), 1)).alias("unknown")).collect()}

    def long(rows):
        total = sum(int(r["total"] or 0) for r in rows)
        return total if total <= LONG and not any(r["unknown"] for r in rows) else None

    facts = spark.createDataFrame(
        [(c, long([r]), long(sums.values()),
          hashlib.sha256(",".join(map(str, values[c])).encode()).hexdigest())
         for c, r in sums.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
