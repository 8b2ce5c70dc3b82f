"""k-means in whole numbers, with bounds loosened by geometric drift.

Components are floor(`scale` x), so sums, centroids and squared distances are exact. Each round
assigns every vector to its nearest centroid, the smaller number at ties, and then moves every
centroid that has vectors to their componentwise floor(sum / count).

A vector keeps a lower bound on its distance to every centroid but its own. When centroids move, the
bound has to give way by as much as any other centroid may have come nearer. Full drift is the worst
case; but the vectors of a cluster lie in a sphere around its centroid, and how much nearer a moved
centroid comes to any point of a sphere is decided in the plane of the sphere's centre and the
centroid's old and new place (`loosening`). A vector whose exact distance to its own centroid is
below its loosened bound stays without looking at the others; all the rest are scanned exactly. So
bounds spare work and change no result.

Vectors are packed in blocks, one row each, with their bounds and the block's sums, so a round reads
and writes blocks and sends k x (dims + 3) numbers to the driver. A round's table is removed once
the next is written. A hot vector is many rows of many blocks.

Defined cases: vectors of another length or with a null, NaN or infinite component and null vectors
are left out; components must stay under 2^17 in magnitude, or distances would pass 64 bits, and a
larger one is an error. Repeated rows each count and each get a row. Null ids are ids and come last
in the choice of first centroids; equal hashes are ordered by the vector. Fewer than k vectors make
that many clusters, none give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from listwright.llm.base import remove, shared_path, shuffles_dropped

K, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, 3
BLOCK = 4096
#: Magnitudes from which squared distances of 64 components could pass 63 bits.
LIMIT = 1 << 27
#: More than the rounding of a few operations on doubles.
SLACK = 1e-12


@dataclass
class Clustering:
    """Blocks of assigned vectors; final centroids; distances summed by cluster; vectors scanned in each pass."""

    blocks: DataFrame
    id: str
    centroids: list[list[int]]
    inertia: list[int]
    scanned: list[int]

    def rows(self) -> DataFrame:
        """The id, cluster and squared distance of every vector."""
        kind = self.blocks.schema["ids"].dataType.elementType.simpleString()

        def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n in range(batch.num_rows):
                    cluster = np.frombuffer(batch["cluster"][n].as_py(), np.int32)
                    distance = np.frombuffer(batch["distance"][n].as_py(), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [batch["ids"][n].values, pa.array(cluster), pa.array(distance)], ["id", "cluster", "distance"]
                    )

        rows = self.blocks.select("ids", "cluster", "distance").mapInArrow(
            unpacked, f"id {kind}, cluster int, distance bigint"
        )
        return rows.withColumnRenamed("id", self.id)

    def report(self) -> DataFrame:
        """`rows` with cluster_inertia, inertia and the digest of the final centroid."""
        spark = self.blocks.sparkSession
        each = [(n, own, sum(self.inertia), hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest())
                for n, (own, centroid) in enumerate(zip(self.inertia, self.centroids))]
        clusters = spark.createDataFrame(
            each, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        )
        return self.rows().join(F.broadcast(clusters), "cluster")  # one row per cluster


def kept(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE, id: str = "vec_id", values: str = "embedding") -> DataFrame:
    """id and points, the whole numbers of each vector that is complete and finite."""
    found = vectors.select(F.col(id).alias("id"), F.col(values).cast("array<double>").alias("values")).filter(
        (F.size("values") == dims) & F.coalesce(
            F.forall("values", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))), F.lit(False)
        )
    )
    return found.select("id", F.transform("values", lambda x: F.floor(
        F.when(F.abs(x * scale) < LIMIT, x * scale)
        .otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("double"))
    ).cast("int")).alias("points"))


def first_centroids(points: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The k vectors with the smallest hashes of seed and id."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = points.select(mark.alias("mark"), "points").orderBy(F.col("mark").asc_nulls_last(), "points").limit(k)
    return [list(row["points"]) for row in rows.collect()]


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, how much nearer to any of its vectors another centroid can have come.

    Put a centroid's old and new place c and c' at (0, -p/2) and (0, p/2), and the centre of the
    sphere at (x, y), x >= 0. Points that are s p nearer to c' than to c, 0 <= s <= 1, lie above
    one branch of a hyperbola, so above its asymptote, the line through the origin that rises by the
    angle whose sine is s. The largest s that the sphere can hold is that of the line it touches:
    s = (x r + y sqrt(x^2 + y^2 - r^2)) / (x^2 + y^2). A sphere that reaches the axis can hold s = 1;
    where the line would fall, the sphere is wholly on the side of c and nothing in it is nearer.
    """
    k = len(old)
    result = np.zeros(k)
    for j in range(k):
        drift = new[j] - old[j]
        p = math.sqrt(float(drift @ drift))
        if p == 0:
            continue
        for a in range(k):
            if a == j:
                continue
            centre = old[a] - (old[j] + new[j]) / 2
            y = float(centre @ drift) / p
            square = float(centre @ centre)
            x = math.sqrt(max(square - y * y, 0.0))
            r = radius[a]
            # The margin covers the rounding of x and y.
            reach = r + SLACK * (1 + math.sqrt(square)) * 1e3
            if reach >= x:
                s = 1.0
            else:
                s = (x * reach + y * math.sqrt(square - reach * reach)) / square
            result[a] = max(result[a], p * min(max(s, 0.0), 1.0) * (1 + 1e-9))
    return result


def _distances(points: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    apart = points - centroid
    return np.einsum("ij,ij->i", apart, apart)


def _assigned(points: np.ndarray, centroids: np.ndarray, cluster: np.ndarray | None, lower: np.ndarray | None,
              loose: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """cluster, squared distance and lower bound of each point, and how many were scanned."""
    n = len(points)
    if cluster is None:
        cluster, lower, distance = np.zeros(n, np.int32), np.full(n, -1.0), np.zeros(n, np.int64)
        scan = np.arange(n)
    else:
        apart = points - centroids[cluster]
        distance = np.einsum("ij,ij->i", apart, apart)
        lower = lower - loose[cluster]
        scan = np.flatnonzero(np.sqrt(distance.astype(float)) * (1 + SLACK) >= lower * (1 - SLACK) - SLACK)
        cluster = cluster.copy()
    if len(scan):
        every = np.stack([_distances(points[scan], c) for c in centroids])
        best = every.argmin(0)
        cluster[scan], distance[scan] = best, every[best, np.arange(len(scan))]
        every[best, np.arange(len(scan))] = np.iinfo(np.int64).max
        lower[scan] = np.sqrt(every.min(0).astype(float)) * (1 - SLACK)
    return cluster, distance, lower, len(scan)


def _statistics(points: np.ndarray, cluster: np.ndarray, distance: np.ndarray, k: int, scanned: int) -> list[int]:
    """By cluster the sums of components, count and summed distance; then the vectors scanned, and the radii squared."""
    rows, radii = [], []
    for a in range(k):
        own = cluster == a
        rows.append([*points[own].sum(0).tolist(), int(own.sum()), sum(distance[own].tolist())])
        radii.append(int(distance[own].max(initial=0)))
    return [x for row in rows for x in row] + [scanned] + radii


def _blocks(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The first pass: blocks of vectors, each scanned."""
    k = len(centroids)
    kind = points.schema["id"].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                values = batch["points"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                values = values.astype(np.int64)
                yield _row(batch["id"], values, *_assigned(values, centroids, None, None, np.zeros(k)), k)

    return points.mapInArrow(packed, f"ids array<{kind}>, {_COLUMNS}")


_COLUMNS = "points binary, cluster binary, distance binary, lower binary, statistics array<decimal(38,0)>"


def _row(ids: pa.Array, points: np.ndarray, cluster: np.ndarray, distance: np.ndarray, lower: np.ndarray, scanned: int,
         k: int) -> pa.RecordBatch:
    offsets = pa.array([0, len(ids)], pa.int32())
    statistics = _statistics(points, cluster, distance, k, scanned)
    return pa.RecordBatch.from_arrays(
        [pa.ListArray.from_arrays(offsets, ids),
         *(pa.array([x.tobytes()], pa.binary()) for x in (points.astype(np.int32), cluster.astype(np.int32), distance, lower)),
         pa.array([[Decimal(x) for x in statistics]], pa.list_(pa.decimal128(38, 0)))],
        ["ids", "points", "cluster", "distance", "lower", "statistics"],
    )


def _next(blocks: DataFrame, centroids: np.ndarray, loose: np.ndarray) -> DataFrame:
    """Blocks assigned anew to moved centroids."""
    k, dims = centroids.shape
    kind = blocks.schema["ids"].dataType.simpleString()

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                points = np.frombuffer(batch["points"][n].as_py(), np.int32).reshape(-1, dims).astype(np.int64)
                cluster = np.frombuffer(batch["cluster"][n].as_py(), np.int32)
                lower = np.frombuffer(batch["lower"][n].as_py(), float)
                yield _row(batch["ids"][n].values, points, *_assigned(points, centroids, cluster, lower, loose), k)

    return blocks.mapInArrow(moved, f"ids {kind}, {_COLUMNS}")


def _totals(blocks: DataFrame, k: int, dims: int) -> tuple[list[list[int]], list[int], list[int], int, np.ndarray]:
    """Sums of components, counts and summed distances by cluster, the vectors scanned, and the radii."""
    place = F.col("pos")
    found = blocks.select(F.posexplode("statistics")).groupBy("pos").agg(
        F.when(place <= k * (dims + 2), F.sum("col")).otherwise(F.max("col")).alias("x")
    ).orderBy("pos")
    flat = [int(row["x"]) for row in found.collect()]
    rows = [flat[a * (dims + 2):(a + 1) * (dims + 2)] for a in range(k)]
    radius = np.sqrt(np.array(flat[k * (dims + 2) + 1:], float)) * (1 + SLACK)
    return [r[:dims] for r in rows], [r[dims] for r in rows], [r[dims + 1] for r in rows], flat[k * (dims + 2)], radius


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED,
              id: str = "vec_id", values: str = "embedding") -> Clustering:
    """`rounds` rounds of assigning and moving, then a last assignment."""
    spark = vectors.sparkSession
    points = kept(vectors, dims, scale, id, values)
    centroids = np.array(first_centroids(points, k, seed), np.int64).reshape(-1, dims)
    path, scanned = "", []
    with shuffles_dropped(spark):
        for turn in range(rounds + 1):
            made = _blocks(points, centroids) if turn == 0 else _next(blocks, centroids, loose)
            before, path = path, shared_path(spark, "clusters")
            made.write.parquet(path)
            blocks = spark.read.schema(made.schema).parquet(path)
            sums, counts, inertia, seen, radius = _totals(blocks, len(centroids), dims) if len(centroids) else ([], [], [], 0, None)
            scanned.append(seen)
            if before:
                remove(spark, before)
            if turn < rounds and len(centroids):
                old = centroids
                centroids = np.array(
                    [[s // n for s in own] if n else was.tolist() for own, n, was in zip(sums, counts, old)], np.int64
                )
                loose = loosening(old.astype(float), centroids.astype(float), radius)
            elif not len(centroids):
                break
    return Clustering(blocks, id, centroids.tolist(), inertia, scanned)
