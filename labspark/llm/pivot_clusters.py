"""Centroid clustering in exact integers, with a pivot table that spares distances.

Each vector's distances to fixed pivots are stored once, beside the vector.  In every round the centroids'
distances to the same pivots are computed; by the triangle inequality the difference of two such distances is
at most the distance between vector and centroid, so the largest difference over all pivots is a lower bound.
Only centroids whose bound does not exceed the best distance found get their exact integer distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labspark.llm.storage import written

#: Components of smaller size have squared distances that 64 bits hold; others are computed in Python's integers.
SAFE = 1 << 27
LONG = (1 << 63) - 1
_LIMB = 30


def to_grid(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, as 64-bit integers, or as Python's where those could overflow."""
    y = np.floor(x * scale)
    if not y.size or np.abs(y).max() < SAFE:
        return y.astype(np.int64)
    whole = [[int(b) if abs(b) < 2.0**53 else int(a) * scale for a, b in zip(r, s, strict=True)] for r, s in zip(x.tolist(), y.tolist(), strict=True)]
    return np.array(whole, object)


def squared(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of points to one centre."""
    gap = points - centre
    return (gap * gap).sum(axis=1)


def pivot_distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of every point to every pivot, as doubles; zeros where the integers exceed 64 bits."""
    if points.dtype == object or pivots.dtype == object:
        return np.zeros((len(points), len(pivots)))
    return np.sqrt(np.stack([squared(points, p) for p in pivots], axis=1).astype(np.float64)) if len(points) else np.zeros((0, len(pivots)))


def nearest(points: np.ndarray, stored: np.ndarray, centres: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centre, its exact squared distance) of each point, and how many distances were computed.

    ``stored`` has each point's distances to ``pivots``.  The smaller number wins a tie.
    """
    exact = points.dtype == object or centres.dtype == object or pivots.dtype == object
    if exact:
        points = points.astype(object)
    bound = np.zeros((len(points), len(centres)))
    if not exact:
        own = pivot_distances(centres, pivots)
        for c, distances in enumerate(own):
            # The slack is thousands of times the rounding error of the two square roots.
            bound[:, c] = np.maximum(0.0, (np.abs(stored - distances) - 1e-12 * (stored + distances)).max(axis=1)) ** 2
    cluster = bound.argmin(axis=1)
    best = np.zeros(len(points), points.dtype)
    computed = len(points)
    for c in range(len(centres)):
        rows = np.flatnonzero(cluster == c)
        best[rows] = squared(points[rows], centres[c])
    first = cluster.copy()
    for c in range(len(centres)):
        possible = first != c
        if not exact:
            possible &= bound[:, c] <= best.astype(np.float64)
        rows = np.flatnonzero(possible)
        computed += len(rows)
        found = squared(points[rows], centres[c])
        closer = ((found < best[rows]) | ((found == best[rows]) & (c < cluster[rows]))).astype(bool)
        best[rows[closer]], cluster[rows[closer]] = found[closer], c
    return cluster, best, computed


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of an integer of any size in base 2^30, which Spark can sum; the last digit has the sign."""
    place = 0
    while value not in (0, -1):
        yield place, value & ((1 << _LIMB) - 1)
        value >>= _LIMB
        place += 1
    if value:
        yield place, -1


def _vectors(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _sums(table: DataFrame, centres: np.ndarray, pivots: np.ndarray, scale: int) -> dict[int, list[int]]:
    """Size and componentwise sum of each cluster: a few rows per task, summed by Spark."""
    width = centres.shape[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[int]] = {}
        for batch in batches:
            points = to_grid(_vectors(batch, "x", width), scale)
            cluster, _, _ = nearest(points, _vectors(batch, "stored", len(pivots)), centres, pivots)
            for c in np.unique(cluster).tolist():
                inside = points[cluster == c]
                new = [len(inside), *map(int, inside.sum(axis=0))]
                sums[c] = [a + b for a, b in zip(sums[c], new, strict=True)] if c in sums else new
        rows = [(c, at, place, digit) for c, values in sums.items() for at, v in enumerate(values) for place, digit in _limbs(v)]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["cluster", "at", "place", "digit"])

    rows = table.mapInArrow(partial, "cluster int, at int, place int, digit long").groupBy("cluster", "at", "place").agg(F.sum("digit").alias("digit"))
    total: dict[int, list[int]] = {}
    for r in rows.collect():  # at most centroids x (components + 1) x a few digits
        total.setdefault(r.cluster, [0] * (width + 1))[r.at] += r.digit << (_LIMB * r.place)
    return total


def _start(spark: SparkSession, kept: DataFrame, number: int, salt: str) -> list[list[float]]:
    key = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    return [list(r.x) for r in kept.orderBy(key.asc_nulls_last(), "x").limit(number).select("x").collect()]


def exact_clusters(
    vectors: DataFrame,
    centroids: int = 8,
    rounds: int = 10,
    width: int = 64,
    scale: int = 1024,
    pivots: int = 16,
    salt: str = "3:",
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept row of ``vectors``.

    ``vectors`` (vec_id, embedding); other columns are ignored.  Rows are kept whose embedding has exactly
    ``width`` components, none null or non-finite; the others, and an empty table, give no rows.  The first
    centroids and the pivots are the kept rows with the smallest hash of ``salt`` and vec_id; rows without
    vec_id come last there and take part like all others.  Rows that repeat a vec_id are vectors of their
    own.  With fewer rows than ``centroids`` there are as many centroids as rows.  Ties go to the smaller
    number, and an empty cluster keeps its centroid.  A squared distance or inertia beyond 64 bits is null;
    the clusters are exact all the same.
    """
    spark = vectors.sparkSession
    floats = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    x = F.col("embedding") if floats else F.col("embedding").cast("array<double>")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(
        f"size(x) = {width} and forall(x, v -> v is not null and not isnan(v) and abs(v) < double('Infinity'))"
    )
    starts = _start(spark, kept, max(centroids, pivots), salt)
    if not starts:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    grid = to_grid(np.array(starts, np.float64), scale)
    centres, fixed = grid[:centroids].copy(), grid[:pivots]

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distances = pivot_distances(to_grid(_vectors(batch, "x", width), scale), fixed)
            lists = pa.ListArray.from_arrays(np.arange(0, distances.size + 1, len(fixed), dtype=np.int32), distances.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), lists], names=["vec_id", "x", "stored"])

    kind = "float" if floats else "double"
    table = written(kept.mapInArrow(stored, f"vec_id long, x array<{kind}>, stored array<double>"), "pivots")
    for _ in range(rounds):
        rows = centres.tolist()
        for c, (size, *sums) in _sums(table, centres, fixed, scale).items():
            rows[c] = [s // size for s in sums]
        small = max(abs(v) for r in rows for v in r) < SAFE
        centres = np.array(rows, np.int64 if small else object)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = to_grid(_vectors(batch, "x", width), scale)
            cluster, best, _ = nearest(points, _vectors(batch, "stored", len(fixed)), centres, fixed)
            distance = pa.array([d if d <= LONG else None for d in best.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), distance], names=["vec_id", "cluster", "distance"])

    out = written(table.mapInArrow(assigned, "vec_id long, cluster int, distance long"), "clusters")
    inertia = {
        r.cluster: int(r.total) if r.known == r.n else None
        for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.count("distance").alias("known"), F.count("*").alias("n")).collect()
    }

    def held(value: int | None) -> int | None:
        return value if value is not None and value <= LONG else None

    whole = held(None if None in inertia.values() else sum(inertia.values()))
    facts = [
        (c, held(inertia[c]), whole, hashlib.sha256(",".join(map(str, centres[c].tolist())).encode()).hexdigest())
        for c in sorted(inertia)
    ]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(centroids: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, salt: str = "3:") -> str:
    """The same in SQL by all distances, for ``embeddings`` with unique ids and components of usual size."""
    ctes = [
        f"""q AS MATERIALIZED (SELECT vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
        WHERE len(embedding) = {width} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        "flat AS MATERIALIZED (SELECT vec_id, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM q)",
        f"""c0 AS MATERIALIZED (SELECT n AS cluster, i, x FROM flat JOIN
        (SELECT vec_id, row_number() OVER (ORDER BY sha256('{salt}' || vec_id)) - 1 AS n FROM q) USING (vec_id) WHERE n < {centroids})""",
    ]
    for r in range(rounds + 1):
        ctes.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, cluster, d FROM (SELECT f.vec_id, c.cluster, CAST(sum((f.x - c.x) * (f.x - c.x)) AS BIGINT) AS d,
        row_number() OVER (PARTITION BY f.vec_id ORDER BY sum((f.x - c.x) * (f.x - c.x)), c.cluster) AS place FROM flat f JOIN c{r} c ON f.i = c.i GROUP BY f.vec_id, c.cluster) WHERE place = 1)""")
        if r < rounds:
            ctes.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.cluster, c.i, CAST(coalesce((s - ((s % n) + n) % n) // n, c.x) AS BIGINT) AS x FROM c{r} c LEFT JOIN
        (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM a{r} JOIN flat USING (vec_id) GROUP BY cluster, i) m ON c.cluster = m.cluster AND c.i = m.i)""")
    return f"""WITH {", ".join(ctes)},
    named AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
    SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
           CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{rounds} JOIN named USING (cluster)"""
