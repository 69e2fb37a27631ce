import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from labspark.llm.pivot_clusters import _limbs, exact_clusters, nearest, oracle, pivot_distances, squared

LONG = (1 << 63) - 1


def frame(spark, rows, kind="double"):
    schema = f"vec_id long, embedding array<{kind}>, label int, x string, cluster string, stored string"
    return spark.createDataFrame([(i, v, 1, "x", "c", "s") for i, v in rows], schema).repartition(4)


def brute(rows, width=64, k=8, rounds=10):
    """All distances, in Python's integers."""

    def fits(v):
        return v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)

    def whole(x):
        return math.floor(1024 * x) if abs(x) < 1e15 else 1024 * int(x)

    kept = [(i, [whole(x) for x in v], v) for i, v in rows if fits(v)]

    def key(r):
        return (r[0] is None, "" if r[0] is None else hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[2])

    centres = [v for _, v, _ in sorted(kept, key=key)[:k]]

    def assign():
        out = []
        for _, v, _ in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centres]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        where = assign()
        for c in range(len(centres)):
            inside = [v for (_, v, _), (own, _) in zip(kept, where, strict=True) if own == c]
            if inside:
                centres[c] = [sum(col) // len(inside) for col in zip(*inside, strict=True)]
    where = assign()

    def held(values):
        return None if any(v > LONG for v in values) or sum(values) > LONG else sum(values)

    total = held([d for _, d in where])
    out = []
    for (i, _, _), (c, d) in zip(kept, where, strict=True):
        sha = hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()
        out.append((i, c, held([d]), held([x for own, x in where if own == c]), total, sha))
    return sorted(out, key=str)


def rows_of(n, seed=3, width=64):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(6)]
    return [(i, [m + rng.gauss(0, 0.2) for m in rng.choice(middles)]) for i in range(n)]


def found(df):
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert df.columns == names
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_brute_force_with_odd_rows(spark):
    rows = rows_of(150)
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [1.0] * 63 + [None]), (205, [1.0] * 63 + [math.nan])]
    rows += [(206, [math.inf] + [0.0] * 63), (207, [0.0] * 64), (None, [0.5] * 64), (None, [-0.5] * 64), (5, rows[5][1]), (5, [0.25] * 64)]
    rows += [(300 + i, [1 / 1024] * 64) for i in range(30)]  # copies, and ties between equal centroids
    assert found(exact_clusters(frame(spark, rows))) == brute(rows)


def test_single_precision(spark):
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows_of(60, 4)]
    assert found(exact_clusters(frame(spark, rows, "float"))) == brute(rows)


def test_few_rows_and_none(spark):
    rows = rows_of(3)
    assert found(exact_clusters(frame(spark, rows))) == brute(rows)
    assert exact_clusters(frame(spark, [])).count() == 0
    assert exact_clusters(frame(spark, [(1, [1.0])])).count() == 0
    same = [(i, [0.5] * 64) for i in range(40)]
    got = found(exact_clusters(frame(spark, same)))
    assert got == brute(same) and {r[1] for r in got} == {0}


def test_components_beyond_64_bits(spark):
    rows = rows_of(40) + [(100, [1e300] + [0.0] * 63), (101, [-3e5] * 64), (102, [1e9] * 64)]
    got = found(exact_clusters(frame(spark, rows)))
    assert got == brute(rows) and {r[4] for r in got} <= {None, *(r[4] for r in got)}


def test_sql_equals_brute_force():
    rows = rows_of(80, 9)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings(vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [*rows, (90, [0.0]), (91, None)])
    sql = f"SELECT vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 FROM ({oracle()})"
    assert sorted(con.execute(sql).fetchall(), key=str) == brute(rows)


def test_bounds_spare_distances_and_keep_ties():
    rng = np.random.default_rng(1)
    middles = rng.integers(-900, 900, (8, 64))
    points = middles[rng.integers(0, 8, 3000)] + rng.integers(-50, 50, (3000, 64))
    pivots = points[:16]
    stored = pivot_distances(points, pivots)
    centres = np.concatenate([middles, middles[:1]])  # the last one ties with the first
    cluster, best, computed = nearest(points, stored, centres, pivots)
    every = np.stack([squared(points, c) for c in centres], axis=1)
    assert (cluster == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert computed < every.size / 3


@pytest.mark.parametrize("value", [0, 1, -1, 2**30, -(2**30), 2**90 + 17, -(2**90) - 17, 12345678901234567890])
def test_digits_add_up(value):
    assert sum(d << (30 * place) for place, d in _limbs(value)) == value
