import numpy as np

from labspark.llm.ann import Graph, _nearest_in, nearest_neighbours, spread_out


def brute(ids, vectors, k, every):
    out = {}
    for i in sorted({x for x in ids if x % every == 0}):
        q = vectors[ids.index(i)]
        scores = sorted((-float(v @ q), j) for j, v in zip(ids, vectors, strict=True) if j != i)
        out[i] = [(j, -s) for s, j in scores[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, rep long, shard int").repartition(3)


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_recall_over_shards(spark, monkeypatch):
    import labspark.llm.ann as ann

    monkeypatch.setattr(ann, "SHARD", 500)
    r = np.random.default_rng(1)
    centers = r.normal(size=(30, 24))
    vectors = (centers[r.integers(0, 30, 1400)] + 0.6 * r.normal(size=(1400, 24))).astype(np.float32)
    vectors[100:900] = vectors[99]  # a third and more of all rows are one vector
    ids = [int(x) for x in r.permutation(5000)[:1400]]
    got = found(nearest_neighbours(frame(spark, zip(ids, vectors.tolist(), strict=True))))
    want = brute(ids, vectors.astype(float), 20, 20)
    assert set(got) == set(want)
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    for q, near in got.items():
        assert len(near) == 20 and near == sorted(near, key=lambda x: (-x[1], x[0]))
        for j, s in near:
            assert abs(s - float(vectors[ids.index(j)].astype(float) @ vectors[ids.index(q)].astype(float))) < 1e-9


def recall(spark, vectors):
    ids = list(range(len(vectors)))
    got = found(nearest_neighbours(frame(spark, zip(ids, vectors.tolist(), strict=True))))
    want = brute(ids, vectors.astype(float), 20, 20)
    return sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def test_recall_with_very_long_vectors(spark):
    r = np.random.default_rng(4)
    vectors = r.normal(size=(1200, 32))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    for factor in (10_000, 1e8):
        one = vectors.astype(np.float32)
        one[77] *= factor
        assert recall(spark, one) >= 0.95
    uneven = (vectors * np.exp(r.normal(size=1200) * 3)[:, None]).astype(np.float32)
    assert recall(spark, uneven) >= 0.9


def test_small_tables_ties_and_invalid_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 1.0]), (3, [-1.0, 0.0]), (20, [0.0, 3.0]), (4, None), (5, [0.0, 0.0]), (6, [None, 1.0])]
    rows += [(7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, []), (None, [5.0, 5.0]), (10, [1.0, 2.0, 3.0]), (40, [0.0, 0.0])]
    got = found(nearest_neighbours(frame(spark, rows)))
    assert got == {0: [(2, 2.0), (1, 1.0), (20, 0.0), (3, -1.0)], 20: [(2, 3.0), (0, 0.0), (1, 0.0), (3, 0.0)]}
    assert nearest_neighbours(frame(spark, rows[:1]).where("false")).count() == 0
    assert nearest_neighbours(frame(spark, rows[:1])).count() == 0


def test_graph_arrays_are_symmetric_in_size():
    points = np.random.default_rng(2).normal(size=(300, 8)).astype(np.float32)
    graph = Graph.build(points)
    assert all(x.shape[0] == 300 and x.dtype == np.int32 for x in graph.links)
    assert (graph.links[0] != np.arange(300)[:, None]).all()
    near = graph.nearest(points[7] * 10, 40)
    best = np.argsort(-(points @ points[7]))[:10]
    assert len(set(near) & set(best.tolist())) >= 9


def test_queries_of_a_block_find_what_each_finds_alone():
    r = np.random.default_rng(6)
    centers = r.normal(size=(40, 16)) * 4
    points = centers[r.integers(0, 40, 900)] + 0.3 * r.normal(size=(900, 16))
    queries = centers[r.integers(0, 40, 70)] + 0.3 * r.normal(size=(70, 16))
    graph = Graph.build(points)
    block = graph.nearest_of(queries, 60)
    assert [sorted(x.tolist()) for x in block] == [sorted(graph.nearest(q, 60)) for q in queries]
    assert all(len(x) == len(set(x.tolist())) == 60 for x in block)
    best = [set(np.argsort(-(points @ q))[:20].tolist()) for q in queries]
    assert sum(len(b & set(x.tolist())) for b, x in zip(best, block, strict=True)) >= 0.95 * 20 * 70
    assert [x.tolist() for x in Graph.build(points[:0]).nearest_of(queries[:2], 5)] == [[], []]
    assert [x.tolist() for x in Graph.build(points[:1]).nearest_of(queries[:2], 5)] == [[0], [0]]


def test_nearness_of_all_rows_is_symmetric_and_keeps_digits_beside_a_long_vector():
    points = np.random.default_rng(7).normal(size=(600, 8))
    points[5] *= 1e8
    graph = Graph.build(points)
    near = graph._nearness()
    assert np.allclose(near, near.T)
    # Beside terms of each row alone, it falls with the distance of two rows.
    rows = np.delete(np.arange(600), 5)
    distance = ((points[rows][:, None] - points[rows][None]) ** 2).sum(axis=2)
    own = near[rows, rows]
    assert np.allclose(near[np.ix_(rows, rows)], (own[:, None] + own[None] - distance) / 2, atol=1e-4)


def test_spread_out_takes_rows_nearer_to_the_point_than_to_taken_ones_first():
    r = np.random.default_rng(8)
    for _ in range(20):
        points = r.normal(size=(40, 5))
        near = Graph.build(points)._nearness()
        rows = r.permutation(np.arange(1, 40))[:30]
        order = sorted(rows.tolist(), key=lambda x: -near[0, x])
        wanted = []
        for x in order:
            if len(wanted) < 8 and all(near[x, y] < near[0, x] for y in wanted):
                wanted.append(x)
        wanted += [x for x in order if x not in wanted][: 8 - len(wanted)]
        assert spread_out(near, 0, rows, 8) == wanted


def test_graphs_of_a_group_give_the_nearest_of_all_and_skip_only_farther_rows(monkeypatch):
    r = np.random.default_rng(9)
    points, queries = r.normal(size=(1200, 12)), r.normal(size=(60, 12))
    ids = r.permutation(5000)[:1200]
    graphs = [(ids[k::12], Graph.build(points[k::12])) for k in range(12)]
    followed = []
    nearest_of = Graph.nearest_of

    def counted(*args):
        out = nearest_of(*args)
        followed.append(sum(map(bool, map(len, out))))
        return out

    monkeypatch.setattr(Graph, "nearest_of", counted)
    got = _nearest_in(graphs, queries, 3)
    assert followed[0] == 60 and followed[-1] < 30
    for q, (names, scores) in zip(queries, got, strict=True):
        products = points @ q
        best = np.lexsort((ids, -products))[:3]
        assert names.tolist() == ids[best].tolist() and np.allclose(scores, products[best])


def test_groups_of_shards_give_the_same_rows(spark, monkeypatch):
    import labspark.llm.ann as ann

    r = np.random.default_rng(10)
    vectors = r.normal(size=(900, 16)).astype(np.float32)
    rows = list(zip(range(900), vectors.tolist(), strict=True))
    monkeypatch.setattr(ann, "SHARD", 40)  # 23 shards
    want = found(nearest_neighbours(frame(spark, rows)))
    for group in (1, 5):
        monkeypatch.setattr(ann, "GROUP", group)
        assert found(nearest_neighbours(frame(spark, rows))) == want
    true = brute(list(range(900)), vectors.astype(float), 20, 20)
    assert all([j for j, _ in want[q]] == [j for j, _ in true[q]] for q in true)
