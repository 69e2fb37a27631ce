"""Nearest neighbours by inner product: a hierarchical navigable small-world graph for each shard.

Equal vectors are one class, which is indexed once and keeps its smallest ids.  Classes are dealt over shards
of bounded size; each shard's graph is stored as flat neighbour arrays.  Queries go in blocks to every group of shards,
through the shards of a group one after the other, and the groups' results are merged.  Inner products become nearness in a graph as if one more component gave all
indexed vectors the length of the longest; only its differences are computed, in double precision, so that one
very long vector takes no digits from the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labspark.llm.storage import written

SHARD = 4096
QUERY_BLOCK = 512
#: Shards whose graphs a task holds at once.
GROUP = 64
#: Rows with a graph or a block of queries that a Python task takes at once.
BATCH_ROWS = 8
LINKS = 16
BUILD_WIDTH = 64
SEARCH_WIDTH = 96
#: Rows whose links are followed at once for each query.
FOLLOWED = 8
SALTS = 64
SEED = 5


class Graph:
    """Flat neighbour arrays over the rows of ``points``, one array a level; -1 where a row has fewer links."""

    def __init__(self, points: np.ndarray, levels: np.ndarray, links: list[np.ndarray], entry: int, length2: float = 0.0):
        self.points, self.levels, self.links, self.entry = points, levels, links, entry
        self.squares = (points**2).sum(axis=1)
        self.length2 = max(length2, float(self.squares.max(initial=0.0)))

    def _lift(self, rows, row) -> np.ndarray:
        """The product of the further components of points, less the squared length that all share.

        With m = sqrt(length2 - square) it is m * m' - length2, written without the difference of large numbers.
        """
        a, b, whole = self.squares[rows], self.squares[row], self.length2
        below = np.sqrt((whole - a) * (whole - b)) + whole
        return (a * b - whole * (a + b)) / np.where(below > 0, below, 1.0)

    def _nearness(self) -> np.ndarray:
        """The nearness of all rows to each other, ``8 * rows ** 2`` bytes."""
        out, every = np.empty((len(self.points),) * 2), np.arange(len(self.points))
        for k in range(0, len(every), 256):
            rows = every[k : k + 256]
            out[rows] = self.points[rows] @ self.points.T + self._lift(rows[:, None], every[None, :])
        return out

    @classmethod
    def build(cls, points: np.ndarray, length2: float = 0.0) -> Graph:
        """Rows come one after the other, each level for itself, and are linked to spread-out ones of the nearest before them."""
        random = np.random.default_rng(SEED)
        levels = np.minimum(np.floor(-np.log(1 - random.random(len(points))) / np.log(LINKS)), 12).astype(np.int32)
        links = [np.full((len(points), 2 * LINKS if level == 0 else LINKS), -1, np.int32) for level in range(int(levels.max(initial=0)) + 1)]
        graph = cls(points, levels, links, int(levels.argmax()) if len(points) else 0, length2)
        near = graph._nearness()
        for level, mine in enumerate(links):
            most, rows = mine.shape[1], np.nonzero(levels >= level)[0]
            held: dict[int, list[int]] = {}
            for k, row in enumerate(rows.tolist()):
                nearness = near[row, rows[:k]]
                best = np.argpartition(nearness, -BUILD_WIDTH)[-BUILD_WIDTH:] if k > BUILD_WIDTH else np.arange(k)
                held[row] = spread_out(near, row, rows[best], LINKS)
                for other in held[row]:
                    held[other].append(row)
                    if len(held[other]) > 2 * most:  # cut now and then, not with each new link
                        held[other] = spread_out(near, other, np.array(held[other]), most)
            for row, others in held.items():
                others = others if len(others) <= most else spread_out(near, row, np.array(others), most)
                mine[row, : len(others)] = others
        return graph

    def nearest(self, q: np.ndarray, width: int) -> list[int]:
        """About ``width`` rows with a large inner product with ``q``, whose further component is zero."""
        return self.nearest_of(q[None, :], width)[0].tolist()

    def nearest_of(self, queries: np.ndarray, width: int, least: np.ndarray | None = None) -> list[np.ndarray]:
        """The same for each of ``queries``; all go on at the same time, each from its nearest rows whose links were not yet followed.

        A query has none if its inner products with all rows are below its ``least``.
        """
        count, size = len(queries), len(self.points)
        if not size:
            return [np.empty(0, np.int64)] * count
        scores = np.full((count, size + 1), -np.inf)  # the last column is of no row, -1
        scores[:, :size] = queries @ self.points.T
        todo, at = np.arange(count), np.full(count, self.entry)
        if least is not None:
            todo = todo[scores.max(axis=1) >= least]
        for level in range(int(self.levels[self.entry]), 0, -1):
            climbing = todo
            while len(climbing):
                rows = self.links[level][at[climbing]]
                found = scores[climbing[:, None], rows]
                best = found.argmax(axis=1)
                better = found[np.arange(len(best)), best] > scores[climbing, at[climbing]]
                climbing, rows, best = climbing[better], rows[better], best[better]
                at[climbing] = rows[np.arange(len(best)), best]
        seen, place = np.zeros(scores.shape, bool), np.zeros(scores.shape, np.int16)
        seen[:, size], seen[todo, at[todo]] = True, True
        rows, out = np.full((len(todo), width), -1), [np.empty(0, np.int64)] * count
        rows[:, 0] = at[todo]
        best = scores[todo[:, None], rows]
        open_ = rows >= 0
        while len(todo):
            line, mine = np.arange(len(todo))[:, None], todo[:, None]
            value = np.where(open_, best, -np.inf)
            next_ = np.argpartition(value, -min(FOLLOWED, width), axis=1)[:, -min(FOLLOWED, width) :]
            new = self.links[0][np.where(open_[line, next_], rows[line, next_], -1)]
            new[~open_[line, next_]] = -1
            open_[line, next_] = False
            new = new.reshape(len(todo), -1)
            column = np.arange(new.shape[1], dtype=np.int16)
            place[mine, new] = column
            fresh = ~seen[mine, new] & (place[mine, new] == column)  # a row that several are linked to comes once
            seen[mine, new] = True
            rows, open_ = np.hstack([rows, new]), np.hstack([open_, fresh])
            best = np.hstack([best, np.where(fresh, scores[mine, new], -np.inf)])
            keep = np.argpartition(best, -width, axis=1)[:, -width:]
            rows, best, open_ = rows[line, keep], best[line, keep], open_[line, keep]
            on = open_.any(axis=1)
            for k in np.nonzero(~on)[0]:
                out[todo[k]] = rows[k, best[k] > -np.inf]
            todo, rows, best, open_ = todo[on], rows[on], best[on], open_[on]
        return out


def spread_out(near: np.ndarray, row: int, rows: np.ndarray, most: int) -> list[int]:
    """Of ``rows`` those nearer to ``row`` than to any taken before, from near to far; then the nearest others."""
    nearness = near[row, rows]
    order = np.argsort(-nearness, kind="stable")
    rows, nearness = rows[order], nearness[order]
    between = near[rows[:, None], rows]
    free, taken, k = np.ones(len(rows), bool), [], 0
    while len(taken) < most:
        k += int(free[k:].argmax()) if k < len(rows) else 0
        if k == len(rows) or not free[k]:
            break
        taken.append(k)
        free &= between[k] < nearness
        k += 1
    others = np.ones(len(rows), bool)
    others[taken] = False
    return rows[[*taken, *np.nonzero(others)[0][: most - len(taken)].tolist()]].tolist()


def _packed(rows: np.ndarray) -> bytes:
    return np.ascontiguousarray(rows).tobytes()


def _valid(vector: Column) -> Column:
    """Vectors without null or non-finite components and other than zero."""
    whole = F.size(vector) > 0
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & whole & finite & F.exists(vector, lambda x: x != 0)


def classes_of(vectors: DataFrame, most: int) -> DataFrame:
    """(rep, vector, members): the distinct vectors, their smallest id and their ``most`` smallest ids in order.

    Ids are cut to ``most`` in salted parts first, so that a vector of any number of rows is never gathered.
    """
    salted = vectors.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    part = Window.partitionBy("vector", "salt").orderBy("vec_id")
    few = salted.withColumn("at", F.row_number().over(part)).where(F.col("at") <= most)
    parts = few.groupBy("vector", "salt").agg(F.collect_list("vec_id").alias("ids"))
    whole = parts.groupBy("vector").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, most).alias("members"))
    return whole.select(F.col("members")[0].alias("rep"), "vector", "members")


def build_index(classes: DataFrame, shards: int, length2: float) -> DataFrame:
    """(shard, reps, vectors, points, levels, links, entry): the graph of each shard as binary columns.

    ``classes`` (rep, vector); ``length2`` is the largest squared length of a vector.
    """

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep")
        vectors = np.stack(group["vector"].tolist()).astype(np.float64)
        graph = Graph.build(vectors, length2)
        return pd.DataFrame(
            {
                "shard": group["shard"].iloc[:1],
                "reps": [_packed(group["rep"].to_numpy(np.int64))],
                "vectors": [_packed(vectors)],
                "levels": [_packed(graph.levels)],
                "links": [[_packed(x) for x in graph.links]],
                "entry": [graph.entry],
            }
        )

    dealt = classes.select(F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int").alias("shard"), "rep", "vector")
    schema = "shard int, reps binary, vectors binary, levels binary, links array<binary>, entry int"
    return dealt.groupBy("shard").applyInPandas(build, schema)


def _nearest_in(graphs: list[tuple[np.ndarray, Graph]], queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(reps, scores) of about the ``k`` nearest rows of all ``graphs`` for each query, nearest first.

    A query is followed through a graph only if one of its rows is as near as the ``k`` found before it.
    """
    best = [(np.empty(0, np.int64), np.empty(0))] * len(queries)
    lengths, least = np.sqrt((queries**2).sum(axis=1)), np.full(len(queries), -np.inf)
    for reps, graph in graphs:
        rounding = 1e-12 * lengths * np.sqrt(graph.squares.max(initial=0.0))
        for i, near in enumerate(graph.nearest_of(queries, max(SEARCH_WIDTH, 2 * k), least - rounding)):
            if len(near):
                names, scores = np.append(best[i][0], reps[near]), np.append(best[i][1], graph.points[near] @ queries[i])
                first = np.lexsort((names, -scores))[:k]
                best[i] = names[first], scores[first]
                least[i] = scores[first[-1]] if len(first) == k else -np.inf
    return best


def search_index(index: DataFrame, queries: DataFrame, k: int, shards: int) -> DataFrame:
    """(query, rep, score): about the ``k`` nearest classes in each group of shards for each of ``queries`` (rep, vector).

    A task holds the graphs of a group and takes one block of queries after the other.
    """
    groups = max(-(-shards // GROUP), min(shards, 16))
    block = F.pmod(F.xxhash64("rep"), F.ceil(F.lit(max(1, queries.count())) / QUERY_BLOCK))
    blocks = (
        queries.groupBy(block.cast("int").alias("part"))
        .agg(F.collect_list(F.struct("rep", "vector")).alias("queries"))
        .select("part", F.col("queries.rep").alias("q_reps"), F.flatten("queries.vector").alias("q_vectors"))
        .withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, graphs = -1, []
        for batch in batches:
            for row in range(batch.num_rows):
                if batch.column("group")[row].as_py() != group:
                    group, graphs = batch.column("group")[row].as_py(), []
                if not batch.column("q_reps")[row].is_valid:
                    get = {c: batch.column(c)[row].as_py() for c in ("reps", "vectors", "levels", "links", "entry")}
                    reps = np.frombuffer(get["reps"], np.int64)
                    vectors = np.frombuffer(get["vectors"], np.float64).reshape(len(reps), -1)
                    links = [np.frombuffer(x, np.int32).reshape(len(reps), -1) for x in get["links"]]
                    graphs.append((reps, Graph(vectors, np.frombuffer(get["levels"], np.int32), links, get["entry"])))
                    continue
                asked = batch.column("q_reps")[row].values.to_numpy()
                wanted = batch.column("q_vectors")[row].values.to_numpy().reshape(len(asked), -1)
                found = _nearest_in(graphs, wanted, k)
                columns = [np.repeat(asked, [len(reps) for reps, _ in found]), *(np.concatenate(c) for c in zip(*found, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "rep", "score"])

    held = index.withColumn("group", F.pmod("shard", F.lit(groups))).withColumnRenamed("shard", "part")
    dealt = held.unionByName(blocks, allowMissingColumns=True).withColumn("asks", F.col("q_reps").isNotNull())
    ordered = dealt.repartition(groups, "group").sortWithinPartitions("group", "asks", "part")
    return ordered.drop("asks", "part").mapInArrow(run, "query long, rep long, score double")


def nearest_neighbours(vectors: DataFrame, k: int = 20, every: int = 20, dimensions: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with largest inner product for each query.

    ``vectors`` (vec_id, embedding); the rows whose vec_id is divisible by ``every`` are the queries, all other
    rows than the query's own are candidates.  Rows come nearest first, ties by smaller vec_id.  The score is
    exact for the rows found; tests hold their recall against brute force above 0.9, also with lengths that differ
    by factors of thousands.  Vectors that are null,
    empty, zero or hold a null or non-finite component take no part, nor do rows without vec_id and vectors of
    another length than ``dimensions`` (default: the most frequent length, the smaller of equals).  A vec_id
    that occurs in several rows is taken with each of its vectors.  Other columns are ignored.
    """
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    plain = plain.where(F.col("vec_id").isNotNull() & _valid(F.col("vector")))
    if dimensions is None:
        lengths = plain.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
        dimensions = lengths["n"] if lengths else 0
    plain = plain.where(F.size("vector") == dimensions)
    classes = written(classes_of(plain, k + 1), "vector-classes")
    squares = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    size = classes.agg(F.count("*").alias("n"), F.max(squares).alias("length2")).first()
    shards = max(1, -(-size["n"] // SHARD))
    index = written(build_index(classes.select("rep", "vector"), shards, size["length2"] or 0.0), "graphs")

    asked = plain.where(F.col("vec_id") % every == 0)
    asked = written(asked.join(classes.select("rep", "vector"), "vector").select("vec_id", "rep").distinct(), "queries")
    query_classes = classes.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "vector")
    found = written(search_index(index, query_classes, k + 1, shards), "found", BATCH_ROWS)
    first = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    found = found.withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 1)
    members = found.join(classes.select("rep", "members"), "rep").select("query", "score", F.explode("members").alias("vec_id"))
    nearest = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = members.withColumn("at", F.row_number().over(nearest)).where(F.col("at") <= k + 1)
    lists = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("at", "vec_id", "score"))).alias("near"))
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return (
        asked.select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query"))
        .join(lists, "query")
        .select("query_id", F.posexplode(others).alias("rank", "x"))
        .select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
    )
