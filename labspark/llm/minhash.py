"""Near duplicates by bottom-k sketches of word shingles.

Every document keeps the ``SKETCH`` smallest hashes of its shingle set (one hash function).  Inverted lists
of the ``INDEXED`` smallest of them propose pairs, the union sketch of two documents estimates their
similarity, and pairs that may reach the threshold are confirmed on the full sets.

Completeness.  Two sets with the least similarity asked for share that part less ``SLACK`` of their
``INDEXED`` smallest hashes with probability above 1 - 1e-5.  A document therefore enters only the lists of its
rarest values, just so many that a pair sharing that many of them must meet in one (prefix rule).  A list links its members to the member
with most shared values, so a group of copies costs one link per copy and never all its pairs.

Lists whose members are then still in different components go on exactly: the full sets of their documents
are indexed by their rarest shingles, again linked to one member first, and only then are members of
different components compared, if the shingles that no other such document has leave the threshold within
reach.  The estimate's margin is more than five standard deviations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labspark.llm.graph import components
from labspark.llm.storage import written
from labspark.llm.words import shingle_set

SKETCH = 64
INDEXED = 32
SLACK = 35  # per cent
MARGIN = 0.25


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Documents whose shingle sets have ``100 * intersection >= percent * union`` are linked; a component is
    named by its smallest doc_id, which alone has ``kept``.  ``percent`` must be 80 or more.  Null and
    wordless texts have no shingles and are linked with nothing.  Rows that repeat a doc_id are one
    document with several texts.  Rows without doc_id have a null component and stay.  Other columns are
    ignored.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent is between 80 and 100")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = written(docs.mapInArrow(_sketcher(shingle), _SKETCH_SCHEMA), "sketches")
    classes = written(
        sketches.where("signature is not null and doc_id is not null")
        .groupBy("signature")
        .agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min_by("sketch", "doc_id").alias("sketch")),
        "classes",
    )
    lists = written(_inverted_lists(classes, percent), "lists")
    # All later steps look at documents of the lists only, so the texts of the rest are moved at most once.
    texts = written(docs.join(lists.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), "texts")
    heads = lists.groupBy("value").agg(F.max_by("rep", F.struct("shared", -F.col("rep"))).alias("head"))
    near = _links(_pairs(lists.join(heads, "value").select(F.col("rep").alias("a"), F.col("head").alias("b"))), classes, texts, shingle, percent)

    named = _with_component(lists, components(near))
    open_lists = named.groupBy("value").agg(F.max("component").alias("top"), F.min("component").alias("low")).where("top != low")
    core = named.join(open_lists, "value", "left_semi").select("rep").distinct()
    exact = written(_rarest_shingles(texts.join(core.toDF("doc_id"), "doc_id", "left_semi"), shingle, percent), "exact")
    heads = exact.groupBy("value").agg(F.min(F.struct("alone", "rep", "n")).alias("h"))
    members = exact.join(heads, "value").select("rep", "n", "alone", F.col("h.rep").alias("b"), F.col("h.n").alias("m"), F.col("h.alone").alias("free"))
    near = near.union(_links(_pairs(members.where(_reachable(percent)).select(F.col("rep").alias("a"), "b")), classes, texts, shingle, percent))

    named = _with_component(exact, components(near))
    mixed = (
        named.groupBy("value")
        .agg(F.min_by("component", F.struct("alone", "rep")).alias("main"), F.max("component").alias("top"), F.min("component").alias("low"))
        .where("top != low")
        .select("value", "main")
    )
    named = written(named.join(mixed, "value"), "mixed")
    other = named.select("value", *(F.col(c).alias(d) for c, d in (("rep", "b"), ("n", "m"), ("alone", "free"), ("at", "place"), ("component", "with"))))
    across = named.where("component != main").join(other, "value").where("component != with").where(_reachable(percent))
    # The first shingle that both lists hold bounds what can follow.
    across = across.where(f"100 * least(n - at, m - place) >= {percent} * (n + m - least(n - at, m - place))")
    near = near.union(_links(_pairs(across.select(F.col("rep").alias("a"), "b")), classes, texts, shingle, percent))
    found = components(near)

    reps = sketches.select("doc_id", "n_shingles", "signature").join(classes.select("signature", "rep"), "signature", "left")
    # Rows that repeat a doc_id with another text tie their classes together.
    return (
        reps.join(found, reps["rep"] == found["node"], "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


_SKETCH_SCHEMA = "doc_id long, n_shingles long, signature binary, sketch binary"


def _sketcher(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, signatures, sketches = [], [], []
            for text in batch.column("text"):
                hashes = shingle_set(text.as_py(), shingle)
                counts.append(len(hashes))
                signatures.append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
                sketches.append(hashes[:SKETCH].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(signatures, pa.binary()), pa.array(sketches, pa.binary())],
                ["doc_id", "n_shingles", "signature", "sketch"],
            )

    return run


def _with_component(lists: DataFrame, found: DataFrame) -> DataFrame:
    return lists.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _reachable(percent: int) -> str:
    """Whether the shingles that each of two sets has alone leave the threshold within reach."""
    common = "least(n - alone, m - free)"
    return f"100 * {common} >= {percent} * (n + m - {common})"


def _rarest_shingles(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(value, rep, n, alone, at): each document under the rarest shingles of its full set.

    ``alone`` counts its shingles that no other of ``docs`` has, ``at`` is the shingle's place by rarity.  Two
    sets that reach the threshold share one of their first ``n - ceil(n * percent / 100) + 1`` shingles.
    """

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                hashes = shingle_set(text.as_py(), shingle).view(np.int64)
                rep, n = np.full(len(hashes), doc.as_py(), np.int64), np.full(len(hashes), len(hashes), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(rep), pa.array(n)], ["value", "rep", "n"])

    rows = docs.mapInArrow(flat, "value long, rep long, n long")
    frequent = rows.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    shared = rows.join(frequent, "value").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("values"))
    places = F.expr(f"n - (n * {percent} + 99) div 100 + 1 - (n - size(values))").cast("int")
    return (
        shared.where(places > 0)
        .select("rep", "n", (F.col("n") - F.size("values")).alias("alone"), F.posexplode(F.slice("values", F.lit(1), places)).alias("at", "x"))
        .select(F.col("x.value").alias("value"), "rep", "n", "alone", (F.col("at") + F.col("alone")).alias("at"))
    )


def _inverted_lists(classes: DataFrame, percent: int) -> DataFrame:
    """(value, rep, shared): each class under its rarest retained values, values of one class left out.

    ``shared`` counts the class's retained values that other classes have.
    """

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = [np.frombuffer(x.as_py(), np.int64)[:INDEXED] for x in batch.column("sketch")]
            sizes = np.array([len(x) for x in sketches], np.int64)
            rows = np.repeat(np.arange(len(sizes)), sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(sketches) if sketches else np.empty(0, np.int64)),
                    batch.column("rep").take(pa.array(rows)),
                    pa.array(sizes[rows]),
                ],
                ["value", "rep", "held"],
            )

    flat = classes.select("rep", "sketch").mapInArrow(values, "value long, rep long, held long")
    frequent = flat.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    shared = flat.join(frequent, "value").groupBy("rep", "held").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("values"))
    # Values of no other class come first in the order of rarity and count as taken.
    places = F.expr(f"held - greatest(1, held * {percent - SLACK} div 100) + 1 - (held - size(values))").cast("int")
    return (
        shared.where(places > 0)
        .select("rep", F.size("values").alias("shared"), F.explode(F.slice("values", F.lit(1), places)).alias("x"))
        .select(F.col("x.value").alias("value"), "rep", "shared")
    )


def _pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold on their full sets."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                _estimate(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) >= percent / 100 - MARGIN
                for x, y in zip(batch.column("x"), batch.column("y"), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py(), shingle).tobytes() for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.large_binary())], ["doc_id", "hashes"])

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    size = classes.select("rep", "n", "sketch")
    compared = (
        pairs.join(size.toDF("a", "n", "x"), "a").join(size.toDF("b", "m", "y"), "b").where(f"100 * least(n, m) >= {percent} * greatest(n, m)")
    )
    hopeful = written(compared.select("a", "b", "x", "y").mapInArrow(likely, "a long, b long"), "hopeful")
    needed = hopeful.select(F.col("a").alias("doc_id")).union(hopeful.select("b")).distinct()
    sets = written(docs.join(needed, "doc_id", "left_semi").mapInArrow(full, "doc_id long, hashes binary"), "sets")
    both = hopeful.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return written(both.select("a", "b", "x", "y").mapInArrow(reach, "a long, b long").distinct(), "links")


def _estimate(x: np.ndarray, y: np.ndarray) -> float:
    """Similarity of two sets from the bottom of their union; exact where both sketches hold their whole set."""
    union = np.unique(np.concatenate([x, y]))
    whole = len(x) < SKETCH and len(y) < SKETCH
    bottom = union if whole else union[: min(SKETCH, max(len(x), len(y)))]
    common = np.intersect1d(x, y, assume_unique=True)
    return np.searchsorted(common, bottom[-1], side="right") / len(bottom)
