"""Toxicity scores by a factorization machine over hashed terms.

A text is the set of its hashed terms: its words and their first letters, as inflected words keep their stem.
Besides a weight for each term the machine learns a short vector for
it, and the inner product of two vectors is the effect of both terms in one text, such as an insult beside
the mention of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labspark.llm.quality import is_held_out
from labspark.llm.words import Memo, plain_words_of

BUCKETS = 1 << 20
FACTORS = 4
#: At most so many labelled rows of each class are learned from, those with the smallest hash of their doc_id.
SAMPLE = 6_000
#: A term is learned if so many sampled texts hold it and its share among toxic texts differs by so many standard errors.
LEAST_TEXTS = 8
LEAST_ERRORS = 4.0
#: Beginnings of words that are terms too, in letters.
STEMS = (4, 5, 6)
EPOCHS = 150
RATE = 0.1
PENALTY = 1e-4
SEED = 7
THRESHOLD = 0.3


def buckets_of(word: bytes) -> list[int]:
    """Hashes of a word and its beginnings."""
    letters = word.decode("utf-8", "replace")
    stems = [f"^{letters[:n]}".encode() for n in STEMS if len(letters) > n]
    return [xxhash.xxh3_64_intdigest(term) % BUCKETS for term in (word, *stems)]


def terms_of(text: str | None) -> set[bytes]:
    """The distinct words of a whole text in lower case, without punctuation."""
    return set(plain_words_of(text))


@dataclass
class Machine:
    """Intercept, and for each learned bucket its place, weight and vector."""

    intercept: float
    place: dict[int, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, FACTORS)))

    def score(self, texts: list[list[int]]) -> np.ndarray:
        """Probability of the toxic label for texts given as places of their terms."""
        sizes = np.array([len(t) for t in texts], np.int64)
        flat = np.array([i for t in texts for i in t], np.int64)
        return 1 / (1 + np.exp(-np.clip(_response(self, np.repeat(np.arange(len(texts)), sizes), flat, len(texts))[0], -35, 35)))


def _response(m: Machine, rows: np.ndarray, terms: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Response of each text, and the sum of its terms' vectors."""
    linear = np.bincount(rows, m.weights[terms], n)
    v = m.vectors[terms]
    sums = np.column_stack([np.bincount(rows, v[:, f], n) for f in range(FACTORS)])
    squares = np.bincount(rows, (v**2).sum(axis=1), n)
    return m.intercept + linear + ((sums**2).sum(axis=1) - squares) / 2, sums


def train(texts: list[np.ndarray], labels: np.ndarray, prior: float) -> Machine:
    """Fit the machine by AdaGrad steps over the whole sample; ``prior`` is the label's share outside the sample.

    Buckets are hashes of terms; a sample without both labels gives the prior for every text.
    """
    toxic, n = int(labels.sum()), len(labels)
    intercept = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    if not 0 < toxic < n:
        return Machine(intercept)
    buckets, flat = np.unique(np.concatenate(texts), return_inverse=True)
    rows = np.repeat(np.arange(n), [len(t) for t in texts])
    held = np.bincount(flat, minlength=len(buckets))
    held_toxic = np.bincount(flat, labels[rows], len(buckets))
    share = held / n
    error = np.sqrt(share * (1 - share) * (1 / toxic + 1 / (n - toxic))) + 1e-12
    gap = np.abs(held_toxic / toxic - (held - held_toxic) / (n - toxic)) / error
    keep = (held >= LEAST_TEXTS) & (gap >= LEAST_ERRORS)
    number = np.cumsum(keep) - 1
    used = keep[flat]
    rows, flat = rows[used], number[flat[used]]
    random = np.random.default_rng(SEED)
    m = Machine(
        0.0, {int(b): int(number[i]) for i, b in enumerate(buckets) if keep[i]}, np.zeros(keep.sum()), random.normal(0, 0.05, (int(keep.sum()), FACTORS))
    )
    past_w, past_v, past_0 = np.full(len(m.weights), 1e-8), np.full(m.vectors.shape, 1e-8), 1e-8
    for _ in range(EPOCHS):
        response, sums = _response(m, rows, flat, n)
        slope = (1 / (1 + np.exp(-np.clip(response, -35, 35))) - labels) / n
        each = slope[rows]
        to_w = np.bincount(flat, each, len(m.weights)) + PENALTY * m.weights
        pull = each[:, None] * (sums[rows] - m.vectors[flat])
        to_v = np.column_stack([np.bincount(flat, pull[:, f], len(m.weights)) for f in range(FACTORS)]) + PENALTY * m.vectors
        past_w, past_v, past_0 = past_w + to_w**2, past_v + to_v**2, past_0 + slope.sum() ** 2
        m.weights -= 10 * RATE * to_w / np.sqrt(past_w)
        m.vectors -= RATE * to_v / np.sqrt(past_v)
        m.intercept -= 10 * RATE * slope.sum() / np.sqrt(past_0)
    m.intercept += intercept - float(np.log(toxic / (n - toxic)))  # the sample's classes are not in proportion
    return m


def _hashed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.fromiter({b for w in terms_of(t.as_py()) for b in buckets_of(w)}, np.int32) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(rows, pa.list_(pa.int32()))], ["y", "terms"])

    return docs.select("y", "text").mapInArrow(run, "y int, terms array<int>")


def fit(docs: DataFrame, labels: DataFrame) -> Machine:
    """Learn from a bounded sample of ``labels`` (doc_id, y): at most ``SAMPLE`` rows of each class."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    sampled = [usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for y in (0, 1)]
    chosen = F.broadcast(sampled[0].union(sampled[1]))  # bounded by SAMPLE
    rows = _hashed(docs.join(chosen, "doc_id")).toArrow()
    texts = [np.asarray(t, np.int64) for t in rows.column("terms").to_pylist()]
    return train(texts, rows.column("y").to_numpy().astype(float), prior)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    ``labels`` (doc_id, toxic) are learned from rows whose CRC-32 of doc_id modulo 4 is not 2; rows with a
    null or other label are left out.  Without labels of both kinds every score is their share.  Null texts
    count as empty and get the score of a text without learned terms; a row without doc_id is scored and not
    held out.  Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    machine = fit(docs, labels.select("doc_id", F.col("toxic").alias("y")).where(~is_held_out(4, 2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Memo(lambda w: tuple(machine.place[b] for b in buckets_of(w) if b in machine.place), 500_000)
        for batch in batches:
            texts = [list(set(chain.from_iterable(map(places.__getitem__, terms_of(t.as_py()))))) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "held_out")), pa.array(machine.score(texts), pa.float64())], ["doc_id", "held_out", "score"])

    scored = docs.withColumn("held_out", is_held_out(4, 2)).select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
