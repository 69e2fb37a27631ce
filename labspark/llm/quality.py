"""Quality scores: ridge regression on random Fourier features of document statistics, then isotonic calibration.

The random features approximate a Gaussian kernel over standardised statistics of a whole text.  Every
partition sums its part of the normal equations, Spark adds the parts, and the driver solves a system whose
size is set by ``FEATURES`` alone.  Calibration pools adjacent violators over the counts of a fixed score grid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.llm.storage import written

FEATURES = 192
RIDGE = 1.0
WIDTH = 3.0
GRID = 2000
SEED = 20
THRESHOLD = 0.3

_LOWER, _UPPER, _DIGITS = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_SENTENCE, _MARKS, _OTHER = b".,;:?'\"()-", b"!", b"|#$%&*+/<=>@[\\]^_`{}~"
_HIGH = bytes(range(128, 256))


def statistics(text: str | None) -> list[float]:
    """Numbers that describe the shape of a whole text; a null text counts as empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words, lines = data.split(), data.split(b"\n")
    size, count = max(1, len(data)), max(1, len(words))

    def share(kind: bytes) -> float:
        return (len(data) - len(data.translate(None, kind))) / size

    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return [
        np.log1p(len(data)),
        np.log1p(len(words)),
        np.log1p(len(lines)),
        float(lengths.mean()) if len(words) else 0.0,
        float(lengths.std()) if len(words) else 0.0,
        float((lengths <= 3).mean()) if len(words) else 0.0,
        len(set(words)) / count,
        len(set(lines)) / len(lines),
        np.log1p(len(words) / len(lines)),
        share(_LOWER),
        share(_UPPER),
        share(_DIGITS),
        share(_SENTENCE),
        share(_MARKS),
        share(_OTHER),
        share(_HIGH),
    ]


def _described(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, x array<double>")


def is_held_out(modulus: int, rest: int) -> Column:
    """Whether the CRC-32 of the doc_id as text leaves ``rest``; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == rest, F.lit(False))


@dataclass
class Model:
    """What scoring needs; its size does not depend on the data."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def lifted(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(((x - self.mean) / self.scale) @ self.directions + self.phases)
        return np.hstack([z * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lifted(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sums of z z' and z y over all rows (x, y), one partial sum for each partition."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            if batch.num_rows:
                z = model.lifted(_matrix(batch.column("x")))
                total += z.T @ np.column_stack([z, batch.column("y").to_numpy()])
        yield pa.RecordBatch.from_arrays([pa.array(range(FEATURES + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "sums"])

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": group["i"].iloc[:1], "sums": [np.sum(np.stack(group["sums"].tolist()), axis=0)]})

    parts = rows.select("x", "y").mapInArrow(partial, "i int, sums array<double>")
    total = parts.groupBy("i").applyInPandas(summed, "i int, sums array<double>").orderBy("i").collect()
    if not total:
        return np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
    sums = np.array([r["sums"] for r in total])
    return sums[:, :-1], sums[:, -1]


def pool_violators(count: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence of shares closest to positive / count by weighted squares."""
    blocks: list[list[float]] = []
    for n, p in zip(count, positive, strict=True):
        blocks.append([n, p, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n2, p2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n2, blocks[-1][1] + p2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), p / n) for n, p, k in blocks]) if blocks else np.empty(0)


def fit(described: DataFrame, labels: DataFrame) -> Model:
    """Fit on all rows of ``described`` (doc_id, x) that have a 0 or 1 in ``labels`` (doc_id, y)."""
    wanted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("double").alias("y")).where("y in (0, 1)")
    rows = written(described.join(wanted, "doc_id").select("x", "y"), "labelled")
    width = len(statistics(""))
    moments = rows.agg(
        F.count("*").alias("n"), *[f(F.col("x")[i]).alias(f"{name}{i}") for i in range(width) for name, f in (("m", F.avg), ("s", F.stddev_pop))]
    ).first()
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(width)])
    scale = np.array([moments[f"s{i}"] or 1.0 for i in range(width)])
    random = np.random.default_rng(SEED)
    model = Model(
        mean, scale, random.normal(0, 1 / WIDTH, (width, FEATURES)), random.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5])
    )
    if not moments["n"]:
        return model
    left, right = _normal_equations(rows, model)
    penalty = np.eye(FEATURES + 1) * RIDGE
    penalty[-1, -1] = 0  # the intercept is free
    model.weights = np.linalg.solve(left + penalty, right)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                place = np.clip(np.rint(model.raw(_matrix(batch.column("x"))) * GRID), -GRID, 2 * GRID).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(place), batch.column("y")], ["place", "y"])

    counts = rows.mapInArrow(binned, "place long, y double").groupBy("place").agg(F.count("*").alias("n"), F.sum("y").alias("p")).orderBy("place").collect()
    level = pool_violators(np.array([r["n"] for r in counts]), np.array([r["p"] for r in counts]))
    model.knots, model.levels = _steps(np.array([r["place"] for r in counts]) / GRID, np.array([r["n"] for r in counts]), level)
    return model


def _steps(places: np.ndarray, counts: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One knot for each level, at its rows' mean place; scores between knots are interpolated, so ties stay rare."""
    _, first = np.unique(levels, return_index=True)
    weight = np.add.reduceat(counts, first)
    return np.add.reduceat(places * counts, first) / weight, levels[first]


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    ``labels`` (doc_id, quality) are learned from rows whose CRC-32 of doc_id modulo 5 is not 0; rows with
    a null or other label are left out, and repeated labels weigh as often as they occur.  Without any
    label every score is 0.5.  Null texts count as empty; a row without doc_id is scored and not held out.
    Other columns are ignored.
    """
    described = written(_described(docs), "statistics")
    model = fit(described, labels.select("doc_id", F.col("quality").alias("y")).where(~is_held_out(5, 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch.column("x"))) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64())], ["doc_id", "held_out", "score"])

    scored = described.withColumn("held_out", is_held_out(5, 0)).mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
