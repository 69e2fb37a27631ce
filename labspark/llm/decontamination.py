"""Benchmark passages in documents, by random-walk embedding and bit-sampling LSH.

A walk reads a window word by word, writes the word it stands on and steps on or stays as a random bit of
that word says.  Windows within a small edit distance write strings of small Hamming distance, so a few
sampled places of both strings agree with good probability.  ``WALKS`` independent walks with ``SAMPLED``
places each reach the target recall of 0.99 at the largest distance allowed (a test measures it); windows that agree with an item in
any walk are verified by their exact edit distance.

Only windows that can pass are walked: with at most d edits, one of d + 1 equal parts of the item must stand
unchanged in the window, so windows around such parts are all that is needed.  This loses nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labspark.llm.words import hashes_of, plain_words_of, shingle_hashes

#: Edits allowed for each item: this share of its words, rounded down.
EDITS = 0.2
#: Shorter items name nothing; they match no document.
LEAST_WORDS = 5
WALKS = 24
SAMPLED = 2
#: So many words of items are matched in one pass over the documents; more items take more passes.
BLOCK_WORDS = 500_000

_PAD = np.uint64(0)
_GATE_BITS = 20


def edit_distance_within(item: list, text: list) -> tuple[int, int]:
    """Least edit distance between ``item`` and any run of ``text``, and the end of the first such run."""
    size = len(item)
    full, high = (1 << size) - 1, 1 << (size - 1)
    places: dict = defaultdict(int)
    for i, word in enumerate(item):
        places[word] |= 1 << i
    up, down, score = full, 0, size
    best, end = size, 0
    for j, word in enumerate(text, 1):
        same = places.get(word, 0)
        diagonal = (((same & up) + up) ^ up) | same
        right, left = (down | ~(diagonal | up)) & full, up & diagonal
        score += bool(right & high) - bool(left & high)
        right, left = (right << 1) & full, (left << 1) & full
        vertical = same | down
        up, down = (left | ~(vertical | right)) & full, right & vertical
        if score < best:
            best, end = score, j
    return best, end


class Walks:
    """The walks over windows of one length and the items' keys in each of them."""

    def __init__(self, size: int, items: dict[int, np.ndarray]):
        random = np.random.default_rng([size, 11])
        self.size, self.steps = size, 2 * size
        self.bits = random.integers(0, 2**63, (WALKS, self.steps), np.uint64) * np.uint64(2) + np.uint64(1)
        self.places = np.sort(random.integers(0, self.steps, (WALKS, SAMPLED)), axis=1)
        self.mix = random.integers(0, 2**63, SAMPLED, np.uint64) * np.uint64(2) + np.uint64(1)
        numbers = np.array(list(items), np.int64)
        self.items = [(keys[order], numbers[order]) for keys in self.keys(np.stack(list(items.values()))) if (order := np.argsort(keys)) is not None]

    def keys(self, windows: np.ndarray) -> Iterator[np.ndarray]:
        """For each walk the key of every row of ``windows``: its words at the sampled places."""
        padded = np.hstack([windows, np.full((len(windows), 1), _PAD)])
        rows = np.arange(len(windows))
        for bits, places in zip(self.bits, self.places, strict=True):
            at, key, taken = np.zeros(len(windows), np.int64), np.zeros(len(windows), np.uint64), 0
            for step in range(places[-1] + 1):
                word = padded[rows, at]
                while taken < SAMPLED and places[taken] == step:
                    key = key * np.uint64(31) + (word + np.uint64(1)) * self.mix[taken]
                    taken += 1
                at = np.minimum(at + ((word * bits[step]) >> np.uint64(63)).astype(np.int64), self.size)
            yield key

    def candidates(self, windows: np.ndarray) -> set[tuple[int, int]]:
        """(row of ``windows``, item) for all that agree in any walk."""
        found: set[tuple[int, int]] = set()
        for keys, (known, numbers) in zip(self.keys(windows), self.items, strict=True):
            low, high = np.searchsorted(known, keys, "left"), np.searchsorted(known, keys, "right")
            for row in np.nonzero(high > low)[0]:
                found.update((int(row), int(i)) for i in numbers[low[row] : high[row]])
        return found


class Block:
    """Items of one pass: their words, parts that gate windows, and walks by length."""

    def __init__(self, items: list[tuple[int, list[bytes]]]):
        self.ids = [i for i, _ in items]
        self.words = [hashes_of(w) for _, w in items]
        self.edits = [int(EDITS * len(w)) for w in self.words]
        by_size: dict[int, dict[int, np.ndarray]] = defaultdict(dict)
        self.gates: dict[int, tuple[np.ndarray, dict[int, list[tuple[int, int]]]]] = {}
        for n, words in enumerate(self.words):
            by_size[len(words)][n] = words
            part = len(words) // (self.edits[n] + 1)
            bitmap, known = self.gates.setdefault(part, (np.zeros(1 << _GATE_BITS, bool), defaultdict(list)))
            grams = shingle_hashes(words, part)
            for k in range(self.edits[n] + 1):
                known[int(grams[k * part])].append((n, k * part))
                bitmap[int(grams[k * part]) >> (64 - _GATE_BITS)] = True
        self.walks = {size: Walks(size, members) for size, members in by_size.items()}

    def matches(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        """(row of ``texts``, item_id, distance, words of the item, word at which the passage ends)."""
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        ends = np.cumsum(lengths) - 1  # the pad after each text
        words = np.full(int(lengths.sum()), _PAD)
        words[np.delete(np.arange(len(words)), ends)] = np.concatenate(texts) if texts else []
        found: dict[int, list[np.ndarray]] = defaultdict(list)
        for part, (bitmap, known) in self.gates.items():
            grams = shingle_hashes(words, part)
            for at in np.nonzero(bitmap[grams >> np.uint64(64 - _GATE_BITS)])[0].tolist():
                for n, offset in known.get(int(grams[at]), ()):
                    d = self.edits[n]
                    found[len(self.words[n])].append(np.arange(at - offset - d, at - offset + d + 1))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for size, starts in found.items():
            for places in np.array_split(np.unique(np.concatenate(starts)), 1 + sum(map(len, starts)) // 50_000):
                self._verify(words, ends, size, places[places >= 0], best)
        return [(row, self.ids[n], distance, len(self.words[n]), end) for (row, n), (distance, end) in sorted(best.items())]

    def _verify(self, words: np.ndarray, ends: np.ndarray, size: int, places: np.ndarray, best: dict) -> None:
        rows = np.searchsorted(ends, places)
        index = places[:, None] + np.arange(size)
        windows = np.where(index < ends[rows][:, None], words[np.minimum(index, len(words) - 1)], _PAD)
        for k, n in sorted(self.walks[size].candidates(windows)):
            d, row, place = self.edits[n], int(rows[k]), int(places[k])
            first = int(ends[row - 1]) + 1 if row else 0
            low, high = max(first, place - d), min(int(ends[row]), place + size + d)
            distance, end = edit_distance_within(self.words[n].tolist(), words[low:high].tolist())
            if distance <= d and distance < best.get((row, n), (size, 0))[0]:
                best[row, n] = (distance, low + end - first)


def _blocks(items: DataFrame) -> Iterator[Block]:
    """The items, read a partition at a time and cut into blocks of bounded size."""
    held, size = [], 0
    for row in items.toLocalIterator():
        words = plain_words_of(row["text"])
        if len(words) < LEAST_WORDS:
            continue
        if held and size + len(words) > BLOCK_WORDS:
            yield Block(held)
            held, size = [], 0
        held.append((row["item_id"], words))
        size += len(words)
    if held:
        yield Block(held)


_SCHEMA = "doc_id long, item_id long, distance int, item_words int, end_word int"


def _pass(docs: DataFrame, block: Block) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)  # bounded by BLOCK_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = [hashes_of(plain_words_of(t.as_py())) for t in batch.column("text")]
            rows = [(ids[row], *match) for row, *match in block.matches(texts)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "distance", "item_words", "end_word"]
            )

    return docs.mapInArrow(run, _SCHEMA)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, item_words, end_word) for each item that a document holds.

    ``docs`` (doc_id, text) and ``items`` (item_id, text) are compared as words in lower case without
    punctuation.  A document holds an item if a run of its words is within ``EDITS`` of the item's word count;
    ``distance`` is the least such distance and ``end_word`` the number of words up to the end of the
    passage.  Null texts, and items of fewer than ``LEAST_WORDS`` words, match nothing.  Repeated items and
    documents are reported each; null ids are carried.  Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    passes = [_pass(docs, block) for block in _blocks(items)]
    return reduce(DataFrame.union, passes) if passes else docs.sparkSession.createDataFrame([], _SCHEMA)
