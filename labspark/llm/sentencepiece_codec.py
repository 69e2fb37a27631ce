"""SentencePiece encoding and decoding by a Viterbi pass over a trie of marked words.

Every space is the mark of a word, and a text is cut wherever no piece of the vocabulary spans the cut, which leaves marked
words and runs of separators.  The distinct new words of a batch are sorted, so that words with a common
prefix are neighbours: walking them in order is a depth-first traversal of their trie, and the forward states
of the shared prefix are kept.

The forward state of a prefix is its last piece and its score.  The model merges pieces by score, and of all
pieces that end a prefix exactly one extends the path that the merges would take, the one that stays apart
from the path's last piece when both are merged together.  So the pass yields the same ids as the public
library does, which the plain sum of scores would not for a model of merges.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labspark.llm.words import Memo, joined_codes, portions

#: How piece names write the space, which stands for itself in here.
MARK = "▁"
WORDS_HELD = 400_000
PAIRS_HELD = 400_000

_SEPARATORS = ".,;:!?|\"()[]{}<>/\\*+=_~^`@#$%&\n\t\r-'"


class Vocabulary:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.unknown = model.unk_id()
        self.pieces = [model.id_to_piece(i) for i in range(self.size)]
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        plain = [i for i in range(self.size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.pieces = [p.replace(MARK, " ") for p in self.pieces]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {i: model.get_score(i) for i in plain}
        #: Pieces read from their last character on: (id or -1, next characters).
        self.ends: tuple[int, dict] = self._backwards()
        self.cut = re.compile(self._cuts())
        self.apart = Memo(self._stay_apart, PAIRS_HELD)
        self.whole = Memo(lambda i: self.merge(self.pieces[i]) == [i], PAIRS_HELD)
        self.text = [self._surface(i) for i in range(self.size)]

    def _backwards(self) -> tuple[int, dict]:
        root: list = [-1, {}]
        for piece, i in self.ids.items():
            node = root
            for c in reversed(piece):
                node = node[1].setdefault(c, [-1, {}])
            node[0] = i
        return root

    def _cuts(self) -> str:
        """A pattern for marked words and separator runs that no piece spans."""
        separators = set(_SEPARATORS)
        while mixed := {c for p in self.ids for c in p.lstrip(" ") if c in separators and set(p.lstrip(" ")) - separators}:
            separators -= mixed
        inner = "".join(map(re.escape, sorted(separators)))
        if any(" " in p.lstrip(" ") for p in self.ids):
            return "(?s:.+)"  # pieces span words: texts stay whole
        return rf" *[^ {inner}]+| *[{inner}]+| +" if inner else " *[^ ]+| +"

    def _surface(self, i: int) -> bytes:
        if m := re.fullmatch("<0x([0-9A-F]{2})>", self.pieces[i]):
            return bytes([int(m[1], 16)])
        return self.pieces[i].encode() if i in self.scores else b" \xe2\x81\x87 " if i == self.unknown else b""

    def merge(self, word: str) -> list[int]:
        """Join the neighbours whose piece has the best score, the first of equals, until none is left."""
        parts = list(word)
        while True:
            best = max(
                ((self.scores[i], -k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None
            )
            if best is None:
                return [x for p in parts for x in self.of_part(p)]
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def _stay_apart(self, pair: int) -> bool:
        left, right = divmod(pair, self.size)
        return self.merge(self.pieces[left] + self.pieces[right]) == [left, right]

    def of_part(self, part: str) -> list[int]:
        """The id of a piece, or the ids of an unknown character's bytes."""
        i = self.ids.get(part)
        return [i] if i is not None else [self.byte_ids[b] for b in part.encode("utf-8", "surrogatepass")]

    def encode_sorted(self, words: list[str]) -> Iterator[list[int]]:
        """The ids of each of ``words``, which are distinct and sorted."""
        root, apart, whole, size = self.ends[1], self.apart, self.whole, self.size
        before = ""
        last: list[int] = [-1]  # by prefix length: id of the last piece, -2 for an unknown character
        start: list[int] = [0]  # where it starts
        for word in words:
            at = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                at += 1
            del last[at + 1 :], start[at + 1 :]
            for end in range(at + 1, len(word) + 1):
                piece = -2
                begin = chosen = end - 1
                following = root
                while begin >= 0 and (node := following.get(word[begin])):
                    i, following = node
                    if i >= 0 and (whole[i] if begin == 0 else (x := last[begin]) == -2 or apart[x * size + i]):
                        piece, chosen = i, begin
                        break
                    begin -= 1
                last.append(piece)
                start.append(chosen)
            before = word
            path, end = [], len(word)
            while end:
                path.append(self.of_part(word[end - 1]) if last[end] == -2 else [last[end]])
                end = start[end]
            yield [i for ids in reversed(path) for i in ids]

    def encode(self, texts: list[str | None], held: dict[str, bytes]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers; ``held`` keeps those of words between batches."""
        out: list[bytes] = []
        for part in portions(texts):
            cut = [self.cut.findall(" " + t.replace(MARK, " ")) if t else [] for t in part]
            out += joined_codes(cut, held, WORDS_HELD, lambda new: (np.array(ids, "<u4").tobytes() for ids in self.encode_sorted(new)))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, marks as spaces, without the space put before the text."""
        data = b"".join(map(self.text.__getitem__, ids.tolist()))
        return data.removeprefix(b" ").decode("utf-8", "replace")


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _per_batch(run: Callable[[pa.RecordBatch, dict], pa.Array], old: str, new: str):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, bytes] = {}
        for batch in parts:
            names = [c for c in batch.schema.names if c != old]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), run(batch, held)], [*names, new])

    return batches


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``docs`` with the column ``text`` replaced by ``ids`` (binary, little-endian 32-bit ids).

    ``model`` is the path of a model file on every executor.  Whole texts are encoded; a null text has null
    ids, an empty one none.  An existing column ``ids`` is replaced; all other columns and all rows stay.
    """

    def run(batch: pa.RecordBatch, held: dict) -> pa.Array:
        texts = batch.column("text").to_pylist()
        ids = vocabulary(model).encode(texts, held)
        return pa.array([None if t is None else i for t, i in zip(texts, ids, strict=True)], pa.binary())

    kept = docs.drop("ids").withColumn("text", F.col("text").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text")
    return kept.mapInArrow(_per_batch(run, "text", "ids"), f"{schema}{', ' if schema else ''}ids binary")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` with the column ``ids`` replaced by the ``text`` they stand for; null ids have a null text."""

    def run(batch: pa.RecordBatch, _: dict) -> pa.Array:
        words = vocabulary(model)
        return pa.array([None if i is None else words.decode(np.frombuffer(i, "<u4")) for i in batch.column("ids").to_pylist()], pa.string())

    kept = encoded.drop("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "ids")
    return kept.mapInArrow(_per_batch(run, "ids", "text"), f"{schema}{', ' if schema else ''}text string")


def encoded_documents(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, n_tokens, exact) for every row of ``docs`` (doc_id, text).

    ``ids`` is an array of the text's piece ids, ``exact`` whether decoding them gives the text back.  A null
    text has null ids, no tokens and a null ``exact``.  Rows may repeat; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, bytes] = {}
        for batch in batches:
            words = vocabulary(model)
            texts = batch.column("text").to_pylist()
            ids = [np.frombuffer(i, "<u4").astype(np.int32) for i in words.encode(texts, held)]
            exact = [None if t is None else words.decode(i) == t for t, i in zip(texts, ids, strict=True)]
            lists = [None if t is None else i for t, i in zip(texts, ids, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lists, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int32()), pa.array(exact, pa.bool_())],
                ["doc_id", "ids", "n_tokens", "exact"],
            )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, ids array<int>, n_tokens int, exact boolean")
