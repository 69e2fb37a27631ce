"""Token ids in binary files with Elias-Fano coded document boundaries.

A file holds the concatenated ids of its documents, then two Elias-Fano sequences, the documents' boundaries
in that array and their doc_ids, and a fixed footer.  A sequence of n values below u takes about
2 + log2(u / n) bits a value: the low bits are packed, the high bits stand in unary in a bit vector, and a
rank directory over its blocks answers ``select``, so an offset is found without a table of 64-bit numbers.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labspark.llm.storage import new_folder, written
from labspark.llm.words import portions

MAGIC = b"EFIDS1\0\0"
#: Byte places of both sequences, number of documents, of them without doc_id, least doc_id, ids, bytes of an id, magic.
FOOTER = struct.Struct("<QQQQqQQ8s")
BLOCK = 512
WORDS_HELD = 700_000
READ_IDS = 1 << 20
#: Words of one call to the tokenizer.
TOGETHER = 256

_END = "</w>"
_SIGNS = ",.;:!?"

_ASCII_SEPARATORS = re.compile("[\x1c-\x1f]")
_WHITE_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Letters beyond those whose lower case is the same in Python and in the model, which composition leaves as they are.
_FAR = re.compile("[^\x00-\u012f\u0131-\u017f]")
#: Signs side by side are one piece of the model, by what it counts as letters, digits and white space below U+0180.
_SIGN_RUN = re.compile("[^\t-\r \x85\xa0a-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\u017f]{2}")
#: How the names of the model's added pieces begin, which it looks for before the text is put in lower case.
_ADDED = "<|"


class EliasFano:
    """A non-decreasing sequence of non-negative numbers."""

    HEAD = struct.Struct("<QQQ")

    def __init__(self, count: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.count, self.low_bits, self.low, self.high = count, low_bits, low, high
        ones = np.bitwise_count(high).astype(np.uint32)
        pad = -len(ones) % (BLOCK // 8)
        #: Ones before each block of the bit vector.
        self.ranks = np.concatenate([[0], np.cumsum(np.append(ones, np.zeros(pad, np.uint32)).reshape(-1, BLOCK // 8).sum(axis=1))]).astype(np.uint32)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(places[-1]) if n else 0) + 1, np.uint8)
        high[places] = 1
        low = (values[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel()
        return cls(n, bits, np.packbits(low, bitorder="little"), np.packbits(high, bitorder="little"))

    def tobytes(self) -> bytes:
        return self.HEAD.pack(self.count, self.low_bits, len(self.high)) + self.high.tobytes() + self.low.tobytes()

    @classmethod
    def frombytes(cls, data: bytes) -> EliasFano:
        count, bits, size = cls.HEAD.unpack_from(data)
        body = np.frombuffer(data, np.uint8, offset=cls.HEAD.size)
        return cls(count, bits, body[size : size + (count * bits + 7) // 8], body[:size])

    def select(self, i: int) -> int:
        """Value ``i``."""
        block = int(np.searchsorted(self.ranks, i, "right")) - 1
        bits = np.unpackbits(self.high[block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        place = block * BLOCK + int(np.nonzero(bits)[0][i - int(self.ranks[block])])
        first = i * self.low_bits
        taken = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little") >> first % 8
        return (place - i) << self.low_bits | taken & (1 << self.low_bits) - 1

    def values(self) -> np.ndarray:
        places = np.nonzero(np.unpackbits(self.high, bitorder="little"))[0][: self.count]
        out = (places - np.arange(self.count)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            low = np.unpackbits(self.low, bitorder="little")[: self.count * self.low_bits].reshape(self.count, self.low_bits)
            for bit in range(self.low_bits):
                out |= low[:, bit].astype(np.uint64) << np.uint64(bit)
        return out


class TokenFile:
    """One file, read by document or as a whole without holding all its ids."""

    def __init__(self, path: str):
        store, name = fs.FileSystem.from_uri(path)
        self.source = store.open_input_file(name)
        end = self.source.size() - FOOTER.size
        bounds, doc_ids, self.count, self.nameless, self.least, self.size, self.width, magic = FOOTER.unpack(self.source.read_at(FOOTER.size, end))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.bounds = EliasFano.frombytes(self.source.read_at(doc_ids - bounds, bounds))
        self.doc_ids = EliasFano.frombytes(self.source.read_at(end - doc_ids, doc_ids))

    def close(self) -> None:
        self.source.close()

    def ids(self, first: int, last: int) -> np.ndarray:
        data = self.source.read_at((last - first) * self.width, first * self.width)
        return np.frombuffer(data, f"<u{self.width}").astype("<u4")

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.bounds.select(i), self.bounds.select(i + 1))

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, offset, ids) of every document, in order."""
        bounds = self.bounds.values().astype(np.int64)
        names = self.doc_ids.values()
        held, first, last = np.empty(0, "<u4"), 0, 0
        for i in range(self.count):
            low, high = int(bounds[i]), int(bounds[i + 1])
            if high > last:
                first, last = low, min(self.size, max(high, low + READ_IDS))
                held = self.ids(first, last)
            yield (None if i < self.nameless else int(names[i - self.nameless]) + self.least), low, held[low - first : high - first]


class TokenFileWriter:
    """Writes documents in ascending doc_id order, those without doc_id first."""

    def __init__(self, path: str, width: int):
        store, name = fs.FileSystem.from_uri(path)
        store.create_dir(name.rpartition("/")[0])
        self.sink, self.width, self.lengths, self.names = store.open_output_stream(name), width, [0], []

    def add(self, doc_id: int | None, codes: bytes) -> None:
        self.sink.write(codes)
        self.lengths.append(len(codes) // self.width)
        self.names.append(doc_id)

    def close(self) -> tuple[int, int]:
        """Write boundaries, doc_ids and footer; the numbers of documents and ids."""
        known = np.array([n for n in self.names if n is not None], np.int64)
        least = int(known[0]) if len(known) else 0
        ends = np.cumsum(self.lengths)
        bounds = EliasFano.of(ends).tobytes()
        self.sink.write(bounds + EliasFano.of((known - least).astype(np.uint64)).tobytes())
        place, count, size = int(ends[-1]) * self.width, len(self.names), int(ends[-1])
        self.sink.write(FOOTER.pack(place, place + len(bounds), count, count - len(known), least, size, self.width, MAGIC))
        self.sink.close()
        return count, size


def split_words(text: str) -> list[str]:
    """Words of a text that encode to what the text does, one after the other.

    Where that is sure to change nothing, they are in lower case and without the sign at their end, which is a word of
    its own, so fewer different ones occur.
    """
    if _ASCII_SEPARATORS.search(text):
        return [w for w in _WHITE_SPACE.split(text) if w]
    if _ADDED not in text and (text.isascii() or not _FAR.search(text)):
        text = text.lower()
        if not _SIGN_RUN.search(text):
            for sign in _SIGNS:
                text = text.replace(sign, f" {sign}")
    return text.split()


class WordEncoder:
    """Encodes texts word by word; the model's pieces never span white space, which it drops."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; idle threads would spin
        self.model = Tokenizer.from_file(path)
        self.width = 2 if self.model.get_vocab_size() <= 1 << 16 else 4
        self._keep(np.empty(0, np.int64))
        #: Whether a piece ends a part of a word.
        self.last = np.zeros(self.model.get_vocab_size(), bool)
        self.last[[i for piece, i in self.model.get_vocab().items() if piece.endswith(_END)]] = True

    def _keep(self, at: np.ndarray) -> None:
        """Hold the words numbered ``at`` only, with new numbers, their ids one after the other and their uses."""
        if not len(at):
            self.numbers: dict[str, int] = defaultdict()
            self.ids, self.sizes, self.uses = np.empty(0, f"<u{self.width}"), np.empty(0, np.int64), np.empty(0, np.int64)
        else:
            words = list(self.numbers)
            self.ids, self.sizes, self.uses = self._ids(at), self.sizes[at], self.uses[at] // 2
            self.numbers = defaultdict(None, zip([words[i] for i in at.tolist()], range(len(at)), strict=True))
        self.numbers.default_factory = self.numbers.__len__  # a new word gets the next number

    def _ids(self, at: np.ndarray) -> np.ndarray:
        """Ids of the words numbered ``at``, one after the other."""
        sizes = self.sizes[at]
        starts = (np.cumsum(self.sizes) - self.sizes)[at] - (np.cumsum(sizes) - sizes)
        return self.ids[np.repeat(starts, sizes) + np.arange(sizes.sum())]

    def _numbered(self, words: list[list[str]]) -> np.ndarray:
        """Numbers of the words of all texts; the ids of new words are held from now on."""
        before = len(self.numbers)
        at = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
        new = list(islice(reversed(self.numbers), len(self.numbers) - before))[::-1]
        codes = self._codes(new)
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(codes), f"<u{self.width}")])
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, codes), np.int64, len(codes)) // self.width])
        self.uses = np.append(self.uses, np.zeros(len(codes), np.int64)) + np.bincount(at, minlength=len(self.numbers))
        return at

    def _codes(self, words: list[str]) -> list[bytes]:
        """Ids of each word.  Words of a known number of parts share a call, where each part's last piece tells its end."""
        parts = [1 if w.isalpha() else 2 if w[:-1].isalpha() and w[-1] in _SIGNS else 0 for w in words]
        codes = [b""] * len(words)
        plain = [i for i, n in enumerate(parts) if n]
        single = [i for i, n in enumerate(parts) if not n]
        for first in range(0, len(plain), TOGETHER * 64):
            groups = [plain[k : k + TOGETHER] for k in range(first, min(first + TOGETHER * 64, len(plain)), TOGETHER)]
            texts = [" ".join([words[i] for i in group]) for group in groups]
            for group, found in zip(groups, self.model.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(found.ids, f"<u{self.width}")
                ends = np.nonzero(self.last[ids])[0] + 1
                sizes = [parts[i] for i in group]
                if len(ends) != sum(sizes):  # a letter became something else in lower case
                    single += group
                    continue
                cuts = (ends[np.cumsum(sizes) - 1] * self.width).tolist()
                data = ids.tobytes()
                for i, low, high in zip(group, [0, *cuts], cuts, strict=False):
                    codes[i] = data[low:high]
        for first in range(0, len(single), 20_000):
            some = single[first : first + 20_000]
            for i, found in zip(some, self.model.encode_batch_fast([words[i] for i in some], add_special_tokens=False), strict=True):
                codes[i] = np.array(found.ids, f"<u{self.width}").tobytes()
        return codes

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes.  Beyond ``WORDS_HELD`` the words of most uses stay, half as many at most."""
        out: list[bytes] = []
        for part in portions(texts):
            words = list(map(split_words, part))
            at = self._numbered(words)
            counts = np.fromiter(map(len, words), np.int64, len(words))
            # Places of the texts' ends among the ids, which begin and end with words.
            ends = np.concatenate([[0], np.cumsum(self.sizes[at])])[np.cumsum(counts)] * self.width
            data, low = self._ids(at).tobytes(), 0
            for high in ends.tolist():
                out.append(data[low:high])
                low = high
            if len(self.numbers) > WORDS_HELD:
                often = np.argsort(-self.uses, kind="stable")[: WORDS_HELD // 2]
                self._keep(np.sort(often[self.uses[often] > 1]))
        return out


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


_MANIFEST = "shard int, path string, n_docs long, n_ids long"


def write_token_files(docs: DataFrame, model: str, end_id: int, folder: str) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write files below ``folder``; returns (shard, path, n_docs, n_ids).

    Documents stand in ascending doc_id order over the shards, rows without doc_id first; rows that repeat a
    doc_id are ordered by text.  Null texts are empty; ``end_id`` follows each document.  A task writes a
    file of its own name for each attempt, and only the files of finished tasks get into the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(model)
        end = end_id.to_bytes(words.width, "little")
        shard = TaskContext.get().partitionId()
        path = f"{folder}/ids-{shard:06d}-{uuid.uuid4().hex}.ef"
        file = None
        for batch in batches:
            file = file or (TokenFileWriter(path, words.width) if batch.num_rows else None)
            for name, codes in zip(batch.column("doc_id").to_pylist(), words.encode(batch.column("text").to_pylist()), strict=True):
                file.add(name, codes + end)
        if file is None:
            return
        n_docs, n_ids = file.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([path]), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())],
            ["shard", "path", "n_docs", "n_ids"],
        )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = plain.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(run, _MANIFEST), "token-files")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, read back one file to a task.

    ``start`` counts the ids of all documents before it, over all shards.
    """
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each file, so the running sum over them is small.
    files = manifest.withColumn("before", before).select("shard", "path", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                source = TokenFile(path)
                rows = [(name, first + low, len(ids), zlib.crc32(ids.tobytes())) for name, low, ids in source.documents()]
                source.close()
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = files.repartition(max(1, manifest.count()), "shard")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files_of(docs: DataFrame, model: str, end_id: int = 1) -> DataFrame:
    """Write token files of ``docs`` to the shared folder and return what they hold, see ``read_token_files``.

    An empty table writes no file and returns no row.  Other columns are ignored.
    """
    return read_token_files(write_token_files(docs, model, end_id, new_folder(docs.sparkSession, "ids")))
