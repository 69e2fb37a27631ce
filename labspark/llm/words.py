"""Words of a text and their hashes, for Python tasks."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import xxhash

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)
_SPACES = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


class Memo(dict):
    """A function's values by argument, kept between batches; emptied when ``limit`` of them are held."""

    def __init__(self, compute: Callable, limit: int):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


def words_of(text: str) -> list[bytes]:
    """A-Z in lower case, split at space, tab, line feed, vertical tab, form feed and carriage return."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def plain_words_of(text: str | None) -> list[bytes]:
    """Words in lower case, ASCII punctuation counting as white space; none for a null text."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACES).split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(hashes: np.ndarray, length: int, starts: np.ndarray | None = None) -> np.ndarray:
    """One 64-bit hash for each run of ``length`` words, in text order; none if there are fewer words.

    With ``starts``, only those of the runs that begin there.
    """
    count = max(0, len(hashes) - length + 1) if starts is None else len(starts)
    out = np.full(count, length, np.uint64)
    for i in range(length):
        out = (out ^ (hashes[i : i + count] if starts is None else hashes[starts + i])) * _FACTOR
        out ^= out >> _SHIFT
    return out * _FACTOR


def shingle_set(text: str | None, length: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles.

    A text of fewer words is one shingle, its whole word sequence; a null text or one without words has none.
    """
    hashes = hashes_of(words_of(text)) if text else np.empty(0, np.uint64)
    if not len(hashes):
        return hashes
    return np.unique(shingle_hashes(hashes, min(length, len(hashes))))


def portions(texts: list[str | None], size: int = 4_000_000) -> Iterator[list[str]]:
    """``texts`` in order in parts of about ``size`` characters, so the words of a batch are never held at once."""
    part, held = [], 0
    for text in texts:
        part.append(text or "")
        held += len(part[-1])
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


def joined_codes(texts: list[list[str]], held: dict[str, bytes], limit: int, encode: Callable[[list[str]], Iterable[bytes]]) -> list[bytes]:
    """The codes of each text's words, one after the other.

    ``held`` keeps codes between batches; ``encode`` gives those of new words, which come distinct and sorted.
    Beyond ``limit`` only words stay that this batch met again.
    """
    codes = [list(map(held.get, words)) for words in texts]
    lacking = [None in found for found in codes]
    new = sorted({w for words, found, lacks in zip(texts, codes, lacking, strict=True) if lacks for w, code in zip(words, found, strict=True) if code is None})
    if len(held) + len(new) > limit:
        again = {w: code for words, found in zip(texts, codes, strict=True) for w, code in zip(words, found, strict=True) if code is not None}
        held.clear()
        held.update(again)
    held.update(zip(new, encode(new), strict=True))
    return [
        b"".join(map(held.__getitem__, words) if lacks else found) for words, found, lacks in zip(texts, codes, lacking, strict=True)
    ]
