"""Words, shingles and hashes of whole texts, as bytes and numpy arrays."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WORD = r"[^\x20\x09-\x0D]+"


def words(text: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lowered. bytes.split() cuts at exactly these six characters."""
    return text.translate(LOWER).split() if text else []


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def n_words(text: Column) -> Column:
    """How many words a text column has; null: 0."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")).cast("long")


#: Bytes of texts that are hashed together; a worker needs some 60 times as much.
CHUNK = 1 << 18
#: Longer runs are hashed by themselves.
LONG_WORD = 64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SPACES = re.compile(rb"[\x20\x09-\x0D]")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: each output bit depends on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int) -> np.ndarray:
    out = np.ones(CHUNK + 2, np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a byte stands for, the powers of an odd number modulo 2**64, and those of its inverse."""
    base = 0x9E3779B97F4A7C15
    return mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1), _powers(base), _powers(pow(base, -1, 1 << 64))


def _hash_chunk(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lowered text of at most CHUNK bytes, and where each begins."""
    values, power, inverse = _tables()
    b = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(b) + 2, bool)
    np.logical_not(_SPACE[b], out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(values[b] * power[: len(b)], out=sums[1:])
    size = (end - start).astype(np.uint64)
    h = mix((sums[end] - sums[start]) * inverse[start] + size * np.uint64(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    return h, start


def word_hashes(texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
    """For each text the 64-bit hashes of its words, A-Z lowered, in order. Texts are hashed together, very long ones in parts."""

    def together(some: list[bytes]) -> Iterator[np.ndarray]:
        h, start = _hash_chunk(b" ".join(some).translate(LOWER))
        bounds = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in some)]))
        for i in range(len(some)):
            yield h[bounds[i] : bounds[i + 1]]

    some, size = [], 0
    for text in texts:
        text = text or b""
        if some and size + len(text) + 1 > CHUNK:
            yield from together(some)
            some, size = [], 0
        if len(text) < CHUNK:
            some.append(text)
            size += len(text) + 1
            continue
        found, at = [], 0
        while at < len(text):
            stop = at + CHUNK
            if stop < len(text) and not _SPACE[text[stop]]:
                stop = 1 + max(text.rfind(c, at, stop) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
                if not stop:  # one run without spaces
                    space = _SPACES.search(text, at + CHUNK)
                    stop = space.start() if space else len(text)
                    found.append(np.array([xxhash.xxh3_64_intdigest(text[at:stop].translate(LOWER))], np.uint64))
                    at = stop
                    continue
            found.append(_hash_chunk(text[at:stop].translate(LOWER))[0])
            at = stop
        yield np.concatenate(found)
    if some:
        yield from together(some)


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word runs in text order; of the whole sequence if it is shorter; none without words."""
    n = len(h)
    if not n:
        return h
    take = min(n, k)
    x = mix(h[: n - take + 1] + np.uint64(take))
    for j in range(1, take):
        x = mix(x + h[j : n - take + 1 + j])
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, sorted."""
    if len(x) < 2:
        return x
    x = np.sort(x)
    other = np.empty(len(x), bool)
    other[0] = True
    np.not_equal(x[1:], x[:-1], out=other[1:])
    return x[other]


def shingle_sets(texts: Iterable[bytes | None], k: int) -> Iterator[np.ndarray]:
    """For each text its distinct k-word shingles, sorted."""
    return (distinct(ngrams(h, k)) for h in word_hashes(texts))


def set_hash(f: np.ndarray, seed: int = 0) -> int:
    """One signed 64-bit hash of a sorted set. Two of n different sets share one with probability n*n/2**65."""
    return xxhash.xxh3_64_intdigest(f.tobytes(), seed) - (1 << 63)
