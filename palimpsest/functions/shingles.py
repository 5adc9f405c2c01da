"""Hashed word n-grams and MinHash, vectorised with NumPy for Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from xxhash import xxh3_64_intdigest

#: All bytes but those of lower-case ASCII letters and digits, which words consist of, are blanks.
_BLANKED = bytes(b if chr(b).isascii() and (chr(b).isdigit() or chr(b).islower()) else 32 for b in range(256))
_A, _B, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
#: Hashes of frequent words that a process keeps.
KEPT = 200_000


def scrambled(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all."""
    h = (h ^ (h >> np.uint64(33))) * _A
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


def words(text: str | None) -> list[bytes]:
    """The lower-cased runs of ASCII letters and digits."""
    return (text or "").lower().encode().translate(_BLANKED).split()


class _Hashes(dict):
    """Word hashes, a bounded number of them kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        found = self[word] = xxh3_64_intdigest(word)
        return found


_hashes = _Hashes()


def gram_lists(texts: Iterable[str | None], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sorted sets of several texts' hashed k-word runs, one after the other, and where each begins and the last ends.

    Runs are hashed over all texts at once; those that cross two texts are left out.
    """
    found: list[bytes] = []
    counts = []
    for text in texts:
        own = words(text)
        found += own
        counts.append(len(own))
    counts = np.array(counts, np.int64)
    begins = np.cumsum(counts) - counts
    sizes = np.maximum(counts - k + 1, 0)
    n = len(found) - k + 1
    if n <= 0 or not sizes.any():
        return np.zeros(0, np.int64), np.zeros(len(counts) + 1, np.int64)
    h = scrambled(np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found)))
    out = h[:n].copy()
    for i in range(1, k):
        out = out * _STEP + h[i : n + i]
    out = scrambled(out).view(np.int64)
    keep = np.zeros(n, bool)
    keep[1:] = True
    for begin, size in zip(begins.tolist(), sizes.tolist(), strict=True):
        own = out[begin : begin + size]
        own.sort()
    keep[1:] = out[1:] != out[:-1]
    inside = np.zeros(n + 1, np.int64)  # +1 where a text's runs begin, -1 after their end
    np.add.at(inside, begins[sizes > 0], 1)
    np.add.at(inside, (begins + sizes)[sizes > 0], -1)
    keep &= np.cumsum(inside[:n]) > 0
    keep[begins[sizes > 0]] = True
    upto = np.concatenate([[0], np.cumsum(keep)])
    ends = upto[np.minimum(begins + sizes, n)]
    return out[keep], np.concatenate([[0], ends])


def grams(text: str | None, k: int = 5) -> np.ndarray:
    """The set of a text's hashed k-word runs, sorted as signed values; empty if it has fewer words."""
    return gram_lists([text], k)[0].view(np.uint64)


def gram_sets(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, grams): each document's set as a sorted array of signed 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                values, offsets = gram_lists(part.column("text").to_pylist(), k)
                sets = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), sets], names=["doc_id", "grams"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, grams array<long>")


def family(count: int, seed: int = 41_017) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 1 << 32, count, np.uint64).astype(np.uint32), rng.integers(0, 1 << 32, count, np.uint64).astype(np.uint32) | np.uint32(1)


def minima(own: np.ndarray, hashes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least value of a set under each hash function."""
    high = (own.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(hashes[0]), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(high), 512):
        out = np.minimum(out, ((high[at : at + 512, None] ^ hashes[0]) * hashes[1]).min(0))
    return out
