"""Word shingles as 64-bit hashes, and their rare-first order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_in_arrow, parts_of

#: Places of the word-count sketch: a fixed size, whatever the corpus.
SKETCH = 1 << 20
MEMO_MAX = 150_000
#: Least bits of a set's signature: 2**9.
BITS = 512
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordHasher:
    """Texts to arrays of word hashes. On bytes, lower() changes A-Z alone, and split() splits at U+0020 and U+0009 to U+000D alone;
    ``split`` may be another function of lower-cased bytes."""

    def __init__(self, memo: dict[bytes, int] | None = None, split: Callable[[bytes], list[bytes]] = bytes.split):
        self.memo: dict[bytes, int] = {} if memo is None else memo
        self.split = split

    def words(self, text: str | None) -> list[bytes]:
        return self.split(text.encode("utf-8", "surrogatepass").lower()) if text else []

    def hashes(self, text: str | None) -> np.ndarray:
        return self.of(self.words(text))

    def of(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        try:
            return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(memo) > MEMO_MAX:  # a text's own words stay together until it is done
                memo.clear()
            for w in words:
                if w not in memo:
                    memo[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def places(words: np.ndarray) -> np.ndarray:
    """Where words are counted in the sketch."""
    return (words & np.uint64(SKETCH - 1)).astype(np.int64)


def word_counts(texts: DataFrame, split: Callable[[bytes], list[bytes]] = bytes.split, wanted: np.ndarray | None = None) -> np.ndarray:
    """How often the words of each place of the sketch occur in column ``text``, over all rows; with ``wanted``, of places that it marks alone."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = WordHasher(split=split), np.zeros(SKETCH, np.int64)
        for b in parts_of(batches):
            part = np.concatenate([places(hasher.hashes(text)) for text in b.column("text").to_pylist()])
            total += np.bincount(part, minlength=SKETCH)
        at = np.flatnonzero(total if shared is None else total * shared.value)
        yield pa.RecordBatch.from_pydict({"place": at.astype(np.int32), "n": total[at]})

    rows = map_in_arrow(texts.select(F.col("text").cast("string").alias("text")), run, "place int, n long")
    found = rows.groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # at most SKETCH rows
    total = np.zeros(SKETCH, np.int64)
    total[found["place"].to_numpy()] = found["n"].to_numpy()
    return total


def hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of the shingle that begins at each place. Fewer words than ``width`` make one shingle."""
    if not len(words):
        return words
    wide = min(width, len(words))
    n = len(words) - wide + 1
    h = np.full(n, np.uint64(wide), np.uint64)
    for i in range(wide):
        h = (h ^ words[i : i + n]) * M1
        h ^= h >> np.uint64(32)
    h *= M2
    return h ^ (h >> np.uint64(31))


def distinct(h: np.ndarray) -> np.ndarray:
    """Distinct hashes, ascending."""
    h = np.sort(h)
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def rarest(words: np.ndarray, h: np.ndarray, width: int, sketch: np.ndarray, n: int, repeats: int) -> np.ndarray:
    """The first ``n`` distinct shingles by the count of their rarest word, which bounds their own count, then by hash.
    ``repeats``: how many places hold a shingle that an earlier one holds."""
    counts, wide = sketch[places(words)], min(width, len(words))
    bound = counts[: len(h)]
    for i in range(1, wide):
        bound = np.minimum(bound, counts[i : i + len(h)])
    # as many places as hold n distinct shingles whatever repeats, with all that tie with the last
    enough = min(len(h), n + repeats)
    near = np.flatnonzero(bound <= np.partition(bound, enough - 1)[enough - 1])
    order = near[np.lexsort((h[near], bound[near]))]
    found = h[order]
    return found[np.append(True, found[1:] != found[:-1])][:n]


def signature(found: np.ndarray, bits: int | None = None) -> np.ndarray:
    """Bits as longs, a power of two of them, as many as shingles or more (BITS at least): for each place of the hash, whether an odd
    number of shingles is there. Where two signatures differ, at least one shingle is in one set alone, so differing bits bound the
    sets' symmetric difference from below. Halves that are combined by exclusive or are the signature of half as many bits."""
    bits = bits or max(BITS, 1 << max(0, len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)
