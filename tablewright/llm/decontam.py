"""Benchmark decontamination by a prefix-filtered set join.

Words are lower-cased (A-Z alone) runs of the letters, digits and non-ASCII characters that WORD names. An
item's windows are its WINDOW consecutive words, or all its words where it has fewer. Each window is a
sequence of shingles, SHINGLE words each (or the whole window where it is shorter).

1. Shingles are ordered by rarity: by the count of their rarest word over all documents, in a sketch of fixed
   size, then by hash. The count bounds a shingle's own; any order that all windows share is right.
2. Exact containment of a window needs its rarest shingle, so that one is the window's prefix, and its only
   token in the join. Each window is one row: token, place of the token in it, size, words.
3. One pass over the documents keeps the places whose shingle may be a prefix token, by a bitmap of all tokens
   (at most 2**MAX_BITS bits, whatever the benchmark), with the words around them. These rows, and no others,
   are joined with the windows on the token.
4. Length and positional bounds discard places where the window would begin before the document or end after
   it. What is left is verified exactly over the window: all its words must stand there. Words of over LONG
   bytes are compared by 128-bit digests.

Tokens that a third of all documents share cost no task more than others: windows are broadcast where they are
at most BROADCAST_WINDOWS rows, and dealt out over SALTS copies beyond that.

Null texts have no words, empty texts neither. Items of a null id are not used; items without words have no
window; items that repeat an id add windows to it. Document rows are kept one to one, so repeated rows, null
ids and ties need no rule. A very long text is one row of the pass and gives a row for each of its places that
the bitmap lets through, with WINDOW words on each side at most; spans are merged by a sort that may spill. Without
documents there are no rows; without items no document is hit. Other columns are not read, so their names
can't clash; ``clean`` returns them all.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shingles as S
from .common import NO_ID, Scratch, key_columns, map_batches, map_in_arrow, pa_schema, parts_of, table, without

WINDOW = 10
SHINGLE = 5
LONG = 32
MAX_BITS = 28
BROADCAST_WINDOWS = 50_000
SALTS = 16
#: Windows of a long item that are handed on at a time.
STEP = 10_000
#: On bytes, lower() changes A-Z alone, and every byte of a non-ASCII character is 0x80 or more.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Every byte that is in no word as a blank, so that the words are what is between blanks.
BLANKED = bytes(b if WORD.match(bytes([b])) else 32 for b in range(256))
WINDOWS = "item long, token long, at int, size int, wide int, words string"
PLACES = "doc_id long, d long, t long, n_words long, place array<int>, token array<long>, first array<int>, around array<string>"
KEY = ["d", "t"]
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def joined(words: list[bytes]) -> str:
    """Words with a blank between them. A long word stands as its digest after a zero byte, which no word has."""
    return b" ".join(w if len(w) <= LONG else b"\0" + hashlib.blake2b(w, digest_size=16).hexdigest().encode() for w in words).decode("utf-8", "surrogatepass")


def split_words(raw: bytes) -> list[bytes]:
    """The matches of WORD in lower-cased bytes."""
    return raw.translate(BLANKED).split()


def hasher_of(memo: dict[bytes, int]) -> S.WordHasher:
    return S.WordHasher(memo, split_words)


def prefixes(words: np.ndarray, counts: np.ndarray, window: int, width: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """For each window of an item: the token of its rarest shingle and the place of that within it; then the windows' size and
    the shingles' width."""
    size = min(window, len(words))
    wide = min(width, size)
    h = S.hashes(words, wide)
    rare, n = counts[S.places(words)], len(h)
    bound = np.min([rare[i : i + n] for i in range(wide)], axis=0)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((h, bound))] = np.arange(n)
    _, equal = np.unique(h, return_inverse=True)  # equal shingles have one rank, so that the first of them is taken
    low = np.full(n, n)
    np.minimum.at(low, equal, rank)
    at = np.lib.stride_tricks.sliding_window_view(low[equal], size - wide + 1).argmin(axis=1)
    return h[np.arange(len(at)) + at], at, size, wide


def windows_of(benchmark: DataFrame, counts: np.ndarray, window: int, width: int) -> DataFrame:
    """A row for each window of each item: WINDOWS."""
    shared = benchmark.sparkSession.sparkContext.broadcast(counts)
    schema, memo = pa_schema(WINDOWS), {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = hasher_of(memo)
        for b in parts_of(batches):
            for item, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = hasher.words(text)
                if not words:
                    continue
                token, at, size, wide = prefixes(hasher.of(words), shared.value, window, width)
                for i in range(0, len(at), STEP):
                    own = range(i, min(i + STEP, len(at)))
                    cols = {"item": [item] * len(own), "token": token[i : i + STEP].view(np.int64), "at": at[i : i + STEP].astype(np.int32)}
                    cols |= {"size": [size] * len(own), "wide": [wide] * len(own), "words": [joined(words[k : k + size]) for k in own]}
                    yield pa.RecordBatch.from_pydict(cols, schema=schema)

    items = benchmark.select(F.col("item_id").cast("long").alias("item"), F.col("text").cast("string").alias("text"))
    return map_in_arrow(items.where("item is not null and text is not null"), run, WINDOWS)


class Bitmap:
    """A set of 64-bit tokens with false positives, in bits of a bounded number."""

    def __init__(self, log2: int, words: np.ndarray):
        self.log2, self.words = log2, words

    @staticmethod
    def spots(h: np.ndarray, mix: np.uint64, log2: int) -> np.ndarray:
        return (h * mix) >> np.uint64(64 - log2)

    def holds(self, h: np.ndarray) -> np.ndarray:
        """Places in ``h`` whose token may be in the set."""
        at = np.arange(len(h))
        for mix in MIX:
            spot = self.spots(h[at], mix, self.log2)
            at = at[(self.words[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1]
        return at

    @staticmethod
    def of(tokens: DataFrame, n: int) -> Bitmap:
        """From column ``token``; some 32 bits for each of ``n`` tokens, within bounds."""
        log2 = min(MAX_BITS, max(16, (32 * n).bit_length()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h = b.column("token").to_numpy(zero_copy_only=False).view(np.uint64)
                spot = np.concatenate([Bitmap.spots(h, mix, log2) for mix in MIX])
                cols = {"word": (spot >> np.uint64(6)).astype(np.int32), "bits": (np.uint64(1) << (spot & np.uint64(63))).view(np.int64)}
                yield pa.RecordBatch.from_pydict(cols)

        found = map_in_arrow(tokens.select("token"), run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most 2**MAX_BITS / 64 rows
        words = np.zeros(1 << (log2 - 6), np.uint64)
        words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
        return Bitmap(log2, words)


def places_of(docs: DataFrame, tokens: Bitmap, widths: list[int], window: int, width: int) -> DataFrame:
    """Step 3: (doc_id, d, t, n_words, and for each place that may hold a token: place, token, the words around it from word ``first`` on)."""
    shared = docs.sparkSession.sparkContext.broadcast(tokens)
    memo: dict[bytes, int] = {}

    def run(cols: dict) -> dict:
        hasher = hasher_of(memo)
        out: dict = {"doc_id": cols["doc_id"], "d": cols["d"], "t": cols["t"], "n_words": [], "place": [], "token": [], "first": [], "around": []}
        for text in cols["text"]:
            words = hasher.words(text)
            ids, own = hasher.of(words), {k: [] for k in ("place", "token", "first", "around")}
            for wide in widths:
                if len(words) < wide:
                    continue
                h = S.hashes(ids, wide)
                # a shingle that is shorter than the others is a whole window
                before, after = (window - width, window) if wide == width else (0, wide)
                for p in shared.value.holds(h).tolist():
                    first = max(0, p - before)
                    own["place"].append(p)
                    own["token"].append(int(h[p].astype(np.int64)))
                    own["first"].append(first)
                    own["around"].append(joined(words[first : p + after]))
            out["n_words"].append(len(words))
            for k, v in own.items():
                out[k].append(v)
        return out

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *key_columns(), F.col("text").cast("string").alias("text"))
    return map_batches(read, run, PLACES)


def meet(rows: DataFrame, few: DataFrame, key: str, n: int, spread: list[str]) -> DataFrame:
    """``rows`` with the ``n`` rows of ``few`` that have the same ``key``: a broadcast, or copies of ``few`` where it is large, over
    which ``rows`` are dealt by ``spread``."""
    if n <= BROADCAST_WINDOWS:
        return rows.join(F.broadcast(few), key)
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)))
    return dealt.join(few.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [key, "salt"]).drop("salt")


def contamination(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, window: int = WINDOW, width: int = SHINGLE) -> DataFrame:
    """One row per document: its words, the words inside an occurring window, and the items that these belong to."""
    own = S.word_counts(benchmark, split_words) > 0
    windows = scratch.save(windows_of(benchmark, S.word_counts(docs, split_words, own), window, width))
    distinct = scratch.save(windows.drop("item").distinct())
    owners = scratch.save(windows.select("words", "item").distinct())
    n, m = distinct.count(), owners.count()
    widths = sorted(r["wide"] for r in distinct.select("wide").distinct().collect())  # at most SHINGLE rows
    rows = scratch.save(places_of(docs, Bitmap.of(distinct, n), widths, window, width))

    each = rows.where(F.size("place") > 0).select(*KEY, "n_words", F.inline(F.arrays_zip("place", "token", "first", "around")))
    begin = F.col("place") - F.col("at")
    near = meet(each, distinct.drop("wide"), "token", n, [*KEY, "place"]).where((begin >= 0) & (begin + F.col("size") <= F.col("n_words")))
    there = F.array_join(F.slice(F.split("around", " "), begin - F.col("first") + 1, F.col("size")), " ")
    # Rows that repeat id and text have the same spans, which count once from here on.
    spans = scratch.save(near.where(there == F.col("words")).select(*KEY, begin.alias("begin"), (begin + F.col("size")).alias("end"), "words").distinct())

    order = W.partitionBy(*KEY).orderBy("begin", "end").rowsBetween(W.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(order), F.lit(0))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("begin", reach)).cast("long")
    hits = spans.select(*KEY, "begin", "end").distinct().withColumn("new", new).groupBy(*KEY).agg(F.sum("new").alias("n_hit"))
    items = meet(spans.select(*KEY, "words").distinct(), owners, "words", m, KEY).groupBy(*KEY).agg(F.collect_set("item").alias("items"))
    found = hits.join(items, KEY)
    listed = F.sort_array(F.coalesce("items", F.array().cast("array<long>")))
    n_hit = F.coalesce("n_hit", F.lit(0))
    digest = F.sha2(F.array_join(F.array_sort(F.transform(listed, lambda x: x.cast("string"))), ","), 256)
    return rows.select("doc_id", *KEY, "n_words").join(found, KEY, "left").select(
        "doc_id", "t", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), digest.alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), listed.alias("items"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no window of ``benchmark``."""
    found = scratch.save(contamination(docs, benchmark, scratch).where("contaminated").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), "t"))
    return without(docs, found)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every whole text of ``documents`` with windows of ``benchmark``."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "decontam")).drop("t")
