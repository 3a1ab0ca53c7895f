"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes of a text: h = (h << 1) + GEAR[byte], in 32 bits, so a value depends on the
last 32 bytes alone. A chunk ends at the first white space at or after a place where h falls under a limit,
on average each MEAN bytes, or at that place itself, after its character, if no white space begins within REACH
bytes: so the ends depend on the content next to them, with or without white space, and an insertion changes the
chunks around it and no others. A chunk of over MOST bytes ends at its smallest hashes too, again and again. Where
the last 32 bytes repeat those of up to 32 bytes before and no white space is near, the hash tells no place from the
next, so none of these is an end; such periodic stretches alone are cut each MOST bytes from where they begin.
Every chunk has a 64-bit digest of its words. Of all chunks of one digest the first is kept, by (doc_id, hash
of the text, chunk number); later ones repeat it. Stretches of adjacent repeats are cut where they are
MIN_CHARS code points long or more, so a passage is found wherever it stands in a text, and neither a short
common phrase nor two chunks that share a digest by chance are cut. A text that is shorter than that has a digest
of all its words besides, which other such texts alone share: a later exact copy of it is cut whole, whatever its
length, while a short text that only stands within another stays.

The gear hash of a whole text is computed in five doubling steps on arrays: the sum over 2k bytes is the sum
over k bytes plus that of the k bytes before, shifted.

Null and empty texts have no chunks. Chunks of white space alone are never repeats. Null ids come first in the
order and are kept; ties in the id go by the hash of the text. Rows that repeat both id and text are one document, with the same
result. Other columns pass through whatever their names. Empty tables give no rows.

A very long text is chunked whole, by one row of a task; its chunks are one row each from there on.
Digests are counted before they meet rows, and meet them by ``join_counted``: a passage that a third of all documents share
is a row of its broadcast side. A stretch's ids of first copies are a set of at most as many as the stretch has chunks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, join_counted, key_columns, keyed, map_batches, table

MEAN = 32
MOST = 256
REACH = 64
MIN_CHARS = 100
#: The gear table: a random number for each byte, from a fixed seed.
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
CHUNKS = "d long, t long, digests array<long>, short long"
#: The chunk number of a short text as a whole: apart from chunk 0, so that no run joins the two.
WHOLE = -2


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling gear hash at each byte."""
    h = GEAR[data]
    width = 1
    while width < 32 and width < len(h):
        more = h.copy()
        more[width:] += h[:-width] << np.uint32(width)
        h, width = more, 2 * width
    return h


def places_to_end(data: np.ndarray, cut: np.ndarray, spaces: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks end for places: after the next run of white space if it is near, else after the character there; and if it is near."""
    k = np.searchsorted(spaces, cut)
    near = k < len(spaces)
    near[near] = spaces[k[near]] - cut[near] <= REACH
    ends = cut + 1
    ends[near] = last[np.searchsorted(last, spaces[k[near]])] + 1
    far = np.flatnonzero(~near & (ends < len(data)))
    while len(far := far[(data[ends[far]] & 0xC0) == 0x80]):  # not inside a character
        ends[far] += 1
        far = far[ends[far] < len(data)]
    return ends, near


def periodic(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the hash at places was there up to 32 bytes before."""
    found = np.zeros(len(at), bool)
    for back in range(1, 33):
        found |= (at >= back) & (h[np.maximum(at - back, 0)] == h[at])
    return found


def chunk_ends(raw: bytes, mean: int = MEAN, most: int = MOST) -> np.ndarray:
    """Ends of chunks, in bytes; each is the end of the text or follows white space or a character."""
    data = np.frombuffer(raw, np.uint8)
    h = gear_hashes(data)
    spaces = np.flatnonzero(SPACE[data])
    last = spaces[np.flatnonzero(np.append(np.diff(spaces) != 1, True))] if len(spaces) else spaces
    cut = np.flatnonzero(h < np.uint32((1 << 32) // mean))
    ends, near = places_to_end(data, cut, spaces, last)
    if not near.all():
        near[~near] = ~periodic(h, cut[~near])
        ends = ends[near]
    ends = np.unique(np.append(ends, len(data)))
    more, wide = [], long_ones(ends, most)
    while wide:
        a, b = wide.pop()
        at = np.arange(a, b)
        to, fit = places_to_end(data, at, spaces, last)
        if not fit.all():
            fit[~fit] = ~periodic(h, at[~fit])
        fit &= to < b
        if fit[32:].any():
            new = np.unique(to[fit & (h[a:b] == h[a + 32 : b][fit[32:]].min())])
            wide += [(int(x), int(y)) for x, y in zip(np.append(a, new), np.append(new, b), strict=True) if y - x > most]
        else:
            new = np.arange(a + most, b, most)
            while (inside := (data[new] & 0xC0) == 0x80).any():  # not inside a character
                new = new - inside
        more.append(new)
    return np.unique(np.concatenate([ends, *more]))


def long_ones(ends: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(begin, end) of chunks longer than ``most``."""
    begins = np.insert(ends[:-1], 0, 0)
    return [(int(begins[i]), int(ends[i])) for i in np.flatnonzero(ends - begins > most)]


def chunks(text: str | None) -> tuple[list[int], list[int], list[int]]:
    """Digests (0 for white space alone), begins and ends in code points."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [], [], []
    ends = chunk_ends(raw)
    begins = np.insert(ends[:-1], 0, 0)
    points = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    at = lambda x: np.where(x > 0, points[x - 1], 0).tolist()
    digests = []
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        words = raw[a:b].split()
        digests.append(xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63) if words else 0)
    return digests, at(begins), at(ends)


def short_digest(text: str | None, min_chars: int = MIN_CHARS) -> int | None:
    """A digest of all words of a text that has some and is too short for a run."""
    words = (text or "").encode("utf-8", "surrogatepass").split() if len(text or "") < min_chars else []
    return xxhash.xxh3_64_intdigest(b" ".join(words), seed=1) - (1 << 63) if words else None


def chunked(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(d, t, digests, short): the key of each document, the digests of its chunks, in order, and that of a short text."""
    read = docs.select(*key_columns(), F.col("text").cast("string").alias("text"))

    def found(cols):
        return {"d": cols["d"], "t": cols["t"], "digests": [chunks(x)[0] for x in cols["text"]], "short": [short_digest(x, min_chars) for x in cols["text"]]}

    return map_batches(read, found, CHUNKS)


def repeats(docs: DataFrame, scratch: Scratch, min_chars: int = MIN_CHARS) -> DataFrame:
    """(d, t, n_repeats, runs): for each document with chunks that occur earlier, its runs of adjacent ones, in order:
    the first chunk a, the last chunk b, and the ids of the documents that hold the first copies. A short text's copy has
    the run from WHOLE to WHOLE first."""
    each = scratch.save(chunked(docs, min_chars)).select("d", "t", F.size("digests").alias("n"), F.posexplode(F.array_append("digests", F.col("short"))).alias("k", "digest"))
    each = each.where("digest != 0").select("d", "t", F.when(F.col("k") < F.col("n"), F.col("k")).otherwise(WHOLE).alias("k"), "digest")
    place = F.struct("d", "t", "k")
    # Counting moves digests alone; only chunks whose digest occurs again go further.
    shared = scratch.save(each.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"))
    again = scratch.save(join_counted(each, shared, ["digest"]).drop("n"))
    firsts = scratch.save(again.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    later = join_counted(again, firsts, ["digest"]).where(place > F.col("first")).select("d", "t", "k", F.col("first.d").alias("source")).dropDuplicates(["d", "t", "k"])
    island = F.col("k") - F.row_number().over(W.partitionBy("d", "t").orderBy("k"))
    runs = later.withColumn("island", island).groupBy("d", "t", "island").agg(
        F.min("k").alias("a"), F.max("k").alias("b"), F.collect_set("source").alias("from"), F.count("*").alias("n")
    )
    return runs.groupBy("d", "t").agg(F.sum(F.when(F.col("a") >= 0, F.col("n")).otherwise(0)).alias("n_repeats"), F.sort_array(F.collect_list(F.struct("a", "b", "from"))).alias("runs"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def ends_of_runs(text: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
    """Begin and end of each run in code points, from its first and last chunk; null where there is no text."""
    out = []
    for t, a, b in zip(text, first, last, strict=True):
        if t is None:
            out.append(None)
            continue
        _, begins, ends = chunks(t)
        out.append([x for i, j in zip(a, b, strict=True) for x in ((begins[i], ends[j]) if i >= 0 else (0, ends[-1]))])
    return pd.Series(out, dtype=object)


def dedup_substrings(docs: DataFrame, scratch: Scratch, min_chars: int = MIN_CHARS) -> DataFrame:
    """(row, text, n_repeats, spans, sources): each row as it was, its text without repeated stretches, the stretches as
    (begin, end) in code points, and the ids of the documents that hold their first copies."""
    joined = keyed(docs).join(repeats(docs, scratch, min_chars).hint("shuffle_hash"), ["d", "t"], "left")
    text = F.col("row.text").cast("string")
    # Texts with runs alone are chunked again, which moves less than carrying all chunks' places along.
    places = ends_of_runs(F.when(F.col("runs").isNotNull(), text), F.col("runs.a"), F.col("runs.b"))
    placed = joined.select("row", "n_repeats", "runs", places.alias("places"))
    spans = F.transform("runs", lambda r, i: F.struct(F.get("places", 2 * i).alias("begin"), F.get("places", 2 * i + 1).alias("end"), r["from"].alias("from"), (r["a"] == WHOLE).alias("whole")))
    spans = F.filter(F.coalesce(spans, F.expr("array()")), lambda s: s["whole"] | (s["end"] - s["begin"] >= min_chars))
    found = placed.select("row", F.coalesce("n_repeats", F.lit(0)).alias("n_repeats"), spans.alias("spans"))
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))
    cut = F.aggregate(
        "spans",
        start,
        lambda acc, s: F.struct(F.concat(acc["kept"], F.substr(text, acc["at"] + 1, s["begin"] - acc["at"])).alias("kept"), s["end"].alias("at")),
        lambda acc: F.concat(acc["kept"], F.substr(text, acc["at"] + 1)),
    )
    return found.select(
        "row",
        F.when(F.size("spans") > 0, cut).otherwise(text).alias("text"),
        "n_repeats",
        F.transform("spans", lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: s["from"])))).alias("sources"),
    )


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of ``documents``: where they are, where they come from, and the text without them."""
    found = dedup_substrings(table(spark, sf_dir, "documents"), Scratch(spark, "substring-dedup"))
    removed = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"]), F.lit(0).cast("long"))
    spans = F.coalesce(F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["begin"], s["end"])), ","), F.lit(""))
    return found.select(
        F.col("row.doc_id").cast("long").alias("doc_id"), "n_repeats", removed.alias("n_removed"), spans.alias("spans"), "sources", "text"
    )
