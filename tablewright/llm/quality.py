"""Quality classifier: hashed word n-gram logistic regression, trained with FTRL-proximal updates.

A text becomes hashed word unigrams and bigrams. Words are lower-cased; a word in capitals, a word equal
to the one before and each punctuation mark give tokens of their own, so that n-grams also show shouting,
stutter and symbol noise. A feature's value is its share of the text's n-grams times SCALE. Training runs
over a bounded sample of labelled rows, which one task holds: at most TRAIN_ROWS ids, one text for each, and at most
TRAIN_FEATURES features of them all. Scoring is a sparse dot product with a dense
weight vector of fixed size (2**BITS doubles), the only thing that is broadcast beside the sample's ids.

Null and empty texts have the bias feature alone and score what it says. Very long texts are read whole. Without any usable
label, and in an empty table, all weights are 0 and every score is 0.5. Labels other than 0 and 1, and those of a null id, are
not used; a document with several labels counts as 1 where their mean is at least 0.5. Of an id with several texts, training
reads the one of the smallest hash; equal texts are one. Rows of documents are kept one
to one; a null id counts as not held out. Language, source, id and labels are never features. Other columns are not read by
``classify``, whatever their names; ``good`` returns them as they are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filter_batches, id_and_text, map_batches, map_in_arrow, table

BITS = 18
#: Most labelled documents that training reads: the first by a hash of the id. Bounds the training task and the join's small side.
TRAIN_ROWS = 16_000
#: Most features, over all texts, that the training task holds, in 8 bytes each; texts that come after are not read. Bounds its memory where texts are long.
TRAIN_FEATURES = 16_000_000
EPOCHS = 3
SCALE = 12.0
#: FTRL-proximal: learning rate and its smoothing, L1 and L2 strength.
ALPHA, BETA, L1, L2 = 0.25, 1.0, 0.002, 0.05
TOKEN = re.compile(r"\w+|[^\w\s]")
MASK = np.uint64((1 << BITS) - 1)
CACHE_MAX = 150_000


class Hasher:
    """Text -> hashed feature places, with a bounded memo of word hashes."""

    def __init__(self, memo: dict[str, int] | None = None):
        self.memo: dict[str, int] = {} if memo is None else memo

    def word(self, w: str) -> int:
        if (h := self.memo.get(w)) is None:
            if len(self.memo) >= CACHE_MAX:
                self.memo.clear()
            # the hash of the lower-cased word; the lowest bit of the upper half says whether it is in capitals
            h = self.memo[w] = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) | (len(w) > 1 and w.isupper()) << 32
        return h

    def places(self, text: str | None) -> np.ndarray:
        """Feature places, repeated as often as they occur; the bias feature, place 0, isn't among them."""
        found = TOKEN.findall(text or "")
        if not found:
            return np.zeros(0, np.int64)
        raw = np.fromiter(map(self.word, found), np.uint64, len(found))
        ids, capitals = raw & np.uint64(0xFFFFFFFF), (raw >> np.uint64(32)).astype(bool)
        stutter = ids[1:] == ids[:-1]
        marks = np.concatenate([np.full(int(capitals.sum()), 0x1F0F0F0F1, np.uint64), np.full(int(stutter.sum()), 0x1E0E0E0E1, np.uint64)])
        pairs = (ids[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (ids[1:] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))
        h = np.concatenate([ids, marks, pairs]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        return (((h >> np.uint64(40)) & MASK) % np.uint64((1 << BITS) - 1)).astype(np.int64) + 1


@dataclass
class Ftrl:
    """Per-coordinate FTRL-proximal state."""

    z: np.ndarray
    n: np.ndarray

    @staticmethod
    def empty() -> Ftrl:
        return Ftrl(np.zeros(1 << BITS), np.zeros(1 << BITS))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def features(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, count = np.unique(places, return_counts=True)
    return np.append(at, 0), np.append(count * (SCALE / max(1, len(places))), 1.0)


def held_out(doc_id) -> F.Column:
    """Rows that training never reads."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, label, h), all rows of at most ``rows`` labelled ids outside the held-out third; h is a hash of the text."""
    quality = F.col("quality").cast("int")
    marked = labels.select(F.col("doc_id").cast("long").alias("id"), quality.alias("quality"))
    marked = marked.where(F.col("id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("id")))
    chosen = marked.groupBy("id").agg((F.avg("quality") >= 0.5).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(rows)
    # At most ``rows`` ids are on the small side, so it may be broadcast.
    return id_and_text(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("doc_id", "text", "label", F.xxhash64("text").alias("h"))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most: int = TRAIN_FEATURES) -> np.ndarray:
    """The weight vector."""

    memo: dict[str, int] = {}

    def extract(cols: dict) -> dict:
        hasher, out = Hasher(memo), {k: cols[k] for k in ("doc_id", "label", "h")} | {"places": [], "values": []}
        for text in cols["text"]:
            at, x = features(hasher.places(text))
            out["places"].append(at.astype(np.int32))
            out["values"].append(x.astype(np.float32))
        return out

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for at, x, y in zip(b.column("places"), b.column("values"), b.column("label").to_pylist(), strict=True):
                held += len(at.values)
                if held <= most:  # copies, as a part of a batch would keep it whole
                    rows.append((at.values.to_numpy().copy(), x.values.to_numpy().copy(), float(y)))
        model = Ftrl.empty()
        for epoch in range(EPOCHS):
            for k in np.random.default_rng(epoch).permutation(len(rows)):
                model.update(*rows[k])
        yield pa.RecordBatch.from_pydict({"weights": [model.weights().tobytes()]}, schema=pa.schema([("weights", pa.binary())]))

    found = map_batches(training_rows(docs, labels, rows), extract, "doc_id long, label int, h long, places array<int>, values array<float>")
    # Rows that repeat an id are combined before they are shuffled, so one for each id reaches the task that trains.
    found = found.groupBy("doc_id", "label").agg(F.min_by(F.struct("places", "values"), "h").alias("x")).select("doc_id", "label", "x.places", "x.values")
    one = found.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "label")
    model = map_in_arrow(one, fit, "weights binary").first()
    return np.frombuffer(model["weights"], float) if model else np.zeros(1 << BITS)


def scorer(docs: DataFrame, weights: np.ndarray) -> Callable[[list], list[float]]:
    """Texts -> probabilities of label 1, for use on executors."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    memo: dict[str, int] = {}  # one for all parts that a task scores

    def run(texts: list) -> list[float]:
        w, hasher, out = shared.value, Hasher(memo), []
        for text in texts:
            places = hasher.places(text)
            dot = w[0] + (SCALE / max(1, len(places))) * float(w[places].sum())
            out.append(float(1.0 / (1.0 + np.exp(-min(35.0, max(-35.0, dot))))))
        return out

    return run


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score): the probability of label 1 for each row."""
    run = scorer(docs, weights)
    return map_batches(id_and_text(docs), lambda cols: {"doc_id": cols["doc_id"], "score": run(cols["text"])}, "doc_id long, score double")


def good(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are predicted to have label 1."""
    run = scorer(docs, train(docs, labels, rows))
    return filter_batches(docs, lambda texts: [p >= 0.5 for p in run(texts)])


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    return score(docs, train(docs, labels, rows)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every whole text of ``documents``, learnt from ``labels`` outside the held-out third."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
