"""Quality, decontamination, mixing and the pipeline against plain versions, and on odd rows."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablewright.llm import decontam, mixing, ngram_join, quality
from tablewright.llm import shingles as S
from tablewright.llm.common import Scratch
from tablewright.llm.registry import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


# Quality


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.classify(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.93
    assert np.mean([r["predicted"] for r in held if r["quality"] == 1]) > 0.97


def test_training_never_reads_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality.train(docs, labels) == quality.train(docs, flipped)).all()
    assert quality.training_rows(docs, labels, 5).count() == 5


def plain_training(rows):
    """FTRL-proximal on dicts of places, an example at a time; ``rows`` in the order of training."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return (math.copysign(quality.L1, z[i]) - z[i]) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for epoch in range(quality.EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            x, y = rows[k]
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(weight(i) * v for i, v in x.items())))))
            for i, v in x.items():
                w, g = weight(i), (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_training_equals_a_plain_loop(spark):
    docs, labels = spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet")
    texts, hasher = {r["doc_id"]: r["text"] for r in docs.collect()}, quality.Hasher()
    order = [r["doc_id"] for r in spark.createDataFrame([(d,) for d in texts], "doc_id long").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    marks = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    rows = []
    for d in order:
        if d in marks and d in texts:
            count = Counter(hasher.places(texts[d]).tolist())
            rows.append(({0: 1.0} | {i: float(np.float32(k * quality.SCALE / sum(count.values()))) for i, k in count.items()}, marks[d]))
    want, got = plain_training(rows), quality.train(docs, labels)
    assert len(rows) > 30 and all(abs(got[i] - w) < 1e-9 for i, w in want.items()) and not got[sorted(set(range(len(got))) - set(want))].any()
    scored = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    for d, text in texts.items():
        count = Counter(hasher.places(text).tolist())
        dot = want.get(0, 0) + sum(want.get(i, 0) * k * quality.SCALE / sum(count.values()) for i, k in count.items())
        assert scored[d] == pytest.approx(1 / (1 + math.exp(-dot)), abs=1e-6)


def test_training_bounds_hold(spark, monkeypatch):
    """Ids that repeat bring one text each, and features have a bound beside rows."""
    docs = spark.createDataFrame([(i, f"text {i} {k}") for i in range(4) for k in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    updates = []

    def weights(most, rows=2):
        return quality.train(docs, labels, rows, most)

    chosen = quality.training_rows(docs, labels, 2).select("doc_id").distinct().count()
    assert chosen == 2 and np.count_nonzero(weights(1 << 20)) <= 2 * 6
    one = docs.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    assert (quality.train(one, labels, 2) == weights(1 << 20)).all()  # as if each id had one text
    assert not weights(3).any() and weights(1 << 20).any() and not updates


def test_ftrl_is_a_logistic_regression():
    rng, model = np.random.default_rng(1), quality.Ftrl.empty()
    for _ in range(2_000):
        y = float(rng.random() < 0.5)
        model.update(np.array([5 if y else 6, 0]), np.array([1.0, 1.0]), y)
    w = model.weights()
    assert w[5] > 1 and w[6] < -1 and not w[7:].any()


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a"), (1, None), (2, ""), (2, ""), (3, "x " * 100_000), (4, "😀")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.classify(docs, none).collect()} == {0.5}
    odd = spark.createDataFrame([(3, 1), (3, 0), (4, None), (None, 1), (2, 7)], "doc_id long, quality int")
    assert quality.classify(docs, odd).count() == 6
    assert quality.classify(docs.limit(0), odd).count() == 0
    wide = docs.withColumns({"score": F.lit(1), "row": F.lit("r")})
    assert quality.good(wide, none).columns == wide.columns and quality.good(wide, none).count() == 6
    clash = docs.withColumns({c: F.lit("c") for c in ("score", "h", "label", "id", "places", "values")})
    assert quality.classify(clash, odd).count() == 6


# Decontamination


def plain_contamination(text, items, window=10):
    w = ITEM_WORD.findall((text or "").translate(UPPER))
    hit, owners = set(), set()
    for item, t in items:
        y = ITEM_WORD.findall((t or "").translate(UPPER))
        for k in range(max(1, len(y) - window + 1)) if y and item is not None else ():
            part = y[k : k + window]
            for a in range(len(w) - len(part) + 1):
                if w[a : a + len(part)] == part:
                    hit.update(range(a, a + len(part)))
                    owners.add(item)
    return len(w), len(hit), len(owners), hashlib.sha256(",".join(sorted(map(str, owners))).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("broadcast,bits", [(50_000, 28), (0, 28), (50_000, 6)])
def test_decontamination(spark, broadcast, bits, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", broadcast)
    if bits < 16:  # nearly every shingle passes the bitmap
        monkeypatch.setattr(decontam.Bitmap, "of", staticmethod(lambda tokens, n: decontam.Bitmap(bits, np.full(1, ~np.uint64(0)))))
    rnd = random.Random(3)
    vocabulary = "a b c É ñ9 d".split()
    rows = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60)))) for i in range(120)] + [(None, "a b"), (500, None), (501, "A-B c"), (502, ""), (0, "a")]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 2, 3, 4, 5, 6, 9, 10, 11, 14])))) for i in range(30)] + [(3, "b c"), (None, "a"), (8, None)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, items int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(docs, bench, Scratch(spark, "test"))
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, got.select(*cols).collect()), key=repr) == sorted([(i, *plain_contamination(t, items)) for i, t in rows], key=repr)
    if broadcast and bits == 28:
        left = decontam.clean(docs, bench, Scratch(spark, "test"))
        assert left.columns == docs.columns
        assert sorted(map(tuple, left.select("doc_id", "text").collect()), key=repr) == sorted([(i, t) for i, t in rows if not plain_contamination(t, items)[4]], key=repr)
        assert decontam.contamination(docs.limit(0), bench, Scratch(spark, "test")).count() == 0
        assert decontam.contamination(docs, bench.limit(0), Scratch(spark, "test")).where("contaminated").count() == 0


def test_words_are_those_of_the_pattern():
    rnd = random.Random(8)
    for _ in range(500):
        text = "".join(rnd.choice("abZ09 \t\n\x00\x1f\x7f\x85\xa0é漢😀`{[@:/") for _ in range(30))
        assert [w.decode() for w in decontam.hasher_of({}).words(text)] == ITEM_WORD.findall(text.translate(UPPER))


def test_prefix_is_the_rarest_shingle():
    words = S.WordHasher().hashes("a b c d e f g h i j k")
    counts = np.zeros(S.SKETCH, np.int64)
    counts[S.places(words)] = [9, 9, 9, 1, 9, 9, 9, 9, 9, 9, 2]
    h = S.hashes(words, 5)
    token, at, size, wide = decontam.prefixes(words, counts, 10, 5)
    assert (size, wide) == (10, 5)
    # of the shingles with word d, or with k for the last window, the one of the smallest hash
    for k, (t, p) in enumerate(zip(token.tolist(), at.tolist(), strict=True)):
        rare = [i for i in range(k, k + 6) if i <= 3]
        assert t == h[k + p] == min(h[i] for i in rare)


def test_repeated_shingles_in_a_window_take_the_first():
    words = S.WordHasher().hashes("a a a a a a a a a a b")
    token, at, _, _ = decontam.prefixes(words, np.zeros(S.SKETCH, np.int64), 10, 5)
    same = S.hashes(words, 5)[0]
    assert all(p == 0 for t, p in zip(token, at, strict=True) if t == same)


def test_decontamination_of_very_long_texts(spark):
    rnd = random.Random(5)
    prose = lambda n: " ".join(f"w{rnd.randrange(500)}" for _ in range(n))
    long_word = "x" * 5_000
    items = [(1, prose(30_000)), (2, "same " * 20_000), (3, f"{long_word} b"), (4, f"{long_word}y b")]
    texts = [prose(20_000) + " " + " ".join(items[0][1].split()[12_000:12_030]) + " " + prose(20_000), "same " * 30_000, f"a {long_word} b c", "Z" * 200_000, "a\n" * 50_000]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontam.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), Scratch(spark, "test")).collect()}
    assert got == {0: (40_030, 30, [1]), 1: (30_000, 30_000, [2]), 2: (4, 2, [3]), 3: (1, 0, []), 4: (50_000, 0, [])}


def test_decontamination_reads_documents_in_one_stage(spark):
    """However many windows there are, a document goes through one Python worker that looks for them."""
    rnd = random.Random(6)
    items = spark.createDataFrame([(i, " ".join(f"v{rnd.randrange(5_000)}" for _ in range(40))) for i in range(2_000)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(f"v{rnd.randrange(5_000)}" for _ in range(50))) for i in range(20)], "doc_id long, text string")
    plan = decontam.contamination(docs, items, Scratch(spark, "test"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 0  # what is left reads tables
    tokens = decontam.Bitmap.of(spark.range(5).withColumnRenamed("id", "token"), 5)
    assert decontam.places_of(docs, tokens, [5], 10, 5)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {0, 1, 2, 3, 4} <= set(tokens.holds(np.arange(5, dtype=np.uint64)).tolist())


# Mixing


def check_mix(rows, sizes):
    by_source = defaultdict(list)
    for r in rows:
        by_source[r["source"]].append(r)
    total = sum(sizes.values())
    assert abs(sum(own[0]["target"] for own in by_source.values()) - 1.5 * total) < 1e-6 * max(1, total)
    for own in by_source.values():
        size, target, most = own[0]["source_size"], own[0]["target"], max(r["size"] for r in own)
        assert size == sum(r["size"] for r in own) and target <= 2 * size + 1e-6
        assert all(r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - target) <= 2 * most + 1


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 50)
    rnd = random.Random(4)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 5, 5, 5, 40])), rnd.choice(["a", "a", "a", "b", "É", "Z", "", None])) for i in range(600)]
    rows += [(5, rows[5][1], rows[5][2]), (None, "x y", "a"), (700, None, "empty")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, place int")
    got = mixing.mix(docs, Scratch(spark, "test"))
    found = got.collect()
    assert len(found) == len(rows)
    check_mix(found, dict(enumerate(len((t or "").split()) for _, t, _ in rows)))
    again = mixing.mix(docs.repartition(7).orderBy(F.desc("text")), Scratch(spark, "test")).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))
    assert mixing.mix(docs.limit(0), Scratch(spark, "test")).count() == 0
    assert {r["copies"] for r in mixing.mix(docs.where("doc_id = 700"), Scratch(spark, "test")).collect()} == {0}


def test_targets_equal_repeated_sharing(spark):
    sizes = {"a": 100, "b": 1, "c": 50, "d": 7, "e": 300, None: 20}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    order = [*sorted(k for k in sizes if k), None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    want, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        share = {k: left * weight[k] / sum(weight[x] for x in free) for k in free}
        over = {k for k in free if share[k] > 2 * sizes[k]}
        if not over:
            want |= share
            break
        for k in over:
            want[k] = 2.0 * sizes[k]
            left -= want[k]
        free -= over
    assert got == pytest.approx(want)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    want, got = con.execute(ORACLE_SQL[name]).df(), QUERIES[name](spark, SF_DIR).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    text = lambda x: sorted(map(str, x[cols].astype(float).itertuples(index=False)))
    assert text(want) == text(got)


# Pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumns({"row": F.lit("r"), "component_id": F.lit(1), "score": F.lit(2.0)})
    scratch = Scratch(spark, "test")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(scratch.save(stage(spark, seen[-1], SF_DIR)))
    assert all(x.columns == docs.columns for x in seen[:-1])
    ids = [{r["doc_id"] for r in x.select("doc_id").collect()} for x in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and ids[-1]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    clean = [d for d, q in labels.items() if q == 1]
    assert sum(d in ids[1] for d in clean) >= 0.95 * len(clean)
    near = {r["component_id"] for r in ngram_join.join(seen[2], scratch)[0].where("n_shingles > 0").collect()}
    assert {r["doc_id"] for r in seen[3].collect() if (r["text"] or "").split()} == near
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    assert ids[4] == {r["doc_id"] for r in seen[3].collect() if not plain_contamination(r["text"], items)[4]}
    assert seen[5].where("copies < 1").count() == 0
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])


def test_pipeline_runs(spark):
    got = corpus_pipeline.run(spark, SF_DIR)
    assert got.count() > 0 and set(got.columns) >= {"doc_id", "source", "copies", "taken"}


def test_empty_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = Scratch(spark, "test").save(stage(spark, docs, SF_DIR))
        assert docs.count() == 0
