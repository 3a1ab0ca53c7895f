"""Line, near-duplicate and substring dedup against plain versions, and on odd rows."""

import random
import re
import time
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tablewright.llm import line_dedup, ngram_join, shingles, substring_dedup
from tablewright.llm.common import FREED, NO_ID, Scratch, join_counted
from tablewright.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_lines(docs, least):
    """Line numbers to delete: of every run of at least ``least`` words that occurs earlier."""
    first, out = set(), []
    for text in docs:
        lines = [(n, x, len(WORD.findall(x))) for n, x in enumerate((text or "").split("\n")) if WORD.search(x)]
        gone, new = set(), set()
        for i in range(len(lines)):
            words = 0
            for j in range(i, len(lines)):
                words += lines[j][2]
                if words >= least:
                    key = tuple(x[1] for x in lines[i : j + 1])
                    if key in first or key in new:
                        gone.update(range(lines[i][0], lines[j][0] + 1))
                    new.add(key)
        first |= new
        for a, b in zip(lines, lines[1:], strict=False):
            if a[0] in gone and b[0] in gone:
                gone.update(range(a[0], b[0]))
        out.append(gone)
    return out


@pytest.mark.parametrize("seed,least", [(1, 1), (2, 3), (3, 5), (4, 9)])
def test_line_dedup(spark, seed, least):
    rnd = random.Random(seed)
    lines = ["a b", "c", "d e f", "", "  ", "g h i j", "k"] + [f"u{i} v" for i in range(6)]
    texts = ["\n".join(rnd.choice(lines) for _ in range(rnd.randint(0, 14))) for _ in range(60)]
    texts += [texts[3], texts[4], None, "", "x" * 50_000, "\n".join(["hot line here"] * 40)]
    docs = spark.createDataFrame([(i, t, "r", i) for i, t in enumerate(texts)], "doc_id long, text string, row string, t int")
    got = {r["row"]["doc_id"]: r for r in line_dedup.dedup_lines(docs, Scratch(spark, "test"), least).collect()}
    for i, (t, gone) in enumerate(zip(texts, plain_lines(texts, least), strict=True)):
        want = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)
        assert got[i]["text"] == want, (i, t)


def test_line_dedup_odd_rows(spark):
    run = "one two three\nfour five six"
    rows = [(None, run, 5), (1, run, 5), (2, f"{run}\nmore", 5), (2, f"{run}\nmore", 5), (3, "", 0), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = line_dedup.cleaned(docs, Scratch(spark, "test"), 6)
    assert out.columns == docs.columns
    got = sorted([tuple(r) for r in out.collect()], key=repr)
    assert got == sorted([(None, run, 5), (2, "more", 4), (2, "more", 4), (3, "", 0), (4, None, None)], key=repr)
    assert line_dedup.cleaned(docs.limit(0), Scratch(spark, "test")).count() == 0


def test_line_dedup_is_native(spark):
    df = line_dedup.op10_line_dedup(spark, "/root/testdata/sf0.001")
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def plain_components(rows, width, percent):
    sets = {}
    for d, t in rows:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(t or "")]
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    label = {d: d for d in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {d: (len(sets[d]), label[d]) for d in sets}


def near_copies(seed, n=160):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[rnd.choice(vocabulary) for _ in range(rnd.choice([3, 5, 12, 40, 90]))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(rnd.choice(bases[:3] if i % 2 else bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        text = " ".join(words)
        rows.append((i, text.upper() if i % 7 == 0 else text))
    return rows


@pytest.mark.parametrize("seed,width,percent", [(1, 4, 85), (2, 5, 80), (3, 2, 60), (4, 4, 85)])
def test_ngram_join(spark, seed, width, percent, monkeypatch):
    if seed == 4:  # hot lists: small windows, several rounds, joins instead of broadcasts
        monkeypatch.setattr(ngram_join, "CHUNK", 7)
        monkeypatch.setattr(ngram_join, "BLOCK", 5)
        monkeypatch.setattr(ngram_join, "ENOUGH", 0)
        monkeypatch.setattr(ngram_join, "SHRINK", 1.0)
        monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    rows = near_copies(seed) + [(900, ""), (901, None), (902, " \n"), (903, "one"), (904, "ONE"), (905, "É a"), (906, "é a")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, rid long, c string")
    membership, links = ngram_join.join(docs, Scratch(spark, "test"), width, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in membership.collect()} == plain_components(rows, width, percent)
    assert links.groupBy("a", "b").count().where("count > 1").count() == 0  # each pair is verified once


def test_ngram_join_odd_rows(spark):
    words = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(None, words), (5, words), (5, words), (7, words + " x"), (8, "")], "doc_id long, text string")
    got = sorted([tuple(r) for r in ngram_join.join(docs, Scratch(spark, "test"))[0].select("doc_id", "component_id").collect()], key=repr)
    assert got == sorted([(None, None), (5, 5), (5, 5), (7, 5), (8, 8)], key=repr)
    kept = sorted([r["doc_id"] for r in ngram_join.keep_one(docs, Scratch(spark, "test")).collect()], key=repr)
    assert kept == sorted([None, 5, 8], key=repr)
    assert ngram_join.join(docs.limit(0), Scratch(spark, "test"))[0].count() == 0
    assert ngram_join.keep_one(docs.limit(0), Scratch(spark, "test")).columns == docs.columns


def test_ngram_join_leaves_no_large_tables(spark):
    """Prefixes, signatures and whole sets go once they are used; membership, links and kept rows don't need them."""
    docs, shared = spark.createDataFrame(near_copies(2), "doc_id long, text string"), Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.rglob("*.parquet"))
    membership, links = ngram_join.join(docs, Scratch(spark, "test"))
    kept = ngram_join.keep_one(docs, Scratch(spark, "test"))
    columns = {c for f in set(shared.rglob("*.parquet")) - before for c in pq.read_schema(f).names}
    assert columns and not columns & {"prefix", "brief", "signature", "grams", "token"}
    assert membership.count() == docs.count() and links.count() > 0
    assert kept.count() == membership.select("component_id").distinct().count() < docs.count()


def test_saved_tables_leave_no_shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for d in files.localDirsString() for f in Path(d).rglob("shuffle_*.data")}
    before = shuffled()
    rows = spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).count()
    saved = Scratch(spark, "test").save(rows)
    for _ in range(50):  # files go in the background
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before and saved.count() == rows.count() == 7
    assert spark.conf.get(FREED) == "false"


def test_ngram_join_ids_of_several_texts(spark):
    """Texts that share an id don't link what they don't match."""
    one, two = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    docs = spark.createDataFrame([(1, one), (1, two), (2, one + " z"), (3, two + " z"), (4, two)], "doc_id long, text string")
    membership, links = ngram_join.join(docs, Scratch(spark, "test"))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in membership.collect())
    assert got == [(1, 36, 1), (1, 36, 1), (2, 37, 1), (3, 37, 1), (4, 36, 1)] and links.count() == 2
    other = spark.createDataFrame([(5, one), (5, two), (6, one + " z"), (0, two + " z")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in ngram_join.join(other, Scratch(spark, "test"))[0].collect()) == [(0, 0), (5, 0), (5, 5), (6, 5)]


def test_ngram_join_of_very_long_texts(spark):
    rnd = random.Random(7)
    words = [f"w{rnd.randrange(9_000)}" for _ in range(30_000)]
    near = list(words)
    for k in range(0, 30_000, 400):
        near[k] = "changed"
    far = list(words)
    rnd.shuffle(far)
    docs = spark.createDataFrame([(3, " ".join(words)), (4, " ".join(near)), (5, " ".join(far)), (6, "x" * 300_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(docs, Scratch(spark, "test"))[0].collect()}
    assert got == {3: 3, 4: 3, 5: 5, 6: 6}


def test_hot_shingle_spreads(spark, monkeypatch):
    """A shingle that all documents share, of which none match, leaves no large task in the last round."""
    monkeypatch.setattr(ngram_join, "BLOCK", 100)
    members = spark.range(3_000).select(F.col("id").alias("rid"), F.lit(12).alias("n"), F.array(*(F.xxhash64(F.lit(k), "id") for k in range(8))).alias("brief"))
    members = members.withColumn("signature", F.col("brief"))
    postings = members.select(F.lit(7).cast("long").alias("token"), "rid", "n", F.lit(0).alias("pos"), F.col("rid").alias("c"), (F.col("rid") == 0).alias("major"), F.lit(3_000).cast("long").alias("cnt"), F.lit(1).cast("long").alias("k_major"))
    # 30 blocks on each side: no key holds more than two blocks of rows
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = ngram_join.remaining_pairs(postings, members, 85)._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"hashpartitioning\(token#\d+L?, band#\d+, i#\d+L?, j#\d+L?", plan) or "BroadcastHashJoin" in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert ngram_join.remaining_pairs(postings, members, 85).count() == 0


def test_join_counted_broadcasts_hot_keys_alone(spark):
    rows = Scratch(spark, "test").save(spark.range(9_000).select((F.when(F.col("id") < 3_000, 1).otherwise(F.col("id"))).alias("k"), "id"))
    counted = Scratch(spark, "test").save(rows.groupBy("k").agg(F.count("*").alias("n")))
    got = join_counted(rows, counted, ["k"])
    assert got.count() == 9_000 and got.where("k = 1 and n != 3000 or k > 1 and n != 1").count() == 0
    assert join_counted(rows.limit(0), counted.limit(0), ["k"]).count() == 0


def test_signatures_bound_differences():
    rnd = np.random.default_rng(5)
    for _ in range(200):
        x = np.unique(rnd.integers(0, 1 << 63, rnd.integers(1, 800), dtype=np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate([rnd.choice(x, len(x) // 2), rnd.integers(0, 1 << 63, 20, dtype=np.uint64)]))
        for bits in (512, 1024, 4096):
            one, other = shingles.signature(x, bits), shingles.signature(y, bits)
            differ = sum(int(a).bit_count() for a in (one ^ other).view(np.uint64))
            assert differ <= len(np.setxor1d(x, y))
            half = len(one) // 2  # folded, it is the signature of half as many bits
            assert bits == 512 or (one[:half] ^ one[half:] == shingles.signature(x, bits // 2)).all()


def test_signatures_reject_unlike_sets_of_any_size():
    rnd = np.random.default_rng(6)
    for n in (100, 1_600, 3_157, 20_000):
        x, y = (np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64)) for _ in "xy")
        one, other = shingles.signature(x), shingles.signature(y)
        assert len(one) * 64 >= n and sum(int(a).bit_count() for a in (one ^ other).view(np.uint64)) > 2 * n - 2 * np.ceil(2 * n * 85 / 185)


def test_components(spark):
    rnd = random.Random(6)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(1, rnd.randrange(2, 60)) for _ in range(40)] + [(500, 501), (501, 500), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "test")).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[b] == 1 for a, b in pairs if a == 1) and got[501] == 500 and got.get(7, 1) in (1, 7)


def test_gear_hash_rolls():
    data = np.frombuffer("Hello, a rolling hash: é ñ 12345678901234567890 to the end".encode(), np.uint8)
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(substring_dedup.GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert substring_dedup.gear_hashes(data).tolist() == want


@pytest.mark.parametrize("text", ["", " ", "a" * 5000, "é" * 3000, "ab " * 3000, "\n\n", "one two", "😀" * 700, " x " * 400 + "é" * 900])
def test_chunks_cover_the_text(text):
    digests, begins, ends = substring_dedup.chunks(text)
    assert len(digests) == len(begins) == len(ends)
    assert "".join(text[a:b] for a, b in zip(begins, ends, strict=True)) == text


def test_chunks_resist_shifts():
    rnd = random.Random(8)
    text = " ".join(f"w{rnd.randrange(10_000)}" for _ in range(2_000))
    moved = text[:3000] + " inserted words" + text[3000:]
    a, b = substring_dedup.chunks(text)[0], substring_dedup.chunks(moved)[0]
    assert len(set(a) - set(b)) <= 3


def texts_without_blanks(rnd):
    """Texts of at least 6,000 characters by kind: CJK, Thai, base64, code and data on one line, no white space in them."""
    pick = lambda chars, n=6000: "".join(rnd.choice(chars) for _ in range(n))
    return {
        "cjk": pick([chr(x) for x in range(0x4E00, 0x5200)]),
        "thai": pick([chr(x) for x in range(0x0E01, 0x0E2F)]),
        "base64": pick("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
        "code": "".join(f"function f{rnd.randrange(10_000)}(a){{return a+{rnd.randrange(1000)};}}" for _ in range(200)),
        "data": "".join(f'{{"id":{rnd.randrange(10**6)},"v":[{rnd.randrange(100)},{rnd.randrange(100)}]}},' for _ in range(250)),
        "emoji": pick([chr(x) for x in range(0x1F600, 0x1F640)]),
    }


@pytest.mark.parametrize("kind", ["cjk", "thai", "base64", "code", "data", "emoji"])
@pytest.mark.parametrize("at", [0, 1, 3000])
def test_chunks_resist_shifts_without_blanks(kind, at):
    text = texts_without_blanks(random.Random(20))[kind]
    a, b = (substring_dedup.chunks(x)[0] for x in (text, text[:at] + "x" + text[at:]))
    assert len(a) > 100 and len(set(a) - set(b)) <= 5
    # a passage at another offset, in a text of one blank far off
    moved = substring_dedup.chunks("Q" * 7 + text[1500:4500] + "z" * 900 + " end")[0]
    inside = substring_dedup.chunks(text[1500:4500])[0]
    assert len(set(inside) - set(moved)) <= 8 and len(set(inside) - set(a)) <= 8


def test_wide_chunks_resist_shifts_without_blanks():
    """Whatever the hashes, also where none falls under the limit."""
    raw = texts_without_blanks(random.Random(21))["base64"].encode()
    pieces = lambda x, ends: {x[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)}
    a, b = (pieces(x, substring_dedup.chunk_ends(x, mean=1 << 20).tolist()) for x in (raw, b"12345" + raw))
    assert max(map(len, a)) <= substring_dedup.MOST and len(a - b) <= 4


def test_periodic_stretches_have_few_chunks():
    for unit in ["a", "=", "ab", "é", "漢字", "-=+*", *(chr(x) for x in range(33, 127))]:
        text = unit * (6000 // len(unit))
        digests, begins, ends = substring_dedup.chunks(text)
        assert len(digests) < 150 and "".join(text[a:b] for a, b in zip(begins, ends, strict=True)) == text
        assert max(len(text[a:b].encode()) for a, b in zip(begins, ends, strict=True)) <= substring_dedup.MOST + 3


def test_substring_dedup_without_blanks(spark):
    texts = texts_without_blanks(random.Random(22))
    other = texts_without_blanks(random.Random(23))
    docs = []
    for i, kind in enumerate(texts):
        docs += [(2 * i, texts[kind]), (2 * i + 1, other[kind][:777] + texts[kind][2001:2801] + other[kind][777:1500])]
    got = {r["row"]["doc_id"]: r for r in substring_dedup.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string"), Scratch(spark, "test")).collect()}
    for i, t in docs:
        cut = sum(s["end"] - s["begin"] for s in got[i]["spans"])
        if i % 2:
            assert cut > 600 and all(s["begin"] >= 700 and s["end"] <= 1650 for s in got[i]["spans"]) and got[i]["sources"] == [i - 1]
        else:
            assert cut == 0 and got[i]["text"] == t


def test_substring_dedup(spark):
    rnd = random.Random(9)
    prose = lambda n: " ".join(f"w{rnd.randrange(100_000)}" for _ in range(n))
    passage = prose(120)
    texts = [prose(200), f"{prose(50)} {passage} {prose(50)}", f"{prose(31)} {passage} {prose(80)}", prose(10), None, "", f"{prose(5)}\n{passage}"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(3, texts[3], "s"), (None, prose(90), "s")], "doc_id long, text string, spans string")
    rows = substring_dedup.dedup_substrings(docs, Scratch(spark, "test")).collect()
    assert len(rows) == len(texts) + 2
    got = {r["row"]["doc_id"]: r for r in rows}
    for i, t in enumerate(texts):
        if i in (2, 6):
            cut = [t[s["begin"] : s["end"]] for s in got[i]["spans"]]
            assert len(cut) == 1 and cut[0].strip() in passage and len(cut[0]) > 0.7 * len(passage) and got[i]["sources"] == [1]
            assert got[i]["text"] == t.replace(cut[0], "", 1)
        else:
            assert got[i]["text"] == t and not got[i]["spans"]
    assert substring_dedup.dedup_substrings(docs.limit(0), Scratch(spark, "test")).count() == 0


def test_substring_dedup_short_copies(spark):
    short = "Thank you for reading, see you on Monday."
    texts = ["One " + short + " Two", short, short, f"\n {short.replace(' ', '  ')}\n", "ok", "ok", "好的", "好的", short + " Not a copy", " ", " ", "", "", None]
    docs = spark.createDataFrame([*enumerate(texts), (1, short), (None, "ok")], "doc_id long, text string")
    got = {}
    for r in substring_dedup.dedup_substrings(docs, Scratch(spark, "test")).collect():
        got.setdefault(r["row"]["doc_id"], []).append((r["text"], [(s["begin"], s["end"]) for s in r["spans"]], r["sources"]))
    copies = {2: [1], 3: [1], 4: [NO_ID], 5: [NO_ID], 7: [6]}
    for i, t in enumerate(texts):
        want = ("", [(0, len(t))], copies[i]) if i in copies else (docs.where(f"doc_id = {i}").first()["text"], [], [])
        assert all(g == want for g in got[i]) and len(got[i]) == 1 + (i == 1), (i, got[i], want)
    assert got[None] == [("ok", [], [])]


def plain_substrings(rows, min_chars=100):
    """Chunks of whole documents in order of (id, hash of the text); stretches of chunks seen before are cut from ``min_chars`` on."""
    seen, short_seen, out = set(), set(), {}
    for key, text in rows:
        digests, begins, ends = substring_dedup.chunks(text)
        again = [d != 0 and d in seen for d in digests]
        own = set()
        for k, d in enumerate(digests):
            again[k] = again[k] or (d != 0 and d in own)
            own.add(d)
        spans, k = [], 0
        short = substring_dedup.short_digest(text, min_chars)
        if short is not None and short in short_seen:
            spans = [(0, len(text))]
        while k < len(digests):
            j = k
            while j < len(digests) and again[j]:
                j += 1
            if j > k and ends[j - 1] - begins[k] >= min_chars:
                spans.append((begins[k], ends[j - 1]))
            k = max(j, k + 1)
        seen |= own
        short_seen.add(short)
        cut, at = "", 0
        for a, b in spans:
            cut, at = cut + text[at:a], b
        out[key] = (sum(again), spans, None if text is None else cut + text[at:])
    return out


def test_substring_dedup_by_force(spark):
    rnd = random.Random(31)
    prose = lambda n: " ".join(f"w{rnd.randrange(3_000)}" for _ in range(n))
    passages = [prose(rnd.choice([8, 20, 60, 150])) for _ in range(8)]
    texts = [" ".join([prose(rnd.randrange(40)), *rnd.sample(passages, rnd.randrange(4)), prose(rnd.randrange(40))]) for _ in range(150)]
    texts += [prose(9), None, "", " \n ", "é" * 400, prose(3_000) + " " + passages[3] * 300]
    texts += [texts[150], texts[5], "x" * 100_000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, digest string")
    got = {r["row"]["doc_id"]: (r["n_repeats"], [(s["begin"], s["end"]) for s in r["spans"]], r["text"]) for r in substring_dedup.dedup_substrings(docs, Scratch(spark, "test")).collect()}
    want = plain_substrings(list(enumerate(texts)))
    for i in want:
        assert got[i] == want[i], i
    assert sum(bool(spans) for _, spans, _ in want.values()) > 50
