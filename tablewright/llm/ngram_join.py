"""N-gram Jaccard join: rare-first prefix filtering, verified once per pair.

A document is the set of its distinct word shingles. Two documents link when PERCENT percent of their union,
or more, is common. The join runs as follows.

1. A sketch of word counts over all documents (fixed size) orders shingles rare-first: by the count of their
   rarest word, which bounds their own count. Any order that all documents share is right; a good one is fast.
2. One pass over the texts keeps, per document, the size and a 128-bit digest of its set, its prefix (the
   shingles of which a partner must share one), and two signatures. Equal sets become one node, whose
   representative is its row of the smallest id.
3. Prefix shingles that two nodes share make postings; the rest, most of them, end here. Pairs of
   a posting list pass a length filter and a positional filter.
   A pair also passes a suffix filter: signatures bound how many shingles only one of two sets has. The brief one
   has 512 bits and filters within lists; the other has a bit or more for each shingle, so that it rejects unlike sets of any
   size before whole sets are fetched.
4. Pairs are made in rounds. A neighbour round pairs each node with the one next to it in each list, in a
   random order, and with the list's hub; verified links merge components. Pairs inside a component need no
   verifying, so large groups of near copies melt without all their pairs being made. Once the pairs left are
   no more than in proportion to the postings, or rounds don't help any more, the last round makes all pairs
   between different components, so no link between components is missed. There lists are split by bands of
   size, of which a pair's are the same or next to each other, and each band into blocks of about BLOCK nodes;
   two blocks meet in one task, whatever a list holds.
5. Pairs are deduplicated over lists and rounds, and each is verified once, on the exact sets of 64-bit
   shingle hashes, which only documents with a shared prefix shingle have computed. Two shingles that share a
   hash count as one: links are exact up to that.

Tables of prefixes, signatures and whole sets go as soon as no later step reads them.

What is returned is membership: the component of each document, and the verified links, which span each
component of the full link graph.

Null and empty texts have no shingles and link with nothing. Fewer words than WIDTH are one shingle. A very long
text is one set, held whole by the task that hashes it and by one that verifies it.
Repeated rows have equal sets and share a component. Rows of a null id have no component and link nothing.
If rows of one id hold different texts, each row has the component of its own text, whatever the others are.
Ties have no effect, as components don't depend on order. Other columns are not read, so their names
can't clash; ``keep_one`` returns them all. An empty table gives no rows.

Broadcast: the sketch (8 MB, fixed), and nodes to read again where these are at most
BROADCAST_IDS; beyond that they are joined by a shuffle. Frequent shingles are split over salted
windows of about CHUNK rows, and equal texts that are a large group join by ``join_counted``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shingles as S
from .common import Scratch, join_counted, key_columns, keyed, map_batches, map_in_arrow, parts_of, table, without
from .components import components

WIDTH, PERCENT = 5, 80
CHUNK = 1_000
#: Nodes of a block in the last round; two blocks meet in a task.
BLOCK = 1_000
#: Pairs that a node verifies in a neighbour round.
NEIGHBOURS = 6
#: All remaining pairs are made once they are at most this many times the postings.
ENOUGH = 2
ROUNDS = 6
#: Neighbour rounds go on while each leaves at most this share of the pairs.
SHRINK = 0.25
BROADCAST_IDS = 200_000
SETS = "doc_id long, t long, n int, d1 long, d2 long, prefix array<long>, brief array<long>, signature array<long>"


def least_common(na: Column, nb: Column, percent: int) -> Column:
    """The smallest intersection at which sets of these sizes link."""
    return F.ceil((na + nb) * percent / (100.0 + percent))


def sets_of(docs: DataFrame, counts: np.ndarray, width: int, percent: int) -> DataFrame:
    """Step 2: (doc_id, t, n, d1, d2, prefix, brief, signature) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    memo: dict[bytes, int] = {}

    def run(cols: dict) -> dict:
        hasher = S.WordHasher(memo)
        out: dict = {k: [] for k in ("n", "d1", "d2", "prefix", "brief", "signature")}
        for text in cols["text"]:
            words = hasher.hashes(text)
            h = S.hashes(words, width)
            found = S.distinct(h)
            n, prefix = len(found), np.zeros(0, np.uint64)
            if n and percent * (n + 1) <= 100 * n:  # smaller sets link with equal ones alone
                prefix = S.rarest(words, h, width, shared.value, n - -(-n * percent // 100) + 1, len(h) - n)
            d1, d2 = np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), np.int64).tolist()
            none = prefix[:0]  # sets without a prefix make no pairs
            brief, full = (S.signature(found, S.BITS), S.signature(found)) if len(prefix) else (none, none)
            for k, v in (("n", n), ("d1", d1), ("d2", d2), ("prefix", prefix.view(np.int64)), ("brief", brief), ("signature", full)):
                out[k].append(v.view(np.int64) if isinstance(v, np.ndarray) else v)
        return {"doc_id": cols["doc_id"], "t": cols["t"]} | out

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key_columns()[1], F.col("text").cast("string").alias("text"))
    return map_batches(read, run, SETS)


def among(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """Rows joined with ``few``, which has a row for a key at most. A broadcast where it is short, which spares a shuffle of the rows."""
    return rows.join(F.broadcast(few) if few.count() <= BROADCAST_IDS else few.hint("shuffle_hash"), on)


def full_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(rid, grams): the whole sets of the nodes (d, t, rid), from their representatives' texts."""
    wanted = among(docs.select(*key_columns(), F.col("text").cast("string").alias("text")), nodes, ["d", "t"])
    memo: dict[bytes, int] = {}

    def run(cols: dict) -> dict:
        hasher = S.WordHasher(memo)
        return {"rid": cols["rid"], "grams": [S.distinct(S.hashes(hasher.hashes(t), width)).view(np.int64) for t in cols["text"]]}

    return map_batches(wanted.select("rid", "text"), run, "rid long, grams array<long>")


def postings_of(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """(token, rid, n, pos, cnt): prefix shingles that several nodes have."""
    each = reps.select("rid", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = scratch.save(each.groupBy("token").agg(F.count("*").alias("cnt")).where("cnt > 1"))
    found = scratch.save(join_counted(each, shared, ["token"], "cnt"))
    scratch.drop(shared)
    return found


def passes(percent: int, x: str = "x", y: str = "y") -> Column:
    """Length, prefix and positional filters on postings x and y of one list, x the smaller set."""
    xn, yn, xp, yp = (F.col(c) for c in (f"{x}.n", f"{y}.n", f"{x}.pos", f"{y}.pos"))
    index_prefix = xn - F.ceil(xn * (2.0 * percent) / (100.0 + percent)) + 1
    most = F.least(xp, yp) + 1 + F.least(xn - xp - 1, yn - yp - 1)
    return (yn * percent <= xn * 100) & (xp < index_prefix) & (most >= least_common(xn, yn, percent))


def differing(a: Column, b: Column) -> Column:
    """Bits in which two signatures of equal length differ."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, k: total + k)


def folded(signature: Column, size: Column) -> Column:
    """A signature as one of ``size`` longs, its own or half as many."""
    rest = F.slice(signature, size + 1, size)
    return F.when(F.size(signature) > size, F.zip_with(F.slice(signature, F.lit(1), size), rest, lambda p, q: p.bitwiseXOR(q))).otherwise(signature)


def briefly_close(percent: int, x: str = "x", y: str = "y") -> Column:
    """Suffix filter by the brief signatures, without a loop."""
    words = [F.bit_count(F.col(f"{x}.brief")[i].bitwiseXOR(F.col(f"{y}.brief")[i])) for i in range(S.BITS // 64)]
    return sum(words[1:], words[0]) <= spare(percent, x, y)


def spare(percent: int, x: str, y: str) -> Column:
    """How many shingles may be in one of two sets alone, of those that link."""
    return F.col(f"{x}.n") + F.col(f"{y}.n") - 2 * least_common(F.col(f"{x}.n"), F.col(f"{y}.n"), percent)


def close(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that pass the suffix filter by whole signatures. A pair's sizes pass the length filter, so with ``percent`` over 50
    their signatures' lengths are equal or one is half the other."""
    x, y = members.alias("x"), members.alias("y")
    both = pairs.join(x, F.col("a") == F.col("x.rid")).join(y, F.col("b") == F.col("y.rid"))
    size = F.least(F.size("x.signature"), F.size("y.signature"))
    one, other = folded(F.col("x.signature"), size), folded(F.col("y.signature"), size)
    comparable = F.greatest(F.size("x.signature"), F.size("y.signature")) <= 2 * size
    return both.where(briefly_close(percent) & (~comparable | (differing(one, other) <= spare(percent, "x", "y")))).select("a", "b").distinct()


def neighbour_pairs(postings: DataFrame, members: DataFrame, seed: int, percent: int) -> DataFrame:
    """(a, b): pairs of different components, for each node of the NEIGHBOURS lists it shares most of. Its partners
    are the one next to it in a random order, and the list's hub: the node with the fewest shingles rarer than the list's,
    as an original has among copies that were each changed elsewhere."""
    parts = F.ceil(F.col("cnt") / CHUNK)
    salt = F.pmod(F.xxhash64(F.lit(seed), "token", "rid"), parts)
    row = F.struct("rid", "n", "pos", "c")
    salted = postings.select("token", row.alias("p"), "rid", "cnt", salt.alias("salt"), F.xxhash64(F.lit(seed + 1), "token", "rid").alias("order"))
    near = salted.select("p", F.lag("p").over(W.partitionBy("token", "salt").orderBy("order", "rid")).alias("q"))
    hubs = postings.groupBy("token").agg(F.min(F.struct("pos", "rid", "n", "c")).alias("hub"), F.max("cnt").alias("cnt"))
    hubs = hubs.select("token", F.struct("hub.rid", "hub.n", "hub.pos", "hub.c").alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("salt"))
    near = near.unionByName(salted.join(hubs, ["token", "salt"]).select("p", "q"))
    near = near.where("q is not null and p.c != q.c and p.rid != q.rid")
    first = (F.col("p.n") < F.col("q.n")) | ((F.col("p.n") == F.col("q.n")) & (F.col("p.rid") < F.col("q.rid")))
    sided = near.select(F.when(first, F.col("p")).otherwise(F.col("q")).alias("x"), F.when(first, F.col("q")).otherwise(F.col("p")).alias("y"), F.col("p.rid").alias("own"))
    pairs = sided.where(passes(percent)).groupBy(F.col("x.rid").alias("a"), F.col("y.rid").alias("b"), "own").agg(F.count("*").alias("shared"))
    best = F.row_number().over(W.partitionBy("own").orderBy(F.desc("shared"), "a", "b"))
    return close(pairs.withColumn("nth", best).where(F.col("nth") <= NEIGHBOURS).select("a", "b").distinct(), members, percent)


def remaining_pairs(postings: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of a list that pass the filters and are of different components. One of each pair is outside
    the list's largest component, so pairs inside that one aren't even looked at. The smaller set of a pair is in band k by
    its size and the larger one in band k or k + 1. Lists of over BLOCK nodes are dealt out to blocks, by node, and each block of the
    one side is repeated for each block of the other."""
    signed = postings.join(members.select("rid", "n", "brief"), ["rid", "n"])
    # Bands as wide as the length filter allows; the edge is widened so that rounding can't part two sets.
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent) + 1e-9)).cast("int")
    minor = F.col("cnt") - F.col("k_major")
    blocks = {True: F.greatest(F.lit(1), F.ceil(F.col("cnt") / BLOCK)), False: F.greatest(F.lit(1), F.ceil(minor / BLOCK))}
    dealt = lambda n: F.pmod(F.xxhash64("rid"), n)
    all_of = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    row = F.struct("rid", "n", "pos", "c", "brief")

    def met(x_rows: DataFrame, y_rows: DataFrame, x_whole: bool, y_whole: bool) -> DataFrame:
        x = x_rows.select("token", band.alias("band"), dealt(blocks[x_whole]).alias("i"), F.explode(all_of(blocks[y_whole])).alias("j"), row.alias("x"))
        y = y_rows.select("token", F.explode(F.array(band, band - 1)).alias("band"), dealt(blocks[y_whole]).alias("j"), all_of(blocks[x_whole]).alias("is"), row.alias("y"))
        y = y.select("token", "band", F.explode("is").alias("i"), "j", "y")
        smaller = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.rid") < F.col("y.rid")))
        found = x.join(y, ["token", "band", "i", "j"]).where((F.col("x.c") != F.col("y.c")) & smaller & passes(percent) & briefly_close(percent))
        return found.select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b"))

    few, most = signed.where("not major"), signed.where("major")
    return close(met(few, signed, False, True).unionByName(met(most, few, True, False)).distinct(), members, percent)


def verified(pairs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """(a, b) pairs that link, by the exact intersection of their sets."""
    grams = among(grams, pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), ["rid"])
    sides = pairs
    for end in "ba":
        sides = sides.join(grams.select(F.col("rid").alias(end), F.col("grams").alias(f"g_{end}")), end)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts_of(batches):
            keep = []
            for x, y in zip(b.column("g_a"), b.column("g_b"), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_in_arrow(sides.select("a", "b", "g_a", "g_b"), exact, "a long, b long").distinct()


def labelled(postings: DataFrame, groups: DataFrame | None, scratch: Scratch) -> DataFrame:
    """Postings with their component ``c``, whether that is the list's largest, and its size ``k_major``, of lists that still have several."""
    known = postings.drop("cnt").withColumn("c", F.col("rid"))
    if groups is not None:
        known = known.join(groups.select(F.col("node").alias("rid"), "component"), "rid", "left")
        known = known.withColumn("c", F.coalesce("component", "rid")).drop("component")
    own = known.groupBy("token", "c").agg(F.count("*").alias("k"))
    lists = own.groupBy("token").agg(F.sum("k").alias("cnt"), F.max(F.struct("k", "c")).alias("largest"), F.count("*").alias("several")).where("several > 1")
    lists = scratch.save(lists.select("token", "cnt", F.col("largest.c").alias("largest"), F.col("largest.k").alias("k_major")))
    found = join_counted(known, lists, ["token"], "cnt")
    found = scratch.save(found.withColumn("major", F.col("c") == F.col("largest")).drop("largest"))
    scratch.drop(lists)
    return found


def pairs_left(postings: DataFrame) -> int:
    """Pairs that remaining_pairs would look at, about."""
    return int(postings.agg(F.coalesce(F.sum(F.when(~F.col("major"), F.col("cnt").cast("decimal(38,0)"))), F.lit(0))).first()[0])


def join(docs: DataFrame, scratch: Scratch, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(membership: doc_id, t (a hash of the text), n_shingles, component_id; links: a, b, the ids of the sets' representatives)."""
    sets = scratch.save(sets_of(docs, S.word_counts(docs), width, percent))
    key = ["d1", "d2", "n"]
    smallest = sets.where("doc_id is not null and n > 0").groupBy(*key).agg(F.min(F.struct("doc_id", "t")).alias("least"), F.count("*").alias("rows"))
    # A number for each set, as written: ids may repeat, sets don't.
    smallest = scratch.save(smallest.select(*key, "least.doc_id", "least.t", "rows", F.monotonically_increasing_id().alias("rid")))
    own = sets.where(F.size("prefix") > 0).select("doc_id", "t", "n", "prefix", "brief", "signature")
    reps = own.join(smallest.select("doc_id", "t", "n", "rid"), ["doc_id", "t", "n"]).dropDuplicates(["rid"])
    reps = scratch.save(reps.select("rid", F.col("doc_id").alias("d"), "t", "n", "prefix", "brief", "signature"))
    # Prefixes and signatures are most of a table: what is read later is kept without them.
    rows = scratch.save(sets.select("doc_id", "t", *key))
    scratch.drop(sets)
    postings = postings_of(reps, scratch)
    size = postings.count()
    ids = scratch.save(postings.select("rid").distinct())
    members = scratch.save(reps.select("rid", "d", "t", "n", "brief", "signature").join(ids, "rid", "left_semi"))
    scratch.drop(reps, ids)
    grams = scratch.save(full_sets(docs, members.select("d", "t", "rid"), width))

    links: DataFrame | None = None
    groups: DataFrame | None = None
    done: DataFrame | None = None
    open_lists = labelled(postings, None, scratch)
    spent = [postings, grams, members]
    left = pairs_left(open_lists)
    before = left / SHRINK
    for turn in range(ROUNDS + 1):
        if not left:
            scratch.drop(open_lists)
            break
        last = left <= ENOUGH * size or left > SHRINK * before or turn == ROUNDS
        pairs = remaining_pairs(open_lists, members, percent) if last else neighbour_pairs(open_lists, members, turn, percent)
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = scratch.save(pairs)
        scratch.drop(open_lists)
        spent.append(pairs)
        found = scratch.save(verified(pairs, grams, percent))
        links = found if links is None else links.unionByName(found)
        groups = scratch.save(components(links, scratch))
        if last:
            break
        done = pairs if done is None else done.unionByName(pairs)
        open_lists = labelled(postings, groups, scratch)
        before, left = left, pairs_left(open_lists)
    scratch.drop(*spent)

    known = smallest.select(*key, "rows", "rid", F.col("doc_id").alias("least"))
    if groups is not None:
        grouped = known.join(groups.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
        lowest = grouped.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n_sets"))
        known = join_counted(scratch.save(grouped), scratch.save(lowest), ["component"], "n_sets")
    else:
        known = known.withColumn("component_id", F.col("least"))
    known = scratch.save(known.select(*key, "component_id", "rows"))
    whole = rows.where("doc_id is not null and n > 0").select("doc_id", "t", *key)
    mine = join_counted(whole, known, key, "rows").select("doc_id", "t", F.col("n").cast("long").alias("n_shingles"), "component_id")
    alone = rows.where("doc_id is null or n = 0").select("doc_id", "t", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    if links is None:
        return mine.unionByName(alone), pairs_none(docs.sparkSession)
    named = smallest.select("rid", F.col("doc_id").alias("d"))
    a, b = named.toDF("a", "id_a"), named.toDF("b", "id_b")
    return mine.unionByName(alone), links.join(a, "a").join(b, "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def pairs_none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "a long, b long")


def keep_one(docs: DataFrame, scratch: Scratch, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, less all but the smallest (doc_id, t) of each component.
    Rows without shingles and rows of a null id stay. Of rows that repeat id and text one stays."""
    own = Scratch(scratch.spark, "keep-one")
    rows = join(docs, own, width, percent)[0].where("n_shingles > 0 and doc_id is not null")
    rows = scratch.save(rows.select(F.col("doc_id").alias("d"), "t", "component_id"))
    own.clear()
    kept = scratch.save(rows.groupBy("component_id").agg(F.min(F.struct("d", "t")).alias("kept"), F.count("*").alias("n")))
    dropped = join_counted(rows, kept, ["component_id"]).where(F.struct("d", "t") != F.col("kept")).select("d", "t").distinct()
    left = without(docs, dropped)
    again = scratch.save(rows.groupBy("d", "t").agg(F.count("*").alias("n")).where("n > 1").select("d", "t"))
    if again.isEmpty():
        return left
    repeated = keyed(left).join(again, ["d", "t"], "left_semi")
    nth = F.row_number().over(W.partitionBy("d", "t").orderBy(F.xxhash64("row")))
    return without(left, again).unionByName(repeated.withColumn("nth", nth).where("nth = 1").select("row.*"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` at 85 percent of 4-word shingles."""
    return join(table(spark, sf_dir, "documents"), Scratch(spark, "ngram-join"), width=4, percent=85)[0].drop("t")


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), grams AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM words
), sizes AS (
  SELECT doc_id, len(g)::BIGINT AS n FROM grams
), each AS (
  SELECT doc_id, unnest(g) AS s FROM grams
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM each a JOIN each b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), sides AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, s.b FROM reach r JOIN sides s ON s.a = r.other
)
SELECT s.doc_id, s.n AS n_shingles, min(r.other) AS component_id FROM sizes s JOIN reach r ON r.doc_id = s.doc_id GROUP BY ALL
"""
