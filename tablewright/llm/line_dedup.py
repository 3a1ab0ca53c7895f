"""Line dedup: later copies of repeated line runs are deleted. DataFrame operations only.

The corpus is a set of sequences of line ids, one sequence per document, of its lines with a word. Suffixes
of these sequences are sorted by distributed prefix doubling: level k ranks each suffix by its first 2**k
lines. A rank is the place in the suffix array where the suffixes that share these lines begin, so equal
ranks are an interval of the suffix array whose longest common prefix is at least 2**k lines. Suffixes that
are alone in their interval repeat nothing of that length and are discarded: most lines go at level 0.
Two overlapping ranks of level k give the interval of any length from 2**k to 2**(k+1).

A run counts as repeated from MIN_WORDS words on. From each line the shortest such run forward and the
shortest such run backward are looked up; each one whose interval has an earlier place is a later copy.
Their union is the union of all maximal repeated runs, less their first copies. Ranks deeper than the
longest of these runs can't change it, so doubling ends there.

Earlier means a smaller (doc_id, hash of the text, line); null ids come first. Rows that repeat both id and
text are one document and have the same result. Lines without a word are in no sequence; those between
two deleted lines go with them. Null texts stay null, empty texts stay empty. Other columns pass through whatever
their names are. An empty table gives no rows.

A very long text is one row of lines until these are split; a document's lines are in one task where its ranges are
merged, by sorts that may spill.

Lines meet by their 128-bit hash. Groups are counted before they are joined, by ``join_counted``, which broadcasts the few
large ones; a frequent line's suffixes join by their place, and places within an interval are summed up in blocks of BLOCK,
so no step brings a frequent line or a large group of copies into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, join_counted, keyed, table

MIN_WORDS = 30
BLOCK = 1 << 16
WORDS = r"[^\x20\x09-\x0D]+"
PLACE = ["d", "t", "i"]


def lines_of(docs: DataFrame) -> DataFrame:
    """(d, t, i, no, h1, h2, words) of every line with a word: its place among these, its number, its hash, its words."""
    lines = F.transform(F.split(F.col("row.text").cast("string"), "\n"), lambda x, n: F.struct(n.alias("no"), x.alias("line"), F.regexp_count(x, F.lit(WORDS)).alias("words")))
    full = keyed(docs).select("d", "t", F.posexplode(F.filter(lines, lambda x: x["words"] > 0)).alias("i", "x"))
    return full.select(*PLACE, "x.no", F.xxhash64("x.line").alias("h1"), F.xxhash64(F.lit(1), "x.line").alias("h2"), F.col("x.words").cast("long").alias("words"))


def starts(groups: DataFrame, within: list[str], block: Column, order: list[str]) -> DataFrame:
    """Adds ``before``: the sum of n over groups that come earlier in the same ``within``, by blocks."""
    parts = groups.withColumn("block", block)
    sums = parts.groupBy(*within, "block").agg(F.sum("n").alias("total"))
    earlier = F.sum("total").over(W.partitionBy(*within).orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    bases = sums.select(*within, "block", F.coalesce(earlier, F.lit(0)).alias("base"))
    inside = F.sum("n").over(W.partitionBy(*within, "block").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    inner = parts.withColumn("inside", F.coalesce(inside, F.lit(0)))
    return inner.join(bases, [*within, "block"]).withColumn("before", F.col("base") + F.col("inside")).drop("block", "base", "inside")


def first_level(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """Suffixes whose first line is repeated, ranked by it: (d, t, i, no, words, rank)."""
    ids = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    # hashes are even over their 2**16 blocks; the blocks themselves are summed up as one small group
    ranked = starts(ids.withColumn("all", F.lit(0)), ["all"], F.shiftright("h1", 48), ["h1", "h2"])
    ranked = scratch.save(ranked.select("h1", "h2", "n", F.col("before").alias("rank")))
    found = join_counted(lines, ranked, ["h1", "h2"])
    # rows that repeat id and text have the same places, which count once from here on
    return found.select(*PLACE, "no", "words", "rank").dropDuplicates(PLACE)


def next_level(level: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """(d, t, i, rank) by twice the lines, of the suffixes that repeat that far."""
    a = level.select(*PLACE, "rank")
    b = level.select("d", "t", (F.col("i") - width).cast("int").alias("i"), F.col("rank").alias("then"))
    pairs = scratch.save(a.join(b, PLACE))
    groups = pairs.groupBy("rank", "then").agg(F.count("*").alias("n")).where("n > 1")
    ranked = starts(groups, ["rank"], F.expr(f"then div {BLOCK}"), ["then"])
    ranked = scratch.save(ranked.select("rank", "then", "n", (F.col("rank") + F.col("before")).alias("new")))
    found = scratch.save(join_counted(pairs, ranked, ["rank", "then"]).select(*PLACE, F.col("new").alias("rank")))
    scratch.drop(pairs, ranked)
    return found


def shortest_runs(level: DataFrame, min_words: int) -> DataFrame:
    """(d, t, i, n, no, last): runs of n repeated lines from line i, at least ``min_words`` words, not longer than need be."""
    doc = W.partitionBy("d", "t").orderBy("i")
    level = level.withColumn("island", F.col("i") - F.row_number().over(doc))
    own = ["d", "t", "island"]
    total = F.sum("words").over(W.partitionBy(*own).orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    level = level.select(*own, "i", "no", (total - F.col("words")).alias("begin"), total.alias("end"))
    # Begins and ends of lines as events on the count of words. Forward: the first end at or after a begin + min_words.
    # Backward: the last begin at or before an end - min_words.
    line = F.struct("i", "no")
    begin, end = F.col("begin"), F.col("end")
    event = lambda at, kind: F.struct(at.alias("at"), F.lit(kind).alias("kind"), line.alias("line"))
    events = lambda at_begin, at_end: F.explode(F.array(event(at_begin, 0), event(at_end, 1)))
    order = W.partitionBy(*own).orderBy("x.at", "x.kind", "x.line")
    forward = level.select(*own, events(begin + min_words, end).alias("x"))
    ends = F.min(F.when(F.col("x.kind") == 1, F.col("x.line"))).over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    forward = forward.select("d", "t", F.when(F.col("x.kind") == 0, F.col("x.line")).alias("a"), ends.alias("b"))
    backward = level.select(*own, events(begin, end - min_words).alias("x"))
    begins = F.max(F.when(F.col("x.kind") == 0, F.col("x.line"))).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    backward = backward.select("d", "t", begins.alias("a"), F.when(F.col("x.kind") == 1, F.col("x.line")).alias("b"))
    runs = forward.unionByName(backward).where("a is not null and b is not null").distinct()
    return runs.select("d", "t", "a.i", (F.col("b.i") - F.col("a.i") + 1).alias("n"), "a.no", F.col("b.no").alias("last"))


def later_copies(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, t, ranges): the line numbers [first, last] to delete from each document that has any, merged and in order."""
    lines = scratch.save(lines_of(docs))
    level = scratch.save(first_level(lines, scratch))
    runs = scratch.save(shortest_runs(level, min_words))
    scratch.drop(lines)
    longest = runs.agg(F.max("n")).first()[0] or 1
    ranks, k = [level.select(*PLACE, F.lit(0).alias("k"), "rank")], 0
    while 2 << k <= longest:
        level = next_level(level, 1 << k, scratch)
        k += 1
        ranks.append(level.select(*PLACE, F.lit(k).alias("k"), "rank"))
    rank = ranks[0]
    for more in ranks[1:]:
        rank = rank.unionByName(more)
    deep = F.least(F.length(F.bin("n")) - 1, F.lit(k)).cast("int")
    runs = runs.withColumns({"k": deep, "tail": (F.col("i") + F.col("n") - F.expr("shiftleft(1, least(length(bin(n)) - 1, " + str(k) + "))")).cast("int")})
    head = runs.join(rank.withColumnRenamed("rank", "r1"), [*PLACE, "k"])
    both = head.join(rank.select("d", "t", F.col("i").alias("tail"), "k", F.col("rank").alias("r2")), ["d", "t", "tail", "k"])
    both = scratch.save(both.select(*PLACE, "n", "no", "last", "r1", "r2"))
    place = F.struct(*PLACE)
    interval = ["n", "r1", "r2"]
    repeated = both.groupBy(*interval).agg(F.min(place).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    later = join_counted(both, scratch.save(repeated), interval, "copies").where(place > F.col("first")).select(*PLACE, "n", "no", "last")
    order = W.partitionBy("d", "t").orderBy("i", "n")
    reach = F.max(F.col("i") + F.col("n")).over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = later.withColumn("opens", (reach.isNull() | (F.col("i") > reach)).cast("int"))
    opens = opens.withColumn("run", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    merged = opens.groupBy("d", "t", "run").agg(F.min("no").alias("first"), F.max("last").alias("last"))
    return merged.groupBy("d", "t").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("ranges"))


def dedup_lines(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, text, ranges): each row as it was, its text without later copies, and the line ranges deleted (null: none)."""
    ranges = later_copies(docs, scratch, min_words)
    # The ranges are the small side in every partition; the texts stream past them.
    joined = keyed(docs).join(ranges.hint("shuffle_hash"), ["d", "t"], "left")
    text = F.col("row.text").cast("string")
    inside = lambda n: F.exists("ranges", lambda r: (n >= r["first"]) & (n <= r["last"]))
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, n: ~inside(n)), "\n")
    return joined.select("row", F.when(F.col("ranges").isNull(), text).otherwise(kept).alias("text"), "ranges")


def cleaned(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """The columns of ``docs`` with later copies deleted from ``text`` (and ``n_chars`` renewed where a text changed).
    Documents of which no line with a word is left go; those that had none before stay."""
    found = dedup_lines(docs, scratch, min_words)
    found = found.where(F.col("ranges").isNull() | (F.regexp_count("text", F.lit(WORDS)) > 0))
    new = {"text": F.col("text").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("ranges").isNull(), F.col("row").getField("n_chars")).otherwise(size)
    return found.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` without later copies of repeated line runs."""
    found = dedup_lines(table(spark, sf_dir, "documents"), Scratch(spark, "line-dedup"))
    spans = F.coalesce(F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["first"], r["last"])), ","), F.lit(""))
    deleted = F.coalesce(F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"] + 1), F.lit(0).cast("long"))
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), deleted.alias("n_deleted"), spans.alias("deleted_lines"), "text")
