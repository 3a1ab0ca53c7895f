"""Mixing sources to target weights by systematic sampling.

Sources in code-point order (null last) weigh WEIGHTS in turn. They share TIMES times all words by weight;
no target exceeds MOST times its source's words, and what is cut off is shared by weight among the others
until none is above. With the sources sorted by cap over weight this has a closed form, which two running
sums give.

Each document of a source expects target / source size copies. The expected copies are summed up in an
order of nearly ascending size, one offset in [0, 1) that a hash of the source and SEED gives is added, and
a document is taken once for each integer that its own share crosses. Ordering by size makes the words
taken, not only the documents, follow the target closely.

Running sums don't need a source in one task: as all documents of a source expect the same, the sum at a
document is its place times that number. Places come from two levels. Groups of (source, size class, hash
of the id) hold about CHUNK rows at most where ids differ; their counts are summed up per source, and a window within a
group gives the place there. Hot sources and hot sizes are thus split.

Null texts have 0 words. A source without words has target 0 and nothing is taken. Null ids are in the
first hash group. Rows are kept one to one; rows that repeat an id are documents of their own, and of rows that tie in
size and id, none differs from another. A very long text is its number of words from the first pass on; a source's words may miss its target by
about its longest text. Other columns are not read, so their names can't clash. An empty table gives no rows. The same rows give the
same result in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, table

WEIGHTS = (5, 2, 1)
TIMES = 1.5
MOST = 2
CHUNK = 20_000
SEED = "mix"
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, times: float = TIMES, most: int = MOST) -> DataFrame:
    """(source, source_size, target), one row per source. There are as many rows in one task as sources."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    cap = most * F.col("source_size").cast("double")
    caps = sources.select("source", "source_size", place.alias("place"), weight.alias("weight"), cap.alias("cap"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (times * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levels = caps.withColumns({"level": level, "nth": F.row_number().over(by_ratio)})
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("nth"))
    # the first source, in order of cap over weight, that its level doesn't overfill: those before it are capped, it and the rest share that level
    first = levels.withColumn("first", F.min(fits).over(everything))
    final = first.withColumn("final", F.max(F.when(F.col("nth") == F.col("first"), F.col("level"))).over(everything))
    return final.select("source", "source_size", F.when(F.col("nth") < F.col("first"), F.col("cap")).otherwise(F.col("weight") * F.col("final")).alias("target"))


def size_class() -> F.Column:
    """An integer that ascends with size: its bits, then its four leading ones."""
    bits = F.length(F.bin("size"))
    return bits * 16 + F.expr("shiftright(size, cast(greatest(length(bin(size)) - 4, 0) as int))").cast("int")


def mix(docs: DataFrame, scratch: Scratch, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")
    sized = scratch.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")))
    chunks = max(1, -(-sized.count() // CHUNK))
    hashed = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 7), 16, 10).cast("long")
    rows = sized.withColumns({"class": size_class(), "chunk": F.coalesce(hashed % chunks, F.lit(0))})
    key = ["source", "class", "chunk"]
    counts = rows.groupBy(*key).agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("source").orderBy("class", "chunk").rowsBetween(W.unboundedPreceding, -1))
    groups = counts.select(*key, F.coalesce(before, F.lit(0)).alias("before"))
    placed = rows.withColumn("nth", F.row_number().over(W.partitionBy(*key).orderBy("size", "doc_id")))
    on_group = F.col("p.source").eqNullSafe(F.col("g.source")) & (F.col("p.class") == F.col("g.class")) & (F.col("p.chunk") == F.col("g.chunk"))
    placed = placed.alias("p").join(groups.alias("g"), on_group).select("p.doc_id", "p.source", "p.size", (F.col("g.before") + F.col("p.nth")).alias("place"))
    joined = placed.alias("p").join(targets(sized).alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
    rate = F.when(F.col("t.source_size") > 0, F.col("t.target") / F.col("t.source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("p.source", F.lit(""))).cast("binary")), 1, 5), 16, 10).cast("double") / 1048576.0
    parts = joined.select("p.doc_id", "p.source", "p.size", "t.source_size", "t.target", "p.place", rate.alias("rate"), offset.alias("offset"))
    crossed = F.floor(F.col("rate") * F.col("place") + F.col("offset")) - F.floor(F.col("rate") * (F.col("place") - 1) + F.col("offset"))
    copies = F.least(crossed, F.ceil("rate"))
    return parts.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``."""
    return mix(table(spark, sf_dir, "documents"), Scratch(spark, "mix")).drop("source")


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS cap,
         (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM sized GROUP BY source
), levels AS (
  SELECT *, row_number() OVER r AS nth,
         (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM sources WINDOW r AS (ORDER BY cap / weight, place)
), target AS (
  SELECT source, source_size,
         CASE WHEN nth < (SELECT min(nth) FROM levels WHERE level * weight <= cap) THEN cap
              ELSE weight * (SELECT arg_min(level, nth) FROM levels WHERE level * weight <= cap) END AS target
  FROM levels
), grouped AS (
  SELECT *, len(bin(size)) * 16 + (size >> greatest(len(bin(size)) - 4, 0)) AS class,
         coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 7))::BIGINT % (SELECT greatest(1, ceil(count(*) / {CHUNK})::BIGINT) FROM documents), 0) AS chunk
  FROM sized
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, chunk, size, doc_id NULLS FIRST) AS place FROM grouped
), rated AS (
  SELECT p.doc_id, p.size, t.source_size, t.target, p.place, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('{SEED}:' || coalesce(p.source, '')), 1, 5))::BIGINT::DOUBLE / 1048576.0::DOUBLE AS shift
  FROM placed p JOIN target t ON p.source IS NOT DISTINCT FROM t.source
), counted AS (
  SELECT *, least(floor(rate * place + shift) - floor(rate * (place - 1) + shift), ceil(rate))::BIGINT AS copies FROM rated
)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM counted
"""
