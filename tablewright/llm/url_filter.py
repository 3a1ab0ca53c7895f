"""URL filters by association rules.

Fixed (host, path) rules label the urls that they fit; the longest fitting rule decides. Labelled urls
become sets of tokens (host labels, path segments, query keys, scheme), and FP-growth mines the token
combinations that go with ``block``. Mined rules are pruned by support and confidence, and by simpler rules
that are as confident. They judge the urls that no fixed rule fits: an inverted index from the rarest token
of each rule finds candidate rules, and a rule matches where all its tokens are present. The most confident
matching rule decides, where it is a ``block`` rule; without one, a url is allowed.

All rules are mined; only what can't be in one that pruning keeps is left out. Tokens that fewer labelled urls have than the
support asks for are in no rule. A token that goes with one label alone is a rule by itself, which implies all rules with more
tokens, so it is in no combination. Tokens of the very same labelled urls are one, the class, and a url has the class if it has any
of them. Where no url has over MINED of the classes that are left, Spark's FP-growth mines them: at most 2**MINED / MIN_SUPPORT item
sets, whatever the urls are. Where a url has more, FP-growth goes by the same conditional tables, an item's in a task, but leaves
out branches that hold no rule, or only rules that a shorter one implies (``grow``). No rule is dropped for its length, and no class
of a url is. The time of ``grow`` has no bound but the number of item sets: many classes that are each in most urls, but seldom
together in one, take long. A task holds the different conditional sets of an item, as Arrow data and a byte for each item of each.

Judging works on
distinct urls, so a url that many rows share is judged once; the verdict meets its rows by ``join_counted``. Null urls and
urls without ``://`` have an empty host and path and are allowed; a url of any length is judged whole. Ties between rules go to
more tokens, more support, ``block``, then the rule's text. Rows are kept one
to one: repeated page ids and null ids need no rule. An empty table gives no rows. Other columns are not
read, so their names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, join_counted, pa_schema, table

#: Fixed rules: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: A mined rule holds for this share of the labelled urls, and for MIN_ROWS of them, at least.
MIN_SUPPORT = 0.01
MIN_ROWS = 20
MIN_CONFIDENCE = 0.9
#: What a count may lack of the support by rounding.
ROUNDED = 1e-6
#: Most classes of tokens of a url where all item sets are mined; with more, only those that may give a rule are.
MINED = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = "label:block"
ALLOW = "label:allow"


@dataclass(frozen=True)
class Parts:
    host: Column
    path: Column
    query: Column


def parts(url: Column) -> Parts:
    """Host (A-Z lower-cased), path and query; all empty for null and for urls without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    bare = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    host = F.substring_index(bare, "/", 1)
    path = F.substr(bare, F.length(host) + 1)
    query = F.when(F.instr(F.substring_index(rest, "#", 1), "?") > 0, F.regexp_replace(F.substring_index(rest, "#", 1), r"^[^?]*\?", "")).otherwise(F.lit(""))
    return Parts(F.translate(host, UPPER, LOWER), path, query)


def rule_name(host: str, path: str) -> str:
    return host + path


def fixed_rule(host: Column, path: Column) -> tuple[Column, Column]:
    """(name, verdict) of the longest fixed rule that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(RULES, key=lambda r: len(rule_name(*r[1:]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(rule_name(h, p))).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def tokens(p: Parts, url: Column) -> Column:
    """Distinct tokens of a url: its scheme, host labels, path segments (digits as one), and query keys."""
    shape = lambda x: F.regexp_replace(x, "[0-9]+", "0")
    labels = F.transform(F.split(p.host, r"\."), lambda x: F.concat(F.lit("host:"), x))
    segments = F.transform(F.filter(F.split(p.path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), shape(x)))
    keys = F.transform(F.filter(F.split(p.query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1)))
    scheme = F.array(F.concat(F.lit("scheme:"), F.translate(F.substring_index(url, "://", 1), UPPER, LOWER)))
    return F.array_distinct(F.concat(scheme, labels, segments, keys))


def classes(labelled: DataFrame, least: float) -> DataFrame:
    """(token, item, n, blocked, pure) of the tokens of at least ``least`` labelled urls (tokens, verdict): the class that
    stands for the token, the urls that have it, how many of them are blocked, and whether all or none are."""
    each = labelled.select("tokens", (F.col("verdict") == "block").cast("int").alias("blocked"))
    total = each.count()
    # two hashes of the urls that have a token: equal ones are the same urls
    h, g = F.xxhash64("tokens"), F.xxhash64(F.lit(1), "tokens")
    each = each.select("blocked", h.alias("h"), g.alias("g"), F.explode("tokens").alias("token"))
    sums = [F.sum(F.col(x).cast("decimal(38,0)")).alias(x) for x in "hg"]
    found = each.groupBy("token").agg(F.count("*").alias("n"), F.sum("blocked").alias("blocked"), *sums).where(F.col("n") >= F.lit(least * total))
    item = F.min("token").over(W.partitionBy("n", "blocked", "h", "g"))  # frequent tokens alone, at most 1 / MIN_SUPPORT for each token of a url
    pure = (F.col("blocked") == 0) | (F.col("blocked") == F.col("n"))
    return found.select("token", item.alias("item"), "n", "blocked", pure.alias("pure"))


#: Rows of a conditional table that are counted at a time.
COUNTED = 1 << 16


def counts(weights: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Sum of the weights of the rows that hold each item."""
    out = np.zeros(held.shape[1], np.int64)
    for at in range(0, len(held), COUNTED):
        out += weights[at : at + COUNTED] @ held[at : at + COUNTED]
    return out


def bits(rests: list[pa.ListArray]) -> tuple[list[str], np.ndarray]:
    """All items, and for each row which of them it has, a byte each; items become no Python objects but once."""
    names = sorted(pa.chunked_array([r.flatten() for r in rests], pa.string()).unique().to_pylist())
    held, at = np.zeros((sum(map(len, rests)), len(names)), bool), 0
    for r in rests:
        rows = np.repeat(np.arange(at, at + len(r)), pc.list_value_length(r).to_numpy(zero_copy_only=False))
        held[rows, pc.index_in(r.flatten(), pa.array(names, pa.string())).to_numpy(zero_copy_only=False)] = True
        at += len(r)
    return names, held


def grow(first: str, names: list[str], held: np.ndarray, blocked: np.ndarray, allowed: np.ndarray, least: float, confidence: float):
    """Rules (items, label, confidence, rows) on ``first`` and any items of its conditional table: which others (``names``) its urls hold, and
    how many of these are blocked and allowed. A rule that one on fewer of its items implies may be left out; no other is.

    A set is extended by an item at a time. An item that all rows of the set have gives rules that those without it imply. A set
    that holds the item in question and any others has its label in no more rows than the item has, and the other label in no fewer rows than
    have all items that are left. Where this keeps the confidence under what is asked for, or not over that of a
    rule on fewer of the items, the item is left out, which raises the second number."""
    weights = [blocked, allowed]
    labels = (BLOCK, ALLOW)

    def rule(items: tuple, own: list, best: list):
        """What the set says if that is a rule; and the most confident rule of each label on it or the sets before it."""
        sure = [n / sum(own) for n in own]
        says = [n >= least and c >= confidence and c > b for n, c, b in zip(own, sure, best)]
        found = [([first, *(names[i] for i in items)], labels[k], sure[k], own[k]) for k in (0, 1) if says[k]]
        return found, [c if s else b for s, c, b in zip(says, sure, best)]

    own = [int(w.sum()) for w in weights]
    found, best = rule((), own, [0.0, 0.0])
    yield from found
    todo = [((), np.arange(len(held)), np.arange(len(names)), own, best)]
    while todo:
        items, rows, tail, own, best = todo.pop()
        if 0 in own or not len(tail):
            continue  # nothing is surer
        ws, has = [w[rows] for w in weights], held[np.ix_(rows, tail)]
        n = np.array([counts(w, has) for w in ws])
        keep = (n.sum(0) < sum(own)) & (n >= least).any(0)
        while len(tail):
            tail, has, n = tail[keep], has[:, keep], n[:, keep]
            whole = has.all(1)
            other = np.array([[ws[1][whole].sum()], [ws[0][whole].sum()]])
            most = n / np.maximum(n + other, 1)
            keep = ((n >= least) & (most >= confidence) & (most > np.array(best)[:, None])).any(0)
            if keep.all():
                break
        order = np.argsort(n.sum(0), kind="stable")
        for k, j in enumerate(order):
            more, said = (*items, int(tail[j])), [int(x) for x in n[:, j]]
            found, sure = rule(more, said, best)
            yield from found
            todo.append((more, rows[has[:, j]], tail[order[k + 1 :]], said, sure))


GROWN = "tokens array<string>, label string, confidence double, rows long"


def grown(baskets: DataFrame, least: float, confidence: float) -> DataFrame:
    """(tokens, label, confidence, rows) from ``baskets`` (items, rarest first, and label): each item with those after it is a conditional table."""
    same = baskets.groupBy("items").agg(F.count_if(F.col("label") == BLOCK).alias("blocked"), F.count_if(F.col("label") == ALLOW).alias("allowed"))
    each = same.select("items", "blocked", "allowed", F.posexplode("items").alias("at", "item"))
    each = each.groupBy("item", F.slice("items", F.col("at") + 2, F.greatest(F.size("items"), F.lit(1))).alias("rest")).agg(F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"))
    schema = pa_schema(GROWN)

    def run(group: pa.Table) -> pa.Table:
        rows = [group[x].to_numpy() for x in ("blocked", "allowed")]
        found = list(grow(group["item"][0].as_py(), *bits(group["rest"].chunks), *rows, least, confidence))
        return pa.Table.from_pydict(dict(zip(schema.names, map(list, zip(*found)))) if found else {n: [] for n in schema.names}, schema=schema)

    return each.groupBy("item").applyInArrow(run, GROWN)


def mine(labelled: DataFrame, scratch: Scratch, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE, mined: int = MINED) -> tuple[DataFrame, DataFrame]:
    """From rows (tokens, verdict): pruned rules (tokens, label, confidence, support) on classes, and the class of each token (token, item)."""
    total = labelled.count()
    least = min(1.0, max(support, MIN_ROWS / max(1, total)))
    known = scratch.save(classes(labelled, least))
    alone = known.where(F.col("pure")).select("item", "n", "blocked").distinct()
    alone = alone.select(F.array("item").alias("tokens"), F.when(F.col("blocked") > 0, BLOCK).otherwise(ALLOW).alias("label"), F.lit(1.0).alias("confidence"), (F.col("n") / F.lit(max(1, total))).alias("support"))
    mixed = known.where(~F.col("pure")).select("token", F.struct("n", "item").alias("by"))
    rows = labelled.select(F.monotonically_increasing_id().alias("row"), "tokens", F.concat(F.lit("label:"), F.col("verdict")).alias("label"))
    own = scratch.save(rows).select("row", "label", F.explode("tokens").alias("token")).join(mixed, "token")
    sets = own.groupBy("row", "label").agg(F.sort_array(F.collect_set("by")).alias("by"))
    baskets = scratch.save(sets.select(F.transform("by", lambda x: x["item"]).alias("items"), "label"))
    n, widest = baskets.agg(F.count("*"), F.max(F.size("items"))).first()
    rules = alone
    if n and widest > mined:
        found = grown(baskets, least * total - ROUNDED, confidence)
        rules = rules.unionByName(found.select(F.array_sort("tokens").alias("tokens"), "label", "confidence", (F.col("rows") / F.lit(total)).alias("support")))
    elif n and least * total <= n:  # the share of all labelled urls, as a share of those that have a mixed token
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, least * total / n), minConfidence=confidence).fit(baskets.select(F.array_append("items", F.col("label")).alias("items")))
        label = F.col("consequent")[0]
        clean = ~F.exists("antecedent", lambda x: x.startswith("label:"))
        found = model.associationRules.where(label.isin(BLOCK, ALLOW) & clean)
        rules = rules.unionByName(found.select(F.array_sort("antecedent").alias("tokens"), label.alias("label"), "confidence", (F.col("support") * F.lit(n / total)).alias("support")))
    rules = scratch.save(rules)
    # a rule goes where a rule on fewer of its tokens says the same, as confidently
    whole = rules.select(F.col("tokens").alias("whole"), "label", F.col("confidence").alias("sure"), F.explode("tokens").alias("token"))
    part = rules.select(F.col("tokens").alias("part"), "label", F.col("confidence").alias("enough"), F.col("tokens")[0].alias("token"))
    inside = (F.size("part") < F.size("whole")) & (F.size(F.array_except("part", "whole")) == 0) & (F.col("enough") >= F.col("sure"))
    implied = whole.join(part, ["label", "token"]).where(inside).select(F.col("whole").alias("tokens"), "label").distinct()
    return rules.join(implied, ["tokens", "label"], "left_anti"), known.select("token", "item")


def index_of(rules: DataFrame, frequency: DataFrame) -> DataFrame:
    """Inverted index: rules under their rarest token."""
    each = rules.select("tokens", "label", "confidence", "support", F.explode("tokens").alias("token")).join(frequency, "token", "left")
    best = F.min(F.struct(F.coalesce("n", F.lit(0)), "token"))["token"]
    return each.groupBy("tokens", "label", "confidence", "support").agg(best.alias("token"))


def judge(pages: DataFrame, scratch: Scratch, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row per page: page_id, host, path, rule (null where the method decides), verdict, mined (the rule that decided)."""
    url = F.col("url").cast("string")
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"))
    own = parts(F.col("url"))
    distinct = read.where(F.instr("url", "://") > 0).groupBy("url").agg(F.count("*").alias("n"))
    name, verdict = fixed_rule(own.host, own.path)
    urls = scratch.save(distinct.select("url", "n", tokens(own, F.col("url")).alias("tokens"), verdict.alias("verdict")))
    rules, classed = mine(urls.where("verdict is not null").select("tokens", "verdict"), scratch, support, confidence)
    rules = scratch.save(rules)
    wanted = rules.select(F.explode("tokens").alias("item")).distinct()
    # tokens that rules read, as their classes; at most a row for each frequent token is on the small side
    each = urls.where("verdict is null").select("url", F.explode("tokens").alias("token")).join(classed.join(wanted, "item"), "token")
    held = scratch.save(each.groupBy("url").agg(F.collect_set("item").alias("tokens")))
    each = held.select("url", "tokens", F.explode("tokens").alias("token"))
    frequency = each.select("token").groupBy("token").agg(F.count("*").alias("n"))
    index = index_of(rules, frequency).withColumnsRenamed({"tokens": "needed"})
    matched = each.join(index, "token").where(F.size(F.array_except("needed", "tokens")) == 0)
    rank = F.struct("confidence", F.size("needed"), "support", (F.col("label") == BLOCK).alias("blocks"), F.concat_ws(" ", "needed").alias("mined"))
    decided = matched.groupBy("url").agg(F.max(rank).alias("best"))
    decided = decided.select("url", F.when(F.col("best.blocks"), F.lit("block")).otherwise(F.lit("allow")).alias("found"), F.col("best.mined").alias("mined"))
    decided = scratch.save(urls.select("url", "n").join(decided, "url", "left"))
    plain = read.where(F.col("url").isNull() | (F.instr("url", "://") == 0))
    judged = join_counted(read, decided, ["url"]).drop("n").unionByName(plain, allowMissingColumns=True)
    return judged.select(
        "page_id",
        own.host.alias("host"),
        own.path.alias("path"),
        name.alias("rule"),
        F.coalesce(verdict, F.col("found"), F.lit("allow")).alias("verdict"),
        F.when(name.isNull(), F.col("mined")).alias("mined"),
    )


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every url of ``pages``."""
    return judge(table(spark, sf_dir, "pages"), Scratch(spark, "url-rules"))
