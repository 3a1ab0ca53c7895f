"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed: its blob is the SHA-256 of its text. The ledger is a folder of two tables
that rows are only ever added to. ``paths`` has a row for each version of each path, with its blob. ``blobs`` has a row for each
blob and rule version that was scanned, with its findings. A run adds the versions that the ledger lacks, scans the blobs
that it lacks under the rules' version, each once, adds them, and joins the findings back to all paths that carry them.
A run that fails on its way has added nothing or whole blobs, so it may be tried again. One run at a time writes a ledger.

Texts are combined by blob before they are shuffled, so a blob that a third of all paths share is moved once for each task
that reads it, and scanned once; its findings meet its paths by ``join_counted``. Null texts count as empty, and their
blob is that of the empty text. A null path, or version, is a path or version like others. Where versions have no
column ``version``, a path's blob tells its versions apart. Repeated rows are one version, scanned once, and all are returned.
Texts of any length are scanned whole. Without rows nothing is scanned or returned. Other columns are not read, so their names can't
clash.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_counted, map_batches, table

BASE = ("assign", "access", "hex")
ADDED = ("pem", "jwt", "forge", "slack")
#: What the rules look for. Kinds that the contract fixes, then those that the method adds.
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
FORGE = re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")
SLACK = re.compile(r"xox[abprs]-[0-9A-Za-z-]{10,}")
RULE_VERSION = hashlib.sha256("\n".join(r.pattern for r in (ASSIGN, ACCESS, HEX, PEM, JWT, FORGE, SLACK)).encode()).hexdigest()[:16]
#: Setting of the session that names the folder of a kept ledger.
LEDGER_AT = "spark.tablewright.secrets.ledger"
PATHS = "path long, version string, blob string"
KEY = ["path", "version", "blob"]
LEDGER = "blob string, rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_spans(text: str | None) -> list[tuple[int, int, str, int]]:
    """(start, place of the kind, kind, end), sorted; code points, end exclusive."""
    if not text:
        return []
    found = []

    def put(kind: str, spans) -> None:
        found.extend((a, (BASE + ADDED).index(kind), kind, b) for a, b in spans)

    low = text.lower()
    if any(w in low for w in WORDS):
        put("assign", (m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 6))
    if "AKIA" in text:
        put("access", (m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= 20))
    put("hex", (m.span() for m in HEX.finditer(text)))
    for kind, cue, rule in (("pem", "PRIVATE KEY-----", PEM), ("jwt", "eyJ", JWT), ("forge", "gh", FORGE), ("slack", "xox", SLACK)):
        if cue in text:
            put(kind, (m.span() for m in rule.finditer(text)))
    return sorted(found)


def joined(found: list[tuple[int, int, str, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in found if k in kinds)


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """Ledger rows for (blob, text) rows."""

    def run(cols: dict) -> dict:
        found = [find_spans(t) for t in cols["text"]]
        return {
            "blob": cols["blob"],
            "rule_version": [RULE_VERSION] * len(found),
            **{f"n_{k}": [sum(x[2] == k for x in f) for f in found] for k in BASE},
            "base_sha256": [hashlib.sha256(joined(f, BASE).encode()).hexdigest() for f in found],
            "spans": [joined(f, BASE + ADDED) for f in found],
        }

    return map_batches(blobs, run, LEDGER)


class Ledger:
    """The tables ``paths`` (path, version, blob) and ``blobs`` (LEDGER) below a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if there else self.spark.createDataFrame([], schema)

    def paths(self) -> DataFrame:
        return self._read("paths", PATHS)

    def blobs(self) -> DataFrame:
        return self._read("blobs", LEDGER)

    def add(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.root}/{name}")

    def scan(self, versions: DataFrame, scratch: Scratch) -> DataFrame:
        """``versions``: (path long, text, and version if there is one). Brings the ledger up to date and returns the findings of every row."""
        version = F.col("version").cast("string") if "version" in versions.columns else F.lit(None).cast("string")
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        addressed = versions.select(F.col("path").cast("long").alias("path"), version.alias("version"), F.sha2(text, 256).alias("blob"), text.alias("text"))
        ids = scratch.save(addressed.select(*KEY))
        new, old = ids.distinct().alias("v"), self.paths().alias("k")
        same = [F.col(f"v.{c}").eqNullSafe(F.col(f"k.{c}")) for c in KEY]
        self.add("paths", new.join(old, same[0] & same[1] & same[2], "left_anti"))

        counts = scratch.save(ids.groupBy("blob").agg(F.count("*").alias("n")))
        known = self.blobs().where(F.col("rule_version") == RULE_VERSION).select("blob")
        unseen = counts.join(known, "blob", "left_anti")
        if not unseen.isEmpty():
            texts = addressed.groupBy("blob").agg(F.first("text").alias("text"))
            self.add("blobs", scan_blobs(texts.join(unseen.select("blob"), "blob", "left_semi")))
        found = scratch.save(counts.join(self.blobs().where(F.col("rule_version") == RULE_VERSION).drop("rule_version"), "blob"))
        return join_counted(ids, found, ["blob"]).drop("n")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``, scanned through the ledger that the session's LEDGER_AT names, or a new one."""
    scratch = Scratch(spark, "secret-ledger")
    ledger = Ledger(spark, spark.conf.get(LEDGER_AT, None) or f"{scratch.root}/ledger")
    versions = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("path"), F.col("text").cast("string").alias("text"))
    return ledger.scan(versions, scratch).select(F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "blob")
