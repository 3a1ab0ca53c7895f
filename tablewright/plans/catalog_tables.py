"""Queries that go through a store: statements, versions, evolution, files. Each works in a store of its own, which goes with the session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import ColumnSpec, Logical, schema_of
from ..operators import correct, dml, validate
from ..operators.ordinals import ORDINAL
from ..sources import files
from ..sources.store import Store
from . import ddl
from .registry import fixed, query, read

SHORT = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"


def orders(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def stored(spark, df: DataFrame, primary_key=(), unique=()) -> Store:
    """A new store with table ``t``."""
    store = Store.sandbox(spark)
    store.create("t", schema_of(df.schema, primary_key, unique), df)
    return store


def one_row(spark, columns: str, *values) -> DataFrame:
    return spark.createDataFrame([values], columns)


# Insert


@query(f"SELECT {SHORT} FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_custkey, 'N', NULL FROM orders WHERE o_orderkey % 2 = 1")
def insert_append(spark, sf_dir):
    df = orders(spark, sf_dir)
    store = stored(spark, df.where("o_orderkey % 2 = 0"), ["o_orderkey"])
    dml.insert(store, df.where("o_orderkey % 2 = 1").select("O_ORDERKEY", "o_custkey", F.lit("N").alias("o_orderstatus")), "t")
    return store.read("t")


@query("SELECT * FROM (SELECT count(*) AS total, count(*) AS success, 0::BIGINT AS failed, 'bulk' AS method, 0::BIGINT AS chunks FROM orders WHERE o_orderkey % 2 = 1)")
def insert_stats_bulk(spark, sf_dir):
    df = orders(spark, sf_dir)
    store = stored(spark, df.where("o_orderkey % 2 = 0"), ["o_orderkey"])
    s = dml.insert(store, df.where("o_orderkey % 2 = 1"), "t")
    return one_row(spark, "total long, success long, failed long, method string, chunks long", s.total, s.success, s.failed, s.method, len(s.chunks))


#: Of every 2000 keys 12 in a row are in the table already; a chunk of 1000 rows takes five such failures.
ISOLATED = """WITH s AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS ord, o_orderkey FROM orders), b AS (SELECT *, (ord - 1) // 1000 AS chunk, (o_orderkey % 2000 BETWEEN 500 AND 511)::INT AS bad FROM s),
p AS (SELECT *, coalesce(sum(bad) OVER (PARTITION BY chunk ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM b)"""


def isolating(spark, sf_dir) -> tuple[Store, dml.Stats]:
    df = orders(spark, sf_dir).select("o_orderkey")
    store = stored(spark, df.where("o_orderkey % 2000 BETWEEN 500 AND 511"), ["o_orderkey"])
    return store, dml.insert(store, df, "t", 1000, 5, ["o_orderkey"])


@query(ISOLATED + " SELECT chunk::BIGINT AS chunk, count(*) FILTER (WHERE prior < 5 AND bad = 0) AS success, count(*) FILTER (WHERE prior < 5 AND bad = 1) AS failed, count(*) FILTER (WHERE prior >= 5) AS unprocessed FROM p GROUP BY chunk HAVING count(*) FILTER (WHERE prior < 5 AND bad = 1) > 0")
def insert_stats_by_chunk(spark, sf_dir):
    _, s = isolating(spark, sf_dir)
    return s.by_chunk.select("chunk", F.col("written").alias("success"), "failed", "unprocessed")


@query(ISOLATED + " SELECT o_orderkey FROM orders WHERE o_orderkey % 2000 BETWEEN 500 AND 511 UNION ALL SELECT o_orderkey FROM p WHERE prior < 5 AND bad = 0")
def insert_isolates_rows(spark, sf_dir):
    store, _ = isolating(spark, sf_dir)
    return store.read("t")


@query("SELECT row_number() OVER (ORDER BY c_name) + 99 AS id, c_name FROM customer")
def insert_counts_up(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select("c_name")
    made = ddl.df_ddl(spark.createDataFrame([(1, "x")], "id long, c_name string"), "t", "postgres", ddl.Keys(("id",), autoincrement=("id", 100)))
    store = Store.sandbox(spark)
    store.create("t", ddl.table_schema(made))
    dml.insert(store, df, "t", order_by=["c_name"])
    return store.read("t")


# Upsert, update


@query(f"""WITH n AS (SELECT o_orderkey + CASE WHEN o_orderkey % 20 = 0 THEN 10000000 ELSE 0 END AS o_orderkey, o_custkey, 'U' AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 10 = 0)
SELECT {SHORT} FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n) UNION ALL SELECT {SHORT} FROM n""")
def store_upsert(spark, sf_dir):
    df = orders(spark, sf_dir)
    store = stored(spark, df, ["o_orderkey"])
    key = (F.col("o_orderkey") + F.when(F.col("o_orderkey") % 20 == 0, 10000000).otherwise(0)).alias("o_orderkey")
    new = df.where("o_orderkey % 10 = 0").select(key, "o_custkey", F.lit("U").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    for _ in range(2):  # again changes nothing
        dml.upsert(store, new, "t", ["O_ORDERKEY"], dialect="oracle")
    return store.read("t")


@query("""WITH s AS (SELECT o_orderkey // 4 * 4 + 1 AS k, o_custkey, o_orderkey AS ord FROM orders), w AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY ord DESC) = 1)
SELECT coalesce(k, o_orderkey) AS o_orderkey, CASE WHEN k IS NOT NULL THEN w.o_custkey ELSE o.o_custkey END AS o_custkey, CASE WHEN k IS NOT NULL THEN 'L' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders o FULL JOIN w ON o_orderkey = k""")
def store_upsert_last_wins(spark, sf_dir):
    df = orders(spark, sf_dir)
    store = stored(spark, df, ["o_orderkey"])
    dml.upsert(store, df.select(F.expr("o_orderkey div 4 * 4 + 1").alias("o_orderkey"), "o_custkey", F.lit("L").alias("o_orderstatus"), F.col("o_orderkey").alias(ORDINAL)), "t", ["o_orderkey"])
    return store.read("t")


@query("SELECT CASE WHEN c_custkey % 10 = 0 THEN c_custkey + 1000000 ELSE c_custkey END AS c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN 'M' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def upsert_on_duplicate_key(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    store = stored(spark, df, ["c_custkey"], [["c_name"]])
    dml.upsert(store, df.where("c_custkey % 10 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), "c_name", F.lit("M").alias("c_mktsegment")), "t", ["c_custkey"], dialect="mysql")
    return store.read("t")


@query("SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_custkey + 1000000, c_name || '!' FROM customer WHERE c_custkey % 10 = 5")
def upsert_other_unique_set(spark, sf_dir):
    """Rows with a new key and another row's name are rejected, the others are written."""
    df = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    store = stored(spark, df, ["c_custkey"], [["c_name"]])
    new = df.where("c_custkey % 5 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.when(F.col("c_custkey") % 10 == 5, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")).alias("c_name"))
    dml.upsert(store, new, "t", ["c_custkey"], tolerance=1 << 40)
    return store.read("t")


@query("SELECT 'lazy_only' AS method, count(*) AS success FROM orders WHERE o_orderkey % 3 = 0")
def lazy_upsert_stats(spark, sf_dir):
    df = orders(spark, sf_dir)
    s = dml.lazy_upsert(stored(spark, df, ["o_orderkey"]), df.where("o_orderkey % 3 = 0"), "t", ["o_orderkey"])
    return one_row(spark, "method string, success long", s.method, s.success)


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 100000 AND o_orderstatus IN ('F', 'P') THEN 'B' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders")
def store_update(spark, sf_dir):
    store = stored(spark, orders(spark, sf_dir))
    dml.update(store, "t", {"O_ORDERSTATUS": "B"}, ["o_totalprice > 100000", ("o_orderstatus", "IN", ["F", "P"])], "1 AND 2")
    return store.read("t")


@query("SELECT count(*) AS matched FROM orders WHERE o_custkey < 200")
def update_count(spark, sf_dir):
    store = stored(spark, orders(spark, sf_dir))
    return one_row(spark, "matched long", dml.auto_update(store, "t", [{"o_orderstatus": "C"}, {"o_orderstatus": "ignored"}], ("o_custkey", "<", 200)))


@query("SELECT o_orderkey, o_orderstatus, NULL::BIGINT AS age FROM orders UNION ALL SELECT o_orderkey + 10000000, 'A', CASE WHEN o_orderkey % 300 > 0 THEN o_orderkey % 7 END FROM orders WHERE o_orderkey % 100 = 0")
def auto_insert_adds_columns(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    store = stored(spark, df, ["o_orderkey"])
    new = df.where("o_orderkey % 100 = 0").select((F.col("o_orderkey") + 10000000).cast("string").alias("O-OrderKey"), F.lit("A").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 300 > 0, (F.col("o_orderkey") % 7).cast("string")).alias("Age"))
    dml.auto_insert(store, new, "t")
    return store.read("t")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 0 THEN o_orderkey + 0.5::DOUBLE ELSE o_totalprice END AS o_totalprice FROM orders")
def auto_upsert_text(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    store = stored(spark, df, ["o_orderkey"])
    new = df.where("o_orderkey % 100 = 0").select(F.concat(F.lit(" "), F.col("o_orderkey").cast("string")).alias("O_OrderKey"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".5")).alias("o_totalprice"))
    dml.auto_upsert(store, new, "t", ["o_orderkey"])
    return store.read("t")


CHECKS = ((["O_ORDERKEY"], True), (["o_custkey", "o_orderstatus"], True), (["o_orderstatus", "O_CUSTKEY"], True), (["o_custkey"], False), (["o_orderkey", "o_custkey"], False), ([], False))


def refused(act) -> bool:
    try:
        act()
    except ValueError:
        return True
    return False


@query(fixed("keys, accepted, within", [("O_ORDERKEY", True, True), ("o_custkey,o_orderstatus", True, True), ("o_orderstatus,O_CUSTKEY", True, True), ("o_custkey", False, True), ("o_orderkey,o_custkey", False, False), ("", False, False)]))
def conflict_keys(spark, sf_dir):
    schema = schema_of(orders(spark, sf_dir).schema, ["o_orderkey"], [["o_custkey", "o_orderstatus"]])
    rows = [(",".join(k), not refused(lambda k=k: validate.conflict_key(k, schema)), not refused(lambda k=k: validate.conflict_key(k, schema, True))) for k, _ in CHECKS]
    return spark.createDataFrame(rows, "keys string, accepted boolean, within boolean")


@query(fixed("case_, refused", [("insert unknown column", True), ("upsert unknown column", True), ("update unknown column", True), ("upsert without its key", True), ("unknown dialect", True), ("known columns", False)]))
def unknown_columns(spark, sf_dir):
    df = orders(spark, sf_dir).where("o_orderkey < 50")
    store = stored(spark, df, ["o_orderkey"])
    odd = df.withColumn("nope", F.lit(1))
    cases = {
        "insert unknown column": lambda: dml.insert(store, odd, "t"), "upsert unknown column": lambda: dml.upsert(store, odd, "t", ["o_orderkey"]),
        "update unknown column": lambda: dml.update(store, "t", {"nope": 1}, "o_orderkey = 1"), "upsert without its key": lambda: dml.upsert(store, df.drop("o_orderkey"), "t", ["o_orderkey"]),
        "unknown dialect": lambda: dml.upsert(store, df, "t", ["o_orderkey"], dialect="db2"), "known columns": lambda: dml.upsert(store, df, "t", ["o_orderkey"]),
    }
    return spark.createDataFrame([(k, refused(f)) for k, f in cases.items()], "case_ string, refused boolean")


# Versions, evolution, catalogue


@query("SELECT 0::BIGINT AS version, count(*) AS rows FROM orders UNION ALL SELECT 1, count(*) + count(*) FILTER (WHERE o_orderkey % 10 = 0) FROM orders UNION ALL SELECT 2, count(*) FILTER (WHERE o_orderkey % 2 = 1) FROM orders UNION ALL SELECT 3, count(*) FROM orders UNION ALL SELECT 4, count(*) + 1 FROM orders")
def store_versions(spark, sf_dir):
    """Append, replace by a part of itself, roll back, append: every version stays."""
    df = orders(spark, sf_dir)
    store = stored(spark, df)
    store.append("t", df.where("o_orderkey % 10 = 0"))
    store.save(store.read("t").where("o_orderkey % 2 = 1"), "t", "replace")
    store.rollback("t", 0)
    store.append("t", df.orderBy("o_orderkey").limit(1))
    return spark.createDataFrame([(v, store.read("t", v).count()) for v in store.versions("t")], "version long, rows long")


@query("SELECT o_orderkey, NULL::VARCHAR AS note, 7::BIGINT AS level FROM orders UNION ALL SELECT o_orderkey + 10000000, 'n' || o_orderkey, 7 FROM orders WHERE o_orderkey % 100 = 0")
def evolve_add_column(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select("o_orderkey")
    store = stored(spark, df)
    new = df.where("o_orderkey % 100 = 0").select((F.col("o_orderkey") + 10000000).alias("o_orderkey"), F.concat(F.lit("n"), F.col("o_orderkey")).alias("Note"))
    store.add_columns("t", [correct.added_spec(new, "Note"), ColumnSpec("level", Logical.INTEGER, "bigint", default=7), ColumnSpec("O_ORDERKEY", Logical.INTEGER, "bigint")])
    store.append("t", new)
    return store.read("t")


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, o_totalprice FROM orders")
def evolve_alter_type(spark, sf_dir):
    store = stored(spark, read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"))
    store.execute("ALTER TABLE t ALTER COLUMN o_orderkey TYPE string")
    return store.read("t")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0")
def save_aligned_modes(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    store = Store.sandbox(spark)
    store.save(df.where("o_orderkey % 2 = 1"), "t", "fail")
    store.save(df.where("o_orderkey % 4 = 0"), "t", "replace")
    store.save(df.where("o_orderkey % 4 = 2").select("o_custkey", "o_orderkey"), "t", "append")
    if not refused(lambda: store.save(df, "t", "fail")):
        raise AssertionError("a table that exists was written")
    return store.read("t")


@query(fixed("what, answer", [
    ("tables", "Customers,orders"), ("tables like ORD", "orders"), ("schemas", "hr"), ("schema with staff", "hr"), ("find CUSTOMERS", "Customers"), ("columns", "id:bigint,name:string,joined:timestamp_ntz"),
    ("primary key", "id"), ("unique sets", "name"), ("identity", "id"), ("columns like AM", "Customers.name"), ("exists nope", "False"), ("missing", "city"), ("extra", "joined"), ("different", "name"), ("tables after drop", "orders"),
]))
def store_catalogue(spark, sf_dir):
    store = Store.sandbox(spark)
    made = spark.createDataFrame([], "id long, name string, joined timestamp_ntz")
    schema = schema_of(made.schema, ["id"], [["name"]])
    counting = ColumnSpec("id", Logical.INTEGER, "bigint", tag="identity", has_server_default=True)
    store.create("Customers", type(schema)((counting, *schema.columns[1:]), schema.constraints))
    store.save(read(spark, sf_dir, "orders").select("o_orderkey").limit(1), "orders")
    store.save(spark.range(1), "hr.staff")
    gap = store.compare("customers", {"ID": "int", "name": "date", "city": "string"})
    found = {
        "tables": ",".join(store.tables()), "tables like ORD": ",".join(store.tables("ORD")), "schemas": ",".join(store.schemas()), "schema with staff": store.schema_with("staff"), "find CUSTOMERS": store.find("CUSTOMERS"),
        "columns": ",".join(f"{c.name}:{c.type}" for c in store.columns("customers")), "primary key": ",".join(store.primary_key("customers")), "unique sets": ";".join(map(",".join, store.unique_sets("customers"))),
        "identity": ",".join(store.identity_columns("customers")), "columns like AM": ",".join(".".join(x) for x in store.find_columns("AM")), "exists nope": str(store.exists("nope")),
        "missing": ",".join(gap["missing"]), "extra": ",".join(gap["extra"]), "different": ",".join(gap["different"]),
    }
    store.execute("DROP TABLE IF EXISTS nope")
    store.execute("DROP TABLE customers;")
    found["tables after drop"] = ",".join(store.tables())
    return spark.createDataFrame(list(found.items()), "what string, answer string")


@query("SELECT 'orders' AS name, count(*) AS rows FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'none', 0")
def row_counts(spark, sf_dir):
    store = Store.sandbox(spark)
    for name in ("orders", "customer"):
        store.save(read(spark, sf_dir, name), name)
    store.create("none", schema_of(read(spark, sf_dir, "orders").schema))
    return spark.createDataFrame([(n, store.count(n)) for n in ("orders", "customer", "none")], "name string, rows long")


@query(fixed("key, repeats", [("o_orderkey", False), ("o_custkey", True), ("o_orderkey,o_custkey", False)]))
def duplicates_exist(spark, sf_dir):
    df = orders(spark, sf_dir)
    return spark.createDataFrame([(k, validate.has_duplicates(df, k.split(","))) for k in ("o_orderkey", "o_custkey", "o_orderkey,o_custkey")], "key string, repeats boolean")


# Files


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, CASE WHEN n_nationkey % 5 > 0 THEN n_name END AS n_name FROM nation WHERE n_nationkey % 7 > 0")
def csv_scan_and_overwrite(spark, sf_dir):
    """Null tokens read as null; the file is written over by a part of itself."""
    path = f"{Store.sandbox(spark).root}/in.csv"
    token = F.element_at(F.array(*(F.lit(x) for x in ("NA", "nan", "", "NULL", "N/A"))), (F.col("n_nationkey") / 5 + 1).cast("int"))
    df = read(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 5 == 0, token).otherwise(F.col("n_name")).alias("n_name"))
    df.write.csv(path, header=True)
    files.overwrite_csv(files.read_csv(spark, path).where("n_nationkey % 7 > 0"), path)
    return files.read_csv(spark, path)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_create_and_load(spark, sf_dir):
    store = Store.sandbox(spark)
    read(spark, sf_dir, "nation").write.csv(f"{store.root}/in.csv", header=True)
    ddl.csv_create_and_load(store, f"{store.root}/in.csv", "t", ["oracle", "postgres"])
    return store.read("t").select(*(F.col(c).cast("int" if c != "n_name" else "string").alias(c) for c in ("n_nationkey", "n_name", "n_regionkey")))


@query("SELECT row_number() OVER (ORDER BY n_nationkey) AS batch_row, n_nationkey, n_name FROM nation")
def stream_upsert(spark, sf_dir):
    from ..streaming.sink import upsert_stream

    store = Store.sandbox(spark)
    df = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    store.create("t", schema_of(df.schema, ["n_nationkey"]), df.where("n_nationkey % 2 = 0").select("n_nationkey", F.lit("old").alias("n_name")))
    df.write.parquet(f"{store.root}/.in")
    upsert_stream(spark.readStream.schema(df.schema).parquet(f"{store.root}/.in"), store, "t", ["n_nationkey"], f"{store.root}/.check").awaitTermination()
    return store.read("t").select((F.col("n_nationkey") + 1).cast("long").alias("batch_row"), "n_nationkey", "n_name")
