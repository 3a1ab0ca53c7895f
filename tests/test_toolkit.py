import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.functions import identifiers as I
from tablewright.functions import parse
from tablewright.functions.clean import CleaningConfig, clean_text, clean_value, quick_clean
from tablewright.functions.types import ColumnSpec, Constraints, ForeignKey, Logical, TableSchema, TypeRegistry, schema_of
from tablewright.operators import cast, coerce, correct, dml, mapping, outliers, predicate, profile, validate
from tablewright.operators.ordinals import ORDINAL, with_ordinal
from tablewright.plans import ddl, log
from tablewright.plans.harness import Harness
from tablewright.plans.pipeline import Config, CrudCycle, CsvJob
from tablewright.sources import files
from tablewright.sources.store import Store
from tablewright.streaming.sink import upsert_stream


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


USERS = TableSchema(
    (ColumnSpec("id", Logical.INTEGER, "bigint", nullable=False), ColumnSpec("username", Logical.STRING, "string", length=10), ColumnSpec("city", Logical.STRING, "string")),
    Constraints(("id",), (("username",),)),
)


# Identifiers


def test_headers_and_names():
    assert I.clean_headers(["Order", " Customer ID ", "2nd", "a", "a", "a_1", "", "é!"]) == ["order", "customer_id", "2nd", "a", "a_1", "a_1_1", "col_6", "col_7"]
    assert I.sanitize(["Order", "class", "2nd", "x y"]) == ["order_", "class_", "_2nd", "x_y"]
    assert I.sanitize({"A b": 1}) == {"a_b": 1}
    assert I.normalize(" Customer-ID ") == "customer_id"
    assert I.escape("order", "oracle") == '"ORDER"' and I.escape("a]b", "mssql") == "[a]]b]" and I.escape("x y", "mysql") == "`x y`"
    with pytest.raises(ValueError):
        I.dialect_of("db2")


@given(st.lists(st.text(max_size=6), max_size=8))
def test_headers_are_unique(names):
    found = I.clean_headers(names)
    assert len(set(found)) == len(names) and all(found)


# Predicates


def test_conditions():
    assert predicate.parse("x BETWEEN 'a' and 'b'").value == ["a", "b"]
    assert predicate.parse("x IN ('a,b', c)").value == ["a,b", "c"]
    assert predicate.parse("x in ()").value == []
    for bad in ("x <> 3", "x == 3", "1x = 2", "x LIKES 3", "x"):
        with pytest.raises(ValueError):
            predicate.parse(bad)
    with pytest.raises(TypeError):
        predicate.condition(5)


def test_expressions_and_sql():
    conditions = ["cell_id = '00123'", ("vendor", "IN", ["GP", "BL"]), {"field": "tech", "operator": "LIKE", "value": "2G_"}, "dt BETWEEN '2023-01-01' and '2023-01-31'"]
    row = dict.fromkeys(("cell_id", "vendor", "tech", "dt"), "x")
    w = predicate.where_sql(predicate.bind(conditions, row), "1 AND (2 OR 3) AND 4", "postgres")
    assert w.sql == "((cell_id = :cell_id_1 AND (vendor IN (:vendor_2_0, :vendor_2_1) OR tech LIKE :tech_3 ESCAPE '\\')) AND dt BETWEEN :dt_4_0 AND :dt_4_1)"
    assert w.params["tech_3"] == "%2G\\_%"
    for bad in ("1 AND 5", "1 AND", "(1", "1 XOR 2"):
        with pytest.raises(ValueError):
            predicate.where_sql(predicate.bind(conditions, row), bad)
    up = predicate.build_update({"cost_code": "N"}, "quota", [("COST_ID", "=", 1001)])
    assert up.sql == "UPDATE quota SET cost_code = :u_cost_code WHERE COST_ID = :COST_ID_1" and up.params == {"u_cost_code": "N", "COST_ID_1": 1001}
    with pytest.raises(ValueError):
        predicate.build_update({"cost_code": "N"}, "quota", [("COST_ID", "=", 1001)], allow_missing=False)
    assert predicate.build_insert({"a": 1}, "t").sql == "INSERT INTO t (a) VALUES (:i_a)"
    assert predicate.build_select({"a": 1, "b": 2}, "t", [("a", "=", "?"), ("z", "=", "?")]).params == {"a_1": 1}


def test_nested_conditions_hold_together(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "x int, y string")
    assert values(predicate.where(df, [["x > 1", "y = a"], "x = 2"], "1 OR 2"), "x") == [(2,), (3,)]
    assert predicate.where(df, "y LIKE '%'").count() == 0
    with pytest.raises(ValueError):
        predicate.where(df, "nope = 1")


# Profiles


def sample_frame(spark):
    t = dt.datetime
    rows = [("Alice", 25.0, t(1990, 1, 1), "A", 1, 50000.0), ("Bob", None, t(1995, 2, 2), "B", 2, 60000.0), (None, 30.0, None, "A", 3, None), ("Charlie", 35.0, t(1985, 3, 3), "C", 4, 70000.0)]
    return spark.createDataFrame(rows, "name string, age double, birth_date timestamp, category string, id long, salary double")


def test_profile_key_and_sample(spark):
    df = sample_frame(spark)
    found = {r["column"]: r for r in profile.profile(df).collect()}
    assert [c for c in df.columns if found[c]["is_unique"]] == ["name", "age", "birth_date", "id", "salary"]
    assert found["name"]["null_pct"] == 25.0 and found["category"]["distinct_count"] == 3
    key = profile.infer_key(df)
    assert key.components == ["name"] and key.name == "pk" and key.unique
    with pytest.warns(UserWarning):
        s = profile.sample(df, 50, "birth_date")
    assert values(s.rows, "name") == [("Alice",), ("Charlie",)] and s.num_per_side == 1 and s.filtered_rows == 2
    for bad in (0, 101):
        with pytest.raises(ValueError):
            profile.sample(df, bad)
    with pytest.raises(ValueError):
        profile.sample(df.limit(0), 5)
    assert profile.profile(df.limit(0)).count() == 0


def test_composite_key_and_text(spark):
    df = spark.createDataFrame([(i // 3, i % 3, "z") for i in range(9)], "a int, b int, c string")
    key = profile.infer_key(df, most=3)
    assert key.unique and set(key.components) >= {"a", "b"}
    none = profile.infer_key(spark.createDataFrame([(1, 1), (1, 1)], "a int, b int"))
    assert not none.unique and none.warning
    text = spark.createDataFrame([("a|b", "c\\", None)], "x string, y string, z string").select(profile.key_text(["x", "y", "z"]))
    assert text.first()[0] == "a\\|b|c\\\\|null"


# Parsing, casting, coercion

DIRTY = ["12", " 12 ", "1.0", "1.5", "1e3", "1,000", "abc", "", "nan", "12d", None]


def test_integers_and_numbers(spark):
    df = spark.createDataFrame([(x,) for x in DIRTY], "t string")
    c = coerce.integer(F.col("t"), df.schema["t"].dataType)
    got = [tuple(r) for r in df.select(c.value, c.failed).collect()]
    assert [v for v, _ in got] == [12, 12, 1, None, 1000, None, None, None, None, None, None]
    assert [f for _, f in got] == [False, False, False, True, False, True, True, True, True, True, False]
    big = spark.createDataFrame([("9007199254740993",)], "t string")
    assert big.select(coerce.integer(F.col("t"), big.schema["t"].dataType).value).first()[0] == 9007199254740993


def test_decimals_bools_dates_json(spark):
    df = spark.createDataFrame([("2.675",), ("-0.125",), ("12345",)], "t string")
    assert [None if r[0] is None else str(r[0]) for r in df.select(coerce.decimal(F.col("t"), df.schema["t"].dataType, 5, 2).value).collect()] == ["2.68", "-0.13", None]
    df = spark.createDataFrame([(x,) for x in ["true", "T", "1.0", "off", "maybe", None]], "t string")
    kind = df.schema["t"].dataType
    assert [r[0] for r in df.select(coerce.boolean(F.col("t"), kind).value).collect()] == [True, True, True, False, None, None]
    assert [r[0] for r in df.select(coerce.boolean(F.col("t"), kind, strict=True).value).collect()] == [True, None, None, False, None, None]
    df = spark.createDataFrame([(x,) for x in ["2023-01-01", "2023-01-01 10:00:00", "13/02/2023", "20230101", "2023", "1", "12:30", "abc"]], "t string")
    d = dt.datetime
    assert [r[0] for r in df.select(parse.to_timestamp(F.col("t"))).collect()] == [d(2023, 1, 1), d(2023, 1, 1, 10), d(2023, 2, 13), d(2023, 1, 1), d(2023, 1, 1), None, None, None]
    df = spark.createDataFrame([(x,) for x in ['{"k": 69}', "[1, 2]", "5", "null", "", "{bad"]], "t string")
    assert [r[0] for r in df.select(coerce.json_text(F.col("t"), df.schema["t"].dataType).value).collect()] == ['{"k":69}', "[1,2]", "5", None, None, None]


def test_cast_frame(spark):
    rows = [(f"${i},000", "yes" if i % 2 else "no", f"2024-01-{i + 1:02d}", f"w{i}", str(i)) for i in range(20)]
    df = cast.cast_df(spark.createDataFrame(rows, "amount string, flag string, created string, word string, n string"))
    assert [t for _, t in df.dtypes] == ["bigint", "boolean", "timestamp_ntz", "string", "bigint"]
    assert df.agg(F.sum("amount")).first()[0] == 190_000
    assert dict(cast.cast_df(spark.createDataFrame(rows, "amount string, flag string, created string, word string, n string"), {"n": "string"}).dtypes)["n"] == "string"
    assert cast.to_frame(spark, {"a": 1}).count() == 1 and cast.to_frame(spark, {"a": [1, 2]}).count() == 2
    with pytest.raises(TypeError):
        cast.to_frame(spark, 5)
    by_column = cast.auto_cast(spark.createDataFrame([("1.5",), ("2",), (None,)], "x string"), by_column=True)
    assert by_column.dtypes == [("x", "double")]
    assert cast.cast_df(df.limit(0)).count() == 0


# Cleaning


def test_clean_text(spark):
    raw = ["a b", "a​b", "﻿x", "“q”", "–", "…", "ﬁ", "１２", "А", "a\x07b", "nan", "None", "NAT", "NAN", "null", None, "  x  "]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, t string")
    got = [r[0] for r in df.select(clean_text(F.col("t")).alias("c"), "i").orderBy("i").select("c").collect()]
    assert got == ["a b", "ab", "x", '"q"', "-", "...", "fi", "12", "A", "ab", None, None, None, None, None, None, "x"]
    assert clean_value("a\x07b c ") == "ab c" and clean_value(float("nan")) is None
    one = spark.createDataFrame([("a-b c!é",)], "t string")
    assert one.select(clean_text(F.col("t"), CleaningConfig(remove_special=True))).first()[0] == "ab cé"
    assert quick_clean(spark.createDataFrame([(" x ", 1)], "`My Col` string, `2` int")).columns == ["my_col", "2"]


# Mapping, outliers, validation, correction


def test_mapping(spark):
    m = mapping.by_name(["Customer ID", "name", "Name ", "x"], ["customer_id", "name", "y"], {"X": "y"})
    assert m.pairs == {"x": "y", "Customer ID": "customer_id", "name": "name"} and m.dropped == ["Name "] and m.missing == []


def test_outliers(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 5, 100]] + [(None,)], "v double")
    assert df.where(~outliers.valid_mask(df, "v")).count() == 1
    assert values(outliers.null_outliers(df, "v"), "v").count((None,)) == 2
    assert outliers.bounds(df.limit(3), "v") == outliers.NONE
    wide = spark.createDataFrame([(float((i * 7919) % 1000) if i % 9 else 5.0, float(i % 3), None if i % 4 else float(i)) for i in range(3_000)], "a double, b double, c double")
    want = outliers.quartiles(wide, ["a", "b", "c"])
    try:
        outliers.AT_ONCE = 50  # narrowed by sketches, exactly the same
        assert outliers.quartiles(wide, ["a", "b", "c"]) == want
    finally:
        outliers.AT_ONCE = 1_000_000
    odd = spark.createDataFrame([(float(i % 40),) for i in range(400)] + [(5_000.0,), (-9_000.0,)], "v double")
    found = [r[0] for r in odd.where(~outliers.valid_mask(odd, "v", "forest")).collect()]
    assert {5_000.0, -9_000.0} <= set(found) and len(found) < 100
    same = spark.createDataFrame([(1.0,)] * 5, "v double")
    assert outliers.bounds(same, "v", "zscore") == outliers.NONE


def test_validation(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "b"), (2, None)], "id long, username string")
    assert validate.duplicate_rows(df, ["id"]) == 4
    assert validate.null_counts(df, USERS) == {"id": 2}
    assert validate.required_missing(["username"], USERS) == ["id"]
    assert validate.conflict_key(["USERNAME"], USERS) == ("username",)
    with pytest.raises(validate.ConstraintError):
        validate.conflict_key(["city"], USERS)
    parent = spark.createDataFrame([(1,)], "pid long")
    assert values(validate.orphans(df, parent, ForeignKey(("id",), "p", ("pid",))), "id") == [(2,)]


def test_correct_reports_and_raises(spark):
    schema = schema_of(spark.createDataFrame([], "id long, score double").schema)
    df = spark.createDataFrame([("1", "2.5", "x"), ("b", "z", "y")], "ID string, score string, `More Text` string")
    out, report = correct.correct(df, schema, correct.COERCE)
    assert values(out, "id", "score") == [(1, 2.5), (None, None)]
    assert {c.column: (c.failures, c.decision, c.samples) for c in report.columns} == {"id": (1, "null", ["b"]), "score": (1, "null", ["z"])}
    assert report.mapping.dropped == ["More Text"]
    with pytest.raises(correct.CorrectionError):
        correct.correct(df, schema)  # raises by default, for one bad value
    many = spark.createDataFrame([(f"bad{i}", "1") for i in range(50)], "id string, score string")
    assert len(correct.correct(many, schema, correct.COERCE)[1].columns[0].samples) == 5
    out, report = correct.correct(df, schema, correct.COERCE, evolve=True)
    assert report.added == ["more_text"] and out.columns == ["id", "score", "more_text"]


def test_align_and_conform(spark):
    target = schema_of(spark.createDataFrame([], "id long, name string, value double, created_at timestamp_ntz, active boolean").schema)
    rows = [(1, "a", 10.5, "2023-01-01", True, 1), (2, "b", 20.3, "2023-01-02", False, 2), (3, "c", 1000.0, "invalid", True, 3), (4, "d", 30.7, "2023-01-04", True, 4), (5, "e", 40.2, "2023-01-05", True, 5)]
    df = spark.createDataFrame(rows, "ID long, NAME string, value double, created_at string, active boolean, extra_column long")
    with pytest.raises(correct.CorrectionError):
        correct.conform(df, target)
    out, report, schema = correct.conform(df, target, strict_mode=False, auto_alter=True)
    assert report.failed == ["created_at"] and report.introduced_nulls_pct["created_at"] == 100 and report.added == ["extra_column"]
    assert out.where("created_at is not null").count() == 0 and out.agg(F.max("value")).first()[0] == 1000.0
    for method in ("iqr", "zscore", "forest"):  # a column that casts reliably keeps its outliers
        out, report, _ = correct.conform(df, target, strict_mode=False, fix_outliers=method)
        assert out.agg(F.max("value")).first()[0] == 1000.0 and report.failed == ["created_at"] and not report.corrected
    text = df.withColumn("value", F.when(F.col("ID") == 2, "n/a").otherwise(F.col("value").cast("string"))).withColumn("active", F.lit("yes"))
    out, report, _ = correct.conform(text, target, strict_mode=False, fix_outliers="iqr")
    assert values(out, "value") == values(spark.createDataFrame([(10.5,), (None,), (None,), (30.7,), (40.2,)], "value double"), "value")
    assert report.corrected == {"value": 1} and set(report.failed) == {"value", "created_at", "active"}  # words are no booleans here
    assert correct.conform(text, target, strict_mode=False)[0].where("value is not null").count() == 0
    assert correct.conform(df, None)[1].status == "table not found"
    with pytest.raises(correct.CorrectionError):
        correct.align(df, target)
    loose = correct.align(df, target, failure_threshold=30)
    assert loose.columns == target.names and loose.where("created_at is null").count() == 1
    assert values(correct.align(loose, target, failure_threshold=30)) == values(loose)  # a fixed point
    assert correct.threshold_of(None) == 0.02 and correct.threshold_of(3) == 0.03 and correct.threshold_of(-1) == 0


# Store and DML


def data_files(store, table):
    return {f: store._fs().getFileStatus(store._path(store.snapshot(table).path, f)).getModificationTime() for f in store.snapshot(table).files}


def test_store(spark, store):
    store.create("Users", USERS)
    assert store.tables() == ["Users"] and store.exists("users") and store.count("users") == 0
    store.append("users", spark.createDataFrame([(1, "a", "P")], "id long, username string, city string"))
    assert store.version("users") == 1 and store.primary_key("users") == ("id",)
    before = data_files(store, "users")
    assert store.add_columns("users", [ColumnSpec("Age", Logical.INTEGER, "bigint"), ColumnSpec("CITY", Logical.STRING), ColumnSpec("kind", Logical.STRING, default="it's"), ColumnSpec("n", Logical.INTEGER, "bigint", default=7)]) == ["Age", "kind", "n"]
    assert data_files(store, "users") == before  # new columns change no file
    assert store.read("users").columns == ["id", "username", "city", "Age", "kind", "n"] and values(store.read("users"), "Age", "kind", "n") == [(None, "it's", 7)]
    store.append("users", spark.createDataFrame([(2, None)], "id long, kind string"))
    assert values(store.read("users"), "id", "kind", "n") == [(1, "it's", 7), (2, None, 7)] and set(before) < set(data_files(store, "users"))
    store.alter_type("users", "age", "double")
    assert dict(store.read("users").dtypes)["Age"] == "double"
    store.execute('ALTER TABLE users ADD COLUMN "Note" string')
    store.execute("alter table users alter column age type bigint;")
    assert dict(store.read("users").dtypes)["Age"] == "bigint" and store.read("users").columns[-1] == "Note"
    with pytest.raises(ValueError):
        store.execute("DELETE FROM users")
    assert store.compare("users", {"id": "big", "city": "int", "x": "int"})["missing"] == ["x"]
    store.rollback("users", 0)
    assert store.count("users") == 0 and store.schema("users") == USERS
    assert store.compare("users", {"id": "big", "city": "int", "x": "int"}) == {"missing": ["x"], "extra": ["username"], "different": ["city"]}
    assert store.find_columns("name") == [("Users", "username")] and store.details("users")["rows"] == 0
    with pytest.raises(ValueError):
        store.create("users", USERS)
    store.save(spark.createDataFrame([(2,)], "id long"), "other")
    store.execute("DROP TABLE users")
    store.execute("DROP TABLE IF EXISTS users")
    assert store.tables() == ["other"]
    with pytest.raises(KeyError):
        store.read("users")


def test_versions_are_never_reused(spark, store):
    one = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    store.save(one(1, 2), "t")
    store.append("t", one(3))
    store.rollback("t", 0)
    store.append("t", one(*range(10, 60)))
    assert [store.read("t", v).count() for v in store.versions("t")] == [2, 3, 2, 52] and store.version("t") == 3
    store.save(store.read("t").where("id > 1"), "t", "replace")  # reads what it replaces
    assert store.count("t") == 51 and store.read("t", 3).count() == 52
    at = store.snapshot("t")
    store.append("t", one(1000))
    with pytest.raises(RuntimeError):
        store.publish(at, (), at.files)  # another has committed since
    assert store.publish(at, store.stage("t", one(2000)), after_others=True) == at.version + 2 and store.count("t") == 53
    assert store.vacuum("t") == 3 and store.versions("t") == [at.version + 2] and store.count("t") == 53


def test_failed_statement_leaves_the_table(spark, store):
    store.save(spark.range(3), "t")
    bad = spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    for act in (lambda: store.append("t", bad), lambda: store.save(bad, "t", "replace")):
        with pytest.raises(Exception, match="no"):
            act()
    assert store.count("t") == 3 and store.version("t") == 0


def test_schemas(spark, store):
    store.save(spark.range(2), "t")
    store.save(spark.range(5), "hr.t")
    store.save(spark.range(7), "hr.Staff")
    assert store.schemas() == ["hr"] and store.tables() == ["t"] and store.tables(schema="hr") == ["Staff", "t"]
    assert (store.count("t"), store.count("HR.t".lower()), store.count("staff")) == (2, 5, 7)
    assert store.schema_with("staff") == "hr" and store.schema_with("t") == "" and store.schema_with("none") is None and store.find("STAFF") == "hr.Staff"


def test_migration_plan(spark, store):
    store.create("users", USERS)
    plan = store.plan("users", schema_of(spark.createDataFrame([], "ID long, city int, Age int").schema).columns)
    assert [c.name for c in plan.add] == ["Age"] and plan.change == (("city", "string", "int"),) and store.version("users") == 0
    assert store.migrate(plan) == 1 and store.schema("users").names[-1] == "Age" and not store.plan("users", store.columns("users"))


def test_statements_touch_files_with_their_rows_alone(spark, store):
    df = spark.range(400).selectExpr("id", "concat('u', id) as username", "'x' as city")
    store.create("users", USERS)
    for k in range(4):
        store.append("users", df.where(f"id div 100 = {k}").coalesce(1))
    old = data_files(store, "users")
    assert len(old) == 4
    dml.insert(store, [{"id": 1000, "username": "new"}], "users")
    assert set(old) < set(data_files(store, "users"))
    dml.upsert(store, [{"id": 150, "city": "Y"}, {"id": 2000, "city": "Z"}], "users", ["id"])
    assert len(set(old) & set(data_files(store, "users"))) == 3 and store.count("users") == 402
    assert dml.update(store, "users", {"city": "W"}, "id = 20") == 1
    kept = data_files(store, "users")
    assert len(set(old) & set(kept)) == 2
    dml.upsert(store, [{"id": 3000, "city": "Z"}], "users", ["id"])  # no key is there: an append
    assert set(kept) < set(data_files(store, "users"))
    assert set(values(store.read("users").where("city != 'x'"), "id", "city")) == {(20, "W"), (150, "Y"), (2000, "Z"), (3000, "Z")}


@pytest.mark.parametrize("dialect", ["sqlite", "postgres", "oracle", "mysql", "mssql"])
def test_upsert(spark, store, dialect):
    store.create("users", USERS, spark.createDataFrame([(1, "alice", "Paris"), (2, "bob", "London")], "id long, username string, city string"))
    new = [{"id": 1, "username": "alice", "city": "Lyon"}, {"id": 3, "username": "charlie", "city": "Berlin"}]
    for _ in range(2):
        stats = dml.upsert(store, new, "users", ["ID"], dialect=dialect)
        assert values(store.read("users")) == [(1, "alice", "Lyon"), (2, "bob", "London"), (3, "charlie", "Berlin")] and stats.success == 2
    assert dml.merge_sql("users", ["id", "city"], ["id"], dialect)


def test_upsert_rules(spark, store):
    store.create("users", USERS, spark.createDataFrame([(1, "alice", "Paris")], "id long, username string, city string"))
    with pytest.raises(validate.ConstraintError):
        dml.upsert(store, [{"id": 1, "city": "X"}], "users", ["city"])
    with pytest.raises(ValueError):
        dml.upsert(store, [{"id": 1, "nope": "X"}], "users", ["id"])
    df = spark.createDataFrame([(1, "first", 1), (1, "last", 2)], "id long, city string, seq int")
    dml.upsert(store, df.select("id", "city", F.col("seq").cast("long").alias(ORDINAL)), "users", ["id"])
    assert values(store.read("users")) == [(1, "alice", "last")]  # the last row wins; columns it lacks stay


def test_upsert_keeps_other_unique_sets(spark, store):
    store.create("users", USERS, spark.createDataFrame([(1, "alice", "Paris"), (2, "bob", "London")], "id long, username string, city string"))
    stats = dml.upsert(store, [{"id": 4, "username": "alice"}, {"id": 5, "username": "eve"}], "users", ["id"])
    assert (stats.success, stats.failed) == (1, 1) and values(store.read("users"), "id", "username") == [(1, "alice"), (2, "bob"), (5, "eve")]
    # one after the other: alice's row is renamed first, then the name is free; of two rows with one name the first has it
    rows = spark.createDataFrame([(1, "al", 1), (6, "alice", 2), (7, "zoe", 3), (8, "zoe", 4), (2, "bob", 5), (9, "bob", 6)], f"id long, username string, {ORDINAL} long")
    stats = dml.upsert(store, rows, "users", ["id"])
    assert stats.failed == 2 and values(store.read("users"), "id", "username") == [(1, "al"), (2, "bob"), (5, "eve"), (6, "alice"), (7, "zoe")]


def test_upsert_by_any_unique_set(spark, store):
    store.create("users", USERS, spark.createDataFrame([(1, "alice", "Paris"), (2, "bob", "London")], "id long, username string, city string"))
    dml.upsert(store, [{"id": 4, "username": "alice", "city": "Oslo"}, {"id": 9, "username": "eve", "city": "Rome"}], "users", ["id"], dialect="mysql")
    assert values(store.read("users")) == [(2, "bob", "London"), (4, "alice", "Oslo"), (9, "eve", "Rome")]  # all columns of the row that matched


def test_columns_that_count_up(spark, store):
    made = ddl.df_ddl(spark.createDataFrame([(1, "a")], "id long, name string"), "t", "postgres", ddl.Keys(("id",), autoincrement=("id", 100)))
    store.create("t", ddl.table_schema(made))
    dml.insert(store, [{"name": "x"}, {"name": "y"}], "t", order_by=["name"])
    assert values(store.read("t")) == [(100, "x"), (101, "y")] and store.identity_columns("t") == ["id"]
    dml.insert(store, spark.createDataFrame([(None, "z"), (500, "w")], "id long, name string"), "t")
    dml.upsert(store, spark.createDataFrame([(100, "xx"), (None, "new")], "id long, name string"), "t", ["id"])
    assert values(store.read("t")) == [(100, "xx"), (101, "y"), (500, "w"), (501, "z"), (502, "new")]


def test_many_null_keys_meet_in_no_task(spark):
    df = spark.range(200).select(F.lit(None).cast("long").alias("id"), F.col("id").cast("string").alias("username"), (F.col("id") + 1).alias(ORDINAL))
    target = spark.createDataFrame([], "id long, username string, city string")
    loose = TableSchema((ColumnSpec("id", Logical.INTEGER, "bigint"), *USERS.columns[1:]), USERS.constraints)
    rows = dml.reasons(df, loose, target)
    assert rows.where("size(__reasons) > 0").count() == 0
    parts = df.withColumn("__reasons", F.array().cast("array<string>")).select(F.count("*").over(dml._good_by(df.withColumn("__reasons", F.array().cast("array<string>")), ("id",), ORDINAL)).alias("n"))
    assert parts.agg(F.max("n")).first()[0] == 1


def test_insert_isolates_rows(spark, store):
    store.create("users", USERS, spark.createDataFrame([(1, "alice", "Paris")], "id long, username string, city string"))
    rows = [(1, "dup", "x"), (2, "bob", "x"), (2, "again", "x"), (3, "much too long", "x"), (4, "bob", "x"), (5, "eve", "x")]
    df = spark.createDataFrame(rows, "id long, username string, city string")
    stats = dml.insert(store, df, "users", order_by=["id", "username"])
    assert (stats.total, stats.success, stats.failed) == (6, 3, 3)
    stats = dml.insert(store, spark.createDataFrame([(i, f"u{i}" if i not in (11, 12) else "much too long", "x") for i in range(10, 20)], "id long, username string, city string"), "users", chunk=5, tolerance=2, order_by=["id"])
    # the first chunk holds ids 10 to 14: two failures use up its tolerance, and the rest of it isn't tried
    assert [(c.success, c.failed, c.unprocessed) for c in stats.chunks] == [(1, 2, 2)]
    assert (stats.total, stats.success, stats.failed) == (10, 6, 2)


def test_foreign_keys_reject(spark, store):
    store.create("city", schema_of(spark.createDataFrame([], "name string").schema), spark.createDataFrame([("Paris",)], "name string"))
    schema = TableSchema(USERS.columns, Constraints(("id",), (), (ForeignKey(("city",), "city", ("name",)),)))
    store.create("users", schema)
    stats = dml.insert(store, spark.createDataFrame([(1, "a", "Paris"), (2, "b", "Rome"), (3, "c", None)], "id long, username string, city string"), "users")
    assert (stats.success, stats.failed) == (2, 1) and values(store.read("users"), "id") == [(1,), (3,)]
    assert Store.sandbox(spark).tables() == []
    assert cast.sample_values(store.read("users"), "city", 5).count() == 1


def test_insert_without_a_good_row_fails(spark, store):
    store.create("users", USERS)
    with pytest.raises(RuntimeError):
        dml.insert(store, spark.createDataFrame([(None, "a")], "id long, username string"), "users")
    assert store.count("users") == 0


def test_update_and_auto(spark, store):
    store.create("users", USERS, spark.createDataFrame([(1, "alice", "Paris"), (2, "bob", "London")], "id long, username string, city string"))
    assert dml.update(store, "users", {"city": "Rome"}, [("ID", "=", 2)]) == 1
    assert dml.update(store, "users", {"city": "Oslo"}, ["id = 1", "id = 2"], "1 AND 2") == 0
    assert values(store.read("users"), "city") == [("Paris",), ("Rome",)]
    dml.auto_upsert(store, spark.createDataFrame([("2", "bob", "x", "7")], "ID string, `User-Name` string, username string, Age string"), "users", ["id"])
    assert "age" in store.read("users").columns and store.read("users").where("id = 2").first()["age"] == 7
    assert dml.auto_update(store, "users", [{"city": "Bonn"}], "id = 1") == 1
    assert dml.lazy_upsert(store, [{"id": 9, "username": "z"}], "users", ["id"]).method == "lazy_only"


def test_ordinals(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as v")
    got = with_ordinal(df, ["v"])
    assert got.where(F.col(ORDINAL) != F.col("v") + 1).count() == 0 and got.count() == 1000
    ties = spark.range(100).selectExpr("id % 3 as k", "100 - id as v").repartition(7)
    assert with_ordinal(ties, ["k"]).withColumn("want", F.row_number().over(W.orderBy("k", "v"))).where(f"want != {ORDINAL}").count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 99)), min_size=1, max_size=12))
def test_upsert_equals_one_by_one(spark, rows):
    target = spark.createDataFrame([(i, -1) for i in range(3)], "k int, v int")
    expected = {i: -1 for i in range(3)}
    for k, v in rows:
        expected[k] = v
    source = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], f"k int, v int, {ORDINAL} int")
    assert values(dml.upserted(target, source, ["k"])) == sorted(expected.items())


# DDL, files, harness, pipeline, stream


def employees(spark):
    rows = [(1, "a", None, 1.5, True, dt.datetime(2020, 1, 1), None), (2, "b", "x@y", None, False, dt.datetime(2021, 1, 1), "c"), (3, "c", "z@y", 2.5, True, dt.datetime(2022, 1, 1), None)]
    return spark.createDataFrame(rows, "user_id long, user_name string, email string, salary double, is_active boolean, hire_date timestamp, comment string")


@pytest.mark.parametrize("server", ["oracle", "sqlite", "mssql", "mysql", "postgres"])
def test_ddl(spark, server):
    keys = ddl.Keys(("user_id",), (("email",),), autoincrement=("user_id", 100))
    made = ddl.df_ddl(employees(spark), "emp", server, keys, schema=None if server == "sqlite" else "hr", sanitize=True, lengths={"user_name": 50})
    assert made.sql.startswith("CREATE TABLE") and made.sql.count("PRIMARY KEY") == 1
    assert ("VARCHAR2(50)" in made.sql or "VARCHAR(50)" in made.sql) == (server in ("oracle", "mssql", "mysql"))
    assert made.json["row_count"] == 3 and made.json["columns"][0]["nullable"] is False
    with pytest.raises(ValueError):
        ddl.df_ddl(employees(spark), "emp", server, ddl.Keys(("is_active",)), sanitize=True)
    if server == "sqlite":
        with pytest.raises(ValueError):
            ddl.df_ddl(employees(spark), "emp", server, ddl.Keys(("user_name",), autoincrement=("user_id", 1)), sanitize=True)


def test_ddl_helpers(spark, store):
    with pytest.raises(ValueError):
        ddl.df_ddl(employees(spark), "emp", "oracle", ddl.Keys(("nope",)), sanitize=True)
    made = ddl.create_and_load(store, employees(spark), "emp", ["oracle", "db2"])
    assert [m.status for m in made] == ["created", "failed"] and store.count("emp") == 3
    made = ddl.create_and_load(store, employees(spark), "all5", list(I.DIALECTS))
    assert {m.status for m in made} == {"created"} and store.tables("all5") == ["all5"] and [m.sql for m in made] == [ddl.df_ddl(employees(spark), "all5", s, ddl.Keys(("user_id",)), sanitize=True).sql for s in I.DIALECTS]
    assert "user_id = Column(BigInteger, primary_key=True)" in ddl.model_source(employees(spark).schema, "emp", ddl.Keys(("user_id",)))
    assert ddl.add_column_sql("t", "c", ddl.added_type(employees(spark).schema["comment"].dataType, "mssql", 5000), "mssql") == "ALTER TABLE t ADD [c] VARCHAR(MAX)"
    assert ddl.frame_schema(employees(spark), "postgres").columns["hire_date"] == "TIMESTAMP"


def test_csv(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    (tmp_path / "in.csv").write_text("a,b\n1,NA\nnan,x\n")
    df = files.read_csv(spark, path)
    assert values(df) == [("1", None), (None, "x")] or values(df) == [(None, "x"), ("1", None)]
    files.overwrite_csv(df.where("a is not null"), path)
    assert values(files.read_csv(spark, path), "a") == [("1",)]
    assert files.write_schema_json(spark, str(tmp_path), "oracle", "t", {"a": 1}).endswith("oracle_t_schema.json")


def test_csv_create_and_load(spark, store, tmp_path):
    (tmp_path / "in.csv").write_text("User ID,Amount\n" + "".join(f'{i},"${i},500"\n' for i in range(9)))
    made = ddl.csv_create_and_load(store, str(tmp_path / "in.csv"), "pay", ["oracle", "postgres"], save_back=True, folder=str(tmp_path / "schema"))
    assert [(m.status, m.rows) for m in made] == [("created", 9)] * 2 and store.primary_key("pay") == ("user_id",)
    assert values(files.read_csv(spark, str(tmp_path / "in.csv")), "amount")[0] == ("1500",) or values(files.read_csv(spark, str(tmp_path / "in.csv")), "amount")[0] == ("500",)
    assert sorted(p.name for p in (tmp_path / "schema").iterdir() if p.suffix == ".json") == ["oracle_pay_schema.json", "postgres_pay_schema.json"]
    assert ddl.csv_create_and_load(store, str(tmp_path / "in.csv"), "pay2", ["oracle"], ddl.Keys(("nope",)))[0].status == "failed"


def test_utc_times(spark):
    raw = ["2023-01-02T03:04:05+02:00", "2023-01-02 03:04:05Z", "2023-01-02 03:04:05", "13/02/2023", "2023-01-02 03:04:05+0530", "x", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, t string")
    d = dt.datetime
    want = [d(2023, 1, 2, 1, 4, 5), d(2023, 1, 2, 3, 4, 5), d(2023, 1, 2, 3, 4, 5), d(2023, 2, 13), d(2023, 1, 1, 21, 34, 5), None, None]
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            c = coerce.timestamp(F.col("t"), df.schema["t"].dataType, utc=True)
            assert [r[0] for r in df.orderBy("i").select(c.value).collect()] == want
            instant = coerce.timestamp(F.col("t"), df.schema["t"].dataType, utc=True, naive=False)
            assert dict(df.select(instant.value.alias("v")).dtypes)["v"] == "timestamp"
            assert [r[0] for r in df.orderBy("i").select(F.to_utc_timestamp(instant.value, zone).cast("timestamp_ntz")).collect()] == want
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_missing_columns_may_be_allowed(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    with pytest.raises(ValueError):
        predicate.where(df, ["x = 1", "gone = 3"])
    assert predicate.where(df, ["x = 1", "gone = 3"], allow_missing=True).count() == 0
    assert values(predicate.where(df, ["x = 1", "gone = 3"], "1 OR 2", allow_missing=True)) == [(1,)]


def test_harness_and_cycle(spark, store):
    rows = [(i, f"u{i}", None if i in (4, 7) else i / 2, i % 2 == 0, dt.datetime(2024, 1, i), f"n{i}") for i in range(1, 11)]
    df = spark.createDataFrame(rows, "id long, username string, score double, active boolean, joined timestamp_ntz, note string")
    checks, where = CrudCycle(store).run(df, ["id"], ["username"], "t", where=["id = 3"])
    assert all(c.passed for c in checks), list(map(str, checks))
    assert where.sql == "id = :id_1" and store.count("t") == 8
    for bad in (df.limit(9), df):
        with pytest.raises(ValueError):
            Harness(bad, ["id"], ["id"] if bad is df else ["username"])


def test_csv_job(spark, store, tmp_path):
    (tmp_path / "in.csv").write_text("Order ID,Amount,Created At\n" + "".join(f"{i},\"${i},500\",2024-01-{i + 1:02d}\n" for i in range(20)))
    job = CsvJob(spark, Config(str(tmp_path / "in.csv"), "orders_in"), store)
    report = job.run()
    assert report.all_passed(), report
    assert dict(store.read("orders_in").dtypes) == {"order_id": "bigint", "amount": "bigint", "created_at": "timestamp_ntz"}
    assert CsvJob(spark, Config(str(tmp_path / "none.csv"), "t"), store).run().operations[-1].status == "failed"


def test_stream(spark, store, tmp_path):
    store.create("users", USERS)
    src = str(tmp_path / "src")
    spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, username string, city string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("id long, username string, city string").parquet(src)
    upsert_stream(stream, store, "users", ["id"], str(tmp_path / "check")).awaitTermination(60)
    assert store.count("users") == 2


def test_types_and_log(spark, tmp_path, monkeypatch):
    assert TableSchema.from_json(USERS.to_json()) == USERS
    registry = TypeRegistry()
    registry.register(lambda t: t.typeName() == "string", Logical.JSON)
    assert registry.logical(spark.createDataFrame([], "a string").schema["a"].dataType) is Logical.JSON
    monkeypatch.setenv(log.SWITCH, "1")
    handler = log.attach(str(tmp_path / "logs"))
    assert log.log_call(lambda x: x + 1)(1) == 2
    log.log_frame("f", spark.range(3))
    assert "struct<id:bigint>" in next((tmp_path / "logs").iterdir()).read_text()
    log.LOG.removeHandler(handler)
