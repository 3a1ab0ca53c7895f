"""Queries whose answers are text, names, types or reports, and those over casting and correction that the catalogue's first part lacks."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import identifiers as I
from ..functions import parse
from ..functions.clean import CleaningConfig, clean_text, clean_value, quick_clean, robust_clean
from ..functions.types import REGISTRY, ColumnSpec, Constraints, Logical, TableSchema, schema_of
from ..operators import cast, coerce, correct, mapping, outliers, predicate, profile, validate
from ..sources import files
from ..sources.store import Store
from . import ddl, log
from .registry import events_text, fixed, query, read


def answers(spark, rows, columns: str = "what string, answer string"):
    return spark.createDataFrame(rows, columns)


# Conditions and statements


@query("SELECT o_orderkey FROM orders WHERE (o_custkey < 300 AND o_orderstatus = 'F') OR o_totalprice > 200000")
def where_nested(spark, sf_dir):
    conditions = [[{"field": "O_CUSTKEY", "operator": "<", "value": 300}, ("o_orderstatus", "=", "F")], "o_totalprice > 200000"]
    return predicate.select(read(spark, sf_dir, "orders"), conditions, ["o_orderkey"], "1 OR 2")


@query("SELECT o_orderkey FROM orders WHERE o_custkey < 100")
def where_allow_missing(spark, sf_dir):
    return predicate.select(read(spark, sf_dir, "orders"), ["o_custkey < 100", "gone = 1"], ["o_orderkey"], "1 OR 2", allow_missing=True)


@query(fixed("dialect, accepted", [("sqlite", True), ("postgres", True), ("postgresql", True), ("oracle", True), ("mysql", True), ("mssql", True), ("db2", False), ("Oracle", False)]))
def where_dialects(spark, sf_dir):
    def accepted(d):
        try:
            predicate.where_sql(predicate.bind("a = 1", ["a"]), None, d)
        except ValueError:
            return False
        return True

    return answers(spark, [(d, accepted(d)) for d in ("sqlite", "postgres", "postgresql", "oracle", "mysql", "mssql", "db2", "Oracle")], "dialect string, accepted boolean")


@query(fixed("statement, sql, params", [
    ("select", "SELECT cell, vendor FROM net WHERE (cell = :cell_1 AND (vendor IN (:vendor_2_0, :vendor_2_1) OR tech LIKE :tech_3 ESCAPE '\\'))", '{"cell_1": "00123", "tech_3": "%2G\\\\_%", "vendor_2_0": "GP", "vendor_2_1": "BL"}'),
    ("select all", "SELECT * FROM net WHERE dt BETWEEN :dt_1_0 AND :dt_1_1", '{"dt_1_0": "2023-01-01", "dt_1_1": "2023-01-31"}'),
    ("update", "UPDATE quota SET cost_code = :u_cost_code WHERE COST_ID = :COST_ID_1", '{"COST_ID_1": 1001, "u_cost_code": "N"}'),
    ("insert", "INSERT INTO quota (a, b) VALUES (:i_a, :i_b)", '{"i_a": 1, "i_b": "x"}'),
]))
def statements(spark, sf_dir):
    row = {"cell": "x", "vendor": "y", "tech": "z", "dt": "d"}
    made = {
        "select": predicate.build_select(row, "net", ["cell = '00123'", ("vendor", "IN", ["GP", "BL"]), {"field": "tech", "operator": "LIKE", "value": "2G_"}], "oracle", "1 AND (2 OR 3)", ["cell", "vendor"]),
        "select all": predicate.build_select([row], "net", "dt BETWEEN '2023-01-01' and '2023-01-31'"),
        "update": predicate.build_update({"cost_code": "N"}, "quota", [("COST_ID", "=", 1001)]),
        "insert": predicate.build_insert({"a": 1, "b": "x"}, "quota"),
    }
    return answers(spark, [(k, w.sql, json.dumps(w.params, sort_keys=True)) for k, w in made.items()], "statement string, sql string, params string")


# Names and values


@query(fixed("what, answer", [
    ("headers", "order|customer_id|2nd|a|a_1|a_1_1|col_6|class"), ("headers in case", "Order|Customer_ID|2nd|a|a_1|a_1_1|col_6|class"), ("sanitised", "order_|customer_id|_2nd|a|a_1|a_1_1|col_6|class_"),
    ("sanitised mysql", "order|customer_id|_2nd|a|a_1|a_1_1|col_6|class_"), ("sanitised text", "x_y"), ("sanitised keys", "a_b"), ("normalised", "customer_id|2nd_name|ab"), ("oracle", '"ORDER"|A_B|"X Y"'), ("postgresql", '"order"|a_b|"x y"'),
    ("mysql", "order|a_b|`x y`"), ("mssql", "[order]|[a_b]|[x y]|[a]]b]"), ("constraint", "a_table_name_of_more_than_thirt"[:30]),
]))
def names(spark, sf_dir):
    raw = ["Order", " Customer ID ", "2nd", "a", "a", "a_1", "", "class"]
    found = {
        "headers": I.clean_headers(raw), "headers in case": I.clean_headers(raw, lower=False), "sanitised": I.sanitize(raw, dialect="oracle"), "sanitised mysql": I.sanitize(raw, dialect="mysql"), "sanitised text": [I.sanitize("x y")],
        "sanitised keys": list(I.sanitize({"A b": 1})), "normalised": [I.normalize(x) for x in (" Customer-ID ", "2nd  Name", "a!b")],
        **{d: [I.escape(x, d) for x in ("order", "a_b", "x y", *(["a]b"] if d == "mssql" else []))] for d in ("oracle", "postgresql", "mysql", "mssql")},
        "constraint": [I.constraint_name("a_table_name_of_more_than_thirty_characters")],
    }
    return answers(spark, [(k, "|".join(v)) for k, v in found.items()])


VALUES = (("nbsp", "a\u00a0b"), ("zero width", "a\u200bb"), ("bom", "\ufeffx"), ("quotes", "\u201cq\u201d"), ("dash", "\u2013"), ("dots", "\u2026"), ("ligature", "\ufb01"), ("wide", "\uff11\uff12"), ("cyrillic", "\u0410"), ("bell", "a\x07b"), ("soft hyphen", "a\u00adb"), ("private", "a\ue000b"), ("tab", "a\tb "), ("none", None))


@query(fixed("what, answer, bare", [("nbsp", "a b", "a b"), ("zero width", "ab", "ab"), ("bom", "x", "x"), ("quotes", '"q"', "q"), ("dash", "-", ""), ("dots", "...", ""), ("ligature", "fi", "fi"), ("wide", "12", "12"), ("cyrillic", "A", "A"), ("bell", "ab", "ab"), ("soft hyphen", "ab", "ab"), ("private", "ab", "ab"), ("tab", "a\tb", "a\tb"), ("none", None, None)]))
def clean_values(spark, sf_dir):
    return answers(spark, [(k, clean_value(v), clean_value(v, CleaningConfig(remove_special=True))) for k, v in VALUES], "what string, answer string, bare string")


@query(fixed("what, answer", [(k, {"nbsp": "a b", "zero width": "ab", "bom": "x", "quotes": '"q"', "dash": "-", "dots": "...", "ligature": "fi", "wide": "12", "cyrillic": "A", "tab": "a\tb", "none": None}.get(k, "ab")) for k, _ in VALUES]))
def clean_value_column(spark, sf_dir):
    """What single values become, as an expression."""
    df = answers(spark, VALUES)
    return df.select("what", clean_text(F.col("answer"), CleaningConfig(all_controls=True)).alias("answer"))


@query("SELECT c_custkey AS customer_key, trim(c_name) AS full_name, c_acctbal AS col_2 FROM customer")
def robust_clean_frame(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("Customer  Key"), F.concat(F.lit("\u00a0 "), F.col("c_name"), F.lit("\u200b\u2003")).alias(" Full-Name"), F.col("c_acctbal").alias("!"))
    return robust_clean(df)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE replace(replace('ﬁ ' || c_custkey || ' １２', 'ﬁ', 'fi'), '１２', '12') END AS t FROM customer")
def quick_clean_forms(spark, sf_dir):
    df = read(spark, sf_dir, "customer")
    return quick_clean(df.select(F.col("c_custkey").alias("ID"), F.when(F.col("c_custkey") % 5 == 0, "NAN").otherwise(F.concat(F.lit(" ﬁ "), F.col("c_custkey").cast("string"), F.lit(" １２\x07 "))).alias("T")))


# Casting


KINDS = "case event_id % 8 when 0 then '2024-01-02 03:04:05' when 1 then '2024-01-02' when 2 then '13/02/2024' when 3 then 'Yes' when 4 then '-12' when 5 then '.5' when 6 then '1e5' else 'word' end"


@query("SELECT CASE event_id % 8 WHEN 0 THEN 'timestamp' WHEN 1 THEN 'date' WHEN 2 THEN 'date' WHEN 3 THEN 'boolean' WHEN 4 THEN 'integer' WHEN 5 THEN 'float' WHEN 6 THEN 'float' ELSE 'string' END AS kind, count(*) AS n FROM events GROUP BY ALL")
def pattern_inference(spark, sf_dir):
    return events_text(spark, sf_dir, t=KINDS).groupBy(cast.inferred(F.col("t")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT event_id, event_id * 2 AS whole, event_id + 0.25::DOUBLE AS part, event_id % 2 = 0 AS flag, TIMESTAMP '2024-01-01' + INTERVAL (event_id % 28) DAY AS day, CASE WHEN event_id % 3 = 0 THEN 'x' ELSE '1' END AS mixed FROM events")
def cast_by_column(spark, sf_dir):
    df = events_text(spark, sf_dir, whole="cast(event_id * 2 as string)", part="concat(cast(event_id as string), '.25')", flag="case when event_id % 2 = 0 then 'yes' else 'no' end",
                     day="concat('2024-01-', lpad(cast(event_id % 28 + 1 as string), 2, '0'))", mixed="case when event_id % 3 = 0 then 'x' else '1' end")
    return cast.auto_cast(df, by_column=True)


@query("SELECT event_id, CASE WHEN event_id % 13 > 0 THEN event_id END AS auto, CASE WHEN event_id % 13 > 0 THEN event_id::VARCHAR ELSE 'x' END AS safe, CASE WHEN event_id % 13 > 0 THEN event_id END AS fast FROM events")
def cast_presets(spark, sf_dir):
    """One value in thirteen is no number: fewer than a tenth, but more than a twentieth."""
    df = events_text(spark, sf_dir, x="case when event_id % 13 > 0 then cast(event_id as string) else 'x' end")
    made = [f(df).select("event_id", F.col("x").alias(n)) for n, f in (("auto", cast.auto_cast), ("safe", cast.safe_cast), ("fast", cast.fast_cast))]
    return made[0].join(made[1], "event_id").join(made[2], "event_id")


@query("SELECT event_id, props, '2024-01-01' AS created, '7' AS kept FROM events")
def cast_leaves_json_and_named_types(spark, sf_dir):
    """JSON stays text, also under a name that suggests a date; a type that is named is not inferred."""
    df = events_text(spark, sf_dir, props="props", created="'2024-01-01'", kept="'7'")
    return cast.cast_df(df, {"kept": "string", "created": "string"}).select("event_id", "props", "created", "kept")


@query("SELECT event_type AS v FROM (SELECT DISTINCT ON (md5(v), v) v AS event_type, md5(v) AS m FROM (SELECT event_type || event_id AS v FROM events WHERE event_id % 4 > 0)) ORDER BY m, event_type LIMIT 25")
def smart_sample(spark, sf_dir):
    df = events_text(spark, sf_dir, v="case when event_id % 4 > 0 then concat(event_type, event_id) end")
    return cast.sample_values(df, "v", 25)


@query(fixed("name, kind", [("props", "STRUCTURED_OBJECT"), ("words", "STRING_OBJECT"), ("nothing", "STRING_OBJECT"), ("pair", "STRUCTURED_OBJECT"), ("event_id", "TRUE_OBJECT"), ("some", "STRING_OBJECT")]))
def semantic_kinds(spark, sf_dir):
    df = events_text(spark, sf_dir, props="props", words="event_type", nothing="cast(null as string)", pair="named_struct('a', 1)", some="case when event_id % 5 = 0 then 'x' else props end")
    return answers(spark, list(cast.semantic_types(df, ["props", "words", "nothing", "pair", "event_id", "some"]).items()), "name string, kind string")


# Coercion and correction


def coerced(df, found: coerce.Coerced):
    return df.select("event_id", found.value.alias("value"), found.failed.alias("failed"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 1500.0::DOUBLE WHEN 1 THEN -0.25 WHEN 2 THEN event_id::DOUBLE END AS value, event_id % 6 BETWEEN 3 AND 4 AS failed FROM events")
def strict_float(spark, sf_dir):
    df = events_text(spark, sf_dir, t="case event_id % 6 when 0 then ' 1.5e3 ' when 1 then '-.25' when 2 then cast(event_id as string) when 3 then '12d' when 4 then 'nan' end")
    return coerced(df, correct.strict(F.col("t"), df.schema["t"].dataType, ColumnSpec("t", Logical.DECIMAL, "double")))


@query("SELECT event_id, CASE WHEN len(event_type) <= 5 THEN event_type END AS value, len(event_type) > 5 AS failed FROM events")
def strict_string(spark, sf_dir):
    df = events_text(spark, sf_dir, t="event_type")
    return coerced(df, correct.strict(F.col("t"), df.schema["t"].dataType, ColumnSpec("t", Logical.STRING, "string", length=5)))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN TIMESTAMP '2023-01-02 01:04:05' WHEN 1 THEN TIMESTAMP '2023-01-02 03:04:05' WHEN 2 THEN TIMESTAMP '2023-02-13' WHEN 3 THEN TIMESTAMP '2023-01-01 21:34:05' END AS value, event_id % 5 = 4 AS failed FROM events")
def strict_datetime_utc(spark, sf_dir):
    df = events_text(spark, sf_dir, t="case event_id % 5 when 0 then '2023-01-02T03:04:05+02:00' when 1 then '2023-01-02 03:04:05' when 2 then '13/02/2023' when 3 then '2023-01-02 03:04:05+0530' else '25:00' end")
    return coerced(df, coerce.timestamp(F.col("t"), df.schema["t"].dataType, utc=True))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{\"a\":[1,2]}' WHEN 1 THEN '5' END AS value, event_id % 4 > 1 AS failed FROM events")
def strict_json(spark, sf_dir):
    df = events_text(spark, sf_dir, t="case event_id % 4 when 0 then ' {\"a\": [1, 2]}' when 1 then '5' when 2 then '{' else 'null' end")
    return coerced(df, correct.strict(F.col("t"), df.schema["t"].dataType, ColumnSpec("t", Logical.JSON, "string")))


@query("SELECT event_id, hex(event_type) AS raw, false AS raw_failed, NULL::VARCHAR AS txt, event_id % 2 = 0 AS txt_failed FROM events")
def binary_columns(spark, sf_dir):
    df = events_text(spark, sf_dir, b="cast(event_type as binary)", t="case when event_id % 2 = 0 then event_type end")
    spec = ColumnSpec("b", Logical.BINARY, "binary")
    raw, text = (coerce.coerce(F.col(c), df.schema[c].dataType, spec) for c in "bt")
    return df.select("event_id", F.hex(raw.value).alias("raw"), raw.failed.alias("raw_failed"), F.hex(text.value).alias("txt"), text.failed.alias("txt_failed"))


def tenth_bad(spark, sf_dir):
    """A tenth of the values fail."""
    return events_text(spark, sf_dir, n="case when event_id % 10 > 0 then cast(event_id as string) else 'x' end")


NUMBERS = (ColumnSpec("event_id", Logical.INTEGER, "bigint"), ColumnSpec("n", Logical.INTEGER, "bigint"))


@query(fixed("how, outcome", [("no threshold", "raised"), ("0.05", "raised"), ("0.2", "100 nulls a thousand"), ("20 percent", "100 nulls a thousand"), ("-1", "raised"), ("lenient", "100 nulls a thousand"), ("raise, lenient", "raised"), ("not null", "raised"), ("not null, 0.2", "100 nulls a thousand"), ("length", "raised"), ("repeated key", "raised"), ("repeated key, lenient", "100 nulls a thousand")]))
def failure_gate(spark, sf_dir):
    df = tenth_bad(spark, sf_dir)
    plain = TableSchema(NUMBERS)
    needed = TableSchema((NUMBERS[0], ColumnSpec("n", Logical.INTEGER, "bigint", nullable=False)))
    cases = {
        "no threshold": (plain, {}), "0.05": (plain, {"failure_threshold": 0.05}), "0.2": (plain, {"failure_threshold": 0.2}), "20 percent": (plain, {"failure_threshold": 20}), "-1": (plain, {"failure_threshold": -1}),
        "lenient": (plain, {"strict_mode": False}), "raise, lenient": (plain, {"strict_mode": False, "on_error": "raise"}), "not null": (needed, {"strict_mode": False}), "not null, 0.2": (needed, {"failure_threshold": 0.2}),
        "length": (TableSchema((NUMBERS[0], ColumnSpec("n", Logical.STRING, "string", length=2))), {"failure_threshold": 100}),
        "repeated key": (TableSchema(NUMBERS, Constraints((), (("n",),))), {"failure_threshold": 0.2}), "repeated key, lenient": (TableSchema(NUMBERS, Constraints((), (("n",),))), {"failure_threshold": 0.2, "strict_mode": False}),
    }
    rows = []
    for name, (schema, options) in cases.items():
        try:
            out = correct.align(df, schema, **options)
            nulls, n = out.agg(F.count_if(F.col("n").isNull()), F.count("*")).first()
            rows.append((name, f"{nulls * 1000 // n} nulls a thousand"))
        except correct.CorrectionError:
            rows.append((name, "raised"))
    return answers(spark, rows, "how string, outcome string")


@query("SELECT event_id, CASE WHEN event_id % 10 > 0 THEN event_id END AS n FROM events")
def align_lenient(spark, sf_dir):
    return correct.align(tenth_bad(spark, sf_dir), TableSchema(NUMBERS), strict_mode=False)


@query("SELECT event_id, value, NULL::TIMESTAMP AS created, NULL::BOOLEAN AS active, event_id % 2 = 0 AS flag, NULL::VARCHAR AS missing, event_id AS extra FROM events")
def conform_events(spark, sf_dir):
    """Columns cast as a whole or become null; a reliable column keeps its outliers; words are no booleans, 1 and 0 are; extra columns are added."""
    df = read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("EVENT_ID"), "value", F.when(F.col("event_id") % 100 == 3, "invalid").otherwise("2023-01-01").alias("created"), F.lit("yes").alias("active"), (1 - F.col("event_id") % 2).alias("flag"), F.col("event_id").alias("Extra"))
    target = schema_of(spark.createDataFrame([], "event_id long, value double, created timestamp_ntz, active boolean, flag boolean, missing string").schema)
    return correct.conform(df, target, strict_mode=False, auto_alter=True, fix_outliers="iqr")[0]


@query("SELECT count(*) FILTER (WHERE value IS NULL)::BIGINT AS nulls, count(*) AS rows FROM (SELECT CASE WHEN event_id % 50 > 0 AND value BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a) THEN value END AS value FROM events, (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS c FROM events WHERE event_id % 50 > 0))")
def conform_fixes_unreliable_numbers(spark, sf_dir):
    df = events_text(spark, sf_dir, v="case when event_id % 50 > 0 then cast(value as string) else 'n/a' end")
    target = schema_of(spark.createDataFrame([], "event_id long, v double").schema)
    out = correct.conform(df, target, strict_mode=False, fix_outliers="iqr")[0]
    return out.agg(F.count_if(F.col("v").isNull()).alias("nulls"), F.count("*").alias("rows"))


@query("SELECT event_id, CASE WHEN event_id % 10 > 0 THEN event_id END AS n, left(event_type, 3) AS t, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id::VARCHAR END AS s FROM events")
def policies_by_column(spark, sf_dir):
    df = tenth_bad(spark, sf_dir).join(events_text(spark, sf_dir, T="event_type", S="case when event_id % 4 = 0 then null else cast(event_id as string) end"), "event_id")
    schema = TableSchema((*NUMBERS, ColumnSpec("t", Logical.STRING, "string", length=3), ColumnSpec("s", Logical.INTEGER, "bigint")))
    by_column = {"n": correct.COERCE, "t": correct.Policy(on_length=coerce.OnLength.TRUNCATE), "s": correct.Policy(logical=Logical.STRING)}
    return correct.correct(df, schema, by_column=by_column)[0]


@query(fixed("policy, outcome", [("default", "raised"), ("a tenth may fail", "null"), ("less may fail", "raised"), ("coerce", "null"), ("report", "keep"), ("iqr", "none")]))
def policy_decisions(spark, sf_dir):
    df, schema = tenth_bad(spark, sf_dir), TableSchema(NUMBERS)
    on = coerce.OnError
    cases = {"default": correct.Policy(), "a tenth may fail": correct.Policy(max_failure_rate=0.11), "less may fail": correct.Policy(max_failure_rate=0.05), "coerce": correct.COERCE, "report": correct.Policy(on.REPORT)}
    rows = []
    for name, policy in cases.items():
        try:
            rows.append((name, next(c.decision for c in correct.correct(df, schema, policy)[1].columns if c.column == "n")))
        except correct.CorrectionError:
            rows.append((name, "raised"))
    whole = df.withColumn("n", F.col("event_id").cast("string"))
    rows.append(("iqr", next(c.decision for c in correct.correct(whole, schema, correct.Policy(outliers="iqr"))[1].columns if c.column == "n")))
    return answers(spark, rows, "policy string, outcome string")


@query(fixed("check_, answer", [("required", "id"), ("required, given", ""), ("nulls", "id:2"), ("repeated", "4"), ("batch", "True"), ("whole batch", "False")]))
def batch_checks(spark, sf_dir):
    schema = TableSchema((ColumnSpec("id", Logical.INTEGER, "bigint", nullable=False), ColumnSpec("a", Logical.STRING, nullable=False, default="x"), ColumnSpec("b", Logical.STRING, nullable=False, has_server_default=True), ColumnSpec("c", Logical.STRING)))
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "b"), (2, None)], "id long, c string")
    found = {
        "required": ",".join(validate.required_missing(["c"], schema)), "required, given": ",".join(validate.required_missing(["ID"], schema)), "nulls": ",".join(f"{k}:{v}" for k, v in validate.null_counts(df, schema).items()),
        "repeated": str(validate.duplicate_rows(df, ["id"])), "batch": str(validate.has_duplicates(df, ["id"])), "whole batch": str(validate.has_duplicates(df.distinct(), ["id"])),
    }
    return answers(spark, list(found.items()), "check_ string, answer string")


@query()
def outliers_forest(spark, sf_dir):
    df = read(spark, sf_dir, "events")
    return df.where(~outliers.valid_mask(df, "value", "forest")).select("event_id", "value")


@query("SELECT 'c_name' AS name, max(len(c_name))::BIGINT AS longest, min(c_name) AS sample FROM customer UNION ALL SELECT 'c_mktsegment', max(len(c_mktsegment)), min(c_mktsegment) FROM customer")
def longest_texts(spark, sf_dir):
    df = read(spark, sf_dir, "customer")
    found, (_, sample) = ddl.longest_text(df), ddl.facts(df)
    return answers(spark, [(k, v, sample[k]) for k, v in found.items()], "name string, longest long, sample string")


@query("SELECT c_custkey AS id, c_name AS \"name\", NULL::VARCHAR AS city FROM customer")
def order_to_target(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select(F.col("c_name").alias("NAME"), F.col("c_acctbal").alias("other"), F.col("c_custkey").alias("Id"))
    df = mapping.rename(df, mapping.ignoring_case(df.columns, ["id", "name", "city"]))
    return mapping.in_order(df, ["id", "name", "city"])


@query(fixed("name, logical", [("i", "integer"), ("d", "decimal"), ("x", "decimal"), ("s", "string"), ("b", "bool"), ("t", "datetime"), ("y", "binary"), ("j", "json"), ("v", "other")]))
def type_registry(spark, sf_dir):
    struct = T.DataType.fromDDL("struct<i:int,d:decimal(9,2),x:double,s:string,b:boolean,t:timestamp,y:binary,j:array<int>,v:interval day to second>")
    return answers(spark, [(f.name, REGISTRY.logical(f.dataType).value) for f in struct], "name string, logical string")


# DDL


TYPED = "l long, d double, f float, b boolean, t timestamp, a date, y binary, s string, n decimal(12,2), j array<int>"
ORDER = ("l", "d", "f", "b", "t", "a", "y", "s", "n", "j")
#: The type of each of these columns by dialect.
SQL_TYPES = {
    "oracle": "NUMBER|BINARY_DOUBLE|BINARY_FLOAT|NUMBER(1,0)|TIMESTAMP|DATE|BLOB|VARCHAR2(40)|NUMBER(12,2)|BLOB",
    "sqlite": "INTEGER|REAL|REAL|INTEGER|DATETIME|DATE|BLOB|TEXT|NUMERIC(12,2)|BLOB",
    "mssql": "BIGINT|FLOAT|REAL|BIT|DATETIME2|DATE|VARBINARY(MAX)|VARCHAR(40)|DECIMAL(12,2)|VARBINARY(MAX)",
    "mysql": "BIGINT|DOUBLE|FLOAT|TINYINT|DATETIME|DATE|BLOB|VARCHAR(40)|DECIMAL(12,2)|JSON",
    "postgresql": "BIGINT|DOUBLE PRECISION|REAL|BOOLEAN|TIMESTAMP|DATE|BYTEA|TEXT|NUMERIC(12,2)|JSONB",
}
ADDED_TYPES = {
    "oracle": "NUMBER(19)|NUMBER|BINARY_FLOAT|NUMBER(1)|TIMESTAMP|DATE|BLOB|VARCHAR2(255)|NUMBER(12,2)|CLOB|CLOB",
    "sqlite": "INTEGER|FLOAT|REAL|INTEGER|TEXT|DATE|BLOB|VARCHAR(255)|NUMERIC(12,2)|TEXT|TEXT",
    "mssql": "BIGINT|FLOAT|REAL|BIT|TIMESTAMP|DATE|VARBINARY(MAX)|VARCHAR(255)|DECIMAL(12,2)|TEXT|VARCHAR(MAX)",
    "mysql": "BIGINT|FLOAT|FLOAT|BOOLEAN|TIMESTAMP|DATE|BLOB|VARCHAR(255)|DECIMAL(12,2)|JSON|TEXT",
    "postgresql": "BIGINT|DOUBLE PRECISION|REAL|BOOLEAN|TIMESTAMP WITH TIME ZONE|DATE|BYTEA|VARCHAR(255)|NUMERIC(12,2)|JSONB|TEXT",
}


@query(fixed("server, types, added", [(s, SQL_TYPES[s], ADDED_TYPES[s]) for s in SQL_TYPES]))
def sql_types(spark, sf_dir):
    struct = T.DataType.fromDDL("struct<" + ",".join(":".join(x.split(" ", 1)) for x in TYPED.split(", ")) + ">")
    rows = []
    for s in SQL_TYPES:
        added = [ddl.added_type(struct[c].dataType, s, 12 if c == "s" else None) for c in ORDER]
        rows.append((s, "|".join(ddl.sql_type(struct[c].dataType, s, 40) for c in ORDER), "|".join([*added, ddl.added_type(struct["s"].dataType, s, 5000)])))
    return answers(spark, rows, "server string, types string, added string")


def customer_ddl(spark, sf_dir, server: str, **more) -> ddl.Ddl:
    keys = ddl.Keys(("c_custkey",), (("c_name",),), (ddl.ForeignKey(("c_nationkey",), "nation", ("n_nationkey",)),), more.pop("auto", None))
    return ddl.df_ddl(read(spark, sf_dir, "customer"), "customer", server, keys, lengths={"c_name": 40}, **more)


def _customer_sql(quote, key: str, text: str, name: str, number: str, int_: str, constraint) -> str:
    q = quote
    lines = [f"{q('c_custkey')} {key}", f"{q('c_name')} {name} NOT NULL", f"{q('c_nationkey')} {int_} NOT NULL", f"{q('c_acctbal')} {number} NOT NULL", f"{q('c_mktsegment')} {text} NOT NULL"]
    lines += [constraint("customer_PK", f"PRIMARY KEY ({q('c_custkey')})"), constraint("customer_fk1", f"FOREIGN KEY ({q('c_nationkey')}) REFERENCES {q('nation')}({q('n_nationkey')})"), constraint("customer_uq1", f"UNIQUE ({q('c_name')})")]
    return f"CREATE TABLE {q('customer')} (\n    " + ",\n    ".join(lines) + "\n)"


#: The statements that are expected, put together from the dialects' fixed parts.
CUSTOMER_SQL = {
    "oracle": _customer_sql(str.upper, "NUMBER NOT NULL", "VARCHAR2(255)", "VARCHAR2(40)", "BINARY_DOUBLE", "NUMBER", lambda n, x: f"CONSTRAINT {n.upper()} {x}"),
    "sqlite": _customer_sql(str, "INTEGER NOT NULL", "TEXT", "TEXT", "REAL", "INTEGER", lambda n, x: x),
    "mssql": _customer_sql(lambda c: f"[{c}]", "BIGINT NOT NULL", "VARCHAR(255)", "VARCHAR(40)", "FLOAT", "BIGINT", lambda n, x: f"CONSTRAINT [{n}] {x}"),
    "mysql": _customer_sql(str, "BIGINT NOT NULL", "VARCHAR(255)", "VARCHAR(40)", "DOUBLE", "BIGINT", lambda n, x: f"CONSTRAINT {n} {x}"),
    "postgres": _customer_sql(str, "BIGINT NOT NULL", "TEXT", "TEXT", "DOUBLE PRECISION", "BIGINT", lambda n, x: f"CONSTRAINT {n} {x}"),
}


@query(fixed("server, sql", CUSTOMER_SQL.items()))
def ddl_five_dialects(spark, sf_dir):
    return answers(spark, [(s, customer_ddl(spark, sf_dir, s).sql) for s in CUSTOMER_SQL], "server string, sql string")


COUNTED = {"oracle": "C_CUSTKEY NUMBER GENERATED ALWAYS AS IDENTITY (START WITH 100 INCREMENT BY 1) NOT NULL", "sqlite": "c_custkey INTEGER PRIMARY KEY AUTOINCREMENT NOT NULL", "mssql": "[c_custkey] BIGINT IDENTITY(100,1) NOT NULL", "mysql": "c_custkey BIGINT AUTO_INCREMENT NOT NULL", "postgres": "c_custkey SERIAL NOT NULL"}


@query(fixed("server, line, keys", [(s, x, 1) for s, x in COUNTED.items()]))
def ddl_counts_up(spark, sf_dir):
    made = [(s, customer_ddl(spark, sf_dir, s, auto=("c_custkey", 100)).sql) for s in COUNTED]
    return answers(spark, [(s, x.split("\n")[1].strip().rstrip(","), x.count("PRIMARY KEY")) for s, x in made], "server string, line string, keys long")


@query(fixed("server, sql", [("oracle", "ALTER TABLE hr.t ADD \"c\" CLOB"), ("sqlite", 'ALTER TABLE t ADD COLUMN "c" TEXT'), ("mssql", "ALTER TABLE t ADD [c] VARCHAR(MAX)"), ("mysql", "ALTER TABLE t ADD COLUMN `c` TEXT"), ("postgresql", 'ALTER TABLE t ADD COLUMN "c" TEXT')]))
def ddl_add_column(spark, sf_dir):
    kind = T.StringType()
    return answers(spark, [(s, ddl.add_column_sql("t", "c", ddl.added_type(kind, s, 5000), s, "hr" if s == "oracle" else None)) for s in I.DIALECTS], "server string, sql string")


@query(fixed("case_, refused", [("reserved word", True), ("blank in a name", True), ("sanitised", False), ("key that repeats", True), ("key that isn't there", True), ("unknown dialect", True), ("two keys in sqlite", True)]))
def ddl_refusals(spark, sf_dir):
    df = read(spark, sf_dir, "nation")
    odd = df.select(F.col("n_nationkey").alias("order"), F.col("n_name").alias("n name"))
    cases = {
        "reserved word": lambda: ddl.df_ddl(odd.select("order"), "t"), "blank in a name": lambda: ddl.df_ddl(odd.select("`n name`"), "t"), "sanitised": lambda: ddl.df_ddl(odd, "t", keys=ddl.Keys(("order",)), sanitize=True),
        "key that repeats": lambda: ddl.df_ddl(df, "t", keys=ddl.Keys(("n_regionkey",))), "key that isn't there": lambda: ddl.df_ddl(df, "t", keys=ddl.Keys(("x",))), "unknown dialect": lambda: ddl.df_ddl(df, "t", "db2"),
        "two keys in sqlite": lambda: ddl.df_ddl(df, "t", "sqlite", ddl.Keys(("n_name",), autoincrement=("n_nationkey", 1))),
    }

    def refused(act):
        try:
            act()
        except ValueError:
            return True
        return False

    return answers(spark, [(k, refused(f)) for k, f in cases.items()], "case_ string, refused boolean")


def _column(name: str, kind: str, dtype: str, table: str = "customer") -> str:
    return f"SELECT '{name}' AS name, '{dtype}' AS dtype, '{kind}' AS sql, false AS nullable, min({name}::VARCHAR) AS sample, count(*) AS rows, '[\"c_custkey\"]' AS key FROM {table}"


@query(" UNION ALL ".join(_column(*x) for x in (("c_custkey", "BIGINT", "bigint"), ("c_name", "TEXT", "string"), ("c_nationkey", "BIGINT", "int"), ("c_mktsegment", "TEXT", "string"))))
def schema_json(spark, sf_dir):
    """The sidecar as it is written and read again."""
    root = Store.sandbox(spark).root
    df = read(spark, sf_dir, "customer").drop("c_acctbal")
    path = files.write_schema_json(spark, root, "postgresql", "customer", ddl.schema_json(df, "customer", "postgres", ddl.Keys(("c_custkey",))))
    found = json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))
    return answers(spark, [(c["name"], c["dtype"], c["sql"], c["nullable"], c["sample"], found["row_count"], json.dumps(found["primary_key"])) for c in found["columns"]], "name string, dtype string, sql string, nullable boolean, sample string, rows long, key string")


MODEL = """from sqlalchemy import Column, BigInteger, Float, String
from sqlalchemy.orm import declarative_base

Base = declarative_base()


class Customer(Base):
    __tablename__ = "customer"

    c_custkey = Column(BigInteger, primary_key=True)
    c_name = Column(String(255), nullable=True, unique=True)
    c_nationkey = Column(BigInteger, nullable=True)
    c_acctbal = Column(Float, nullable=True)
    c_mktsegment = Column(String(255), nullable=False)
"""


@query(fixed("line, text", [(i, x) for i, x in enumerate(MODEL.split("\n"))]))
def model_source(spark, sf_dir):
    text = ddl.model_source(read(spark, sf_dir, "customer").schema, "customer", ddl.Keys(("c_custkey",), (("c_name",),)), {"c_mktsegment": False})
    return answers(spark, list(enumerate(text.split("\n"))), "line long, text string")


@query(fixed("name, postgres, mysql", [("event_id", "BIGINT", "BIGINT"), ("day", "TIMESTAMP", "DATETIME"), ("kind", "TEXT", "VARCHAR(255)"), ("long", "TEXT", "TEXT"), ("score", "DOUBLE PRECISION", "DOUBLE"), ("flag", "BOOLEAN", "TINYINT")]))
def frame_schema(spark, sf_dir):
    df = events_text(spark, sf_dir, day="'2024-01-02'", kind="event_type", long="repeat(event_type, 60)", score="value", flag="event_id > 3").withColumnRenamed("day", "day")
    df = df.withColumnRenamed("day", "created")
    a, b = (ddl.frame_schema(df, s).columns for s in ("postgres", "mysql"))
    return answers(spark, [("day" if c == "created" else c, a[c], b[c]) for c in df.columns], "name string, postgres string, mysql string")


@query(fixed("name, type, length", [("whole", "bigint", None), ("part", "decimal(38,10)", None), ("short", "string", 255), ("long", "string", None), ("flag", "boolean", None), ("day", "timestamp_ntz", None), ("none", "string", 255), ("customer_id", "bigint", None)]))
def added_columns(spark, sf_dir):
    df = events_text(spark, sf_dir, whole="cast(event_id as string)", part="concat(event_id, '.5')", short="event_type", long="repeat(event_type, 60)", flag="event_id > 3", day="ts", none="cast(null as string)")
    df = df.withColumn("Customer ID", F.col("event_id"))
    made = [correct.added_spec(df, c) for c in df.columns if c != "event_id"]
    return answers(spark, [(c.name, c.type, c.length) for c in made], "name string, type string, length long")


@query(fixed("server, status, rows", [("oracle", "created", 25), ("db2", "failed", 0), ("postgres", "created", 25)]))
def create_and_load(spark, sf_dir):
    made = ddl.create_and_load(Store.sandbox(spark), read(spark, sf_dir, "nation"), "nation", ["oracle", "db2", "postgres"])
    return answers(spark, [(m.server, m.status, m.rows) for m in made], "server string, status string, rows long")


# Jobs


@query("SELECT * FROM (VALUES ('load', 'passed'), ('key', 'passed'), ('ddl', 'passed'), ('insert', 'passed'), ('upsert', 'passed'), ('update', 'passed')) AS s(operation, status), (SELECT count(*) AS n FROM supplier) WHERE n > 0")
def pipeline_report(spark, sf_dir):
    from .pipeline import Config, CsvJob

    store, df = Store.sandbox(spark), read(spark, sf_dir, "supplier")
    df.write.csv(f"{store.root}/in.csv", header=True)
    report = CsvJob(spark, Config(f"{store.root}/in.csv", "supplier"), store).run()
    rows = {r.operation: r.rows for r in report.operations}
    if (rows["load"], rows["insert"], rows["upsert"], rows["update"]) != (df.count(),) * 3 + (1,):
        raise AssertionError(report)
    return answers(spark, [(r.operation, r.status, rows["load"]) for r in report.operations], "operation string, status string, n long")


@query(fixed("operation, status", [("load", "failed")]))
def pipeline_without_a_file(spark, sf_dir):
    from .pipeline import Config, CsvJob

    store = Store.sandbox(spark)
    report = CsvJob(spark, Config(f"{store.root}/none.csv", "t"), store).run()
    return answers(spark, [(r.operation, r.status) for r in report.operations], "operation string, status string")


STEPS = ("insert", "upsert", "upsert again", "update count", "full cycle")


@query(fixed("dialect, step, passed", [(d, s, True) for d in ("sqlite", "mysql", "oracle") for s in STEPS]))
def harness_cycle(spark, sf_dir):
    from .harness import Harness

    df = read(spark, sf_dir, "nation").where("n_nationkey < 10")
    checks = [(d, c.step, c.passed) for d in ("sqlite", "mysql", "oracle") for c in Harness(df, ["n_nationkey"], ["n_name"], "nation").run(Store.sandbox(spark), d)]
    return answers(spark, checks, "dialect string, step string, passed boolean")


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey IN (1, 3, 4, 5) THEN n_regionkey + 1 WHEN n_nationkey = 7 THEN n_regionkey + 1 ELSE n_regionkey END AS n_regionkey FROM nation WHERE n_nationkey < 8")
def harness_table(spark, sf_dir):
    """Rows 0 to 5 are inserted, 3 to 5 changed and 6 and 7 added by upserts, 1 and 7 changed by updates."""
    from .harness import Harness

    store = Store.sandbox(spark)
    Harness(read(spark, sf_dir, "nation").where("n_nationkey < 10"), ["n_nationkey"], ["n_name"], "nation").run(store)
    return store.read("nation")


@query(fixed("passed, sql", [(5, "n_name LIKE :n_name_1 ESCAPE '\\'")]))
def full_cycle(spark, sf_dir):
    from .pipeline import CrudCycle

    checks, where = CrudCycle(Store.sandbox(spark)).run(read(spark, sf_dir, "nation").where("n_nationkey < 10"), ["n_nationkey"], ["n_name"], "nation", "postgres", ["n_name LIKE 'A'"])
    return answers(spark, [(sum(c.passed for c in checks), where.sql)], "passed long, sql string")


@query(fixed("line, text", [(0, "label: 'value'"), (1, 'json: {"a": 1}'), (2, "frame: struct<id:bigint>"), (3, "doubled(2) -> 4")]))
def logged_lines(spark, sf_dir):
    folder, before = tempfile.mkdtemp(prefix="tablewright-log-"), os.environ.get(log.SWITCH)  # the driver's own log
    os.environ[log.SWITCH] = "1"
    handler = log.attach(folder)
    try:
        def doubled(x):
            return 2 * x

        log.log_string("label", "value")
        log.log_json("json", {"a": 1})
        log.log_frame("frame", spark.range(3))
        log.log_call(doubled)(2)
    finally:
        log.LOG.removeHandler(handler)
        if before is None:
            del os.environ[log.SWITCH]
        else:
            os.environ[log.SWITCH] = before
    lines = [x for f in sorted(os.listdir(folder)) for x in open(os.path.join(folder, f)).read().splitlines()]
    return answers(spark, [(i, x.rpartition(" in ")[0] if " -> " in x else x) for i, x in enumerate(lines)], "line long, text string")


@query(fixed("name, text", [("insert_orders.txt", "INSERT INTO orders (a) VALUES (1)")]))
def traced_sql(spark, sf_dir):
    path = files.trace_sql(spark, Store.sandbox(spark).root, "insert", "orders", "INSERT INTO orders (a) VALUES (1)")
    return answers(spark, [(path.rpartition("/")[2], spark.read.text(path).first()[0])], "name string, text string")


@query("SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_id + 0.5::DOUBLE END AS number, event_id AS exact FROM events")
def parsed_numbers(spark, sf_dir):
    df = events_text(spark, sf_dir, t="case when event_id % 3 > 0 then concat(' ', event_id, '.5 ') else '1f' end", e="cast(event_id as string)")
    return df.select("event_id", parse.to_double(F.col("t")).alias("number"), parse.to_exact(F.col("e")).cast("long").alias("exact"))


@query("SELECT \"column\", distinct_count > 0 AS found FROM (SELECT 'o_orderkey' AS \"column\", 1 AS distinct_count UNION ALL SELECT 'o_custkey', 1 UNION ALL SELECT 'o_orderstatus', 1)")
def profile_by_sketch(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return profile.profile(df, approximate=True).select("column", (F.col("distinct_count") > 0).alias("found"))


@query("SELECT o_orderkey, replace(replace(o_orderstatus || '|' || o_orderkey, '|', '\\|'), '\\\\', '\\') || '|' || CASE WHEN o_custkey % 5 = 0 THEN 'null' ELSE o_custkey::VARCHAR END AS pk FROM orders")
def composite_key_text(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("|", "o_orderstatus", "o_orderkey").alias("a"), F.when(F.col("o_custkey") % 5 > 0, F.col("o_custkey")).alias("b"))
    return df.select("o_orderkey", profile.key_text(["a", "b"]).alias("pk"))
