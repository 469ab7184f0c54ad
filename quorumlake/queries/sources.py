"""Scans and sinks: each writes a table to the shared folder and reads it back by the strict readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.operators import voting
from quorumlake.queries.registry import VOTES, Tables, query
from quorumlake.sources import tables as S


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, '' AS note FROM nation")
def s1_s8_csv_round_trip(t: Tables) -> DataFrame:
    path = S.write_csv(t.nation.select(F.col("n_nationkey").cast("string").alias(" id"), F.col("n_name").alias("name ")), S.fresh_path(t.spark, "csv"), [" id"])
    return S.read_csv(t.spark, path, ["id", "name", "note"], optional=("note",))


@query("SELECT conv_id, turn, role, length(text) AS chars FROM conversations")
def s2_s8_jsonl_round_trip(t: Tables) -> DataFrame:
    path = S.write_jsonl(t.conversations, S.fresh_path(t.spark, "jsonl"))
    return S.read_jsonl(t.spark, path, "conv_id LONG, turn LONG, role STRING, text STRING").select("conv_id", "turn", "role", F.char_length("text").cast("long").alias("chars"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def s3_p1_id_list(t: Tables) -> DataFrame:
    """The labelled documents, by a file of their ids."""
    path = S.fresh_path(t.spark, "ids")
    t.labels.select(F.col("doc_id").cast("string")).distinct().write.text(path)
    return t.documents.select(F.col("doc_id").cast("string").alias("id")).join(S.read_ids(t.spark, path), "id", "left_semi")


@query("SELECT CAST(item_id AS VARCHAR) AS id, 'jsonl' AS kind FROM benchmark UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'csv' FROM nation UNION ALL SELECT CAST(r_regionkey AS VARCHAR), 'ids' FROM region")
def s4_polymorphic_scan(t: Tables) -> DataFrame:
    a, b, c = (S.fresh_path(t.spark, k) for k in ("jsonl", "csv", "ids"))
    S.write_jsonl(t.benchmark.select(F.col("item_id").cast("string").alias("question_id")), a)
    S.write_csv(t.nation.select(F.col("n_nationkey").cast("string").alias("ID")), b, ["ID"])
    t.region.select(F.col("r_regionkey").cast("string")).write.text(c)
    parts = ((a, "jsonl", "question_id STRING", ("id", "question_id")), (b, "csv", "ID STRING", ("id",)), (c, "ids", "", ()))
    rows = [S.read_records(t.spark, path, kind, schema, names).select("id", F.lit(kind).alias("kind")) for path, kind, schema, names in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("SELECT user_id, count(*) AS n, count(DISTINCT event_id) AS distinct_n FROM events GROUP BY 1")
def s9_resumable_append(t: Tables) -> DataFrame:
    """Two overlapping parts are appended, the first one twice; keys stay unique."""
    path = S.fresh_path(t.spark, "append")
    early, late = t.events.where("event_id % 3 < 2"), t.events.where("event_id % 3 > 0")
    for part in (early, early, late):
        S.append_new(part, path, ["event_id"], "run-1")
    return t.spark.read.parquet(path).groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("distinct_n"))


@query(f"{VOTES} SELECT CAST(id AS VARCHAR) AS id, coalesce(answer, '0') AS answer FROM gold LEFT JOIN maj USING (id)")
def s10_submission_csv(t: Tables) -> DataFrame:
    order = t.gold.select("id", F.col("id").alias("source_order"))
    path = S.write_submission(voting.majority(t.pool).select("id", "answer"), order, S.fresh_path(t.spark, "submission"))
    return t.spark.read.option("header", True).csv(path).select("id", "answer")


@query("WITH v(name, value) AS (VALUES ('majority@4', 64.68), ('majority@8', 67.22), ('majority@32', 69.31)) SELECT name, round(value, 2)::DOUBLE AS value FROM v UNION ALL SELECT 'regions', count(*)::DOUBLE FROM region")
def s12_values_and_views(t: Tables) -> DataFrame:
    t.region.createOrReplaceTempView("_region")
    return t.spark.sql("WITH v AS (SELECT * FROM VALUES ('majority@4', 64.68), ('majority@8', 67.22), ('majority@32', 69.31) AS v(name, value)) SELECT name, cast(value AS DOUBLE) AS value FROM v UNION ALL SELECT 'regions', cast(count(*) AS DOUBLE) FROM _region")


@query("SELECT * FROM (VALUES ('votes', 12, 0, 1, true), ('text', 7, 2, 0, false)) v(suite, tests, failed, skipped, passed)")
def s13_junit_xml(t: Tables) -> DataFrame:
    path = S.fresh_path(t.spark, "junit")
    lines = ["<testsuites>", '<testsuite name="votes" tests="12" failures="0" errors="0" skipped="1"></testsuite>', '<testsuite name="text" tests="7" failures="1" errors="1" skipped="0"></testsuite>', "</testsuites>"]
    t.spark.sql("SELECT '" + "\n".join(lines) + "' AS value").write.text(path)
    return S.read_junit(t.spark, path)
