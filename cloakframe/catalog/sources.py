"""Scans, sinks, manifests and first checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.patterns import SUSPICIOUS
from ..session import scratch_path
from ..sources import audit_log, files, registry, tables
from .audit import LOG, log
from .base import r, rounded, table
from .registry import assessments, results
from .registry import files as uploaded


def scan_csv(spark, sf):
    """Round trip through a semicolon-separated file with null tokens."""
    df = table(spark, sf, "customer").select(
        "c_custkey", "c_name", F.when(F.col("c_custkey") % 5 == 0, "N/A").otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"),
        F.when(F.col("c_custkey") % 7 == 0, "NULL").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
    )
    path = scratch_path(spark, "csv")
    tables.write_csv(df, path, ";")
    return tables.scan_csv(spark, path)


def csv_documents(spark, sf):
    """Round trip of whole texts with line feeds, quotes and delimiters."""
    df, path = table(spark, sf, "documents"), scratch_path(spark, "csv")
    tables.write_csv(df, path)
    return tables.scan_csv(spark, path, df.schema).withColumn("text", F.md5(F.col("text").cast("binary")))


def write_csv(spark, sf):
    df, path = table(spark, sf, "orders"), scratch_path(spark, "csv")
    tables.write_csv(df, path)
    return tables.scan_csv(spark, path, df.schema).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


def normalize_nulls(spark, sf):
    token = F.element_at(F.array(*[F.lit(t) for t in ("", "NULL", "null", "N/A", "n/a", "NA", " na ", "NaN-text")]), (F.col("c_custkey") % 8 + 1).cast("int"))
    df = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, token).otherwise(F.col("c_mktsegment")).alias("segment"))
    return tables.normalize_nulls(df)


def scan_json(spark, sf):
    df, path = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), scratch_path(spark, "json")
    tables.write_json(df, path)
    return tables.scan_json(spark, path)


def write_json(spark, sf):
    df, path = table(spark, sf, "customer"), scratch_path(spark, "json")
    tables.write_json(df, path)
    return tables.scan_json(spark, path, df.schema)


def dataset_store(spark, sf):
    root = scratch_path(spark, "store")
    tables.save_dataset(table(spark, sf, "customer"), root, "customers")
    tables.save_dataset(table(spark, sf, "part"), root, "parts")
    return tables.load_dataset(spark, root, "parts")


def append_audit_log(spark, sf):
    root = scratch_path(spark, "auditlog")
    audit_log.append_audit_log(log(spark, sf), root)
    events = audit_log.read_audit_log(spark, root)
    return events.select(
        "id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.date_format("date", "yyyy-MM-dd").alias("date"),
        "user_id", "action", "success", "epsilon", "mechanism",
    )


def registry_tables(spark, sf):
    """Write the six tables under their schemas and read them back."""
    root = scratch_path(spark, "registry")
    events = log(spark, sf).withColumn("id", F.col("id").cast("int"))
    filled = {
        "uploaded_files": uploaded(spark, sf),
        "anonymization_results": results(spark, sf),
        "privacy_assessments": assessments(spark, sf).withColumnRenamed("linkage_attack_score", "overall_score").withColumn("id", F.col("result_id")),
        "audit_logs": events.withColumn("event_type", F.col("action")).withColumn("epsilon_consumed", F.col("epsilon")),
        "system_settings": table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("key"), F.col("p_brand").alias("value")),
        "privacy_budgets": table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("session_id"), F.col("c_acctbal").alias("used_epsilon")),
    }
    out = None
    for name, df in filled.items():
        registry.write_table(df, root, name)
        back = registry.read_table(spark, root, name)
        one = back.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), F.sum("id").alias("ids"), F.lit(len(back.columns)).alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out


def file_manifest(spark, sf):
    return files.content_manifest(table(spark, sf, "pages"), "html", ["page_id"])


def document_manifest(spark, sf):
    return files.content_manifest(table(spark, sf, "documents"), "text", ["doc_id"])


def load_gate(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", F.lit(None).cast("string").alias("note"))
    return rounded(tables.load_gate(df, max_rows=5_000))


def table_metadata(spark, sf):
    return tables.table_metadata(table(spark, sf, "orders").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice"))))


def redacted_preview(spark, sf):
    return tables.redacted_preview(table(spark, sf, "customer"), ["c_custkey"], 25)


QUERIES = {
    f.__name__: f
    for f in (
        scan_csv, csv_documents, write_csv, normalize_nulls, scan_json, write_json, dataset_store, append_audit_log, registry_tables, file_manifest,
        document_manifest, load_gate, table_metadata, redacted_preview,
    )
}


def _manifest(source: str, key: str, text: str) -> str:
    hits = ", ".join(f"CASE WHEN contains(lower({text}), '{p}') THEN '{p}' END" for p in SUSPICIOUS)
    return (
        f"SELECT {key}, octet_length(encode({text}))::BIGINT AS size, sha256({text}) AS sha256, p AS patterns, p <> '' AS suspicious "
        f"FROM (SELECT *, concat_ws(',', {hits}) AS p FROM {source})"
    )


ORACLES = {
    "csv_documents": "SELECT doc_id, md5(text) AS text, lang, source, n_chars FROM documents",
    "scan_csv": "SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer",
    "write_csv": "SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate) FROM orders",
    "normalize_nulls": "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment WHEN c_custkey % 8 = 7 THEN 'NaN-text' END AS segment FROM customer",
    "scan_json": "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders",
    "write_json": "SELECT * FROM customer",
    "dataset_store": "SELECT * FROM part",
    "append_audit_log": f"WITH {LOG} SELECT id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, strftime(timestamp, '%Y-%m-%d') AS date, user_id, action, success, epsilon, mechanism FROM logs",
    "registry_tables": " UNION ALL ".join(
        f"SELECT '{name}' AS \"table\", count(*) AS rows, sum({key})::BIGINT AS ids, {width} AS columns FROM {source}"
        for name, source, key, width in (
            ("uploaded_files", "customer", "c_custkey", 9), ("anonymization_results", "orders", "o_orderkey", 18), ("privacy_assessments", "lineitem", "l_orderkey", 11),
            ("audit_logs", "events", "event_id", 14), ("system_settings", "part", "p_partkey", 7), ("privacy_budgets", "customer", "c_custkey", 10),
        )
    ),
    "file_manifest": _manifest("pages", "page_id", "html"),
    "document_manifest": _manifest("documents", "doc_id", "text"),
    "load_gate": "SELECT 'error' AS severity, 'too_many_rows' AS \"check\", count(*)::DOUBLE AS value FROM lineitem HAVING count(*) > 5000 UNION ALL SELECT 'warning', 'empty_columns', 1.0",
    "table_metadata": "SELECT c AS \"column\", i::INT AS position, t AS type, l AS role, (SELECT count(*) FROM orders) AS rows, CASE WHEN c = 'o_totalprice' THEN (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0) ELSE 0 END::BIGINT AS missing FROM (VALUES "
    "('o_orderkey', 0, 'int64', 'numeric'), ('o_custkey', 1, 'int64', 'numeric'), ('o_orderstatus', 2, 'object', 'categorical'), ('o_totalprice', 3, 'float64', 'numeric'), "
    "('o_orderdate', 4, 'datetime64', 'datetime'), ('o_orderpriority', 5, 'object', 'categorical')) v(c, i, t, l)",
    "redacted_preview": "SELECT * REPLACE ('[REDACTED]' AS c_name) FROM customer ORDER BY c_custkey LIMIT 25",
}
