"""Schemas of the six registry tables, kept as parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .audit_log import conform

# The fields of each table.
TABLES = {
    "uploaded_files": "id INT, filename STRING, original_filename STRING, file_size INT, file_type STRING, "
    "upload_timestamp TIMESTAMP_NTZ, status STRING, file_path STRING, "
    "file_metadata STRUCT<rows: INT, columns: ARRAY<STRING>, column_count: INT>",
    "anonymization_results": "id INT, result_id STRING, original_file_id INT, method STRING, parameters MAP<STRING, STRING>, "
    "privacy_score DOUBLE, utility_score DOUBLE, epsilon_used DOUBLE, delta_used DOUBLE, reidentification_risk DOUBLE, "
    "statistical_similarity DOUBLE, correlation_preservation DOUBLE, data_completeness DOUBLE, execution_time DOUBLE, "
    "created_timestamp TIMESTAMP_NTZ, status STRING, anonymized_data_path STRING, report_data STRING",
    "privacy_assessments": "id INT, result_id INT, assessment_type STRING, overall_score DOUBLE, risk_level STRING, "
    "linkage_attack_score DOUBLE, membership_inference_score DOUBLE, attribute_inference_score DOUBLE, "
    "assessment_data STRING, recommendations ARRAY<STRING>, created_timestamp TIMESTAMP_NTZ",
    "audit_logs": "id INT, timestamp TIMESTAMP_NTZ, event_type STRING, user_id STRING, session_id STRING, action STRING, "
    "resource_type STRING, resource_id STRING, epsilon_consumed DOUBLE, delta_consumed DOUBLE, ip_address STRING, "
    "user_agent STRING, details STRING, success BOOLEAN",
    "system_settings": "id INT, key STRING, value STRING, value_type STRING, description STRING, "
    "created_timestamp TIMESTAMP_NTZ, updated_timestamp TIMESTAMP_NTZ",
    "privacy_budgets": "id INT, session_id STRING, user_id STRING, total_epsilon DOUBLE, total_delta DOUBLE, "
    "used_epsilon DOUBLE, used_delta DOUBLE, created_timestamp TIMESTAMP_NTZ, last_used_timestamp TIMESTAMP_NTZ, is_active BOOLEAN",
}


def table_schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def write_table(df: DataFrame, root: str, name: str, mode: str = "append") -> None:
    conform(df, table_schema(name)).write.mode(mode).parquet(f"{root}/{name}")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(table_schema(name)).parquet(f"{root}/{name}")
