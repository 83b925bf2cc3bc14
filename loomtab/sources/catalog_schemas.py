"""Schemas of the catalog's tables, and their creation in Spark's catalog."""

from __future__ import annotations

from pyspark.sql import SparkSession

TABLES = {
    "users": "id BIGINT, username STRING, phone STRING, email STRING, password_hash STRING, platform_role STRING, status STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "session_user": "id BIGINT, session_id STRING, user_id BIGINT, project_id BIGINT, title STRING, workspace_abs_path STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "session_content": "id BIGINT, session_id STRING, version INT, content STRING, created_at TIMESTAMP",
    "projects": "id BIGINT, user_id BIGINT, name STRING, status STRING, workspace_abs_path STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "project_assets": "id BIGINT, project_id BIGINT, session_id STRING, asset_type STRING, relative_path STRING, original_filename STRING, file_category STRING, created_at TIMESTAMP",
    "project_members": "id BIGINT, project_id BIGINT, user_id BIGINT, role STRING, permissions STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "project_tasks": "id BIGINT, project_id BIGINT, session_id STRING, task_type STRING, status STRING, payload STRING, created_by BIGINT, created_at TIMESTAMP",
}


def bootstrap(spark: SparkSession, database: str = "default") -> list[str]:
    """Creates missing tables and adds missing columns; returns what it did."""
    done = []
    for name, ddl in TABLES.items():
        full = f"{database}.{name}"
        if not spark.catalog.tableExists(full):
            spark.sql(f"CREATE TABLE {full} ({ddl}) USING parquet")
            done.append(f"created {name}")
            continue
        have = {c.name for c in spark.catalog.listColumns(full)}
        missing = [c for c in ddl.split(", ") if c.split()[0] not in have]
        if missing:
            spark.sql(f"ALTER TABLE {full} ADD COLUMNS ({', '.join(missing)})")
            done.append(f"added {len(missing)} to {name}")
    return done
