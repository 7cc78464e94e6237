"""Chunk and vector tables: scans, and sinks that ignore what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from lodestack import schemas
from lodestack.storage import hadoop_path, remove

CHUNK_COLUMNS = ("chunk_id", "page", "text", "section_id", "seq", "chunk_type", "page_start", "page_end", "breadcrumb")


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """Rows as readers want them: page_start from a legacy 0-based page, page_end from page_start, text, ''."""
    start = F.coalesce("page_start", F.col("page") + 1)
    return chunks.select(
        *[c for c in chunks.columns if c not in ("page_start", "page_end", "chunk_type", "breadcrumb")],
        start.alias("page_start"),
        F.coalesce("page_end", start).alias("page_end"),
        F.coalesce("chunk_type", F.lit("text")).alias("chunk_type"),
        F.coalesce("breadcrumb", F.lit("")).alias("breadcrumb"),
    )


def session_chunks(chunks: DataFrame, session_id) -> DataFrame:
    """All chunks of a session in reading order, unknown places last."""
    return chunks.where(F.col("session_id") == session_id).orderBy(F.col("seq").asc_nulls_last())


def chunk_ids(chunks: DataFrame, session_id) -> DataFrame:
    return chunks.where(F.col("session_id") == session_id).select("chunk_id")


def section_chunks(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Chunks of the (session_id, section_id) pairs of ``sections``."""
    return chunks.join(sections, ["session_id", "section_id"], "left_semi")


def insert_ignore(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``old`` and the rows of ``new`` whose key is not there yet, one per key."""
    fresh = new.dropDuplicates([key]).join(old.select(key), key, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def chunk_sink(chunks: DataFrame) -> DataFrame:
    """Chunks as they are stored: 0-based page, no empty breadcrumb."""
    return chunks.withColumn("page", F.col("page_start") - 1).withColumn("breadcrumb", F.nullif(F.col("breadcrumb"), F.lit("")))


def append_vectors(spark: SparkSession, path: str, vectors: DataFrame, ids: str = "chunk_id") -> None:
    """Appends id, content, embedding and metadata columns to a Parquet table; ids that are there stay as they are."""
    store, p = hadoop_path(spark, path)
    fresh = vectors.dropDuplicates([ids])
    if store.exists(p):
        fresh = fresh.join(spark.read.schema(vectors.schema).parquet(path).select(ids), ids, "left_anti").select(*vectors.columns)
    fresh.write.mode("append").parquet(path)


#: Tables of the engine in the order in which they are made, with their schemas and partition columns.
TABLES = {
    "sessions": (schemas.SESSIONS, ()),
    "chat_messages": (schemas.MESSAGES, ()),
    "users": (schemas.USERS, ()),
    "auth_sessions": (schemas.AUTH_SESSIONS, ()),
    "auth_attempts": (schemas.AUTH_ATTEMPTS, ()),
    "session_chunks": (schemas.CHUNKS, ()),
    "ocr_usage": (schemas.OCR_USAGE, ()),
}


def create_tables(spark: SparkSession, database: str = "default") -> list[str]:
    """Makes the engine's tables where they don't exist, and adds columns that older ones lack; the tables' names."""
    names = []
    for name, (ddl, parts) in TABLES.items():
        where = f" PARTITIONED BY ({', '.join(parts)})" if parts else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({ddl}) USING parquet{where}")
        there = set(spark.table(f"{database}.{name}").columns)
        lacking = [f"`{f.name}` {f.dataType.simpleString()}" for f in _parse_datatype_string(ddl).fields if f.name not in there]
        if lacking:
            spark.sql(f"ALTER TABLE {database}.{name} ADD COLUMNS ({', '.join(lacking)})")
        names.append(f"{database}.{name}")
    return names


def publish(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Writes all ``tables`` (a path each) beside their places and moves them there only when all are written.

    If a write fails, nothing is published and what was written is removed. Each path must be new, such as a
    session's own folder of a table.
    """
    staged = {path: f"{path}.staged-{uuid.uuid4().hex}" for path in tables}
    done = []
    try:
        for path, rows in tables.items():
            store, p = hadoop_path(spark, path)
            if store.exists(p):
                raise FileExistsError(path)
            rows.write.parquet(staged[path])
        for path, beside in staged.items():
            store, p = hadoop_path(spark, path)
            if not store.rename(hadoop_path(spark, beside)[1], p):
                raise OSError(f"{path} could not be published")
            done.append(path)
    except Exception:
        for path in done:
            remove(spark, path)
        raise
    finally:
        for beside in staged.values():
            remove(spark, beside)


def to_json(rows: DataFrame) -> DataFrame:
    """A JSON object per row."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
