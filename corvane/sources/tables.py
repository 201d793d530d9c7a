"""The knowledge base as tables: typed pages, relations, claims and tasks derived from the driver's tables.

Each function returns a DataFrame; SQL has the same derivation for DuckDB, as the common table expressions
`wiki`, `edges`, `claims` and `tasks`. Times are unix milliseconds, 0 if unset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: "Now" of all queries (fixed value), so that results don't depend on the clock.
NOW = 1_711_929_600_000
DAY = 86_400_000
TYPES = ("source", "entity", "concept", "synthesis")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: id, title, type, source, body, grade, heat, created_at, last_used_at, is_immutable, category."""
    d = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), d).alias("id"),
        "doc_id",
        F.substring(F.split("text", "\n")[0], 1, 120).alias("title"),
        F.element_at(F.array(*map(F.lit, TYPES)), (d % 4 + 1).cast("int")).alias("type"),
        "source",
        F.col("text").alias("body"),
        F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (d % 3 + 1).cast("int")).alias("grade"),
        (d * 37 % 101).alias("heat"),
        (F.lit(NOW) - (d % 120) * DAY).alias("created_at"),
        F.when(d % 5 == 0, F.lit(0)).otherwise(F.lit(NOW) - (d % 90) * DAY).cast("long").alias("last_used_at"),
        (d % 11 == 0).alias("is_immutable"),
        F.col("lang").alias("category"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed relations between pages; some targets don't exist."""
    d = read(spark, sf_dir, "documents").select("doc_id")
    ident = lambda x: F.concat(F.lit("doc-"), x)
    first = d.select(ident(F.col("doc_id")).alias("source_id"), ident(F.col("doc_id") * 2 + 1).alias("target_id"), F.lit("references").alias("type"), F.lit(1.0).alias("weight"))
    second = d.where("doc_id % 2 = 0").select(ident(F.col("doc_id")), ident(F.col("doc_id") * 3 + 2), F.lit("is_part_of"), F.lit(0.5))
    third = d.where("doc_id % 5 = 0 and doc_id > 0").select(ident(F.col("doc_id")), ident(F.floor(F.col("doc_id") / 5).cast("long")), F.lit("contradicts"), F.lit(0.8))
    return first.union(second).union(third)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of conversations: id, entity, ordinal, statement."""
    return read(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("conv_id").alias("entity"), F.col("turn").alias("ordinal"), F.col("text").alias("statement"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes of tasks: one row for each event, with the user as the task."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("task_id"), "ts", "value", F.expr("case event_type when 'error' then 'failed' when 'signup' then 'pending' when 'click' then 'running' when 'view' then 'waiting_review' else 'approved' end").alias("status"), "event_type")


SQL = f"""
WITH wiki AS (
  SELECT 'doc-' || doc_id AS id, doc_id, substr(string_split(text, chr(10))[1], 1, 120) AS title,
    ['source', 'entity', 'concept', 'synthesis'][doc_id % 4 + 1] AS type, source, text AS body, ['A', 'B', 'C'][doc_id % 3 + 1] AS grade,
    doc_id * 37 % 101 AS heat, {NOW} - (doc_id % 120) * {DAY} AS created_at, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE {NOW} - (doc_id % 90) * {DAY} END AS last_used_at,
    doc_id % 11 = 0 AS is_immutable, lang AS category
  FROM documents
), edges AS (
  SELECT 'doc-' || doc_id AS source_id, 'doc-' || (doc_id * 2 + 1) AS target_id, 'references' AS type, 1.0::DOUBLE AS weight FROM documents
  UNION ALL SELECT 'doc-' || doc_id, 'doc-' || (doc_id * 3 + 2), 'is_part_of', 0.5 FROM documents WHERE doc_id % 2 = 0
  UNION ALL SELECT 'doc-' || doc_id, 'doc-' || (doc_id // 5), 'contradicts', 0.8 FROM documents WHERE doc_id % 5 = 0 AND doc_id > 0
), claims AS (
  SELECT conv_id || ':' || turn AS id, conv_id AS entity, turn AS ordinal, text AS statement FROM conversations
), tasks AS (
  SELECT event_id, user_id AS task_id, ts, value, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'view' THEN 'waiting_review' ELSE 'approved' END AS status, event_type FROM events
)
"""
