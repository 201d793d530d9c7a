"""The corpus pipeline: quality, repeated lines, near duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
stage's docs. All but the last return the columns of documents; n_chars follows the text. A document that a
stage empties goes; one that came empty stays until a stage judges it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe_replay, decontaminate, line_dedup, minhash_dedup, quality_crf
from corvane.llm.common import sent_if_few, staged

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and everything else in one column, so that no name clashes with a stage's own."""
    rest = (F.col(f"`{c}`") for c in docs.columns if c != "text")
    return docs.select("doc_id", "text", F.struct(*rest, F.length("text").alias("length before")).alias("row"))


def _as_documents(out: DataFrame, before: DataFrame) -> DataFrame:
    """The columns of documents again, with the text as it is now, and n_chars of it where something was cut out."""

    def value(c: str):
        if c == "n_chars":
            same = F.length("text").eqNullSafe(F.col("row").getField("length before"))
            return F.when(same, F.col("row").getField(c)).otherwise(F.length("text").cast(before.schema[c].dataType))
        return F.col("text") if c == "text" else F.col("row").getField(c)

    return out.select(*(value(c).alias(c) for c in before.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the field rejects go."""
    field = quality_crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _as_documents(quality_crf.score(_packed(docs), field).where(F.col("quality_score") >= quality_crf.THRESHOLD), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: later runs of repeated lines go, and documents that held nothing else."""
    out = line_dedup.dedup_lines(_packed(docs))
    emptied = (F.col("removed_lines") > 0) & ~F.col("text").rlike(r"\S")
    return _as_documents(out.where(~F.coalesce(emptied, F.lit(False))), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one document of each group stays; of rows that share its identifier, the one with the least digest.

    Documents without words, or without identifier, all stay.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    found = staged(minhash_dedup.near_duplicates(docs).where("n_shingles > 0 and doc_id is not null"), "groups")
    gone = sent_if_few(found.where("not kept").select("doc_id").distinct(), "gone")
    out = docs.join(gone, "doc_id", "left_anti").select(*names)
    repeated = staged(found.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return out
    # rows that have words are grouped by their identifier; hashes are compared, texts are not gathered
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    whole = out.select("doc_id", F.struct(*names).alias("row"), worded.alias("worded")).withColumn("digest", F.xxhash64("row"))
    mine = whole.join(repeated, "doc_id", "left_semi").where("worded")
    first = mine.groupBy("doc_id").agg(F.min_by("row", "digest").alias("row"))
    rest = whole.join(repeated.withColumn("again", F.lit(True)), "doc_id", "left").where("not (worded and coalesce(again, false))")
    return rest.select("row.*").union(first.select("row.*"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: passages of the benchmark are cut out, and documents that held nothing else go."""
    marked = _packed(docs).withColumn("had", F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)))
    out = decontaminate.remove(marked, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    emptied = F.col("had") & ~F.col("text").rlike(r"\S")
    return _as_documents(out.where(~F.coalesce(emptied, F.lit(False))), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the ids, as little-endian unsigned 32-bit numbers, and the text that they decode to."""
    return bpe_replay.encode_and_decode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("MinHash near-dedup", near_duplicates), ("benchmark decontamination", benchmark), ("byte-level BPE", tokens)]

#: The first stage is a fitted model, which SQL can't express; tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
