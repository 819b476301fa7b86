"""From raw documents to encoded ones: quality rules, line dedup, near-dedup, decontamination, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelens.llm import bpe, decontamination, line_dedup, quality, simhash
from placelens.sources.shared import cut

#: Keys of contaminated documents, of about 150 bytes, are broadcast up to so many; beyond it the documents are shuffled to them.
BROADCAST_ROWS = 200_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule go, row by row; null and empty texts break one.  No shuffle, texts of any length stay one row."""
    return quality.kept_rows(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of lines go from the texts; n_chars is counted anew.  Every row stays, with null ids and null texts too."""
    out = line_dedup.dedup_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def _keyed(docs: DataFrame) -> DataFrame:
    """(row: all columns, text, key): key orders rows by id, null last, then by a digest of the text; only rows of equal id and text share one."""
    key = F.struct(F.col("doc_id").isNull().alias("null_id"), F.col("doc_id").alias("doc_id"), F.sha2("text", 256).alias("digest"))
    return docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text"), key.alias("key"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts of a similarity of 0.8 or more the row of the smallest id stays, then that of the smallest digest of the text.

    Rows are told apart by id and text; null and repeated ids do no harm.
    Of rows equal in both, the least by a hash of all columns stays.  Texts
    without a word, null included, are one group.
    """
    rows = _keyed(docs)
    _, groups = simhash.similar_texts(rows, id_col="key")
    kept = groups.select(F.col("component_id").alias("kept")).distinct()
    rows = rows.join(kept, rows["key"] == kept["kept"], "left_semi")  # dealt as the groups are
    return rows.groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words in benchmark passages go, row by row whatever their ids; a text without words stays."""
    rows = _keyed(docs)
    found = decontamination.contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")
    dirty = found.where(decontamination.contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("key").alias("dirty"))
    dirty = cut(dirty, "contaminated")
    small = F.broadcast(dirty) if dirty.count() <= BROADCAST_ROWS else dirty
    return rows.join(small, rows["key"] == small["dirty"], "left_anti").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encoded, decoded again, and digests of both; a null text counts as empty."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("same")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("encoding", encode),
]

#: Fingerprints, chunk boundaries and merges are not SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
