"""Registered queries of this subpackage: each operator with its production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, classifier, conversation_trie, decontamination, line_dedup, merkle, pii, quality, secrets, simhash, token_counts, token_output, url_filter
from .oracles import ORACLES

RULES = [url_filter.Rule(*x.split(" ")) for x in ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark", "item_id", "text"))
    items = F.sha2(F.array_join("item_ids", ","), 256)
    dirty = decontamination.contaminated(F.col("n_hit"), F.col("n_words"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), items.alias("items_sha256"), dirty.alias("contaminated"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(pii.listed(F.filter("spans", lambda s: s["kind"].isin(*secrets.KINDS[:3]))), 256)
    live = F.size(F.filter("spans", lambda s: s["verdict"] == "live")).cast("long")
    verdicts = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["verdict"], s["n_owners"].cast("string"), s["n_repositories"].cast("string"))), ",")
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), base.alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"), live.alias("n_live"), verdicts.alias("verdicts"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages", "page_id", "url"), RULES).drop("blocked_by")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.written_and_read(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(documents(spark, sf_dir))
    base = [kind.name for kind in pii.BASE]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    own = F.sha2(pii.listed(F.filter("spans", lambda s: s["kind"].isin(base))), 256)
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",")
    return found.select("doc_id", *map(count, base), own.alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"), scores.alias("scores"), F.size("spans").cast("long").alias("n_spans"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", *merkle.COLUMNS)
    chosen = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    broken = F.when(chosen, merkle.leaf(*[F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in merkle.COLUMNS]))
    found = merkle.manifest(docs, {"broken": broken}).withColumn("folded", merkle.folded(F.coalesce("broken", "leaf"), F.col("path")))
    text = lambda c: F.lower(F.hex(c))
    digests = [text(c).alias(c) for c in ("leaf", "subroot", "root")]
    return found.select("doc_id", *digests, F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return conversation_trie.prefix_trie(conversation_trie.rebuilt(turns))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_token_counts, op2_decontamination, op3_simhash, op4_bpe, op5_line_dedup, op6_secrets, op7_url_filter, op8_quality, op9_token_files, op10_pii, op11_quality_classifier, op12_merkle, op13_conversation_trie)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
