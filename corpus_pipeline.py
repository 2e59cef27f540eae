"""A corpus pipeline of operators in gridwake.llm.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents; the last one returns
the encoded texts. The driver, or run(), writes each result as Parquet and reads it again for the next stage. Stages keep
their Arrow batches small, since a session that runs them all has a full heap beside the batches; this setting of the
session stays lowered.

Rows are judged one by one: a null text is an empty one (too short for the quality rules); a null or repeated id makes no
difference to a row's own verdicts, but rows without an id are never the copies that go; texts of any length are read
whole; of equal rows all go or stay, but for copies under other ids, of which the smallest id stays; further columns pass
through up to the last stage, whatever their names; an empty table gives empty results. The first stage needs the columns doc_id, text and source,
the last one doc_id, text, lang and source; benchmark.parquet stands beside the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwake.llm import bpe_codec, decontamination, near_dedup, quality_rules, secret_scan, textbuf
from gridwake.plans.materialize import materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the verdicts of their hosts reject go."""
    textbuf.small_batches(spark)
    return quality_rules.keep_good(docs)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    textbuf.small_batches(spark)
    return near_dedup.keep_one(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    textbuf.small_batches(spark)
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay, and n_chars follows the text."""
    textbuf.small_batches(spark)
    return secret_scan.without_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids): the token ids of each document."""
    textbuf.small_batches(spark)
    coded = bpe_codec.encode_column(docs, bpe_codec.default_path(), "text", "ids")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", keep_quality),
    ("near duplicates", keep_distinct),
    ("benchmark decontamination", keep_uncontaminated),
    ("secret scan", redact_secrets),
    ("BPE encoding", encode),
]
#: Token ids and novelty are no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
