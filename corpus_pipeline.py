"""A corpus pipeline over ``documents``: language ID, SimHash near-dedup,
benchmark decontamination, PII redaction, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's docs. All but the last return the columns of
docs; other columns of any name are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import byte_bpe, decontaminate, langid_crf, pii_deobfuscate, simhash_dedup
from ledgerline.llm.rowwise import carried
from ledgerline.session import ensure_checkpoint_dir

#: A document goes if no language has this share of it (or it has no letter).
MIN_LANGUAGE_SHARE = 0.3
#: Benchmark passages of more words than this are cut out; a document of which
#: more than this share is benchmark text goes.
MAX_SPAN_WORDS = 9
MAX_COVERAGE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told; without any labelled row
    nothing can be told, and none goes."""
    fold = langid_crf.remainder(F.col("doc_id"), 5)
    model = langid_crf.fit(docs, fold != 0)
    if model is None:
        return docs
    found = langid_crf.predict(docs, model, carry="row")
    kept = found.where((F.col("lang_pred") != langid_crf.UND) & (F.col("score") >= MIN_LANGUAGE_SHARE))
    return kept.select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return simhash_dedup.kept_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out; drop documents that are mostly such."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.annotate(docs, items, carry="row", max_span=MAX_SPAN_WORDS, max_coverage=MAX_COVERAGE)
    return carried(found.where(~F.col("over")), docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the kind in place of personal data."""
    return carried(pii_deobfuscate.scan(docs, redact=True, carry="row"), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): token ids of each
    text, and digests of them and of what they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN, with_ids=True).select(
        "doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("pii", pii), ("tokens", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is kept in the shared
    checkpoint folder, so the next one doesn't run it again."""
    ensure_checkpoint_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).checkpoint()
    return STAGES[-1][1](spark, docs, sf_dir)
