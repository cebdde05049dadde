"""A corpus pipeline: quality, near duplicates, secrets, mixture, token ids.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept and returns a DataFrame; all but the last
return the columns of ``documents``.  A stage's output is written as Parquet and read again as the next one's input.

Defined results of every stage: a null text counts as empty, and stays null where a stage keeps it; empty texts are
documents like others (the classifier may reject them); texts are taken whole, whatever their length; ties and repeated
rows are treated alike, and only near copies go; a null source is a source; an empty table gives no rows; columns besides
doc_id, text and source are kept as they are, whatever their names (n_chars follows a redacted text), but for the last
stage, which returns doc_id, source, lang, n_tokens and ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, near_dedup, quality, secrets
from tidemark.llm.common import cut, table, unused
from tidemark.sources.shipping import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    ship(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    (score,) = unused(docs, "_score")
    return quality.score(docs, model, score).filter(F.col(score) >= quality.THRESHOLD).drop(score)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    ship(spark)
    return near_dedup.deduplicate(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret gives way to its kind in brackets; the documents stay."""
    ship(spark)
    return secrets.redact_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources get shares as the square roots of their sizes; documents are repeated accordingly."""
    whole = docs.select("doc_id", "source", F.struct(*(F.col(f"`{name}`") for name in docs.columns)).alias("whole"))
    return mixing.mix(whole, tempered=0.5).select("whole.*")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document."""
    ship(spark)
    encoded = bpe.encode(docs.select("doc_id", "source", "lang", "text"), public_tokenizers.path(bpe.VOCABULARY))
    return encoded.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: The stages hold a trained classifier and a tokenizer, which SQL can't express; a test compares all that follows the
#: classifier with plain loops (groups, redaction, Poisson counts) and with the tokenizer's library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = cut(docs)
    return docs
