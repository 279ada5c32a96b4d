"""A training-corpus pipeline over the documents table: five stages, each on what the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's ``docs``.

1. quality: rejected documents go (co-trained classifier, fitted on ``labels``);
2. near duplicates: of each group linked by 5-word shingles at a Jaccard similarity of 0.8
   the document of the smallest id stays;
3. decontamination: documents that hold an item of ``benchmark`` go;
4. secrets: spans found are put as ``<SECRET>``, and ``n_chars`` follows; all documents stay;
5. tokens: SentencePiece ids with seeded merge-dropout.

Nulls, empty texts and empty tables pass: a null or empty text is of no group and holds
neither items nor secrets; what the classifier thinks of it depends on the labels.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herbarius.llm.common import stored_alone, table
from herbarius.llm.decontaminate import drop_leaks
from herbarius.llm.ngram_jaccard import first_of_each
from herbarius.llm.quality import keep_good
from herbarius.llm.secret_scan import redact_secrets
from herbarius.llm.sentencepiece_dropout import encode


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return first_of_each(docs, words=5, num=4, den=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = redact_secrets(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), dropout=0.1, seed=1)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("tokens", tokens)]

#: No SQL gives the classifier, the latent space or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
