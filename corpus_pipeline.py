"""A corpus from raw documents to packed sequences: five stages, each written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecairn.llm import langid, linededup, mixing, packing, simhash
from wavecairn.session import shared_folder

#: A text without a learned label goes if fewer of its n-grams are known to the landmarks. On sf0.01, prefixes of 8 code
#: points have 0.82 or more, sentences in eight other languages 0.78 or less; the regression value follows length.
LEAST_KNOWN = 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a letter whose lang is a learned one, or whose n-grams are; a null lang becomes the predicted one.

    Null, empty and letterless texts go; long ones are read whole; repeated rows are judged alike. Without
    any labelled document nothing is learned, and nothing stays. An empty table stays empty.
    """
    model = langid.train(docs, F.lit(True))
    found = langid.identify(docs.withColumnsRenamed({"lang": "_lang"}).withColumn("_text", F.col("text")), model, ["doc_id", "_text", "_lang", "source", "n_chars"])
    labelled = F.coalesce(F.col("_lang").isin(model.languages if model else []), F.lit(False))
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (labelled | (F.col("known") >= LEAST_KNOWN)))
    return kept.select("doc_id", F.col("_text").alias("text"), F.coalesce("_lang", "lang_pred").alias("lang"), "source", "n_chars")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; n_chars follows.

    Null texts stay null, a text may become empty, repeated rows keep the same lines; no row goes.
    """
    out = linededup.dedup_lines(docs, classes=linededup.PRODUCTION)
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: five words, 12 bits, then a similarity of 0.8 on full sets.

    The smallest doc_id stays (null last). Texts without words are one group. Unlike texts under one doc_id
    stay apart, of equal rows one stays. An empty table stays empty.
    """
    return simhash.one_of_each(docs, words=5, radius=12, percent=80).select("doc_id", "text", "lang", "source", "n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, none more than twice.

    A null source is a source like any other; null and empty texts have no words, and the mix may leave them out.
    Repeated rows are documents of their own. An empty table stays empty.
    """
    return mixing.mixed_documents(docs).select("doc_id", "text", "lang", "source", "n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences.

    A null or empty text is its end id alone, a text longer than a sequence is cut into pieces, repeated rows are
    packed each. An empty table gives no pieces.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]
#: The stages are learned, hashed or random; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
