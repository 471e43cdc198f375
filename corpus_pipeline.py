"""A corpus pipeline of five stages: language, exact copies, near copies, source mix, tokens.

Every stage works on all rows its predecessor kept and its decision takes effect; all
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braggline.llm import bpe, exact_dedup, langid, mixing, simhash
from braggline.llm.common import fresh, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: a null text or one without a letter goes.

    The classifiers learn from the documents themselves, without the held-out fold.  An
    ambiguous text is still a text in a language and stays.
    """
    model = langid.train(docs, ~langid.held_out())
    name = fresh(docs, "__language")
    told = langid.predict(spark, docs, model, name=name)
    return told.where(F.col(f"{name}.lang_pred") != langid.UNKNOWN).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space one document stays."""
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 0.8 of their 5-word shingles, directly or through others, the one of smallest id stays."""
    return simhash.keep_first(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, 0 to 3 times."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their count per document copy of the mix, with the digest of the decoded text."""
    done = bpe.encode(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), with_text=True)
    return done.select("doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language ID", known_language), ("exact dedup", exact_copies), ("SimHash near-dedup", near_copies),
          ("source mix", source_mix), ("BPE encoding", tokens)]

#: Language prediction and byte-pair encoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name.lower().replace(" ", "-"))
    return docs
