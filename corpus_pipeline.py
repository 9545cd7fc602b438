"""A corpus pipeline over documents: toxicity, SimHash near-dedup, suffix-array dedup, PII, best-fit packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and reread as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import packing, pii, simhash, suffix_dedup, toxicity
from tributary.llm.common import stored, table

#: Bytes of a passage that goes where it repeats: of 51 words in a row, 98 in a hundred have as many or more.
PASSAGE = suffix_dedup.SHORT


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the factorization machine rejects (op3).

    A null or empty text scores by the bias alone; rows that repeat or have no doc_id are scored each. All stages read the
    columns of documents only, so further ones go; no rows give no rows.
    """
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text", "lang", "source", "n_chars"), machine).where("predicted = 0").drop("score", "predicted")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group (as op10's, of texts) one row stays: that with the smallest doc_id, null last."""
    table(spark, sf_dir, "documents")
    return simhash.one_of_each(docs)


def drop_repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes byte strings of PASSAGE and more that also start elsewhere (op4's method, whose own 400 leave most passages
    of 50 words); every document stays, null texts as null."""
    table(spark, sf_dir, "documents")
    return suffix_dedup.without_repeats(docs, PASSAGE)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind (op1); null texts stay null, and their n_chars is null."""
    table(spark, sf_dir, "documents")
    return pii.mask(docs, pii.train(docs)).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens (op8); a null text is the end id alone, rows that repeat or have
    no doc_id are packed each."""
    table(spark, sf_dir, "documents")
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("suffix_dedup", drop_repeated_bytes),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: Trained models and packing cannot be said in SQL; tests hold run() against brute-force stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
