"""A corpus pipeline of five of the training-data operators, from documents to packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import exact_dedup, langid, near_dedup, packing, secrets
from gleaner.llm.common import checkpointed, documents
from gleaner.llm.queries import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or unlike those that their language was learned from, go; lang becomes the prediction."""
    model = langid.fit(docs)
    found = langid.predict(docs.select(*COLUMNS), model).filter((F.col("__lang") != langid.UNKNOWN) & F.col("__claimed"))
    return found.withColumn("lang", F.col("__lang")).select(*COLUMNS)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest id stays."""
    return exact_dedup.drop_exact_duplicates(docs).select(*COLUMNS)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a similarity of 0.8 on five-word shingles, the one with the smallest id stays."""
    return near_dedup.drop_near_duplicates(docs).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in a text become a mask; all documents stay."""
    found = secrets.scan(docs.select(*COLUMNS))
    changed = F.size("secrets") > 0
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.when(changed, F.length("redacted")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens. The executors have held
    the stages before, so their workers remember fewer stretches of text here."""
    return packing.best_fit_pack(docs, tokenizer("word_bpe_49k.json"), capacity=4096, end_id=1, remembered=150_000)


STAGES = [("language_id", identify_language), ("exact_dedup", drop_exact), ("near_dedup", drop_near), ("secret_scan", mask_secrets), ("best_fit_packing", pack)]
#: Near-duplicates, the classifiers and the tokenizer can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
