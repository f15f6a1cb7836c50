"""The corpus pipeline: language ID, near-dedup, secret scans, mixing, packing.

run(spark, sf_dir) applies STAGES to documents, each on what the one before kept, written as Parquet in between. All
stages but the last return the columns of documents. ORACLE_SQL is None: a trained classifier and a randomised join
cannot be said in SQL; tests compare the pipeline with a brute-force version.

Defined results, in every stage: null, empty and very long texts as the stage's operator says (those without letters go in
language_id); ids may be null or repeat, rows keep theirs; rows of equal texts are copies, of which near_dedup keeps the one of
the least id (null last); an empty table gives an empty result; columns other than those of documents are left out, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import langid, mixing, neardup, packing, secrets
from ledgerline.llm.common import read_table, settled
from ledgerline.llm.queries import MAX_EPOCHS, MIX_SEED, SHARE, WEIGHTS, levels

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text with less than this share of trigrams known to any one language is in none of them. Prose has 0.5 and more.
LEAST_SCORE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay; a missing label becomes the predicted one."""
    docs = docs.select(*COLUMNS)
    model = langid.train(docs)
    told = langid.identify(docs, model, keep=("doc_id", "lang", "source", "n_chars"), text_out="text")
    kept = told.filter((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the least id. Shingles of five words, similarity 0.8."""
    return neardup.deduplicated(docs.select(*COLUMNS), width=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts give way to [SECRET], and n_chars follows the text."""
    return secrets.redact_secrets(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture, a row for each epoch that takes one; the last of a leaf is cut at a token."""
    taken = mixing.mix_sources(docs, levels(), WEIGHTS, SHARE, max_epochs=MAX_EPOCHS, seed=MIX_SEED, carry=COLUMNS[1:])
    text = F.when(F.col("take_tokens") < F.col("n_tokens"), mixing.token_prefix(F.col("carry_text"), F.col("take_tokens"))).otherwise(F.col("carry_text"))
    return taken.select("doc_id", text.alias("text"), F.col("carry_lang").alias("lang"), F.col("carry_source").alias("source")).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document, or part of one, lies in the training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
