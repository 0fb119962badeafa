"""Corpus pipeline: five stages from raw documents to a weighted sample.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns the documents that its successor works on, with the columns of
``documents`` (the last stage adds its own). ``run`` applies them to the whole
``documents`` table, writing every stage's result as Parquet to the shared
folder and reading it back.

Every stage defines its result for null or repeated ids, null and empty texts,
repeated rows and empty tables in the operator it calls; extra columns of the
input pass through, also under names that an operator uses itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hanga.llm import decontam, mixing, pii, simhash, toxicity
from hanga.llm.common import in_fold, read_table, shared_table, shielded
from hanga.llm.queries import MIX_SHARE, MIX_TARGETS, pii_key


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts toxic go. The model learns
    from the same labelled fold as ``op3_toxicity_mil``."""
    labels = read_table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, ~in_fold("doc_id", 5, 0))
    return toxicity.drop_toxic(docs, model)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-copies stays."""
    return simhash.near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data; ``n_chars`` follows the text."""
    def run(d):
        new = pii.replace_pii(d, pii_key(spark))
        changed = F.when(F.size("pii_spans") > 0, F.length("text")).otherwise(F.col("n_chars"))
        return new.withColumn("n_chars", changed.cast("long")).drop("pii_spans")

    return shielded(docs, ["doc_id", "text", "n_chars"], run)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample raked to the target shares, with its weights."""
    return mixing.sample_mix(docs, MIX_TARGETS, MIX_SHARE)


STAGES = [
    ("toxicity", toxicity_filter),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontamination", decontamination),
    ("pii_surrogates", pii_surrogates),
    ("mixing", mix_sources),
]

# Trained scores, fingerprints and keyed surrogates have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return docs
