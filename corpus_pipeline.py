"""Training corpus from documents: quality, near duplicates, benchmark leaks, mix, token shards.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's docs.

Cases, for all stages: rows are judged one by one, so repeated and null doc_ids do no harm; null and empty texts are documents without
words (they are near duplicates of each other, and the mix never takes them); very long texts are read in whole; extra columns of any
name pass through all stages but the last; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import decontamination, mixing, quality_classifier, simhash, token_shards
from foliant.llm._common import new_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the co-trained classifier keeps; a score of the threshold itself stays. Without labels of both kinds all stay."""
    return quality_classifier.classify(docs, table(spark, sf_dir, "labels"), only_kept=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that of the least doc_id, null last, and of several of this id the first by a hash of the text."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that hold no benchmark item; other rows of a leaking row's doc_id stay. Without items all stay."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows as often as the mix takes them; of equal rows some may come once more than others."""
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token shards hold of each row: doc_id, start, n_tokens, ids_crc32, in order of doc_id, null first."""
    return token_shards.token_shards(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shards", shards)]

#: The classifier, the fingerprints and the tokens have no SQL form; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = new_path(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
