"""From raw documents to a training mix, in five stages. Each is written as Parquet and read again by the next.

Toxic documents go, one document of each group of near-duplicates stays, documents with benchmark items go, secrets are
replaced by a mark, and the last stage takes words from the sources by weight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import decontaminate, mixing, secrets, simhash, toxicity
from waymark.llm.common import crc_of_id, table, unused
from waymark.materialize import Written

#: Shingles of three words, fingerprints at most two bits apart, as in the operator's query.
NEAR_DUPLICATES = simhash.SimHashRules(width=3, radius=2)
TOXIC = toxicity.ToxicRules()


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold. Labels of ids whose crc32 leaves 2 modulo 4 are held out, as in the operator's query."""
    labels = table(spark, sf_dir, "labels").filter(F.pmod(crc_of_id(F.col("doc_id")), F.lit(4)) != 2)
    model = toxicity.fit(docs, labels.select("doc_id", F.col("toxic").alias("label")), TOXIC)
    score = unused(docs, "score")
    return toxicity.scored(docs, model, score).filter(F.col(score) < TOXIC.threshold).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group."""
    return simhash.one_of_each(docs, NEAR_DUPLICATES)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without items of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark for each secret."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with the number of words."""
    return mixing.mixture(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: Learnt scores and fingerprints are no SQL; `tests/llm` holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = Written(stage(spark, docs, sf_dir)).df
    return STAGES[-1][1](spark, docs, sf_dir)
