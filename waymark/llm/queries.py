"""The registered queries of this folder: each applies an operator to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import chat, decontaminate, licences, mixing, negatives, neighbours, prefixes, quality, secrets, simhash, substrings, tokens, toxicity
from waymark.llm.common import crc_of_id, table

QUERIES = {}
ORACLE = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


ORACLE |= {
    "op2_licences": licences.scan_sql(),
    "op3_mixing": mixing.mix_sql(),
    "op9_secrets": secrets.scan_sql(),
    "op10_decontamination": decontaminate.contained_sql(),
}


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _not_held_out(labels: DataFrame, column: str, parts: int, remainder: int) -> DataFrame:
    return labels.filter(F.pmod(crc_of_id(F.col("doc_id")), F.lit(parts)) != remainder).select("doc_id", F.col(column).alias("label"))


def _decided(scores: DataFrame, parts: int, remainder: int, threshold: float) -> DataFrame:
    return scores.select(
        "doc_id", F.coalesce(F.pmod(crc_of_id(F.col("doc_id")), F.lit(parts)) == remainder, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rules = table(spark, sf_dir, "documents").select("doc_id", "text"), toxicity.ToxicRules()
    model = toxicity.fit(docs, _not_held_out(table(spark, sf_dir, "labels"), "toxic", 4, 2), rules)
    return _decided(toxicity.scored(docs, model), 4, 2, rules.threshold)


def vocabulary_path() -> str:
    """The vocabulary file, from WAYMARK_VOCABULARY or the installed public tokenizers."""
    if "WAYMARK_VOCABULARY" in os.environ:
        return os.environ["WAYMARK_VOCABULARY"]
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokens.read_vocabulary(vocabulary_path()))


@query
def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents"))


@query
def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.top_k(table(spark, sf_dir, "embeddings"))


ORACLE["op7_neighbours"] = """
WITH points AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM points q JOIN points c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, rules = table(spark, sf_dir, "documents").select("doc_id", "text"), quality.QualityRules()
    model = quality.fit(docs, _not_held_out(table(spark, sf_dir, "labels"), "quality", 5, 0), rules)
    return _decided(quality.scored(docs, model, rules), 5, 0, rules.threshold)


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved))


ORACLE["op11_negatives"] = negatives.mined_sql("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")

# A conversation whose texts are made of control strings.
HOSTILE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@query
def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    hostile = spark.createDataFrame(HOSTILE, "conv_id long, turn long, role string, text string")
    return chat.read_back(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hostile))


ORACLE["op12_chat"] = chat.read_back_sql("VALUES " + ", ".join(str(row) for row in HOSTILE))


@query
def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.col("conv_id") - F.col("conv_id") % 100
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    return prefixes.trie(prefixes.rebuilt(prefixes.paths_of(table(spark, sf_dir, "conversations")), base, shared, 5))


ORACLE["op13_prefixes"] = prefixes.trie_sql()
