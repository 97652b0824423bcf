"""The pipeline, stage by stage, against what its stages mean."""

from collections import Counter

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from waymark.llm import decontaminate, mixing, secrets, simhash


@pytest.fixture(scope="module")
def folder(spark, odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    extra = spark.createDataFrame([(200 + i, f"token = \"{'ab12' * 8}\" and text {i} {'u%d ' % i * 30}", "en", "a", 1, "x", "y", 9, "p", "k", "r") for i in range(5)], odd.schema)
    odd.unionByName(extra).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in (100, 101))) for i in range(100, 140)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    passage = {r["doc_id"]: r["text"] for r in odd.collect()}[8].split()[10:60]
    spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        path = f"{folder}/{k}"
        out.write.parquet(path)
        got = spark.read.parquet(path)
        if k < 4:
            assert got.columns == columns
        before, after = Counter(r["doc_id"] for r in docs.collect()), Counter(r["doc_id"] for r in got.collect())
        assert after and not after - before
        if name == "near_duplicates":
            classes = simhash.near_duplicates(docs, corpus_pipeline.NEAR_DUPLICATES).collect()
            assert set(after) - {None} == {r["component_id"] for r in classes if r["doc_id"] is not None}
        elif name == "decontamination":
            gone = {r["doc_id"] for r in decontaminate.contained(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
            assert gone and set(before) - set(after) == gone
        elif name == "secrets":
            assert before == after
            assert got.filter("text like '%[secret]%'").count() >= 5 and secrets.digest(secrets.scan(got)).filter("spans <> ''").count() == 0
        elif name == "mixing":
            want = {(r["doc_id"], r["taken"]) for r in mixing.mix(docs).collect() if r["taken"] > 0}
            assert {(r["doc_id"], r["taken"]) for r in got.collect()} == want
        docs = got


def test_run_and_registration(spark, folder):
    assert contract.queries()["pipeline"] is corpus_pipeline.run
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in contract.queries() if name.startswith("op") and name[2].isdigit()}
    first = corpus_pipeline.run(spark, folder)
    assert sorted((r["doc_id"] or -1, r["taken"]) for r in first.collect()) == sorted((r["doc_id"] or -1, r["taken"]) for r in corpus_pipeline.run(spark, folder).collect())


def test_clashing_columns_stay_as_they_are(spark, folder):
    names = ["_score", "score", "_spans", "spans", "base_spans", "_base_spans", "_size", "_key", "_bin", "_tie", "_row", "_source", "_print", "row"]
    plain = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    docs = plain.selectExpr("*", *[f"concat('{n} of ', doc_id) AS {n}" for n in names])
    without = plain
    for name, stage in corpus_pipeline.STAGES:
        docs, without = stage(spark, docs, folder).cache(), stage(spark, without, folder).cache()
        kept = [r.asDict() for r in docs.collect()]
        assert all(r[n] == (None if r["doc_id"] is None else f"{n} of {r['doc_id']}") for r in kept for n in names)
        assert Counter(tuple(r[c] for c in without.columns) for r in kept) == Counter(tuple(r) for r in without.collect())


def test_empty_tables(spark, nothing, tmp_path):
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
