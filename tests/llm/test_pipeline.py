"""The pipeline's stages one after the other, and what is registered."""

import re

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from soundings.llm import bpe, minhash


def test_stages(spark, documents, tmp_path):
    folder = str(tmp_path)
    docs = documents.selectExpr("*", "'x' AS th", "1 AS doc", "'y' AS ids", "2 AS component", "'z' AS words")
    spark.createDataFrame([(1, "ka ka ka ka po po po po"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    names = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = now
        now = stage(spark, now, folder)
        now.write.parquet(f"{folder}/stage{k}")
        now = spark.read.parquet(f"{folder}/stage{k}")
        names.append(name)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == docs.columns
        assert {r.doc_id for r in now.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
    assert names == ["language", "near_duplicates", "decontamination", "personal_data", "tokens"]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/stage3").collect()}
    c = bpe.codec()
    for r in now.collect():
        assert c.decode(r.ids) == texts[r.doc_id] and r.n_tokens == len(r.ids)


def test_empty_and_unlabelled(spark, documents, tmp_path):
    """An empty table goes through; without any label no language is known, and no text with a letter goes for it."""
    for name, docs in (("none", documents.limit(0)), ("unlabelled", documents.withColumn("lang", F.lit(None).cast("string")))):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        if name == "none":
            assert got == []
        else:
            texts = {r.doc_id: r.text for r in documents.collect()}
            kept = minhash.drop_near_duplicates(documents.where("text RLIKE '[a-zA-Z]'"))
            assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in kept.collect()) and all(texts[r.doc_id] for r in got)


def test_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
