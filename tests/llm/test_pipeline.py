"""The pipeline's stages against what they promise on planted rows."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import simhash

DATA = os.environ.get("TEST_LLM_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    top, docs, out = tmp_path_factory.mktemp("pipeline"), spark.read.parquet(f"{DATA}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{top}/{k}")
        out.append((docs, docs := spark.read.parquet(f"{top}/{k}")))
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "packing"]
    for before, after in stages[:-1]:
        assert after.columns == before.columns and 0 < after.count() <= before.count()
        assert after.exceptAll(before).count() == 0


@pytest.mark.parametrize("stage,column,bad", [(0, "toxic", 1), (1, "quality", 0)])
def test_filters_follow_labels(spark, stages, stage, column, bad):
    before, after = stages[stage]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    gone = before.join(after, "doc_id", "left_anti").join(labels, "doc_id")
    kept = after.join(labels, "doc_id")
    assert kept.where(F.col(column) == bad).count() <= 0.1 * max(1, gone.count())
    assert gone.where(F.col(column) != bad).count() <= 0.02 * kept.count()


def test_one_of_each_group_stays(stages):
    before, after = stages[2]
    least = {r["component_id"] for r in simhash.near_duplicates(before).select("component_id").distinct().collect()}
    assert {r["doc_id"] for r in after.select("doc_id").collect()} == least


def test_packing_takes_what_is_left(stages):
    before, after = stages[3]
    assert {r["doc_id"] for r in after.select("doc_id").distinct().collect()} == {r["doc_id"] for r in before.select("doc_id").collect()}
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_run_gives_the_last_stage(spark, stages):
    assert corpus_pipeline.run(spark, DATA).count() == stages[-1][1].count()
