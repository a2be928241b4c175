"""Tables of a step go when it has ended; pipeline stages bear any columns."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quireflow.llm import jaccard_join, tables

SMALL = "/root/testdata/sf0.001"


def folders(spark):
    place = Path(tables.shared_folder(spark).removeprefix("file://"))
    return {x.name for x in place.iterdir()} if place.exists() else set()


def test_only_results_are_left(spark):
    before = folders(spark)

    def outer():
        tables.written(spark.range(3), "one")
        inner = tables.finished(spark, "inner", lambda: tables.written(spark.range(5), "two").union(spark.range(1)))
        assert sorted(x.rsplit("-", 1)[0] for x in folders(spark) - before) == ["inner", "one"]
        return inner.where("id < 3")

    result = tables.finished(spark, "outer", outer)
    assert [x.rsplit("-", 1)[0] for x in folders(spark) - before] == ["outer"] and sorted(x.id for x in result.collect()) == [0, 0, 1, 2]
    before = folders(spark)

    def failing():
        tables.written(spark.range(3), "one")
        tables.finished(spark, "inner", lambda: spark.range(3))
        raise ValueError("stop")

    with pytest.raises(ValueError, match="stop"):
        tables.finished(spark, "outer", failing)
    assert folders(spark) == before
    table = tables.written(spark.range(2), "alone")
    tables.delete(spark, table.inputFiles()[0].rsplit("/", 1)[0])
    tables.delete(spark, tables.new_path(spark, "never"))
    assert folders(spark) == before


def test_a_join_leaves_its_result_alone(spark):
    before = folders(spark)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert jaccard_join.jaccard_join(docs).count() == docs.count()
    assert len(folders(spark) - before) == 1


def test_a_run_leaves_the_mix_alone(spark):
    before = folders(spark)
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    assert [x.rsplit("-", 1)[0] for x in folders(spark) - before] == ["mix"]


CLASHES = ("good", "score", "lang_pred", "copy", "a.b", "__h1", "__row", "size", "Source size")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_with_any_columns(spark, name, stage):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = docs.withColumn("a.b", F.array("doc_id")).withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in CLASHES if c != "a.b"})
    plain, out = stage(spark, docs, SMALL), stage(spark, extra, SMALL)
    assert out.columns == [*extra.columns, *(["mix_copy"] if name == "mix" else [])]
    rows = out.collect()
    assert sorted((x.doc_id, *([x.mix_copy] if name == "mix" else [])) for x in rows) == sorted((x.doc_id, *([x.copy] if name == "mix" else [])) for x in plain.collect())
    assert all(x["a.b"] == [x.doc_id] and x["good"] == f"good{x.doc_id}" and x["Source size"] == f"Source size{x.doc_id}" for x in rows)


def test_null_and_repeated_ids_are_decontaminated_by_their_texts(spark):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy(F.length("text").desc()).first().text
    rows = [(None, item), (None, "clean words only"), (7, item), (7, "clean words only"), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_contaminated(spark, docs, SMALL).collect()
    assert sorted((str(x.doc_id), str(x.text)) for x in kept) == [("7", "clean words only"), ("8", "None"), ("None", "clean words only")]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0


