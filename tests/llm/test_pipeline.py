"""The stages, each against a plain version of its work on its own input."""

import re

import corpus_pipeline
from strandloom.session import materialize
from tests.llm.test_texts import base_spans, cut, measured, near
from tests.llm.test_tokens import check_packing
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    results = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "stage")
        results.append(docs)
        assert name == "packing" or docs.columns == columns
    text = [{r.doc_id: r.text for r in d.collect()} for d in results[:-1]]
    first = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}

    for i, t in first.items():
        n, _, _, _, repeated = measured(t)
        assert i not in text[0] or (n >= 50 and 100 * repeated <= 50 * n)
    assert all(text[0][i] == first[i] for i in text[0]) and len(text[0]) > 0.6 * len(first)
    assert set(text[1]) == {c for _, c, _ in near([*text[0].items()])}
    assert all(text[1][i] == text[0][i] for i in text[1])
    want = {i: (t if m else text[1][i]) for i, n, m, t in cut([*text[1].items()]) if not m or m < n}
    assert text[2] == want
    for i, t in text[2].items():
        kinds = [s.split(":")[0].upper() for s in base_spans(t).split(",") if s]
        assert (text[3][i] == t) == (not kinds) and not base_spans(re.sub("<[A-Z]+>", "", text[3][i]))
    check_packing(results[-1].withColumn("crc", F.crc32("ids")).collect(), text[3])


def test_run_is_registered_and_complete(spark):
    import __spark_entry__

    rows = __spark_entry__.queries()["pipeline"](spark, SF)
    assert rows.agg(F.countDistinct("doc_id")).first()[0] > 100
    sizes = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert sizes.where("n > 1024").count() == 0 and sizes.where("n < 1024").count() <= 1


def test_two_results_can_be_read(spark):
    """A second result, of one stage or of all, leaves the first one's tables in place."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null")
    a, b = corpus_pipeline.pack(spark, docs, SF), corpus_pipeline.pack(spark, docs, SF)
    assert a.count() == b.count() > 0
    a = corpus_pipeline.run(spark, SF)
    b = corpus_pipeline.run(spark, SF)
    assert a.count() == b.count() > 0
