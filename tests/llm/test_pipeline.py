"""The pipeline over the smallest tables: what each stage lets through."""

import os

import corpus_pipeline
import pytest
from cropgrid.llm import decontaminate, queries, stages

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    assert len(corpus_pipeline.STAGES) == 5
    for stage in (stages.quality_rules, stages.near_duplicates, stages.decontamination, stages.secret_masking):
        found = stage(spark, docs, SF)
        assert found.columns == docs.columns and found.schema.fields[0].dataType == docs.schema.fields[0].dataType
        assert {r.doc_id for r in found.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
    strange = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], docs.schema)
    assert stages.near_duplicates(spark, strange, SF).count() == 2
    assert stages.secret_masking(spark, strange, SF).count() == 3


def test_rows_that_share_an_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(a, 1), (b, 1), (b, 1), (b, 2), (c, None), (c, None), (c + " end", 3), (a + " end", None), (None, 4), (None, 4), ("", None), ("", None), ("x y", 5)]
    of = {"doc_id": lambda r: r[1], "text": lambda r: r[0], "lang": lambda r: "en", "source": lambda r: None, "n_chars": lambda r: 1}
    table = spark.createDataFrame([tuple(of[c](r) for c in docs.columns) for r in rows], docs.schema)
    kept = stages.near_duplicates(spark, table, SF)
    assert kept.columns == docs.columns
    left = sorted(((r.text, r.doc_id) for r in kept.collect()), key=str)
    # (b, 2) has an id of its own; a shares one and its near copy has none, so either is the first of the two
    first = [x for x in left if x[0] in (a, a + " end")]
    assert len(first) == 1 and sorted([x for x in left if x not in first], key=str) == sorted([(b, 2), (c + " end", 3), (None, 4), ("", None), ("", None), ("x y", 5)], key=str)
    for stage in (stages.quality_rules, stages.decontamination, stages.secret_masking):
        found = stage(spark, table, SF)
        assert found.columns == docs.columns and found.count() <= len(rows)
    assert stages.decontamination(spark, table, SF).count() == stages.secret_masking(spark, table, SF).count() == stages.tokens(spark, table, SF).count() == len(rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    whole = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert rows and {r.doc_id for r in rows} < set(whole)
    items = [t.texts for t in [decontaminate.Items([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])]][0]
    assert all(i.decode() not in (whole[r.doc_id] or "") for r in rows for i in items)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_one_query_for_each_operator(name):
    assert name.split("_")[0] in {f"op{n}" for n in range(1, 14)}
