"""Toxic texts of every language are found, also where one language has few of them."""

import os
import random

import pytest
from cropgrid.llm import quality
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


def test_marks_of_a_small_language(spark):
    r = random.Random(5)
    rows = []
    for i in range(1200):
        lang, toxic = ("big", i % 4 == 0) if i < 1120 else ("small", i % 10 == 0)
        words = [f"{lang}{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}" for _ in range(40)]
        rows.append((i, " ".join(words + ([f"{lang}slur"] if toxic else [])), lang, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    marks = quality.toxic_marks(quality.labelled(docs.drop("toxic"), docs.select("doc_id", F.lit(1).alias("quality"), "toxic")))
    found = quality.statistics(docs, marks).select("doc.toxic", "n_marks").collect()
    assert all((x.n_marks > 0) == (x.toxic > 0) for x in found)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_held_out_recall_by_language(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    marks, rules = quality.fit(docs, labels.where(half == 0))
    unseen = docs.join(labels.where(half == 1), "doc_id")
    judged = quality.statistics(unseen, marks).withColumn("caught", quality.verdict(rules).isNotNull())
    toxic = judged.where("doc.toxic > 0").groupBy("doc.lang").agg(F.avg(F.col("caught").cast("int")).alias("recall"), F.count("*").alias("n"))
    recall = {x.lang: x.recall for x in toxic.collect()}
    clean = judged.where("doc.toxic = 0 and doc.quality = 1").agg(F.avg(F.col("caught").cast("int"))).first()[0]
    print(recall, clean)
    assert len(recall) == 4 and min(recall.values()) > 0.75 and clean < 0.03
