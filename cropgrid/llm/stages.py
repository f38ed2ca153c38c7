"""The stages of the corpus pipeline: each takes all documents its predecessor kept and lets its operator's decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropgrid.llm import bpe, decontaminate, jaccard, quality, secrets_scan
from cropgrid.session import kept_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned decision list rejects."""
    return quality.judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept").select("doc.*")


def row_keys(docs: DataFrame) -> DataFrame:
    """`_key`, a number of its own for each row, and the row as `doc`. It is the doc_id where that is given and unique.

    Rows that share an id, or have none, get numbers above all ids; of those alike in id and text one stays (the first by its
    JSON). Only ids are shuffled to find them, and only if there are any is a table with all rows written.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    key = F.col("doc_id").cast("long")
    rows = docs.select(key.alias("_key"), F.struct(*names).alias("doc"))
    ids = rows.groupBy("_key").agg(F.count("*").alias("n"))
    shared = kept_table(ids.where("n > 1 or _key is null").select("_key"), "shared_ids")
    if shared.isEmpty():
        return rows
    above = ids.agg((F.coalesce(F.max("_key"), F.lit(0)) + 1).alias("above"))
    same = rows.join(shared, "_key", "left_semi").groupBy("_key", F.sha2("doc.text", 256).alias("h")).agg(F.min_by("doc", F.to_json("doc")).alias("doc"))
    odd = same.select("doc").unionAll(rows.where("_key is null").select("doc"))
    keyed = odd.withColumn("_at", F.monotonically_increasing_id()).crossJoin(F.broadcast(above)).select((F.col("above") + F.col("_at")).alias("_key"), "doc")  # one row
    whole = rows.where("_key is not null").join(shared, "_key", "left_anti")
    return kept_table(whole.unionAll(keyed), "row_keys")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id; rows that share an id or have none come after all others.

    Such rows are documents of their own: they stay if they are near copies of nothing before them. Texts without words are linked
    with nothing and stay, but for rows alike in id and text."""
    rows = row_keys(docs)
    found = jaccard.groups(rows.select(F.col("_key").alias("doc_id"), F.col("doc.text").alias("text")))
    chosen = found.where("doc_id = component_id").select(F.col("doc_id").alias("_key"))
    return rows.join(chosen, "_key").select("doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.marked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(F.size("matches") == 0).select("doc.*")


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their live credentials masked and their lengths counted anew; a null text stays null."""
    text = F.when(F.col("_doc.text").isNotNull(), secrets_scan.masked("_doc.text", "verdicts"))
    changed = secrets_scan.scan(docs).select("_doc", text.alias("_text"))
    return changed.select(*[
        F.col("_text").alias("text") if c == "text" else F.length("_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"_doc.`{c}`").alias(c)
        for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    return bpe.encoded(docs)
