"""The queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropgrid.llm import bpe, chat, decontaminate, html_text, jaccard, merkle, mixing, quality, secrets_scan, simhash, substrings, suffixes, trie


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), keep_ids=False)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.marked(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc.doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.start", "m.end", "m.edits")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.scores(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    found = secrets_scan.scan(docs, keep=("doc_id",))
    count = lambda kind: F.expr(f"cast(size(filter(verdicts, s -> s.kind = '{kind}')) as long)").alias(f"n_{kind}")
    return found.select(
        "_doc.doc_id", *[count(kind) for kind in secrets_scan.BASE],
        F.sha2(secrets_scan.listed("verdicts", secrets_scan.BASE), 256).alias("base_sha256"),
        secrets_scan.listed("verdicts").alias("spans"),
        F.expr("cast(size(filter(verdicts, s -> s.live)) as long)").alias("n_live"),
        F.expr("cast(coalesce(array_max(transform(verdicts, s -> s.owners)), 0) as long)").alias("most_owners"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.judged(docs, table(spark, sf_dir, "labels")).select(
        "doc.doc_id", *quality.COUNTS, "base_failed", "kept", "rule")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checked(table(spark, sf_dir, "documents"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_jaccard": (op1_jaccard, None),
    "op2_bpe": (op2_bpe, None),
    "op3_chat": (op3_chat, chat.SQL),
    "op4_suffixes": (op4_suffixes, None),
    "op5_substrings": (op5_substrings, None),
    "op6_decontaminate": (op6_decontaminate, None),
    "op7_html": (op7_html, None),
    "op8_mixing": (op8_mixing, None),
    "op9_secrets": (op9_secrets, None),
    "op10_quality": (op10_quality, None),
    "op11_simhash": (op11_simhash, None),
    "op12_merkle": (op12_merkle, merkle.SQL),
    "op13_trie": (op13_trie, trie.SQL),
}
