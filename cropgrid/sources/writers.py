"""Table writes with manifests, artifact registration and stored analyses."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import insert_only
from ..operators.quality import fail_if_any
from .archive import opened_store

MANIFEST_SCHEMA = (
    "dataset string, dataset_version string, path string, rows long, fingerprint string, "
    "pipeline_version string, inputs array<string>, quality string, written_at timestamp"
)
ARTIFACT_SCHEMA = "stem string, suffix string, checksum_sha256 string, file_name string, path string, bytes long"


def _digest_sum(columns: list[str]) -> Column:
    """Sum of the rows' hashes, as text; it does not depend on their order."""
    row = F.xxhash64(*[F.col(c) for c in sorted(columns)]).cast("decimal(38,0)")
    return F.coalesce(F.sum(row), F.lit(0).cast("decimal(38,0)")).cast("string")


def fingerprint(df: DataFrame) -> DataFrame:
    """One row ``rows, fingerprint`` that depends on the rows but not on their order."""
    total = df.agg(F.count(F.lit(1)).alias("rows"), _digest_sum(df.columns).alias("_sum"))
    return total.select("rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), "_sum"), 256).alias("fingerprint"))


def manifests(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{root}/_manifests")
    except Exception as error:  # nothing written yet
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], MANIFEST_SCHEMA)
        raise


def replace_table(
    df: DataFrame, root: str, dataset: str, *, pipeline_version: str = "0.1.0",
    inputs: list[str] = (), partition_by: list[str] = (), quality: str | None = None,
    counters: dict[str, Column] | None = None, rules: dict[str, Column] | None = None,
) -> str:
    """Write a new version of a table and point its manifest to it; returns the version path.

    Rows, fingerprint, ``counters`` (aggregates) and the rows that break ``rules`` (conditions) are observed while the rows are
    written, so they pass once. The manifest row is the switch: if the write fails or a rule is broken, it is not
    added and the old version stays the table. The old version stays readable, so the job may read the table it replaces.
    """
    spark = df.sparkSession
    path = f"{root}/{dataset}/version={uuid.uuid4().hex}"
    told = {"rows": F.count(F.lit(1)), "fingerprint": _digest_sum(df.columns)}
    told |= {f"counter:{c}": aggregate for c, aggregate in (counters or {}).items()}
    told |= {f"rule:{c}": F.count_if(~F.coalesce(ok, F.lit(False))) for c, ok in (rules or {}).items()}
    seen = Observation(f"{dataset}-{uuid.uuid4().hex}")
    writer = df.observe(seen, *[c.alias(name) for name, c in told.items()]).write.mode("errorifexists").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    found = seen.get
    broken = {name.removeprefix("rule:"): n for name, n in found.items() if name.startswith("rule:") and n}
    if broken:
        raise ValueError(f"{dataset} breaks rules, its old version stays: {broken}")
    counted = {name.removeprefix("counter:"): value for name, value in found.items() if name.startswith("counter:")}
    if counted:
        quality = json.dumps(counted, default=str, sort_keys=True)
    digest = hashlib.sha256(f"{found['rows']}:{found['fingerprint']}".encode()).hexdigest()
    row = (dataset, f"{dataset}-{digest[:12]}", path, found["rows"], digest, pipeline_version, list(inputs), quality)
    told_schema = MANIFEST_SCHEMA.removesuffix(", written_at timestamp")
    spark.createDataFrame([row], told_schema).withColumn("written_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/_manifests")
    return path


def latest_manifests(spark: SparkSession, root: str) -> DataFrame:
    rows = manifests(spark, root)
    newest = F.max(F.struct("written_at", *[c for c in rows.columns if c != "written_at"])).alias("m")
    return rows.groupBy("dataset").agg(newest).select("m.*")


def read_table(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    found = latest_manifests(spark, root).where(F.col("dataset") == dataset).first()
    if found is None:
        raise FileNotFoundError(f"no version of {dataset} under {root}")
    return spark.read.parquet(found["path"])


def dataset_versions(spark: SparkSession, root: str, datasets: list[str]) -> DataFrame:
    """One row with a map from dataset to its newest version."""
    chosen = latest_manifests(spark, root).where(F.col("dataset").isin(*datasets))
    entry = F.struct("dataset", F.coalesce("dataset_version", "fingerprint").alias("version"))
    return chosen.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("dataset_versions"))


def artifact_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw files with their SHA-256 and the content-addressed name they are kept under."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    stem, suffix = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    hashed = files.select(
        stem.alias("stem"), suffix.alias("suffix"), F.sha2("content", 256).alias("checksum_sha256"),
        "path", F.col("length").alias("bytes"),
    )
    kept = F.concat("stem", F.lit("-"), F.substring("checksum_sha256", 1, 16), "suffix")
    return hashed.withColumn("file_name", kept)


def hashed_files(spark: SparkSession, path: str | list[str], *, chunk_bytes: int = 8 << 20) -> DataFrame:
    """``path, bytes, checksum_sha256`` of raw files, each read in chunks, so that its size does not matter to a task.

    Spark's listing leaves out files without a byte.
    """
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for name in batch.column("path").to_pylist():
                store, at = opened_store(name)
                digest = hashlib.sha256()
                with store.open_input_stream(at) as file:
                    while chunk := file.read(chunk_bytes):
                        digest.update(chunk)
                sums.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array(sums, pa.string())], ["path", "bytes", "checksum_sha256"])

    files = spark.read.format("binaryFile").load(path).select("path", "length")  # lists, does not read
    return files.mapInArrow(each, "path string, bytes long, checksum_sha256 string")


def register_artifacts(records: DataFrame, registered: DataFrame) -> DataFrame:
    """Records not registered yet; the same bytes twice are one artifact.

    Two different contents under one content-addressed name fail the job.
    """
    both = records.select("file_name", "checksum_sha256").unionByName(
        registered.select("file_name", "checksum_sha256")
    )
    clash = both.groupBy("file_name").agg(
        F.min("checksum_sha256").alias("a"), F.max("checksum_sha256").alias("b")
    ).where("a <> b")
    fail_if_any(clash, "immutable artifact collision")
    return insert_only(records, registered, ["file_name"], "checksum_sha256")


def append_analyses(analyses: DataFrame, path: str) -> None:
    analyses.write.mode("append").option("compression", "zstd").parquet(path)


def find_analysis(spark: SparkSession, path: str, analysis_id: str) -> DataFrame:
    """The stored analysis of one id; the filter reaches the Parquet scan."""
    try:
        normal = str(uuid.UUID(analysis_id))
    except ValueError as error:
        raise KeyError(f"invalid analysis id {analysis_id!r}") from error
    return spark.read.parquet(path).where(F.col("analysis_id") == normal)


def analysis_audit(analyses: DataFrame) -> DataFrame:
    return analyses.select("analysis_id", "audit.*")
