"""Record contracts, key checks and quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_finite

# Natures a value can have; all but the first need a stated method.
DATA_NATURES = ("observed", "interpolated", "estimated", "predicted")
DERIVED_NATURES = DATA_NATURES[1:]
AREA_FLAG = "AREA_HARVESTED_GT_PLANTED"
SHA256 = r"^[0-9a-f]{64}$"


def _matches(c: str, pattern: str) -> Column:
    return F.coalesce(F.col(c).rlike(pattern), F.lit(False))


def _optional(c: str, rule: Column) -> Column:
    return F.col(c).isNull() | rule


def location_rules() -> dict[str, Column]:
    return {
        "codigo_ibge": _matches("codigo_ibge", r"^\d{7}$"),
        "municipio": F.coalesce(F.length(F.trim("municipio")) > 0, F.lit(False)),
        "uf": _matches("uf", r"^[A-Z]{2}$"),
        "regiao": F.coalesce(F.length(F.trim("regiao")) > 0, F.lit(False)),
        "latitude_centroid": _optional("latitude_centroid", F.col("latitude_centroid").between(-90, 90)),
        "longitude_centroid": _optional(
            "longitude_centroid", F.col("longitude_centroid").between(-180, 180)
        ),
    }


def production_rules() -> dict[str, Column]:
    measures = (
        "area_plantada_ha", "area_colhida_ha", "producao_t", "produtividade_kg_ha",
        "valor_producao_original", "valor_producao_brl",
    )
    over = F.coalesce(F.col("area_colhida_ha") > F.col("area_plantada_ha"), F.lit(False))
    return {
        "codigo_ibge": _matches("codigo_ibge", r"^\d{7}$"),
        "municipio": F.coalesce(F.length("municipio") > 0, F.lit(False)),
        "uf": _matches("uf", r"^[A-Z]{2}$"),
        "ano": F.coalesce(F.col("ano").between(1974, 2200), F.lit(False)),
        "cultura": _matches("cultura", r"^[a-z][a-z0-9_]*$"),
        **{m: _optional(m, F.col(m) >= 0) for m in measures},
        "source_type": F.coalesce(F.col("source_type").isin(*DATA_NATURES), F.lit(False)),
        "source_reference": F.col("source_reference").isNotNull(),
        "source_dataset_checksum": _matches("source_dataset_checksum", SHA256),
        "area_inconsistency_flagged": ~over
        | F.coalesce(F.array_contains("quality_flags", AREA_FLAG), F.lit(False)),
    }


def provenance_rules() -> dict[str, Column]:
    method = F.coalesce(F.length("method") > 0, F.lit(False))
    return {
        "data_nature": F.coalesce(F.col("data_nature").isin(*DATA_NATURES), F.lit(False)),
        "source": F.coalesce(F.length("source") >= 2, F.lit(False)),
        "source_reference": F.coalesce(F.length("source_reference") >= 1, F.lit(False)),
        "method": ~F.coalesce(F.col("data_nature").isin(*DERIVED_NATURES), F.lit(False)) | method,
        "confidence": _optional("confidence", F.col("confidence").between(0, 1)),
    }


def crop_rules() -> dict[str, Column]:
    return {
        "crop_id": F.coalesce(F.col("crop_id") > 0, F.lit(False)),
        "canonical_name": _matches("canonical_name", r"^[a-z][a-z0-9_]*$"),
        "temporaria_permanente": _matches("temporaria_permanente", r"^(temporaria|permanente)$"),
        "cycle_days_min": F.coalesce(F.col("cycle_days_min") > 0, F.lit(False)),
        "cycle_order": F.coalesce(F.col("cycle_days_max") >= F.col("cycle_days_min"), F.lit(False)),
        "pilot_active": (F.col("implementation_status") != "pilot") | F.col("active"),
    }


def artifact_rules() -> dict[str, Column]:
    return {
        "source": F.coalesce(F.length("source") >= 2, F.lit(False)),
        "download_url": F.coalesce(F.length("download_url") >= 4, F.lit(False)),
        "download_timestamp": F.col("download_timestamp").isNotNull(),
        "reference_period": F.coalesce(F.length("reference_period") >= 1, F.lit(False)),
        "checksum_sha256": _matches("checksum_sha256", SHA256),
        "file_name": F.coalesce(F.length("file_name") >= 1, F.lit(False)),
        "pipeline_version": F.coalesce(F.length("pipeline_version") >= 1, F.lit(False)),
    }


def with_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``violations``: the names of the rules a row breaks, in rule order."""
    broken = F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()])
    return df.withColumn("violations", F.array_compact(broken))


def split_by_rules(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their violations); no row is lost."""
    marked = with_violations(df, rules)
    valid = marked.where(F.size("violations") == 0).drop("violations")
    return valid, marked.where(F.size("violations") > 0)


def require(df: DataFrame, rules: dict[str, Column], what: str) -> DataFrame:
    """Rows as they are, failing the job at the first row that breaks a rule."""
    marked = with_violations(df, rules)
    text = F.concat(F.lit(f"{what} breaks rules: "), F.array_join("violations", ","))
    ok = F.when(F.size("violations") == 0, F.lit(True)).otherwise(F.raise_error(text).cast("boolean"))
    return marked.where(ok).drop("violations")


def guarded(df: DataFrame, facts: DataFrame, failing: Column, message: Column) -> DataFrame:
    """``df``, whose job fails with ``message`` of a row of ``facts`` that is ``failing``; it adds no row and no job.

    The message is raised inside the condition: beside it, the optimizer may evaluate it for other rows.
    """
    none = facts.where(F.when(failing, F.raise_error(message).cast("boolean")).otherwise(F.lit(False)))
    return df.unionAll(none.select(*[F.lit(None).cast(kind).alias(c) for c, kind in df.dtypes]))


def rule_summary(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``check, failing_rows`` for every rule in one pass over the rows."""
    totals = df.agg(*[F.count_if(~ok).alias(name) for name, ok in rules.items()])
    return totals.unpivot([], list(rules), "check_name", "failing_rows")


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def fail_if_any(df: DataFrame, message: str) -> None:
    if not df.isEmpty():
        raise ValueError(f"{message}: {[r.asDict() for r in df.limit(5).collect()]}")


def require_unique(df: DataFrame, key: list[str], what: str = "table") -> DataFrame:
    fail_if_any(duplicate_keys(df, key), f"duplicate keys {key} in {what}")
    return df


def many_to_one(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "inner", what: str = "facts") -> DataFrame:
    """Join ``facts`` onto ``rows`` by a key that ``facts`` must hold once; a key it holds twice fails the job.

    The copies are counted where the facts are already grouped by the key for the join, so the check costs no second pass and no
    job of its own. Null keys join nothing and may occur often.
    """
    others = [c for c in facts.columns if c not in keys]
    keyed = facts.dropna(subset=keys)
    fact = F.struct(*[F.col(c) for c in others]) if others else F.lit(True)
    single = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"), F.any_value(fact).alias("_fact"))
    text = F.concat(F.lit(f"{what} hold a key more than once: "), F.concat_ws(",", *[F.col(c).cast("string") for c in keys]))
    once = F.when(F.col("_copies") == 1, F.lit(True)).otherwise(F.raise_error(text).cast("boolean"))
    checked = single.where(once).select(*keys, *[F.col(f"_fact.{c}").alias(c) for c in others])
    return rows.join(checked, keys, how)


def join_offenders(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that would fail ``many_to_one``: ``keys, copies, rows_hit`` (rows that the join would multiply)."""
    copies = duplicate_keys(facts.dropna(subset=keys), keys)
    hit = rows.join(copies.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_hit"))
    return copies.join(hit, keys, "left").withColumn("rows_hit", F.coalesce("rows_hit", F.lit(0)))


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, missing`` for all columns in one aggregate."""
    totals = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return totals.unpivot([], columns, "column_name", "missing")


# Production measures whose gaps are reported.
REPORTED_MEASURES = [
    "area_plantada_ha", "area_colhida_ha", "producao_t", "produtividade_kg_ha",
    "valor_producao_original", "valor_producao_brl",
]


def production_report(panel: DataFrame, measures: list[str] = REPORTED_MEASURES) -> DataFrame:
    """One row: size, duplicate keys, year range, distincts, gaps and flagged rows.

    Rows are first reduced per key, so distinct counts run over keys instead of raw rows.
    """
    key = ["codigo_ibge", "cultura", "ano", "sistema_produtivo"]
    per_key = panel.groupBy(*key).agg(
        F.count(F.lit(1)).alias("copies"),
        F.count_if(F.size("quality_flags") > 0).alias("flagged"),
        *[F.count_if(F.col(m).isNull()).alias(m) for m in measures],
    )
    per_pair = per_key.groupBy("codigo_ibge", "cultura").agg(
        F.sum("copies").alias("rows"),
        F.count_if(F.col("copies") > 1).alias("duplicate_keys"),
        F.min("ano").alias("year_min"), F.max("ano").alias("year_max"),
        F.sum("flagged").alias("flagged_rows"),
        *[F.sum(m).alias(m) for m in measures],
    )
    per_place = per_pair.groupBy("codigo_ibge").agg(
        *[F.sum(c).alias(c) for c in ("rows", "duplicate_keys", "flagged_rows", *measures)],
        F.min("year_min").alias("year_min"), F.max("year_max").alias("year_max"),
        F.collect_set("cultura").alias("crops"),
    )
    return per_place.agg(
        F.sum("rows").alias("rows"),
        F.lit(len(panel.columns)).cast("long").alias("columns"),
        F.sum("duplicate_keys").alias("duplicate_keys"),
        F.min("year_min").alias("year_min"), F.max("year_max").alias("year_max"),
        F.count(F.lit(1)).alias("municipalities"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("crops")))).alias("crops"),
        F.sum("flagged_rows").alias("flagged_rows"),
        *[F.sum(m).alias(f"missing_{m}") for m in measures],
    )


def set_difference(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Codes of one side only: ``code, side`` in {left_only, right_only}."""
    a = left.select(F.col(column).alias("code")).distinct()
    b = right.select(F.col(column).alias("code")).distinct()
    return a.join(b, "code", "left_anti").withColumn("side", F.lit("left_only")).unionByName(
        b.join(a, "code", "left_anti").withColumn("side", F.lit("right_only"))
    )


def finite_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    totals = df.agg(*[F.count_if(is_finite(c)).alias(c) for c in columns])
    return totals.unpivot([], columns, "column_name", "finite")
