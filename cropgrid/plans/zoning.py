"""Planting-window zoning: 36 risk columns to windows, and a three-state municipal coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import code7, provenance, trimmed

# Decendio columns, eligible risk levels, crop and provenance texts.
DECENDIOS = [f"dec{i}" for i in range(1, 37)]
RISK_LEVELS = (20, 30, 40)
ZONING_CROP = "soja"
ZONING_SOURCE = "MAPA ZARC open risk table 2026/2027"
SEASON = (2026, 2027)
ABSENT = "absence from complete eligible table for crop/UF/season"
UNCOVERED = "crop/UF not covered by current official table"
COVERAGE_KEY = ["codigo_ibge", "cultura", "safra_inicio", "safra_fim"]
# Fields that stay with each unpivoted window.
WINDOW_FIELDS = [
    "SafraIni", "SafraFin", "Cod_Cultura", "Cod_Ciclo", "Cod_Solo", "geocodigo", "UF",
    "Cod_Outros_Manejos", "Nome_Outros_Manejos", "Portaria",
]


def planting_windows(
    raw: DataFrame, *, source_checksum: str, crop: str = ZONING_CROP, source: str = ZONING_SOURCE
) -> DataFrame:
    """One row per eligible ten-day window."""
    chosen = raw.where(F.upper(trimmed("Nome_cultura")) == crop.upper())
    risks = chosen.withColumns({d: trimmed(d).try_cast("byte") for d in DECENDIOS})
    long = risks.unpivot(WINDOW_FIELDS, DECENDIOS, "decendio_label", "nivel_risco")
    eligible = long.where(F.col("nivel_risco").isin(*RISK_LEVELS))
    whole = lambda c, kind: trimmed(c).try_cast(kind)
    typed = eligible.select(
        F.lit(crop).alias("cultura"),
        whole("SafraIni", "int").alias("safra_inicio"), whole("SafraFin", "int").alias("safra_fim"),
        F.col("Cod_Cultura").cast("string").alias("codigo_cultura_zarc"),
        whole("Cod_Ciclo", "short").alias("ciclo_codigo"),
        whole("Cod_Solo", "short").alias("tipo_solo_codigo"),
        code7("geocodigo").alias("codigo_ibge"), trimmed("UF").alias("uf"),
        whole("Cod_Outros_Manejos", "short").alias("manejo_codigo"),
        trimmed("Nome_Outros_Manejos").alias("manejo_nome_fonte"),
        trimmed("Portaria").alias("portaria"),
        F.substring("decendio_label", 4, 2).cast("byte").alias("decendio"), "nivel_risco",
    ).distinct()
    return provenance(
        typed, zarc_status="eligible", data_nature="observed", source=source,
        source_dataset_checksum=source_checksum,
    )


def zoning_coverage(
    windows: DataFrame, locations: DataFrame, *, season: tuple[int, int] = SEASON,
    crop: str = ZONING_CROP, source: str = ZONING_SOURCE,
) -> DataFrame:
    """Every location as eligible, not_eligible (its state is covered) or not_available."""
    listed = lambda c: F.array_sort(F.collect_set(c))
    eligible = windows.groupBy(*COVERAGE_KEY).agg(
        F.min("nivel_risco").alias("melhor_nivel_risco"),
        F.min("decendio").alias("janela_inicio_decendio"),
        F.max("decendio").alias("janela_fim_decendio"),
        listed("decendio").alias("decendios_elegiveis"),
        listed("ciclo_codigo").alias("ciclos_codigos"),
        listed("tipo_solo_codigo").alias("tipos_solo_codigos"),
        listed("portaria").alias("portarias"),
        F.count(F.lit(1)).alias("combinacoes_elegiveis"),
        F.min("source_dataset_checksum").alias("source_dataset_checksum"),
    )
    states = windows.select("uf", F.lit(True).alias("_covered")).distinct()
    base = locations.select("codigo_ibge", "municipio", "uf").withColumns(
        {
            "cultura": F.lit(crop),
            "safra_inicio": F.lit(season[0]).cast("int"), "safra_fim": F.lit(season[1]).cast("int"),
        }
    )
    joined = base.join(eligible, COVERAGE_KEY, "left").join(states, "uf", "left")
    found, covered = F.col("combinacoes_elegiveis").isNotNull(), F.col("_covered").isNotNull()
    return joined.withColumns(
        {
            "zarc_status": F.when(found, "eligible").when(covered, "not_eligible").otherwise("not_available"),
            "data_nature": F.when(found, "observed").otherwise("estimated"),
            "status_method": F.when(~found, F.when(covered, ABSENT).otherwise(UNCOVERED)),
            "source": F.lit(source),
        }
    ).drop("_covered")


def zoning_report(windows: DataFrame, coverage: DataFrame) -> DataFrame:
    status = lambda s: F.count_if(F.col("zarc_status") == s)
    left = coverage.agg(
        status("eligible").alias("municipalities_eligible"),
        status("not_eligible").alias("municipalities_not_eligible"),
        status("not_available").alias("municipalities_not_available"),
    )
    right = windows.agg(
        F.count(F.lit(1)).alias("window_rows"),
        F.size(F.collect_set("uf")).alias("ufs_covered"),  # at most one entry per state
        F.array_sort(F.collect_set("nivel_risco")).alias("risk_levels"),
    )
    return left.join(F.broadcast(right))  # two single rows
