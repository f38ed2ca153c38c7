"""Inputs of a decision per municipality: yield, cost, price, zoning and climate scenarios.

State-level fallbacks are computed once per state and joined to the municipalities that need them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import code7, period_index, year_month
from ..operators.merge import adequate_climate
from ..operators.quantiles import exact_medians, exact_quantiles
from ..operators.skew import salted_join
from ..session import cut_lineage

# Scenario rules and the texts reported with them.
HISTORY_YEARS, HISTORY_MINIMUM = 10, 3
COST_COMPONENTS = {
    "custo_variavel_brl_ha": "cost_variable", "custo_operacional_brl_ha": "cost_operational",
    "custo_total_brl_ha": "cost_total",
}
COST_METHOD = "mediana dos valores mais recentes dos polos Conab na mesma UF"
PRICE_METHOD = "quantis da serie mensal estadual Conab como fallback municipal"
PRODUCER, PRICE_MONTHS = "PRODUTOR", 12
REANALYSIS_QUALITY = 0.75
NO_CLIMATE_ROW = "no municipality-season climate row for the requested reference"
NO_ZONING_ROW = "municipality absent from materialized coverage dimension"
REANALYSIS_ALERT = "ERA5_LAND_FALLBACK"


def yield_scenarios(panel: DataFrame, *, crop: str = "soja") -> DataFrame:
    """Quantiles of a municipality's last ten positive harvests, if it has at least three.

    A municipality has one row per year and system, so each group is small by nature.
    """
    back = Window.partitionBy("codigo_ibge").orderBy(F.desc("ano"))
    recent = (
        panel.where((F.col("cultura") == crop) & (F.col("produtividade_kg_ha") > 0))
        .select("codigo_ibge", "ano", "produtividade_kg_ha")
        .withColumn("_back", F.row_number().over(back))
        .where(F.col("_back") <= HISTORY_YEARS)
    )
    q = F.percentile("produtividade_kg_ha", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return recent.groupBy("codigo_ibge").agg(
        q.alias("_q"), F.count(F.lit(1)).alias("yield_sample_size"),
        F.concat_ws("-", F.min("ano"), F.max("ano")).alias("yield_reference_period"),
    ).where(F.col("yield_sample_size") >= HISTORY_MINIMUM).select(
        "codigo_ibge", F.col("_q")[0].alias("yield_p10"), F.col("_q")[1].alias("yield_p50"),
        F.col("_q")[2].alias("yield_p90"), "yield_sample_size", "yield_reference_period",
    )


def _two_level(facts: DataFrame, locations: DataFrame, columns: list[str]) -> DataFrame:
    """Municipality facts where they exist, else the facts of its state, as one struct.

    Every location asks for both places in one join, which spreads the locations of a state over tasks.
    """
    place = lambda scope, c, rank: F.struct(F.lit(scope).alias("scope"), F.col(c).alias("place"), F.lit(rank).alias("_rank"))
    asked = locations.select("codigo_ibge", F.inline(F.array(place("municipality", "codigo_ibge", 0), place("state", "uf", 1))))
    found = salted_join(asked, facts.select("scope", "place", F.struct(*columns).alias("_s")), ["scope", "place"])
    return found.groupBy("codigo_ibge").agg(F.min_by("_s", "_rank").alias("_s")).select("codigo_ibge", "_s.*")


def _place_facts(rows: DataFrame, *more: Column) -> DataFrame:
    month = year_month("ano", "mes")
    return rows.groupBy("scope", "place").agg(
        F.count(F.lit(1)).alias("rows"), F.min(month).alias("first_period"), F.max(month).alias("last_period"),
        F.array_sort(F.collect_set(month)).alias("periods"),  # one entry per calendar month
        *more,
    )


def selected_costs(costs: DataFrame) -> DataFrame:
    """Cost rows each place rests on: ``scope, place, ano, mes, municipio_fonte`` and components.

    A municipality rests on all rows of its latest month; a state on the latest row of each of its
    poles, by production system where months tie.
    """
    keep = ["uf", "ano", "mes", "municipio_fonte", *COST_COMPONENTS]
    rows = costs.select(
        code7("codigo_ibge_fonte").alias("code"), period_index("ano", "mes").alias("_period"), *keep,
        *[c for c in ("sistema_produtivo",) if c in costs.columns],
    )
    # Small next to the rows, and read twice, so the poles are materialised once.
    order = ["_period", *[c for c in ("sistema_produtivo",) if c in rows.columns]]
    latest = F.max(F.struct(*order, *keep[1:])).alias("_r")
    poles = cut_lineage(rows.groupBy("uf", "code").agg(latest))
    newest = poles.groupBy("code").agg(F.max("_r._period").alias("_newest"))
    exact = salted_join(rows, newest, ["code"]).where("_period = _newest").select(
        F.lit("municipality").alias("scope"), F.col("code").alias("place"), *keep[1:]
    )
    of_state = poles.select(
        F.lit("state").alias("scope"), F.col("uf").alias("place"), *[f"_r.{c}" for c in keep[1:]]
    )
    return exact.unionByName(of_state)


def cost_sources(costs: DataFrame) -> DataFrame:
    """Names behind the cost of every place, in long form: ``scope, place, municipio_fonte``."""
    return selected_costs(costs).select("scope", "place", "municipio_fonte").distinct()


def cost_scenarios(costs: DataFrame, locations: DataFrame) -> DataFrame:
    """Latest cost of the municipality, else the state median of the latest cost per pole."""
    chosen = cut_lineage(selected_costs(costs))
    medians = exact_medians(chosen, ["scope", "place"], list(COST_COMPONENTS)).groupBy("scope", "place").agg(
        *[
            F.max(F.when(F.col("name") == c, F.col("median"))).alias(alias)
            for c, alias in COST_COMPONENTS.items()
        ]
    )
    facts = medians.join(_place_facts(chosen), ["scope", "place"])
    observed = F.col("scope") == "municipality"
    facts = facts.withColumns(
        {
            "cost_type": F.when(observed, "observed").otherwise("estimated"),
            "cost_method": F.when(~observed, F.lit(COST_METHOD)),
            "cost_confidence": F.when(observed, 1.0).when(F.col("rows") > 1, 0.65).otherwise(0.55),
            "cost_reference_period": F.when(
                F.col("first_period") == F.col("last_period"), F.col("first_period")
            ).otherwise(F.concat_ws("/", "first_period", "last_period")),
            "cost_reference_periods": F.col("periods"),
            "cost_source_rows": F.col("rows"),
        }
    )
    columns = [
        *COST_COMPONENTS.values(), "cost_type", "cost_method", "cost_confidence",
        "cost_reference_period", "cost_reference_periods", "cost_source_rows",
    ]
    return _two_level(facts, locations, columns)


def price_scenarios(prices: DataFrame, locations: DataFrame) -> DataFrame:
    """Price quantiles of the latest twelve months, producer level first, else of the state."""
    level = F.col("coverage_level")
    place = F.when(level == "municipality", code7("codigo_ibge_fonte")).when(level == "state", F.col("uf"))
    rows = prices.select(
        level.alias("scope"), place.alias("place"), "ano", "mes", "nivel_comercializacao",
        F.col("preco_brl_kg").alias("price"), period_index("ano", "mes").alias("_period"),
        F.coalesce(F.col("nivel_comercializacao").contains(PRODUCER), F.lit(False)).alias("_producer"),
    ).where("place is not null")
    newest = rows.groupBy("scope", "place").agg(
        F.max("_period").alias("_any"), F.max(F.when(F.col("_producer"), F.col("_period"))).alias("_own")
    )
    own = F.col("_own").isNotNull()
    window = salted_join(rows, newest, ["scope", "place"]).where(
        (F.col("_producer") | ~own)
        & (F.col("_period") >= F.coalesce("_own", "_any") - (PRICE_MONTHS - 1))
    ).select("scope", "place", "ano", "mes", "nivel_comercializacao", "price")
    window = cut_lineage(window)  # the last year of prices, read three times below
    quantiles = exact_quantiles(
        window, ["scope", "place"], "price", {"price_p20": 0.2, "price_p50": 0.5, "price_p80": 0.8},
        count_as="price_sample_size",
    )
    levels = F.array_sort(F.collect_set("nivel_comercializacao")).alias("price_market_levels")
    facts = quantiles.join(_place_facts(window, levels), ["scope", "place"])
    observed, n = F.col("scope") == "municipality", F.col("price_sample_size")
    facts = facts.withColumns(
        {
            "price_type": F.when(observed, "observed").otherwise("estimated"),
            "price_method": F.when(~observed, F.lit(PRICE_METHOD)),
            "price_confidence": F.when(observed, F.least(F.lit(1.0), n / 12)).otherwise(
                F.least(F.lit(0.75), 0.45 + n / 40)
            ),
            "price_coverage_level": F.col("scope"),
            "price_reference_period": F.concat_ws("/", "first_period", "last_period"),
        }
    )
    columns = [
        "price_p20", "price_p50", "price_p80", "price_sample_size", "price_market_levels", "price_type",
        "price_method", "price_confidence", "price_coverage_level", "price_reference_period",
    ]
    return _two_level(facts, locations, columns)


def zoning_scenarios(coverage: DataFrame) -> DataFrame:
    status = F.col("zarc_status")
    payload = F.struct(
        F.col("melhor_nivel_risco").alias("best_risk_level"),
        F.col("decendios_elegiveis").alias("eligible_decendios"),
        F.col("ciclos_codigos").alias("cycle_codes"),
        F.col("tipos_solo_codigos").alias("soil_type_codes"),
        F.col("portarias").alias("ordinances"),
        F.col("combinacoes_elegiveis").alias("eligible_combinations"),
    )
    return coverage.select(
        "codigo_ibge", status.alias("zoning_status"),
        F.concat_ws("/", "safra_inicio", "safra_fim").alias("zoning_season"),
        F.col("safra_fim").cast("int").alias("_zoning_year"),
        F.col("source").alias("zoning_source"), F.col("status_method").alias("zoning_method"),
        F.when(status != "not_available", 1.0).otherwise(0.0).alias("zoning_confidence"),
        F.when(status == "eligible", payload).alias("zoning_windows"),
    )


def climate_scenarios(
    climate: DataFrame, requested: DataFrame | None = None, *, max_distance_km: float = 250.0,
    minimum_coverage: float = 0.70,
) -> DataFrame:
    """Climate of the requested season per municipality, or of its latest one.

    ``requested`` holds ``codigo_ibge, climate_season``; NULL or absence asks for the latest.
    """
    optional = {
        "distance_to_station_km": "double", "distance_to_grid_km": "double", "station_code": "string",
        "station_name": "string", "dry_days": "long", "days_temp_gt_35": "long", "quality_flag": "string",
        "source": "string", "data_nature": "string", "method": "string",
    }
    rows = climate.withColumns(
        {c: F.lit(None).cast(t) for c, t in optional.items() if c not in climate.columns}
    )
    if requested is not None:
        asked = requested.select("codigo_ibge", F.col("climate_season").cast("int").alias("_asked"))
        rows = rows.join(asked, "codigo_ibge", "left").where(
            F.col("_asked").isNull() | (F.col("season_year") == F.col("_asked"))
        )
    fields = [
        "season_year", *optional, "season_coverage", "rain_crop_cycle_mm", "mean_temp_c",
    ]
    one = rows.groupBy("codigo_ibge").agg(F.max(F.struct(*fields)).alias("r")).select("codigo_ibge", "r.*")
    reanalysis = F.coalesce(F.col("source").contains("ERA5"), F.lit(False))
    distance, coverage = F.col("distance_to_station_km"), F.col("season_coverage")
    near = F.when(distance.between(0, max_distance_km), F.greatest(F.lit(0.5), 1 - distance / max_distance_km))
    quality = F.when(reanalysis, REANALYSIS_QUALITY).otherwise(F.coalesce(near, F.lit(0.0)))
    available = adequate_climate(minimum_coverage) & (quality > 0)
    usable = F.col("_available")
    return one.withColumns({"_available": available, "_quality": quality}).select(
        "codigo_ibge", F.when(usable, "available").otherwise("not_available").alias("climate_status"),
        F.col("data_nature").alias("climate_type"), F.col("method").alias("climate_method"),
        F.col("source").alias("climate_source"),
        F.col("season_year").alias("climate_reference_season"),
        F.when(reanalysis, "reanalysis").otherwise("station").alias("climate_origin"),
        "station_code", "station_name", "distance_to_station_km", "distance_to_grid_km",
        "season_coverage", "rain_crop_cycle_mm", "dry_days", "mean_temp_c", "days_temp_gt_35",
        F.col("quality_flag").alias("climate_quality_flag"),
        F.when(usable, F.least(F.lit(1.0), coverage * F.col("_quality"))).otherwise(0.0).alias("climate_confidence"),
        F.when(usable & reanalysis, F.array(F.lit(REANALYSIS_ALERT))).otherwise(
            F.array().cast("array<string>")
        ).alias("climate_alerts"),
    )


def empty_alerts() -> Column:
    return F.array().cast("array<string>")
