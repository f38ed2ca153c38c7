"""Economics, profit risk, ranking and recommendations for all municipalities at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import COMPONENTS, CROPS, RANKING_PROFILES, RANKING_VERSION, Settings
from ..functions.columns import clip, flags
from ..functions.draws import DIMENSIONS, seeded_stream
from ..operators.skew import salted_join
from ..sources.dimensions import profile_rows
from .scenarios import (
    NO_CLIMATE_ROW, NO_ZONING_ROW, climate_scenarios, cost_scenarios, empty_alerts, price_scenarios,
    yield_scenarios, zoning_scenarios,
)

# Economic and ranking constants, audit texts, alerts and reasons.
DAYS_PER_MONTH = 365.25 / 12
COST_SPREAD = 0.10
HIGH_UNCERTAINTY, FEW_PRICES = 0.5, 12
RISK_SCORES = {20: 100.0, 30: 75.0}
OTHER_RISK_SCORE = 50.0
CONFIDENCE_WEIGHTS = {"yield": 25, "climate": 15, "cost": 20, "price": 20, "zoning": 20}
LABELS = ((80, "high"), (55, "medium"))
MISMATCH_NO_YEAR = "yield uses historical quantiles without a single forecast harvest year"
MISMATCH_COST = "cost reference years differ from the yield target year"
MISMATCH_PRICE = "price reference years differ from the yield target year"
MISMATCH_ZONING = "ZARC harvest season differs from the yield target year"
MISMATCH_CLIMATE = "climate reference does not match the model's prior-season contract"
NOTE_MIXED = (
    "Cenario economico com referencias de periodos diferentes; nao e uma previsao "
    "alinhada para a safra ZARC. O clima defasado e uma entrada historica do modelo."
)
NOTE_ALIGNED = (
    "Cenario com referencias no mesmo ano; custos e precos sao historicos, "
    "e o clima defasado e uma entrada historica do modelo."
)
EXCLUDED_REASON = "Municipio nao elegivel na tabela oficial ZARC da safra."
NO_ZONING_REASON = "ZARC indisponivel: ausencia reduz a confianca, mas nao exclui."
YIELD_SOURCE, PREDICTED_SOURCE = "IBGE/PAM/SIDRA table 5457", "IBGE/PAM history and lagged climate features"
COST_SOURCE, PRICE_SOURCE = "CONAB CustoProducao.txt", "CONAB precos mensais"


def economics(
    expected: Column, price: Column, operational: Column, total: Column, area: Column, days: Column
) -> dict[str, Column]:
    """Per-hectare and per-area results of one scenario; area results are NULL without an area."""
    revenue = expected * price
    profit = revenue - total
    months = F.when(days > 0, days / F.lit(DAYS_PER_MONTH))
    return {
        "revenue_brl_ha": revenue,
        "operating_margin_brl_ha": revenue - operational,
        "economic_profit_brl_ha": profit,
        "roi": F.try_divide(profit, total),
        "break_even_price_brl_kg": F.try_divide(total, expected),
        "break_even_yield_kg_ha": F.try_divide(total, price),
        "revenue_total_brl": revenue * area,
        "profit_total_brl": profit * area,
        "capital_required_brl": total * area,
        "profit_per_month_brl": profit * area / months,
    }


def economics_problem(expected, price, operational, total) -> Column:
    """Why a scenario has no economics, or NULL."""
    return (
        F.when(~(expected > 0) | expected.isNull(), "expected yield must be positive")
        .when(~(price > 0) | price.isNull(), "price must be positive")
        .when(~(total > 0) | total.isNull(), "total cost must be positive")
        .when(total < operational, "total cost below operational cost")
    )


RISK_SCHEMA = (
    "probability_profit double, probability_loss double, profit_p10_brl_ha double, "
    "profit_p50_brl_ha double, profit_p90_brl_ha double, expected_profit_brl_ha double, "
    "expected_downside_brl_ha double"
)
RISK_FIELDS = [f.split()[0] for f in RISK_SCHEMA.split(", ")]
# Rows simulated at once: bounds a worker's memory to rows x draws, whatever the batch size.
RISK_ROWS = 64


def _triangular(u: np.ndarray, low: np.ndarray, mode: np.ndarray, high: np.ndarray) -> np.ndarray:
    base = high - low
    rising = low + np.sqrt(u * (mode - low) * base)
    falling = high - np.sqrt((1 - u) * (high - mode) * base)
    return np.where(u * base <= mode - low, rising, falling)


def _simulator(stream: np.ndarray, n: int):
    """Vectorised simulation of Arrow batches; a task needs nothing but its rows and the stream."""
    slices = stream.reshape(DIMENSIONS, n)

    @F.pandas_udf(RISK_SCHEMA)
    def simulate(batch: pd.DataFrame) -> pd.DataFrame:
        limits = batch.to_numpy(dtype=float)
        out = np.full((len(limits), len(RISK_FIELDS)), np.nan)
        known = np.isfinite(limits).all(axis=1)
        # A range without width is constant and leaves its draws to the next one; rows with the same widths share draws.
        wide = limits[:, 0::3] < limits[:, 2::3]
        for pattern in np.unique(wide[known], axis=0):
            turn = np.r_[0, np.cumsum(pattern[:-1])]
            alike = np.flatnonzero(known & (wide == pattern).all(axis=1))
            for start in range(0, len(alike), RISK_ROWS):
                rows = alike[start : start + RISK_ROWS]
                drawn = []
                for d in range(DIMENSIONS):
                    low, mode, high = (limits[rows, 3 * d + i][:, None] for i in range(3))
                    drawn.append(np.where(low == high, low, _triangular(slices[turn[d]], low, mode, high)))
                profit = drawn[0] * drawn[1] - drawn[2]
                out[rows] = np.column_stack(
                    [
                        (profit > 0).mean(axis=1), (profit < 0).mean(axis=1),
                        *np.quantile(profit, [0.1, 0.5, 0.9], axis=1),
                        profit.mean(axis=1), np.minimum(profit, 0.0).mean(axis=1),
                    ]
                )
        return pd.DataFrame(out, columns=RISK_FIELDS)

    return simulate


def profit_risk(
    df: DataFrame, stream: np.ndarray, simulations: int, *,
    ranges: dict[str, tuple[Column, Column, Column]],
) -> DataFrame:
    """Add the simulated profit distribution of every row; rows with unknown ranges get NULLs.

    All municipalities share one stream of uniforms. Rows are simulated where they lie, without a
    shuffle, and only nine numbers per row travel to Python.
    """
    if len(stream) != DIMENSIONS * simulations:
        raise ValueError(f"the stream must hold {DIMENSIONS} x {simulations} uniforms")
    limits = F.struct(
        *[ranges[d][i].cast("double").alias(f"{d}{i}") for d in ("yield", "price", "cost") for i in range(3)]
    )
    simulated = df.withColumn("_risk", _simulator(stream, simulations)(limits))
    nothing = F.lit(float("nan"))
    return simulated.withColumns({f: F.nullif(F.col(f"_risk.{f}"), nothing) for f in RISK_FIELDS}).drop("_risk")


def scenario_ranges() -> dict[str, tuple[Column, Column, Column]]:
    total = F.col("cost_total")
    return {
        "yield": (F.col("yield_p10"), F.col("yield_p50"), F.col("yield_p90")),
        "price": (F.col("price_p20"), F.col("price_p50"), F.col("price_p80")),
        "cost": (total * (1 - COST_SPREAD), total, total * (1 + COST_SPREAD)),
    }


def cycle_days(crop: str = "soja") -> int:
    record = next(c for c in CROPS if c["canonical_name"] == crop)
    return round((record["cycle_days_min"] + record["cycle_days_max"]) / 2)


def composite_confidence() -> Column:
    """0..100 from the quality of each input; a missing input counts nothing."""
    predicted = F.col("yield_type") == "predicted"
    own = F.when(predicted, F.col("performance_confidence")).otherwise(
        F.least(F.col("yield_sample_size") / 10, F.lit(1.0))
    )
    parts = {
        "yield": own, "climate": F.col("climate_confidence"), "cost": F.col("cost_confidence"),
        "price": F.col("price_confidence"), "zoning": F.col("zoning_confidence"),
    }
    total = F.lit(0.0)
    for name, weight in CONFIDENCE_WEIGHTS.items():
        total = total + F.coalesce(parts[name], F.lit(0.0)) * weight
    return F.rint(total * 100) / 100


def confidence_label(score: Column) -> Column:
    (high, top), (mid, middle) = LABELS
    return F.when(score >= high, top).when(score >= mid, middle).otherwise("low")


def components(roi: Column, p_profit: Column, risk_level: Column, days: Column, confidence: Column):
    agronomic = F.lit(OTHER_RISK_SCORE)
    for level, score in RISK_SCORES.items():
        agronomic = F.when(risk_level == level, score).otherwise(agronomic)
    return {
        "return": clip((roi + 0.5) / 1.5 * 100, 0.0, 100.0),
        "risk": p_profit * 100,
        "agronomic": agronomic,
        "speed": clip(100 - (days - 90) / 275 * 100, 0.0, 100.0),
        "confidence": confidence,
    }


def weighted_score(prefix: str = "component_") -> Column:
    """Dot product of the components with the weights of the row's profile."""
    total = F.lit(0.0)
    for c in COMPONENTS:
        total = total + F.col(prefix + c) * F.col(f"w_{c}")
    return F.rint(total * 1e6) / 1e6


def min_max(
    df: DataFrame, value: str, *, keys: list[str] = (), higher_is_better: bool = True,
    output: str = "normalised",
) -> DataFrame:
    """Scale a column to 0..100 per key; equal values all get 50."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    if keys:
        joined = salted_join(df, ends, list(keys))
    else:
        joined = df.join(F.broadcast(ends))  # one row
    scaled = (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 100
    score = F.when(F.col("_lo") == F.col("_hi"), 50.0).otherwise(
        scaled if higher_is_better else 100 - scaled
    )
    return joined.withColumn(output, F.when(F.col(value).isNotNull(), score)).drop("_lo", "_hi")


def _first_year(period: Column) -> Column:
    return F.substring(period, 1, 4).try_cast("int")


def temporal_context() -> Column:
    """Struct naming every input period that is not the yield's target year."""
    target = F.col("yield_target_year")
    known = target.isNotNull()
    years = F.transform("cost_reference_periods", _first_year)
    off = lambda years_: F.exists(years_, lambda y: y != target)
    price_years = F.transform(F.split("price_reference_period", "/"), _first_year)
    season = F.col("climate_reference_season")
    mismatches = flags(
        (~known, MISMATCH_NO_YEAR),
        (known & off(years), MISMATCH_COST),
        (known & off(price_years), MISMATCH_PRICE),
        (known & (F.col("_zoning_year") != target), MISMATCH_ZONING),
        (known & (season != target - 1), MISMATCH_CLIMATE),
    )
    mixed = F.size(mismatches) > 0
    return F.struct(
        F.when(mixed, "hybrid_reference").otherwise("reference_scenario").alias("scenario_type"),
        F.lit(False).alias("aligned_forecast"),
        target.alias("yield_target_year"), F.col("yield_reference_period"),
        season.alias("climate_reference_season"),
        F.when(known, "lagged_model_feature").otherwise("historical_context").alias("climate_usage"),
        F.col("cost_reference_period"), F.col("cost_reference_periods"), F.col("price_reference_period"),
        F.col("zoning_season").alias("zarc_season"), mismatches.alias("mismatches"),
        F.when(mixed, NOTE_MIXED).otherwise(NOTE_ALIGNED).alias("note"),
    )


def _alerts(model_alert: str | None) -> Column:
    predicted = F.col("yield_type") == "predicted"
    width = (F.col("yield_p90") - F.col("yield_p10")) / F.greatest("yield_p50", F.lit(1.0))
    producer = F.exists("price_market_levels", lambda level: level.contains("PRODUTOR"))
    own = flags(
        (F.size("temporal_context.mismatches") > 0, "TEMPORAL_MISMATCH"),
        (~predicted & F.lit(model_alert is not None), model_alert or ""),
        (F.col("climate_status") == "not_available", "MISSING_CLIMATE"),
        (F.col("climate_quality_flag") == "NO_NEARBY_INMET_STATION", "NO_NEARBY_INMET_STATION"),
        (predicted & (width > HIGH_UNCERTAINTY), "HIGH_YIELD_UNCERTAINTY"),
        (F.col("zoning_status") == "not_available", "MISSING_ZARC"),
        (F.col("price_sample_size") < FEW_PRICES, "LOW_PRICE_SAMPLE"),
        (~F.coalesce(producer, F.lit(False)), "PRICE_MARKET_LEVEL_NOT_PRODUCER"),
        (F.col("cost_type") != "observed", "LOW_COST_DATA_CONFIDENCE"),
    )
    none = empty_alerts()
    return F.concat(F.coalesce("yield_alerts", none), F.coalesce("climate_alerts", none), own)


def _reasons() -> Column:
    predicted = F.col("yield_type") == "predicted"
    about_yield = F.when(
        predicted,
        F.format_string(
            "Produtividade prevista pelo modelo %s para %d, com intervalo conformal calibrado.",
            "model_version", "yield_target_year",
        ),
    ).otherwise(
        F.format_string("Produtividade baseada em %d anos municipais do IBGE/PAM.", "yield_sample_size")
    )
    available = F.col("climate_status") == "available"
    about_climate = F.when(
        available & (F.col("climate_origin") == "reanalysis"),
        F.format_string(
            "Clima da safra %d estimado pela reanalise ERA5-Land como fallback para a cobertura "
            "INMET indisponivel.", "climate_reference_season",
        ),
    ).when(
        available,
        F.format_string(
            "Clima da safra %d interpolado da estacao INMET %s a %.1f km.",
            "climate_reference_season", "station_code", "distance_to_station_km",
        ),
    )
    about_zoning = F.when(
        F.col("zoning_status") == "eligible",
        F.format_string(
            "ZARC oficial %s indica elegibilidade, com melhor risco de %d%%.",
            "zoning_season", "zoning_windows.best_risk_level",
        ),
    ).otherwise(NO_ZONING_REASON)
    return F.array_compact(
        F.array(
            about_yield,
            F.format_string("Cenario base usa preco mediano de R$ %.2f/kg da Conab.", "price_p50"),
            F.format_string("Margem economica base de R$ %,.2f/ha.", "economic_profit_brl_ha"),
            about_climate,
            F.when(F.size("temporal_context.mismatches") > 0, F.col("temporal_context.note")),
            about_zoning,
        )
    )


def decision_inputs(
    locations: DataFrame, panel: DataFrame, costs: DataFrame, prices: DataFrame, *,
    zoning: DataFrame | None = None, climate: DataFrame | None = None, predicted: DataFrame | None = None,
    settings: Settings | None = None, crop: str = "soja",
) -> DataFrame:
    """One row per location with all its scenarios and ``status``.

    ``excluded`` when zoning says not eligible, ``unavailable`` with the first missing input, else
    ``recommended``. Predicted yields replace historical ones where they exist.
    """
    cfg = settings or Settings()
    text = lambda: F.lit(None).cast("string")
    base = locations.select("codigo_ibge", "municipio", "uf").join(
        yield_scenarios(panel, crop=crop), "codigo_ibge", "left"
    )
    history = F.col("yield_sample_size").isNotNull()
    base = base.withColumn("_history", history)
    extra = {
        "yield_type": F.lit("estimated"), "yield_target_year": F.lit(None).cast("int"),
        "model_version": text(), "performance_confidence": F.lit(None).cast("double"),
        "climate_season": F.lit(None).cast("int"), "yield_alerts": empty_alerts(),
    }
    base = base.withColumns(extra)
    if predicted is not None:
        fields = ["yield_p10", "yield_p50", "yield_p90", "yield_reference_period", *extra]
        renamed = predicted.select("codigo_ibge", F.struct(*fields).alias("_m"))
        base = base.join(renamed, "codigo_ibge", "left").withColumns(
            {c: F.when(F.col("_m").isNotNull(), F.col(f"_m.{c}")).otherwise(F.col(c)) for c in fields}
        ).drop("_m")
    if zoning is not None:
        base = base.join(zoning_scenarios(zoning), "codigo_ibge", "left")
    else:
        empty = (
            "struct<best_risk_level:int,eligible_decendios:array<int>,cycle_codes:array<int>,"
            "soil_type_codes:array<int>,ordinances:array<string>,eligible_combinations:bigint>"
        )
        base = base.withColumns(
            {
                "zoning_status": text(), "zoning_season": text(),
                "_zoning_year": F.lit(None).cast("int"), "zoning_source": text(),
                "zoning_method": text(), "zoning_confidence": F.lit(0.0),
                "zoning_windows": F.lit(None).cast(empty),
            }
        )
    base = base.withColumns(
        {
            "zoning_status": F.coalesce("zoning_status", F.lit("not_available")),
            "zoning_confidence": F.coalesce("zoning_confidence", F.lit(0.0)),
            "zoning_method": F.when(F.col("zoning_status").isNull(), NO_ZONING_ROW).otherwise(F.col("zoning_method")),
        }
    )
    if climate is not None:
        asked = predicted.select("codigo_ibge", "climate_season") if predicted is not None else None
        found = climate_scenarios(
            climate, asked, max_distance_km=cfg.climate.max_station_distance_km,
            minimum_coverage=cfg.climate.minimum_season_coverage,
        )
        base = base.join(found, "codigo_ibge", "left")
    else:
        kinds = {
            "climate_status": "string", "climate_type": "string", "climate_method": "string",
            "climate_source": "string", "climate_reference_season": "int", "climate_origin": "string",
            "station_code": "string", "station_name": "string", "distance_to_station_km": "double",
            "distance_to_grid_km": "double", "season_coverage": "double", "rain_crop_cycle_mm": "double",
            "dry_days": "long", "mean_temp_c": "double", "days_temp_gt_35": "long",
            "climate_quality_flag": "string", "climate_confidence": "double",
            "climate_alerts": "array<string>",
        }
        base = base.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items()})
    base = base.withColumns(
        {
            "climate_method": F.when(F.col("climate_status").isNull(), NO_CLIMATE_ROW).otherwise(F.col("climate_method")),
            "climate_status": F.coalesce("climate_status", F.lit("not_available")),
            "climate_confidence": F.coalesce("climate_confidence", F.lit(0.0)),
        }
    )
    full = base.join(cost_scenarios(costs, locations), "codigo_ibge", "left").join(
        price_scenarios(prices, locations), "codigo_ibge", "left"
    )
    money = F.col("cost_total").isNotNull() & F.col("cost_operational").isNotNull()
    problem = economics_problem(
        F.col("yield_p50"), F.col("price_p50"), F.col("cost_operational"), F.col("cost_total")
    )
    missing = (
        F.when(~F.col("_history"), "INSUFFICIENT_HISTORY")
        .when(F.col("cost_type").isNull(), "MISSING_COST_COVERAGE")
        .when(~money, "MISSING_COST_COMPONENT")
        .when(F.col("price_type").isNull(), "MISSING_PRICE_COVERAGE")
        .when(problem.isNotNull(), "INVALID_ECONOMICS")
    )
    excluded = F.col("zoning_status") == "not_eligible"
    return full.withColumns(
        {
            "status": F.when(excluded, "excluded").when(missing.isNotNull(), "unavailable").otherwise("recommended"),
            "status_alert": F.when(excluded, "ZARC_NOT_ELIGIBLE").otherwise(missing),
        }
    ).drop("_history")


def recommendations(
    inputs: DataFrame, *, stream: np.ndarray | None = None, settings: Settings | None = None,
    area_ha: float | Column | None = None, model_alert: str | None = "MODEL_NOT_AVAILABLE",
    profiles: dict[str, dict[str, float]] = RANKING_PROFILES, crop: str = "soja",
) -> DataFrame:
    """Every location under every profile: economics, risk, components, score and alerts.

    Excluded and unavailable locations stay in the result, without economics.
    """
    cfg = settings or Settings()
    draws = stream if stream is not None else seeded_stream(cfg.risk.seed, cfg.risk.simulations)
    days = cycle_days(crop)
    area = area_ha if isinstance(area_ha, Column) else F.lit(area_ha).cast("double")
    ok = F.col("status") == "recommended"
    rows = inputs.withColumn("area_ha", area)
    money = economics(
        F.col("yield_p50"), F.col("price_p50"), F.col("cost_operational"), F.col("cost_total"),
        F.col("area_ha"), F.lit(days),
    )
    rows = rows.withColumns({k: F.when(ok, v) for k, v in money.items()})
    ranges = {d: tuple(F.when(ok, c) for c in r) for d, r in scenario_ranges().items()}
    rows = profit_risk(rows, draws, cfg.risk.simulations, ranges=ranges)
    rows = rows.withColumn("confidence_score", F.when(ok, composite_confidence()))
    parts = components(
        F.col("roi"), F.col("probability_profit"), F.col("zoning_windows.best_risk_level"),
        F.lit(days), F.col("confidence_score"),
    )
    rows = rows.withColumns({f"component_{k}": F.when(ok, v) for k, v in parts.items()})
    rows = rows.withColumns(
        {
            "temporal_context": F.when(ok, temporal_context()),
            "confidence_label": F.when(ok, confidence_label(F.col("confidence_score"))),
            "crop": F.lit(crop), "cycle_days": F.lit(days),
            "harvests_per_year": F.lit(365 // days),
        }
    )
    rows = rows.withColumns(
        {
            "alerts": F.when(ok, _alerts(model_alert)).otherwise(F.array("status_alert")),
            "reasons": F.when(ok, _reasons()).when(
                F.col("status") == "excluded", F.array(F.lit(EXCLUDED_REASON))
            ),
        }
    )
    profiled = rows.select("*", F.inline(profile_rows(profiles)))
    return profiled.withColumn("score", F.when(ok, weighted_score())).drop(
        "_zoning_year", *[f"w_{c}" for c in COMPONENTS]
    )


def analyses(recommended: DataFrame, *, settings: Settings | None = None, versions: Column | None = None) -> DataFrame:
    """Stored documents: request, result and audit as structs under a reproducible id.

    The id is a UUID made from the hash of the inputs and configuration, so a rerun over the same
    data writes the same ids.
    """
    cfg = settings or Settings()
    skip = {"codigo_ibge", "municipio", "uf", "area_ha", "profile", "temporal_context", "status"}
    fields = [c for c in recommended.columns if c not in skip]
    body = F.struct(*fields)
    digest = F.sha2(
        F.concat_ws("|", F.lit(cfg.config_version), "codigo_ibge", "profile", F.to_json(body)), 256
    )
    part = lambda i, n: F.substring(digest, i, n)
    used = F.array(
        F.when(F.col("yield_type") == "predicted", PREDICTED_SOURCE).otherwise(YIELD_SOURCE),
        F.lit(COST_SOURCE), F.lit(PRICE_SOURCE), "zoning_source", "climate_source",
    )
    # a place that was not recommended rests on its zoning alone
    chosen = F.when(F.col("status") == "recommended", used).otherwise(F.array("zoning_source"))
    sources = F.array_distinct(F.array_compact(chosen))
    audit = F.struct(
        F.lit(RANKING_VERSION).alias("ranking_config_version"),
        F.lit(cfg.pipeline_version).alias("pipeline_version"),
        sources.alias("sources_used"), F.col("model_version"),
        (versions if versions is not None else F.lit(None).cast("map<string,string>")).alias("dataset_versions"),
        F.col("temporal_context"),
    )
    return recommended.select(
        F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)).alias("analysis_id"),
        F.current_timestamp().alias("timestamp"),
        F.struct("codigo_ibge", "municipio", "uf").alias("location"),
        "area_ha", "profile", "status", "temporal_context", body.alias("recommendation"), audit.alias("audit"),
    )

