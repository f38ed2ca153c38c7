import math

import numpy as np
import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from cropgrid.config import (
    RANKING_PROFILES, ClimateSettings, ModelSettings, RiskSettings, Settings, checked_profiles,
)
from cropgrid.functions.draws import seeded_stream
from cropgrid.operators.metrics import performance_confidence
from cropgrid.plans import decision, modelling, scenarios, training
from cropgrid.plans.history import history_features, trailing_median

CODE = "5107925"


def panel(spark, *data):
    kinds = "codigo_ibge string, municipio string, uf string, cultura string, sistema_produtivo string, ano int, area_plantada_ha double, area_colhida_ha double, producao_t double, produtividade_kg_ha double, valor_producao_brl double"
    return spark.createDataFrame([(c, "M", "MT", "soja", "not_available", y, 10.0, 9.0, 30.0, v, 1.0) for c, y, v in data], kinds)


def test_history_sees_only_the_past(spark):
    got = {r["ano"]: r for r in rows(history_features(panel(spark, ("1", 2020, 100.0), ("1", 2021, 200.0), ("1", 2022, 10000.0))))}
    assert [got[y]["yield_mean_3y"] for y in (2020, 2021, 2022)] == [None, 100, 150]
    assert [got[y]["crop_presence_years"] for y in (2020, 2021, 2022)] == [0, 1, 2]
    assert got[2022]["yield_std_5y"] == pytest.approx(np.std([100, 200], ddof=1)) and got[2021]["yield_std_5y"] is None
    assert got[2022]["yield_trend_5y"] == pytest.approx(100)
    with pytest.raises(ValueError, match="lacks"):
        history_features(panel(spark, ("1", 2020, 1.0)).drop("ano"))


def test_trend_counts_years_without_yield(spark):
    data = [("1", 2015, 10.0), ("1", 2016, None), ("1", 2018, 40.0), ("1", 2019, 70.0), ("1", 2020, 1.0)]
    got = {r["ano"]: r["yield_trend_5y"] for r in rows(history_features(panel(spark, *data)))}
    x = np.array([2015, 2016, 2018, 2019.0]); y = np.array([10, np.nan, 40, 70.0])
    want = (np.nanmean(x * y) - x.mean() * np.nanmean(y)) / ((x * x).mean() - x.mean() ** 2)
    assert got[2020] == pytest.approx(want, rel=1e-5) and got[2016] is None


def test_trailing_median_needs_three(spark):
    df = panel(spark, *[("1", 2010 + i, float(v)) for i, v in enumerate([5, 0, 9, 7, 1, 3])])
    got = [r["m"] for r in rows(df.withColumn("m", trailing_median()).orderBy("ano"))]
    assert got == [None, None, None, 5.0, 6.0, 5.0]


def climate(spark, *data):
    base = {c: 1.0 for c in training.CLIMATE_FEATURES}
    return spark.createDataFrame([base | dict(codigo_ibge=c, season_year=y, rain_crop_cycle_mm=r) for c, y, r in data])


def places(spark, *codes):
    return spark.createDataFrame([(c, "M", "MT", -10.0, -50.0) for c in codes], "codigo_ibge string, municipio string, uf string, latitude_centroid double, longitude_centroid double")


def two_places(spark):
    data = [(c, y, base + 100.0 * (y - 2020)) for c, base in (("1", 1000.0), ("2", 2000.0)) for y in range(2020, 2024)]
    weather = climate(spark, *[(c, y, 500.0 + y) for c in ("1", "2") for y in (2021, 2022, 2023)])
    return panel(spark, *data), weather, places(spark, "1", "2")


def test_training_frame(spark):
    history, weather, where = two_places(spark)
    frame = training.training_frame(history_features(history), weather, where, start_year=2023, end_year=2023)
    got = {r["codigo_ibge"]: r for r in rows(frame)}
    assert got["1"]["baseline_regional_median_lag1"] == 1700 and got["1"]["baseline_municipal_median_5y"] == 1100
    assert got["1"]["climate_reference_season"] == 2022 and got["1"]["climate_lag1_rain_crop_cycle_mm"] == 2522
    assert got["1"]["climate_data_nature"] == "interpolated"
    assert set(training.MODEL_FEATURES) <= set(frame.columns) and len(training.MODEL_FEATURES) == 29


def test_inference_frame(spark):
    history, weather, where = two_places(spark)
    got = {r["codigo_ibge"]: r for r in rows(training.inference_frame(history.where("ano < 2023"), weather, where))}
    assert got["1"]["ano"] == 2023 and got["1"]["yield_mean_5y"] == 1100 and got["1"]["baseline_municipal_median_5y"] == 1100
    assert got["1"]["baseline_regional_median_lag1"] == 1700 and got["1"]["climate_reference_season"] == 2022
    assert got["1"]["produtividade_kg_ha"] is None
    late = history.union(panel(spark, ("2", 2024, None)))
    assert {r["codigo_ibge"] for r in rows(training.inference_frame(late, weather, where))} == {"1"}


def test_economics(spark):
    lit = lambda v: F.lit(v).cast("double")
    out = decision.economics(lit(4000), lit(2), lit(4500), lit(5000), lit(10), lit(130))
    row = one(spark.range(1).select(*[c.alias(k) for k, c in out.items()]))
    assert (row["revenue_brl_ha"], row["operating_margin_brl_ha"], row["economic_profit_brl_ha"], row["roi"]) == (8000, 3500, 3000, 0.6)
    assert (row["break_even_price_brl_kg"], row["break_even_yield_kg_ha"]) == (1.25, 2500)
    assert (row["revenue_total_brl"], row["profit_total_brl"], row["capital_required_brl"]) == (80_000, 30_000, 50_000)
    assert row["profit_per_month_brl"] == pytest.approx(30_000 / (130 / 30.4375))


def _simulate(seed, n, y, p, c):
    rng = np.random.default_rng(seed)
    draw = lambda r: np.full(n, r[0]) if r[0] == r[2] else rng.triangular(*r, size=n)
    return draw(y) * draw(p) - draw(c)


@pytest.mark.parametrize("y, p, c", [
    ((3000.0, 4000.0, 4500.0), (1.5, 2.0, 2.2), (4500.0, 5000.0, 5500.0)),
    ((3000.0, 3000.0, 3000.0), (1.5, 2.0, 2.2), (4500.0, 5000.0, 5500.0)),
    ((3000.0, 3000.0, 4000.0), (2.0, 2.0, 2.0), (4500.0, 5000.0, 5500.0)),
])
def test_risk_equals_seeded_simulation(spark, y, p, c):
    df = spark.createDataFrame([(*y, *p, c[1])], "yield_p10 double, yield_p50 double, yield_p90 double, price_p20 double, price_p50 double, price_p80 double, cost_total double")
    ranges = decision.scenario_ranges() | {"cost": tuple(F.lit(v) for v in c)}
    row = one(decision.profit_risk(df, seeded_stream(20_260_820, 10_000), 10_000, ranges=ranges))
    profit = _simulate(20_260_820, 10_000, y, p, c)
    want = [(profit > 0).mean(), (profit < 0).mean(), *np.quantile(profit, [0.1, 0.5, 0.9]), profit.mean(), np.minimum(profit, 0).mean()]
    assert [row[f] for f in decision.RISK_FIELDS] == pytest.approx(want, rel=1e-12)
    assert row["profit_p10_brl_ha"] <= row["profit_p50_brl_ha"] <= row["profit_p90_brl_ha"]


def test_min_max_and_score(spark):
    df = spark.createDataFrame([("a", 10.0), ("a", 20.0), ("a", 30.0), ("b", 5.0), ("b", 5.0)], "k string, v double")
    got = sorted((r["k"], r["normalised"]) for r in rows(decision.min_max(df, "v", keys=["k"])))
    assert got == [("a", 0), ("a", 50), ("a", 100), ("b", 50), ("b", 50)]
    weights = RANKING_PROFILES["balanced"]
    parts = {"return": 80.0, "risk": 70.0, "agronomic": 100.0, "speed": 80.0, "confidence": 90.0}
    row = spark.range(1).select(*[F.lit(v).alias(f"component_{k}") for k, v in parts.items()], *[F.lit(v).alias(f"w_{k}") for k, v in weights.items()])
    assert one(row.select(decision.weighted_score().alias("s")))["s"] == pytest.approx(81.0)
    assert weights["return"] == 0.45 and all(abs(sum(w.values()) - 1) < 1e-9 for w in checked_profiles().values())


def test_settings_reject_nonsense():
    for bad in (lambda: ClimateSettings(end_year=2000), lambda: ModelSettings(temporal_test_start_year=2019), lambda: RiskSettings(simulations=5),
                lambda: ModelSettings(geographic_holdout_fraction=0.6), lambda: checked_profiles({"x": {"return": 1.0}})):
        with pytest.raises(ValueError):
            bad()
    assert performance_confidence(0.9, 0.75, 0.8) == pytest.approx(0.7) and performance_confidence(2.0, 0.1, 0.8) == 0.4


COSTS = "codigo_ibge_fonte long, uf string, municipio_fonte string, ano int, mes int, custo_variavel_brl_ha double, custo_operacional_brl_ha double, custo_total_brl_ha double"
PRICES = "coverage_level string, codigo_ibge_fonte long, uf string, ano int, mes int, nivel_comercializacao string, preco_brl_kg double"


def test_cost_falls_back_to_the_state(spark):
    costs = spark.createDataFrame([(5100001, "MT", "A", 2025, 12, 100.0, 120.0, 150.0), (5100001, "MT", "A", 2024, 1, 1.0, 1.0, 1.0),
                                   (5100002, "MT", "B", 2026, 1, 200.0, 220.0, 250.0)], COSTS)
    got = {r["codigo_ibge"]: r for r in rows(scenarios.cost_scenarios(costs, places(spark, CODE, "5100001")))}
    assert got[CODE]["cost_total"] == 200 and got[CODE]["cost_confidence"] == 0.65 and got[CODE]["cost_type"] == "estimated"
    assert got[CODE]["cost_reference_periods"] == ["2025-12", "2026-01"] and got[CODE]["cost_reference_period"] == "2025-12/2026-01"
    assert got["5100001"]["cost_total"] == 150 and got["5100001"]["cost_type"] == "observed" and got["5100001"]["cost_reference_period"] == "2025-12"


def test_price_window_and_level(spark):
    prices = spark.createDataFrame([("municipality", 5107925, "MT", 2025, 12, "PRODUTOR", 2.0), ("municipality", 5107925, "MT", 2026, 1, "PRODUTOR", 2.1),
                                    ("municipality", 5107925, "MT", 2024, 12, "PRODUTOR", 9.0), ("municipality", 5107925, "MT", 2026, 2, "ATACADO", 9.0),
                                    ("state", None, "MT", 2025, 1, "ATACADO", 3.0)], PRICES)
    got = {r["codigo_ibge"]: r for r in rows(scenarios.price_scenarios(prices, places(spark, CODE, "1")))}
    assert got[CODE]["price_reference_period"] == "2025-12/2026-01" and got[CODE]["price_p50"] == pytest.approx(2.05)
    assert got[CODE]["price_confidence"] == pytest.approx(2 / 12)
    assert got["1"]["price_coverage_level"] == "state" and got["1"]["price_confidence"] == pytest.approx(0.475)


CLIMATE = "codigo_ibge string, season_year int, rain_crop_cycle_mm double, mean_temp_c double, season_coverage double, distance_to_station_km double, distance_to_grid_km double, source string, data_nature string, method string"


@pytest.mark.parametrize("rain, coverage, status", [
    (1500.0, 1.0, "available"), (None, 1.0, "not_available"), (1500.0, 0.5, "not_available"), (1500.0, 1.01, "not_available"),
    (1500.0, math.inf, "not_available"), (1500.0, math.nan, "not_available"), (math.nan, 1.0, "not_available")])
def test_reanalysis_availability(spark, rain, coverage, status):
    df = spark.createDataFrame([(CODE, 2024, rain, 25.0, coverage, None, 5.0, "Copernicus CDS ERA5-Land", "estimated", "grid")], CLIMATE)
    row = one(scenarios.climate_scenarios(df))
    assert row["climate_status"] == status and row["climate_confidence"] == (0.75 if status == "available" else 0)
    assert row["station_code"] is None and row["distance_to_grid_km"] == 5.0


def minimum(spark):
    zoning = spark.createDataFrame(
        [(CODE, 2026, 2027, "eligible", "MAPA ZARC", None, 20, [27, 28, 29], [20], [11], ["Port. 1"], 3),
         ("5100001", 2026, 2027, "not_eligible", "MAPA ZARC", "absence", None, None, None, None, None, None)],
        "codigo_ibge string, safra_inicio int, safra_fim int, zarc_status string, source string, status_method string, melhor_nivel_risco int, "
        "decendios_elegiveis array<int>, ciclos_codigos array<int>, tipos_solo_codigos array<int>, portarias array<string>, combinacoes_elegiveis long")
    return dict(
        locations=places(spark, CODE, "5100001", "5100002"), panel=panel(spark, (CODE, 2022, 3000.0), (CODE, 2023, 3500.0), (CODE, 2024, 4000.0)),
        costs=spark.createDataFrame([(5107925, "MT", "SORRISO-MT", 2026, 3, 4000.0, 4800.0, 5000.0)], COSTS),
        prices=spark.createDataFrame([("municipality", 5107925, "MT", 2025, m, "PRECO RECEBIDO P/ PRODUTOR", 2.0) for m in range(1, 13)], PRICES),
        zoning=zoning)


def test_end_to_end(spark):
    inputs = decision.decision_inputs(**minimum(spark))
    out = decision.recommendations(inputs, area_ha=10.0)
    got = {r["codigo_ibge"]: r for r in rows(out.where("profile = 'balanced'"))}
    best = got[CODE]
    assert best["status"] == "recommended" and best["economic_profit_brl_ha"] == 2000 and best["cycle_days"] == 130
    assert best["alerts"] == ["TEMPORAL_MISMATCH", "MODEL_NOT_AVAILABLE", "MISSING_CLIMATE"]
    assert best["harvests_per_year"] == 2 and best["temporal_context"]["aligned_forecast"] is False
    assert best["confidence_score"] == pytest.approx(7.5 + 20 + 20 + 20) and best["confidence_label"] == "medium"
    assert got["5100001"]["status"] == "excluded" and got["5100001"]["alerts"] == ["ZARC_NOT_ELIGIBLE"] and got["5100001"]["score"] is None
    assert got["5100002"]["status"] == "unavailable" and got["5100002"]["alerts"] == ["INSUFFICIENT_HISTORY"]
    assert out.count() == 12
    stored = one(decision.analyses(out).where(f"location.codigo_ibge = '{CODE}' and profile = 'balanced'"))
    assert len(stored["analysis_id"]) == 36 and stored["audit"]["sources_used"][0] == "IBGE/PAM/SIDRA table 5457"


def test_predicted_yield_exposes_mixed_periods(spark):
    data = minimum(spark)
    weather = spark.createDataFrame([(CODE, 2024, 1700.0, 25.0, 1.0, None, 4.0, "Copernicus CDS ERA5-Land", "estimated", "nearest land grid")], CLIMATE)
    predicted = spark.createDataFrame(
        [(CODE, 3000.0, 3500.0, 4000.0, "predicted", 2025, "2025", "fixture-v1", 0.8, 2024, ["CLIMATE_SOURCE_NOT_IN_MODEL_TRAINING"])],
        "codigo_ibge string, yield_p10 double, yield_p50 double, yield_p90 double, yield_type string, yield_target_year int, "
        "yield_reference_period string, model_version string, performance_confidence double, climate_season int, yield_alerts array<string>")
    inputs = decision.decision_inputs(**data, climate=weather, predicted=predicted)
    row = one(decision.recommendations(inputs, area_ha=10.0).where(f"codigo_ibge = '{CODE}' and profile = 'balanced'"))
    context = row["temporal_context"]
    assert row["climate_status"] == "available" and row["climate_origin"] == "reanalysis" and row["climate_confidence"] == 0.75
    assert row["alerts"][:2] == ["CLIMATE_SOURCE_NOT_IN_MODEL_TRAINING", "ERA5_LAND_FALLBACK"] and "MISSING_CLIMATE" not in row["alerts"]
    assert context["scenario_type"] == "hybrid_reference" and context["yield_target_year"] == 2025 and context["climate_reference_season"] == 2024
    assert (context["cost_reference_period"], context["price_reference_period"], context["zarc_season"]) == ("2026-03", "2025-01/2025-12", "2026/2027")
    assert context["mismatches"] == [decision.MISMATCH_COST, decision.MISMATCH_ZONING]


def test_model_selection_and_prediction(spark):
    rng = np.random.default_rng(1)
    data = []
    for code in range(40):
        for year in range(2019, 2025):
            x = rng.uniform(0, 1)
            data.append((f"{code:07d}", year, 1000 + 3000 * x + rng.normal(0, 20), x, 2000.0, 2500.0, 2200.0))
    df = spark.createDataFrame(data, "codigo_ibge string, ano int, produtividade_kg_ha double, rain double, baseline_municipal_median_5y double, yield_mean_5y double, baseline_regional_median_lag1 double")
    for f in training.MODEL_FEATURES:
        if f not in df.columns:
            df = df.withColumn(f, F.lit(None).cast("double"))
    df = df.withColumns({"climate_lag1_rain_crop_cycle_mm": F.col("rain"), "climate_lag1_source": F.lit("A")})
    makers = {"ridge_regression": modelling.default_candidates()["ridge_regression"]}
    settings = Settings(model=ModelSettings()).model
    out = modelling.evaluate_candidates(df, settings, makers)
    assert out.selected == "ridge_regression" and out.promoted and out.selection_score < 0.5
    assert out.intervals["calibration_rows"] == 40 and 0.4 <= out.confidence <= 0.95
    model = modelling.fit_production_model(df, out, version="v1", settings=settings, candidates=makers)
    assert model.climate_sources == ("A",) and model.radius > 0
    future = df.where("ano = 2024").withColumns({"ano": F.lit(2025), "climate_lag1_source": F.lit("ERA5 x")})
    row = predicted = rows(modelling.predicted_yields(future, model.model, radius=model.radius, version="v1", confidence=0.5, climate_sources=model.climate_sources))
    assert len(predicted) == 40 and row[0]["yield_alerts"] == ["CLIMATE_SOURCE_NOT_IN_MODEL_TRAINING"]
    assert all(r["yield_p10"] >= 0 and r["yield_p10"] <= r["yield_p50"] <= r["yield_p90"] for r in predicted)
