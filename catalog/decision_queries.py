"""Training, metrics, scenario and recommendation queries."""

from __future__ import annotations

import uuid

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from cropgrid.config import RANKING_PROFILES, ModelSettings, RiskSettings, Settings
from cropgrid.functions.draws import hashed_stream
from cropgrid.operators import metrics
from cropgrid.operators.quantiles import exact_quantiles
from cropgrid.plans import audit, decision, modelling, scenarios, training, zoning
from cropgrid.plans.history import history_features
from cropgrid.session import shared_folder

from .climate_queries import MERGED, merged
from .history_queries import CHECKSUM, COVERAGE, ELIGIBLE, HISTORY, WINDOWS, history_sql
from .sqltext import adequate, joined, n, r, rs
from .views import plain, read, view, with_views

LAG, CLIMATE = training.LAG, training.CLIMATE_FEATURES
META = training.CLIMATE_METADATA
SEED = 20_260_820
COUNTED = {"dry_days", "days_temp_gt_35", "days_temp_lt_10", "crop_presence_years", "ano", "climate_reference_season"}
TEXT = {"codigo_ibge", "municipio", "uf", "cultura", "sistema_produtivo", "climate_data_nature", "target_name", "leakage_contract"} | {
    LAG + m for m in META if m != "distance_to_grid_km"
}


def _out(c: str) -> str:
    if c in TEXT:
        return c
    return n(c) if c.removeprefix(LAG) in COUNTED else r(c)


def _training(spark, sf_dir):
    history = history_features(view(spark, sf_dir, "harvests"))
    return training.training_frame(
        history, merged(spark, sf_dir), view(spark, sf_dir, "municipalities"), start_year=1997, end_year=2001
    )


def training_frame(spark, sf_dir):
    return plain(_training(spark, sf_dir))


LAGGED = f"""
select codigo_ibge, season_year as climate_reference_season, season_year + 1 as ano,
  {", ".join(f"{c} as {LAG}{c}" for c in [*CLIMATE, *META])} from merged"""
_PANEL = [
    "codigo_ibge", "municipio", "uf", "cultura", "sistema_produtivo", "ano", "area_plantada_ha", "area_colhida_ha",
    "producao_t", "produtividade_kg_ha", "valor_producao_brl",
]
FRAME = f"""
select {", ".join("t." + c for c in _PANEL + HISTORY)}, case when c5 >= 3 then m5 end as baseline_municipal_median_5y,
  g.baseline_regional_median_lag1, k.climate_reference_season, {", ".join(f"k.{LAG}{c}" for c in [*CLIMATE, *META])},
  l.latitude_centroid, l.longitude_centroid, 'produtividade_kg_ha' as target_name,
  'all features available before target harvest year' as leakage_contract,
  case when k.{LAG}rain_crop_cycle_mm is not null then k.{LAG}data_nature else 'not_available' end as climate_data_nature
from (select *, quantile_cont(produtividade_kg_ha, 0.5) over w as m5, count(produtividade_kg_ha) over w as c5 from h
    window w as (partition by codigo_ibge order by ano rows between 5 preceding and 1 preceding)) t
left join (select uf, ano + 1 as ano, median(produtividade_kg_ha) as baseline_regional_median_lag1 from harvests
  where produtividade_kg_ha is not null group by 1, 2) g on g.uf = t.uf and g.ano = t.ano
left join lagged k on k.codigo_ibge = t.codigo_ibge and k.ano = t.ano
left join municipalities l on l.codigo_ibge = t.codigo_ibge
where t.ano between 1997 and 2001 and t.produtividade_kg_ha > 0"""
FRAME_COLUMNS = [
    *_PANEL, *HISTORY, "baseline_municipal_median_5y", "baseline_regional_median_lag1", "climate_reference_season",
    *[LAG + c for c in [*CLIMATE, *META]], "latitude_centroid", "longitude_centroid", "target_name", "leakage_contract",
    "climate_data_nature",
]
FRAME_VIEWS = dict(h=history_sql("harvests"), merged=MERGED, lagged=LAGGED, frame=FRAME)
FRAME_SQL = with_views(f"select {', '.join(_out(c) for c in FRAME_COLUMNS)} from frame", **FRAME_VIEWS)


def inference_frame(spark, sf_dir):
    out = training.inference_frame(
        view(spark, sf_dir, "harvests"), merged(spark, sf_dir), view(spark, sf_dir, "municipalities")
    )
    return plain(out)


FUTURE = """
select codigo_ibge, municipio, uf, cultura, sistema_produtivo, target as ano, null::double as area_plantada_ha,
  null::double as area_colhida_ha, null::double as producao_t, null::double as produtividade_kg_ha,
  null::double as valor_producao_brl, true as future
from (select codigo_ibge, max(municipio) as municipio, max(uf) as uf, max(cultura) as cultura, max(sistema_produtivo) as sistema_produtivo,
  max(ano) as last, max(ano) filter (where produtividade_kg_ha is not null) + 1 as target from harvests group by 1) where target > last"""
EXTENDED = "select *, false as future from harvests union all select * from future"
RECENT = """
select codigo_ibge, case when count(*) >= 3 then median(produtividade_kg_ha) end as m from (
  select *, row_number() over (partition by codigo_ibge order by ano desc) as b from harvests where produtividade_kg_ha > 0)
where b <= 5 group by 1"""
INFERENCE = f"""
select {", ".join("t." + c for c in _PANEL + HISTORY)}, m as baseline_municipal_median_5y, g.baseline_regional_median_lag1,
  k.climate_reference_season, {", ".join(f"k.{LAG}{c}" for c in [*CLIMATE, *META])}, l.latitude_centroid, l.longitude_centroid
from h t left join recent x on x.codigo_ibge = t.codigo_ibge
left join (select uf, ano + 1 as ano, median(produtividade_kg_ha) as baseline_regional_median_lag1 from harvests
  where produtividade_kg_ha > 0 group by 1, 2) g on g.uf = t.uf and g.ano = t.ano
left join lagged k on k.codigo_ibge = t.codigo_ibge and k.ano = t.ano
join municipalities l on l.codigo_ibge = t.codigo_ibge where t.future"""
INFERENCE_COLUMNS = [c for c in FRAME_COLUMNS if c not in ("target_name", "leakage_contract", "climate_data_nature")]
INFERENCE_SQL = with_views(
    f"select {', '.join(_out(c) for c in INFERENCE_COLUMNS)} from inference",
    future=FUTURE, extended=EXTENDED, h=history_sql("extended"), merged=MERGED, lagged=LAGGED, recent=RECENT, inference=INFERENCE,
)


def dataset_report(spark, sf_dir):
    return plain(training.dataset_report(_training(spark, sf_dir)))


_t = "produtividade_kg_ha"
REPORT_SQL = with_views(f"""
select count(*) as rows, {n('min(ano)', 'year_min')}, {n('max(ano)', 'year_max')}, count(distinct codigo_ibge) as municipalities,
  count(distinct uf) as ufs, {r(f'min({_t})', 'target_min')}, {r(f'max({_t})', 'target_max')}, {r(f'avg({_t})', 'target_mean')},
  {r(f'quantile_cont({_t}, 0.1)', 'target_p10')}, {r(f'median({_t})', 'target_median')}, {r(f'quantile_cont({_t}, 0.9)', 'target_p90')}
from frame""", **FRAME_VIEWS)


def feature_gaps(spark, sf_dir):
    return plain(training.feature_gaps(_training(spark, sf_dir)))


GAPS_SQL = with_views(" union all ".join(
    f"select '{c}' as column_name, count(*) filter (where {c} is null) as missing from frame" for c in training.MODEL_FEATURES
), **FRAME_VIEWS)


def climate_mix(spark, sf_dir):
    return plain(training.climate_mix(_training(spark, sf_dir)))


MIX_SQL = with_views(f"select {LAG}source, climate_data_nature, count(*) as rows from frame group by 1, 2", **FRAME_VIEWS)


def regression_metrics(spark, sf_dir):
    return plain(metrics.regression_metrics(_training(spark, sf_dir), metrics.BASELINES, keys=["ano"]))


def _metric(p: str, name: str, source: str, keys: str, ok: str) -> str:
    return f"""
    select {keys}, '{name}' as predictor, max(total) as total_rows, count(*) filter (where ok) as rows,
      avg(abs(p - y)) filter (where ok) as mae, sqrt(avg(pow(p - y, 2)) filter (where ok)) as rmse,
      100 * avg(case when abs(y) + abs(p) > 1e-9 then 2 * abs(p - y) / (abs(y) + abs(p)) else 0 end) filter (where ok) as smape_pct,
      case when count(*) filter (where ok) = 1 then 'nan'::double when var_pop(y) filter (where ok) > 0
        then 1 - (avg(pow(p - y, 2)) filter (where ok)) / (var_pop(y) filter (where ok)) end as r2
    from (select *, {_t} as y, {p} as p, {ok} as ok, count(*) over (partition by {keys}) as total from {source}) group by {keys}"""


_pairs = {name: c for name, c in metrics.BASELINES.items()}
METRICS_SQL = with_views(
    f"select {n('ano')}, predictor, total_rows, rows, {rs('mae', 'rmse', 'smape_pct', 'r2')} from long",
    **FRAME_VIEWS,
    long=" union all ".join(_metric(c, name, "frame", "ano", f"{c} is not null") for name, c in _pairs.items()),
)
# A stand-in prediction that needs no fitting: the mean of two baselines.
BLEND = "(baseline_regional_median_lag1 + yield_mean_5y) / 2"


def metrics_by_source(spark, sf_dir):
    frame = _training(spark, sf_dir).withColumn("blend", F.expr(BLEND))
    return plain(metrics.metrics_by_source(frame, "blend"))


_common = " and ".join(f"{c} is not null" for c in _pairs.values())
SOURCE_METRICS = " union all ".join(
    _metric(c, name, f"(select *, coalesce({LAG}source, 'unknown') as source from frame)", "source", _common)
    for name, c in {"model": BLEND, **_pairs}.items()
)
BY_SOURCE_SQL = with_views(f"""
select m.source, m.total_rows, m.rows as evaluated_rows, m.total_rows - m.rows as excluded_rows,
  case when m.rows > 0 then 'evaluated' else 'no_common_finite_rows' end as status,
  {", ".join(r(f'm.{c}', f'model_{c}') for c in ('mae', 'rmse', 'smape_pct', 'r2'))},
  b.predictor as best_baseline, {r('b.mae', 'best_baseline_mae')}, m.mae < b.mae as beats_best_baseline
from long m left join (select * from long where predictor <> 'model' and rows > 0
  qualify row_number() over (partition by source order by mae) = 1) b on b.source = m.source
where m.predictor = 'model'""", **FRAME_VIEWS, long=SOURCE_METRICS)


def selection_scores(spark, sf_dir):
    """Two blends as candidates against the baselines on both splits."""
    frame = _training(spark, sf_dir).withColumns(
        {"blend": F.expr(BLEND), "low": F.col("yield_mean_3y") * 0.95}
    )
    marked = metrics.with_splits(frame, seed=SEED, fraction=0.2, test_start_year=2000)
    names = {"blend": "blend", "low": "low", **metrics.BASELINES}
    both = [
        metrics.regression_metrics(marked.where(f"{s}_test"), names).withColumn("split", F.lit(s))
        for s in ("temporal", "geographic")
    ]
    return plain(metrics.selection_scores(both[0].unionByName(both[1]).select("split", "predictor", "mae"), ["blend", "low"]))


_share = f"cast(cast('0x' || substr(sha256('{SEED}:' || codigo_ibge), 1, 16) as ubigint) as double) / 18446744073709551616.0"
_tests = {"temporal": "ano >= 2000", "geographic": f"{_share} < 0.2"}
_names = {"blend": BLEND, "low": "yield_mean_3y * 0.95", **_pairs}
SPLITS = " union all ".join(
    f"select '{s}' as split, '{name}' as predictor, avg(abs({c} - {_t})) as mae from frame where {test}"
    for s, test in _tests.items() for name, c in _names.items()
)
SELECTION_SQL = with_views(f"""
select c.predictor, max(b.predictor) filter (where c.split = 'temporal') as temporal_best_baseline,
  max(b.predictor) filter (where c.split = 'geographic') as geographic_best_baseline,
  {r("max(c.mae / b.mae) filter (where c.split = 'temporal')", 'temporal_mae_ratio')},
  {r("max(c.mae / b.mae) filter (where c.split = 'geographic')", 'geographic_mae_ratio')}, {r('avg(c.mae / b.mae)', 'selection_score')},
  max(c.mae / b.mae) < 1 as beats_baseline
from splits c join (select * from splits where predictor not in ('blend', 'low')
  qualify row_number() over (partition by split order by mae) = 1) b on b.split = c.split
where c.predictor in ('blend', 'low') group by c.predictor""", **FRAME_VIEWS, splits=SPLITS)


def conformal_radius(spark, sf_dir):
    return plain(metrics.conformal_radius(_training(spark, sf_dir), "yield_mean_5y", 0.8, keys=["uf"]))


RESIDUALS = f"select uf, ano, yield_mean_5y as p, {_t} as y, abs({_t} - yield_mean_5y) as a from frame where yield_mean_5y is not null"
_pick = "cast(ceil(round((n - 1) * least(1.0, ceil((n + 1) * 0.8) / n), 9)) as bigint) + 1"
RADIUS_SQL = with_views(f"""
select uf, {r('a', 'radius')}, n as calibration_rows from (
  select *, row_number() over (partition by uf order by a) as rn, count(*) over (partition by uf) as n from residuals) where rn = {_pick}
""", **FRAME_VIEWS, residuals=RESIDUALS)


def interval_evaluation(spark, sf_dir):
    frame = _training(spark, sf_dir).where("yield_mean_5y is not null")
    return plain(metrics.evaluate_intervals(frame, "yield_mean_5y", calibration_year=1999, coverage=0.8))


INTERVAL_SQL = with_views(f"""
with c as (select a, n from (select *, row_number() over (order by a) as rn, count(*) over () as n from residuals where ano = 1999) where rn = {_pick})
select 0.8::double as nominal_coverage, 1999::bigint as calibration_year, max(n) as calibration_rows, count(*) as evaluation_rows,
  {r('max(c.a)', 'radius')}, {r('avg(cast(y between greatest(p - c.a, 0) and p + c.a as int))', 'empirical_coverage')},
  {r('avg(p + c.a - greatest(p - c.a, 0))', 'mean_interval_width')}, {r('avg(abs(p - y))', 'point_mae')},
  {r('sqrt(avg(pow(p - y, 2)))', 'point_rmse')}
from (select p, y from residuals where ano > 1999), c""".replace("\nwith c as", "\nselect * from (with c as") + ")",
    **FRAME_VIEWS, residuals=RESIDUALS)


def state_year_quantiles(spark, sf_dir):
    """Exact quantiles of line prices per return flag; each flag holds a third of all rows."""
    li = read(spark, sf_dir, "lineitem")
    return plain(exact_quantiles(
        li, ["l_returnflag"], "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, count_as="rows"
    ))


QUANTILE_SQL = f"""
select l_returnflag, {", ".join(r(f'quantile_cont(l_extendedprice, {p})', name) for name, p in (('p10', 0.1), ('p50', 0.5), ('p90', 0.9)))},
  count(*) as rows from lineitem group by 1"""


def yield_scenarios(spark, sf_dir):
    return plain(scenarios.yield_scenarios(view(spark, sf_dir, "harvests")))


YIELDS = f"""
select codigo_ibge, quantile_cont({_t}, 0.1) as yield_p10, quantile_cont({_t}, 0.5) as yield_p50, quantile_cont({_t}, 0.9) as yield_p90,
  count(*) as yield_sample_size, min(ano) || '-' || max(ano) as yield_reference_period from (
  select *, row_number() over (partition by codigo_ibge order by ano desc) as b from harvests where {_t} > 0)
where b <= 10 group by 1 having count(*) >= 3"""
YIELD_SQL = with_views(
    f"select codigo_ibge, {rs('yield_p10', 'yield_p50', 'yield_p90')}, yield_sample_size, yield_reference_period from yields", yields=YIELDS
)


def cost_scenario(spark, sf_dir):
    return plain(scenarios.cost_scenarios(view(spark, sf_dir, "costs"), view(spark, sf_dir, "municipalities")))


_month = "format('{:d}-{:02d}', ano, mes)"
_period_range = "case when min({m}) = max({m}) then min({m}) else min({m}) || '/' || max({m}) end".format(m=_month)


def _cost_facts(kind: str, source: str, key: str) -> str:
    observed = kind == "observed"
    return f"""
    select {key} as place, median(custo_variavel_brl_ha) as cost_variable, median(custo_operacional_brl_ha) as cost_operational,
      median(custo_total_brl_ha) as cost_total, '{kind}' as cost_type,
      {"null" if observed else "'mediana dos valores mais recentes dos polos Conab na mesma UF'"} as cost_method,
      {"1.0" if observed else "case when count(*) > 1 then 0.65 else 0.55 end"} as cost_confidence,
      {_period_range} as cost_reference_period,
      {joined(f'list_sort(list_distinct(list({_month})))', 'cost_reference_periods')}, count(*) as cost_source_rows from ({source}) group by 1"""


_own_rows = (
    "select *, lpad(cast(codigo_ibge_fonte as varchar), 7, '0') as code from costs "
    "qualify ano * 12 + mes = max(ano * 12 + mes) over (partition by codigo_ibge_fonte)"
)
_pole_rows = (
    "select * from costs qualify row_number() over (partition by uf, codigo_ibge_fonte order by ano * 12 + mes desc, "
    "sistema_produtivo desc, custo_variavel_brl_ha desc) = 1"
)
COST_HERE = _cost_facts("observed", _own_rows, "code")
COST_STATE = _cost_facts("estimated", _pole_rows, "uf")
_COST = ["cost_variable", "cost_operational", "cost_total", "cost_type", "cost_method", "cost_confidence",
         "cost_reference_period", "cost_reference_periods", "cost_source_rows"]
_either = lambda columns: ", ".join(f"case when x.place is not null then x.{c} else y.{c} end as {c}" for c in columns)
COST = f"""
select m.codigo_ibge, {_either(_COST)} from municipalities m left join cost_here x on x.place = m.codigo_ibge
left join cost_state y on y.place = m.uf where x.place is not null or y.place is not null"""
COST_VIEWS = dict(cost_here=COST_HERE, cost_state=COST_STATE, cost=COST)
COST_SQL = with_views(
    f"select codigo_ibge, {rs(*_COST[:3])}, cost_type, cost_method, cost_confidence::double as cost_confidence, {', '.join(_COST[6:])} from cost",
    **COST_VIEWS,
)


def cost_sources(spark, sf_dir):
    return plain(scenarios.cost_sources(view(spark, sf_dir, "costs")))


COST_SOURCES_SQL = with_views(f"""
select distinct 'municipality' as scope, code as place, municipio_fonte from ({_own_rows})
union all select distinct 'state', uf, municipio_fonte from ({_pole_rows})""")


def price_scenario(spark, sf_dir):
    return plain(scenarios.price_scenarios(view(spark, sf_dir, "prices"), view(spark, sf_dir, "municipalities")))


PRICE_FACTS = f"""
select coverage_level as scope, place, quantile_cont(preco_brl_kg, 0.2) as price_p20, quantile_cont(preco_brl_kg, 0.5) as price_p50,
  quantile_cont(preco_brl_kg, 0.8) as price_p80, count(*) as price_sample_size,
  {joined('list_sort(list_distinct(list(nivel_comercializacao)))', 'price_market_levels')},
  case when coverage_level = 'state' then 'estimated' else 'observed' end as price_type,
  case when coverage_level = 'state' then 'quantis da serie mensal estadual Conab como fallback municipal' end as price_method,
  case when coverage_level = 'state' then least(0.75, 0.45 + count(*) / 40) else least(1.0, count(*) / 12) end as price_confidence,
  coverage_level as price_coverage_level, min({_month}) || '/' || max({_month}) as price_reference_period
from (select * from (
    select *, max(own) over (partition by coverage_level, place) as has from (
      select *, case when coverage_level = 'state' then uf else lpad(cast(codigo_ibge_fonte as varchar), 7, '0') end as place,
        contains(nivel_comercializacao, 'PRODUTOR') as own, ano * 12 + mes as period from prices)) where own or not has
  qualify period >= max(period) over (partition by coverage_level, place) - 11) group by 1, 2"""
_PRICE = ["price_p20", "price_p50", "price_p80", "price_sample_size", "price_market_levels", "price_type", "price_method",
          "price_confidence", "price_coverage_level", "price_reference_period"]
PRICE = f"""
select m.codigo_ibge, {_either(_PRICE)} from municipalities m
left join (select * from price_facts where scope = 'municipality') x on x.place = m.codigo_ibge
left join (select * from price_facts where scope = 'state') y on y.place = m.uf where x.place is not null or y.place is not null"""
PRICE_VIEWS = dict(price_facts=PRICE_FACTS, price=PRICE)
PRICE_SQL = with_views(
    f"select codigo_ibge, {rs(*_PRICE[:3])}, {', '.join(_PRICE[3:7])}, {r('price_confidence')}, {', '.join(_PRICE[8:])} from price",
    **PRICE_VIEWS,
)


def climate_scenario(spark, sf_dir):
    return plain(scenarios.climate_scenarios(merged(spark, sf_dir)))


_q = "case when contains(source, 'ERA5') then 0.75 when distance_to_station_km between 0 and 250 then greatest(0.5, 1 - distance_to_station_km / 250) else 0 end"
CLIMATE_NOW = f"""
select codigo_ibge, case when ok then 'available' else 'not_available' end as climate_status, data_nature as climate_type,
  method as climate_method, source as climate_source, season_year as climate_reference_season,
  case when contains(source, 'ERA5') then 'reanalysis' else 'station' end as climate_origin, station_code, station_name,
  distance_to_station_km, distance_to_grid_km, season_coverage, rain_crop_cycle_mm, dry_days, mean_temp_c, days_temp_gt_35,
  quality_flag as climate_quality_flag, case when ok then least(1.0, season_coverage * q) else 0 end as climate_confidence,
  case when ok and contains(source, 'ERA5') then 'ERA5_LAND_FALLBACK' else '' end as climate_alerts
from (select *, {_q} as q, {adequate()} and {_q} > 0 as ok from merged
  qualify row_number() over (partition by codigo_ibge order by season_year desc) = 1)"""
_CT = ["climate_status", "climate_type", "climate_method", "climate_source", "climate_origin", "station_code", "station_name",
       "climate_quality_flag", "climate_alerts"]
_CN = ["distance_to_station_km", "distance_to_grid_km", "season_coverage", "rain_crop_cycle_mm", "mean_temp_c", "climate_confidence"]
CLIMATE_SQL = with_views(
    f"select codigo_ibge, {', '.join(_CT)}, {rs(*_CN)}, {n('climate_reference_season')}, {n('dry_days')}, {n('days_temp_gt_35')} from climate_now",
    merged=MERGED, climate_now=CLIMATE_NOW,
)

DRAWS = RiskSettings().simulations
SETTINGS = Settings(risk=RiskSettings(simulations=DRAWS, seed=SEED))


def risk_distribution(spark, sf_dir):
    """Profit distribution per municipality from shared draws, as many as configured."""
    base = scenarios.yield_scenarios(view(spark, sf_dir, "harvests"))
    places = view(spark, sf_dir, "municipalities")
    rows = base.join(scenarios.cost_scenarios(view(spark, sf_dir, "costs"), places).select("codigo_ibge", "cost_total"), "codigo_ibge").join(
        scenarios.price_scenarios(view(spark, sf_dir, "prices"), places).select("codigo_ibge", "price_p20", "price_p50", "price_p80"), "codigo_ibge"
    )
    out = decision.profit_risk(rows, hashed_stream(SEED, DRAWS), DRAWS, ranges=decision.scenario_ranges())
    return plain(out.select("codigo_ibge", *RISK))


RISK = ["probability_profit", "probability_loss", "profit_p10_brl_ha", "profit_p50_brl_ha", "profit_p90_brl_ha",
        "expected_profit_brl_ha", "expected_downside_brl_ha"]
STREAM = f"select k, cast(cast('0x' || substr(md5('{SEED}:' || k), 1, 13) as bigint) as double) / 4503599627370496.0 as u from (select unnest(range(0, {3 * DRAWS})) as k)"


def _triangle(u: str, low: str, mode: str, high: str) -> str:
    return (
        f"case when {high} = {low} then {low} when {u} <= ({mode} - {low}) / ({high} - {low}) "
        f"then {low} + sqrt({u} * ({mode} - {low}) * ({high} - {low})) else {high} - sqrt((1 - {u}) * ({high} - {mode}) * ({high} - {low})) end"
    )


DRAWN = f"""
select codigo_ibge, {_triangle('a.u', 'yield_p10', 'yield_p50', 'yield_p90')} * ({_triangle('b.u', 'price_p20', 'price_p50', 'price_p80')})
  - ({_triangle('c.u', 'cost_total * 0.9', 'cost_total', 'cost_total * 1.1')}) as profit
from (select *, case when yield_p10 < yield_p90 then {DRAWS} else 0 end as o1,
    case when yield_p10 < yield_p90 then {DRAWS} else 0 end + case when price_p20 < price_p80 then {DRAWS} else 0 end as o2
  from yields join cost using (codigo_ibge) join price using (codigo_ibge)) s
join stream a on a.k < {DRAWS} join stream b on b.k = a.k + s.o1 join stream c on c.k = a.k + s.o2"""
RISKS = """
select codigo_ibge, avg(cast(profit > 0 as int)) as probability_profit, avg(cast(profit < 0 as int)) as probability_loss,
  quantile_cont(profit, 0.1) as profit_p10_brl_ha, quantile_cont(profit, 0.5) as profit_p50_brl_ha, quantile_cont(profit, 0.9) as profit_p90_brl_ha,
  avg(profit) as expected_profit_brl_ha, avg(least(profit, 0)) as expected_downside_brl_ha from drawn group by 1"""
RISK_VIEWS = dict(yields=YIELDS, **COST_VIEWS, **PRICE_VIEWS, stream=STREAM, drawn=DRAWN, risks=RISKS)
RISK_SQL = with_views(f"select codigo_ibge, {rs(*RISK)} from risks", **RISK_VIEWS)


def _coverage(spark, sf_dir):
    windows = zoning.planting_windows(view(spark, sf_dir, "zoning_wide"), source_checksum=CHECKSUM)
    return zoning.zoning_coverage(windows, view(spark, sf_dir, "municipalities"))


def _recommended(spark, sf_dir):
    inputs = decision.decision_inputs(
        view(spark, sf_dir, "municipalities"), view(spark, sf_dir, "harvests"), view(spark, sf_dir, "costs"),
        view(spark, sf_dir, "prices"), zoning=_coverage(spark, sf_dir), climate=merged(spark, sf_dir), settings=SETTINGS,
    )
    return decision.recommendations(
        inputs, stream=hashed_stream(SEED, DRAWS), settings=SETTINGS, area_ha=500.0
    )


MONEY = ["revenue_brl_ha", "operating_margin_brl_ha", "economic_profit_brl_ha", "roi", "break_even_price_brl_kg", "break_even_yield_kg_ha",
         "revenue_total_brl", "profit_total_brl", "capital_required_brl", "profit_per_month_brl"]
PARTS = ["return", "risk", "agronomic", "speed", "confidence"]


def recommendations(spark, sf_dir):
    """Every municipality under every profile: status, economics, risk, score, confidence, alerts."""
    out = _recommended(spark, sf_dir)
    return plain(out.select(
        "codigo_ibge", "profile", "status", *MONEY, *RISK, *[f"component_{c}" for c in PARTS], "confidence_score",
        "confidence_label", "score", "alerts", F.col("temporal_context.scenario_type").alias("scenario_type"),
        F.col("temporal_context.mismatches").alias("mismatches"),
    ), 3)


_clamp = lambda x: f"least(greatest({x}, 0), 100)"
DECIDED = f"""
select *, least(yield_sample_size / 10, 1.0) * 25 + coalesce(climate_confidence, 0) * 15 + cost_confidence * 20 + price_confidence * 20
    + case when zarc_status = 'eligible' then 20 else 0 end as confidence_raw,
  yield_p50 * price_p50 as revenue_brl_ha
from (select m.codigo_ibge, y.* exclude (codigo_ibge), c.* exclude (codigo_ibge), p.* exclude (codigo_ibge), k.* exclude (codigo_ibge),
    z.* exclude (codigo_ibge), g.* exclude (codigo_ibge),
    case when z.zarc_status = 'not_eligible' then 'excluded'
      when y.codigo_ibge is null or c.codigo_ibge is null or p.codigo_ibge is null then 'unavailable' else 'recommended' end as status,
    case when z.zarc_status = 'not_eligible' then 'ZARC_NOT_ELIGIBLE' when y.codigo_ibge is null then 'INSUFFICIENT_HISTORY'
      when c.codigo_ibge is null then 'MISSING_COST_COVERAGE' when p.codigo_ibge is null then 'MISSING_PRICE_COVERAGE' end as why
  from municipalities m left join yields y using (codigo_ibge) left join cost c using (codigo_ibge) left join price p using (codigo_ibge)
  left join risks k using (codigo_ibge) left join climate_now g using (codigo_ibge)
  left join (select codigo_ibge, zarc_status, melhor_nivel_risco from coverage) z using (codigo_ibge))"""
_money = {
    "revenue_brl_ha": "revenue_brl_ha", "operating_margin_brl_ha": "revenue_brl_ha - cost_operational",
    "economic_profit_brl_ha": "revenue_brl_ha - cost_total", "roi": "(revenue_brl_ha - cost_total) / cost_total",
    "break_even_price_brl_kg": "cost_total / yield_p50", "break_even_yield_kg_ha": "cost_total / price_p50",
    "revenue_total_brl": "revenue_brl_ha * 500", "profit_total_brl": "(revenue_brl_ha - cost_total) * 500",
    "capital_required_brl": "cost_total * 500",
    "profit_per_month_brl": "(revenue_brl_ha - cost_total) * 500 / (130 / (365.25 / 12))",
}
SCORED = f"""
select codigo_ibge, status, why, {", ".join(f"case when status = 'recommended' then {e} end as {c}_" for c, e in _money.items())},
  {", ".join(f"case when status = 'recommended' then {c} end as {c}" for c in RISK)},
  case when status = 'recommended' then {_clamp('((revenue_brl_ha - cost_total) / cost_total + 0.5) / 1.5 * 100')} end as component_return,
  case when status = 'recommended' then probability_profit * 100 end as component_risk,
  case when status = 'recommended' then case melhor_nivel_risco when 20 then 100.0 when 30 then 75.0 else 50.0 end end as component_agronomic,
  case when status = 'recommended' then 100 - (130 - 90) / 275 * 100 end as component_speed,
  case when status = 'recommended' then round_even(confidence_raw, 2) end as component_confidence,
  list_aggregate(list_filter(case when status <> 'recommended' then [why] else [nullif(climate_alerts, ''), 'TEMPORAL_MISMATCH', 'MODEL_NOT_AVAILABLE',
    case when coalesce(climate_status, 'not_available') = 'not_available' then 'MISSING_CLIMATE' end,
    case when climate_quality_flag = 'NO_NEARBY_INMET_STATION' then 'NO_NEARBY_INMET_STATION' end,
    case when zarc_status = 'not_available' then 'MISSING_ZARC' end, case when price_sample_size < 12 then 'LOW_PRICE_SAMPLE' end,
    case when not contains(price_market_levels, 'PRODUTOR') then 'PRICE_MARKET_LEVEL_NOT_PRODUCER' end,
    case when cost_type <> 'observed' then 'LOW_COST_DATA_CONFIDENCE' end] end, lambda x: x is not null), 'string_agg', ',') as alerts
from decided"""
_profiles = ", ".join(
    f"('{name}', {', '.join(str(float(w[c])) for c in PARTS)})" for name, w in RANKING_PROFILES.items()
)
R3 = lambda e, name: f"round({e}, 3) as {name}"
RECOMMEND_SQL = with_views(f"""
select codigo_ibge, profile, status, {", ".join(R3(f'{c}_', c) for c in MONEY)}, {", ".join(R3(c, c) for c in RISK)},
  {", ".join(R3(f'component_{c}', f'component_{c}') for c in PARTS)}, {R3('component_confidence', 'confidence_score')},
  case when component_confidence >= 80 then 'high' when component_confidence >= 55 then 'medium' when status = 'recommended' then 'low' end as confidence_label,
  round({" + ".join(f"component_{c} * w_{c}::double" for c in PARTS)}, 3) as score, alerts,
  case when status = 'recommended' then 'hybrid_reference' end as scenario_type,
  case when status = 'recommended' then 'yield uses historical quantiles without a single forecast harvest year' end as mismatches
from scored, (values {_profiles}) x(profile, {", ".join(f"w_{c}" for c in PARTS)})""",
    merged=MERGED, climate_now=CLIMATE_NOW, windows=WINDOWS, eligible=ELIGIBLE, coverage=COVERAGE, **RISK_VIEWS, decided=DECIDED, scored=SCORED)


def predicted_recommendations(spark, sf_dir):
    """Recommendations resting on predicted yields, with aligned and mixed periods exposed."""
    places, harvests = view(spark, sf_dir, "municipalities"), view(spark, sf_dir, "harvests")
    inference = training.inference_frame(harvests, merged(spark, sf_dir), places)
    predicted = modelling.predicted_yields(
        inference, None, radius=900.0, version="mean-v1", confidence=0.8, prediction="yield_mean_5y",
        climate_sources=("INMET automatic station annual archives",),
    )
    inputs = decision.decision_inputs(
        places, harvests, view(spark, sf_dir, "costs"), view(spark, sf_dir, "prices"), climate=merged(spark, sf_dir),
        predicted=predicted, settings=SETTINGS,
    )
    out = decision.recommendations(inputs, stream=hashed_stream(SEED, DRAWS), settings=SETTINGS, area_ha=10.0)
    stored = decision.analyses(out, settings=SETTINGS)
    return plain(stored.select(
        F.col("location.codigo_ibge").alias("codigo_ibge"), "profile", "status",
        F.col("recommendation.yield_type").alias("yield_type"), F.col("recommendation.score").alias("score"),
        F.col("recommendation.alerts").alias("alerts"), F.col("temporal_context.mismatches").alias("mismatches"),
        F.col("audit.sources_used").alias("sources_used"), F.length("analysis_id").alias("id_length"),
    ), 3)


PRED = f"""
select codigo_ibge, greatest(greatest(yield_mean_5y, 0) - 900, 0) as p10, greatest(yield_mean_5y, 0) as p50, greatest(yield_mean_5y, 0) + 900 as p90,
  ano as target, case when {LAG}rain_crop_cycle_mm is not null and contains({LAG}source, 'ERA5') then 'CLIMATE_SOURCE_NOT_IN_MODEL_TRAINING' end as unseen
from inference where yield_mean_5y is not null"""
MIXED_YIELDS = """
select h.codigo_ibge, coalesce(p.p10, h.yield_p10) as yield_p10, coalesce(p.p50, h.yield_p50) as yield_p50, coalesce(p.p90, h.yield_p90) as yield_p90,
  h.yield_sample_size, p.target, p.unseen from past_yields h left join pred p using (codigo_ibge)"""
_years_off = lambda c, sep: f"len(list_filter(string_split({c}, '{sep}'), lambda y: try_cast(substr(y, 1, 4) as int) <> target)) > 0"
PREDICTED_DECIDED = f"""
select *, case when p_target is not null then 'predicted' else 'estimated' end as yield_type,
  case when status = 'recommended' then [case when target is null then 'yield uses historical quantiles without a single forecast harvest year' end,
    case when target is not null and {_years_off('cost_reference_periods', ',')} then 'cost reference years differ from the yield target year' end,
    case when target is not null and {_years_off('price_reference_period', '/')} then 'price reference years differ from the yield target year' end,
    case when target is not null and climate_reference_season <> target - 1 then 'climate reference does not match the model''s prior-season contract' end] end as found,
  round_even((case when target is not null then 0.8 else least(yield_sample_size / 10, 1.0) end * 25 + coalesce(climate_confidence, 0) * 15
    + cost_confidence * 20 + price_confidence * 20) , 2) as confidence
from (select m.codigo_ibge, q.target as p_target, y.* exclude (codigo_ibge), c.* exclude (codigo_ibge), p.* exclude (codigo_ibge), k.* exclude (codigo_ibge),
    g.* exclude (codigo_ibge), case when why is null then 'recommended' else 'unavailable' end as status, why
  from (select m.codigo_ibge, case when y.codigo_ibge is null then 'INSUFFICIENT_HISTORY' when c.codigo_ibge is null then 'MISSING_COST_COVERAGE'
      when p.codigo_ibge is null then 'MISSING_PRICE_COVERAGE' when not y.yield_p50 > 0 or not p.price_p50 > 0 or not c.cost_total > 0
      or c.cost_total < c.cost_operational then 'INVALID_ECONOMICS' end as why
    from municipalities m left join yields y using (codigo_ibge) left join cost c using (codigo_ibge) left join price p using (codigo_ibge)) m
  left join pred q using (codigo_ibge) left join yields y using (codigo_ibge) left join cost c using (codigo_ibge) left join price p using (codigo_ibge)
  left join risks k using (codigo_ibge) left join asked_climate g using (codigo_ibge))"""
ASKED_CLIMATE = CLIMATE_NOW.replace("from merged\n", "from (select m.* from merged m left join pred p using (codigo_ibge) where p.target is null or m.season_year = p.target - 1)\n")
_roi = "(yield_p50 * price_p50 - cost_total) / cost_total"
_scores = {"return": _clamp(f"({_roi} + 0.5) / 1.5 * 100"), "risk": "probability_profit * 100", "agronomic": "50.0",
           "speed": "(100 - (130 - 90) / 275 * 100)", "confidence": "confidence"}
_text = lambda e: f"list_aggregate(list_filter({e}, lambda x: x is not null), 'string_agg', ',')"
PREDICTED_RECOMMEND_SQL = with_views(f"""
select codigo_ibge, profile, status, yield_type, case when status = 'recommended' then round({" + ".join(f"{_scores[c]} * w_{c}::double" for c in PARTS)}, 3) end as score,
  coalesce({_text("""case when status <> 'recommended' then [why] else [unseen, nullif(climate_alerts, ''),
    case when len(list_filter(found, lambda x: x is not null)) > 0 then 'TEMPORAL_MISMATCH' end, case when target is null then 'MODEL_NOT_AVAILABLE' end,
    case when coalesce(climate_status, 'not_available') = 'not_available' then 'MISSING_CLIMATE' end,
    case when climate_quality_flag = 'NO_NEARBY_INMET_STATION' then 'NO_NEARBY_INMET_STATION' end,
    case when target is not null and (yield_p90 - yield_p10) / greatest(yield_p50, 1) > 0.5 then 'HIGH_YIELD_UNCERTAINTY' end, 'MISSING_ZARC',
    case when price_sample_size < 12 then 'LOW_PRICE_SAMPLE' end,
    case when not contains(price_market_levels, 'PRODUTOR') then 'PRICE_MARKET_LEVEL_NOT_PRODUCER' end,
    case when cost_type <> 'observed' then 'LOW_COST_DATA_CONFIDENCE' end] end""")}, '') as alerts,
  case when status = 'recommended' then coalesce({_text('found')}, '') end as mismatches,
  coalesce({_text("""case when status = 'recommended' then [case when target is not null then 'IBGE/PAM history and lagged climate features'
    else 'IBGE/PAM/SIDRA table 5457' end, 'CONAB CustoProducao.txt', 'CONAB precos mensais', climate_source] else []::varchar[] end""")}, '') as sources_used,
  36::bigint as id_length
from chosen, (values {_profiles}) x(profile, {", ".join(f"w_{c}" for c in PARTS)})""",
    **{k: v for k, v in dict(future=FUTURE, extended=EXTENDED, h=history_sql("extended"), merged=MERGED, lagged=LAGGED, recent=RECENT, inference=INFERENCE,
                             pred=PRED, past_yields=YIELDS).items()},
    **(RISK_VIEWS | {"yields": MIXED_YIELDS}), asked_climate=ASKED_CLIMATE, chosen=PREDICTED_DECIDED)


def batch_predictions(spark, sf_dir):
    inference = training.inference_frame(
        view(spark, sf_dir, "harvests"), merged(spark, sf_dir), view(spark, sf_dir, "municipalities")
    )
    return plain(modelling.predicted_yields(
        inference, None, radius=900.0, version="mean-v1", confidence=0.8, prediction="yield_mean_5y",
        climate_sources=("INMET automatic station annual archives",),
    ))


PREDICTED_SQL = with_views(f"""
select codigo_ibge, {r('greatest(greatest(yield_mean_5y, 0) - 900, 0)', 'yield_p10')}, {r('greatest(yield_mean_5y, 0)', 'yield_p50')},
  {r('greatest(yield_mean_5y, 0) + 900', 'yield_p90')}, 'predicted' as yield_type, {n('ano', 'yield_target_year')},
  cast(ano as varchar) as yield_reference_period, 'mean-v1' as model_version, 0.8::double as performance_confidence,
  {n('ano - 1', 'climate_season')}, case when {LAG}rain_crop_cycle_mm is not null and contains({LAG}source, 'ERA5')
    then 'CLIMATE_SOURCE_NOT_IN_MODEL_TRAINING' else '' end as yield_alerts
from inference where yield_mean_5y is not null""",
    future=FUTURE, extended=EXTENDED, h=history_sql("extended"), merged=MERGED, lagged=LAGGED, recent=RECENT, inference=INFERENCE)


def min_max(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    low = decision.min_max(c, "c_acctbal", keys=["c_nationkey"], higher_is_better=False, output="cheapness")
    return plain(decision.min_max(low, "c_acctbal", output="balance"))


MINMAX_SQL = f"""
select c_custkey, {n('c_nationkey')}, {r('c_acctbal')},
  {r('100 - (c_acctbal - min(c_acctbal) over w) / (max(c_acctbal) over w - min(c_acctbal) over w) * 100', 'cheapness')},
  {r('(c_acctbal - min(c_acctbal) over ()) / (max(c_acctbal) over () - min(c_acctbal) over ()) * 100', 'balance')}
from customer window w as (partition by c_nationkey)"""


def dataset_rows(spark, sf_dir):
    names = ("municipalities", "harvests", "costs", "prices")
    return plain(audit.dataset_rows({**{v: view(spark, sf_dir, v) for v in names}, "models": None}))


ROWS_SQL = with_views(" union all ".join(
    f"select '{v}' as dataset, true as available, count(*) as rows from {v}" for v in ("municipalities", "harvests", "costs", "prices")
) + " union all select 'models', false, 0")


def market_report(spark, sf_dir):
    from cropgrid.plans.markets import market_report as report

    return plain(report(view(spark, sf_dir, "costs"), view(spark, sf_dir, "prices")))


MARKET_SQL = with_views(f"""
select * from (select count(*) as cost_rows, {n('min(ano)', 'cost_year_min')}, {n('max(ano)', 'cost_year_max')},
  count(distinct codigo_ibge_fonte) as cost_reference_municipalities, count(*) filter (where custo_total_brl_ha <= 0) as invalid_nonpositive_cost_rows,
  count(distinct uf) as cost_ufs from costs), (select count(*) as price_rows, {n('min(ano)', 'price_year_min')}, {n('max(ano)', 'price_year_max')},
  count(distinct uf) as price_ufs, count(*) filter (where preco_brl_kg <= 0) as invalid_nonpositive_price_rows from prices)""")


def yield_model_evaluation(spark, sf_dir):
    """Fits the candidates on both splits and reports every metric; iterative, so without SQL."""
    cfg = ModelSettings(training_start_year=1997, training_end_year=2001, temporal_test_start_year=2000)
    makers = modelling.default_candidates()
    out = modelling.evaluate_candidates(_training(spark, sf_dir), cfg, makers)
    return plain(out.metrics.withColumns({
        "selected": F.lit(out.selected), "promoted": F.lit(out.promoted), "radius": F.lit(out.intervals["radius"]),
    }))


LINE = "yield_mean_5y"
LINE_SETTINGS = ModelSettings(training_start_year=1997, training_end_year=2001, temporal_test_start_year=2000)


def _line() -> modelling.Candidates:
    """An ordinary least-squares line, whose fit SQL can repeat."""
    return {"line": lambda seed: LinearRegression(
        featuresCol="_x", labelCol=training.TARGET, predictionCol="prediction", solver="normal", regParam=0.0)}


def line_evaluation(spark, sf_dir):
    """The whole evaluation with one candidate on one feature: splits, imputation, metrics, gate and intervals."""
    out = modelling.evaluate_candidates(_training(spark, sf_dir), LINE_SETTINGS, _line(), features=[LINE])
    told = {"selected": F.lit(out.selected), "promoted": F.lit(out.promoted), "selection_score": F.lit(out.selection_score)}
    told |= {c: F.lit(out.intervals[c]) for c in ("radius", "calibration_rows", "evaluation_rows", "empirical_coverage")}
    return plain(out.metrics.select("split", "predictor", "rows", "mae", "rmse", "smape_pct", "r2").withColumns(told))


def _fitted(train: str, test: str) -> str:
    """Rows of `frame` where `test` holds, with the line fitted where `train` does."""
    return f"""
    select f.*, a.slope * coalesce({LINE}, a.mid) + a.base as line from frame f,
      (select regr_slope({_t}, x) as slope, regr_intercept({_t}, x) as base, max(mid) as mid
       from (select {_t}, coalesce({LINE}, mid) as x, mid from frame, (select median({LINE}) as mid from frame where {train}) where {train})) a where {test}"""


LINE_VIEWS = dict(
    temporal_rows=_fitted("ano < 2000", "ano >= 2000"), geographic_rows=_fitted(f"not {_share} < 0.2", f"{_share} < 0.2"),
    line_metrics=" union all ".join(
        _metric(c, name, f"(select *, '{split}' as split from {split}_rows)", "split", f"{c} is not null")
        for split in ("temporal", "geographic") for name, c in {"line": "line", **_pairs}.items()),
    ratios="select split, max(mae) filter (where predictor = 'line') / min(mae) filter (where predictor <> 'line') as ratio from line_metrics group by split",
    errors=f"select ano, line as p, {_t} as y, abs({_t} - line) as a from temporal_rows",
    reached="select a as radius, n as calibration_rows from (select a, row_number() over (order by a) as rn, count(*) over () as n from errors where ano = 2000) where rn = "
            + _pick)
LINE_SQL = with_views(f"""
select split, predictor, rows, {rs('mae', 'rmse', 'smape_pct', 'r2')}, 'line' as selected, (select max(ratio) < 1 from ratios) as promoted,
  {r('(select avg(ratio) from ratios)', 'selection_score')}, {r('radius')}, calibration_rows, evaluation_rows, {r('empirical_coverage')}
from line_metrics, reached, (select count(*) as evaluation_rows, avg(cast(y between greatest(p - radius, 0) and p + radius as int)) as empirical_coverage
  from errors, reached where ano > 2000)""", **FRAME_VIEWS, **LINE_VIEWS)


def loaded_model_predictions(spark, sf_dir):
    """Predictions of a model that was fitted, written, pointed to and loaded again."""
    frame, harvests = _training(spark, sf_dir), view(spark, sf_dir, "harvests")
    told = modelling.Evaluation(None, None, None, "line", True, 0.9, {"empirical_coverage": 0.75, "nominal_coverage": 0.8})
    fitted = modelling.fit_production_model(
        frame, told, version="line-v1", settings=LINE_SETTINGS, candidates=_line(), features=[LINE], dataset_version="training-1")
    root = f"{shared_folder(spark)}/models-{uuid.uuid4().hex}"
    modelling.promote_model(spark, root, fitted)
    inference = training.inference_frame(harvests, merged(spark, sf_dir), view(spark, sf_dir, "municipalities"))
    return plain(modelling.promoted_predictions(inference, modelling.promoted_model(spark, root), harvests))


LOADED_SQL = with_views(f"""
select i.codigo_ibge, {r('greatest(greatest(p, 0) - radius, 0)', 'yield_p10')}, {r('greatest(p, 0)', 'yield_p50')}, {r('greatest(p, 0) + radius', 'yield_p90')},
  'predicted' as yield_type, {n('ano', 'yield_target_year')}, cast(ano as varchar) as yield_reference_period, 'line-v1' as model_version,
  0.7::double as performance_confidence, {n('ano - 1', 'climate_season')},
  case when {LAG}rain_crop_cycle_mm is not null and contains({LAG}source, 'ERA5') and {LAG}source not in (select {LAG}source from frame
    where {LAG}rain_crop_cycle_mm is not null) then 'CLIMATE_SOURCE_NOT_IN_MODEL_TRAINING' else '' end as yield_alerts,
  {LAG}rain_crop_cycle_mm is not null as climate_available, {LAG}source as climate_source, {LAG}data_nature as climate_data_nature,
  {LAG}method as climate_method, {LAG}quality_flag as climate_quality_flag, sample_size, 'line' as model, 'training-1' as dataset_version,
  'split_conformal_absolute_residual' as interval_method, 0.8::double as interval_nominal_coverage, {r('radius', 'interval_radius_kg_ha')},
  0.75::double as interval_empirical_coverage, {n('ano - 1', 'history_through_year')},
  case when {LAG}rain_crop_cycle_mm is not null then 'IBGE/PAM history and lagged ' || {LAG}source || ' climate features'
    else 'IBGE/PAM history; unavailable climate features imputed' end as yield_source
from (select i.*, l.slope * coalesce({LINE}, l.mid) + l.base as p from inference i, last_line l) i
left join (select codigo_ibge, count(*) as sample_size from harvests where {_t} is not null group by 1) s on s.codigo_ibge = i.codigo_ibge, last_radius""",
    **FRAME_VIEWS,
    last_line=f"""select regr_slope({_t}, x) as slope, regr_intercept({_t}, x) as base, max(mid) as mid from (
      select {_t}, coalesce({LINE}, mid) as x, mid from frame, (select median({LINE}) as mid from frame where ano < (select max(ano) from frame))
      where ano < (select max(ano) from frame))""",
    last_radius=f"""select a as radius from (select a, row_number() over (order by a) as rn, count(*) over () as n from (
      select abs({_t} - (slope * coalesce({LINE}, mid) + base)) as a from frame, last_line where ano = (select max(ano) from frame))) where rn = """ + _pick,
    future=FUTURE, extended=EXTENDED, hx=history_sql("extended"), recent=RECENT, inference=INFERENCE.replace("from h t left join", "from hx t left join"))


QUERIES = {
    "training_frame": (training_frame, FRAME_SQL),
    "inference_frame": (inference_frame, INFERENCE_SQL),
    "dataset_report": (dataset_report, REPORT_SQL),
    "feature_gaps": (feature_gaps, GAPS_SQL),
    "climate_mix": (climate_mix, MIX_SQL),
    "regression_metrics": (regression_metrics, METRICS_SQL),
    "metrics_by_source": (metrics_by_source, BY_SOURCE_SQL),
    "selection_scores": (selection_scores, SELECTION_SQL),
    "conformal_radius": (conformal_radius, RADIUS_SQL),
    "interval_evaluation": (interval_evaluation, INTERVAL_SQL),
    "exact_quantiles": (state_year_quantiles, QUANTILE_SQL),
    "yield_scenarios": (yield_scenarios, YIELD_SQL),
    "cost_scenario": (cost_scenario, COST_SQL),
    "cost_sources": (cost_sources, COST_SOURCES_SQL),
    "price_scenario": (price_scenario, PRICE_SQL),
    "climate_scenario": (climate_scenario, CLIMATE_SQL),
    "risk_distribution": (risk_distribution, RISK_SQL),
    "recommendations": (recommendations, RECOMMEND_SQL),
    "predicted_recommendations": (predicted_recommendations, PREDICTED_RECOMMEND_SQL),
    "batch_predictions": (batch_predictions, PREDICTED_SQL),
    "min_max": (min_max, MINMAX_SQL),
    "dataset_rows": (dataset_rows, ROWS_SQL),
    "market_report": (market_report, MARKET_SQL),
    "yield_model_evaluation": (yield_model_evaluation, None),
    "line_evaluation": (line_evaluation, LINE_SQL),
    "loaded_model_predictions": (loaded_model_predictions, LOADED_SQL),
}
