"""Domain views over the given tables, written in SQL that Spark and DuckDB both run.

Every view derives from whole tables; keys give positions, orders give costs, prices, harvests and
planting windows, and line items give daily weather. Where a view must leave places uncovered, its rows
stay and carry the code of a place or state that no municipality has.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS: dict[str, str] = {}

# Harvest panel of suppliers: one row per supplier and shipping year.
VIEWS["panel"] = """
select lpad(cast(l_suppkey as string), 7, '0') as codigo_ibge, s_name as municipio,
  lpad(cast(s_nationkey as string), 2, '0') as uf, 'soja' as cultura,
  'not_available' as sistema_produtivo, cast(year(l_shipdate) as int) as ano,
  sum(l_quantity) as area_plantada_ha,
  sum(case when l_linestatus = 'F' then l_quantity else 0e0 end) as area_colhida_ha,
  sum(l_extendedprice) as producao_t,
  case when count(*) % 11 = 0 then null when count(*) % 13 = 0 then 0e0
    else sum(l_extendedprice) / sum(l_quantity) end as produtividade_kg_ha,
  sum(l_extendedprice * (1e0 - l_discount)) as valor_producao_original,
  case when year(l_shipdate) >= 1997 then sum(l_extendedprice * (1e0 - l_discount)) end as valor_producao_brl
from lineitem join supplier on l_suppkey = s_suppkey
group by l_suppkey, s_name, s_nationkey, year(l_shipdate)
"""

# Harvest panel of customers: years without orders are gaps in the series.
VIEWS["harvests"] = """
select lpad(cast(o_custkey as string), 7, '0') as codigo_ibge, c_name as municipio,
  lpad(cast(c_nationkey as string), 2, '0') as uf, 'soja' as cultura,
  'not_available' as sistema_produtivo, cast(year(o_orderdate) as int) as ano,
  10e0 * count(*) as area_plantada_ha, 9e0 * count(*) as area_colhida_ha,
  sum(o_totalprice) / 7.31e2 as producao_t,
  case when sum(o_orderkey) % 17 = 0 then null when sum(o_orderkey) % 19 = 0 then 0e0
    else sum(o_totalprice) / (53e0 * count(*)) end as produtividade_kg_ha,
  sum(o_totalprice) / 7e0 as valor_producao_brl
from orders join customer on o_custkey = c_custkey
group by o_custkey, c_name, c_nationkey, year(o_orderdate)
"""

VIEWS["municipalities"] = """
select lpad(cast(c_custkey as string), 7, '0') as codigo_ibge, c_name as municipio,
  lpad(cast(c_nationkey as string), 2, '0') as uf, r_name as regiao,
  case when c_custkey % 97 <> 5 then -33e0 + ((c_custkey * 7919) % 280013) / 1e4 end as latitude_centroid,
  case when c_custkey % 97 <> 5 then -70e0 + ((c_custkey * 10007) % 350003) / 1e4 end as longitude_centroid
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
"""

# Daily weather of suppliers as stations, whose metadata is revised between years.
VIEWS["station_days"] = """
select concat('A', lpad(cast(l_suppkey as string), 5, '0')) as station_code,
  case when l_suppkey % 6 = 1 and year(l_shipdate) % 2 = 0 then concat(s_name, ' B') else s_name end as station_name,
  case when l_suppkey % 6 = 2 and year(l_shipdate) % 2 = 1 then 'ZZ'
    else lpad(cast(s_nationkey as string), 2, '0') end as station_uf,
  -33e0 + ((l_suppkey * 6007) % 280009) / 1e4
    + case when l_suppkey % 6 = 3 then 4e-3 * (year(l_shipdate) % 2)
        when l_suppkey % 6 = 4 then 1e-1 * (year(l_shipdate) % 2) else 0e0 end as station_latitude,
  -70e0 + ((l_suppkey * 9001) % 350009) / 1e4 as station_longitude,
  cast(l_suppkey % 900 as double) as station_altitude_m,
  cast(l_shipdate as date) as data,
  sum(l_tax) * 100e0 as rain_mm, count(*) * 80 as rain_observations,
  avg(l_quantity) * 6e-1 as mean_temp_c, count(*) * 85 as temp_observations,
  max(l_quantity) * 8e-1 as max_temp_c, min(l_quantity) * 5e-1 as min_temp_c,
  avg(l_discount) * 1e3 as mean_humidity_pct, count(*) as humidity_observations,
  sum(l_extendedprice) / 10e0 as radiation_kj_m2, count(*) as radiation_observations,
  avg(l_tax) * 100e0 as mean_wind_m_s, count(*) as wind_observations,
  lpad(cast(year(l_shipdate) as string), 64, 'a') as source_dataset_checksum
from lineitem join supplier on l_suppkey = s_suppkey
group by l_suppkey, s_name, s_nationkey, l_shipdate
"""

# Daily reanalysis of customers: every order line is a day, some without a rain total.
VIEWS["reanalysis_days"] = """
select codigo_ibge, municipio, uf, latitude_centroid, longitude_centroid, cast(l_shipdate as date) as data,
  case when count(*) % 2 = 0 then null else sum(l_tax) * 300e0 end as rain_mm,
  avg(l_quantity) * 6e-1 as mean_temp_c, max(l_quantity) * 8e-1 as max_temp_c,
  min(l_quantity) * 5e-1 as min_temp_c, avg(l_discount) * 1e3 as mean_humidity_pct,
  sum(l_extendedprice) / 10e0 as radiation_kj_m2, avg(l_tax) * 100e0 as mean_wind_m_s,
  1000 * count(*) as rain_observations, 1000 * count(*) as temp_observations,
  24 * count(*) as humidity_observations, 24 * count(*) as radiation_observations,
  24 * count(*) as wind_observations, max(l_linenumber) % 3 as rain_negative_increments,
  max(l_linenumber) % 2 as radiation_negative_increments,
  latitude_centroid + 1e-2 as grid_latitude, longitude_centroid + 1e-2 as grid_longitude,
  (o_custkey % 15) + 1e-1 as distance_to_grid_km,
  lpad(cast(year(l_shipdate) as string), 64, 'b') as checksum
from lineitem join orders on l_orderkey = o_orderkey
join municipalities on codigo_ibge = lpad(cast(o_custkey as string), 7, '0')
where latitude_centroid is not null
group by codigo_ibge, municipio, uf, latitude_centroid, longitude_centroid, o_custkey, l_shipdate
"""

# Hourly readings: events by type and hour.
VIEWS["readings"] = """
select event_type, cast(ts as date) as data, value as precipitacao_mm, value - 40e0 as temperatura_c,
  value + 5e0 as temperatura_max_c, value - 60e0 as temperatura_min_c, value * 2e0 as umidade_pct,
  value - 20e0 as radiacao_kj_m2, value as vento_m_s
from events
"""

VIEWS["hourly_grid"] = """
select event_type, date_trunc('hour', ts) as valid_time, 273.15e0 + avg(value) / 4e0 as t2m,
  270e0 + avg(value) / 5e0 as d2m, avg(value) / 10e0 as u10, max(value) / 20e0 as v10,
  case when sum(user_id) % 29 = 0 then null else (avg(value) - 12e0) / 1e3 end as tp,
  case when sum(user_id) % 31 = 0 then null else avg(value) * 1e3 end as ssrd
from events group by event_type, date_trunc('hour', ts)
"""

# Production survey in long form, one token per customer, year and variable.
VIEWS["survey"] = """
select lpad(cast(o_custkey as string), 7, '0') as D1C,
  case when o_custkey % 2 = 0 then concat(c_name, ' (N', chr(65 + c_nationkey), ')')
    else concat(c_name, ' - N', chr(65 + c_nationkey)) end as D1N,
  case substr(o_orderpriority, 1, 1) when '1' then '8331' when '2' then '216' when '3' then '214'
    when '4' then '112' else '215' end as D2C,
  cast(year(o_orderdate) as string) as D3C, '40124' as D4C,
  case when o_custkey % 3 = 0 then 'Soja (em grão)' else '  SOJA em  Grao' end as D4N,
  case when max(o_orderkey) % 9 = 1 then ''
    when substr(o_orderpriority, 1, 1) = '3' then 'Toneladas'
    when substr(o_orderpriority, 1, 1) = '4' then 'Quilogramas por Hectare'
    when substr(o_orderpriority, 1, 1) = '5' then
      case when year(o_orderdate) % 2 = 0 then 'Mil Reais' else 'Mil Cruzeiros' end
    else 'Hectares' end as MN,
  case max(o_orderkey) % 9 when 0 then '-' when 1 then '...' when 2 then 'X' when 3 then 'C'
    when 4 then '..' else cast(max(o_orderkey) * 7 as string) end as V
from orders join customer on o_custkey = c_custkey
group by o_custkey, c_name, c_nationkey, year(o_orderdate), o_orderpriority
"""

_DECENDIO = "(month(o_orderdate) - 1) * 3 + least(cast(floor((day(o_orderdate) - 1) / 10) as int), 2) + 1"
_RISK = "case o_orderkey % 4 when 0 then 0 when 1 then 20 when 2 then 30 else 40 end"
VIEWS["zoning_wide"] = f"""
select case when o_orderstatus = 'P' then 'Milho' else ' Soja ' end as Nome_cultura,
  2026 as SafraIni, 2027 as SafraFin, 60 as Cod_Cultura,
  cast(substr(o_orderpriority, 1, 1) as int) * 10 as Cod_Ciclo, o_custkey % 3 + 11 as Cod_Solo,
  case when c_nationkey < 20 and c_mktsegment <> 'HOUSEHOLD' then o_custkey else o_custkey + 5000000 end as geocodigo,
  lpad(cast(case when c_nationkey < 20 then c_nationkey else c_nationkey + 40 end as string), 2, '0') as UF, 1 as Cod_Outros_Manejos,
  ' Sequeiro ' as Nome_Outros_Manejos, concat('Port. ', cast(c_nationkey as string)) as Portaria,
  {", ".join(f"max(case when {_DECENDIO} = {i} then {_RISK} else 0 end) as dec{i}" for i in range(1, 37))}
from orders join customer on o_custkey = c_custkey
group by o_orderstatus, o_orderpriority, o_custkey, c_nationkey, c_mktsegment
"""

VIEWS["costs"] = """
select case when c_mktsegment = 'BUILDING' then c_custkey else c_custkey + 5000000 end as codigo_ibge_fonte,
  lpad(cast(case when c_nationkey = 7 then 67 else c_nationkey end as string), 2, '0') as uf,
  cast(year(o_orderdate) as int) as ano, cast(month(o_orderdate) as int) as mes,
  c_name as municipio_fonte, o_orderpriority as sistema_produtivo,
  o_totalprice * 1.0371913e-2 as custo_variavel_brl_ha, o_totalprice * 1.2371917e-2 as custo_operacional_brl_ha,
  o_totalprice * 1.2871923e-2 as custo_total_brl_ha
from orders join customer on o_custkey = c_custkey
"""

VIEWS["prices"] = """
select coverage_level, case when coverage_level = 'state' then cast(null as bigint)
    when c_mktsegment = 'MACHINERY' then c_custkey else c_custkey + 5000000 end as codigo_ibge_fonte,
  lpad(cast(case when c_nationkey = 11 then 71 else c_nationkey end as string), 2, '0') as uf,
  cast(year(o_orderdate) as int) as ano, cast(month(o_orderdate) as int) as mes,
  case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'PRECO RECEBIDO P/ PRODUTOR' else 'ATACADO' end
    as nivel_comercializacao,
  o_totalprice / 1.0371913e5 as preco_brl_kg
from (select 'state' as coverage_level, orders.* from orders union all select 'municipality', orders.* from orders) o
join customer on o_custkey = c_custkey
"""

# Municipality seasons from stations, some beyond the radius, some with unusable values.
VIEWS["station_climate"] = """
select codigo_ibge, municipio, uf, latitude_centroid, longitude_centroid, season_year,
  case when d <= 250e0 and k % 5 <> 0 then price / 300e0 when k % 35 = 0 then cast('NaN' as double) end as rain_crop_cycle_mm,
  price / 1100e0 as rain_30d_mm, price / 900e0 as rain_60d_mm, price / 700e0 as rain_90d_mm,
  case when d <= 250e0 then k % 90 end as dry_days, k % 40 as days_temp_gt_35, k % 7 as days_temp_lt_10,
  case when d <= 250e0 then 20e0 + (k % 90) / 1e1 end as mean_temp_c, 31e0 + k % 9 as max_temp_c, 1e0 + k % 13 as min_temp_c,
  60e0 + k % 30 as mean_humidity_pct, price as radiation_sum_kj_m2, 1e0 + (k % 11) / 4e0 as mean_wind_m_s,
  case when d <= 250e0 then 5e-1 + (k % 60) / 1e2 end as season_coverage,
  concat('A', lpad(cast(k % 700 as string), 3, '0')) as station_code, concat('Station ', cast(k % 700 as string)) as station_name,
  uf as station_uf, d as distance_to_station_km,
  case when d <= 250e0 then 'interpolated' else 'estimated' end as data_nature,
  case when d <= 250e0 then 'nearest INMET automatic station within configured radius'
    else 'nearest station exceeds configured radius; features withheld' end as method,
  case when d > 250e0 then 'NO_NEARBY_INMET_STATION' end as quality_flag,
  'INMET automatic station annual archives' as source, lpad(cast(season_year as string), 64, 'a') as checksum
from (
  select o_custkey, cast(case when month(o_orderdate) >= 9 then year(o_orderdate) + 1 else year(o_orderdate) end as int) as season_year,
    sum(o_orderkey) as k, sum(o_totalprice) as price, (o_custkey * 31 + sum(o_orderkey)) % 400 + 5e-1 as d
  from orders group by 1, 2) o
join municipalities on codigo_ibge = lpad(cast(o_custkey as string), 7, '0')
"""

# Whole-season reanalysis rows for some of the same keys.
VIEWS["grid_climate"] = """
select codigo_ibge, municipio, uf, latitude_centroid, longitude_centroid, season_year,
  rain_crop_cycle_mm * 2e0 + 3e2 as rain_crop_cycle_mm, rain_30d_mm * 2e0 as rain_30d_mm, rain_60d_mm * 2e0 as rain_60d_mm,
  rain_90d_mm * 2e0 as rain_90d_mm, dry_days, days_temp_gt_35, days_temp_lt_10, mean_temp_c, max_temp_c, min_temp_c,
  mean_humidity_pct, radiation_sum_kj_m2, mean_wind_m_s, season_coverage,
  cast(null as string) as station_code, cast(null as string) as station_name, cast(null as string) as station_uf,
  cast(null as double) as distance_to_station_km, g as distance_to_grid_km, 'estimated' as data_nature,
  'nearest ERA5-Land reanalysis grid cell; UTC Sep-Apr' as method, 'ERA5_REANALYSIS_FALLBACK' as quality_flag,
  'Copernicus ERA5-Land reanalysis' as source, lpad(cast(season_year as string), 64, 'b') as checksum
from (
  select codigo_ibge, municipio, uf, latitude_centroid, longitude_centroid, season_year,
    radiation_sum_kj_m2 / 500e0 as rain_crop_cycle_mm, rain_30d_mm, rain_60d_mm, rain_90d_mm,
    days_temp_gt_35 + 20 as dry_days, days_temp_gt_35, days_temp_lt_10, 24e0 as mean_temp_c, max_temp_c, min_temp_c,
    mean_humidity_pct, radiation_sum_kj_m2, mean_wind_m_s, (days_temp_lt_10 + 13e0) / 20e0 as season_coverage,
    (days_temp_gt_35 % 24) + 5e-1 as g
  from station_climate where days_temp_gt_35 % 3 <> 1)
"""


def _needed(sql: str, seen: dict[str, None]) -> dict[str, None]:
    for name in VIEWS:
        if name not in seen and re.search(rf"\b{name}\b", sql):
            _needed(VIEWS[name], seen)
            seen[name] = None
    return seen


def with_views(sql: str, **extra: str) -> str:
    """SQL with the views it names, directly or through ``extra`` views, as common tables."""
    body = " ".join([sql, *extra.values()])
    parts = [f"{name} as ({VIEWS[name].strip()})" for name in _needed(body, {})]
    parts += [f"{name} as ({text.strip()})" for name, text in extra.items()]
    return f"with {', '.join(parts)} {sql.strip()}" if parts else sql.strip()


@lru_cache(maxsize=64)
def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view as a DataFrame."""
    sql = with_views(f"select * from {name}")
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            read(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(sql)


def plain(df: DataFrame, digits: int = 4) -> DataFrame:
    """Columns in types both engines print alike: rounded doubles, longs, joined arrays."""
    out: list[Column] = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), digits)
        elif kind in ("int", "smallint", "tinyint", "bigint"):
            c = c.cast("long")
        elif kind.startswith("array"):
            c = F.array_join(c.cast("array<string>"), ",")
        elif kind == "date" or kind.startswith("timestamp"):
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)
