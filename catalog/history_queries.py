"""Panel, history and cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cropgrid.functions.columns import code7, decimal_comma, provenance, tolerant_date, trimmed
from cropgrid.functions.geo import centroid
from cropgrid.functions.text import normalise_text
from cropgrid.operators import merge, quality
from cropgrid.operators.metrics import hash_share
from cropgrid.plans import history, markets, panel as panel_plan, zoning
from cropgrid.sources.dimensions import crop_aliases, resolve_crops
from cropgrid.sources.readers import pick_file, search_locations

from .sqltext import joined, n, r, rs
from .views import plain, read, view, with_views

KEYS = ["codigo_ibge", "cultura", "ano"]
HISTORY = [
    "yield_mean_3y", "yield_mean_5y", "yield_std_5y", "yield_cv_5y", "yield_trend_5y", "yield_trend_10y",
    "area_mean_5y", "production_mean_5y", "crop_presence_years",
]
CHECKSUM = "0123456789abcdef" * 4


def history_features(spark, sf_dir):
    return plain(history.history_features(view(spark, sf_dir, "panel")).select(*KEYS, *HISTORY))


def _frame(k):
    return f"over (partition by codigo_ibge, cultura order by ano rows between {k} preceding and 1 preceding)"


def history_sql(source: str) -> str:
    """Reference formulas for the history features of a panel-shaped relation."""

    def trend(k):
        w = _frame(k)
        two = lambda x: f"case when count({x}) {w} >= 2 then avg({x}) {w} end"
        return f"{two('x')} as mx{k}, {two('y')} as my{k}, {two('x*y')} as mxy{k}, {two('x*x')} as mxx{k}"

    slope = lambda k: (
        f"case when abs(mxx{k} - mx{k}*mx{k}) > 1e-12 then (mxy{k} - mx{k}*my{k}) / (mxx{k} - mx{k}*mx{k}) end"
    )
    return f"""
      select *, case when abs(yield_mean_5y) > 1e-12 then yield_std_5y / yield_mean_5y end as yield_cv_5y,
        {slope(5)} as yield_trend_5y, {slope(10)} as yield_trend_10y
      from (select *, avg(y) {_frame(3)} as yield_mean_3y, avg(y) {_frame(5)} as yield_mean_5y,
          stddev_samp(y) {_frame(5)} as yield_std_5y, avg(area_plantada_ha) {_frame(5)} as area_mean_5y,
          avg(producao_t) {_frame(5)} as production_mean_5y,
          count(y) over (partition by codigo_ibge, cultura order by ano
            rows between unbounded preceding and 1 preceding) as crop_presence_years, {trend(5)}, {trend(10)}
        from (select *, cast(ano - 2000 as double) as x, produtividade_kg_ha as y from {source}))"""


HISTORY_SQL = with_views(
    f"select codigo_ibge, cultura, {n('ano')}, {rs(*HISTORY[:-1])}, {n('crop_presence_years')} from h",
    h=history_sql("panel"),
)


def trailing_median(spark, sf_dir):
    rows = view(spark, sf_dir, "panel")
    return plain(rows.select(*KEYS, history.trailing_median().alias("median_5y")))


TRAILING_SQL = with_views(f"""
select codigo_ibge, cultura, {n('ano')}, {r('case when c >= 3 then m end', 'median_5y')} from (
  select *, quantile_cont(produtividade_kg_ha, 0.5) over w as m, count(produtividade_kg_ha) over w as c
  from panel window w as (partition by codigo_ibge order by ano rows between 5 preceding and 1 preceding))
""")


def panel_pivot_flags(spark, sf_dir):
    out = panel_plan.assemble_panel(
        view(spark, sf_dir, "survey"), crop_aliases(spark), source_checksum=CHECKSUM
    )
    return plain(out)


_FIELDS = {
    "8331": "area_plantada_ha", "216": "area_colhida_ha", "214": "producao_t",
    "112": "produtividade_kg_ha", "215": "valor_producao_original",
}
_VALUE = "case when V = '-' then 0.0 else try_cast(V as double) end"
_FLAG = (
    "case V when '-' then 'SIDRA_ABSOLUTE_ZERO' when '...' then 'SIDRA_NOT_AVAILABLE' "
    "when 'X' then 'SIDRA_SUPPRESSED' when '..' then 'SIDRA_NOT_APPLICABLE' "
    "when 'C' then 'SIDRA_VALUE_RANGE_OR_SUPPRESSED' end"
)
_PIVOT_FLAGS = ", ".join(
    f"case when n_{f} = 0 then '{f}:MISSING_VARIABLE' end, '{f}:' || f_{f}, "
    + (
        f"case when n_{f} = 1 and v_{f} is null and u_{f} = '' then '{f}:UNIT_NOT_PROVIDED_FOR_MISSING_VALUE' end"
        if f != "valor_producao_original"
        else f"case when v_{f} is not null and u_{f} <> 'Mil Reais' "
        "then 'valor_producao_brl:HISTORICAL_CURRENCY_NOT_NORMALIZED' end"
    )
    for f in _FIELDS.values()
)
PIVOT_SQL = with_views(
    f"""
select D1C as codigo_ibge, municipio, uf, {n('ano')}, 'soja' as cultura, 'not_available' as sistema_produtivo,
  {", ".join(r(f"v_{f}", f) for f in _FIELDS.values())},
  nullif(u_valor_producao_original, '') as valor_producao_unidade_original,
  {r("case when u_valor_producao_original = 'Mil Reais' then v_valor_producao_original * 1000 end", "valor_producao_brl")},
  'IBGE/PAM/SIDRA' as source, '5457' as source_table, 'observed' as source_type,
  'SIDRA:t5457:n6:' || D1C || ':p' || ano || ':c782:40124' as source_reference,
  '{CHECKSUM}' as source_dataset_checksum,
  coalesce(list_aggregate(list_sort(list_distinct(list_filter([{_PIVOT_FLAGS},
    case when v_area_colhida_ha > v_area_plantada_ha then 'AREA_HARVESTED_GT_PLANTED' end],
    lambda x: x is not null))), 'string_agg', ','), '') as quality_flags
from wide""",
    wide="select D1C, D3C as ano, max(regexp_extract(D1N, '^(.+?)(?: \\(([A-Z]{2})\\)| - ([A-Z]{2}))$', 1)) as municipio, "
    "max(regexp_extract(D1N, '(N[A-Z])\\)?$', 1)) as uf, "
    + ", ".join(
        f"count(*) filter (where D2C = '{i}') as n_{f}, max({_VALUE}) filter (where D2C = '{i}') as v_{f}, "
        f"max({_FLAG}) filter (where D2C = '{i}') as f_{f}, max(MN) filter (where D2C = '{i}') as u_{f}"
        for i, f in _FIELDS.items()
    )
    + " from survey group by D1C, D3C",
)


def keep_last_upsert(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(
        "o_custkey", F.year("o_orderdate").alias("ano"), "o_orderkey", "o_totalprice", "o_orderpriority"
    )
    return plain(merge.keep_last(orders, ["o_custkey", "ano"], ["o_orderkey"]))


KEEP_LAST_SQL = f"""
select o_custkey, ano, o_orderkey, {r('o_totalprice')}, o_orderpriority from (
  select o_custkey, cast(year(o_orderdate) as bigint) as ano, o_orderkey, o_totalprice, o_orderpriority,
    row_number() over (partition by o_custkey, year(o_orderdate) order by o_orderkey desc) as rn from orders)
where rn = 1"""


def panel_upsert(spark, sf_dir):
    """Existing panel whose later years are replaced by a revised load."""
    base = view(spark, sf_dir, "harvests")
    revised = base.where("ano >= 1999").withColumn("producao_t", F.col("producao_t") * 2)
    return plain(panel_plan.upsert_panel(base.where("ano < 2001"), revised, verify=False))


PANEL_UPSERT_SQL = with_views(f"""
select codigo_ibge, municipio, uf, cultura, sistema_produtivo, {n('ano')},
  {rs('area_plantada_ha', 'area_colhida_ha', 'produtividade_kg_ha', 'valor_producao_brl')},
  {r('case when ano >= 1999 then producao_t * 2 else producao_t end', 'producao_t')} from harvests
""")


def anti_union_upsert(spark, sf_dir):
    """All orders with those of one customer in three replaced by repriced ones, and a new order for each customer."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("price"))
    repriced = o.where("o_custkey % 3 = 0").withColumn("price", F.col("price") * 2).withColumn("note", F.lit("repriced"))
    fresh = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"), F.max("price").alias("price")).select(
        (-1 - F.col("o_custkey")).alias("o_orderkey"), "o_custkey", "price", F.lit("new").alias("note"))
    return plain(merge.upsert(o, repriced.unionByName(fresh), ["o_orderkey"]))


UPSERT_SQL = f"""
select {n('o_orderkey')}, {n('o_custkey')}, round(case when o_custkey % 3 = 0 then price * 2 else price end, 4) as price,
  case when o_custkey % 3 = 0 then 'repriced' end as note
from (select o_orderkey, o_custkey, cast(o_totalprice as double) as price from orders)
union all select cast(-1 - o_custkey as bigint), {n('o_custkey')}, round(max(cast(o_totalprice as double)), 4), 'new' from orders group by o_custkey"""


def newest_file(spark, sf_dir):
    """The first and the last file name of each folder, over a listing of all documents."""
    folder = F.concat(F.lit("/land/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")))
    listing = read(spark, sf_dir, "documents").select(F.concat(folder, F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".json")).alias("path"))
    first = pick_file(listing, last=False).withColumnRenamed("path", "first_path")
    return pick_file(listing).withColumnRenamed("path", "last_path").join(first, "directory")


NEWEST_SQL = """
select directory, min(path) as first_path, max(path) as last_path
from (select directory, directory || '/' || lpad(cast(doc_id as varchar), 12, '0') || '.json' as path
  from (select *, '/land/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none') as directory from documents)) group by directory"""


def conflict_merge(spark, sf_dir):
    """Two overlapping projections of orders, some of which disagree, coalesced per order."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    left = o.select("o_orderkey", F.when(k % 3 != 0, F.col("o_totalprice")).alias("price"), F.col("o_orderstatus").alias("state"))
    right = o.select(
        "o_orderkey", (F.col("o_totalprice") + F.when(k % 7 == 0, 1.0).otherwise(0.0)).alias("price"),
        F.when(k % 2 == 0, F.col("o_orderstatus")).alias("state"),
    )
    return plain(merge.merge_non_null(left.unionByName(right), ["o_orderkey"], ["price", "state"]))


CONFLICT_SQL = f"""
select o_orderkey, {r('max(price)', 'price')}, max(state) as state,
  case when count(distinct price) > 1 then 'price' else '' end as conflicts from (
  select o_orderkey, case when o_orderkey % 3 <> 0 then o_totalprice end as price, o_orderstatus as state from orders
  union all
  select o_orderkey, o_totalprice + case when o_orderkey % 7 = 0 then 1.0 else 0.0 end,
    case when o_orderkey % 2 = 0 then o_orderstatus end from orders) group by o_orderkey"""


def anti_semi_full(spark, sf_dir):
    """Customers with and without orders, and both key sets joined in full."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"), "c_acctbal")
    o = read(spark, sf_dir, "orders").groupBy(
        (F.col("o_custkey") + 40).alias("code")
    ).agg(F.count(F.lit(1)).alias("orders"))
    tagged = c.join(o, "code", "left_semi").select("code", F.lit("semi").alias("kind")).unionByName(
        c.join(o, "code", "left_anti").select("code", F.lit("anti").alias("kind"))
    )
    full = c.join(o, "code", "full")
    return plain(full.join(tagged, "code", "left"))


ANTI_SQL = f"""
with o as (select o_custkey + 40 as code, count(*) as orders from orders group by 1),
c as (select c_custkey as code, c_acctbal from customer)
select code, {r('c_acctbal')}, {n('orders')},
  case when c.c_acctbal is not null and o.orders is not null then 'semi' when c.c_acctbal is not null then 'anti' end as kind
from c full join o using (code)"""


def row_differences(spark, sf_dir):
    """Order revisions compared with the orders: rows on one side only."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    revised = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 50 == 3, F.lit("Z")).otherwise(F.col("o_orderstatus")))
    return plain(merge.differing_rows(o, revised))


DIFF_SQL = """
select o_orderkey, o_custkey, o_orderstatus, 'left_only' as _side from orders where o_orderkey % 50 = 3 and o_orderstatus <> 'Z'
union all select o_orderkey, o_custkey, 'Z', 'right_only' from orders where o_orderkey % 50 = 3 and o_orderstatus <> 'Z'"""


def budgeted_take(spark, sf_dir):
    """Orders in priority order: cached ones always, new ones within the budget."""
    o = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", (F.col("o_orderkey") % 5 == 0).alias("cached")
    )
    order = [F.asc("o_orderpriority"), F.desc("o_custkey"), F.asc("o_orderkey")]
    return plain(merge.budgeted(o, F.col("cached"), order, 100))


BUDGET_SQL = """
with p as (select o_orderkey, o_custkey, o_orderpriority, o_orderkey % 5 = 0 as cached from orders)
select * from p where cached union all (select * from p where not cached order by o_orderpriority, o_custkey desc, o_orderkey limit 100)"""


def unpivot_windows(spark, sf_dir):
    windows = zoning.planting_windows(view(spark, sf_dir, "zoning_wide"), source_checksum=CHECKSUM)
    return plain(windows)


WINDOWS = """
select distinct 'soja' as cultura, SafraIni as safra_inicio, SafraFin as safra_fim,
  cast(Cod_Cultura as varchar) as codigo_cultura_zarc, Cod_Ciclo as ciclo_codigo, Cod_Solo as tipo_solo_codigo,
  lpad(cast(geocodigo as varchar), 7, '0') as codigo_ibge, trim(UF) as uf, Cod_Outros_Manejos as manejo_codigo,
  trim(Nome_Outros_Manejos) as manejo_nome_fonte, trim(Portaria) as portaria,
  cast(substr(label, 4) as int) as decendio, risk as nivel_risco
from (unpivot (select * from zoning_wide where upper(trim(Nome_cultura)) = 'SOJA')
  on columns('^dec[0-9]+$') into name label value risk) where risk in (20, 30, 40)"""
_PROVENANCE = (
    "'observed' as data_nature, 'MAPA ZARC open risk table 2026/2027' as source, "
    f"'{CHECKSUM}' as source_dataset_checksum"
)
WINDOWS_SQL = with_views(f"""
select cultura, {", ".join(n(c) for c in ("safra_inicio", "safra_fim", "ciclo_codigo", "tipo_solo_codigo", "manejo_codigo", "decendio", "nivel_risco"))},
  codigo_cultura_zarc, codigo_ibge, uf, manejo_nome_fonte, portaria, 'eligible' as zarc_status, {_PROVENANCE} from windows
""", windows=WINDOWS)


def tri_state_coverage(spark, sf_dir):
    windows = zoning.planting_windows(view(spark, sf_dir, "zoning_wide"), source_checksum=CHECKSUM)
    return plain(zoning.zoning_coverage(windows, view(spark, sf_dir, "municipalities")))


_sorted = lambda c, name: joined(f"list_sort(list_distinct(list({c})))", name)
ELIGIBLE = f"""
select codigo_ibge, cultura, safra_inicio, safra_fim, min(nivel_risco) as melhor_nivel_risco,
  min(decendio) as janela_inicio_decendio, max(decendio) as janela_fim_decendio,
  {_sorted('decendio', 'decendios_elegiveis')}, {_sorted('ciclo_codigo', 'ciclos_codigos')},
  {_sorted('tipo_solo_codigo', 'tipos_solo_codigos')}, {_sorted('portaria', 'portarias')},
  count(*) as combinacoes_elegiveis from windows group by 1, 2, 3, 4"""
COVERAGE = f"""
select m.codigo_ibge, m.municipio, m.uf, 'soja' as cultura, 2026 as safra_inicio, 2027 as safra_fim,
  melhor_nivel_risco, janela_inicio_decendio, janela_fim_decendio, decendios_elegiveis, ciclos_codigos,
  tipos_solo_codigos, portarias, combinacoes_elegiveis,
  case when combinacoes_elegiveis is not null then '{CHECKSUM}' end as source_dataset_checksum,
  case when combinacoes_elegiveis is not null then 'eligible' when m.uf in (select uf from windows) then 'not_eligible'
    else 'not_available' end as zarc_status,
  case when combinacoes_elegiveis is not null then 'observed' else 'estimated' end as data_nature,
  case when combinacoes_elegiveis is not null then null
    when m.uf in (select uf from windows) then 'absence from complete eligible table for crop/UF/season'
    else 'crop/UF not covered by current official table' end as status_method,
  'MAPA ZARC open risk table 2026/2027' as source
from municipalities m left join eligible e on m.codigo_ibge = e.codigo_ibge"""
COVERAGE_SQL = with_views(f"""
select codigo_ibge, municipio, uf, cultura, {n('safra_inicio')}, {n('safra_fim')}, {n('melhor_nivel_risco')},
  {n('janela_inicio_decendio')}, {n('janela_fim_decendio')}, decendios_elegiveis, ciclos_codigos, tipos_solo_codigos,
  portarias, {n('combinacoes_elegiveis')}, source_dataset_checksum, zarc_status, data_nature, status_method, source from coverage
""", windows=WINDOWS, eligible=ELIGIBLE, coverage=COVERAGE)


def zoning_report(spark, sf_dir):
    windows = zoning.planting_windows(view(spark, sf_dir, "zoning_wide"), source_checksum=CHECKSUM)
    return plain(zoning.zoning_report(windows, zoning.zoning_coverage(windows, view(spark, sf_dir, "municipalities"))))


ZONING_REPORT_SQL = with_views(f"""
select {", ".join(f"count(*) filter (where zarc_status = '{s}') as municipalities_{s}" for s in ("eligible", "not_eligible", "not_available"))},
  (select count(*) from windows) as window_rows, (select count(distinct uf) from windows) as ufs_covered,
  (select {joined('list_sort(list_distinct(list(nivel_risco)))', 'x')} from windows) as risk_levels from coverage
""", windows=WINDOWS, eligible=ELIGIBLE, coverage=COVERAGE)


def _raw_costs(spark, sf_dir):
    """Line items as a text export: decimal commas, padding, junk numbers and other products."""
    li = read(spark, sf_dir, "lineitem")
    comma = lambda c, k: F.when(
        F.col("l_partkey") % k == 0, F.lit("n/d")
    ).otherwise(F.concat(F.lit(" "), F.floor(F.col(c) * 1).cast("string"), F.lit(",5 ")))
    text = lambda c: F.col(c).cast("string")
    return li.select(
        F.col("l_linestatus").alias("empreendimento"), F.year("l_shipdate").cast("string").alias("ano"),
        F.month("l_shipdate").cast("string").alias("mes"), text("l_orderkey").alias("ano_mes"),
        text("l_linenumber").alias("safra"), F.lit(" MT ").alias("uf"),
        F.concat(F.lit(" "), text("l_suppkey"), F.lit(" ")).alias("municipio"),
        F.when(F.col("l_partkey") % 29 == 0, F.lit("x")).otherwise(text("l_suppkey")).alias("cod_ibge"),
        F.lit("kg").alias("unidade_comercializacao"),
        F.when(F.col("l_returnflag") == "A", " soja ").when(F.col("l_returnflag") == "N", "SOJA").otherwise("FARELO DE SOJA").alias("produto"),
        comma("l_extendedprice", 31).alias("vlr_custo_variavel_ha"), comma("l_quantity", 37).alias("vlr_custo_fixo_ha"),
        comma("l_tax", 41).alias("vlr_renda_fator_ha"), comma("l_quantity", 1_000_003).alias("vlr_custo_variavel_unidade"),
        comma("l_quantity", 1_000_003).alias("vlr_custo_fixo_unidade"), comma("l_quantity", 1_000_003).alias("vlr_renda_fator_unidade"),
    )


def cost_cleaning(spark, sf_dir):
    return plain(markets.clean_costs(_raw_costs(spark, sf_dir), source_checksum=CHECKSUM))


_num = lambda c, k: f"case when l_partkey % {k} = 0 then null else floor({c}) + 0.5 end"
COST_CLEAN_SQL = f"""
with t as (select *, {_num('l_extendedprice', 31)} as v, {_num('l_quantity', 37)} as f, {_num('l_tax', 41)} as d,
  {_num('l_quantity', 1000003)} as u from lineitem where l_returnflag in ('A', 'N') and l_partkey % 29 <> 0)
select l_linestatus as sistema_produtivo, 'soja' as cultura, year(l_shipdate) as ano, month(l_shipdate) as mes,
  cast(l_orderkey as varchar) as ano_mes, cast(l_linenumber as varchar) as safra, 'MT' as uf,
  cast(l_suppkey as varchar) as municipio_fonte, l_suppkey as codigo_ibge_fonte, 'kg' as unidade_comercializacao,
  {r('v', 'custo_variavel_brl_ha')}, {r('f', 'custo_fixo_brl_ha')}, {r('d', 'renda_fatores_brl_ha')},
  {r('u', 'custo_variavel_brl_unidade')}, {r('u', 'custo_fixo_brl_unidade')}, {r('u', 'renda_fatores_brl_unidade')},
  {r('v + f', 'custo_operacional_brl_ha')}, {r('v + f + d', 'custo_total_brl_ha')}, 'observed' as data_nature,
  'CONAB CustoProducao.txt' as source, '{CHECKSUM}' as source_dataset_checksum,
  cast(null as varchar) as estimation_method, 1.0::double as confidence from t where v + f + d > 0"""


def price_cleaning(spark, sf_dir):
    raw = _raw_costs(spark, sf_dir).select(
        "produto", "uf", "ano", "mes", F.col("municipio").alias("nom_municipio"), "cod_ibge",
        F.concat(F.col("empreendimento"), F.lit("  ")).alias("dsc_nivel_comercializacao"),
        F.col("vlr_custo_variavel_ha").alias("valor_produto_kg"),
    )
    levels = [markets.clean_prices(raw, coverage_level=c, source_checksum=CHECKSUM) for c in markets.COVERAGE_LEVELS]
    return plain(merge.union_widening(*levels))


PRICE_CLEAN_SQL = f"""
with t as (select *, {_num('l_extendedprice', 31)} as v from lineitem where l_returnflag in ('A', 'N'))
select 'soja' as cultura, year(l_shipdate) as ano, month(l_shipdate) as mes, 'MT' as uf,
  l_linestatus as nivel_comercializacao, {r('v', 'preco_brl_kg')}, level as coverage_level, 'observed' as data_nature,
  'CONAB precos mensais' as source, '{CHECKSUM}' as source_dataset_checksum,
  case when level = 'municipality' then cast(l_suppkey as varchar) end as municipio_fonte,
  case when level = 'municipality' and l_partkey % 29 <> 0 then l_suppkey end as codigo_ibge_fonte
from t, (values ('municipality'), ('state')) x(level) where v > 0"""


def crop_resolution(spark, sf_dir):
    """Labels written from part names and types, resolved against source and global aliases."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey") % 7
    label = (
        F.when(k == 0, "  Soja (em GRÃO) ").when(k == 1, "ALGODÃO").when(k == 2, "feijão")
        .when(k == 3, "Arroz (em casca)").when(k == 4, "trigo em grãos").when(k == 5, "milho")
        .otherwise(F.col("p_name"))
    )
    rows = p.select("p_partkey", label.alias("label"))
    return plain(resolve_crops(rows, crop_aliases(spark), label="label", source="conab"))


CROP_SQL = """
select p_partkey, case p_partkey % 7 when 0 then '  Soja (em GRÃO) ' when 1 then 'ALGODÃO' when 2 then 'feijão'
  when 3 then 'Arroz (em casca)' when 4 then 'trigo em grãos' when 5 then 'milho' else p_name end as label,
  case p_partkey % 7 when 0 then 'soja' when 1 then 'algodao' when 2 then 'feijao' when 3 then 'arroz'
  when 4 then 'trigo' when 5 then 'milho' end as cultura from part"""


def text_normalise(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return plain(d.select("doc_id", F.md5(normalise_text("text")).alias("digest"), F.length(normalise_text("text")).alias("chars")))


# Fixed value: what compatibility folding adds to accent stripping for the given texts.
TEXT_SQL = r"""
select doc_id, md5(t) as digest, cast(length(t) as bigint) as chars from (
  select doc_id, trim(regexp_replace(lower(strip_accents(replace(replace(text, 'ß', 'ss'), 'ẞ', 'ss'))), '[^a-z0-9]+', ' ', 'g')) as t
  from documents)"""


def search(spark, sf_dir):
    return plain(search_locations(view(spark, sf_dir, "municipalities"), "  Mer#0000001", 50))


SEARCH_SQL = with_views("""
select codigo_ibge, municipio, uf from municipalities
where contains(lower(municipio), 'mer#0000001') or contains(codigo_ibge, 'mer#0000001')
order by municipio, uf, codigo_ibge limit 50""")


def json_nested(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    k = F.from_json("props", "k long")["k"]
    return plain(e.select("event_type", k.alias("k")).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.count("k").alias("known"), F.sum("k").alias("total"),
        F.max("k").alias("highest"),
    ))


JSON_SQL = f"""
select event_type, count(*) as rows, count(k) as known, {n('sum(k)', 'total')}, max(k) as highest from (
  select event_type, cast(json_extract(props, '$.k') as bigint) as k from events) group by event_type"""


def hash_split(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", hash_share("c_custkey", 20260820).alias("share"))
    return plain(c.withColumn("holdout", F.col("share") < 0.2), 9)


SPLIT_SQL = """
select c_custkey, round(share, 9) as share, share < 0.2 as holdout from (
  select c_custkey, cast(cast('0x' || substr(sha256('20260820:' || c_custkey), 1, 16) as ubigint) as double)
    / 18446744073709551616.0 as share from customer)"""


def _contract_rows(spark, sf_dir):
    rows = view(spark, sf_dir, "panel")
    return provenance(
        rows, source_type="observed", source_reference="lineitem", source_dataset_checksum=CHECKSUM
    ).withColumn("quality_flags", F.when(F.col("ano") % 2 == 0, F.array(F.lit(quality.AREA_FLAG))).otherwise(F.array().cast("array<string>")))


def contract_violations(spark, sf_dir):
    """Record contract over the panel; its two-digit states break the state rule."""
    return plain(quality.rule_summary(_contract_rows(spark, sf_dir), quality.production_rules()))


_RULES = [
    "codigo_ibge", "municipio", "uf", "ano", "cultura", "area_plantada_ha", "area_colhida_ha", "producao_t",
    "produtividade_kg_ha", "valor_producao_original", "valor_producao_brl", "source_type", "source_reference",
    "source_dataset_checksum", "area_inconsistency_flagged",
]
_BAD = {
    "uf": "not regexp_matches(uf, '^[A-Z]{2}$')", "ano": "ano not between 1974 and 2200",
    "codigo_ibge": "not regexp_matches(codigo_ibge, '^[0-9]{7}$')",
    "area_inconsistency_flagged": "coalesce(area_colhida_ha > area_plantada_ha, false) and ano % 2 <> 0",
    **{m: f"{m} < 0" for m in _RULES[5:11]},
}
CONTRACT_SQL = with_views(" union all ".join(
    f"select '{c}' as check_name, count(*) filter (where {_BAD.get(c, 'false')}) as failing_rows from panel" for c in _RULES
))


def production_report(spark, sf_dir):
    return plain(quality.production_report(_contract_rows(spark, sf_dir)))


REPORT_SQL = with_views(f"""
select count(*) as rows, cast(16 as bigint) as columns, cast(0 as bigint) as duplicate_keys, {n('min(ano)', 'year_min')},
  {n('max(ano)', 'year_max')}, count(distinct codigo_ibge) as municipalities, 'soja' as crops,
  count(*) filter (where ano % 2 = 0) as flagged_rows,
  {", ".join(f"count(*) filter (where {m} is null) as missing_{m}" for m in quality.REPORTED_MEASURES)} from panel""")


def missing_by_column(spark, sf_dir):
    return plain(quality.missing_counts(view(spark, sf_dir, "harvests"), quality.REPORTED_MEASURES[3:4] + ["valor_producao_brl", "ano"]))


MISSING_SQL = with_views(" union all ".join(
    f"select '{c}' as column_name, count(*) filter (where {c} is null) as missing from harvests"
    for c in ("produtividade_kg_ha", "valor_producao_brl", "ano")
))


def duplicate_keys(spark, sf_dir):
    return plain(quality.duplicate_keys(read(spark, sf_dir, "orders").withColumn("ano", F.year("o_orderdate")), ["o_custkey", "ano"]))


DUPLICATE_SQL = "select o_custkey, year(o_orderdate) as ano, count(*) as copies from orders group by 1, 2 having count(*) > 1"


def polygon_centroids(spark, sf_dir):
    """Squares with a hole around every municipality, every other one a multipolygon."""
    m = view(spark, sf_dir, "municipalities").where("latitude_centroid is not null")
    x, y = F.col("longitude_centroid"), F.col("latitude_centroid")

    def ring(x0, y0, size, turn):
        corners = [(0, 0), (size, 0), (size, size), (0, size), (0, 0)]
        points = [F.format_string("[%.4f,%.4f]", x0 + a, y0 + b) for a, b in (corners[::-1] if turn else corners)]
        return F.concat(F.lit("["), F.concat_ws(",", *points), F.lit("]"))

    one = F.concat(F.lit("["), ring(x, y, 4.0, False), F.lit(","), ring(x + 1, y + 1, 1.0, False), F.lit("]"))
    two = F.concat(F.lit("["), ring(x + 10, y, 2.0, True), F.lit("]"))
    single = F.concat(F.lit('{"type":"Polygon","coordinates":'), one, F.lit("}"))
    multi = F.concat(F.lit('{"type":"MultiPolygon","coordinates":['), one, F.lit(","), two, F.lit("]}"))
    shape = F.when(F.col("codigo_ibge").cast("long") % 2 == 0, single).otherwise(multi)
    rows = m.select("codigo_ibge", centroid(shape).alias("c"))
    return plain(rows.select("codigo_ibge", F.col("c.latitude").alias("latitude"), F.col("c.longitude").alias("longitude")))


# A 4x4 square (area 16) less a 1x1 hole, and a 2x2 square (area 4) ten degrees east.
CENTROID_SQL = with_views(f"""
select codigo_ibge, case when k = 0 then {{one}} else {{two}} end as latitude, case when k = 0 then {{onex}} else {{twox}} end as longitude from (
  select codigo_ibge, cast(codigo_ibge as bigint) % 2 as k, longitude_centroid as x, latitude_centroid as y
  from municipalities where latitude_centroid is not null)""".format(
    one="round((16 * (y + 2) - (y + 1.5)) / 15, 4)", two="round((16 * (y + 2) - (y + 1.5) + 4 * (y + 1)) / 19, 4)",
    onex="round((16 * (x + 2) - (x + 1.5)) / 15, 4)", twox="round((16 * (x + 2) - (x + 1.5) + 4 * (x + 11)) / 19, 4)",
))


def tolerant_parsing(spark, sf_dir):
    """Dates with either separator and numbers with decimal commas, junk turned to NULL."""
    o = read(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.replace(day, F.lit("-"), F.lit("/"))).when(k == 1, day).when(k == 2, F.concat(day, F.lit("x")))
    price = F.when(k == 3, F.lit("--")).otherwise(F.concat(F.floor("o_totalprice").cast("string"), F.lit(",25")))
    return plain(o.select(
        "o_orderkey", tolerant_date(text).alias("day"), decimal_comma(price).alias("price"),
        code7("o_custkey").alias("code"), F.upper(trimmed(F.concat(F.lit("\t "), "o_orderstatus", F.lit("\n")))).alias("state"),
    ))


PARSE_SQL = """
select o_orderkey, case when o_orderkey % 4 < 2 then cast(cast(o_orderdate as date) as varchar) end as day,
  case when o_orderkey % 4 <> 3 then floor(o_totalprice) + 0.25 end as price, lpad(cast(o_custkey as varchar), 7, '0') as code,
  upper(o_orderstatus) as state from orders"""


QUERIES = {
    "history_features": (history_features, HISTORY_SQL),
    "trailing_median": (trailing_median, TRAILING_SQL),
    "panel_pivot_flags": (panel_pivot_flags, PIVOT_SQL),
    "keep_last_upsert": (keep_last_upsert, KEEP_LAST_SQL),
    "anti_union_upsert": (anti_union_upsert, UPSERT_SQL),
    "newest_file": (newest_file, NEWEST_SQL),
    "panel_upsert": (panel_upsert, PANEL_UPSERT_SQL),
    "conflict_merge": (conflict_merge, CONFLICT_SQL),
    "anti_semi_full": (anti_semi_full, ANTI_SQL),
    "row_differences": (row_differences, DIFF_SQL),
    "budgeted_take": (budgeted_take, BUDGET_SQL),
    "unpivot_windows": (unpivot_windows, WINDOWS_SQL),
    "tri_state_coverage": (tri_state_coverage, COVERAGE_SQL),
    "zoning_report": (zoning_report, ZONING_REPORT_SQL),
    "cost_cleaning": (cost_cleaning, COST_CLEAN_SQL),
    "price_cleaning": (price_cleaning, PRICE_CLEAN_SQL),
    "crop_resolution": (crop_resolution, CROP_SQL),
    "text_normalise": (text_normalise, TEXT_SQL),
    "search_locations": (search, SEARCH_SQL),
    "json_nested": (json_nested, JSON_SQL),
    "hash_split": (hash_split, SPLIT_SQL),
    "contract_violations": (contract_violations, CONTRACT_SQL),
    "production_report": (production_report, REPORT_SQL),
    "missing_by_column": (missing_by_column, MISSING_SQL),
    "duplicate_keys": (duplicate_keys, DUPLICATE_SQL),
    "polygon_centroids": (polygon_centroids, CENTROID_SQL),
    "tolerant_parsing": (tolerant_parsing, PARSE_SQL),
}
