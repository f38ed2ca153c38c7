"""Cost and price tables cleaned from the text exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import decimal_comma, provenance, trimmed

# Product filter and provenance of the exports.
PRODUCT, CROP = "SOJA", "soja"
COST_SOURCE, PRICE_SOURCE = "CONAB CustoProducao.txt", "CONAB precos mensais"
COVERAGE_LEVELS = ("municipality", "state")


def only_product(df: DataFrame, column: str = "produto", product: str = PRODUCT) -> DataFrame:
    """Rows whose whole label is the product; "FARELO DE SOJA" is another product."""
    return df.where(F.upper(trimmed(column)) == product)


def clean_costs(raw: DataFrame, *, source_checksum: str) -> DataFrame:
    """Typed cost rows; operational = variable + fixed, total adds factor income."""
    number = lambda c, name: decimal_comma(c).alias(name)
    typed = only_product(raw).select(
        trimmed("empreendimento").alias("sistema_produtivo"),
        F.lit(CROP).alias("cultura"),
        trimmed("ano").try_cast("int").alias("ano"),
        trimmed("mes").try_cast("byte").alias("mes"),
        trimmed("ano_mes").alias("ano_mes"), trimmed("safra").alias("safra"), trimmed("uf").alias("uf"),
        trimmed("municipio").alias("municipio_fonte"),
        trimmed("cod_ibge").try_cast("long").alias("codigo_ibge_fonte"),
        trimmed("unidade_comercializacao").alias("unidade_comercializacao"),
        number("vlr_custo_variavel_ha", "custo_variavel_brl_ha"),
        number("vlr_custo_fixo_ha", "custo_fixo_brl_ha"),
        number("vlr_renda_fator_ha", "renda_fatores_brl_ha"),
        number("vlr_custo_variavel_unidade", "custo_variavel_brl_unidade"),
        number("vlr_custo_fixo_unidade", "custo_fixo_brl_unidade"),
        number("vlr_renda_fator_unidade", "renda_fatores_brl_unidade"),
    )
    operational = F.col("custo_variavel_brl_ha") + F.col("custo_fixo_brl_ha")
    costed = typed.withColumns(
        {
            "custo_operacional_brl_ha": operational,
            "custo_total_brl_ha": operational + F.col("renda_fatores_brl_ha"),
        }
    )
    kept = costed.where((F.col("codigo_ibge_fonte").isNotNull()) & (F.col("custo_total_brl_ha") > 0))
    kept = provenance(
        kept, data_nature="observed", source=COST_SOURCE, source_dataset_checksum=source_checksum
    )
    return kept.withColumns({"estimation_method": F.lit(None).cast("string"), "confidence": F.lit(1.0)})


def clean_prices(raw: DataFrame, *, coverage_level: str, source_checksum: str) -> DataFrame:
    """Typed positive prices of one territorial level; state rows carry no municipality."""
    if coverage_level not in COVERAGE_LEVELS:
        raise ValueError(f"coverage_level must be one of {COVERAGE_LEVELS}")
    local = coverage_level == "municipality"
    place = trimmed("nom_municipio") if local else F.lit(None).cast("string")
    code = trimmed("cod_ibge").try_cast("long") if local else F.lit(None).cast("long")
    typed = only_product(raw).select(
        F.lit(CROP).alias("cultura"),
        trimmed("ano").try_cast("int").alias("ano"), trimmed("mes").try_cast("byte").alias("mes"),
        trimmed("uf").alias("uf"), trimmed("dsc_nivel_comercializacao").alias("nivel_comercializacao"),
        decimal_comma("valor_produto_kg").alias("preco_brl_kg"),
        F.lit(coverage_level).alias("coverage_level"),
        F.lit("observed").alias("data_nature"), F.lit(PRICE_SOURCE).alias("source"),
        F.lit(source_checksum).alias("source_dataset_checksum"),
        place.alias("municipio_fonte"), code.alias("codigo_ibge_fonte"),
    )
    return typed.where("preco_brl_kg > 0")


def market_report(costs: DataFrame, prices: DataFrame) -> DataFrame:
    """One row of counts, year ranges and distincts over both tables."""
    cost = costs.agg(
        F.count(F.lit(1)).alias("cost_rows"),
        F.min("ano").alias("cost_year_min"), F.max("ano").alias("cost_year_max"),
        F.count_distinct("codigo_ibge_fonte").alias("cost_reference_municipalities"),
        F.count_if(F.col("custo_total_brl_ha") <= 0).alias("invalid_nonpositive_cost_rows"),
    )
    states = costs.agg(F.count_distinct("uf").alias("cost_ufs"))
    price = prices.agg(
        F.count(F.lit(1)).alias("price_rows"),
        F.min("ano").alias("price_year_min"), F.max("ano").alias("price_year_max"),
        F.count_distinct("uf").alias("price_ufs"),
        F.count_if(F.col("preco_brl_kg") <= 0).alias("invalid_nonpositive_price_rows"),
    )
    # Three single-row tables side by side.
    return cost.join(F.broadcast(states)).join(F.broadcast(price))
