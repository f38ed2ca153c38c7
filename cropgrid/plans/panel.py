"""Production panel: survey records in long form to one row per municipality, crop and year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_label, survey_number
from ..operators.merge import keep_last, union_widening
from ..operators.quality import AREA_FLAG, production_rules, require, require_unique
from ..sources.dimensions import resolve_crops

# Survey variable ids, the panel column each one fills and its unit.
VARIABLES = {
    "8331": ("area_plantada_ha", "Hectares"),
    "216": ("area_colhida_ha", "Hectares"),
    "214": ("producao_t", "Toneladas"),
    "112": ("produtividade_kg_ha", "Quilogramas por Hectare"),
    "215": ("valor_producao_original", None),
}
VALUE_VARIABLE = "215"
# Currencies the value variable was published in over the years.
CURRENCIES = ("Mil Cruzeiros", "Mil Cruzados", "Mil Cruzados Novos", "Mil Cruzeiros Reais", "Mil Reais")
CURRENT_CURRENCY = "Mil Reais"
PANEL_KEY = ["codigo_ibge", "cultura", "ano", "sistema_produtivo"]
# Provenance texts of the panel and its quality flags.
PANEL_SOURCE, PANEL_TABLE = "IBGE/PAM/SIDRA", "5457"
NO_UNIT, NOT_NORMALISED, NO_VARIABLE = (
    "UNIT_NOT_PROVIDED_FOR_MISSING_VALUE", "HISTORICAL_CURRENCY_NOT_NORMALIZED", "MISSING_VARIABLE",
)


def _unit_problem() -> Column:
    """Text of a unit error, or NULL. A missing value may come without a unit."""
    unit, value = F.col("MN"), F.col("number.value")
    blank = F.coalesce(unit, F.lit("")) == ""
    expected = F.lit(None).cast("string")
    for variable, (_, name) in VARIABLES.items():
        expected = F.when(F.col("D2C") == variable, F.lit(name)).otherwise(expected)
    currency = (F.col("D2C") == VALUE_VARIABLE) & ~blank & ~unit.isin(*CURRENCIES)
    other = (
        (F.col("D2C") != VALUE_VARIABLE)
        & (F.coalesce(unit, F.lit("")) != expected)
        & ~(value.isNull() & blank)
    )
    return F.when(currency, F.concat(F.lit("unexpected currency "), unit)).when(
        other, F.concat(F.lit("unexpected unit "), F.coalesce(unit, F.lit("(none)")))
    )


def survey_records(raw: DataFrame, aliases: DataFrame) -> DataFrame:
    """Typed survey rows with ``problem``: NULL, or why the row cannot be used."""
    header = (F.col("V") == "Valor") & ~F.col("D2C").rlike(r"^\d+$")
    body = raw.where(~F.coalesce(header, F.lit(False)))
    named = resolve_crops(body, aliases, label="D4N", source="ibge")
    typed = named.withColumns({"number": survey_number("V"), "label": split_label("D1N")})
    # A missing field is named like any other bad value: a NULL text would read as "usable".
    named_value = lambda why, c: F.concat(F.lit(why), F.coalesce(F.col(c), F.lit("NULL")))
    holds = lambda test: F.coalesce(test, F.lit(False))
    problem = (
        F.when(~holds(F.col("D2C").isin(*VARIABLES)), named_value("unexpected variable ", "D2C"))
        .when(F.col("cultura").isNull(), named_value("unknown crop label ", "D4N"))
        .when(~holds(F.col("number.known")) | F.col("V").isNull(), named_value("unknown numeric token ", "V"))
        .when(F.col("label.uf").isNull(), named_value("unexpected municipality label ", "D1N"))
        .otherwise(_unit_problem())
    )
    return typed.withColumn("problem", problem)


def rejected_records(raw: DataFrame, aliases: DataFrame) -> DataFrame:
    return survey_records(raw, aliases).where("problem is not null")


def assemble_panel(raw: DataFrame, aliases: DataFrame, *, source_checksum: str) -> DataFrame:
    """Wide panel with quality flags, in one aggregation.

    The first unusable record, or a variable given twice for one key, fails the job.
    """
    records = survey_records(raw, aliases)
    usable = records.where(
        F.when(F.col("problem").isNull(), F.lit(True)).otherwise(
            F.raise_error(F.col("problem")).cast("boolean")
        )
    )
    cell = F.struct(
        F.lit(True).alias("present"), F.col("number.value").alias("value"),
        F.col("number.flag").alias("flag"), F.coalesce("MN", F.lit("")).alias("unit"),
    )
    cells = []
    for variable, (name, _) in VARIABLES.items():
        here = F.col("D2C") == variable
        cells += [F.max(F.when(here, cell)).alias(f"_{name}"), F.count_if(here).alias(f"_n_{name}")]
    wide = usable.groupBy(
        F.col("D1C").alias("codigo_ibge"), F.col("D3C").cast("int").alias("ano"), "cultura"
    ).agg(
        F.max(F.struct("label.municipio", "label.uf", "D4C")).alias("_about"), *cells
    )
    fields = [name for name, _ in VARIABLES.values()]
    wide = wide.where(
        F.when(F.greatest(*[F.col(f"_n_{f}") for f in fields]) <= 1, F.lit(True)).otherwise(
            F.raise_error(
                F.concat(F.lit("duplicate variable rows for "), "codigo_ibge", F.lit("/"), F.col("ano"))
            ).cast("boolean")
        )
    )
    value_field = VARIABLES[VALUE_VARIABLE][0]
    marks: list[Column] = []
    for f in fields:
        c = F.col(f"_{f}")
        absent = c.isNull()
        marks.append(F.when(absent, F.lit(f"{f}:{NO_VARIABLE}")))
        marks.append(F.when(c.flag.isNotNull(), F.concat(F.lit(f"{f}:"), c.flag)))
        if f != value_field:
            marks.append(F.when(~absent & c.value.isNull() & (c.unit == ""), F.lit(f"{f}:{NO_UNIT}")))
    money = F.col(f"_{value_field}")
    in_reais = money.unit == CURRENT_CURRENCY
    marks.append(
        F.when(money.value.isNotNull() & ~in_reais, F.lit(f"valor_producao_brl:{NOT_NORMALISED}"))
    )
    marks.append(
        F.when(F.col("_area_colhida_ha.value") > F.col("_area_plantada_ha.value"), F.lit(AREA_FLAG))
    )
    return wide.select(
        "codigo_ibge", F.col("_about.municipio").alias("municipio"), F.col("_about.uf").alias("uf"),
        "ano", "cultura", F.lit("not_available").alias("sistema_produtivo"),
        *[F.col(f"_{f}.value").alias(f) for f in fields],
        F.nullif(money.unit, F.lit("")).alias("valor_producao_unidade_original"),
        F.when(in_reais, money.value * 1000.0).alias("valor_producao_brl"),
        F.lit(PANEL_SOURCE).alias("source"), F.lit(PANEL_TABLE).alias("source_table"),
        F.lit("observed").alias("source_type"),
        F.format_string(
            "SIDRA:t5457:n6:%s:p%d:c782:%s", "codigo_ibge", "ano", F.col("_about.D4C")
        ).alias("source_reference"),
        F.lit(source_checksum).alias("source_dataset_checksum"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*marks)))).alias("quality_flags"),
    )


def checked_panel(panel: DataFrame) -> DataFrame:
    return require(panel, production_rules(), "production panel")


def upsert_panel(existing: DataFrame, new: DataFrame, *, verify: bool = True) -> DataFrame:
    """Existing panel with the rows of ``new`` replacing equal keys."""
    both = union_widening(
        existing.withColumn("_load", F.lit(0)), new.withColumn("_load", F.lit(1))
    )
    merged = keep_last(both, PANEL_KEY, ["_load"]).drop("_load")
    return require_unique(merged, PANEL_KEY, "production panel") if verify else merged
