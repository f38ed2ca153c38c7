import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from cropgrid.functions import columns as C
from cropgrid.functions.text import normalise_label, normalise_text, split_label, survey_number
from cropgrid.operators import quality
from cropgrid.plans import markets, panel, zoning
from cropgrid.sources.dimensions import crop_aliases, crop_dimension, listed_crops, resolve_crops

SUM = "a" * 64


def survey(code="1234567", year="2024", values=None, name="Município de Teste (DF)", crop="Soja (em grão)"):
    units = {"8331": "Hectares", "216": "Hectares", "214": "Toneladas", "112": "Quilogramas por Hectare", "215": "Mil Reais"}
    values = values or {"8331": "100", "216": "90", "214": "270", "112": "3000", "215": "450"}
    out = [("Município (Código)", "Município", "Variável (Código)", "Variável", "Ano", "Código", "Produto", "Unidade", "Valor")]
    for variable, v in values.items():
        v, unit = v if isinstance(v, tuple) else (v, units[variable])
        out.append((code, name, variable, "", year, "40124", crop, unit, v))
    return out


def build(spark, data):
    raw = spark.createDataFrame(data, "D1C string, D1N string, D2C string, D2N string, D3C string, D4C string, D4N string, MN string, V string")
    return panel.assemble_panel(raw, crop_aliases(spark), source_checksum=SUM)


def test_panel_row_and_contract(spark):
    row = one(panel.checked_panel(build(spark, survey())))
    assert (row["produtividade_kg_ha"], row["valor_producao_original"], row["valor_producao_brl"]) == (3000, 450, 450_000)
    assert (row["municipio"], row["uf"], row["quality_flags"]) == ("Município de Teste", "DF", [])
    assert row["source_reference"] == "SIDRA:t5457:n6:1234567:p2024:c782:40124"


def test_historic_currency_stays_unnormalised(spark):
    row = one(build(spark, survey(year="1974", values={
        "8331": "100", "216": "90", "214": "270", "112": "3000", "215": ("450", "Mil Cruzeiros")})))
    assert row["valor_producao_brl"] is None
    assert row["quality_flags"] == ["valor_producao_brl:HISTORICAL_CURRENCY_NOT_NORMALIZED"]


def test_special_tokens(spark):
    row = one(build(spark, survey(values={"8331": "-", "216": "0", "214": "X", "112": "..", "215": ("...", "")})))
    assert (row["area_plantada_ha"], row["area_colhida_ha"]) == (0.0, 0.0)
    assert row["producao_t"] is None and row["produtividade_kg_ha"] is None and row["valor_producao_original"] is None
    assert row["quality_flags"] == [
        "area_colhida_ha:SIDRA_ROUNDED_ZERO", "area_plantada_ha:SIDRA_ABSOLUTE_ZERO", "producao_t:SIDRA_SUPPRESSED",
        "produtividade_kg_ha:SIDRA_NOT_APPLICABLE", "valor_producao_original:SIDRA_NOT_AVAILABLE",
    ]


def test_missing_variable_and_area_flag(spark):
    row = one(build(spark, survey(values={"8331": "90", "216": "100", "214": "1"})))
    assert "AREA_HARVESTED_GT_PLANTED" in row["quality_flags"]
    assert "produtividade_kg_ha:MISSING_VARIABLE" in row["quality_flags"]


@pytest.mark.parametrize("values, crop, text", [
    ({"8331": ("1", "Toneladas")}, "Soja (em grão)", "unexpected unit"),
    ({"999": ("1", "x")}, "Soja (em grão)", "unexpected variable"),
    ({"8331": "12a"}, "Soja (em grão)", "unknown numeric token"),
    ({"215": ("1", "Dollar")}, "Soja (em grão)", "unexpected currency"),
    ({"8331": "1"}, "Cacau", "unknown crop label"),
])
def test_unusable_records_fail_and_are_listed(spark, values, crop, text):
    data = survey(values=values, crop=crop)
    with pytest.raises(Exception, match=text):
        build(spark, data).collect()
    raw = spark.createDataFrame(data, "D1C string, D1N string, D2C string, D2N string, D3C string, D4C string, D4N string, MN string, V string")
    assert text in one(panel.rejected_records(raw, crop_aliases(spark)))["problem"]


def test_duplicate_variable_fails(spark):
    data = survey()
    with pytest.raises(Exception, match="duplicate variable"):
        build(spark, data + data[1:2]).collect()


def test_labels(spark):
    df = spark.createDataFrame([("Sorriso (MT)",), ("Alta Floresta D'Oeste - RO",), ("Sorriso",)], "l string")
    got = [r["s"] for r in rows(df.select(split_label("l").alias("s")))]
    assert got == [
        {"municipio": "Sorriso", "uf": "MT"}, {"municipio": "Alta Floresta D'Oeste", "uf": "RO"}, {"municipio": None, "uf": None}]


def test_survey_letters_are_ranges(spark):
    row = one(spark.createDataFrame([("C",)], "v string").select(survey_number("v").alias("n")))["n"]
    assert row == {"value": None, "flag": "SIDRA_VALUE_RANGE_OR_SUPPRESSED", "known": True}


@pytest.mark.parametrize("text, expected", [
    ("  Soja (em GRÃO) ", "soja em grao"), ("STRAßE ﬁx", "strasse fix"), ("½ é Ⅷ", "1 2 e viii"), ("İstanbul", "istanbul"),
    ("日本 ㎏", "kg"), ("", ""),
])
def test_normaliser_matches_driver_rule(spark, text, expected):
    got = one(spark.createDataFrame([(text,)], "t string").select(normalise_text("t").alias("n")))["n"]
    assert got == expected == normalise_label(text)


def test_crop_resolution_and_dimension(spark):
    df = spark.createDataFrame([("ALGODÃO",), ("trigo em grãos",), ("FARELO",)], "l string")
    got = {r["l"]: r["cultura"] for r in rows(resolve_crops(df, crop_aliases(spark), label="l", source="conab"))}
    assert got == {"ALGODÃO": "algodao", "trigo em grãos": "trigo", "FARELO": None}
    dim = crop_dimension(spark)
    assert dim.count() == 6 and [r["canonical_name"] for r in rows(listed_crops(dim))] == ["soja"]
    assert listed_crops(dim, include_planned=True).count() == 6
    assert quality.split_by_rules(dim, quality.crop_rules())[1].count() == 0


def test_alias_collision_is_rejected(spark):
    base = dict(crop_id=1, canonical_name="a", aliases={"x": ["same"]})
    with pytest.raises(ValueError, match="stands for"):
        crop_aliases(spark, [base, {**base, "crop_id": 2, "canonical_name": "b"}])


def test_costs(spark):
    base = {c: "1" for c in (
        "ano_mes", "id_produto", "safra", "unidade_comercializacao", "vlr_custo_variavel_unidade", "vlr_custo_fixo_unidade",
        "vlr_renda_fator_unidade")}
    good = dict(base, empreendimento=" x ", ano="2024", mes="3", produto=" soja ", uf="MT", municipio="SORRISO", cod_ibge="5107925",
                vlr_custo_variavel_ha="4000,00", vlr_custo_fixo_ha="800", vlr_renda_fator_ha="200")
    data = [good, dict(good, produto="FARELO DE SOJA"), dict(good, cod_ibge="n/d"), dict(good, vlr_renda_fator_ha="junk")]
    row = one(markets.clean_costs(spark.createDataFrame(data), source_checksum=SUM))
    assert (row["custo_operacional_brl_ha"], row["custo_total_brl_ha"], row["codigo_ibge_fonte"]) == (4800, 5000, 5107925)


def test_prices(spark):
    good = dict(produto="SOJA", ano="2025", mes="1", uf="MT", dsc_nivel_comercializacao="PRODUTOR", valor_produto_kg="2,10",
                nom_municipio=" Sorriso ", cod_ibge="5107925")
    df = spark.createDataFrame([good, dict(good, produto="FARELO DE SOJA"), dict(good, valor_produto_kg="0")])
    row = one(markets.clean_prices(df, coverage_level="municipality", source_checksum=SUM))
    assert (row["preco_brl_kg"], row["municipio_fonte"]) == (2.1, "Sorriso")
    state = one(markets.clean_prices(df.drop("nom_municipio", "cod_ibge"), coverage_level="state", source_checksum=SUM))
    assert state["codigo_ibge_fonte"] is None and state["municipio_fonte"] is None
    with pytest.raises(ValueError):
        markets.clean_prices(df, coverage_level="country", source_checksum=SUM)


def _zoning(spark, **changes):
    row = {c: "1" for c in zoning.WINDOW_FIELDS} | {f"dec{i}": "0" for i in range(1, 37)}
    row |= dict(Nome_cultura=" Soja ", SafraIni="2026", SafraFin="2027", geocodigo="5107925", UF="MT", dec1="20", dec3="30") | changes
    return spark.createDataFrame([row])


def test_windows_and_tri_state(spark):
    windows = zoning.planting_windows(_zoning(spark), source_checksum=SUM)
    assert sorted((r["decendio"], r["nivel_risco"]) for r in rows(windows)) == [(1, 20), (3, 30)]
    places = spark.createDataFrame(
        [("5107925", "a", "MT"), ("5100001", "b", "MT"), ("1200001", "c", "AC")], "codigo_ibge string, municipio string, uf string")
    got = {r["codigo_ibge"]: r for r in rows(zoning.zoning_coverage(windows, places))}
    assert [got[c]["zarc_status"] for c in ("5107925", "5100001", "1200001")] == ["eligible", "not_eligible", "not_available"]
    assert got["5107925"]["decendios_elegiveis"] == [1, 3] and got["5107925"]["melhor_nivel_risco"] == 20
    assert one(zoning.zoning_report(windows, zoning.zoning_coverage(windows, places)))["risk_levels"] == [20, 30]


def test_rules(spark):
    good = dict(codigo_ibge="1234567", municipio="a", uf="MT", regiao="Norte", latitude_centroid=-10.0, longitude_centroid=-50.0)
    df = spark.createDataFrame([good, dict(good, codigo_ibge="123456"), dict(good, latitude_centroid=-100.0), dict(good, municipio=" ")])
    valid, rejected = quality.split_by_rules(df, quality.location_rules())
    assert valid.count() == 1
    assert sorted(r["violations"][0] for r in rows(rejected)) == ["codigo_ibge", "latitude_centroid", "municipio"]
    with pytest.raises(Exception, match="breaks rules"):
        quality.require(df, quality.location_rules(), "location").collect()
    with pytest.raises(ValueError, match="duplicate keys"):
        quality.require_unique(df.union(df), ["codigo_ibge"])


@pytest.mark.parametrize("nature, method, ok", [("observed", None, True), ("interpolated", None, False), ("estimated", "", False),
                                                ("predicted", "model", True), ("guessed", "x", False)])
def test_provenance_rules(spark, nature, method, ok):
    df = spark.createDataFrame([(nature, "src", "ref", method, 0.5)], "data_nature string, source string, source_reference string, method string, confidence double")
    assert (quality.split_by_rules(df, quality.provenance_rules())[0].count() == 1) is ok


def test_column_helpers(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (2.0,)], "x double")
    assert [r[0] for r in df.select(C.is_finite("x")).collect()] == [False, False, False, True]
    years = spark.createDataFrame([(2023,), (2024,)], "y int")
    assert [r[0] for r in years.select(C.season_hours("y")).collect()] == [242 * 24, 243 * 24]
    clipped = df.select(C.clip(C.finite_or_null("x"), 0.0, 1.0).alias("c"))
    assert [r["c"] for r in rows(clipped)] == [None, None, None, 1.0]
    text = spark.createDataFrame([("1.0f",), ("1d",), ("1,5",), ("",), ("1e3",)], "t string")
    assert [r[0] for r in text.select(C.decimal_comma("t")).collect()] == [None, None, 1.5, None, 1000.0]
    assert one(spark.range(1).select(F.to_json(F.struct(C.code7(F.lit(51)).alias("c"))).alias("j")))["j"] == '{"c":"0000051"}'
