"""Readers of landed raw files with explicit all-text schemas; typing happens in the plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import null_tokens
from ..functions.geo import centroid
from ..operators.quality import fail_if_any, location_rules, require

# Columns of the production survey records, raw exports and the zoning table.
SURVEY_FIELDS = ["D1C", "D1N", "D2C", "D2N", "D3C", "D4C", "D4N", "MN", "V"]
COST_FIELDS = [
    "empreendimento", "ano", "mes", "ano_mes", "produto", "id_produto", "safra", "uf", "municipio",
    "cod_ibge", "unidade_comercializacao", "vlr_custo_variavel_ha", "vlr_custo_variavel_unidade",
    "vlr_custo_fixo_ha", "vlr_custo_fixo_unidade", "vlr_renda_fator_ha", "vlr_renda_fator_unidade",
]
ZONING_FIELDS = [
    "Nome_cultura", "SafraIni", "SafraFin", "Cod_Cultura", "Cod_Ciclo", "Cod_Solo", "geocodigo", "UF",
    "municipio", "Cod_Clima", "Nome_Clima", "Cod_Outros_Manejos", "Nome_Outros_Manejos",
    "Produtividade", "Cod_NM", "Cod_Munic", "Cod_Meso", "Cod_Micro", "Portaria",
    *[f"dec{i}" for i in range(1, 37)],
]
NULL_TOKENS = ("", "null", "NULL")
MISSING_GEOMETRY = "MISSING_OFFICIAL_GEOMETRY"
LOCATION_SOURCE = "IBGE/Localidades+Malhas"
WITH_MESH = "IBGE Localidades v1 + Malhas v3 (qualidade=minima, intrarregiao=municipio)"
WITHOUT_MESH = "IBGE Localidades v1; geometry unavailable in Malhas v3"


def table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def survey_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Survey pages: JSON arrays of text records, the first of which is a header."""
    schema = ", ".join(f"{c} string" for c in SURVEY_FIELDS)
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    keyed = F.col("D1C").isNotNull() & F.col("V").isNotNull()
    return rows.where(
        F.when(keyed, F.lit(True)).otherwise(
            F.raise_error(F.lit("survey record lacks its key columns")).cast("boolean")
        )
    )


def delimited(
    spark: SparkSession, path: str | list[str], *, encoding: str = "windows-1252",
    fields: list[str] | None = None, keep: list[str] | None = None, tokens=NULL_TOKENS,
) -> DataFrame:
    """Semicolon export as text columns, with null tokens removed.

    The header names the columns. ``fields`` instead renames by position, for files whose first
    header starts with a byte-order mark. Rows of another width fail the read.
    """
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # windows-1252 is refused otherwise
    reader = spark.read.option("sep", ";").option("header", True).option("mode", "FAILFAST")
    raw = reader.option("encoding", encoding).option("enforceSchema", False).csv(path)
    raw = raw.toDF(*fields) if fields and len(fields) == len(raw.columns) else raw
    if keep:
        raw = raw.select(*keep)
    return raw.select(*[null_tokens(F.col(c), tokens).alias(c) for c in raw.columns])


def zoning_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Zoning table in UTF-8; its first column may carry a byte-order mark. Rows of another width fail the read."""
    raw = spark.read.option("sep", ";").option("header", True).option("mode", "FAILFAST").csv(path)
    named = raw.toDF("Nome_cultura", *raw.columns[1:])
    return named.select(*[null_tokens(F.col(c), ("",)).alias(c) for c in named.columns])


def municipalities_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Municipality list with state and region taken from its nested regions."""
    unit = "UF: struct<sigla: string, regiao: struct<nome: string>>"
    schema = (
        f"id long, nome string, `regiao-imediata` struct<`regiao-intermediaria`: struct<{unit}>>"
    )
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    state = "`regiao-imediata`.`regiao-intermediaria`.UF"
    return rows.select(
        F.col("id").cast("string").alias("codigo_ibge"), F.trim("nome").alias("municipio"),
        F.col(f"{state}.sigla").alias("uf"), F.trim(F.col(f"{state}.regiao.nome")).alias("regiao"),
    )


def mesh_geojson(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Features of state meshes as ``codarea, geometry`` text; geometry keeps its own JSON."""
    text = spark.read.option("wholetext", True).text(path)
    parts = F.from_json("value", "struct<type: string, features: array<string>>")
    parsed = text.select(parts.alias("p"))
    whole = F.when(F.col("p.type") == "FeatureCollection", F.col("p.features")).otherwise(
        F.raise_error(F.lit("mesh is not a FeatureCollection")).cast("array<string>")
    )
    features = parsed.select(F.explode(whole).alias("f"))
    code = F.get_json_object("f", "$.properties.codarea")
    shape = F.get_json_object("f", "$.geometry")
    usable = code.isNotNull() & (code != "") & shape.startswith("{")
    return features.where(
        F.when(usable, F.lit(True)).otherwise(F.raise_error(F.lit("invalid mesh feature")).cast("boolean"))
    ).select(code.alias("codarea"), shape.alias("geometry"))


def build_locations(municipalities: DataFrame, mesh: DataFrame, *, check: bool = True) -> DataFrame:
    """Location dimension with centroids; a missing mesh is flagged, an empty one is an error."""
    if check:
        for df, key in ((municipalities, "codigo_ibge"), (mesh, "codarea")):
            fail_if_any(df.groupBy(key).count().where("count > 1"), f"duplicate {key}")
    shapes = mesh.select(
        F.col("codarea").alias("codigo_ibge"), "geometry", centroid("geometry").alias("_at")
    )
    joined = municipalities.join(shapes, "codigo_ibge", "left")
    has = F.col("geometry").isNotNull()
    whole = joined.where(
        F.when(~has | F.col("_at").isNotNull(), F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("empty geometry for "), "codigo_ibge")).cast("boolean")
        )
    )
    dim = whole.select(
        "codigo_ibge", "municipio", "uf", "regiao",
        F.col("_at.latitude").alias("latitude_centroid"),
        F.col("_at.longitude").alias("longitude_centroid"), "geometry",
        F.lit(LOCATION_SOURCE).alias("source"),
        F.when(has, WITH_MESH).otherwise(WITHOUT_MESH).alias("source_reference"),
        F.when(has, F.array().cast("array<string>")).otherwise(F.array(F.lit(MISSING_GEOMETRY))).alias("quality_flags"),
    )
    return require(dim, location_rules(), "location")


def search_locations(locations: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Locations whose name or code contains the text, in name order."""
    if not 2 <= len(query) <= 80 or not 1 <= limit <= 100:
        raise ValueError("query needs 2..80 characters and limit 1..100")
    wanted = F.lit(query.strip().lower())
    hit = F.contains(F.lower("municipio"), wanted) | F.contains(F.col("codigo_ibge").cast("string"), wanted)
    return locations.where(hit).select("codigo_ibge", "municipio", "uf").orderBy(
        "municipio", "uf", "codigo_ibge"
    ).limit(limit)


def pick_file(listing: DataFrame, *, last: bool = True) -> DataFrame:
    """Per directory the last (or first) file by name: ``directory, path``.

    JSON and TXT folders keep snapshots, newest name last; ZIP and CSV folders keep one file.
    """
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    pick = F.max("path") if last else F.min("path")
    return listing.groupBy(folder.alias("directory")).agg(pick.alias("path"))


def list_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    )
