"""Queries over landed files and stored tables: given tables are written in a raw format, and read back by the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropgrid import jobs
from cropgrid.config import CROPS
from cropgrid.operators.merge import insert_only
from cropgrid.operators.quality import join_offenders
from cropgrid.plans import audit, station
from cropgrid.session import shared_folder
from cropgrid.sources import archive, dimensions, readers, writers

from .climate_queries import NEAREST, STATION_CHAIN
from .sqltext import adequate, n, r, rs
from .views import plain, read, view, with_views

#: Records of a landed page or features of a landed mesh: one file each.
PAGE = 2000


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _pages(df: DataFrame, record, order: list[str]) -> DataFrame:
    """`value`: JSON arrays of up to about PAGE records, by a hash of the row."""
    count = F.greatest(F.lit(1), F.ceil(F.lit(df.count() / PAGE))).cast("int")
    paged = df.select(F.pmod(F.xxhash64(*order), count).alias("page"), F.to_json(record, {"ignoreNullFields": "false"}).alias("record"))
    return paged.groupBy("page").agg(F.collect_list("record").alias("records"))


def _files(pages: DataFrame, value, spark, name: str) -> str:
    """One file for each page."""
    path = _folder(spark, name)
    pages.select(value.alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)
    return path


def survey_pages(spark, sf_dir):
    """The survey as JSON pages, each headed by a record of column titles, read back without the titles."""
    survey = view(spark, sf_dir, "survey").withColumn("D2N", F.lit("variável"))
    fields = readers.SURVEY_FIELDS
    head = F.to_json(F.struct(*[F.lit("Valor" if c == "V" else f"{c} (título)").alias(c) for c in fields]))
    pages = _pages(survey, F.struct(*fields), fields)
    path = _files(pages, F.concat(F.lit("["), head, F.lit(","), F.array_join("records", ","), F.lit("]")), spark, "survey")
    return plain(readers.survey_json(spark, path).where("V <> 'Valor'"))


SURVEY_SQL = with_views("""
select D1C, D1N, D2C, 'variável' as D2N, cast(D3C as varchar) as D3C, D4C, D4N, MN, V from survey""")


def municipality_pages(spark, sf_dir):
    """Municipalities as the nested records of the public list, read back flat."""
    m = view(spark, sf_dir, "municipalities")
    state = F.struct(F.struct(F.col("uf").alias("sigla"), F.struct(F.concat(F.lit(" "), "regiao", F.lit(" ")).alias("nome")).alias("regiao")).alias("UF"))
    record = F.struct(
        F.col("codigo_ibge").cast("long").alias("id"), F.concat(F.lit("  "), "municipio").alias("nome"),
        F.struct(state.alias("regiao-intermediaria")).alias("regiao-imediata"))
    path = _files(_pages(m, record, ["codigo_ibge"]), F.concat(F.lit("["), F.array_join("records", ","), F.lit("]")), spark, "municipalities")
    return plain(readers.municipalities_json(spark, path))


MUNICIPALITY_SQL = with_views("select cast(cast(codigo_ibge as bigint) as varchar) as codigo_ibge, municipio, uf, regiao from municipalities")


def mesh_locations(spark, sf_dir):
    """Boxes around the municipalities as meshes, joined to the municipalities as the location dimension."""
    m = view(spark, sf_dir, "municipalities").withColumn("codigo_ibge", F.concat(F.lit("1"), F.lpad(F.substring("codigo_ibge", 2, 6), 6, "0")))
    x, y = F.col("longitude_centroid"), F.col("latitude_centroid")
    corner = lambda dx, dy: F.array(x + dx, y + dy)
    ring = F.array(corner(-0.5, -0.25), corner(0.5, -0.25), corner(0.5, 0.25), corner(-0.5, 0.25), corner(-0.5, -0.25))
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct(F.col("codigo_ibge").alias("codarea")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    pages = _pages(m.where("latitude_centroid is not null"), feature, ["codigo_ibge"])
    value = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join("records", ","), F.lit("]}"))
    mesh = readers.mesh_geojson(spark, _files(pages, value, spark, "mesh"))
    towns = m.select("codigo_ibge", "municipio", "uf", "regiao").withColumn("uf", F.translate("uf", "0123456789", "ABCDEFGHIJ"))
    return plain(readers.build_locations(towns, mesh, check=False).select(
        "codigo_ibge", "municipio", "uf", "latitude_centroid", "longitude_centroid", "source_reference", "quality_flags"))


MESH_SQL = with_views(f"""
select '1' || substr(codigo_ibge, 2, 6) as codigo_ibge, municipio, translate(uf, '0123456789', 'ABCDEFGHIJ') as uf,
  {rs('latitude_centroid', 'longitude_centroid')},
  case when latitude_centroid is null then 'IBGE Localidades v1; geometry unavailable in Malhas v3'
    else 'IBGE Localidades v1 + Malhas v3 (qualidade=minima, intrarregiao=municipio)' end as source_reference,
  case when latitude_centroid is null then 'MISSING_OFFICIAL_GEOMETRY' else '' end as quality_flags from municipalities""")


def windows_export(spark, sf_dir):
    """Costs as a semicolon export in windows-1252, with null tokens and letters beyond ASCII."""
    costs = view(spark, sf_dir, "costs").select(
        F.concat(F.lit("“Município” "), "municipio_fonte").alias("município"), "uf",
        F.when(F.col("mes") % 4 == 0, F.lit("null")).otherwise(F.concat("ano", F.lit("/"), "mes")).alias("ano_mes"),
        F.concat(F.floor("custo_total_brl_ha").cast("string"), F.lit(",5")).alias("preço €"))
    path = _folder(spark, "export")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    costs.write.option("sep", ";").option("header", True).option("encoding", "windows-1252").option("escapeQuotes", False).csv(path)
    found = readers.delimited(spark, path)
    return plain(found.toDF("municipio", "uf", "ano_mes", "preco"))


EXPORT_SQL = with_views("""
select '“Município” ' || municipio_fonte as municipio, uf, case when mes % 4 <> 0 then ano || '/' || mes end as ano_mes,
  cast(floor(custo_total_brl_ha) as bigint) || ',5' as preco from costs""")


def zoning_export(spark, sf_dir):
    """The zoning table as UTF-8 text whose first title bears a byte-order mark."""
    wide = view(spark, sf_dir, "zoning_wide")
    fields = readers.ZONING_FIELDS
    rows = wide.select(*[(F.col(c).cast("string") if c in wide.columns else F.lit("")).alias(c) for c in fields])
    path = _folder(spark, "zoning")
    rows.toDF("﻿" + fields[0], *fields[1:]).write.option("sep", ";").option("header", True).option("ignoreLeadingWhiteSpace", False) \
        .option("ignoreTrailingWhiteSpace", False).csv(path)
    return plain(readers.zoning_csv(spark, path))


_wide = {"Nome_cultura", "SafraIni", "SafraFin", "Cod_Cultura", "Cod_Ciclo", "Cod_Solo", "geocodigo", "UF", "Cod_Outros_Manejos",
         "Nome_Outros_Manejos", "Portaria"} | {f"dec{i}" for i in range(1, 37)}
ZONING_SQL = with_views(f"""
select {", ".join(f"cast({c} as varchar) as {c}" if c in _wide else f"cast(null as varchar) as {c}" for c in readers.ZONING_FIELDS)} from zoning_wide""")


def _archives(spark, sf_dir) -> str:
    """Yearly archives of hourly files in the shared folder: one member for each kind of event, written by one task a year.

    A member has an hour a line, so a year bounds it.
    """
    u, c = F.col("u"), F.col("c")
    hours = read(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(
        F.sum("user_id").alias("u"), F.count(F.lit(1)).alias("c"))
    number = lambda e, tenth: F.concat((e).cast("string"), F.lit(","), (tenth).cast("string"))
    fields = {0: F.date_format("hour", "yyyy/MM/dd"), 1: F.date_format("hour", "HH00 'UTC'"), 2: number(c % 50, u % 10), 6: number(u % 3000, c % 10),
              7: number(u % 40, u % 10), 9: number(u % 40 + 5, u % 10), 10: number(u % 40 - 5, u % 10), 15: number(u % 101, F.lit(0)), 18: number(c % 60, c % 10)}
    line = F.concat_ws(";", *[fields.get(i, F.lit("")) for i in range(19)])
    members = hours.groupBy("event_type", F.year("hour").alias("year")).agg(F.array_sort(F.collect_list(line)).alias("lines")).select(
        "year", F.concat(F.lit("data/"), "event_type", F.lit(".CSV")).alias("member"),
        F.concat_ws("\r\n", F.lit("REGIÃO:;CO"), F.lit("UF:;MT"), F.concat(F.lit("ESTAÇÃO:;"), "event_type"), F.concat(F.lit("CODIGO (WMO):;"), "event_type"),
                    F.lit("LATITUDE:;-12,5"), F.lit("LONGITUDE:;-55,7"), F.lit("ALTITUDE:;379,1"), F.lit("DATA DE FUNDACAO:;2001-01-01"),
                    F.lit("Data;Hora UTC;" + ";".join(f"v{i}" for i in range(2, 19))), F.array_join("lines", "\r\n")).alias("text"))
    path = _folder(spark, "archives")

    def packed(batches):
        import zipfile

        from cropgrid.sources.archive import opened_store

        store, at = opened_store(path)
        store.create_dir(at, recursive=True)
        now, file, pack = None, None, None
        for batch in batches:
            for year, member, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if year != now:
                    if pack:
                        pack.close()
                        file.close()
                    now, file = year, store.open_output_stream(f"{at}/{year}.zip")
                    pack = zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED)
                pack.writestr(member, text.encode("latin1"))
            yield batch.select(["year", "member"])
        if pack:
            pack.close()
            file.close()

    written = members.repartition("year").sortWithinPartitions("year", "member").mapInArrow(packed, "year int, member string")
    if not written.count():
        raise ValueError("there are no hours to pack")
    return path


def archive_days(spark, sf_dir):
    """Daily weather from yearly archives, read by ranges of members."""
    members = archive.member_ranges(spark, _archives(spark, sf_dir), range_bytes=1 << 20)
    days = station.archive_daily(archive.checked_readings(members), source_checksum="a" * 64)
    return plain(days)


_value = lambda whole, tenth: f"({whole} + ({tenth}) / 10e0)"
ARCHIVE_SQL = f"""
select code as station_code, code as station_name, 'MT' as station_uf, -12.5::double as station_latitude, -55.7::double as station_longitude,
  379.1::double as station_altitude_m, cast(data as varchar) as data, {r('coalesce(sum(p), 0)', 'rain_mm')}, count(p) as rain_observations,
  {r('avg(t)', 'mean_temp_c')}, count(t) as temp_observations, {r('max(x)', 'max_temp_c')}, {r('min(m)', 'min_temp_c')}, {r('avg(h)', 'mean_humidity_pct')},
  count(h) as humidity_observations, {r('coalesce(sum(s), 0)', 'radiation_kj_m2')}, count(s) as radiation_observations, {r('avg(w)', 'mean_wind_m_s')},
  count(w) as wind_observations, 'observed' as data_nature, 'INMET automatic station annual archive' as source, repeat('a', 64) as source_dataset_checksum
from (select event_type as code, cast(hour as date) as data, {_value('c % 50', 'u % 10')} as p, {_value('u % 3000', 'c % 10')} as s,
    {_value('u % 40', 'u % 10')} as t, {_value('u % 40 + 5', 'u % 10')} as x,
    case when u % 40 - 5 < 0 then u % 40 - 5 - (u % 10) / 10e0 else u % 40 - 5 + (u % 10) / 10e0 end as m,
    (u % 101)::double as h, {_value('c % 60', 'c % 10')} as w
  from (select event_type, date_trunc('hour', ts) as hour, cast(sum(user_id) as bigint) as u, count(*) as c from events group by 1, 2))
group by 1, 2, 3, data"""


def climate_job(spark, sf_dir):
    """Stored days to station seasons, municipalities and merged climate, and what the manifests tell of them."""
    root = _folder(spark, "store")
    for name, table in ((jobs.DAILY, "station_days"), (jobs.LOCATIONS, "municipalities"), (jobs.GRID, "grid_climate")):
        writers.replace_table(view(spark, sf_dir, table), root, name)
    told = jobs.rebuild_climate(spark, root)
    number = lambda c: F.get_json_object("quality", f"$.{c}").cast("long").alias(c)
    names = ("season_year_min", "season_year_max", "within_radius_rows", "outside_radius_rows", "adequate_rows", "reanalysis_rows")
    return told.select("dataset", "rows", F.size("inputs").cast("long").alias("inputs"), *[number(c) for c in names])


_close = "distance_to_station_km <= 250"
JOB_SQL = with_views(f"""
with near as (
  select codigo_ibge, season_year, case when {_close} then rain_crop_cycle_mm end as rain_crop_cycle_mm, case when {_close} then mean_temp_c end as mean_temp_c,
    case when {_close} then season_coverage end as season_coverage, {_close} as close from nearest),
whole as (
  select n.codigo_ibge, n.season_year, {adequate('n.')} as own, {adequate('g.')} as other, close
  from near n left join grid_climate g on g.codigo_ibge = n.codigo_ibge and g.season_year = n.season_year)
select 'station_season' as dataset, count(*) as rows, 1::bigint as inputs, {n('min(season_year)', 'season_year_min')}, {n('max(season_year)', 'season_year_max')},
  null::bigint as within_radius_rows, null::bigint as outside_radius_rows, null::bigint as adequate_rows, null::bigint as reanalysis_rows from seasons
union all select 'station_climate', count(*), 2, min(season_year), max(season_year), count(*) filter (where close), count(*) filter (where not close), null, null from whole
union all select 'climate', count(*), 2, min(season_year), max(season_year), null, null, count(*) filter (where own or other),
  count(*) filter (where not own and other) from whole""".replace("\nwith near as", "\nselect * from (with near as") + ")", **STATION_CHAIN, nearest=NEAREST)


def stored_versions(spark, sf_dir):
    """Tables replaced twice, with a fingerprint that follows the rows and not their order, and the audit of their manifests."""
    root = _folder(spark, "versions")
    orders, parts = (read(spark, sf_dir, t) for t in ("orders", "part"))
    for df in (orders.where("o_orderkey % 2 = 0"), orders, orders.orderBy(F.desc("o_orderkey"))):
        writers.replace_table(df, root, "orders", counters={"most": F.max("o_orderkey")})
    for df in (parts, parts.limit(1)):
        writers.replace_table(df, root, "part")
    told = writers.manifests(spark, root).groupBy("dataset").agg(
        F.count(F.lit(1)).alias("versions"), F.count_distinct("fingerprint").alias("contents"), F.count_distinct("path").alias("paths"),
        F.max_by("rows", "written_at").alias("rows"), F.max(F.get_json_object("quality", "$.most").cast("long")).alias("most"))
    names = writers.dataset_versions(spark, root, ["orders", "part"]).select(F.explode("dataset_versions").alias("dataset", "version"))
    problems = audit.manifest_audit(spark, root, ["orders", "part", "absent"]).groupBy("dataset").agg(F.max("problem").alias("problem"))
    known = told.join(names, "dataset").select("*", F.col("version").startswith(F.concat("dataset", F.lit("-"))).alias("named")).drop("version")
    return known.join(problems, "dataset", "full")


VERSIONS_SQL = """
select 'orders' as dataset, 3::bigint as versions, 2::bigint as contents, 3::bigint as paths, count(*) as rows, cast(max(o_orderkey) as bigint) as most,
  true as named, null::varchar as problem from orders
union all select 'part', 2, 2, 2, least(count(*), 1), null, true, null from part
union all select 'absent', null, null, null, null, null, null, 'manifest_missing'"""


def artifact_registration(spark, sf_dir):
    """Texts as artifacts under names made from their content, of which half are known; a second run adds nothing."""
    d = read(spark, sf_dir, "documents")
    checksum = F.sha2(F.coalesce("text", F.lit("")), 256)
    records = d.select(
        F.concat("source", F.lit("-"), F.substring(checksum, 1, 16), F.lit(".txt")).alias("file_name"), checksum.alias("checksum_sha256"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"), "lang").where("file_name is not null")
    known = records.where("substr(checksum_sha256, 1, 1) < '8'")
    added = insert_only(records, known, ["file_name"], "checksum_sha256")
    again = insert_only(records, known.unionByName(added), ["file_name"], "checksum_sha256").groupBy("file_name").agg(F.count(F.lit(1)).alias("again"))
    return added.join(again, "file_name", "left").withColumn("again", F.coalesce("again", F.lit(0)))


REGISTER_SQL = """
select source || '-' || substr(sum, 1, 16) || '.txt' as file_name, sum as checksum_sha256, min(bytes) as bytes, min(lang) as lang, 0::bigint as again
from (select *, sha256(coalesce(text, '')) as sum, strlen(coalesce(text, '')) as bytes from documents)
where source is not null and substr(sum, 1, 1) >= '8' group by 1, 2"""


def join_cardinality(spark, sf_dir):
    """Keys that keep the seasons of a municipality from being facts of it, and the harvest rows that a join would multiply."""
    return plain(join_offenders(view(spark, sf_dir, "harvests"), view(spark, sf_dir, "station_climate"), ["codigo_ibge"]))


CARDINALITY_SQL = with_views("""
select c.codigo_ibge, c.copies, coalesce(h.n, 0) as rows_hit
from (select codigo_ibge, count(*) as copies from station_climate group by 1 having count(*) > 1) c
left join (select codigo_ibge, count(*) as n from harvests group by 1) h on h.codigo_ibge = c.codigo_ibge""")


def crop_records(spark, sf_dir):
    """The crop list beside the survey's rows of each crop: labels resolved, crops that are only planned included."""
    survey = view(spark, sf_dir, "survey").select("D4N")
    found = dimensions.resolve_crops(survey, dimensions.crop_aliases(spark), label="D4N", source="ibge").groupBy("cultura").agg(F.count(F.lit(1)).alias("rows"))
    crops = dimensions.crop_dimension(spark)
    active = dimensions.listed_crops(crops).select("crop_id", F.lit(True).alias("listed"))
    return plain(dimensions.listed_crops(crops, include_planned=True).join(active, "crop_id", "left")
                 .join(found.withColumnRenamed("cultura", "canonical_name"), "canonical_name", "left")
                 .select("crop_id", "canonical_name", F.coalesce("listed", F.lit(False)).alias("listed"), F.coalesce("rows", F.lit(0)).alias("rows")))


CROPS_SQL = with_views(" union all ".join(
    f"select {c['crop_id']}::bigint as crop_id, '{c['canonical_name']}' as canonical_name, {str(c['active']).lower()} as listed, "
    f"{'(select count(*) from survey)' if c['canonical_name'] == 'soja' else '0::bigint'} as rows" for c in CROPS))


QUERIES = {
    "survey_pages": (survey_pages, SURVEY_SQL),
    "municipality_pages": (municipality_pages, MUNICIPALITY_SQL),
    "mesh_locations": (mesh_locations, MESH_SQL),
    "windows_export": (windows_export, EXPORT_SQL),
    "zoning_export": (zoning_export, ZONING_SQL),
    "archive_days": (archive_days, ARCHIVE_SQL),
    "climate_job": (climate_job, JOB_SQL),
    "stored_versions": (stored_versions, VERSIONS_SQL),
    "artifact_registration": (artifact_registration, REGISTER_SQL),
    "join_cardinality": (join_cardinality, CARDINALITY_SQL),
    "crop_records": (crop_records, CROPS_SQL),
}
