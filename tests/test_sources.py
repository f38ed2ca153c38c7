import json
import zipfile

import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from cropgrid.plans import audit, station
from cropgrid.sources import archive, readers, writers


def test_survey_json(spark, tmp_path):
    fields = readers.SURVEY_FIELDS
    page = [dict.fromkeys(fields, "x") | {"V": "Valor"}, dict.fromkeys(fields, "1") | {"NC": "6"}]
    (tmp_path / "p.json").write_text(json.dumps(page))
    assert [r["V"] for r in rows(readers.survey_json(spark, str(tmp_path)))] == ["Valor", "1"]
    (tmp_path / "q.json").write_text(json.dumps([{"V": "1"}]))
    with pytest.raises(Exception, match="key columns"):
        readers.survey_json(spark, str(tmp_path)).collect()


def test_windows_1252_export(spark, tmp_path):
    (tmp_path / "c.txt").write_bytes("produto;uf;preço\nSOJA “fina”;MT;null\nTRIGO;;2,5\n".encode("cp1252"))
    got = rows(readers.delimited(spark, str(tmp_path / "c.txt")))
    assert got == [{"produto": "SOJA “fina”", "uf": "MT", "preço": None}, {"produto": "TRIGO", "uf": None, "preço": "2,5"}]
    (tmp_path / "bad.txt").write_bytes(b"a;b\n1;2;3\n")
    with pytest.raises(Exception):
        readers.delimited(spark, str(tmp_path / "bad.txt")).collect()


def test_zoning_csv_with_byte_order_mark(spark, tmp_path):
    head = ";".join(readers.ZONING_FIELDS)
    (tmp_path / "z.csv").write_bytes(b"\xef\xbb\xbf" + (head + "\n" + ";".join(["SOJA"] + ["1"] * (len(readers.ZONING_FIELDS) - 1))).encode())
    row = one(readers.zoning_csv(spark, str(tmp_path / "z.csv")))
    assert row["Nome_cultura"] == "SOJA" and row["dec36"] == "1"


def _town(code, name="A", uf="DF"):
    return {"id": code, "nome": name, "regiao-imediata": {"regiao-intermediaria": {"UF": {"sigla": uf, "regiao": {"nome": "Centro"}}}}}


def test_locations(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([_town(1234567), _town(7654321, "Ação")]))
    square = {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]}
    mesh = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"codarea": "1234567"}, "geometry": square}]}
    (tmp_path / "g.json").write_text(json.dumps(mesh))
    towns, shapes = readers.municipalities_json(spark, str(tmp_path / "m.json")), readers.mesh_geojson(spark, str(tmp_path / "g.json"))
    got = {r["codigo_ibge"]: r for r in rows(readers.build_locations(towns, shapes))}
    assert (got["1234567"]["longitude_centroid"], got["1234567"]["latitude_centroid"]) == (1, 1)
    assert json.loads(got["1234567"]["geometry"]) == square and got["1234567"]["regiao"] == "Centro"
    assert got["7654321"]["latitude_centroid"] is None and got["7654321"]["quality_flags"] == ["MISSING_OFFICIAL_GEOMETRY"]
    assert rows(audit.location_coverage(towns, shapes)) == [{"code": "7654321", "side": "left_only"}]
    assert [r["codigo_ibge"] for r in rows(readers.search_locations(readers.build_locations(towns, shapes), "AÇ"))] == ["7654321"]
    with pytest.raises(ValueError, match="duplicate codigo_ibge"):
        readers.build_locations(towns.union(towns), shapes)
    (tmp_path / "x.json").write_text(json.dumps([{"id": 1, "nome": "B"}]))
    with pytest.raises(Exception, match="breaks rules"):
        readers.build_locations(readers.municipalities_json(spark, str(tmp_path / "x.json")), shapes).collect()
    (tmp_path / "bad.json").write_text(json.dumps({"type": "Feature"}))
    with pytest.raises(Exception, match="FeatureCollection"):
        readers.mesh_geojson(spark, str(tmp_path / "bad.json")).collect()


def member(code="A001", width=19, header=True, hours=24):
    pre = ["REGIÃO:;CO", "UF:;MT", "ESTAÇÃO:;SORRISO", f"CODIGO (WMO):;{code}", "LATITUDE:;-12,5", "LONGITUDE:;-55,7", "ALTITUDE:;379,1", "DATA DE FUNDACAO:;2001-01-01"]
    if header:
        pre.append("Data;Hora UTC;" + ";".join(f"v{i}" for i in range(2, width)))
    body = []
    for h in range(hours):
        v = ["1,0" if h == 12 else "0", "", "", "", "10,5", "25,0", "", "26,0", "24,0", "", "", "", "", "70", "", "", "2,5"]
        body.append(";".join(["2024/01/01", f"{h:02d}00 UTC", *v][:width]) + ";")
    return "\r\n".join(pre + body).encode("latin1")


def test_station_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "2024.zip", "w") as z:
        z.writestr("a/INMET_A001.CSV", member())
        z.writestr("a/B.CSV", member("B", header=False))
        z.writestr("a/C.CSV", b"nothing")
        z.writestr("a/readme.txt", b"x")
    members = archive.archive_members(spark, str(tmp_path / "2024.zip"))
    assert sorted(r["member"] for r in rows(archive.skipped_members(members))) == ["a/B.CSV", "a/C.CSV"]
    day = one(station.archive_daily(archive.hourly_readings(members), source_checksum="a" * 64))
    assert day["rain_mm"] == 1.0 and day["temp_observations"] == 24 and day["station_code"] == "A001" and day["station_name"] == "SORRISO"
    assert (day["station_latitude"], day["station_altitude_m"], day["max_temp_c"], day["mean_wind_m_s"]) == (-12.5, 379.1, 26.0, 2.5)
    assert day["radiation_kj_m2"] == pytest.approx(252) and str(day["data"]) == "2024-01-01"
    newer = spark.createDataFrame([day | {"rain_mm": 9.0}], station.archive_daily(archive.hourly_readings(members), source_checksum="a").schema)
    assert one(station.upsert_daily(station.archive_daily(archive.hourly_readings(members), source_checksum="a" * 64), newer))["rain_mm"] == 9.0


def test_versioned_tables(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    writers.replace_table(df, root, "panel", inputs=["raw"])
    current = writers.read_table(spark, root, "panel")
    writers.replace_table(current.union(spark.createDataFrame([(3, "c")], df.schema)), root, "panel", partition_by=["k"])
    assert sorted(r["k"] for r in rows(writers.read_table(spark, root, "panel"))) == [1, 2, 3]
    versions = one(writers.dataset_versions(spark, root, ["panel", "none"]))["dataset_versions"]
    assert list(versions) == ["panel"] and versions["panel"].startswith("panel-")
    assert writers.manifests(spark, root).count() == 2
    with pytest.raises(FileNotFoundError):
        writers.read_table(spark, root, "missing")
    same = one(writers.fingerprint(df.orderBy(F.desc("k"))))
    assert same == one(writers.fingerprint(df)) and same != one(writers.fingerprint(df.limit(1)))


def test_artifacts_are_registered_once(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.json").write_bytes(b"x")
    records = writers.artifact_records(spark, [str(tmp_path / "a.json"), str(tmp_path / "sub" / "a.json")])
    none = spark.createDataFrame([], writers.ARTIFACT_SCHEMA)
    new = writers.register_artifacts(records, none)
    row = one(new)
    assert row["file_name"] == f"a-{row['checksum_sha256'][:16]}.json"
    assert writers.register_artifacts(records, new).count() == 0
    clash = new.withColumn("checksum_sha256", F.lit("0" * 64))
    with pytest.raises(ValueError, match="collision"):
        writers.register_artifacts(records, clash)
    listing = readers.list_files(spark, str(tmp_path), "*.json")
    assert len(rows(readers.pick_file(listing))) == 2


def test_analyses_are_found_by_id(spark, tmp_path):
    ident = "0123abcd-0123-4567-89ab-0123456789ab"
    df = spark.createDataFrame([(ident, ("x",))], "analysis_id string, audit struct<pipeline_version: string>")
    writers.append_analyses(df, str(tmp_path / "analyses"))
    assert one(writers.analysis_audit(writers.find_analysis(spark, str(tmp_path / "analyses"), ident.upper())))["pipeline_version"] == "x"
    with pytest.raises(KeyError):
        writers.find_analysis(spark, str(tmp_path / "analyses"), "nonsense")
