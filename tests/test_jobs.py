"""Chained jobs, observed writes, archive ranges, insert-only merges and promoted models."""

import datetime as dt
import hashlib
import json
import zipfile

import numpy as np
import pytest
from conftest import one, rows
from pyspark.sql import functions as F
from test_climate import grid_days, places, station_days
from test_sources import member

from cropgrid import jobs
from cropgrid.config import ModelSettings
from cropgrid.operators import merge, metrics, quality
from cropgrid.plans import audit, climate, modelling, reanalysis, station, training
from cropgrid.sources import archive, readers, writers


def test_a_write_is_one_pass_and_a_broken_rule_keeps_the_old_table(spark, tmp_path):
    root, passed = str(tmp_path), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            passed.add(batch.num_rows)
            yield batch

    df = spark.range(1000).mapInArrow(counted, "id long")
    writers.replace_table(df, root, "t", counters={"most": F.max("id")}, rules={"positive": F.col("id") >= 0})
    assert passed.value == 1000
    told = one(writers.latest_manifests(spark, root))
    assert told["rows"] == 1000 and json.loads(told["quality"]) == {"most": 999}
    assert told["fingerprint"] == one(writers.fingerprint(spark.range(1000)))["fingerprint"]
    with pytest.raises(ValueError, match="old version stays.*small.*90"):
        writers.replace_table(spark.range(100), root, "t", rules={"small": F.col("id") < 10})
    with pytest.raises(Exception, match="broken"):
        writers.replace_table(spark.range(5).select(F.raise_error(F.lit("broken")).alias("id")), root, "t")
    assert writers.read_table(spark, root, "t").count() == 1000 and writers.manifests(spark, root).count() == 1
    empty = writers.replace_table(spark.range(0), root, "none")
    assert spark.read.parquet(empty).count() == 0


def test_manifest_audit(spark, tmp_path):
    root = str(tmp_path)
    path = writers.replace_table(spark.range(10), root, "good")
    writers.replace_table(spark.range(10), root, "bad")
    spark.range(11).write.mode("append").parquet(writers.latest_manifests(spark, root).where("dataset = 'bad'").first()["path"])
    found = {(r["dataset"], r["problem"]) for r in rows(audit.manifest_audit(spark, root, ["good", "bad", "gone"]))}
    assert path and found == {("bad", "gold_manifest_row_count"), ("bad", "gold_manifest_checksum"), ("gone", "manifest_missing")}


def test_climate_job(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError, match="station_daily is required"):
        jobs.rebuild_climate(spark, root, verify=False)
    daily = station_days(spark, [(0, -10.0, "MT")])
    path = writers.replace_table(daily, root, jobs.DAILY)
    writers.replace_table(places(spark, ("1234567", "A", "MT", -10.0, -50.0), ("2", "B", "MT", -20.0, -50.0)), root, jobs.LOCATIONS)
    grid = reanalysis.reanalysis_seasons(grid_days(spark, 243)).withColumn("codigo_ibge", F.lit("2"))
    writers.replace_table(grid, root, jobs.GRID)
    told = {r["dataset"]: r for r in rows(jobs.rebuild_climate(spark, root))}
    assert [told[d]["rows"] for d in (jobs.SEASONS, jobs.STATION, jobs.CLIMATE)] == [1, 2, 2]
    assert json.loads(told[jobs.STATION]["quality"])["outside_radius_rows"] == 1
    versions = {r["dataset"]: r["dataset_version"] for r in rows(writers.latest_manifests(spark, root))}
    assert told[jobs.CLIMATE]["inputs"] == [versions[jobs.STATION], versions[jobs.GRID]]
    merged = {r["codigo_ibge"]: r for r in rows(jobs.table(spark, root, jobs.CLIMATE))}
    assert "INMET" in merged["1234567"]["source"] and set(merged) == {"1234567", "2"}
    daily.limit(3).write.mode("append").parquet(path)
    with pytest.raises(ValueError, match="not the table of its manifest"):
        jobs.rebuild_climate(spark, root)
    assert writers.manifests(spark, root).where("dataset = 'climate'").count() == 1


def survey(spark, year, value, label="Soja (em grão)"):
    row = ("5107925", "Sorriso (MT)", "216", "", str(year), "40124", label, "Hectares", value)
    return spark.createDataFrame([row], ", ".join(f"{c} string" for c in readers.SURVEY_FIELDS))


def test_survey_and_training_jobs(spark, tmp_path):
    root = str(tmp_path)
    jobs.ingest_survey(spark, root, survey(spark, 2020, "10"), checksum="a" * 64)
    told = one(jobs.ingest_survey(spark, root, survey(spark, 2021, "20").union(survey(spark, 2020, "11")), checksum="b" * 64))
    assert told["rows"] == 2 and len(told["inputs"]) == 1 and json.loads(told["quality"])["year_max"] == 2021
    assert {(r["ano"], r["area_colhida_ha"]) for r in rows(jobs.table(spark, root, jobs.PANEL))} == {(2020, 11.0), (2021, 20.0)}
    with pytest.raises(Exception, match="unknown crop label"):
        jobs.ingest_survey(spark, root, survey(spark, 2022, "1", "Trevo"), checksum="c" * 64)
    assert jobs.table(spark, root, jobs.PANEL).count() == 2
    writers.replace_table(places(spark, ("5107925", "Sorriso", "MT", -12.0, -55.0)), root, jobs.LOCATIONS)
    series = jobs.table(spark, root, jobs.PANEL).withColumn("produtividade_kg_ha", F.lit(3000.0))
    writers.replace_table(series, root, jobs.PANEL)
    weather = [c for c in training.CLIMATE_FEATURES + training.CLIMATE_METADATA]
    kinds = ", ".join(f"{c} {'string' if c in training.CLIMATE_METADATA and c != 'distance_to_grid_km' else 'double'}" for c in weather)
    writers.replace_table(spark.createDataFrame([], f"codigo_ibge string, season_year int, {kinds}"), root, jobs.CLIMATE)
    told = one(jobs.build_training(spark, root, start_year=2020, end_year=2021))
    assert told["rows"] == 2 and json.loads(told["quality"])["target_sum"] == 6000.0 and len(told["inputs"]) == 3


def test_archive_ranges(spark, tmp_path):
    for year in (2023, 2024):
        with zipfile.ZipFile(tmp_path / f"{year}.zip", "w") as z:
            for k in range(6):
                z.writestr(f"a/S{k}.CSV", member(f"S{k}"))
            z.writestr("a/note.txt", b"x")
    (tmp_path / "2025.zip").write_bytes(b"no archive")
    (tmp_path / "other.txt").write_bytes(b"x")
    size = len(member("S0"))
    members = archive.member_ranges(spark, str(tmp_path), range_bytes=2 * size)
    assert members.rdd.getNumPartitions() == 7  # three ranges of two members for each archive, and the broken file
    whole = archive.archive_members(spark, [str(tmp_path / f"{y}.zip") for y in (2023, 2024, 2025)])
    name = F.element_at(F.split("archive", "/"), -1).alias("archive")
    assert merge.differing_rows(members.select(name, "member", "text"), whole.select(name, "member", "text")).count() == 0
    assert archive.hourly_readings(members).count() == 2 * 6 * 24
    with pytest.raises(Exception, match="archive without a usable member.*2025.zip"):
        archive.checked_readings(members).collect()
    told = one(jobs.ingest_archives(spark, str(tmp_path / "store"), [str(tmp_path / "2023.zip"), str(tmp_path / "2024.zip")], checksum="a" * 64))
    assert told["rows"] == 6  # the same stations and day in both
    told = one(jobs.ingest_archives(spark, str(tmp_path / "store"), "file://" + str(tmp_path / "2024.zip"), checksum="b" * 64))
    assert told["rows"] == 6 and {r["source_dataset_checksum"] for r in rows(jobs.table(spark, str(tmp_path / "store"), jobs.DAILY))} == {"b" * 64}


def test_files_are_hashed_in_chunks(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * 100_000)
    (tmp_path / "b.bin").write_bytes(b"y")
    found = {r["path"].rsplit("/", 1)[-1]: r for r in rows(writers.hashed_files(spark, str(tmp_path), chunk_bytes=999))}
    assert found["a.bin"]["checksum_sha256"] == hashlib.sha256(b"x" * 100_000).hexdigest() and found["a.bin"]["bytes"] == 100_000
    assert found["b.bin"]["checksum_sha256"] == hashlib.sha256(b"y").hexdigest()


def test_insert_only(spark):
    schema = "name string, sum string, bytes int"
    new = spark.createDataFrame([("a", "1", 5), ("a", "1", 4), ("b", "2", 1), ("c", "3", 9)], schema)
    known = spark.createDataFrame([("b", "2")], "name string, sum string")
    assert sorted((r["name"], r["bytes"]) for r in rows(merge.insert_only(new, known, ["name"], "sum"))) == [("a", 4), ("c", 9)]
    assert merge.insert_only(new, new, ["name"], "sum").count() == 0 and merge.insert_only(new.limit(0), known, ["name"], "sum").count() == 0
    for clash in (spark.createDataFrame([("a", "9")], "name string, sum string"), known.withColumn("name", F.lit("c"))):
        with pytest.raises(Exception, match="immutable content differs"):
            merge.insert_only(new, clash, ["name"], "sum").collect()


def test_asserted_joins(spark):
    left = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n")], "k int, v string")
    facts = spark.createDataFrame([(1, 10), (3, 30), (None, 0), (None, 1)], "k int, f int")
    got = sorted((r["v"], r["f"]) for r in rows(quality.many_to_one(left, facts, ["k"], "left")) if r["f"] is not None)
    assert got == [("x", 10), ("y", 10)] and quality.many_to_one(left, facts, ["k"]).count() == 2
    twice = facts.union(spark.createDataFrame([(3, 31)], facts.schema))
    with pytest.raises(Exception, match="hold a key more than once: 3"):
        quality.many_to_one(left, twice, ["k"], "left").collect()
    assert one(quality.join_offenders(left, twice, ["k"])) == {"k": 3, "copies": 2, "rows_hit": 0}
    with pytest.raises(Exception, match="stop"):
        quality.guarded(left, facts, F.col("k") == 3, F.concat(F.lit("stop"), "k")).collect()
    assert quality.guarded(left, facts, F.col("k") == 4, F.concat(F.lit("stop"), "k")).count() == 4


def test_differences_count_copies(spark):
    left = spark.createDataFrame([(1, "a")] * 3 + [(2, None)], "k int, v string")
    right = spark.createDataFrame([("a", 1), (None, 2), (None, 2)], "v string, k int")
    got = sorted((r["_side"], r["k"]) for r in rows(merge.differing_rows(left, right)))
    assert got == [("left_only", 1), ("left_only", 1), ("right_only", 2)] and merge.differing_rows(left, left).count() == 0


def weather(spark, *data):
    kinds = {"codigo_ibge": "string", "season_year": "int", "rain_crop_cycle_mm": "double", "mean_temp_c": "double", "season_coverage": "double", "source": "string",
             "quality_flag": "string", "data_nature": "string", "station_code": "string", "station_name": "string", "station_uf": "string",
             "distance_to_station_km": "double", "distance_to_grid_km": "double", "source_checksums": "array<string>"}
    return spark.createDataFrame([tuple(r.get(c) for c in kinds) for r in data], ", ".join(f"{c} {t}" for c, t in kinds.items()))


def test_audit_of_sound_and_odd_tables(spark):
    good = dict(rain_crop_cycle_mm=9.0, mean_temp_c=20.0, season_coverage=1.0, source="A", station_code="S")
    grid = dict(good, source=audit.REANALYSIS_SOURCES[0], station_code=None, data_nature="estimated", distance_to_grid_km=1.0, source_checksums=["x"])
    base = weather(spark, dict(good, codigo_ibge="1", season_year=1), dict(good, codigo_ibge="2", season_year=1, mean_temp_c=None))
    filled = weather(spark, dict(good, codigo_ibge="1", season_year=1), dict(grid, codigo_ibge="2", season_year=1))
    offered = weather(spark, dict(grid, codigo_ibge="2", season_year=1), dict(grid, codigo_ibge="3", season_year=1))
    count = lambda *a, **b: {r["check_name"]: r["failing_rows"] for r in rows(audit.climate_audit(*a, **b)) if r["failing_rows"]}
    assert count(base, filled, offered, expected_rows=2) == {}
    assert count(base, filled) == {"era5_fallback_present": 1}
    assert count(base, filled.union(filled), offered) == {"unique_keys": 2, "adequate_inmet_unchanged": 1, "era5_gold_matches_fallback": 1}
    assert count(base, filled.drop("source", "station_code"), offered) == {
        "required_columns": 1, "inmet_original_columns_preserved": 2, "era5_provenance_columns": 1}
    empty = base.limit(0)
    assert count(empty, empty, empty) == {}


def test_promoted_model(spark, tmp_path):
    rng = np.random.default_rng(2)
    data = [(f"{c:07d}", y, 1000 + 500 * x, x, "A", 1.0) for c in range(30) for y in range(2019, 2025) for x in [float(rng.uniform(0, 5))]]
    frame = spark.createDataFrame(data, "codigo_ibge string, ano int, produtividade_kg_ha double, rain double, climate_lag1_source string, climate_lag1_rain_crop_cycle_mm double")
    told = modelling.Evaluation(None, None, None, "ridge_regression", True, 0.9, {"empirical_coverage": 0.7, "nominal_coverage": 0.8})
    fitted = modelling.fit_production_model(frame, told, version="v1", settings=ModelSettings(), features=["rain"])
    assert (fitted.training_rows, fitted.calibration_year, fitted.coverage) == (150, 2024, 0.8)
    root = str(tmp_path)
    assert modelling.promoted_model(spark, root) is None
    modelling.promote_model(spark, root, fitted)
    with pytest.raises(Exception):
        modelling.promote_model(spark, root, fitted)  # a version is written once
    loaded = modelling.promoted_model(spark, root)
    assert (loaded.radius, loaded.climate_sources, loaded.model.imputation, loaded.version) == (fitted.radius, ("A",), fitted.model.imputation, "v1")
    score = lambda m: {(r["codigo_ibge"], r["ano"]): r["prediction"] for r in rows(m.model.predict(frame))}
    assert score(loaded) == score(fitted)
    (tmp_path / "v1").rename(tmp_path / "moved")
    with pytest.raises(Exception):
        modelling.promoted_model(spark, root)


def test_intervals_need_both_years(spark):
    df = spark.createDataFrame([(2020, 1.0, 1.0), (2021, 2.0, None)], "ano int, produtividade_kg_ha double, p double")
    for year in (2020, 2019):
        with pytest.raises(Exception, match="can not be evaluated"):
            metrics.evaluate_intervals(df, "p", calibration_year=year, coverage=0.8).collect()


def test_units_and_repeated_hours_of_a_file(spark):
    schema = "grid_lat double, grid_lon double, valid_time timestamp_ntz, t2m double, t2m_units string, source_file string"
    hour = dt.datetime(2024, 1, 1, 1)
    grid = spark.createDataFrame([(-10.0, 310.0, hour, 290.0, "K", "a"), (-10.0, 310.0, hour, 290.0, " kelvin", "b")], schema)
    read = lambda df: rows(reanalysis.location_daily(df, places(spark), mode=reanalysis.FORECAST_ORIGIN, source_checksum="a" * 64))
    assert read(grid)[0]["temp_observations"] == 1
    with pytest.raises(Exception, match="an hour twice in one file"):
        read(grid.withColumn("source_file", F.lit("a")))
    with pytest.raises(Exception, match="unsupported unit of t2m: celsius"):
        read(grid.withColumn("t2m_units", F.lit("celsius")))


def test_nearest_lines(spark):
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 17, 360):
        lines = np.unique(np.round(rng.uniform(-90, 90, n), 2))
        values = np.r_[rng.uniform(-95, 95, 200), lines, (lines[1:] + lines[:-1]) / 2]
        df = spark.createDataFrame([(float(v),) for v in values], "v double").withColumn("lines", F.array(*[F.lit(float(x)) for x in lines]))
        for r in rows(df.select("v", reanalysis._nearest_line(F.col("lines"), F.col("v")).alias("x"))):
            best = np.abs(lines - r["v"]).min()
            assert r["x"] == lines[np.abs(lines - r["v"]) == best].max()


def test_climate_station_seam(spark):
    """A station across the date line is nearer than one on the own side."""
    seasons = station.station_seasons(station_days(spark, [(0, -10.0, "MT")])).withColumn("station_longitude", F.lit(179.9))
    far = seasons.withColumns({"station_code": F.lit("B"), "station_longitude": F.lit(-175.0)})
    got = one(station.municipality_seasons(seasons.union(far), places(spark, ("1", "A", "MT", -10.0, -179.9)), max_distance_km=250, minimum_coverage=0.7))
    assert got["station_code"] == "A001" and got["distance_to_station_km"] < 25
    assert climate.climate_gaps(spark.createDataFrame([], "codigo_ibge string, season_year int, rain_crop_cycle_mm double, mean_temp_c double, season_coverage double")).count() == 0
