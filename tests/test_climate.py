import datetime as dt
import math

import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from cropgrid.plans import audit, climate, reanalysis, station

PLACE = ("1234567", "A", "MT", -10.0, -50.0)
HOURS = "grid_lat double, grid_lon double, valid_time timestamp_ntz, t2m double, d2m double, u10 double, v10 double, tp double, ssrd double"


def places(spark, *data):
    return spark.createDataFrame(data or [PLACE], "codigo_ibge string, municipio string, uf string, latitude_centroid double, longitude_centroid double")


def hours(spark, start, n, tp=None, **kw):
    vals = dict(t2m=298.15, d2m=298.15, u10=3.0, v10=4.0, ssrd=1000.0) | kw
    data = [(-10.0, 310.0, start + dt.timedelta(hours=i), vals["t2m"], vals["d2m"], vals["u10"], vals["v10"],
             tp[i] if isinstance(tp, list) else tp, vals["ssrd"]) for i in range(n)]
    return spark.createDataFrame(data, HOURS)


def daily(spark, grid, mode=reanalysis.HOURLY_INCREMENTS):
    return {r["data"]: r for r in rows(reanalysis.location_daily(grid, places(spark), mode=mode, source_checksum="a" * 64))}


def test_units_and_instant_values(spark):
    day = daily(spark, hours(spark, dt.datetime(2024, 1, 1, 1), 24, tp=0.001))[dt.date(2024, 1, 1)]
    assert day["mean_temp_c"] == pytest.approx(25) and day["mean_humidity_pct"] == pytest.approx(100)
    assert day["mean_wind_m_s"] == pytest.approx(5) and day["rain_mm"] == pytest.approx(24)
    assert day["radiation_kj_m2"] == pytest.approx(24) and day["distance_to_grid_km"] == pytest.approx(0, abs=1e-6)
    assert day["grid_longitude"] == pytest.approx(-50)


def test_incomplete_day_withheld(spark):
    rain = [0.001] * 24
    rain[5] = None
    day = daily(spark, hours(spark, dt.datetime(2024, 1, 1, 1), 24, tp=rain))[dt.date(2024, 1, 1)]
    assert day["rain_mm"] is None and day["rain_observations"] == 23


def test_signed_increments_are_summed_before_validation(spark):
    rain = [0.0] * 22 + [0.001 - 2.2e-11, -2.2e-11 + 4.4e-11]
    rain[0] = -2.2e-11
    rain[1] = 2.2e-11
    day = daily(spark, hours(spark, dt.datetime(2024, 1, 1, 1), 24, tp=rain))[dt.date(2024, 1, 1)]
    assert day["rain_mm"] == pytest.approx(1.0) and day["rain_negative_increments"] == 1


def test_midnight_belongs_to_the_day_before(spark):
    got = daily(spark, hours(spark, dt.datetime(2024, 1, 2, 0), 1, tp=0.012), reanalysis.FORECAST_ORIGIN)
    assert got[dt.date(2024, 1, 1)]["rain_mm"] == pytest.approx(12) and got[dt.date(2024, 1, 1)]["rain_observations"] == 24
    assert got[dt.date(2024, 1, 2)]["rain_mm"] is None and got[dt.date(2024, 1, 2)]["temp_observations"] == 1


def test_bad_inputs_rejected(spark):
    grid = hours(spark, dt.datetime(2024, 1, 1, 1), 2, tp=0.0)
    with pytest.raises(ValueError, match="mode"):
        reanalysis.daily_totals(grid, keys=["grid_lat"], mode="guess")
    with pytest.raises(Exception, match="grid too far"):
        reanalysis.location_daily(grid, places(spark, ("1", "A", "MT", -11.0, -50.0)), mode=reanalysis.FORECAST_ORIGIN, source_checksum="a").collect()
    off = grid.withColumn("valid_time", F.col("valid_time") + F.expr("interval 1 minute"))
    with pytest.raises(Exception, match="exact hours"):
        reanalysis.standard_variables(off).collect()
    with pytest.raises(Exception, match="Conflicting"):
        daily(spark, grid.union(grid.withColumn("t2m", F.lit(1.0))))
    assert len(daily(spark, grid.union(grid))) == 1
    reanalysis.check_units({"tp": "m", "u10": "m s**-1"})
    with pytest.raises(ValueError):
        reanalysis.check_units({"t2m": "celsius"})
    aliases = grid.withColumnsRenamed({"t2m": "2m_temperature", "u10": "10u"}).drop("d2m")
    assert set(reanalysis.standard_variables(aliases).columns) == {"grid_lat", "grid_lon", "valid_time", *reanalysis.ALIASES}


def grid_days(spark, days, rain=10.0, start=dt.date(2023, 9, 1)):
    base = dict(zip(("codigo_ibge", "municipio", "uf", "latitude_centroid", "longitude_centroid"), PLACE, strict=True))
    data = []
    for i in range(days):
        value = rain[i] if isinstance(rain, list) else rain
        data.append(base | dict(
            data=start + dt.timedelta(days=i), rain_mm=value, mean_temp_c=25.0, max_temp_c=36.0, min_temp_c=9.0, mean_humidity_pct=70.0,
            radiation_kj_m2=1.0, mean_wind_m_s=2.0, rain_observations=24 if value is not None else 23, temp_observations=24,
            humidity_observations=24, radiation_observations=24, wind_observations=24, rain_negative_increments=0,
            radiation_negative_increments=0, grid_latitude=-10.0, grid_longitude=-50.0, distance_to_grid_km=1.0,
            data_nature="estimated", source="Copernicus ERA5-Land reanalysis", temporal_method="UTC", source_checksums=["a" * 64]))
    kinds = ("codigo_ibge string, municipio string, uf string, latitude_centroid double, longitude_centroid double, data date, rain_mm double, "
             "mean_temp_c double, max_temp_c double, min_temp_c double, mean_humidity_pct double, radiation_kj_m2 double, mean_wind_m_s double, "
             "rain_observations long, temp_observations long, humidity_observations long, radiation_observations long, wind_observations long, "
             "rain_negative_increments long, radiation_negative_increments long, grid_latitude double, grid_longitude double, "
             "distance_to_grid_km double, data_nature string, source string, temporal_method string, source_checksums array<string>")
    return spark.createDataFrame([tuple(d[k.split()[0]] for k in kinds.split(", ")) for d in data], kinds)


def test_full_leap_season(spark):
    row = one(reanalysis.reanalysis_seasons(grid_days(spark, 243)))
    assert (row["rain_crop_cycle_mm"], row["rain_30d_mm"], row["rain_60d_mm"], row["rain_90d_mm"]) == (2430, 300, 610, 900)
    assert row["season_coverage"] == 1 and row["season_year"] == 2024 and row["days_temp_gt_35"] == 243
    assert row["quality_flag"] == "ERA5_REANALYSIS_FALLBACK"


def test_missing_rain_is_not_dry(spark):
    row = one(reanalysis.reanalysis_seasons(grid_days(spark, 243, rain=[None] * 243)))
    assert row["rain_crop_cycle_mm"] is None and row["dry_days"] is None and row["season_coverage"] == 0
    assert row["valid_rain_hours"] == 0 and row["quality_flag"] == "ERA5_INSUFFICIENT_SEASON_COVERAGE"


def test_overlap_merge(spark):
    days = grid_days(spark, 2)
    assert reanalysis.combine_daily(days, days).count() == 2
    with pytest.raises(Exception, match="Conflicting"):
        reanalysis.combine_daily(days, grid_days(spark, 2, rain=11.0)).collect()


def station_days(spark, versions):
    """One season of complete days; ``versions``: (first day index, latitude, state)."""
    data = []
    for i in range(242):
        _, lat, uf = [v for v in versions if v[0] <= i][-1]
        data.append(("A001", f"S{lat}", uf, lat, -50.0, 100.0, dt.date(2024, 9, 1) + dt.timedelta(days=i), 1.0, 24, 25.0, 24, 36.0, 9.0, 70.0, 24, 5.0, 24, 2.0, 24, "a" * 64))
    return spark.createDataFrame(data, (
        "station_code string, station_name string, station_uf string, station_latitude double, station_longitude double, "
        "station_altitude_m double, data date, rain_mm double, rain_observations long, mean_temp_c double, temp_observations long, "
        "max_temp_c double, min_temp_c double, mean_humidity_pct double, humidity_observations long, radiation_kj_m2 double, "
        "radiation_observations long, mean_wind_m_s double, wind_observations long, source_dataset_checksum string"))


def test_metadata_within_tolerance_is_merged(spark):
    row = one(station.station_seasons(station_days(spark, [(0, -10.0, "MT"), (120, -10.005, "MT")])))
    assert row["season_coverage"] == 1 and row["rain_crop_cycle_mm"] == 242 and row["station_metadata_versions"] == 2
    assert 0.5 < row["station_metadata_max_shift_km"] < 0.6 and row["station_name"] == "S-10.005"
    assert row["station_metadata_policy"] == "canonicalized_latest_within_tolerance"


@pytest.mark.parametrize("versions, segments, policy", [
    ([(0, -10.0, "MT"), (120, -10.1, "MT")], 2, "segmented_coordinate_shift_over_tolerance"),
    ([(0, -10.0, "MT"), (120, -10.0, "MS")], 2, "segmented_uf_change"),
    ([(0, -10.0, "MT"), (80, -10.012, "MT"), (160, -10.006, "MT")], 3, "segmented_coordinate_shift_over_tolerance"),
])
def test_metadata_segments(spark, versions, segments, policy):
    got = rows(station.station_seasons(station_days(spark, versions)))
    assert len(got) == segments and {r["station_metadata_policy"] for r in got} == {policy}
    assert all(r["season_coverage"] < 0.7 for r in got)


def test_tolerance_must_be_a_number(spark):
    with pytest.raises(ValueError):
        station.station_seasons(station_days(spark, [(0, -10.0, "MT")]), metadata_tolerance_km=math.inf)


def test_nearest_station_withholds_beyond_radius(spark):
    seasons = station.station_seasons(station_days(spark, [(0, -10.0, "MT")]))
    where = places(spark, PLACE, ("2", "B", "MT", -20.0, -50.0), ("3", "C", "MT", None, None))
    got = {r["codigo_ibge"]: r for r in rows(station.municipality_seasons(seasons, where, max_distance_km=250, minimum_coverage=0.7))}
    assert set(got) == {"1234567", "2"}
    assert got["1234567"]["rain_crop_cycle_mm"] == 242 and got["1234567"]["data_nature"] == "interpolated"
    assert got["2"]["rain_crop_cycle_mm"] is None and got["2"]["season_coverage"] is None
    assert got["2"]["quality_flag"] == "NO_NEARBY_INMET_STATION" and got["2"]["distance_to_station_km"] > 1000
    with pytest.raises(Exception, match="no adequate station"):  # in the job, as the plan runs none before
        station.municipality_seasons(seasons.where("false"), where, max_distance_km=250, minimum_coverage=0.7).collect()


CLIMATE = "codigo_ibge string, season_year int, rain_crop_cycle_mm double, mean_temp_c double, season_coverage double, source string, quality_flag string, latitude_centroid double, longitude_centroid double, distance_to_station_km double"


def seasons(spark, *data):
    return spark.createDataFrame(data, CLIMATE)


def test_whole_row_fallback(spark):
    a = seasons(spark, ("1", 2024, 1000.0, 25.0, 1.0, "A", None, -10.0, -50.0, 1.0), ("2", 2024, None, 25.0, 0.9, "A", None, -10.0, -50.0, 1.0),
                ("3", 2024, None, 25.0, 0.9, "A", None, -10.0, -50.0, 1.0))
    b = seasons(spark, *[(str(i), 2024, 2000.0, 24.0, c, "B", None, -10.0, -50.0, None) for i, c in ((1, 1.0), (2, 1.0), (3, 0.5), (4, 1.0))])
    got = {r["codigo_ibge"]: (r["source"], r["rain_crop_cycle_mm"]) for r in rows(climate.merged_climate(a, b))}
    assert got == {"1": ("A", 1000.0), "2": ("B", 2000.0), "3": ("A", None)}
    with pytest.raises(Exception, match="duplicate primary"):
        climate.merged_climate(a.union(a), b).collect()
    with pytest.raises(Exception, match="duplicate secondary"):
        climate.merged_climate(a, b.union(b)).collect()


@pytest.mark.parametrize("coverage", [math.nan, math.inf, 1.01, -0.01])
def test_invalid_coverage_never_fills(spark, coverage):
    a = seasons(spark, ("1", 2024, None, None, None, "A", None, -10.0, -50.0, None))
    b = seasons(spark, ("1", 2024, 2000.0, 24.0, coverage, "B", None, -10.0, -50.0, None))
    assert one(climate.merged_climate(a, b))["source"] == "A"


def test_gap_tiles(spark):
    gaps = seasons(spark, ("2", 2024, None, None, None, "A", None, -10.5, -50.5, None), ("1", 2024, None, None, None, "A", None, -11.5, -51.5, None),
                   ("3", 2024, None, None, None, "A", None, math.nan, -50.0, None), ("4", 2024, 1.0, 1.0, 1.0, "A", None, -10.0, -50.0, None))
    tiles = climate.gap_tiles(climate.climate_gaps(gaps))
    assert one(climate.tile_members(tiles))["municipalities"] == ["1", "2"]
    periods = sorted(rows(climate.tile_periods(tiles)), key=lambda r: (r["year"], r["month"]))
    assert [(r["year"], r["month"]) for r in periods] == [(2023, m) for m in range(9, 13)] + [(2024, m) for m in range(1, 6)]
    assert periods[5]["days"] == 29 and periods[8]["days"] == 1 and periods[8]["variables"] == 2 and periods[0]["north"] == pytest.approx(-9.9)


def test_backfill_budget_and_status(spark):
    a = seasons(spark, *[(str(i), 2024, None, None, None, "A", None, -10.0, -50.0, None) for i in range(5)])
    states = spark.createDataFrame([("1", 2024, "unavailable", "q", "file"), ("3", 2024, "error", None, None)],
                                   "codigo_ibge string, season_year int, status string, quality_flag string, artifact string")
    pick = lambda n: sorted(r["codigo_ibge"] for r in rows(climate.select_backfill(a, a, states, budget=n)))
    assert pick(0) == ["1"] and pick(2) == ["0", "1", "2"]
    assert one(climate.backfill_progress(a, a, states))["coverage_status"] == "attention_required"
    left = {r["codigo_ibge"]: r["era5_status"] for r in rows(climate.remaining_gaps(a, states))}
    assert left == {"0": "not_attempted", "1": "unavailable", "2": "not_attempted", "3": "error", "4": "not_attempted"}


@pytest.mark.parametrize("coverage", [1.0, 1.01, math.inf, math.nan])
def test_coverage_counts(spark, coverage):
    df = seasons(spark, ("1", 2024, 1500.0, 25.0, 1.0, "INMET automatic station annual archives", None, None, None, 10.0),
                 ("2", 2024, 1800.0, 24.0, coverage, "Copernicus CDS ERA5-Land", "ERA5_LAND_FALLBACK", None, None, None),
                 ("3", 2024, None, None, None, "INMET automatic station annual archives", "NO_NEARBY_INMET_STATION", None, None, 400.0))
    row, filled = one(audit.climate_coverage(df)), int(coverage == 1.0)
    assert row["inmet_within_radius_rows"] == 1 and row["era5_land_fallback_rows"] == filled and row["available_rows"] == 1 + filled
    assert row["missing_climate_rows"] == 2 - filled and row["outside_inmet_radius_rows"] == 2 and row["unfilled_outside_inmet_radius_rows"] == 1


RECORD = ("subset string, group string, zarr_key string, url string, checksum_sha256 string, bytes long, retention string, artifact string, "
          "missing_chunk boolean, http_status int, fill_value string, metadata_checksum_sha256 string, metadata_fill_value string")


def artifact(group, key, **kw):
    ident, name, _ = audit.STORE_GROUPS[group]
    url = f"{audit.STORE_URL}/cadl-arco-geo-{ident}/arco/reanalysis_era5_land/{name}/geoChunked.zarr/{key}"
    chunk = key.count(".") == 2
    base = dict(subset="s", group=group, zarr_key=key, url=url, checksum_sha256="a" * 64, bytes=5,
                retention="memory_cache_only" if chunk else "preserved_in_bronze", artifact=None if chunk else "f", missing_chunk=None,
                http_status=None, fill_value=None, metadata_checksum_sha256=None, metadata_fill_value=None) | kw
    return tuple(base[c.split()[0]] for c in RECORD.split(", "))


def test_artifact_records(spark):
    good = [artifact(g, k) for g, info in audit.STORE_GROUPS.items()
            for k in (".zmetadata", "time/0", "latitude/0", "longitude/0", *[f"{v}/0.0.0" for v in info[2]])]
    assert audit.artifact_problems(spark.createDataFrame(good, RECORD)).count() == 0
    bad = good[1:] + [artifact("rain", "tp/1.0.0", checksum_sha256="x"), artifact("rain", "tp/2.0.0", url="http://x"),
                      artifact("rain", "tp/3.0.0", retention="preserved_in_bronze"),
                      artifact("rain", "tp/4.0.0", missing_chunk=True, http_status=500)]
    got = sorted(r["problem"] for r in rows(audit.artifact_problems(spark.createDataFrame(bad, RECORD))))
    assert got == ["arco_missing_chunk_event", "arco_remote_chunk_retention", "arco_required_source_missing",
                   "arco_source_checksum_format", "arco_source_official_url_and_key"]
