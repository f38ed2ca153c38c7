"""Reanalysis climate: an hourly grid table to daily and seasonal municipality rows.

Days are aggregated per grid cell, and only then handed to the municipalities of the cell, so a
cell shared by many municipalities is read and summed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    celsius, finite_or_null, relative_humidity, season_hours, weighted_mean, wind_speed, withhold,
)
from ..functions.geo import haversine_km, wrap_longitude
from ..operators.merge import require_no_conflicts, union_widening
from .station import FEATURES, in_season

# Source names of the hourly variables, daily columns and provenance texts.
ALIASES = {
    "t2m": ("t2m", "2m_temperature"),
    "d2m": ("d2m", "2m_dewpoint_temperature"),
    "u10": ("u10", "10u", "10m_u_component_of_wind"),
    "v10": ("v10", "10v", "10m_v_component_of_wind"),
    "tp": ("tp", "total_precipitation"),
    "ssrd": ("ssrd", "surface_solar_radiation_downwards"),
}
UNITS = {
    "t2m": {"k", "kelvin"}, "d2m": {"k", "kelvin"},
    "u10": {"ms^-1", "ms-1", "m/s"}, "v10": {"ms^-1", "ms-1", "m/s"},
    "tp": {"m", "mofwaterequivalent"}, "ssrd": {"jm^-2", "jm-2", "j/m^2", "jm^(-2)"},
}
LOCATION = ["codigo_ibge", "municipio", "uf", "latitude_centroid", "longitude_centroid"]
GRID = ["grid_latitude", "grid_longitude", "distance_to_grid_km"]
VALUES = [
    "rain_mm", "mean_temp_c", "max_temp_c", "min_temp_c", "mean_humidity_pct",
    "radiation_kj_m2", "mean_wind_m_s",
]
COUNTS = [
    "rain_observations", "temp_observations", "humidity_observations", "radiation_observations",
    "wind_observations", "rain_negative_increments", "radiation_negative_increments",
]
FORECAST_ORIGIN, HOURLY_INCREMENTS = "forecast_origin", "hourly_increments"
SOURCES = {
    FORECAST_ORIGIN: "Copernicus ERA5-Land reanalysis",
    HOURLY_INCREMENTS: "Copernicus ERA5-Land ARCO reanalysis",
}
TEMPORAL_METHODS = {
    FORECAST_ORIGIN: "UTC; hourly instantaneous; previous-day midnight 24h accumulations",
    HOURLY_INCREMENTS: (
        "UTC; hourly instantaneous; ARCO hourly increments assigned to hour start; "
        "24 finite signed increments required per daily total; "
        "negative increments counted, not clipped; daily nonnegative validation"
    ),
}
RAIN_TOLERANCE_MM, RADIATION_TOLERANCE_KJ = 1e-5, 1e-6
MAX_GRID_KM = 20.0
# Column that names the file of an hourly row, where several files make one table.
SOURCE_FILE = "source_file"
METHOD_PREFIX = "nearest ERA5-Land reanalysis grid cell; UTC Sep-Apr; "
INSUFFICIENT, FALLBACK = "ERA5_INSUFFICIENT_SEASON_COVERAGE", "ERA5_REANALYSIS_FALLBACK"


def check_units(units: dict[str, str]) -> None:
    """Reject a grid table whose declared units are not the expected ones."""
    for variable, unit in units.items():
        plain = unit.lower().replace(" ", "").replace("**", "^")
        if plain not in UNITS[variable]:
            raise ValueError(f"unsupported unit of {variable}: {unit!r}")


def standard_variables(grid: DataFrame) -> DataFrame:
    """Hourly grid rows with one column per variable; absent variables and non-numbers are NULL.

    A column ``<variable>_units`` beside a variable is checked row by row: another unit fails the job. ``source_file`` is kept.
    """
    found = {v: [c for c in names if c in grid.columns] for v, names in ALIASES.items()}
    if not any(found.values()):
        raise ValueError("grid table has no recognised climate variable")
    whole = F.col("valid_time") == F.date_trunc("hour", "valid_time")
    problem = F.when(~F.coalesce(whole, F.lit(False)), F.lit("valid_time must hold exact hours"))
    for v, names in found.items():
        for n in names:
            if f"{n}_units" in grid.columns:
                given = F.replace(F.replace(F.lower(F.col(f"{n}_units")), F.lit(" "), F.lit("")), F.lit("**"), F.lit("^"))
                wrong = F.col(n).isNotNull() & ~F.coalesce(given.isin(*UNITS[v]), F.lit(False))
                problem = problem.when(wrong, F.concat(F.lit(f"unsupported unit of {v}: "), F.coalesce(f"{n}_units", F.lit("none"))))
    hourly = grid.where(F.when(problem.isNull(), F.lit(True)).otherwise(F.raise_error(problem).cast("boolean")))
    columns = [
        F.coalesce(*[finite_or_null(F.col(n).cast("double")) for n in names], F.lit(None).cast("double")).alias(v)
        for v, names in found.items()
    ]
    return hourly.select("grid_lat", "grid_lon", "valid_time", *columns, *[c for c in (SOURCE_FILE,) if c in grid.columns])


def merged_hours(hourly: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and hour, coalesced over files in one aggregate.

    Files may overlap where they agree. An hour that one file holds twice, or values that differ, fail the job.
    """
    named = SOURCE_FILE in hourly.columns
    times = [F.count(F.lit(1)).alias("_rows"), F.size(F.collect_set(SOURCE_FILE)).alias("_files")] if named else []
    spread = [f(c).alias(f"_{f.__name__}_{c}") for c in ALIASES for f in (F.min, F.max)]
    merged = hourly.groupBy(*keys, "valid_time").agg(*spread, *times)
    differ = F.array_compact(F.array(*[F.when(F.col(f"_min_{c}") != F.col(f"_max_{c}"), F.lit(c)) for c in ALIASES]))
    problem = F.when(F.size(differ) > 0, F.concat(F.lit("Conflicting overlapping grid values: "), F.array_join(differ, ",")))
    if named:
        problem = problem.when(F.col("_rows") > F.col("_files"), F.concat(F.lit("an hour twice in one file: "), F.col("valid_time").cast("string")))
    sound = F.when(problem.isNull(), F.lit(True)).otherwise(F.raise_error(problem).cast("boolean"))
    return merged.where(sound).select(*keys, "valid_time", *[F.col(f"_max_{c}").alias(c) for c in ALIASES])


def _nearest_line(lines: Column, value: Column) -> Column:
    """The line of a sorted array nearest to a value, the upper one of two; found by halving."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(lines) + F.lit(1))).cast("int"))
    whole = F.struct(F.lit(1).alias("low"), (F.size(lines) + F.lit(1)).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s.low + s.high) / 2).cast("int")
        below = F.coalesce(F.try_element_at(lines, middle) < value, F.lit(False))
        return F.when(s.low >= s.high, s).when(below, F.struct((middle + 1).alias("low"), s.high.alias("high"))).otherwise(
            F.struct(s.low.alias("low"), middle.alias("high")))

    first = F.aggregate(steps, whole, halve)["low"]  # the first line that is not below the value
    upper = F.element_at(lines, F.least(first, F.size(lines)))
    lower = F.element_at(lines, F.greatest(first - 1, F.lit(1)))
    return F.when(F.abs(value - lower) < F.abs(upper - value), lower).otherwise(upper)


def map_to_grid(locations: DataFrame, grid: DataFrame, *, max_grid_distance_km: float = MAX_GRID_KM) -> DataFrame:
    """Nearest grid line per latitude and per longitude; fails beyond the distance limit.

    One aggregate reads the grid's coordinates and gives both axes as one row, whose lines are as many as the resolution
    allows in 360 degrees. The circle closes: each end of the longitudes also stands a full turn away.
    """
    lines = lambda c: F.array_sort(F.collect_set(F.col(c).cast("double")))
    axes = grid.agg(lines("grid_lat").alias("_lats"), lines("grid_lon").alias("_lons")).where("size(_lats) > 0 and size(_lons) > 0")
    west, east = F.element_at("_lons", 1), F.element_at("_lons", -1)
    turned = F.array_sort(F.array_distinct(F.concat(F.array(east - 360.0), F.col("_lons"), F.array(west + 360.0))))
    axes = axes.select("_lats", turned.alias("_turned"), west.alias("_west"), east.alias("_east"))
    placed = locations.select(*LOCATION).where("latitude_centroid is not null and longitude_centroid is not null").crossJoin(F.broadcast(axes))  # one row
    west, east = F.col("_west"), F.col("_east")
    lon = F.when(west >= 0, F.pmod("longitude_centroid", F.lit(360.0))).otherwise(F.col("longitude_centroid"))
    found = placed.withColumns(
        {"grid_lat": _nearest_line(F.col("_lats"), F.col("latitude_centroid")), "_line": _nearest_line(F.col("_turned"), lon)})
    back = F.when(F.col("_line") > east, west).when(F.col("_line") < west, east).otherwise(F.col("_line"))
    mapped = found.withColumn("grid_lon", back).select(
        *LOCATION, "grid_lat", "grid_lon", F.col("grid_lat").alias("grid_latitude"), wrap_longitude("grid_lon").alias("grid_longitude")
    ).withColumn(
        "distance_to_grid_km",
        haversine_km("latitude_centroid", "longitude_centroid", "grid_latitude", "grid_longitude"),
    )
    near = F.col("distance_to_grid_km") <= max_grid_distance_km
    return mapped.where(
        F.when(near, F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("grid too far from "), F.col("codigo_ibge"))).cast("boolean")
        )
    )


def daily_totals(hourly: DataFrame, *, keys: list[str], mode: str) -> DataFrame:
    """Daily values per key from hourly variables, in one aggregation.

    An hour contributes its instantaneous values to its own UTC day and its accumulations to the
    day its interval began in, which differ only at 00 UTC. ``forecast_origin`` takes the 00 UTC
    sample as the total of the day before; ``hourly_increments`` sums 24 signed increments and
    withholds a total when any is missing. Days with NULL values only are kept.
    """
    if mode not in SOURCES:
        raise ValueError(f"unsupported accumulation mode {mode!r}")
    time = F.col("valid_time")
    day, before = F.to_date(time), F.to_date(time - F.expr("INTERVAL 1 HOUR"))
    temp, dew = celsius("t2m"), celsius("d2m")
    rain, radiation = F.col("tp") * 1000, F.col("ssrd") / 1000
    increments = mode == HOURLY_INCREMENTS
    if not increments:
        rain, radiation = _nonnegative(rain, RAIN_TOLERANCE_MM), _nonnegative(radiation, RADIATION_TOLERANCE_KJ)
    nothing = F.lit(None).cast("double")

    def share(at: Column, instant: bool, total: bool) -> Column:
        pick = lambda on, c: c if on else nothing
        return F.struct(
            at.alias("data"), pick(instant, temp).alias("temp"),
            pick(instant, relative_humidity(temp, dew)).alias("humid"),
            pick(instant, wind_speed("u10", "v10")).alias("wind"),
            pick(total, rain).alias("rain"), pick(total, radiation).alias("sun"),
        )

    midnight = F.hour(time) == 0
    apart = F.array(share(day, True, False), share(before, False, True))
    if increments:
        shares = F.when(midnight, apart).otherwise(F.array(share(day, True, True)))
    else:
        known = midnight & (rain.isNotNull() | radiation.isNotNull())
        shares = F.when(known, apart).otherwise(F.array(share(day, True, False)))
    parts = hourly.select(*keys, F.inline(shares))

    def total(c: str, tolerance: float) -> Column:
        if not increments:
            return F.max(c)
        return _nonnegative(F.when(F.count(c) == 24, F.sum(c)), tolerance)

    hours = 1 if increments else 24
    negative = lambda c: F.count_if(F.col(c) < 0) if increments else F.lit(0).cast("long")
    return parts.groupBy(*keys, "data").agg(
        total("rain", RAIN_TOLERANCE_MM).alias("rain_mm"),
        F.avg("temp").alias("mean_temp_c"), F.max("temp").alias("max_temp_c"),
        F.min("temp").alias("min_temp_c"), F.avg("humid").alias("mean_humidity_pct"),
        total("sun", RADIATION_TOLERANCE_KJ).alias("radiation_kj_m2"),
        F.avg("wind").alias("mean_wind_m_s"),
        (F.count("rain") * hours).alias("rain_observations"),
        F.count("temp").alias("temp_observations"), F.count("humid").alias("humidity_observations"),
        (F.count("sun") * hours).alias("radiation_observations"),
        F.count("wind").alias("wind_observations"),
        negative("rain").alias("rain_negative_increments"),
        negative("sun").alias("radiation_negative_increments"),
    )


def _nonnegative(c: Column, tolerance: float) -> Column:
    """Zero for tiny negatives, NULL for real ones."""
    return F.when(c >= -tolerance, F.greatest(c, F.lit(0.0)))


def location_daily(
    grid: DataFrame, locations: DataFrame, *, mode: str, source_checksum: str,
    max_grid_distance_km: float = MAX_GRID_KM,
) -> DataFrame:
    """Daily rows of every location from the grid cell nearest to it."""
    mapping = map_to_grid(locations, grid, max_grid_distance_km=max_grid_distance_km)
    cell = ["grid_lat", "grid_lon"]
    used = standard_variables(grid).join(mapping.select(*cell).distinct(), cell, "left_semi")
    daily = daily_totals(merged_hours(used, cell), keys=cell, mode=mode)
    return daily.join(mapping, cell).select(
        *LOCATION, "data", *VALUES, *COUNTS, *GRID,
        F.lit("estimated").alias("data_nature"), F.lit(SOURCES[mode]).alias("source"),
        F.lit(TEMPORAL_METHODS[mode]).alias("temporal_method"),
        F.array(F.lit(source_checksum)).alias("source_checksums"),
    )


COMBINED = [*VALUES, *LOCATION[1:], *GRID, "source", "data_nature", "temporal_method"]


def combined_with_conflicts(*frames: DataFrame) -> DataFrame:
    """Daily frames coalesced per municipality and day, naming columns that disagree."""
    rows = union_widening(*frames)
    key = ["codigo_ibge", "data"]
    kinds = [c for c in COMBINED if c in rows.columns]
    spread = [F.min(c).alias(f"_min_{c}") for c in kinds] + [F.max(c).alias(c) for c in kinds]
    merged = rows.groupBy(*key).agg(
        *spread,
        *[F.max(c).alias(c) for c in COUNTS],
        # One checksum per source file that touched the day.
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("source_checksums")))).alias("source_checksums"),
    )
    conflict = F.array_compact(F.array(*[F.when(F.col(f"_min_{c}") != F.col(c), F.lit(c)) for c in kinds]))
    return merged.withColumn("conflicts", conflict).drop(*[f"_min_{c}" for c in kinds])


def combine_daily(*frames: DataFrame) -> DataFrame:
    """Coalesced daily rows; differing overlaps fail the job."""
    return require_no_conflicts(combined_with_conflicts(*frames), "reanalysis")


def reanalysis_seasons(daily: DataFrame, *, minimum_coverage: float = 0.70) -> DataFrame:
    """September-April features per municipality; missing rain stays missing, never dry."""
    if not 0 < minimum_coverage <= 1:
        raise ValueError("minimum_coverage must be in (0, 1]")
    month, rain = F.month("data"), F.col("rain_mm")
    counted = lambda c, test: F.when(F.count(c) > 0, F.count_if(test))
    season = in_season(combine_daily(daily)).groupBy(
        *LOCATION, *GRID, "season_year", "source", "temporal_method"
    ).agg(
        F.sum(rain).alias("rain_crop_cycle_mm"),
        F.sum(F.when(month == 4, rain)).alias("rain_30d_mm"),
        F.sum(F.when(month.isin(3, 4), rain)).alias("rain_60d_mm"),
        F.sum(F.when(month.isin(2, 3, 4), rain)).alias("rain_90d_mm"),
        counted("rain_mm", rain < 1).alias("dry_days"),
        counted("max_temp_c", F.col("max_temp_c") > 35).alias("days_temp_gt_35"),
        counted("min_temp_c", F.col("min_temp_c") < 10).alias("days_temp_lt_10"),
        weighted_mean("mean_temp_c", "temp_observations").alias("mean_temp_c"),
        F.max("max_temp_c").alias("max_temp_c"), F.min("min_temp_c").alias("min_temp_c"),
        weighted_mean("mean_humidity_pct", "humidity_observations").alias("mean_humidity_pct"),
        F.sum("radiation_kj_m2").alias("radiation_sum_kj_m2"),
        weighted_mean("mean_wind_m_s", "wind_observations").alias("mean_wind_m_s"),
        F.sum("temp_observations").alias("valid_temp_hours"),
        F.coalesce(F.sum(F.when(rain.isNotNull(), F.col("rain_observations"))), F.lit(0)).alias("valid_rain_hours"),
        F.count(F.lit(1)).alias("calendar_days_present"),
        F.sum("rain_negative_increments").alias("rain_negative_increments"),
        F.sum("radiation_negative_increments").alias("radiation_negative_increments"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("source_checksums")))).alias("source_checksums"),
    )
    expected = season_hours("season_year")
    covered = season.withColumns(
        {
            "expected_hours": expected,
            "temp_coverage": F.col("valid_temp_hours") / expected,
            "rain_coverage": F.col("valid_rain_hours") / expected,
        }
    ).withColumn("season_coverage", F.least("temp_coverage", "rain_coverage"))
    enough = F.col("season_coverage") >= minimum_coverage
    text = lambda: F.lit(None).cast("string")
    return withhold(covered, enough, FEATURES).withColumns(
        {
            "data_nature": F.lit("estimated"),
            "method": F.concat(F.lit(METHOD_PREFIX), "temporal_method"),
            "station_code": text(), "station_name": text(), "station_uf": text(),
            "distance_to_station_km": F.lit(None).cast("double"),
            "quality_flag": F.when(enough, FALLBACK).otherwise(INSUFFICIENT),
        }
    )
