"""Station climate: hourly readings to daily, to station seasons, to municipality seasons."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import plausible_readings, provenance, season_hours, season_year, withhold
from ..functions.geo import chord_to_km, half_chord
from ..operators.merge import keep_last, union_widening
from ..operators.neighbours import extreme_neighbours
from ..operators.quality import guarded, many_to_one

# Station identity, seasonal climate features and provenance texts.
METADATA = ["station_name", "station_uf", "station_latitude", "station_longitude", "station_altitude_m"]
FEATURES = [
    "rain_crop_cycle_mm", "rain_30d_mm", "rain_60d_mm", "rain_90d_mm", "dry_days",
    "days_temp_gt_35", "days_temp_lt_10", "mean_temp_c", "max_temp_c", "min_temp_c",
    "mean_humidity_pct", "radiation_sum_kj_m2", "mean_wind_m_s",
]
METADATA_AUDIT = [
    "station_metadata_versions", "station_metadata_max_shift_km",
    "station_metadata_tolerance_km", "station_metadata_policy",
]
METADATA_TOLERANCE_KM = 1.0
DAILY_SOURCE = "INMET automatic station annual archive"
STATION_SOURCE = "INMET automatic station annual archives"
WITHIN = "nearest INMET automatic station within configured radius"
OUTSIDE = "nearest station exceeds configured radius; features withheld"
NO_STATION = "NO_NEARBY_INMET_STATION"
MUNICIPALITY = ["codigo_ibge", "municipio", "uf", "latitude_centroid", "longitude_centroid"]


def station_daily(hourly: DataFrame, *, keys: list[str]) -> DataFrame:
    """Daily sums, means, extremes and observation counts of plausible hourly readings.

    A day without any rain reading has sum 0 and count 0, so counts must be read with sums.
    """
    rain, temp, humid = F.col("precipitacao_mm"), F.col("temperatura_c"), F.col("umidade_pct")
    radiation, wind = F.col("radiacao_kj_m2"), F.col("vento_m_s")
    return plausible_readings(hourly.where("data is not null")).groupBy(*keys, "data").agg(
        F.coalesce(F.sum(rain), F.lit(0.0)).alias("rain_mm"),
        F.count(rain).alias("rain_observations"),
        F.avg(temp).alias("mean_temp_c"), F.count(temp).alias("temp_observations"),
        F.max("temperatura_max_c").alias("max_temp_c"),
        F.min("temperatura_min_c").alias("min_temp_c"),
        F.avg(humid).alias("mean_humidity_pct"), F.count(humid).alias("humidity_observations"),
        F.coalesce(F.sum(radiation), F.lit(0.0)).alias("radiation_kj_m2"),
        F.count(radiation).alias("radiation_observations"),
        F.avg(wind).alias("mean_wind_m_s"), F.count(wind).alias("wind_observations"),
    )


def archive_daily(hourly: DataFrame, *, source_checksum: str) -> DataFrame:
    """Daily rows of the stations read from one archive."""
    daily = station_daily(hourly, keys=["member", "station_code", *METADATA]).drop("member")
    return provenance(
        daily, data_nature="observed", source=DAILY_SOURCE, source_dataset_checksum=source_checksum
    )


def upsert_daily(existing: DataFrame, new: DataFrame) -> DataFrame:
    both = union_widening(existing.withColumn("_load", F.lit(0)), new.withColumn("_load", F.lit(1)))
    return keep_last(both, ["station_code", "data"], ["_load"]).drop("_load")


def in_season(daily: DataFrame) -> DataFrame:
    """Days of September to April with the harvest year they belong to."""
    return daily.withColumn("season_year", season_year("data")).where("season_year is not null")


SEASON_WORDS = 4  # 61 days each hold the at most 243 days of a season


def _day_bits() -> list:
    """One bit per day of the season, so that distinct days merge as plain numbers."""
    first = F.make_date(F.col("season_year") - 1, F.lit(9), F.lit(1))
    index = F.datediff("data", first)
    bit = F.expr("shiftleft(1L, pmod(datediff(data, make_date(season_year - 1, 9, 1)), 61))")
    return [
        F.bit_or(F.when(F.floor(index / 61) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"_days{w}")
        for w in range(SEASON_WORDS)
    ]


def _version_totals(daily: DataFrame) -> DataFrame:
    """Mergeable totals per station, season, metadata version and yearly archive.

    All season features are sums, extremes or weighted means of fixed width, so the daily rows are
    hashed once here, with partial sums before the shuffle, and versions are joined afterwards on
    this small table.
    """
    month, rain = F.month("data"), F.col("rain_mm")
    product = lambda v, w: F.sum(F.col(v) * F.col(w))
    seen = F.col("rain_observations") > 0
    return in_season(daily).groupBy(
        "station_code", "season_year", *METADATA, "source_dataset_checksum"
    ).agg(
        F.sum(rain).alias("rain_crop_cycle_mm"),
        F.sum(F.when(month == 4, rain)).alias("rain_30d_mm"),
        F.sum(F.when(month.isin(3, 4), rain)).alias("rain_60d_mm"),
        F.sum(F.when(month.isin(2, 3, 4), rain)).alias("rain_90d_mm"),
        F.count_if(seen & (rain < 1.0)).alias("dry_days"),
        F.count_if(F.col("max_temp_c") > 35).alias("days_temp_gt_35"),
        F.count_if(F.col("min_temp_c") < 10).alias("days_temp_lt_10"),
        product("mean_temp_c", "temp_observations").alias("_temp"),
        F.max("max_temp_c").alias("max_temp_c"), F.min("min_temp_c").alias("min_temp_c"),
        product("mean_humidity_pct", "humidity_observations").alias("_humidity"),
        F.sum("humidity_observations").alias("_humidity_w"),
        F.sum("radiation_kj_m2").alias("radiation_sum_kj_m2"),
        product("mean_wind_m_s", "wind_observations").alias("_wind"),
        F.sum("wind_observations").alias("_wind_w"),
        F.sum("temp_observations").alias("valid_temp_hours"),
        F.sum("rain_observations").alias("valid_rain_hours"),
        F.max("data").alias("_last_day"),
        *_day_bits(),
    )


def _widest(places: str) -> Column:
    """Largest distance between two places of an array."""
    apart = lambda a, b: half_chord(a.lat, a.lon, b.lat, b.lon)
    return chord_to_km(F.array_max(F.transform(places, lambda a: F.array_max(F.transform(places, lambda b: apart(a, b))))))


def _judged(tolerance_km: float) -> dict[str, Column]:
    """The metadata decision from `_versions`, `_same_uf`, `_unplaced` and `_places`."""
    if not math.isfinite(tolerance_km) or tolerance_km < 0:
        raise ValueError("metadata tolerance must be finite and not negative")
    shift = F.when(~F.col("_unplaced"), F.when(F.size("_places") > 1, _widest("_places")).otherwise(0.0))
    merge = F.coalesce((shift <= tolerance_km) & F.col("_same_uf"), F.lit(False))
    policy = (
        F.when(F.col("_versions") == 1, "stable")
        .when(~F.col("_same_uf"), "segmented_uf_change")
        .when(merge, "canonicalized_latest_within_tolerance")
        .otherwise("segmented_coordinate_shift_over_tolerance")
    )
    return {
        "station_metadata_versions": F.col("_versions").cast("long"), "station_metadata_max_shift_km": shift,
        "station_metadata_tolerance_km": F.lit(float(tolerance_km)), "station_metadata_policy": policy, "_merge": merge,
    }


def _version_facts(over) -> dict[str, Column]:
    """What is known of the metadata versions of a station and season; `over` makes an aggregate of them."""
    unplaced = F.col("station_latitude").isNull() | F.col("station_longitude").isNull()
    place = F.struct(F.col("station_latitude").alias("lat"), F.col("station_longitude").alias("lon"))
    return {
        "_versions": F.size(over(F.collect_set(F.struct(*METADATA)))),
        "_same_uf": over(F.min("station_uf")).eqNullSafe(over(F.max("station_uf"))),
        "_unplaced": over(F.max(unplaced)), "_places": over(F.collect_set(place)),
        "_latest": over(F.max(F.struct("_last_day", *METADATA))),
    }


def metadata_policy(versions: DataFrame, tolerance_km: float = METADATA_TOLERANCE_KM) -> DataFrame:
    """Per station and season: may its metadata versions be merged, and into which one.

    Versions merge when the state is unchanged and no two of them lie further apart than the
    tolerance; the latest version then names the station. A station has one row a day, so a season's versions
    are no more than its days and fit one row.
    """
    key = ["station_code", "season_year"]
    judged = _judged(tolerance_km)
    facts = versions.groupBy(*key).agg(*[c.alias(name) for name, c in _version_facts(lambda c: c).items()])
    return facts.select(*key, *[c.alias(name) for name, c in judged.items()], "_latest")


def station_seasons(daily: DataFrame, *, metadata_tolerance_km: float = METADATA_TOLERANCE_KM) -> DataFrame:
    """Season features per station segment, with coverage and the metadata decision.

    The versions of a station and season are a few rows of totals; the decision is made beside them in a window.
    """
    judged = _judged(metadata_tolerance_km)
    season_of = Window.partitionBy("station_code", "season_year")
    facts = _version_totals(daily).withColumns(_version_facts(lambda c: c.over(season_of)))
    named = facts.withColumns(judged).withColumns(
        {m: F.when(F.col("_merge"), F.col(f"_latest.{m}")).otherwise(F.col(m)) for m in METADATA}
    )
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0)).alias(c)
    ratio = lambda v, w: F.try_divide(F.sum(v), F.sum(w))
    days = reduce(lambda a, b: a + b, [F.bit_count(F.bit_or(f"_days{w}")) for w in range(SEASON_WORDS)])
    season = named.groupBy("station_code", *METADATA, "season_year").agg(
        *[zero(c) for c in FEATURES[:4]],
        *[F.sum(c).alias(c) for c in FEATURES[4:7]],
        ratio("_temp", "valid_temp_hours").alias("mean_temp_c"),
        F.max("max_temp_c").alias("max_temp_c"), F.min("min_temp_c").alias("min_temp_c"),
        ratio("_humidity", "_humidity_w").alias("mean_humidity_pct"),
        zero("radiation_sum_kj_m2"),
        ratio("_wind", "_wind_w").alias("mean_wind_m_s"),
        F.sum("valid_temp_hours").alias("valid_temp_hours"),
        F.sum("valid_rain_hours").alias("valid_rain_hours"),
        days.cast("long").alias("calendar_days_present"),
        F.array_sort(F.collect_set("source_dataset_checksum")).alias("source_checksums"),  # one per archive
        *[F.max(c).alias(c) for c in METADATA_AUDIT],
    )
    expected = season_hours("season_year")
    covered = season.withColumns(
        {
            "expected_hours": expected,
            "temp_coverage": F.col("valid_temp_hours") / expected,
            "rain_coverage": F.col("valid_rain_hours") / expected,
        }
    ).withColumn("season_coverage", F.least("temp_coverage", "rain_coverage"))
    return provenance(covered, data_nature="observed", source=STATION_SOURCE)


def municipality_seasons(
    seasons: DataFrame, locations: DataFrame, *, max_distance_km: float, minimum_coverage: float
) -> DataFrame:
    """Every placed municipality in every season with its nearest adequately covered station.

    The nearest station is reported even beyond the radius, with its features withheld. ``seasons`` is read once for each
    level of the search, so give a stored table, or one cut from its lineage.
    """
    adequate = seasons.where(F.col("season_coverage") >= minimum_coverage)
    audit = [c for c in METADATA_AUDIT if c in seasons.columns]
    carried = ["station_name", "station_uf", *FEATURES, "season_coverage", "source_checksums", *audit]
    name = F.struct("station_code", *METADATA)  # tells the segments of a season apart; features join the winners only
    targets = adequate.select("season_year", "station_latitude", "station_longitude", name.alias("station"))
    features = adequate.select("season_year", name.alias("station"), "station_code", *carried)
    placed = locations.where("latitude_centroid is not null and longitude_centroid is not null").select(
        *MUNICIPALITY
    )
    # Seasons without an adequate station yield no rows; none at all fails the job.
    found = targets.agg(F.count(F.lit(1)).alias("_n"))
    nearest = extreme_neighbours(
        placed, targets, by=["season_year"], every_group=True,
        point_coordinates=("latitude_centroid", "longitude_centroid"),
        target_coordinates=("station_latitude", "station_longitude"), target_key="station",
    )
    described = many_to_one(nearest, features, ["season_year", "station"], what="station seasons")
    joined = placed.join(described, ["latitude_centroid", "longitude_centroid"]).select(
        *MUNICIPALITY, "season_year", "station_code", *carried, F.col("distance_km").alias("distance_to_station_km")
    )
    near = F.col("distance_to_station_km") <= max_distance_km
    withheld = withhold(
        joined.withColumns(
            {
                "data_nature": F.when(near, "interpolated").otherwise("estimated"),
                "method": F.when(near, WITHIN).otherwise(OUTSIDE),
                "quality_flag": F.when(~near, F.lit(NO_STATION)),
                "source": F.lit(STATION_SOURCE),
            }
        ),
        near, [*FEATURES, "season_coverage"],
    )
    return guarded(withheld, found, F.col("_n") == 0, F.lit("there is no adequate station in any season"))


def climate_report(municipal: DataFrame) -> DataFrame:
    """Rows, municipalities, season range and rows within or outside the station radius."""
    per_place = municipal.groupBy("codigo_ibge").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("season_year").alias("first"), F.max("season_year").alias("last"),
        F.count_if(F.col("quality_flag").isNull()).alias("within"),
        F.count_if(F.col("quality_flag") == NO_STATION).alias("outside"),
    )
    return per_place.agg(
        F.sum("rows").alias("municipality_season_rows"), F.count(F.lit(1)).alias("municipalities"),
        F.min("first").alias("season_year_min"), F.max("last").alias("season_year_max"),
        F.sum("within").alias("within_radius_rows"), F.sum("outside").alias("outside_radius_rows"),
    )

