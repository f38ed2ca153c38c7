"""Coverage reports and consistency audits over the climate and decision tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import is_finite
from ..operators.merge import CLIMATE_KEY, adequate_climate
from ..operators.quality import set_difference
from ..sources.writers import fingerprint, latest_manifests

# Reanalysis sources, station columns and the published layout of the grid store.
REANALYSIS_SOURCES = ("Copernicus ERA5-Land reanalysis", "Copernicus ERA5-Land ARCO reanalysis")
STATION_COLUMNS = ["station_code", "station_name", "station_uf", "distance_to_station_km"]
STORE_URL = "https://arco.datastores.ecmwf.int"
STORE_GROUPS = {
    "temperature": ("007", "sfc-2m-temperature", ("t2m", "d2m")),
    "wind": ("008", "sfc-wind", ("u10", "v10")),
    "rain": ("009", "sfc-pressure-precipitation", ("tp",)),
    "radiation": ("010", "sfc-radiation-heat", ("ssrd",)),
}
COORDINATES = ("time", "latitude", "longitude")


def location_coverage(municipalities: DataFrame, mesh: DataFrame) -> DataFrame:
    """Codes known on one side only: ``code, side``."""
    return set_difference(municipalities, mesh.withColumnRenamed("codarea", "codigo_ibge"), "codigo_ibge")


def climate_coverage(
    climate: DataFrame, *, minimum_coverage: float = 0.70, max_distance_km: float = 250.0
) -> DataFrame:
    """One row counting available, missing, in-radius, fallback and outside rows."""
    ok = adequate_climate(minimum_coverage)
    station = F.coalesce(F.col("source").contains("INMET"), F.lit(False))
    reanalysis = F.coalesce(F.col("source").contains("ERA5"), F.lit(False))
    outside = F.coalesce(F.col("quality_flag") == "NO_NEARBY_INMET_STATION", F.lit(False))
    tests = {
        "inmet_within_radius_rows": ok & station & (F.col("distance_to_station_km") <= max_distance_km),
        "era5_land_fallback_rows": ok & reanalysis,
        "available_rows": ok,
        "missing_climate_rows": ~ok,
        "outside_inmet_radius_rows": outside | reanalysis,
        "unfilled_outside_inmet_radius_rows": outside & ~reanalysis,
    }
    per_place = climate.groupBy("codigo_ibge").agg(
        F.count(F.lit(1)).alias("rows"), F.min("season_year").alias("y0"), F.max("season_year").alias("y1"),
        *[F.count_if(test).alias(name) for name, test in tests.items()],
    )
    return per_place.agg(
        F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("municipalities"),
        F.min("y0").alias("season_year_min"), F.max("y1").alias("season_year_max"),
        *[F.sum(name).alias(name) for name in tests],
    )


def dataset_rows(tables: dict[str, DataFrame | None]) -> DataFrame:
    """``dataset, available, rows`` of every table; an absent one counts as unavailable."""
    spark = next(t for t in tables.values() if t is not None).sparkSession
    rows = []
    for name, df in tables.items():
        if df is None:
            rows.append(spark.range(1).select(F.lit(name).alias("dataset"), F.lit(False).alias("available"), F.lit(0).cast("long").alias("rows")))
        else:
            rows.append(df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("dataset"), F.lit(True).alias("available"), "rows"))
    return reduce(DataFrame.unionByName, rows)


# Columns that the audit reads of every climate table and of its reanalysis rows.
REQUIRED = [*CLIMATE_KEY, "rain_crop_cycle_mm", "mean_temp_c", "season_coverage", "source", "quality_flag"]
GRID_PROVENANCE = [*STATION_COLUMNS, "distance_to_grid_km", "data_nature", "source_checksums"]


def climate_columns(baseline: DataFrame, combined: DataFrame, fallback: DataFrame | None) -> dict[str, int]:
    """Columns that are absent, by check; read from the schemas alone."""
    tables = [t for t in (baseline, combined, fallback) if t is not None]
    absent = lambda wanted, table: sum(c not in table.columns for c in wanted)
    return {
        "required_columns": sum(absent(REQUIRED, t) for t in tables),
        "inmet_original_columns_preserved": absent(baseline.columns, combined),
        "era5_provenance_columns": absent(GRID_PROVENANCE, combined),
    }


def climate_audit(
    baseline: DataFrame, combined: DataFrame, fallback: DataFrame | None = None, *,
    expected_rows: int | None = None, minimum_coverage: float = 0.70, max_grid_km: float = 20.0,
) -> DataFrame:
    """``check_name, failing_rows`` for every consistency rule of the merged climate table.

    The tables meet in one aggregate by key that feeds all counters, so each is read once (and the baseline's source names
    once more). Rules between tables count keys, those on single rows and on null keys count rows, those on columns count
    absent columns. If columns are absent, only these are reported.
    """
    columns = climate_columns(baseline, combined, fallback)
    names = combined.sparkSession.range(1)
    listed = lambda df: df.unpivot([], df.columns, "check_name", "failing_rows")
    if any(columns.values()):
        return listed(names.select(*[F.lit(n).cast("long").alias(c) for c, n in columns.items()]))

    ok = adequate_climate(minimum_coverage)
    reanalysis = F.coalesce(F.col("source").isin(*REANALYSIS_SOURCES), F.lit(False))
    inside = is_finite("distance_to_grid_km") & F.col("distance_to_grid_km").between(0, max_grid_km)
    claims = reduce(lambda x, y: x | y, [F.col(s).isNotNull() for s in STATION_COLUMNS])
    known = baseline.select("source").distinct().withColumn("_known", F.lit(True))
    single = {
        "known_climate_source": ~reanalysis & F.col("_known").isNull(),
        "era5_adequate_coverage": reanalysis & ~ok,
        "era5_estimated": reanalysis & ~F.coalesce(F.col("data_nature") == "estimated", F.lit(False)),
        "era5_no_station_claim": reanalysis & claims,
        "era5_grid_distance": reanalysis & ~F.coalesce(inside, F.lit(False)),
        "era5_nonnegative_rain": reanalysis & ~(is_finite("rain_crop_cycle_mm") & F.coalesce(F.col("rain_crop_cycle_mm") >= 0, F.lit(False))),
        "era5_source_checksums_present": reanalysis & ~F.coalesce(F.size("source_checksums") > 0, F.lit(False)),
    }
    digest = lambda cols: F.xxhash64(*[F.col(c) for c in cols])
    offered = [c for c in fallback.columns if c in combined.columns] if fallback is not None else []
    never, nothing = F.lit(False), F.lit(None).cast("long")

    def side(df: DataFrame, name: str) -> DataFrame:
        main, is_combined = name != "fallback", name == "combined"
        content = F.when(reanalysis, digest(offered)) if is_combined else digest(offered) if name == "fallback" else nothing
        return df.select(
            *CLIMATE_KEY, F.lit(name).alias("_side"), (digest(baseline.columns) if main else nothing).alias("_row"),
            (content if offered else nothing).alias("_content"), (ok if main else never).alias("_ok"),
            (reanalysis if is_combined else never).alias("_filled"),
            *[(test if is_combined else never).alias(c) for c, test in single.items()],
        )

    sides = [side(baseline, "baseline"), side(combined.join(known, "source", "left"), "combined")]
    if fallback is not None:
        sides.append(side(fallback, "fallback"))
    of = lambda name: F.col("_side") == name
    # Copies meet first by content, so that a key with many rows is a few numbers for each content.
    by_content = reduce(DataFrame.unionByName, sides).groupBy(*CLIMATE_KEY, "_content").agg(
        F.count_if(of("baseline")).alias("_b"), F.count_if(of("combined")).alias("_c"), F.count_if(of("fallback")).alias("_f"),
        F.count_if("_filled").alias("_used"), F.max(F.when(of("baseline"), F.col("_ok"))).alias("_b_ok"),
        *[f(F.when(of(name), F.col("_row"))).alias(f"_{name[0]}_{f.__name__}") for name in ("baseline", "combined") for f in (F.min, F.max)],
        *[F.count_if(c).alias(c) for c in single],
    )
    per_key = by_content.groupBy(*CLIMATE_KEY).agg(
        *[F.sum(c).alias(c) for c in ("_b", "_c", "_f", "_used", *single)], F.max("_b_ok").alias("_b_ok"),
        *[f(f"_{x}_{f.__name__}").alias(f"_{x}_{f.__name__}") for x in "bc" for f in (F.min, F.max)],
        F.sum(F.abs(F.col("_f") - F.col("_used"))).alias("_apart"),
    )
    keyed = ~F.greatest(*[F.col(k).isNull() for k in CLIMATE_KEY], F.lit(False))
    has_b, has_c, good = F.col("_b") > 0, F.col("_c") > 0, F.coalesce("_b_ok", F.lit(False))
    kept = (F.col("_b") == F.col("_c")) & F.col("_b_min").eqNullSafe(F.col("_c_min")) & F.col("_b_max").eqNullSafe(F.col("_c_max"))
    between = {
        "unique_keys": (F.col("_b") > 1) | (F.col("_c") > 1),
        "same_key_universe": (has_b | has_c) & ~(has_b & has_c),
        "adequate_inmet_unchanged": good & ~kept,
        "era5_only_replaces_baseline_gaps": (F.col("_used") > 0) & (~has_b | good),
    }
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    counters = {"non_null_keys": total(F.when(~keyed, F.col("_b") + F.col("_c")))}
    counters |= {c: F.count_if(keyed & test) for c, test in between.items()}
    counters |= {c: total(c) for c in single}
    if expected_rows is not None:
        counters |= {f"{t}_expected_rows": F.abs(total(f"_{t[0]}") - expected_rows) for t in ("baseline", "combined")}
    if fallback is not None:
        counters["era5_gold_matches_fallback"] = total(F.when(F.col("_used") > 0, F.col("_apart")))
    else:
        counters["era5_fallback_present"] = total("_used")
    counters |= {c: F.lit(n).cast("long") for c, n in columns.items()}
    return listed(per_key.agg(*[c.cast("long").alias(name) for name, c in counters.items()]))


def manifest_audit(spark: SparkSession, root: str, datasets: list[str]) -> DataFrame:
    """``dataset, problem`` of stored tables whose newest manifest is absent or does not tell the table's rows or fingerprint."""
    found = {r["dataset"]: r for r in latest_manifests(spark, root).where(F.col("dataset").isin(*datasets)).collect()}  # one row a name
    parts = [spark.createDataFrame([(d, "manifest_missing") for d in datasets if d not in found], "dataset string, problem string")]
    for name, told in found.items():
        now = fingerprint(spark.read.parquet(told["path"]))
        wrong = F.array_compact(F.array(
            F.when(F.col("rows") != told["rows"], F.lit("gold_manifest_row_count")),
            F.when(F.col("fingerprint") != told["fingerprint"], F.lit("gold_manifest_checksum"))))
        parts.append(now.select(F.lit(name).alias("dataset"), F.explode(wrong).alias("problem")))
    return reduce(DataFrame.unionByName, parts)


def provenance_chain(rows: DataFrame, artifacts: DataFrame, *, listed: DataFrame | None = None) -> DataFrame:
    """Checksums a table names without a verified artifact, and, given the manifest's list, those
    on only one of both: ``checksum, problem``."""
    used = rows.select(F.explode("source_checksums").alias("checksum")).distinct()
    verified = artifacts.select(F.col("checksum_sha256").alias("checksum")).distinct()
    out = used.join(verified, "checksum", "left_anti").withColumn("problem", F.lit("unknown_checksum"))
    if listed is not None:
        named = listed.select(F.col("checksum_sha256").alias("checksum")).distinct()
        out = out.unionByName(
            used.join(named, "checksum", "left_anti").withColumn("problem", F.lit("not_in_manifest"))
        ).unionByName(
            named.join(used, "checksum", "left_anti").withColumn("problem", F.lit("only_in_manifest"))
        )
    return out


def _group_value(pick) -> Column:
    out = F.lit(None).cast("string")
    for group, info in STORE_GROUPS.items():
        out = F.when(F.col("group") == group, F.lit(pick(info))).otherwise(out)
    return out


def artifact_problems(records: DataFrame) -> DataFrame:
    """Problems of recorded source artifacts: ``subset, group, zarr_key, problem``.

    ``records``: ``subset, group, zarr_key, url, checksum_sha256, bytes, retention, artifact,
    missing_chunk, http_status, fill_value, metadata_checksum_sha256, metadata_fill_value``.
    Groups that miss their metadata, coordinates or variables are reported per subset.
    """
    key, name = F.col("zarr_key"), F.substring_index("zarr_key", "/", 1)
    prefix = F.concat(
        F.lit(f"{STORE_URL}/cadl-arco-geo-"), _group_value(lambda g: g[0]),
        F.lit("/arco/reanalysis_era5_land/"), _group_value(lambda g: g[1]), F.lit("/geoChunked.zarr/"),
    )
    variables = F.split(_group_value(lambda g: ",".join(g[2])), ",")
    metadata = key == ".zmetadata"
    coordinate = key.rlike(r"^(time|latitude|longitude)/[0-9]+$")
    variable = key.rlike(r"^[^/]+/[0-9]+\.[0-9]+\.[0-9]+$") & F.array_contains(variables, name)
    missing = F.coalesce("missing_chunk", F.lit(False))
    checksum = F.coalesce(F.col("checksum_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))
    is_ = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    absent_ok = (
        variable & is_("http_status", 404) & is_("fill_value", "NaN") & is_("retention", "absent_source_chunk")
        & F.col("artifact").isNull() & F.col("checksum_sha256").isNull() & F.col("bytes").isNull()
    )
    problem = (
        F.when(F.col("group").isNull() | ~F.col("group").isin(*STORE_GROUPS) | key.isNull(), "arco_source_group_and_key")
        .when(~(F.coalesce(F.col("url") == F.concat(prefix, key), F.lit(False)) & (metadata | coordinate | variable)), "arco_source_official_url_and_key")
        .when(missing & ~absent_ok, "arco_missing_chunk_event")
        .when(missing & ~is_("metadata_fill_value", "NaN"), "arco_missing_chunk_metadata_nan")
        .when(~missing & ~checksum, "arco_source_checksum_format")
        .when(~missing & ~F.coalesce(F.col("bytes") > 0, F.lit(False)), "arco_source_byte_count")
        .when(~missing & variable & (~is_("retention", "memory_cache_only") | F.col("artifact").isNotNull()), "arco_remote_chunk_retention")
        .when(~missing & ~variable & (~is_("retention", "preserved_in_bronze") | F.col("artifact").isNull()), "arco_metadata_coordinate_retention")
    )
    judged = records.withColumns({"problem": problem, "_name": name, "_meta": metadata})
    bad = judged.where("problem is not null").select("subset", "group", "zarr_key", "problem")

    # Every subset must show each group's metadata, coordinates and variables: a fixed set of names.
    needed = [(g, n) for g, info in STORE_GROUPS.items() for n in (".zmetadata", *COORDINATES, *info[2])]
    pair = F.concat_ws("/", "group", "_name")
    seen = judged.where(F.col("problem").isNull()).groupBy("subset").agg(F.collect_set(pair).alias("_seen"))
    lacking = records.select("subset").distinct().join(seen, "subset", "left").select(
        "subset",
        F.explode(
            F.array_except(
                F.array(*[F.lit(f"{g}/{n}") for g, n in needed]),
                F.coalesce("_seen", F.array().cast("array<string>")),
            )
        ).alias("_lack"),
    )
    return bad.unionByName(
        lacking.select(
            "subset", F.substring_index("_lack", "/", 1).alias("group"),
            F.substring_index("_lack", "/", -1).alias("zarr_key"),
            F.lit("arco_required_source_missing").alias("problem"),
        )
    )
