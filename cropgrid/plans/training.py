"""Supervised frames for yield models: training rows, inference rows and the dataset report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import with_defaults
from ..operators.quality import many_to_one, missing_counts
from ..operators.quantiles import exact_quantiles
from ..session import kept_table
from .history import history_features, trailing_median
from .station import FEATURES, STATION_SOURCE

# Lagged climate columns, model features and contract texts.
CLIMATE_FEATURES = [*FEATURES, "season_coverage", "distance_to_station_km"]
CLIMATE_METADATA = ["source", "data_nature", "method", "quality_flag", "distance_to_grid_km"]
LAG = "climate_lag1_"
MODEL_FEATURES = [
    "ano", "latitude_centroid", "longitude_centroid", "yield_mean_3y", "yield_mean_5y",
    "yield_std_5y", "yield_cv_5y", "yield_trend_5y", "yield_trend_10y", "area_mean_5y",
    "production_mean_5y", "crop_presence_years", "baseline_municipal_median_5y",
    "baseline_regional_median_lag1", *[LAG + c for c in CLIMATE_FEATURES],
]
TARGET = "produtividade_kg_ha"
LEAKAGE_CONTRACT = "all features available before target harvest year"
NOT_AVAILABLE = "not_available"


def lagged_climate(climate: DataFrame) -> DataFrame:
    """Climate keyed by the harvest year it may inform: season Y-1 for year Y."""
    rain = F.col("rain_crop_cycle_mm").isNotNull()
    text = F.lit(None).cast("string")
    full = with_defaults(
        climate,
        {
            "source": F.lit(STATION_SOURCE),
            "data_nature": F.when(rain, "interpolated").otherwise(NOT_AVAILABLE),
            "method": text, "quality_flag": text, "distance_to_grid_km": F.lit(None).cast("double"),
        },
    )
    return full.select(
        "codigo_ibge", F.col("season_year").alias("climate_reference_season"),
        (F.col("season_year") + 1).alias("ano"),
        *[F.col(c).alias(LAG + c) for c in [*CLIMATE_FEATURES, *CLIMATE_METADATA]],
    )


def regional_medians(history: DataFrame, *, positive_only: bool) -> DataFrame:
    """State median yield of year Y-1 under the key of year Y.

    Training keeps zero yields and inference drops them; the caller states which. The yields are kept once, as their sums may
    differ in the last digit when they are made again, and a median is looked for in three rounds.
    """
    rows = history.where(F.col(TARGET) > 0) if positive_only else history
    kept = kept_table(rows.where(F.col(TARGET).isNotNull()).select("uf", "ano", TARGET), "yields")
    yearly = exact_quantiles(kept, ["uf", "ano"], TARGET, {"baseline_regional_median_lag1": 0.5})
    return yearly.withColumn("ano", F.col("ano") + 1)


def _centroids(locations: DataFrame) -> DataFrame:
    return locations.select("codigo_ibge", "latitude_centroid", "longitude_centroid")


def training_frame(
    history: DataFrame, climate: DataFrame, locations: DataFrame, *, start_year: int, end_year: int,
    crop: str = "soja",
) -> DataFrame:
    """Positive-yield rows of the year range with baselines and last season's climate.

    Medians are taken before the year filter, so early rows still see their past.
    """
    crop_rows = history.where(F.col("cultura") == crop)
    ranged = crop_rows.withColumn("baseline_municipal_median_5y", trailing_median(TARGET)).where(
        F.col("ano").between(start_year, end_year) & (F.col(TARGET) > 0)
    )
    joined = (
        ranged.join(regional_medians(crop_rows, positive_only=False), ["uf", "ano"], "left")
        .join(lagged_climate(climate), ["codigo_ibge", "ano"], "left")
    )
    joined = many_to_one(joined, _centroids(locations), ["codigo_ibge"], "left", "locations")
    nature = F.when(F.col(LAG + "rain_crop_cycle_mm").isNotNull(), F.col(LAG + "data_nature"))
    return joined.withColumns(
        {
            "target_name": F.lit(TARGET), "leakage_contract": F.lit(LEAKAGE_CONTRACT),
            "climate_data_nature": nature.otherwise(NOT_AVAILABLE),
        }
    )


def inference_frame(
    panel: DataFrame, climate: DataFrame, locations: DataFrame, *, target_year: int | None = None,
    crop: str = "soja",
) -> DataFrame:
    """One future row per municipality, from what is known before its target year.

    Without ``target_year`` it is the year after the last known yield; municipalities with a later
    row than that have no valid target and no row, as have those without a centroid.
    """
    series = panel.where(F.col("cultura") == crop)
    per_code = series.groupBy("codigo_ibge").agg(
        F.max("ano").alias("_last"),
        F.max(F.when(F.col(TARGET).isNotNull(), F.col("ano"))).alias("_known"),
        F.max(F.struct("ano", *[c for c in series.columns if c != "ano"])).alias("_row"),
    )
    target = F.lit(target_year).cast("int") if target_year else F.col("_known") + 1
    kinds = dict(series.dtypes)
    blank = {"area_plantada_ha", "area_colhida_ha", "producao_t", TARGET, "valor_producao_brl"}
    future = per_code.withColumn("_target", target).where(F.col("_target") > F.col("_last")).select(
        *[
            F.col("_target").cast(kinds[c]).alias(c) if c == "ano"
            else F.lit(None).cast(kinds[c]).alias(c) if c in blank
            else F.col(f"_row.{c}").alias(c)
            for c in series.columns
        ],
        F.lit(True).alias("_future"),
    )
    featured = history_features(
        series.withColumn("_future", F.lit(False)).unionByName(future)
    ).where("_future").drop("_future")

    # The last five positive harvests of a municipality; its series is bounded by years.
    latest = Window.partitionBy("codigo_ibge").orderBy(F.desc("ano"))
    recent = series.where(F.col(TARGET) > 0).withColumn("_back", F.row_number().over(latest))
    municipal = recent.where("_back <= 5").groupBy("codigo_ibge").agg(
        F.when(F.count(TARGET) >= 3, F.percentile(TARGET, 0.5)).alias("baseline_municipal_median_5y")
    )
    joined = (
        featured.join(municipal, "codigo_ibge", "left")
        .join(regional_medians(series, positive_only=True), ["uf", "ano"], "left")
        .join(lagged_climate(climate), ["codigo_ibge", "ano"], "left")
    )
    return many_to_one(joined, _centroids(locations), ["codigo_ibge"], "inner", "locations")


def dataset_report(frame: DataFrame) -> DataFrame:
    """One row: size, years, municipalities and the target distribution."""
    per_place = frame.groupBy("codigo_ibge", "uf").agg(
        F.count(F.lit(1)).alias("rows"), F.min("ano").alias("y0"), F.max("ano").alias("y1"),
        F.min(TARGET).alias("t0"), F.max(TARGET).alias("t1"), F.sum(TARGET).alias("t"),
    )
    totals = per_place.groupBy("uf").agg(
        F.count_distinct("codigo_ibge").alias("codes"), F.sum("rows").alias("rows"),
        F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("t0").alias("t0"),
        F.max("t1").alias("t1"), F.sum("t").alias("t"),
    ).agg(
        F.sum("rows").alias("rows"), F.min("y0").alias("year_min"), F.max("y1").alias("year_max"),
        F.sum("codes").alias("municipalities"), F.count(F.lit(1)).alias("ufs"),
        F.min("t0").alias("target_min"), F.max("t1").alias("target_max"),
        (F.sum("t") / F.sum("rows")).alias("target_mean"),
    )
    spread = exact_quantiles(
        frame, [], TARGET, {"target_p10": 0.10, "target_median": 0.50, "target_p90": 0.90}
    )
    return totals.join(F.broadcast(spread))  # two single rows


def feature_gaps(frame: DataFrame, features: list[str] = MODEL_FEATURES) -> DataFrame:
    return missing_counts(frame, features)


def climate_mix(frame: DataFrame) -> DataFrame:
    """Rows per lagged climate source and nature."""
    return frame.groupBy(LAG + "source", "climate_data_nature").agg(F.count(F.lit(1)).alias("rows"))
