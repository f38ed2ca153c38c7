"""Chained jobs: read stored tables, transform them, write the results and record them.

Tables live under one root with a manifest each (``sources.writers``). A job reads the newest versions, writes its own tables
in order and returns their manifest rows. Every table is written in one pass, with its fingerprint, its quality counters and
the checks of its rules observed on the way, and becomes current only when all that is well; a failed job leaves the tables that it
did not reach as they were. Manifests name the versions of the tables that a table was made from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .operators.merge import CLIMATE_KEY, adequate_climate
from .operators.quality import production_rules
from .plans import climate, panel, station, training
from .plans.history import history_features
from .sources import archive
from .sources.dimensions import crop_aliases
from .sources.writers import fingerprint, latest_manifests, read_table, replace_table

# Names of the stored tables.
DAILY, SEASONS, STATION, GRID, CLIMATE = "station_daily", "station_season", "station_climate", "grid_climate", "climate"
LOCATIONS, PANEL, TRAINING = "locations", "panel", "training"


class Stored:
    """The tables under a root, as a job sees them: what it reads is named in the manifests of what it writes."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None):
        self.spark, self.root, self.settings = spark, root, settings or Settings()
        self.versions = {r["dataset"]: r for r in latest_manifests(spark, root).collect()}  # one row a table

    def has(self, dataset: str) -> bool:
        return dataset in self.versions

    def read(self, dataset: str) -> DataFrame:
        if not self.has(dataset):
            raise FileNotFoundError(f"{dataset} is required before this job can run")
        return self.spark.read.parquet(self.versions[dataset]["path"])

    def verified(self, dataset: str) -> DataFrame:
        """The table, after its rows were found to be those that its manifest tells."""
        df, told = self.read(dataset), self.versions[dataset]
        found = fingerprint(df).first()
        if (found["rows"], found["fingerprint"]) != (told["rows"], told["fingerprint"]):
            raise ValueError(f"{dataset} is not the table of its manifest")
        return df

    def write(self, df: DataFrame, dataset: str, inputs: list[str], **options) -> DataFrame:
        """Replace a table and read it back."""
        made_from = [self.versions[name]["dataset_version"] for name in inputs if self.has(name)]
        replace_table(df, self.root, dataset, pipeline_version=self.settings.pipeline_version, inputs=made_from, **options)
        self.versions[dataset] = latest_manifests(self.spark, self.root).where(F.col("dataset") == dataset).first()
        return self.read(dataset)

    def manifests(self, *datasets: str) -> DataFrame:
        return latest_manifests(self.spark, self.root).where(F.col("dataset").isin(*datasets))


def _seasons() -> dict[str, Column]:
    return {"season_year_min": F.min("season_year"), "season_year_max": F.max("season_year")}


def ingest_archives(spark: SparkSession, root: str, path: str | list[str], *, checksum: str, settings: Settings | None = None) -> DataFrame:
    """Days of the stations in ZIP archives, put over those already stored. An archive without a usable member fails the job."""
    stored = Stored(spark, root, settings)
    daily = station.archive_daily(archive.checked_readings(archive.member_ranges(spark, path)), source_checksum=checksum)
    if stored.has(DAILY):
        daily = station.upsert_daily(stored.read(DAILY), daily)
    stored.write(daily, DAILY, [DAILY], counters={"day_min": F.min("data"), "day_max": F.max("data"), "rain_mm": F.sum("rain_mm")})
    return stored.manifests(DAILY)


def rebuild_climate(spark: SparkSession, root: str, *, settings: Settings | None = None, verify: bool = True) -> DataFrame:
    """Station seasons, their municipalities, and the table merged with whole-season reanalysis, from the stored days."""
    stored = Stored(spark, root, settings)
    cfg = stored.settings.climate
    daily, places = stored.verified(DAILY) if verify else stored.read(DAILY), stored.read(LOCATIONS)
    seasons = stored.write(
        station.station_seasons(daily), SEASONS, [DAILY], counters=_seasons(),
        rules={"station_code": F.col("station_code").isNotNull(), "season_year": F.col("season_year").isNotNull()})
    outside = F.col("quality_flag") == station.NO_STATION
    municipal = stored.write(
        station.municipality_seasons(seasons, places, max_distance_km=cfg.max_station_distance_km, minimum_coverage=cfg.minimum_season_coverage),
        STATION, [SEASONS, LOCATIONS],
        counters=_seasons() | {"within_radius_rows": F.count_if(F.col("quality_flag").isNull()), "outside_radius_rows": F.count_if(outside)},
        rules={"codigo_ibge": F.col("codigo_ibge").isNotNull()})
    ok = adequate_climate(cfg.minimum_season_coverage)
    merged = climate.merged_climate(municipal, stored.read(GRID), minimum_coverage=cfg.minimum_season_coverage) if stored.has(GRID) else municipal
    stored.write(
        merged, CLIMATE, [STATION, GRID],
        counters=_seasons() | {"adequate_rows": F.count_if(ok), "reanalysis_rows": F.count_if(F.coalesce(F.col("source").contains("ERA5"), F.lit(False)))},
        rules={c: F.col(c).isNotNull() for c in CLIMATE_KEY})
    return stored.manifests(SEASONS, STATION, CLIMATE)


def ingest_survey(spark: SparkSession, root: str, raw: DataFrame, *, checksum: str, settings: Settings | None = None) -> DataFrame:
    """The panel of a survey delivery, put over the stored one. A row that breaks a rule of the panel leaves the old one."""
    stored = Stored(spark, root, settings)
    new = panel.assemble_panel(raw, crop_aliases(spark), source_checksum=checksum)
    whole = panel.upsert_panel(stored.read(PANEL), new, verify=False) if stored.has(PANEL) else new
    stored.write(whole, PANEL, [PANEL], rules=production_rules(), counters={
        "year_min": F.min("ano"), "year_max": F.max("ano"), "flagged_rows": F.count_if(F.size("quality_flags") > 0)})
    return stored.manifests(PANEL)


def build_training(spark: SparkSession, root: str, *, start_year: int, end_year: int, settings: Settings | None = None) -> DataFrame:
    """The training frame of the stored panel, climate and locations."""
    stored = Stored(spark, root, settings)
    frame = training.training_frame(
        history_features(stored.read(PANEL)), stored.read(CLIMATE), stored.read(LOCATIONS), start_year=start_year, end_year=end_year)
    stored.write(frame, TRAINING, [PANEL, CLIMATE, LOCATIONS], counters={
        "year_min": F.min("ano"), "year_max": F.max("ano"), "target_sum": F.sum(training.TARGET),
        "with_climate": F.count_if(F.col(training.LAG + "rain_crop_cycle_mm").isNotNull())})
    return stored.manifests(TRAINING)


def table(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    return read_table(spark, root, dataset)
