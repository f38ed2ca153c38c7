"""Versioned configuration as small tables, and crop label resolution against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import COMPONENTS, CROPS, RANKING_PROFILES, checked_profiles
from ..functions.text import normalise_label, normalise_text

CROP_SCHEMA = (
    "crop_id int, canonical_name string, nome_ptbr string, categoria string, "
    "temporaria_permanente string, cycle_days_min int, cycle_days_max int, active boolean, "
    "implementation_status string, aliases map<string,array<string>>"
)


def crop_dimension(spark: SparkSession, crops: list[dict] = CROPS) -> DataFrame:
    for field in ("crop_id", "canonical_name"):
        values = [c[field] for c in crops]
        if len(set(values)) != len(values):
            raise ValueError(f"duplicate {field} in the crop taxonomy")
    names = [f.split()[0] for f in CROP_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(c[n] for n in names) for c in crops], CROP_SCHEMA)


def listed_crops(crops: DataFrame, *, include_planned: bool = False) -> DataFrame:
    return crops.where(F.col("active") | F.lit(include_planned))


def crop_aliases(spark: SparkSession, crops: list[dict] = CROPS) -> DataFrame:
    """``alias_source, alias_key, cultura``; source NULL holds the global index.

    A key that would stand for two crops is rejected.
    """
    index: dict[tuple[str | None, str], str] = {}

    def register(source: str | None, label: str, name: str) -> None:
        key = (source, normalise_label(label))
        if index.setdefault(key, name) != name:
            raise ValueError(f"crop alias {key} stands for {index[key]} and {name}")

    for crop in crops:
        name = crop["canonical_name"]
        register(None, name, name)
        for source, labels in crop["aliases"].items():
            for label in labels:
                register(source.casefold(), label, name)
                register(None, label, name)
    rows = [(s, k, n) for (s, k), n in index.items()]
    return spark.createDataFrame(rows, "alias_source string, alias_key string, cultura string")


def resolve_crops(df: DataFrame, aliases: DataFrame, *, label: str, source: str | None) -> DataFrame:
    """Add ``cultura``: the source's own alias first, then the global one; NULL if unknown.

    The alias table comes from the configuration, so its size is fixed and it is broadcast.
    """
    own = aliases.where(F.col("alias_source") == F.lit(source)).select(
        F.col("alias_key").alias("_key"), F.col("cultura").alias("_own")
    )
    shared = aliases.where("alias_source is null").select(
        F.col("alias_key").alias("_key"), F.col("cultura").alias("_shared")
    )
    keyed = df.withColumn("_key", normalise_text(label))
    joined = keyed.join(F.broadcast(own), "_key", "left").join(F.broadcast(shared), "_key", "left")
    return joined.withColumn("cultura", F.coalesce("_own", "_shared")).drop("_key", "_own", "_shared")


def profile_rows(profiles: dict[str, dict[str, float]] = RANKING_PROFILES) -> Column:
    """Array of ``struct(profile, w_return, ...)`` to explode onto every row."""
    rows = [
        F.struct(
            F.lit(name).alias("profile"), *[F.lit(float(w[c])).alias(f"w_{c}") for c in COMPONENTS]
        )
        for name, w in checked_profiles(profiles).items()
    ]
    return F.array(*rows)
