"""Keyed merges: keep-last upsert, conflict-checked coalescing, whole-row source fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_finite

CLIMATE_KEY = ["codigo_ibge", "season_year"]


def union_widening(*frames: DataFrame) -> DataFrame:
    """Union by name; columns one side lacks become NULL."""
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def keep_last(df: DataFrame, key: list[str], sequence: list[str]) -> DataFrame:
    """Last row per key by load order.

    An aggregate, not a window: copies of a hot key are reduced before the shuffle. The sequence
    should be unique per key; any remaining tie is settled by the row's own values.
    """
    rest = [c for c in df.columns if c not in key and c not in sequence]
    row = F.struct(*[F.col(c) for c in [*sequence, *rest]])
    picked = df.groupBy(*key).agg(F.max(row).alias("_row"))
    return picked.select(*[c if c in key else F.col(f"_row.{c}").alias(c) for c in df.columns])


def upsert(current: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Replace the keys present in ``new`` and append the others."""
    return union_widening(current.join(new.select(*key).distinct(), key, "left_anti"), new)


def insert_only(new: DataFrame, known: DataFrame, key: list[str], content: str) -> DataFrame:
    """Rows of ``new`` whose key is not known yet, one for each key; content never changes under a key.

    One aggregate by key meets both sides: equal rows are one, and a key with two contents, new or known, fails the job.
    Of several new rows the smallest in order of their columns stays.
    """
    rest = [c for c in new.columns if c not in key]
    row = F.struct(*[F.col(c) for c in rest])
    mine = new.select(*key, F.col(content).alias("_content"), row.alias("_row"))
    theirs = known.select(*key, F.col(content).alias("_content"), F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"))
    met = mine.withColumn("_known", F.lit(0)).unionByName(theirs.withColumn("_known", F.lit(1))).groupBy(*key).agg(
        F.min("_content").alias("_a"), F.max("_content").alias("_z"), F.max("_known").alias("_known"), F.min("_row").alias("_row"))
    clash = F.concat(F.lit("immutable content differs under "), F.concat_ws("/", *[F.col(c).cast("string") for c in key]))
    one = F.when(F.col("_a").eqNullSafe(F.col("_z")), F.col("_known") == 0).otherwise(F.raise_error(clash).cast("boolean"))
    return met.where(one).select(*key, "_row.*").select(*new.columns)


def merge_non_null(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per key the only non-null value of each column, with ``conflicts`` naming violations.

    One value means smallest equals largest, so a single mergeable aggregate decides it.
    """
    spread = []
    for c in columns:
        spread += [F.min(c).alias(f"_min_{c}"), F.max(c).alias(c)]
    merged = df.groupBy(*keys).agg(*spread)
    conflict = F.array_compact(
        F.array(*[F.when(F.col(f"_min_{c}") != F.col(c), F.lit(c)) for c in columns])
    )
    return merged.withColumn("conflicts", conflict).drop(*[f"_min_{c}" for c in columns])


def require_no_conflicts(merged: DataFrame, what: str) -> DataFrame:
    """Fail inside the job, without a second pass, when overlapping values differ."""
    text = F.concat(F.lit(f"Conflicting overlapping {what} values: "), F.array_join("conflicts", ","))
    keep = F.when(F.size("conflicts") == 0, F.lit(True)).otherwise(F.raise_error(text).cast("boolean"))
    return merged.where(keep).drop("conflicts")


def adequate_climate(minimum_coverage: float = 0.70) -> Column:
    """Rain, temperature and coverage are real numbers and coverage lies in [minimum, 1]."""
    coverage = F.col("season_coverage")
    return (
        is_finite("rain_crop_cycle_mm")
        & is_finite("mean_temp_c")
        & is_finite(coverage)
        & F.coalesce(coverage.between(minimum_coverage, 1.0), F.lit(False))
    )


def fall_back_whole_rows(primary: DataFrame, secondary: DataFrame, key: list[str], adequate: Column) -> DataFrame:
    """Primary rows, with inadequate ones replaced whole by an adequate secondary row.

    Columns are never mixed and the output has exactly the primary's keys. Both sides meet in one
    aggregate by key, which also counts them: a key that either side has twice fails the job.
    Null keys take no fallback.
    """
    columns = list(primary.columns) + [c for c in secondary.columns if c not in primary.columns]
    types = {**dict(secondary.dtypes), **dict(primary.dtypes)}

    def side(df: DataFrame, name: str) -> DataFrame:
        row = F.struct(
            *[
                (F.col(c) if c in df.columns else F.lit(None)).cast(types[c]).alias(c)
                for c in columns
            ]
        )
        return df.select(*key, F.lit(name).alias("_side"), F.coalesce(adequate, F.lit(False)).alias("_ok"), row.alias("_row"))

    def of(name: str, c: str) -> Column:
        return F.any_value(F.when(F.col("_side") == name, F.col(c)), True)

    both = side(primary, "primary").unionByName(side(secondary, "secondary"))
    met = both.groupBy(*key).agg(
        *[F.count_if(F.col("_side") == name).alias(f"_n_{name}") for name in ("primary", "secondary")],
        of("primary", "_ok").alias("_p_ok"), of("secondary", "_ok").alias("_s_ok"),
        of("primary", "_row").alias("_p"), of("secondary", "_row").alias("_s"),
    )
    fail = lambda name: F.raise_error(
        F.concat(F.lit(f"duplicate {name} keys: "), F.concat_ws(",", *[F.col(c).cast("string") for c in key]))
    ).cast("boolean")
    unique = F.when(F.col("_n_primary") > 1, fail("primary")).when(F.col("_n_secondary") > 1, fail("secondary"))
    keyed = ~F.greatest(*[F.col(c).isNull() for c in key], F.lit(False))
    chosen = F.when(F.col("_p_ok") | ~F.coalesce("_s_ok", F.lit(False)) | ~keyed, F.col("_p")).otherwise(F.col("_s"))
    return met.where(unique.otherwise(F.col("_n_primary") > 0)).select(chosen.alias("_row")).select("_row.*")


def differing_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows present more often on one side than on the other, once for each copy in excess; empty means equal tables.

    Copies of the left count up and those of the right count down in one aggregate over all columns, so each side is read once
    and copies meet before the shuffle.
    """
    columns = left.columns
    both = left.withColumn("_sign", F.lit(1)).unionByName(right.select(*columns).withColumn("_sign", F.lit(-1)))
    sums = both.groupBy(*columns).agg(F.sum("_sign").alias("_sum")).where("_sum <> 0")
    side = F.when(F.col("_sum") > 0, F.lit("left_only")).otherwise(F.lit("right_only"))
    return sums.select(*columns, side.alias("_side"), F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_sum"))).alias("_copy")).drop("_copy")


def budgeted(pending: DataFrame, cached: Column, order: list[Column], budget: int) -> DataFrame:
    """All cached rows plus the first ``budget`` uncached rows in priority order."""
    if budget < 0:
        raise ValueError("budget must not be negative")
    known = F.coalesce(cached, F.lit(False))
    fresh = pending.where(~known).orderBy(*order).limit(budget)
    return pending.where(known).unionByName(fresh)
