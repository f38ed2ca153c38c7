"""Regression metrics, splits, conformal intervals and model choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, is_finite
from ..session import cut_lineage
from .quantiles import conformal, exact_quantiles

TARGET = "produtividade_kg_ha"
SOURCE = "climate_lag1_source"
# Baseline names and the feature each one predicts with, in tie-break order.
BASELINES = {
    "historical_municipal_median": "baseline_municipal_median_5y",
    "moving_average_5y": "yield_mean_5y",
    "regional_median_lag1": "baseline_regional_median_lag1",
}


def with_baselines(df: DataFrame) -> DataFrame:
    return df.withColumns({name: F.col(column) for name, column in BASELINES.items()})


def _measures(y: Column, p: Column, ok: Column, label: str) -> list[Column]:
    error, size = p - y, F.abs(y) + F.abs(p)
    relative = F.when(size > 1e-9, 2 * F.abs(error) / size).otherwise(0.0)
    take = lambda c: F.when(ok, c)
    return [
        F.count_if(ok).alias(f"{label}_n"),
        F.avg(take(F.abs(error))).alias(f"{label}_mae"),
        F.avg(take(error * error)).alias(f"{label}_mse"),
        F.avg(take(relative)).alias(f"{label}_smape"),
        F.var_pop(take(y)).alias(f"{label}_var"),
    ]


def _row(label: str, name: str) -> Column:
    c = lambda m: F.col(f"{label}_{m}")
    r2 = (
        F.when(c("n") == 1, F.lit(float("nan")))
        .when(c("var") > 0, 1 - c("mse") / c("var"))
        .when(c("mse") == 0, F.lit(1.0))
        .when(c("mse") > 0, F.lit(0.0))
    )
    return F.struct(
        F.lit(name).alias("predictor"), c("n").alias("rows"), c("mae").alias("mae"),
        F.sqrt(c("mse")).alias("rmse"), (c("smape") * 100).alias("smape_pct"), r2.alias("r2"),
    )


def regression_metrics(
    df: DataFrame, predictors: dict[str, str], *, target: str = TARGET, keys: list[str] = (),
    common_rows: bool = False,
) -> DataFrame:
    """``keys, predictor, rows, mae, rmse, smape_pct, r2`` over finite pairs.

    All predictors are measured in one aggregate. ``common_rows`` keeps only rows on which the
    target and every predictor are finite, so the predictors are compared on the same rows.
    """
    y = F.col(target)
    shared = is_finite(y)
    for column in predictors.values():
        shared = shared & is_finite(column)
    parts: list[Column] = []
    for i, column in enumerate(predictors.values()):
        ok = shared if common_rows else is_finite(y) & is_finite(column)
        parts += _measures(y, F.col(column), ok, f"m{i}")
    wide = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_rows"), *parts)
    rows = F.array(*[_row(f"m{i}", name) for i, name in enumerate(predictors)])
    return wide.select(*keys, "total_rows", F.inline(rows))


def metrics_by_source(
    df: DataFrame, model: str, *, source: str = SOURCE, target: str = TARGET,
    baselines: dict[str, str] = BASELINES,
) -> DataFrame:
    """Per climate source: model against baselines on common finite rows, best one and verdict.

    A missing or blank source is shown as ``unknown``.
    """
    name = F.trim(F.col(source).cast("string")) if source in df.columns else F.lit(None)
    named = df.withColumn("source", F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown")))
    long = regression_metrics(
        named, {"model": model, **baselines}, target=target, keys=["source"], common_rows=True
    )
    rank = F.lit(len(baselines))
    for i, b in enumerate(baselines):
        rank = F.when(F.col("predictor") == b, F.lit(i)).otherwise(rank)
    is_model = F.col("predictor") == "model"
    has = F.col("rows") > 0
    best = F.min(F.when(~is_model & has, F.struct(F.col("mae"), rank, F.col("predictor").alias("name"))))
    return long.groupBy("source").agg(
        F.max("total_rows").alias("total_rows"),
        F.max("rows").alias("evaluated_rows"),
        (F.max("total_rows") - F.max("rows")).alias("excluded_rows"),
        F.when(F.max("rows") > 0, "evaluated").otherwise("no_common_finite_rows").alias("status"),
        *[F.max(F.when(is_model, F.col(m))).alias(f"model_{m}") for m in ("mae", "rmse", "smape_pct", "r2")],
        best["name"].alias("best_baseline"),
        best["mae"].alias("best_baseline_mae"),
        (F.max(F.when(is_model, F.col("mae"))) < best["mae"]).alias("beats_best_baseline"),
    )


def best_by(df: DataFrame, metric: str, name: str, order: list[str], keys: list[str] = ()) -> DataFrame:
    """Name with the smallest metric per key; ties go to the earlier name in ``order``."""
    rank = F.lit(len(order))
    for i, n in enumerate(order):
        rank = F.when(F.col(name) == n, F.lit(i)).otherwise(rank)
    usable = F.col(metric).isNotNull()
    best = F.min(F.when(usable, F.struct(F.col(metric).alias("m"), rank.alias("r"), F.col(name).alias("n"))))
    return df.groupBy(*keys).agg(best["n"].alias("best"), best["m"].alias("best_value"))


def selection_scores(metrics: DataFrame, candidates: list[str]) -> DataFrame:
    """Candidates scored by their mean MAE ratio to the best baseline of each split.

    ``metrics`` holds ``split, predictor, mae``; splits are ``temporal`` and ``geographic``. A
    candidate passes the promotion gate when it beats the best baseline on both.
    """
    base = best_by(
        metrics.where(~F.col("predictor").isin(*candidates)), "mae", "predictor", list(BASELINES), ["split"]
    ).withColumnsRenamed({"best": "best_baseline", "best_value": "baseline_mae"})
    scored = metrics.where(F.col("predictor").isin(*candidates)).join(F.broadcast(base), "split")
    one = lambda split, c: F.max(F.when(F.col("split") == split, F.col(c)))
    ratio = {s: one(s, "mae") / one(s, "baseline_mae") for s in ("temporal", "geographic")}
    return scored.groupBy("predictor").agg(
        one("temporal", "best_baseline").alias("temporal_best_baseline"),
        one("geographic", "best_baseline").alias("geographic_best_baseline"),
        ratio["temporal"].alias("temporal_mae_ratio"),
        ratio["geographic"].alias("geographic_mae_ratio"),
        ((ratio["temporal"] + ratio["geographic"]) / 2).alias("selection_score"),
        ((ratio["temporal"] < 1) & (ratio["geographic"] < 1)).alias("beats_baseline"),
    )


def hash_share(code: Column | str, seed: int) -> Column:
    """Reproducible share in [0, 1) from the first 8 bytes of SHA-256("seed:code")."""
    code = F.col(code) if isinstance(code, str) else code
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), code.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(
        float(2**64)
    )


def with_splits(df: DataFrame, *, seed: int, fraction: float, test_start_year: int) -> DataFrame:
    """Add ``temporal_test`` and ``geographic_test``; both follow from the row alone."""
    return df.withColumns(
        {
            "temporal_test": F.col("ano") >= test_start_year,
            "geographic_test": hash_share("codigo_ibge", seed) < fraction,
        }
    )


def conformal_radius(
    df: DataFrame, prediction: str, coverage: float, *, target: str = TARGET, keys: list[str] = ()
) -> DataFrame:
    """``keys, radius, calibration_rows``: split-conformal quantile of absolute residuals."""
    residual = F.abs(F.col(target) - F.col(prediction))
    finite = df.withColumn("_r", residual).where(is_finite("_r"))
    return exact_quantiles(
        finite, list(keys), "_r", {"radius": coverage}, position=conformal, count_as="calibration_rows"
    )


def interval(prediction: Column, radius: Column) -> tuple[Column, Column]:
    """(lower, upper) of an interval whose lower end cannot be negative."""
    return clip(prediction - radius, low=0.0), prediction + radius


def evaluate_intervals(
    df: DataFrame, prediction: str, *, calibration_year: int, coverage: float, target: str = TARGET
) -> DataFrame:
    """Calibrate on one year, evaluate on later years: coverage, width and errors of the intervals.

    Both need three columns of the frame; these are kept once, so that the frame behind them runs once. A year without a finite
    residual, or no row to evaluate, fails the job.
    """
    y, p, year = F.col("_y"), F.col("_p"), F.col("_year")
    narrow = cut_lineage(df.select(F.col("ano").alias("_year"), F.col(target).cast("double").alias("_y"), F.col(prediction).cast("double").alias("_p"))
                         .where(year >= calibration_year))
    radius = conformal_radius(narrow.where(year == calibration_year), "_p", coverage, target="_y")
    known = radius.agg(F.max("radius").alias("radius"), F.max("calibration_rows").alias("calibration_rows"))
    later = narrow.where((year > calibration_year) & is_finite("_y") & is_finite("_p"))
    low, high = interval(p, F.col("radius"))
    inside = y.between(low, high)
    judged = later.join(F.broadcast(known)).agg(  # a single row
        F.max("calibration_rows").alias("calibration_rows"), F.count(F.lit(1)).alias("evaluation_rows"),
        F.max("radius").alias("radius"), F.avg(inside.cast("double")).alias("empirical_coverage"),
        F.avg(high - low).alias("mean_interval_width"), F.avg(F.abs(p - y)).alias("point_mae"),
        F.sqrt(F.avg((p - y) * (p - y))).alias("point_rmse"),
    )
    lacking = F.when(F.col("calibration_rows").isNull(), F.lit("no finite residual or no later row")).when(F.col("evaluation_rows") == 0, F.lit("no later row"))
    whole = F.when(lacking.isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("intervals can not be evaluated: "), lacking)).cast("boolean"))
    return judged.where(whole).select(
        F.lit(coverage).alias("nominal_coverage"), F.lit(calibration_year).alias("calibration_year"), *judged.columns)


def performance_confidence(selection_score: float, empirical: float, nominal: float) -> float:
    """Confidence in a promoted model from its improvement and its coverage gap."""
    return max(0.4, min(0.95, 0.65 + (1.0 - selection_score) - abs(empirical - nominal)))
