"""Yield models on Spark ML: imputation, candidates, selection gate, intervals, predictions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields, replace
from functools import reduce
from math import ceil

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.errors import AnalysisException
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ModelSettings
from ..functions.columns import clip, finite_or_null
from ..operators.metrics import (
    BASELINES, SOURCE, TARGET, conformal_radius, evaluate_intervals, interval, metrics_by_source,
    performance_confidence, regression_metrics, selection_scores, with_splits,
)
from ..operators.quality import many_to_one
from ..operators.quantiles import exact_medians
from ..session import at_once, kept_table
from .training import LAG, MODEL_FEATURES

# Fixed value: alert when a prediction rests on a climate source absent from training.
UNSEEN_SOURCE = "CLIMATE_SOURCE_NOT_IN_MODEL_TRAINING"
INTERVAL_METHOD = "split_conformal_absolute_residual"
WITHOUT_CLIMATE = "IBGE/PAM history; unavailable climate features imputed"
#: Rows that a fit's task reads at least: boosting runs hundreds of jobs one after another, whose time is that of their tasks' start.
FIT_ROWS = 1 << 17

Candidates = dict[str, Callable[[int], Estimator]]


def default_candidates(iterations: int = 60, trees: int = 80) -> Candidates:
    """Spark ML regressors standing in for single-machine boosters."""
    return {
        "gradient_boosted_trees": lambda seed: GBTRegressor(
            featuresCol="_x", labelCol=TARGET, predictionCol="prediction", maxIter=iterations,
            stepSize=0.08, maxDepth=5, subsamplingRate=0.9, seed=seed,
        ),
        "random_forest": lambda seed: RandomForestRegressor(
            featuresCol="_x", labelCol=TARGET, predictionCol="prediction", numTrees=trees,
            maxDepth=8, seed=seed,
        ),
        "ridge_regression": lambda seed: LinearRegression(
            featuresCol="_x", labelCol=TARGET, predictionCol="prediction", regParam=1.0,
            elasticNetParam=0.0, maxIter=100,
        ),
    }


@dataclass(frozen=True)
class Imputation:
    """Training medians; a feature without any value is kept as constant zero."""

    medians: dict[str, float]

    @staticmethod
    def fit(train: DataFrame, features: list[str] = MODEL_FEATURES) -> Imputation:
        finite = train.select(*[finite_or_null(F.col(f).cast("double")).alias(f) for f in features])
        rows = exact_medians(finite, [], features).collect()  # one row per feature
        known = {r["name"]: r["median"] for r in rows}
        return Imputation({f: known.get(f, 0.0) for f in features})

    def apply(self, df: DataFrame) -> DataFrame:
        filled = df.withColumns(
            {
                f"_f_{f}": F.coalesce(finite_or_null(F.col(f).cast("double")), F.lit(m))
                for f, m in self.medians.items()
            }
        )
        names = [f"_f_{f}" for f in self.medians]
        return VectorAssembler(inputCols=names, outputCol="_x").transform(filled).drop(*names)


@dataclass(frozen=True)
class YieldModel:
    """A fitted regressor with its imputation."""

    name: str
    imputation: Imputation
    regressor: Model

    def predict(self, df: DataFrame, column: str = "prediction") -> DataFrame:
        out = self.regressor.transform(self.imputation.apply(df)).drop("_x")
        return out.withColumnRenamed("prediction", column)


def fit_model(
    name: str, build: Callable[[int], Estimator], train: DataFrame, seed: int, *,
    imputation: Imputation | None = None, rows: int | None = None,
) -> YieldModel:
    """``rows``, where it is known, is the number of training rows, which then are read by no more tasks than they need."""
    known = imputation or Imputation.fit(train)
    ready = known.apply(train)
    return YieldModel(name, known, build(seed).fit(ready if rows is None else ready.coalesce(max(1, ceil(rows / FIT_ROWS)))))


@dataclass(frozen=True)
class Evaluation:
    """Metrics of baselines and candidates, the choice, and its interval quality."""

    metrics: DataFrame
    by_source: DataFrame
    scores: DataFrame
    selected: str
    promoted: bool
    selection_score: float
    intervals: dict = field(default_factory=dict)

    @property
    def confidence(self) -> float:
        return performance_confidence(
            self.selection_score, self.intervals["empirical_coverage"], self.intervals["nominal_coverage"]
        )


def evaluate_candidates(
    frame: DataFrame, settings: ModelSettings | None = None, candidates: Candidates | None = None,
    features: list[str] = MODEL_FEATURES,
) -> Evaluation:
    """Fit every candidate on both splits, compare with the baselines and pick one.

    The frame is kept as a table first: every task of a fit would carry the whole plan behind it. The fits of both splits run at the
    same time. The intervals are those of the choice as fitted on the temporal split, whose training rows are the years before the
    calibration year.
    """
    cfg, makers = settings or ModelSettings(), candidates or default_candidates()
    used = {"ano", TARGET, SOURCE, *features, *BASELINES.values(), "temporal_test", "geographic_test"}
    split = with_splits(
        frame, seed=cfg.random_seed, fraction=cfg.geographic_holdout_fraction,
        test_start_year=cfg.temporal_test_start_year,
    )
    marked = kept_table(split.select(*[c for c in split.columns if c in used]), "marked")
    flags = {split: F.col(f"{split}_test") for split in ("temporal", "geographic")}
    train, test = {s: marked.where(~f) for s, f in flags.items()}, {s: marked.where(f) for s, f in flags.items()}
    known = marked.agg(*[F.count_if(c).alias(f"{s}_{side}") for s, f in flags.items() for side, c in (("train", ~f), ("test", f))]).first()
    for split in flags:
        if not known[f"{split}_train"] or not known[f"{split}_test"]:
            raise ValueError(f"the {split} split is empty")
    # One imputation for the candidates of a split.
    medians = dict(zip(flags, at_once(frame.sparkSession, [lambda s=s: Imputation.fit(train[s], features) for s in flags]), strict=True))
    pairs = [(name, split) for name in makers for split in flags]
    fits = dict(zip(pairs, at_once(frame.sparkSession, [
        lambda n=name, s=split: fit_model(n, makers[n], train[s], cfg.random_seed, imputation=medians[s], rows=known[f"{s}_train"])
        for name, split in pairs]), strict=True))
    measured, sources = [], []
    for split in flags:
        scored = test[split]
        for name in makers:
            scored = fits[name, split].predict(scored, name)
        columns = {**{n: n for n in makers}, **BASELINES}
        measured.append(regression_metrics(scored, columns).withColumn("split", F.lit(split)))
        for name in makers:
            sources.append(
                metrics_by_source(scored, name).withColumns({"split": F.lit(split), "model": F.lit(name)})
            )
    # At most a dozen rows; held so that choosing does not predict again.
    metrics = reduce(DataFrame.unionByName, measured).persist()
    scores = selection_scores(metrics.select("split", "predictor", "mae"), list(makers)).persist()
    rank = {n: i for i, n in enumerate(makers)}
    best = min(scores.collect(), key=lambda r: (r["selection_score"], rank[r["predictor"]]))
    year = cfg.temporal_test_start_year
    model = fits[best["predictor"], "temporal"]
    intervals = evaluate_intervals(
        model.predict(marked.where(F.col("ano") >= year)), "prediction", calibration_year=year,
        coverage=cfg.prediction_interval_coverage,
    ).first()
    return Evaluation(
        metrics, reduce(DataFrame.unionByName, sources), scores, best["predictor"],
        bool(best["beats_baseline"]), float(best["selection_score"]), intervals.asDict(),
    )


@dataclass(frozen=True)
class ProductionModel:
    """Model fitted on all but the last year, whose residuals set the interval radius."""

    model: YieldModel
    version: str
    radius: float
    calibration_rows: int
    confidence: float
    climate_sources: tuple[str, ...]
    coverage: float = 0.0
    calibration_year: int = 0
    training_rows: int = 0
    empirical_coverage: float | None = None
    selection_score: float | None = None
    dataset_version: str | None = None


def fit_production_model(
    frame: DataFrame, evaluation: Evaluation, *, version: str, settings: ModelSettings | None = None,
    candidates: Candidates | None = None, features: list[str] = MODEL_FEATURES, dataset_version: str | None = None,
) -> ProductionModel | None:
    """The selected candidate fitted for production, or None if it failed the promotion gate."""
    if not evaluation.promoted:
        return None
    cfg, makers = settings or ModelSettings(), candidates or default_candidates()
    latest, rows = frame.agg(F.max("ano"), F.count(F.lit(1))).first()
    if latest is None:
        raise ValueError("there is no training year")
    train = frame.where(F.col("ano") < latest)
    model = fit_model(
        evaluation.selected, makers[evaluation.selected], train, cfg.random_seed, imputation=Imputation.fit(train, features)
    )
    held = model.predict(frame.where(F.col("ano") == latest))
    calibrated = conformal_radius(held, "prediction", cfg.prediction_interval_coverage).first()
    used = frame.where(F.col(LAG + "rain_crop_cycle_mm").isNotNull()).select(LAG + "source").distinct()
    sources = tuple(sorted(r[0] for r in used.collect() if r[0] is not None))
    return ProductionModel(
        model, version, calibrated["radius"], calibrated["calibration_rows"], evaluation.confidence, sources,
        coverage=cfg.prediction_interval_coverage, calibration_year=latest, training_rows=rows - calibrated["calibration_rows"],
        empirical_coverage=evaluation.intervals.get("empirical_coverage"), selection_score=evaluation.selection_score,
        dataset_version=dataset_version,
    )


POINTER_SCHEMA = (
    "model string, model_version string, path string, promoted boolean, medians map<string,double>, radius double, "
    "calibration_rows long, confidence double, climate_sources array<string>, coverage double, calibration_year int, "
    "training_rows long, empirical_coverage double, selection_score double, dataset_version string"
)
POINTERS = "_models"


def promote_model(spark: SparkSession, root: str, production: ProductionModel) -> str:
    """Write the fitted regressor and point to it; returns its path.

    The regressor is written by Spark ML, spread like any table; the pointer row, which also tells all that a prediction
    needs besides, is added last, so a failed write promotes nothing. A version is written once.
    """
    path = f"{root}/{production.version}"
    production.model.regressor.write().save(path)
    told = {**asdict(replace(production, model=None)), "model": production.model.name, "model_version": production.version,
            "path": path, "promoted": True, "medians": production.model.imputation.medians, "climate_sources": list(production.climate_sources)}
    row = tuple(told[c.split()[0]] for c in POINTER_SCHEMA.split(", "))
    pointer = spark.createDataFrame([row], POINTER_SCHEMA).withColumn("promoted_at", F.current_timestamp())
    pointer.coalesce(1).write.mode("append").parquet(f"{root}/{POINTERS}")
    return path


def promoted_model(spark: SparkSession, root: str) -> ProductionModel | None:
    """The model promoted last, or None where none was. A pointer to a regressor that is gone is an error."""
    try:
        pointers = spark.read.schema(f"{POINTER_SCHEMA}, promoted_at timestamp").parquet(f"{root}/{POINTERS}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    row = pointers.where("promoted").orderBy(F.desc("promoted_at")).first()
    if row is None:
        return None
    regressor = DefaultParamsReader.loadParamsInstance(row["path"], spark)
    names = {f.name for f in fields(ProductionModel)} - {"model", "version", "climate_sources"}
    return ProductionModel(
        YieldModel(row["model"], Imputation(dict(row["medians"])), regressor), row["model_version"],
        climate_sources=tuple(row["climate_sources"]), **{c: row[c] for c in names})


def promoted_predictions(inference: DataFrame, production: ProductionModel, panel: DataFrame | None = None, *, crop: str = "soja") -> DataFrame:
    """Batch predictions of a promoted model with what describes them: model, interval, sample and the features' periods.

    The sample size of a municipality is the number of its known harvests in ``panel``.
    """
    predicted = predicted_yields(
        inference, production.model, radius=production.radius, version=production.version,
        confidence=production.confidence, climate_sources=production.climate_sources)
    climate = inference.select(
        "codigo_ibge", F.col(LAG + "rain_crop_cycle_mm").isNotNull().alias("climate_available"),
        *[F.col(LAG + c).alias(f"climate_{c}") for c in ("source", "data_nature", "method", "quality_flag")])
    described = many_to_one(predicted, climate, ["codigo_ibge"], "left", "inference rows")
    if panel is not None:
        known = panel.where((F.col("cultura") == crop) & F.col(TARGET).isNotNull()).groupBy("codigo_ibge").agg(F.count(F.lit(1)).alias("sample_size"))
        described = described.join(known, "codigo_ibge", "left")
    source = F.concat(F.lit("IBGE/PAM history and lagged "), "climate_source", F.lit(" climate features"))
    return described.withColumns({
        "model": F.lit(production.model.name), "dataset_version": F.lit(production.dataset_version).cast("string"),
        "interval_method": F.lit(INTERVAL_METHOD), "interval_nominal_coverage": F.lit(production.coverage),
        "interval_radius_kg_ha": F.lit(float(production.radius)),
        "interval_empirical_coverage": F.lit(production.empirical_coverage).cast("double"),
        "history_through_year": F.col("yield_target_year") - 1,
        "yield_source": F.when(F.col("climate_available"), source).otherwise(WITHOUT_CLIMATE),
    })


def predicted_yields(
    inference: DataFrame, model: YieldModel | None, *, radius: float, version: str, confidence: float,
    climate_sources: tuple[str, ...] = (), prediction: str | None = None,
) -> DataFrame:
    """Batch predictions with intervals, in the shape the decision layer reads.

    ``prediction`` names a column to use as point prediction instead of running ``model``.
    """
    scored = inference if model is None else model.predict(inference, "_p")
    point = clip(F.col(prediction or "_p"), low=0.0)
    low, high = interval(point, F.lit(float(radius)))
    source = F.col(LAG + "source")
    climate = F.col(LAG + "rain_crop_cycle_mm").isNotNull()
    unseen = climate & source.contains("ERA5") & ~source.isin(*climate_sources, "")
    return scored.where(point.isNotNull()).select(
        "codigo_ibge", low.alias("yield_p10"), point.alias("yield_p50"), high.alias("yield_p90"),
        F.lit("predicted").alias("yield_type"), F.col("ano").alias("yield_target_year"),
        F.col("ano").cast("string").alias("yield_reference_period"),
        F.lit(version).alias("model_version"), F.lit(float(confidence)).alias("performance_confidence"),
        (F.col("ano") - 1).alias("climate_season"),
        F.when(F.coalesce(unseen, F.lit(False)), F.array(F.lit(UNSEEN_SOURCE))).otherwise(
            F.array().cast("array<string>")
        ).alias("yield_alerts"),
    )
