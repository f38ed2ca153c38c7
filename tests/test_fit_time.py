"""The evaluation's fits run side by side, each once, on a table; medians come from one evaluation of the yields."""

import random
import threading

import pytest
from conftest import rows
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from cropgrid.operators.quantiles import exact_medians
from cropgrid.plans import modelling, training

KIND = ("codigo_ibge string, ano int, produtividade_kg_ha double, rain double, baseline_municipal_median_5y double, "
        "yield_mean_5y double, baseline_regional_median_lag1 double, climate_lag1_source string")


def panel(spark):
    rng = random.Random(7)
    return spark.createDataFrame([
        (f"{code:07d}", year, 1000.0 + 100 * code + rng.random(), float(code), 2000.0, 2500.0, 2200.0, "A") for code in range(40) for year in range(2019, 2025)], KIND)


def test_both_splits_are_fitted_at_once_and_once(spark):
    met, built = threading.Barrier(2, timeout=60), []

    def build(seed):
        built.append(seed)
        met.wait()  # both splits' fits have begun
        return LinearRegression(featuresCol="_x", labelCol=training.TARGET, predictionCol="prediction", solver="normal", regParam=0.0)

    out = modelling.evaluate_candidates(panel(spark), candidates={"line": build}, features=["rain"])
    assert len(built) == 2 and out.selected == "line" and out.promoted
    assert out.intervals["calibration_rows"] == 40 and out.intervals["radius"] < 1.0


def test_fit_reads_few_rows_in_one_task(spark):
    class Seen:
        def fit(self, df):
            return df.rdd.getNumPartitions()

    known = modelling.Imputation({"rain": 0.0})
    assert modelling.fit_model("m", lambda _: Seen(), panel(spark).repartition(6), 1, imputation=known, rows=240).regressor == 1
    assert modelling.fit_model("m", lambda _: Seen(), panel(spark).repartition(6), 1, imputation=known, rows=3 * modelling.FIT_ROWS).regressor == 3


@pytest.mark.parametrize("split", ["temporal", "geographic"])
def test_an_empty_split_is_named(spark, split):
    df = panel(spark).where("ano < 2023" if split == "temporal" else "codigo_ibge is null")
    df = df if split == "temporal" else panel(spark).withColumn("codigo_ibge", F.lit("0000001"))
    with pytest.raises(ValueError, match=f"the {split} split is empty"):
        modelling.evaluate_candidates(df, candidates={}, features=["rain"])


def test_regional_medians_of_yields_that_differ_in_the_last_digit(spark):
    """A sum of doubles that is made again may differ; its median must not go missing."""
    again = F.udf(lambda v: v * (1 + random.SystemRandom().random() * 1e-12), "double").asNondeterministic()
    df = spark.createDataFrame([(f"{i % 9}", 2000 + i % 7, 1000.0 + i) for i in range(630)], "uf string, ano int, produtividade_kg_ha double")
    found = rows(training.regional_medians(df.withColumn(training.TARGET, again(training.TARGET)), positive_only=False))
    assert len(found) == 63 and all(abs(r["baseline_regional_median_lag1"] - 1315) < 70 for r in found)


def test_medians_of_columns_without_keys(spark):
    """Few keys: no value is moved, and null, NaN-free, repeated and single values count as before."""
    df = spark.createDataFrame([(1.0, None, 5.0), (1.0, None, -2.0), (3.0, None, None), (4.0, None, 0.0)], "a double, b double, c double")
    wide = exact_medians(df, [], ["a", "b", "c"])
    assert {r["name"]: r["median"] for r in rows(wide)} == {"a": 2.0, "c": 0.0}
    assert "SortMergeJoin" not in wide._jdf.queryExecution().executedPlan().toString()
