import numpy as np
import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from cropgrid.functions.geo import centroid, haversine_km
from cropgrid.operators import merge, metrics, neighbours, quantiles
from cropgrid.operators.quantiles import conformal, exact_medians, exact_quantiles


def _km(a, b):
    la, lo, lb, lp = map(np.radians, (a[:, 0][:, None], a[:, 1][:, None], b[:, 0][None], b[:, 1][None]))
    h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin((lp - lo) / 2) ** 2
    return 6371.0088 * 2 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))


def _cloud(kind, n, rng):
    if kind == "uniform":
        return np.column_stack([rng.uniform(-89, 89, n), rng.uniform(-180, 180, n)])
    if kind == "poles":
        return np.column_stack([rng.choice([-1, 1], n) * (90 - rng.uniform(0, 3, n) ** 2), rng.uniform(-180, 180, n)])
    if kind == "dense":  # a third of all points in one place, far from the rest
        k = n // 3
        near = np.column_stack([rng.normal(10, 1e-3, k), rng.normal(20, 1e-3, k)])
        return np.vstack([near, np.column_stack([rng.uniform(-60, 60, n - k), rng.uniform(-180, 180, n - k)])])
    return np.column_stack([rng.uniform(-80, 80, n), rng.choice([-179.99, 179.99, 179.5], n) + rng.uniform(-1e-3, 1e-3, n)])


@pytest.mark.parametrize("kind", ["uniform", "dense", "date_line", "poles"])
@pytest.mark.parametrize("farthest", [False, True])
def test_neighbours_equal_brute_force(spark, kind, farthest):
    rng = np.random.default_rng(7)
    points, targets = np.vstack([_cloud("uniform", 120, rng), _cloud(kind, 60, rng)]), np.round(_cloud(kind, 400, rng), 9)
    points = np.vstack([points, [[90.0, 0.0], [-90.0, 10.0], [0.0, 180.0], [0.0, -180.0], [89.9, 179.9]]])
    p = spark.createDataFrame([(0, float(a), float(b)) for a, b in points], "g int, lat double, lon double")
    t = spark.createDataFrame([(0, i, float(a), float(b)) for i, (a, b) in enumerate(targets)], "g int, k int, tlat double, tlon double")
    got = rows(neighbours.extreme_neighbours(
        p, t, by=["g"], point_coordinates=("lat", "lon"), target_coordinates=("tlat", "tlon"), target_key="k", farthest=farthest))
    table = _km(points, targets)
    want = table.max(axis=1) if farthest else table.min(axis=1)
    found = {(r["lat"], r["lon"]): r["distance_km"] for r in got}
    assert len(found) == len(points)
    np.testing.assert_allclose([found[float(a), float(b)] for a, b in points], want, rtol=1e-9, atol=1e-6)


def test_neighbours_groups_ties_and_copies(spark):
    p = spark.createDataFrame([(0.0, 0.0)] * 3, "lat double, lon double")
    t = spark.createDataFrame([(1, "b", 0.0, 1.0), (1, "a", 0.0, 1.0), (1, "c", 0.0, -1.0), (2, "z", 5.0, 5.0)], "g int, k string, a double, o double")
    got = rows(neighbours.extreme_neighbours(
        p, t, by=["g"], every_group=True, point_coordinates=("lat", "lon"), target_coordinates=("a", "o"), target_key="k"))
    assert sorted((r["g"], r["k"]) for r in got) == [(1, "a"), (2, "z")]


def test_neighbours_run_no_job_before_the_action(spark):
    tracker, group = spark.sparkContext.statusTracker(), "neighbours-build"
    spark.sparkContext.setJobGroup(group, group)
    try:
        p = spark.range(50).selectExpr("cast(id as double) as a", "cast(id * 3 as double) as b")
        found = neighbours.extreme_neighbours(
            p, p.selectExpr("1 as g", "a as c", "b as d", "a as k"), by=["g"], every_group=True,
            point_coordinates=("a", "b"), target_coordinates=("c", "d"), target_key="k")
        assert not tracker.getJobIdsForGroup(group)
        assert found.where("distance_km = 0 and k = a").count() == 50
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_axis_ties_go_up(spark):
    p = spark.createDataFrame([(0.5,), (0.49,), (-9.0,), (9.0,)], "v double")
    axis = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (1.0,)], "a double")
    got = {r["v"]: r["a"] for r in rows(neighbours.nearest_on_axis(p, "v", axis, "a"))}
    assert got == {0.5: 1.0, 0.49: 0.0, -9.0: 0.0, 9.0: 2.0}


@pytest.mark.parametrize("ranges", [(256, 1 << 16), (1, 3)])
def test_quantiles_equal_numpy(spark, monkeypatch, ranges):
    """Whatever the number of ranges; small ones open every range that a rank falls into."""
    monkeypatch.setattr(quantiles, "STEEP_RANGES", ranges[0])
    monkeypatch.setattr(quantiles, "EVEN_RANGES", ranges[1])
    rng = np.random.default_rng(3)
    data = {
        "a": rng.normal(0, 1, 3000), "b": np.repeat(5.0, 400), "c": np.array([1.0, 2.0]), "d": rng.choice([1.0, 2.0, 3.0], 900),
        "outliers": np.r_[rng.uniform(1, 2, 700), 1e300, -1e300, 1e18, 5e-324], "steep": 2.0 ** np.arange(-500, 500), "one": np.array([7.5]),
        "skewed": np.r_[np.zeros(2000), rng.lognormal(0, 4, 999)], "close": np.nextafter(1.0, 2.0) ** np.arange(50), None: np.array([3.0, 4.0, 8.0]),
    }
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs] + [("a", None), ("e", None)], "k string, v double").repartition(6)
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p51": 0.5005, "p99": 0.99, "p100": 1.0}
    got = {r["k"]: r for r in rows(exact_quantiles(df, ["k"], "v", probs, count_as="n"))}
    assert set(got) == set(data)
    for k, vs in data.items():
        assert got[k]["n"] == len(vs)
        np.testing.assert_allclose([got[k][n] for n in probs], np.quantile(vs, list(probs.values())), rtol=1e-12)
    whole = one(exact_quantiles(df, [], "v", {"m": 0.5}))
    assert whole["m"] == pytest.approx(np.median(np.concatenate(list(data.values()))))
    assert rows(exact_quantiles(df.limit(0), ["k"], "v", probs)) == [] == rows(exact_quantiles(df.limit(0), [], "v", probs))


def test_quantiles_of_a_large_group_open_few_values(spark, monkeypatch):
    """Each round opens a small part of what the one before did, though one group has nearly all rows."""
    values = np.arange(400_000.0)
    df = spark.range(len(values)).select(F.when(F.col("id") % 50 == 0, F.lit("small")).otherwise("hot").alias("k"), (F.col("id") * 1.0).alias("v"))
    most, again = [], quantiles._again

    def watched(data, facts, by, ranks, range_of):
        inside = data.join(facts, by).where("_v between _lo0 and _hi0")
        most.append(inside.groupBy(*by).count().agg(F.max("count")).first()[0])
        return again(data, facts, by, ranks, range_of)

    monkeypatch.setattr(quantiles, "_again", watched)
    got = {r["k"]: r for r in rows(exact_quantiles(df, ["k"], "v", {"p50": 0.5, "p999": 0.999}))}
    for k, vs in (("small", values[::50]), ("hot", np.delete(values, np.arange(0, len(values), 50)))):
        np.testing.assert_allclose([got[k]["p50"], got[k]["p999"]], np.quantile(vs, [0.5, 0.999]), rtol=1e-12)
    assert most[0] <= len(values) / 100 and most[1] <= 4


@pytest.mark.parametrize("n", [1, 4, 9, 10, 57, 500])
def test_conformal_position_equals_numpy_higher(spark, n):
    values = np.random.default_rng(n).uniform(0, 9, n)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = one(exact_quantiles(df, [], "v", {"r": 0.8}, position=conformal))["r"]
    level = min(1.0, np.ceil((n + 1) * 0.8) / n)
    assert got == np.quantile(values, level, method="higher")


def test_medians_long(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, 7.0)], "k string, x double, y double")
    assert {(r["name"], r["median"]) for r in rows(exact_medians(df, ["k"], ["x", "y"]))} == {("x", 2.0), ("y", 7.0)}


def test_centroids(spark):
    square = '{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,2],[0,0]]]}'
    hole = '{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4],[0,0]],[[0,0],[2,0],[2,2],[0,2],[0,0]]]}'
    multi = '{"type":"MultiPolygon","coordinates":[[[[0,0],[0,2],[2,2],[2,0],[0,0]]],[[[10,0],[12,0],[12,2],[10,2],[10,0]]]]}'
    line = '{"type":"Polygon","coordinates":[[[0,0],[4,0],[0,0]]]}'
    empty = '{"type":"Polygon","coordinates":[]}'
    df = spark.createDataFrame([(g,) for g in (square, hole, multi, line, empty)], "g string")
    got = [r["c"] and (r["c"]["longitude"], r["c"]["latitude"]) for r in rows(df.select(centroid("g").alias("c")))]
    assert got[0] == pytest.approx((1, 1)) and got[1] == pytest.approx((28 / 12, 28 / 12))
    assert got[2] == pytest.approx((6, 1)) and got[3] == pytest.approx((2, 0)) and got[4] is None


def test_haversine(spark):
    quarter = one(spark.range(1).select(haversine_km(F.lit(0.0), F.lit(0.0), F.lit(90.0), F.lit(0.0)).alias("d")))["d"]
    assert quarter == pytest.approx(6371.0088 * np.pi / 2)


def test_keep_last_and_upsert(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "new"), ("b", 1, "x")], "k string, seq int, v string")
    assert sorted((r["k"], r["v"]) for r in rows(merge.keep_last(df, ["k"], ["seq"]))) == [("a", "new"), ("b", "x")]
    new = spark.createDataFrame([("a", 9, "z", 1)], "k string, seq int, v string, extra int")
    assert sorted((r["k"], r["v"], r["extra"]) for r in rows(merge.upsert(df, new, ["k"]))) == [("a", "z", 1), ("b", "x", None)]


def test_conflicts_fail(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 1.0, "s"), ("b", 1.0, "t")], "k string, x double, y string")
    merged = merge.merge_non_null(df, ["k"], ["x", "y"])
    assert sorted((r["k"], r["x"], r["y"]) for r in rows(merge.require_no_conflicts(merged, "daily"))) == [("a", 1.0, "s"), ("b", 1.0, "t")]
    bad = merge.merge_non_null(df.union(spark.createDataFrame([("a", 2.0, None)], df.schema)), ["k"], ["x", "y"])
    with pytest.raises(Exception, match="Conflicting"):
        merge.require_no_conflicts(bad, "daily").collect()


def test_budget(spark):
    df = spark.createDataFrame([(i, i % 3 == 0) for i in range(10)], "k int, cached boolean")
    take = lambda n: sorted(r["k"] for r in rows(merge.budgeted(df, F.col("cached"), [F.desc("k")], n)))
    assert take(0) == [0, 3, 6, 9] and take(2) == [0, 3, 6, 7, 8, 9]


def test_metrics(spark):
    pairs = [(40.0, 52.0), (90.0, 81.0), (161.0, 151.0), (None, 7.0), (3.0, float("inf"))]
    df = spark.createDataFrame(pairs, "produtividade_kg_ha double, p double")
    row = one(metrics.regression_metrics(df, {"m": "p"}))
    # errors 12, 9, 10; the observed mean is 97, their squared deviations 3249 + 49 + 4096
    assert row["rows"] == 3 and row["mae"] == pytest.approx(31 / 3) and row["rmse"] == pytest.approx((325 / 3) ** 0.5)
    assert row["r2"] == pytest.approx(1 - 325 / 7394)
    single = one(metrics.regression_metrics(df.limit(1), {"m": "p"}))
    assert np.isnan(single["r2"])


def test_metrics_by_source(spark):
    cols = "produtividade_kg_ha double, model double, baseline_municipal_median_5y double, yield_mean_5y double, baseline_regional_median_lag1 double, climate_lag1_source string"
    df = spark.createDataFrame([
        (100.0, 101.0, 110.0, 105.0, 120.0, "A"), (100.0, None, 100.0, 100.0, 100.0, "A"), (50.0, 90.0, 51.0, 51.0, 60.0, " "),
        (1.0, None, 1.0, 1.0, 1.0, "B")], cols)
    got = {r["source"]: r for r in rows(metrics.metrics_by_source(df, "model"))}
    assert got["A"]["total_rows"] == 2 and got["A"]["evaluated_rows"] == 1 and got["A"]["best_baseline"] == "moving_average_5y"
    assert got["A"]["beats_best_baseline"] is True and got["unknown"]["beats_best_baseline"] is False
    assert got["unknown"]["best_baseline"] == "historical_municipal_median"  # tie goes to the earlier name
    assert got["B"]["status"] == "no_common_finite_rows" and got["B"]["model_mae"] is None


def test_hash_share_is_the_digest(spark):
    import hashlib

    codes = ["5107925", "1200001"]
    got = rows(spark.createDataFrame([(c,) for c in codes], "c string").select(metrics.hash_share("c", 20260820).alias("s")))
    want = [int.from_bytes(hashlib.sha256(f"20260820:{c}".encode()).digest()[:8], "big") / 2**64 for c in codes]
    assert [r["s"] for r in got] == want


def test_intervals(spark):
    data = [(2020, 100.0 + i, 100.0) for i in range(10)] + [(2021, 103.0, 100.0), (2021, 5000.0, 2.0)]
    df = spark.createDataFrame(data, "ano int, produtividade_kg_ha double, p double")
    row = one(metrics.evaluate_intervals(df, "p", calibration_year=2020, coverage=0.8))
    assert row["radius"] == 9.0 and row["calibration_rows"] == 10 and row["empirical_coverage"] == 0.5
    assert row["mean_interval_width"] == pytest.approx((18 + 11) / 2)
