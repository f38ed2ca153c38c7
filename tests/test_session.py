"""Running from another directory, and the shared folder."""

import os
import subprocess
import sys

import pytest
from cropgrid import session
from cropgrid.operators import neighbours

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from cropgrid.session import local_session, ship_package
spark = local_session(2, "elsewhere")
ship_package(spark)
def size(batches):
    from cropgrid.functions import draws
    for batch in batches:
        yield batch
print("rows", spark.range(7).mapInArrow(size, "id long").count())
"""


def test_package_reaches_workers_started_elsewhere(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "rows 7" in done.stdout, done.stderr[-2000:]


def test_kept_table(spark):
    kept = session.kept_table(spark.range(5), "five")
    assert kept.count() == 5 and session.shared_folder(spark) in kept.inputFiles()[0]


@pytest.mark.parametrize("value, line", [(-900.0, 0.0), (730.0, 10.0), (4.9, 0.0), (5.0, 10.0), (1e6, 10.0)])
def test_axis_has_no_bounds(spark, value, line):
    axis = spark.createDataFrame([(0.0,), (10.0,)], "a double")
    points = spark.createDataFrame([(value,)], "v double")
    assert neighbours.nearest_on_axis(points, "v", axis, "a").collect() == [(value, line)]


def test_grid_closes_at_the_seam(spark):
    from cropgrid.plans import reanalysis
    grid = spark.createDataFrame([(0.0, float(i)) for i in range(360)], "grid_lat double, grid_lon double")
    place = {"codigo_ibge": "1", "municipio": "m", "uf": "u", "latitude_centroid": 0.0, "longitude_centroid": -0.02}
    row = reanalysis.map_to_grid(spark.createDataFrame([tuple(place.get(c) for c in reanalysis.LOCATION)], ", ".join(
        f"{c} {'double' if 'centroid' in c else 'string'}" for c in reanalysis.LOCATION)), grid).first()
    assert row.grid_lon == 0 and row.distance_to_grid_km < 3
