"""Places in groups against a plain sort."""

import random

from cropgrid.operators.ranking import ranked


def test_places(spark):
    r = random.Random(2)
    rows = [(r.choice(["hot"] * 6 + ["a", None, "b"]), r.choice([None, *range(40)]), i) for i in range(3000)]
    found = ranked(spark.createDataFrame(rows, "g string, k int, i long").repartition(7), ["g"], ["k", "i"]).collect()
    expected = {}
    for g, k, i in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2])):
        expected[i] = len([1 for j in expected if rows[j][0] == g])
    assert len(found) == len(rows) and {x.i: x.position for x in found} == expected


def test_whole_table_and_empty(spark):
    frame = spark.range(100, 0, -1).repartition(5)
    assert sorted((x.id, x.place) for x in ranked(frame, [], ["id"], "place").collect()) == [(i + 1, i) for i in range(100)]
    assert ranked(frame.limit(0), [], ["id"]).count() == 0
