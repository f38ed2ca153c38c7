"""Exact nearest and farthest neighbours on the sphere without comparing all pairs.

Points and targets fall into cells of a fixed pyramid of latitude/longitude grids. A table of cell pairs says which target
cells can hold the answer for some point of a point cell: it starts with the coarsest cells, and a level keeps a pair if
the best distance that the two cells' bounds allow is no worse than a distance that some target surely gives to every
point of the cell. Its size follows the occupied cells, not the points. On the finest level it becomes a table from point cells
to candidate targets, which points meet in one salted join; the least struct of distance and key is the exact answer.

All of it is one lazy plan: no job runs before the action, whatever the data. The finest cells are some 20 km wide, so
a point meets the targets of a few such cells; a denser set of targets needs a further entry in WIDTHS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import half_chord, haversine_km
from .skew import salted_join

#: Degrees of a cell on each level; each divides the one before.
WIDTHS = (11.25, 2.8125, 0.703125, 0.17578125)
SLACK = 1e-9
#: Tasks that the points of one finest cell are spread over.
CELL_SALTS = 4


def _cell(lat: str, lon: str, width: float) -> Column:
    """Number of the cell, unique on its level."""
    row, column = (F.floor((F.col(c) + shift) / F.lit(width)) for c, shift in ((lat, 90.0), (lon, 180.0)))
    return row * F.lit(1 << 32) + column


def _numbered(df: DataFrame, side: str) -> DataFrame:
    """With the cells of all levels, `_p0`, `_p1`, ... for points and `_t0`, ... for targets."""
    return df.withColumns({f"_{side}{i}": _cell(f"_{side}lat", f"_{side}lon", w) for i, w in enumerate(WIDTHS)})


def _cells(df: DataFrame, side: str, level: int, by: list[str]) -> DataFrame:
    """Occupied cells of a level with the bounds of what lies in them; target cells also with one target's place."""
    lat, lon = f"_{side}lat", f"_{side}lon"
    bounds = [F.min(lat).alias(f"{lat}0"), F.max(lat).alias(f"{lat}1"), F.min(lon).alias(f"{lon}0"), F.max(lon).alias(f"{lon}1")]
    seen = [F.min_by(lon, lat).alias("_seen")] if side == "t" else []
    above = [f"_{side}{level - 1}"] if level else []
    return df.groupBy(*by, *above, f"_{side}{level}").agg(*bounds, *seen)


def _square(degrees: Column) -> Column:
    """Haversine of an angle: even, with period 360, least at 0 and greatest at 180."""
    half = F.sin(F.radians(degrees) / 2)
    return half * half


def _cosines(lat0: str, lat1: str) -> tuple[Column, Column]:
    """Least and greatest cosine between two latitudes."""
    ends = F.cos(F.radians(lat0)), F.cos(F.radians(lat1))
    return F.least(*ends), F.when((F.col(lat0) <= 0) & (F.col(lat1) >= 0), 1.0).otherwise(F.greatest(*ends))


def _spread(a0: Column, a1: Column, b0: Column, b1: Column) -> tuple[Column, Column]:
    """Least and greatest haversine of the longitude between two ranges; b - a lies between b0 - a1 and b1 - a0."""
    low, high = b0 - a1, b1 - a0
    reaches = lambda at: (low <= at) & (high >= at)
    least = F.when(reaches(0.0) | reaches(360.0) | reaches(-360.0), 0.0).otherwise(F.least(_square(low), _square(high)))
    most = F.when(reaches(180.0) | reaches(-180.0), 1.0).otherwise(F.greatest(_square(low), _square(high)))
    return least, most


def _bounds(farthest: bool) -> tuple[Column, Column]:
    """Half-chords of a pair of cells: the best that any point and target may have, and one that some target surely
    gives to every point (for the nearest, at most; for the farthest, at least)."""
    c = F.col
    cos_p, cos_t = _cosines("_plat0", "_plat1"), _cosines("_tlat0", "_tlat1")
    lon = _spread(c("_plon0"), c("_plon1"), c("_tlon0"), c("_tlon1"))
    near_lat = _square(F.greatest(c("_tlat0") - c("_plat1"), c("_plat0") - c("_tlat1"), F.lit(0.0)))
    far_lat = _square(F.greatest(c("_tlat1") - c("_plat0"), c("_plat1") - c("_tlat0")))
    # the seen target is the southernmost one of its cell
    seen_lon = _spread(c("_plon0"), c("_plon1"), c("_seen"), c("_seen"))
    seen_cos = F.cos(F.radians("_tlat0"))
    seen_near = _square(F.greatest(c("_tlat0") - c("_plat1"), c("_plat0") - c("_tlat0"), F.lit(0.0)))
    seen_far = _square(F.greatest(F.abs(c("_tlat0") - c("_plat0")), F.abs(c("_plat1") - c("_tlat0"))))
    if farthest:
        return far_lat + cos_p[1] * cos_t[1] * lon[1], seen_near + cos_p[0] * seen_cos * seen_lon[0]
    return near_lat + cos_p[0] * cos_t[0] * lon[0], seen_far + cos_p[1] * seen_cos * seen_lon[1]


def _candidate_cells(points: DataFrame, seats: DataFrame, by: list[str], given: list[str], farthest: bool) -> DataFrame:
    """by, the finest point cell and the finest target cells that may hold the answer of one of its points."""
    sign = -1 if farthest else 1
    hope, sure = _bounds(farthest)
    open_ = None
    for level in range(len(WIDTHS)):
        p, t = _cells(points, "p", level, given), _cells(seats, "t", level, by)
        if open_ is None:  # all pairs of the coarsest cells: as many as the sphere has, at most
            met = p.withColumn("_root", F.lit(0)).join(t.withColumn("_root", F.lit(0)), [*given, "_root"])
        else:
            met = open_.join(p, [*given, f"_p{level - 1}"]).join(t, [*by, f"_t{level - 1}"])
        here = Window.partitionBy(*by, f"_p{level}")
        judged = met.withColumns({"_hope": hope * sign, "_sure": sure * sign}).withColumn("_best", F.min("_sure").over(here))
        kept = judged.where(F.col("_hope") <= F.col("_best") + F.abs("_best") * SLACK + 1e-15)
        open_ = kept.select(*by, f"_p{level}", f"_t{level}")
    return open_


def extreme_neighbours(
    points: DataFrame,
    targets: DataFrame,
    *,
    by: list[str],
    point_coordinates: tuple[str, str],
    target_coordinates: tuple[str, str],
    target_key: str,
    farthest: bool = False,
    every_group: bool = False,
) -> DataFrame:
    """Per distinct (group, point coordinate): the nearest (or farthest) target and its distance.

    Returns ``by + point coordinates + target_key + distance_km``. Groups without targets yield
    no row. Among equal distances the smallest target key wins; keys travel with candidates, so keep them narrow. With
    ``every_group`` the points carry no group and are searched in each one; groups must then be few, such as seasons.
    """
    plat, plon = point_coordinates
    tlat, tlon = target_coordinates
    given = [] if every_group else by
    # Unique coordinates per group; the first key stands for all targets of one place.
    seats = _numbered(
        targets.select(
            *by, F.col(tlat).cast("double").alias("_tlat"), F.col(tlon).cast("double").alias("_tlon"),
            F.col(target_key).alias("_key"),
        ).where("_tlat is not null and _tlon is not null")
        .groupBy(*by, "_tlat", "_tlon").agg(F.min("_key").alias("_key")),
        "t",
    )
    places = _numbered(
        points.select(
            *given, F.col(plat).cast("double").alias("_plat"), F.col(plon).cast("double").alias("_plon")
        )
        .where("_plat is not null and _plon is not null")
        .distinct(),
        "p",
    )
    finest_p, finest_t = (f"_{side}{len(WIDTHS) - 1}" for side in "pt")
    cells = _candidate_cells(places, seats, by, given, farthest)
    candidates = cells.join(seats.select(*by, finest_t, "_tlat", "_tlon", "_key"), [*by, finest_t]).drop(finest_t)
    sign = -1 if farthest else 1
    met = salted_join(places.select(*given, finest_p, "_plat", "_plon"), candidates, [*given, finest_p], salts=CELL_SALTS)
    found = (
        met.withColumn("_far", half_chord("_plat", "_plon", "_tlat", "_tlon") * sign)
        .groupBy(*by, "_plat", "_plon")
        .agg(F.min(F.struct("_far", "_key", "_tlat", "_tlon")).alias("_pick"))
    )
    return found.select(
        *by, F.col("_plat").alias(plat), F.col("_plon").alias(plon),
        F.col("_pick._key").alias(target_key),
        haversine_km("_plat", "_plon", F.col("_pick._tlat"), F.col("_pick._tlon")).alias("distance_km"),
    )


def nearest_on_axis(points: DataFrame, value: str, axis: DataFrame, axis_value: str) -> DataFrame:
    """Distinct point values with the nearest value of a coordinate axis (ties go upward).

    An axis holds one row per grid line, so its length is bounded by 360 degrees over the grid
    resolution and never grows with the number of readings. Every line owns the interval between
    its two midpoints; intervals meet points by an equi-join on coarse steps.
    """
    lines = axis.select(F.col(axis_value).cast("double").alias("_line")).where(
        "_line is not null"
    ).distinct()
    whole = Window.orderBy("_line")
    lines = lines.select(
        "_line",
        ((F.lag("_line").over(whole) + F.col("_line")) / 2).alias("_from"),
        ((F.lead("_line").over(whole) + F.col("_line")) / 2).alias("_to"),
    )
    bucket = lambda c: F.floor(c)
    first = F.coalesce(bucket(F.col("_from")), bucket(F.col("_line")))
    last = F.coalesce(bucket(F.col("_to")), bucket(F.col("_line")))
    intervals = lines.withColumn("_bucket", F.explode(F.sequence(first, last)))
    wanted = points.select(F.col(value).cast("double").alias("_value")).where(
        "_value is not null"
    ).distinct()
    # A value beyond the axis has the nearest line of the axis' end; the ends are one row.
    ends = lines.agg(F.min("_line").alias("_low"), F.max("_line").alias("_high"))
    inside = wanted.crossJoin(F.broadcast(ends)).withColumn(
        "_inside", F.least(F.greatest("_value", "_low"), F.col("_high"))
    )
    hit = inside.withColumn("_bucket", bucket(F.col("_inside"))).join(intervals, "_bucket").where(
        (F.col("_from").isNull() | (F.col("_inside") >= F.col("_from")))
        & (F.col("_to").isNull() | (F.col("_inside") < F.col("_to")))
    )
    return hit.select(F.col("_value").alias(value), F.col("_line").alias(axis_value))
