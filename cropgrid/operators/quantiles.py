"""Exact quantiles that never gather a large group in one task.

``percentile`` keeps every distinct value of a group in one buffer, and ranking with a window
sorts a group in one task. Both are fine for a municipality's ten harvests, not for a state or a
whole table. Here a rank is found by refinement, alike for groups of every size: the values of a group are counted by range,
a running count over the ranges tells which one holds the wanted rank, and only that one is opened again. The first ranges grow
with the size of the values, so that outliers take ranges of their own; the next split the opened one evenly between the
least and greatest value in it; then the few values left are counted one by one. Counts are partial before every shuffle,
and exact in each round, so a rank can not be missed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import salted_join

# Ranges of the first round for each step of a value by e; ranges of the second round.
STEEP_RANGES = 256
EVEN_RANGES = 1 << 16


def linear(p: float) -> Callable[[Column], Column]:
    """Position of probability ``p`` among n sorted values, interpolating linearly."""
    return lambda n: (n - 1) * F.lit(float(p))


def conformal(coverage: float) -> Callable[[Column], Column]:
    """Position of the split-conformal quantile: level ceil((n+1)c)/n, next higher value."""

    def position(n: Column) -> Column:
        level = F.least(F.lit(1.0), F.ceil((n + 1) * F.lit(float(coverage))) / n)
        exact = (n - 1) * level
        near = F.round(exact)
        return F.when(F.abs(exact - near) < 1e-9, near).otherwise(F.ceil(exact)).cast("double")

    return position


def _counted(ranged: DataFrame, at: list[str]) -> DataFrame:
    """Values by `_range`: how many there are in it and before it, and the least and greatest one."""
    found = ranged.groupBy(*at, "_range").agg(F.count(F.lit(1)).alias("_in"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
    order = Window.partitionBy(*at).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("_before", F.coalesce(F.sum("_in").over(order), F.lit(0)))


def _opened(placed: DataFrame, by: list[str], wanted: list[Column]) -> DataFrame:
    """One row per key: `_n`, and for each wanted rank its rest `_r<i>` in the range that holds it, from `_lo<i>` to `_hi<i>`."""
    told = {"_lo": F.col("_from"), "_hi": F.col("_to")}
    parts = []
    for i, rank in enumerate(wanted):
        hit = (rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_in"))
        parts += [F.max(F.when(hit, c)).alias(f"{name}{i}") for name, c in ({"_r": rank - F.col("_before")} | told).items()]
    return placed.groupBy(*by, "_n").agg(*parts)


def _again(rows: DataFrame, facts: DataFrame, by: list[str], ranks: range, range_of: Callable[[Column, Column], Column], few: bool = False) -> DataFrame:
    """A further round: the values in the ranges of ``facts``, counted by ``range_of`` the ranges' bounds.

    Ranges of two ranks are the same or apart, so the ranks that a value counts for tell its range. ``few``: keys are few enough
    to send their facts to every task, so that no value is moved.
    """
    v = F.col("_v")
    inside = [(v >= F.col(f"_lo{i}")) & (v <= F.col(f"_hi{i}")) for i in ranks]
    bound = lambda side: F.coalesce(*[F.when(test, F.col(f"_{side}{i}")) for i, test in zip(ranks, inside, strict=True)])
    # Not by broadcasting the values to the few tasks that hold the facts: the facts are spread, and the values stay spread.
    # Few salts, as keys may be many; what is left of a hot key is split by Spark's skew handling.
    if few:
        named = facts.withColumnsRenamed({c: f"_of_{c}" for c in by})
        met = rows.join(F.broadcast(named), reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]))
    else:
        met = salted_join(rows, facts.hint("shuffle_hash"), by, salts=4, null_safe=True)
    held = met.where(reduce(lambda x, y: x | y, inside))
    mine = [f"_m{i}" for i in ranks]
    marked = held.select(
        *by, "_n", "_v", *[F.when(test, F.col(f"_r{i}")).alias(m) for i, m, test in zip(ranks, mine, inside, strict=True)],
        range_of(bound("lo"), bound("hi")).alias("_range"))
    return _opened(_counted(marked, [*by, "_n", *mine]), by, [F.col(m) for m in mine])


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    quantiles: dict[str, float],
    *,
    position: Callable[[float], Callable[[Column], Column]] = linear,
    count_as: str | None = None,
    few: bool = False,
) -> DataFrame:
    """One row per key with an exact quantile column for each ``name: probability``.

    NULL values are ignored; a group with only NULLs yields no row. A NULL key is a group. Without keys the result is one row, or none.
    ``few`` tells that the keys are few whatever the table's size, as names of columns are.
    """
    whole = not keys
    again = partial(_again, few=True) if few or whole else _again
    by = ["_all"] if whole else list(keys)
    rows = df.withColumn("_all", F.lit(1)) if whole else df
    rows = rows.select(*by, F.col(value).cast("double").alias("_v"))
    rows = rows.where("_v is not null")
    places = [position(p)(F.col("_n")) for p in quantiles.values()]
    ends = [end(at).cast("long") for at in places for end in (F.floor, F.ceil)]
    ranks = range(len(ends))

    v = F.col("_v")
    size = F.floor(F.log1p(F.abs(v)) * STEEP_RANGES)  # never falls as the value grows
    steep = F.when(v < 0, -1 - size).when(F.isnan(v) | (v == float("inf")), F.lit(1 << 62)).otherwise(size)

    def even(low: Column, high: Column) -> Column:
        share = F.try_divide(v / 2 - low / 2, high / 2 - low / 2)  # halves, so that no difference overflows
        return F.floor(F.nanvl(F.coalesce(share, F.lit(0.0)), F.lit(1.0)) * (EVEN_RANGES - 1))

    first = _counted(rows.withColumn("_range", F.when(v == float("-inf"), F.lit(-(1 << 62))).otherwise(steep)), by)
    first = first.withColumn("_n", F.sum("_in").over(Window.partitionBy(*by)))
    facts = again(rows, _opened(first, by, ends), by, ranks, even)
    found = again(rows, facts, by, ranks, lambda *_: v)  # the last ranges are single values

    outputs: list[Column] = []
    for i, (name, at) in enumerate(zip(quantiles, places, strict=True)):
        low, high = F.col(f"_lo{2 * i}"), F.col(f"_lo{2 * i + 1}")
        outputs.append((low + (high - low) * (at - F.floor(at))).alias(name))
    if count_as:
        outputs.append(F.col("_n").alias(count_as))
    return found.select(*([] if whole else by), *outputs)


def exact_medians(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Medians of several columns per key, in long form ``(keys, name, median)``."""
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        keys, columns, "name", "value"
    )
    return exact_quantiles(long, [*keys, "name"], "value", {"median": 0.5}, few=not keys)
