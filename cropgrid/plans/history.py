"""Leakage-safe history features: a row sees only earlier rows of its municipality and crop.

A series holds one row per harvest year and production system, so the window partitions are
bounded by the number of years, whatever the size of the panel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTORY_KEY = ["codigo_ibge", "cultura"]
HISTORY_INPUTS = [*HISTORY_KEY, "ano", "produtividade_kg_ha", "area_plantada_ha", "producao_t"]
# Years are centred before squaring: slopes are unchanged and small integers stay exact.
YEAR_ORIGIN = 2000
NEAR_ZERO = 1e-12


def _trend(x: Column, y: Column, frame) -> Column:
    """Slope from four means. The mean year counts rows without yield too, unlike regr_slope."""
    two = lambda c: F.when(F.count(c).over(frame) >= 2, F.avg(c).over(frame))
    mx, my, mxy, mxx = two(x), two(y), two(x * y), two(x * x)
    spread = mxx - mx * mx
    return F.when(F.abs(spread) > NEAR_ZERO, (mxy - mx * my) / spread)


def history_features(
    panel: DataFrame, *, key: list[str] = HISTORY_KEY, year: str = "ano",
    value: str = "produtividade_kg_ha", area: str = "area_plantada_ha", production: str = "producao_t",
) -> DataFrame:
    """Trailing means, deviation, variation, trends and presence, one shuffle for all of them."""
    missing = sorted({*key, year, value, area, production} - set(panel.columns))
    if missing:
        raise ValueError(f"panel lacks the columns {missing}")
    series = Window.partitionBy(*key).orderBy(year)
    back = lambda n: series.rowsBetween(-n, -1)
    ever = series.rowsBetween(Window.unboundedPreceding, -1)
    x, y = (F.col(year) - YEAR_ORIGIN).cast("double"), F.col(value)
    featured = panel.withColumns(
        {
            "yield_mean_3y": F.avg(y).over(back(3)),
            "yield_mean_5y": F.avg(y).over(back(5)),
            "yield_std_5y": F.stddev_samp(y).over(back(5)),
            "yield_trend_5y": _trend(x, y, back(5)),
            "yield_trend_10y": _trend(x, y, back(10)),
            "area_mean_5y": F.avg(area).over(back(5)),
            "production_mean_5y": F.avg(production).over(back(5)),
            "crop_presence_years": F.count(y).over(ever).cast("int"),
        }
    )
    mean = F.col("yield_mean_5y")
    return featured.withColumn(
        "yield_cv_5y", F.when(F.abs(mean) > NEAR_ZERO, F.col("yield_std_5y") / mean)
    )


def trailing_median(
    value: str = "produtividade_kg_ha", *, key: list[str] = ("codigo_ibge",), year: str = "ano",
    rows: int = 5, at_least: int = 3,
) -> Column:
    """Median of the previous rows when enough of them carry a value."""
    frame = Window.partitionBy(*key).orderBy(year).rowsBetween(-rows, -1)
    return F.when(F.count(value).over(frame) >= at_least, F.percentile(value, 0.5).over(frame))
