"""Numeric, date and unit helpers built from JVM-side functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The blanks the exports' single-byte encodings can hold.
WHITESPACE = " \t\n\r\x0b\x0c\x85\xa0"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# Plausible ranges of hourly station readings (None = open end).
PLAUSIBLE = {
    "precipitacao_mm": (0, 200),
    "temperatura_c": (-30, 60),
    "temperatura_max_c": (-30, 65),
    "temperatura_min_c": (-40, 60),
    "umidade_pct": (0, 100),
    "radiacao_kj_m2": (0, None),
    "vento_m_s": (0, 75),
}
# Magnus coefficients of vapour pressure and the Kelvin offset.
MAGNUS_A, MAGNUS_B, KELVIN = 17.625, 243.04, 273.15


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: Column | str) -> Column:
    """True for a real number; false (never NULL) for NULL, NaN and infinities."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def finite_or_null(c: Column | str) -> Column:
    return F.when(is_finite(c), col(c))


def clip(c: Column | str, low=None, high=None) -> Column:
    """Bound a value; ``least``/``greatest`` skip NULLs, so NULL is guarded."""
    c = out = col(c)
    if high is not None:
        out = F.least(out, F.lit(high))
    if low is not None:
        out = F.greatest(out, F.lit(low))
    return F.when(c.isNotNull(), out)


def trimmed(c: Column | str) -> Column:
    return F.btrim(col(c).cast("string"), F.lit(WHITESPACE))


def null_tokens(c: Column | str, tokens=("", "null", "NULL")) -> Column:
    c = col(c)
    return F.when(~c.isin(*tokens), c)


def decimal_comma(c: Column | str) -> Column:
    """Number written with a decimal comma; anything else becomes NULL."""
    text = F.replace(trimmed(c), F.lit(","), F.lit("."))
    return F.regexp_extract(text, NUMBER, 0).try_cast("double")


def plausible(c: Column | str, low=None, high=None) -> Column:
    c = col(c)
    keep = F.lit(True)
    if low is not None:
        keep = keep & (c >= low)
    if high is not None:
        keep = keep & (c <= high)
    return F.when(keep & ~F.isnan(c), c)


def plausible_readings(df):
    """Null every hourly reading outside its plausible range."""
    present = {n: r for n, r in PLAUSIBLE.items() if n in df.columns}
    return df.withColumns({n: plausible(n, *r) for n, r in present.items()})


def tolerant_date(c: Column | str) -> Column:
    """Date with ``/`` or ``-`` separators; NULL when it is not one."""
    text = F.replace(trimmed(c), F.lit("/"), F.lit("-"))
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text.try_cast("date"))


def code7(c: Column | str) -> Column:
    """Seven-digit municipality code as text, whatever type the source used."""
    return F.lpad(trimmed(c), 7, "0")


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """sum(v*w)/sum(w) with NULL when no weight is left."""
    value, weight = col(value), col(weight)
    total = F.sum(weight)
    return F.when(total > 0, F.sum(value * weight) / total)


def celsius(c: Column | str) -> Column:
    return col(c) - KELVIN


def wind_speed(u: Column | str, v: Column | str) -> Column:
    u, v = col(u), col(v)
    return F.sqrt(u * u + v * v)


def relative_humidity(temp_c: Column, dew_c: Column) -> Column:
    saturation = lambda t: F.exp(F.lit(MAGNUS_A) * t / (F.lit(MAGNUS_B) + t))
    return clip(100 * saturation(dew_c) / saturation(temp_c), 0.0, 100.0)


def season_year(day: Column | str) -> Column:
    """Harvest year of the September-April season; NULL from May to August."""
    day = col(day)
    return (
        F.when(F.month(day) >= 9, F.year(day) + 1)
        .when(F.month(day) <= 4, F.year(day))
        .cast("int")
    )


def season_hours(year: Column | str) -> Column:
    """Hours from 1 September of the previous year to 30 April, leap years included."""
    year = col(year)
    first = F.make_date(year - 1, F.lit(9), F.lit(1))
    after = F.make_date(year, F.lit(5), F.lit(1))
    return (F.datediff(after, first) * 24).cast("int")


def year_month(year: Column | str, month: Column | str) -> Column:
    return F.format_string("%d-%02d", col(year).cast("int"), col(month).cast("int"))


def period_index(year: Column | str, month: Column | str) -> Column:
    return col(year).cast("int") * 12 + col(month).cast("int")


def flags(*conditions: tuple[Column, str]) -> Column:
    """Array of the labels whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(label)) for c, label in conditions]))


def provenance(df, **values):
    """Append literal provenance columns to every row."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def with_defaults(df, defaults: dict[str, Column]):
    """Add the columns a source lacks; keep the ones it has."""
    return df.withColumns({k: v for k, v in defaults.items() if k not in df.columns})


def withhold(df, ok: Column, columns):
    """Null ``columns`` on rows that fail a quality condition."""
    keep = F.coalesce(ok, F.lit(False))
    return df.withColumns({c: F.when(keep, F.col(c)) for c in columns})
