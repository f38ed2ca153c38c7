"""Small helpers for writing check SQL."""

from __future__ import annotations


def r(expression: str, name: str | None = None) -> str:
    return f"round({expression}, 4) as {name or expression.split('.')[-1]}"


def rs(*names: str, prefix: str = "") -> str:
    return ", ".join(f"round({prefix}{n}, 4) as {n}" for n in names)


def n(expression: str, name: str | None = None) -> str:
    return f"cast({expression} as bigint) as {name or expression.split('.')[-1]}"


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = (
        f"(pow(sin(radians({lat2} - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * pow(sin(radians({lon2} - ({lon1})) / 2), 2))"
    )
    return f"(2 * 6371.0088 * atan2(sqrt({h}), sqrt(1 - {h})))"


def joined(expression: str, name: str) -> str:
    """A list as comma-joined text."""
    return f"list_aggregate({expression}, 'string_agg', ',') as {name}"


def adequate(prefix: str = "") -> str:
    p = prefix
    return (
        f"coalesce(isfinite({p}rain_crop_cycle_mm) and isfinite({p}mean_temp_c) and "
        f"isfinite({p}season_coverage) and {p}season_coverage between 0.7 and 1.0, false)"
    )
