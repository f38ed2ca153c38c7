"""Joins of many rows with a few facts per key that stay balanced when one key is hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "inner", salts: int = SALTS, null_safe: bool = False) -> DataFrame:
    """Join ``facts`` (few per key) onto ``rows`` with every key spread over ``salts`` tasks.

    Rows that are copies of each other share a salt; with the salt in the join key Spark's skew
    handling can still split them, as no later step relies on the join's partitioning. The salt also
    keeps Spark from reusing the join's partitioning for a later grouping on the
    key, which would leave a hot key in one task. With ``null_safe`` a null key finds the facts of the null key.
    """
    spread = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")
    salted = rows.withColumn("_salt", salt)
    if not null_safe:
        return salted.join(spread, [*keys, "_salt"], how).drop("_salt")
    named = spread.withColumnsRenamed({c: f"_of_{c}" for c in [*keys, "_salt"]})
    same = F.col("_salt") == F.col("_of__salt")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return salted.join(named, same, how).drop("_salt", "_of__salt", *[f"_of_{c}" for c in keys])
