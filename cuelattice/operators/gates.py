"""Quality gates as tables: one row a check, with three-valued verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_table(df: DataFrame, keys: Sequence[str], checks: Sequence[tuple[str, Column, bool]]) -> DataFrame:
    """(keys, check, passed, blocking): every check of every row, by a generator and not by unions."""
    arr = F.array(*[F.struct(F.lit(n).alias("check"), c.cast("boolean").alias("passed"), F.lit(b).alias("blocking")) for n, c, b in checks])
    return df.select(*keys, F.explode(arr).alias("c")).select(*keys, "c.check", "c.passed", "c.blocking")


def verdict(checks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, passed, failed, unknown): passed if no blocking check failed; unknown checks don't fail."""
    bad = F.sum(F.when(F.col("blocking") & (F.col("passed") == F.lit(False)), 1).otherwise(0))
    return checks.groupBy(*keys).agg((bad == 0).alias("passed"), F.sum(F.when(F.col("passed") == F.lit(False), 1).otherwise(0)).cast("long").alias("failed"), F.sum(F.when(F.col("passed").isNull(), 1).otherwise(0)).cast("long").alias("unknown"))
