"""Distributions, quantiles, matrices and votes. Partial aggregation runs before every shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.norm import rounded


def distribution(df: DataFrame, label: str, by: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """(by, label, n, share): counts and shares of the non-empty labels of each group."""
    rows = df.where(F.col(label).isNotNull() & (F.col(label) != ""))
    n = rows.groupBy(*by, label).agg(F.count("*").alias("n"))
    return n.withColumn("share", rounded(F.col("n") / F.sum("n").over(Window.partitionBy(*by)), digits))


def average_distribution(df: DataFrame, label: str, by: str, digits: int = 4) -> DataFrame:
    """(label, share): mean of the groups' distributions, empty groups left out, absent labels as 0."""
    per = distribution(df, label, [by], 9).select(by, label, F.floor(F.col("share") * 1e9 + 0.5).cast("long").alias("nano"))
    total = per.groupBy(label).agg(F.sum("nano").alias("s"))
    return total.select(label, rounded(F.col("s") / F.sum("s").over(Window.partitionBy()), digits).alias("share"))


def dominant(df: DataFrame, label: str, by: Sequence[str]) -> DataFrame:
    """(by, label, n): the most frequent label of each group; of equals the larger label."""
    n = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.max(F.struct("n", label)).alias("m")).select(*by, F.col(f"m.{label}").alias(label), F.col("m.n").alias("n"))


def five_numbers(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """(by, n, low, q1, mid, q3, high): linearly interpolated quantiles of the non-null values."""
    q = lambda p: F.percentile(F.col(value).cast("double"), F.lit(p))
    r = df.where(F.col(value).isNotNull()).groupBy(*by)
    return r.agg(F.count("*").alias("n"), F.min(value).alias("low"), q(0.25).alias("q1"), q(0.5).alias("mid"), q(0.75).alias("q3"), F.max(value).alias("high"))


def upper_median(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """(by, upper_mid): the value at position n div 2, counted from 0, in ascending order.

    Counts of distinct values stand for the rows, so a group costs its distinct values only.
    """
    n = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_k"))
    w = Window.partitionBy(*by).orderBy(value)
    n = n.withColumn("_upto", F.sum("_k").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_k").over(Window.partitionBy(*by)))
    half = F.floor(F.col("_all") / 2)
    return n.where((F.col("_upto") > half) & (F.col("_upto") - F.col("_k") <= half)).select(*by, F.col(value).alias("upper_mid"))


def transitions(pairs: DataFrame, src: str, dst: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, src, dst, n, p): row-normalised counts of the pairs with both ends."""
    n = pairs.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).groupBy(*by, src, dst).agg(F.count("*").alias("n"))
    return n.withColumn("p", rounded(F.col("n") / F.sum("n").over(Window.partitionBy(*by, src))))


def best_next(matrix: DataFrame, src: str, dst: str) -> DataFrame:
    """(src, dst): the likeliest follower; of equals the larger label."""
    return matrix.groupBy(src).agg(F.max(F.struct("n", dst)).alias("m")).select(src, F.col(f"m.{dst}").alias(dst))


def votes(df: DataFrame, by: Sequence[str], label: str, confidence: Column) -> DataFrame:
    """(by, label, votes, mean, rank): by mean confidence, then votes, then label."""
    v = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("votes"), F.sum(confidence).alias("c"))
    v = v.withColumn("mean", rounded(F.col("c") / F.col("votes") / 1000.0))
    w = Window.partitionBy(*by).orderBy(F.desc("mean"), F.desc("votes"), F.asc(label))
    return v.withColumn("rank", F.row_number().over(w).cast("long")).drop("c")
