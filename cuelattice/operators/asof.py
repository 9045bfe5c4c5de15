"""Nearest neighbours in time with window functions, for tolerances and argmins in the core."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, ident: str, width: float) -> DataFrame:
    """(left columns, near_id, near_at): the nearest right row of each left row's entity, the earlier of two equally near.

    One union, one sort within slices; slices take the neighbours beyond them from summaries with
    one row a slice. Left rows of entities without right rows keep NULLs. Rows with a null key or
    time don't count. ``ident`` names the right rows; of several at one time the smallest counts.
    """
    cols = [c for c in left.columns]
    r = right.where(" and ".join(f"{c} is not null" for c in [*keys, at])).groupBy(*keys, at).agg(F.min(ident).alias("_id"))
    point = f"struct<t:bigint,id:{dict(right.dtypes)[ident]}>"
    packed = F.struct(F.col(at).alias("t"), F.col("_id").alias("id")).cast(point)
    le = left.where(" and ".join(f"{c} is not null" for c in [*keys, at])).withColumn("_row", F.struct(*cols))
    row_type = le.schema["_row"].dataType
    rows = r.select(*keys, at, F.lit(0).alias("_side"), packed.alias("_p"), F.lit(None).cast(row_type).alias("_row")).unionByName(
        le.select(*keys, at, F.lit(1).alias("_side"), F.lit(None).cast(point).alias("_p"), "_row")
    )
    rows = rows.withColumn("_s", F.floor(F.col(at) / F.lit(width)).cast("long"))
    w = Window.partitionBy(*keys, "_s").orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    b = Window.partitionBy(*keys, "_s").orderBy(F.desc(at), "_side").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.groupBy(*keys, "_s").agg(F.max("_p").alias("tail"), F.min("_p").alias("head"))
    o = Window.partitionBy(*keys).orderBy("_s")
    ends = ends.select(*keys, "_s", F.last("tail", True).over(o.rowsBetween(Window.unboundedPreceding, -1)).alias("_fb"), F.first("head", True).over(o.rowsBetween(1, Window.unboundedFollowing)).alias("_fa"))
    rows = rows.withColumn("_b", F.last("_p", True).over(w)).withColumn("_a", F.last("_p", True).over(b)).where("_side = 1")
    rows = rows.join(ends, [*keys, "_s"]).withColumn("_b", F.coalesce("_b", "_fb")).withColumn("_a", F.coalesce("_a", "_fa"))
    before = F.col("_a").isNull() | (F.col("_b").isNotNull() & (F.col(at) - F.col("_b.t") <= F.col("_a.t") - F.col(at)))
    pick = F.when(before, F.col("_b")).otherwise(F.col("_a"))
    return rows.select(*[F.col(f"_row.{c}").alias(c) for c in cols], pick["id"].alias("near_id"), pick["t"].alias("near_at"))
