"""Connected components over links, by alternating large-star and small-star steps.

Links never reach the driver. Each round is two shuffles of the links left; rounds end when no
link changes; their number grows with the logarithm of the longest chain. Chunks of links are contracted locally first, so few rounds are needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, write_out


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one chunk as stars around the least id of each local component."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = inv[: len(a)], inv[len(a) :]
        label = np.arange(len(ids))
        while True:
            low = np.minimum(label[x], label[y])
            new = label.copy()
            np.minimum.at(new, label[x], low)
            np.minimum.at(new, label[y], low)
            while True:
                jump = new[new]
                if (jump == new).all():
                    break
                new = jump
            if (new == label).all():
                break
            label = new
        far = label != np.arange(len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[label[far]])], ["a", "b"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp): ``comp`` is the least id of the linked group. Ids without a link don't appear.

    Links may be repeated, in either direction, or loops; rows with a null end don't count.
    """
    e = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    e = e.mapInArrow(_contract, "a bigint, b bigint").distinct()
    e = write_out(e, "cc-0")
    i = 0
    while True:
        i += 1
        # large star: every larger neighbour of a node links to the least of the node and its neighbours
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: every smaller neighbour of a node, and the node, link to the least of them
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("s"))
        new = small.select(F.col("s.b").alias("a"), F.col("s.m").alias("b")).where("a <> b").distinct()
        new = write_out(new, f"cc-{i}")
        # done when each id has one link and no id that others link to has one
        stars = new.groupBy("a").agg(F.count("*").alias("n"))
        open_ids = stars.where("n > 1").select("a").limit(1).unionByName(new.select("b").distinct().join(stars, F.col("b") == F.col("a"), "left_semi").select(F.col("b").alias("a")).limit(1))
        more = open_ids.take(1)
        discard(e)
        e = new
        if not more:
            break
    return e.select(F.col("a").alias("id"), F.col("b").alias("comp")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct())
