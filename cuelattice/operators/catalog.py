"""Catalogs: identities, merges, change detection, idempotent history, fallbacks and look-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical_identity(sha: Column, provider_id: Column, path: Column, row: Column) -> Column:
    """One identity by the first that is available: content digest, provider id, path, row id.

    Each has its own prefix, so that identities of different kinds never meet. Digests and paths
    are compared without regard to case and surrounding blanks; 0 is no provider id.
    """
    s, p = F.lower(F.trim(sha)), F.lower(F.trim(path))
    return F.coalesce(
        F.when(s != "", F.concat(F.lit("sha:"), s)),
        F.when(provider_id != 0, F.concat(F.lit("id:"), provider_id.cast("string"))),
        F.when(p != "", F.concat(F.lit("path:"), p)),
        F.concat(F.lit("row:"), row.cast("string")),
    )


def keep_best(df: DataFrame, keys: Sequence[str], best: Sequence[Column], cols: Sequence[str]) -> DataFrame:
    """One row a key: the one that comes first by ``best``, found by a map-side combined minimum.

    ``best``: orderable expressions, smallest wins; they must make a total order.
    """
    packed = F.min(F.struct(*[b.alias(f"o{i}") for i, b in enumerate(best)], F.struct(*cols).alias("row")))
    return df.groupBy(*keys).agg(packed.alias("m")).select(*keys, *[F.col(f"m.row.{c}").alias(c) for c in cols])


def coalesce_merge(parts: Sequence[DataFrame], key: str, cols: Sequence[str]) -> DataFrame:
    """Full upsert of several tables on one key: of each column the first non-null value in order of the tables.

    The smallest value decides between rows of one table.
    """
    rows = None
    for i, p in enumerate(parts):
        r = p.select(key, *cols, F.lit(i).alias("_rank"))
        rows = r if rows is None else rows.unionByName(r)
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("_rank", c)))[c].alias(c)
    return rows.groupBy(key).agg(*[first(c) for c in cols], F.count("*").alias("merged"))


def match_with_fallback(left: DataFrame, right: DataFrame, left_id: str, keys: Sequence[tuple[str, str]], right_id: str) -> DataFrame:
    """(left_id, right_id, tier): each left row's match on the first of several keys that has one.

    ``keys``: (left column, right column) in order. Of several matches on one key the smallest
    right id counts; right keys are reduced to that before the join. NULL keys match nothing; rows without a match keep NULLs.
    """
    out = left.select(left_id, *dict.fromkeys(k for k, _ in keys))
    hits = []
    for i, (a, b) in enumerate(keys):
        r = right.where(F.col(b).isNotNull()).groupBy(F.col(b).alias(f"_k{i}")).agg(F.min(right_id).alias(f"_r{i}"))
        out = out.join(r, F.col(a) == F.col(f"_k{i}"), "left")
        hits.append(f"_r{i}")
    tier = F.coalesce(*[F.when(F.col(h).isNotNull(), F.lit(i + 1)) for i, h in enumerate(hits)])
    return out.select(left_id, F.coalesce(*hits).alias(right_id), tier.alias("tier"))


def library_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, action, old_path): what changed between two snapshots (path, digest), paths unique.

    ``reused``: same path and digest; ``changed``: same path, another digest; ``moved``: a new path whose
    digest stood at paths that are all gone; ``added``: any other new path; ``deleted``: a path that
    is gone and isn't the source of a move. The smallest gone path is a move's source.
    """
    b = before.select("path", F.col("digest").alias("old"))
    n = now.select("path", F.col("digest").alias("new"))
    both = n.join(b, "path", "full")
    kept = both.where("new is not null and old is not null").select("path", F.when(F.col("new") == F.col("old"), "reused").otherwise("changed").alias("action"), F.lit(None).cast("string").alias("old_path"))
    gone = both.where("new is null")
    came = both.where("old is null")
    # a digest counts as moved if none of its old paths is left
    by = before.join(now.select("path", F.lit(True).alias("still")), "path", "left").groupBy("digest").agg(F.min(F.when(F.col("still").isNull(), F.col("path"))).alias("src"), F.count("still").alias("left"))
    came = came.join(by.where("left = 0").select(F.col("digest").alias("new"), "src"), "new", "left")
    new = came.select("path", F.when(F.col("src").isNull(), "added").otherwise("moved").alias("action"), F.col("src").alias("old_path"))
    used = new.where("old_path is not null").select(F.col("old_path").alias("path")).distinct()
    lost = gone.join(used, "path", "left_anti").select("path", F.lit("deleted").alias("action"), F.lit(None).cast("string").alias("old_path"))
    return kept.unionByName(new).unionByName(lost)


def usage_events(uses: DataFrame, run: str, parts: Sequence[str]) -> DataFrame:
    """(event_id, run, n): one event a run, named by a digest of the run and its sorted distinct parts.

    Parts enter as a sum of their hashes, so a run of any number of parts is reduced map-side.
    """
    d = uses.select(run, *parts).distinct()
    h = F.xxhash64(*[F.col(p) for p in parts])
    agg = d.groupBy(run).agg(F.count("*").alias("n"), F.bit_xor(h).alias("a"), F.sum(F.pmod(h, F.lit(1_000_000_007))).alias("b"))
    return agg.select(F.substring(F.sha2(F.concat_ws("|", run, F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256), 1, 24).alias("event_id"), run, "n")


def commit_once(history: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``history`` and the rows of ``new`` whose key isn't there yet, each once: a replay adds nothing."""
    fresh = new.dropDuplicates([key]).join(history.select(key).distinct(), key, "left_anti")
    return history.unionByName(fresh)


def differences(expected: DataFrame, actual: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """(key, expected, actual) where two tables disagree; NULL equals NULL."""
    e = expected.select(*key, F.col(value).alias("expected"), F.lit(1).alias("_e"))
    a = actual.select(*key, F.col(value).alias("actual"), F.lit(1).alias("_a"))
    j = e.join(a, list(key), "full")
    return j.where(F.col("_e").isNull() | F.col("_a").isNull() | ~F.col("expected").eqNullSafe(F.col("actual"))).select(*key, "expected", "actual")


def top_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key; a window group limit drops the rest before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w).cast("long")).where(F.col(out) <= k)


def pivot_pairs(df: DataFrame, key: str, side: str, value: str, sides: Sequence[str]) -> DataFrame:
    """One row a key with a column for each stated side; of several values the largest."""
    return df.groupBy(key).pivot(side, list(sides)).agg(F.max(value))
