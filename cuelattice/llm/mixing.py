"""Mixing sources to target weights by capped water-filling.

Sizes are tokens of a public tokenizer. Sources whose share would need more than their cap of
repetitions are clamped there, and the excess weight goes to the others in proportion, until all
is feasible. A source's repetitions are then drawn as a whole part for every document and a seeded
fraction of one more.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOKENIZER = os.environ.get("CUELATTICE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Sources in a mix; a plan is metadata, one row a source.
MOST_SOURCES = 100_000
#: The split pattern that belongs to the byte-level vocabulary; fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CHUNK = 100_000
BUCKETS = 4096


def load_tokenizer(path: str):
    """A ``tiktoken`` encoding from a ranks file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str = "text", tokenizer: str = TOKENIZER, out: str = "n_tokens") -> DataFrame:
    """``df`` without ``text``, with the tokens of each whole text. Null and empty texts have 0. Narrow.

    A column that is named as ``out`` is replaced. Very long texts are encoded in pieces cut at
    line or word ends, so that time stays linear.
    """
    keep = [c for c in df.columns if c not in (text, out)]
    schema = df.select(*[F.col(f"`{c}`") for c in keep]).schema.add(out, "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load_tokenizer(tokenizer)
        for b in batches:
            n = [sum(len(enc.encode_ordinary(p)) for p in _pieces(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*keep, out])

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(count, schema)


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > _CHUNK:
        cut = max(text.rfind("\n", at + 1, at + _CHUNK), text.rfind(" ", at + 1, at + _CHUNK))
        cut = cut if cut > at else at + _CHUNK
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def source_name(c: Column) -> Column:
    """Trimmed, lower case, blanks and hyphens as underscores; empty is NULL."""
    s = F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"[\s-]", "_")
    return F.when(s != "", s)


def source_sizes(counted: DataFrame, targets: DataFrame, source: str = "source") -> DataFrame:
    """(source, target_share, max_repeats, docs, tokens): what each source of the mix has."""
    t = targets.select(source_name(F.col("source")).alias("s"), "target_share", "max_repeats").dropna(subset=["s"])
    have = counted.withColumn("s", source_name(F.col(source))).where("s is not null").groupBy("s").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    zero = F.lit(0).cast("long")
    return t.join(have, "s", "left").select(F.col("s").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"), F.coalesce("docs", zero).alias("docs"), F.coalesce("tokens", zero).alias("tokens"))


class Fill(NamedTuple):
    """Repetitions by source, and the sources that each round of the filling clamped at their caps."""

    repeats: dict[str, float]
    clamped: list[list[str]]


def water_fill(rows: list[tuple[str, float, int, int]], total: float | None = None) -> Fill:
    """Repetitions of each source (name, share, cap, tokens) in a mix of ``total`` tokens.

    Sources that can't fill their part are clamped at their cap; what they leave is shared among
    the others in proportion to their shares, again and again until no further source clamps.
    Those of the first round fall short of their own share. The default total is all tokens once.
    Shares are relative; a source without tokens gets 0.
    """
    size = {s: n for s, _, _, n in rows}
    cap = {s: float(c) * n for s, _, c, n in rows}
    share = {s: max(0.0, w) for s, w, _, _ in rows}
    left = float(sum(size.values()) if total is None else total)
    part: dict[str, float] = {}
    clamped: list[list[str]] = []
    open_ = {s for s in share if share[s] > 0}
    part |= dict.fromkeys(set(share) - open_, 0.0)
    while open_:
        weight = math.fsum(share[s] for s in open_)
        if abs(weight - 1) < 1e-9:  # shares of a whole, but for the last bits
            weight = 1.0
        full = {s for s in open_ if cap[s] < left * share[s] / weight}
        if not full:
            part |= {s: left * share[s] / weight for s in open_}
            break
        clamped.append(sorted(full))
        part |= {s: cap[s] for s in full}
        left -= sum(cap[s] for s in full)
        open_ -= full
    return Fill({s: part[s] / size[s] if size[s] else 0.0 for s in share}, clamped)


def short_sources(spark: SparkSession, fill: Fill) -> DataFrame:
    """(source): sources that miss their share even at their cap: those that the first round clamped."""
    return spark.createDataFrame([(s,) for s in (fill.clamped or [[]])[0]], "source string")


def plan_rows(sizes: DataFrame) -> list[tuple[str, float, int, int]]:
    """The plan's input on the driver: one row a source, at most ``MOST_SOURCES``."""
    rows = sizes.limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError("too many sources for a mix")
    return [(r["source"], r["target_share"], r["max_repeats"], r["tokens"]) for r in rows]


def sample(counted: DataFrame, repeats: dict[str, float], key: str = "doc_id", source: str = "source", seed: int = 0) -> DataFrame:
    """``counted`` with ``times``: how often each document occurs in the mix; rows of 0 drop out.

    Every document of a source occurs the whole part of its repetitions. For the fraction, documents come in the
    order of a seeded hash of their key until the source's tokens are reached, to half a document, so that reruns and
    other partitionings agree. Sums run over ``BUCKETS`` ranges of the hash, so no source is sorted as a whole.
    """
    spark = counted.sparkSession
    plan = spark.createDataFrame(list(repeats.items()) or [("", 0.0)], "s string, r double")
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 52)).cast("double") / float(1 << 52)
    rows = counted.withColumn("s", source_name(F.col(source))).join(F.broadcast(plan), "s").withColumn("_u", u).withColumn("_b", F.floor(u * BUCKETS).cast("int"))
    sums = rows.groupBy("s", "_b").agg(F.sum("n_tokens").alias("_own"))
    over = Window.partitionBy("s")
    before = F.coalesce(F.sum("_own").over(over.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("s").alias("_s"), F.col("_b").alias("_c"), before.alias("_before"), F.sum("_own").over(over).alias("_all"))
    rows = rows.join(sums, (F.col("s") == F.col("_s")) & (F.col("_b") == F.col("_c")))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("s", "_b").orderBy("_u", key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # documents of one key are told apart by nothing, so they may stand in any order
    more = F.col("_before") + inside + F.col("n_tokens") / 2.0 <= (F.col("r") - F.floor("r")) * F.col("_all")
    times = (F.floor("r") + (more & (F.col("r") > F.floor("r"))).cast("long")).cast("long")
    return rows.withColumn("times", times).where("times > 0").drop("r", "_u", "_b", "_s", "_c", "_before", "_all")


def report(mix: DataFrame, sizes: DataFrame, fill: Fill) -> DataFrame:
    """(source, target_share, docs, tokens, used_tokens, actual_share, repeats, falls_short)."""
    used = mix.groupBy(F.col("s").alias("source")).agg(F.sum(F.col("n_tokens") * F.col("times")).alias("used_tokens"))
    total = F.lit(used.agg(F.sum("used_tokens")).first()[0] or 0)
    rows = sizes.join(used, "source", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0).cast("long")))
    short = short_sources(mix.sparkSession, fill).withColumn("falls_short", F.lit(True))
    rows = rows.join(short, "source", "left")
    return rows.select(
        "source", "target_share", "docs", "tokens", "used_tokens", F.try_divide(F.col("used_tokens"), total).alias("actual_share"), F.try_divide("used_tokens", "tokens").alias("repeats"), F.coalesce("falls_short", F.lit(False)).alias("falls_short")
    )
