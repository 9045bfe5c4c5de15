"""Views of the driver's tables as the engine's entities, for queries and for their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.norm import label, scaled
from ..sources.tables import table

#: Length of a slice of an entity's time line: a day of microseconds, ten minutes of ms, ...
DAY_US = 86_400_000_000
TEN_MIN_MS = 600_000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, track, us, type, m): the event stream; m is the value in thousandths."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("track"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_type").alias("type"), scaled(F.col("value")).alias("m"))


def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, track, ms, energy, band, role): cuts with a track and a finite time, each once."""
    c = table(spark, sf_dir, "cut_record").where("track_key is not null and time_seconds is not null and not isnan(time_seconds)")
    c = c.groupBy("cut_id").agg(*[F.min(x).alias(x) for x in ("track_key", "time_seconds", "energy", "energy_band", "section_role")])
    return c.select(F.col("cut_id").alias("id"), F.col("track_key").alias("track"), scaled(F.col("time_seconds")).alias("ms"), scaled(F.col("energy")).alias("energy"), label(F.col("energy_band")).alias("band"), label(F.col("section_role")).alias("role"))


def sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, track, ms, type, strength, origin): music events with a track and a finite time, each once."""
    e = table(spark, sf_dir, "music_event").where("track_key is not null and time_seconds is not null and not isnan(time_seconds)")
    e = e.groupBy("event_id").agg(*[F.min(x).alias(x) for x in ("track_key", "time_seconds", "event_type", "strength", "origin")])
    return e.select(F.col("event_id").alias("id"), F.col("track_key").alias("track"), scaled(F.col("time_seconds")).alias("ms"), F.col("event_type").alias("type"), F.when(~F.isnan("strength"), scaled(F.col("strength"))).alias("strength"), "origin")


EVENTS = "(SELECT event_id AS id, user_id AS track, epoch_us(ts) AS us, event_type AS type, CAST(floor(value * 1000.0 + 0.5) AS BIGINT) AS m FROM events)"
_LABEL = "CASE WHEN lower(trim({0})) NOT IN ('', 'unknown', 'unresolved', 'general', 'none', 'n/a') THEN lower(trim({0})) END"
CUTS = f"""(SELECT cut_id AS id, any_value(track_key) AS track, CAST(floor(min(time_seconds) * 1000.0 + 0.5) AS BIGINT) AS ms,
  CAST(floor(min(energy) * 1000.0 + 0.5) AS BIGINT) AS energy, {_LABEL.format("min(energy_band)")} AS band, {_LABEL.format("min(section_role)")} AS role
  FROM cut_record WHERE track_key IS NOT NULL AND time_seconds IS NOT NULL AND NOT isnan(time_seconds) GROUP BY cut_id)"""
SOUNDS = """(SELECT event_id AS id, any_value(track_key) AS track, CAST(floor(min(time_seconds) * 1000.0 + 0.5) AS BIGINT) AS ms, min(event_type) AS type,
  CASE WHEN NOT isnan(min(strength)) THEN CAST(floor(min(strength) * 1000.0 + 0.5) AS BIGINT) END AS strength, min(origin) AS origin
  FROM music_event WHERE track_key IS NOT NULL AND time_seconds IS NOT NULL AND NOT isnan(time_seconds) GROUP BY event_id)"""
