"""Queries of the general problems, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, intervals, nested
from ..session import spread
from ..sources.tables import table

LIST_KEYS = ("videos", "pace_over_time", "key_shot_positions", "slots")


def p4_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All groups pivoted: every object that is a member of a list, with its group, parent and fields."""
    return nested.group_rows(spread(table(spark, sf_dir, "artifact_doc").select("artifact_id", "payload")), list_keys=LIST_KEYS)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object that is a member of a list in a payload, with its parent: the rows of all groups."""
    return p4_rows(spark, sf_dir).select("artifact_id", F.col("row_path").alias("path"), "parent_path")


def p4_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of timeline slots, in whatever envelope they come."""
    fields = ["index", "start", "end", "section_role", "energy", "is_emphasis", "transition", "recommended_content", "anchor_event.type", "anchor_event.time", "anchor_event.strength"]
    return nested.key_table(p4_rows(spark, sf_dir), "slots", fields)


def p4_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of reference videos with what was learned of their editing style."""
    style = ["shot_duration_distribution_seconds.mean", "shot_duration_distribution_seconds.p90", "adjacent_change_ratios.subject", "adjacent_change_ratios.scene", "adjacent_change_ratios.shot_scale", "unsupported_effects"]
    fields = ["relative_path", "duration_seconds", "editing_rhythm.classification", "editing_rhythm.detected_cuts", *[f"editing_style_learning.{f}" for f in style]]
    return nested.key_table(p4_rows(spark, sf_dir), "videos", fields)


def p4_pace_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of the phases of a video's pace."""
    return nested.key_table(p4_rows(spark, sf_dir), "pace_over_time", ["phase", "start_seconds", "end_seconds", "shot_count", "cuts_per_minute", "visual_motion_intensity"])


def p4_key_shot_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of a video's key shots."""
    return nested.key_table(p4_rows(spark, sf_dir), "key_shot_positions", ["shot_index", "time_seconds", "normalized_position", "score", "scene", "shot_scale", "tags"])


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated groups and fields found in the payloads."""
    return nested.repeated_groups(nested.path_triples(table(spark, sf_dir, "artifact_doc"), list_keys=LIST_KEYS))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every schema change of a file against the file before it in its stream."""
    return drift.schema_changes(spread(table(spark, sf_dir, "index_file").select("file_id", "stream_id", "written_at", "content")))


def p5_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file and field: the JSON types of its values and the records that have it."""
    return drift.path_statistics(drift.path_values(spread(table(spark, sf_dir, "index_file").select("file_id", "content"))))


def _columns() -> list[tuple[str, list[str], str]]:
    """Columns of the consistent table, with the names that are known beforehand."""
    e, v = "entries[].", "videos[]."
    parts = {
        "string": {
            "": ["schema_version", "library_root", "generator", "profile_name", "overall_label", "selection_signature", "cache_schema_version"],
            e: ["relative_path", "content_digest", "scene_category", "shot_type", "tags", "ratio", "metadata_schema_version"],
            v: ["relative_path", "transition_method", "classification", "orientation", "fastest_phase", "limitation"],
        },
        "bigint": {"": ["entry_count", "video_total", "updated_at"], e: ["size_bytes", "mtime_ns", "historical_usage_count"]},
        "double": {
            e: ["duration_seconds", "motion_score", "fps", "face_content_risk"],
            v: ["duration_seconds", "cuts_per_minute", "motion_strength", "p90_shot_seconds", "text_overlay_ratio"],
        },
        "object": {"": ["analyzer", "sync"], e: ["quality", "analysis_cache", "mean_hsv"], v: ["color_profile", "subject_profile"]},
        "list": {e: ["usable_segments", "semantic_tags"], v: ["key_shot_positions", "semantic_labels"]},
    }
    known = {"duration_seconds": ["entries[].duration"], "scene_category": ["entries[].environment"]}
    found: dict[tuple[str, str], list[str]] = {}
    for kind, by_part in parts.items():
        for part, names in by_part.items():
            for name in names:
                found.setdefault((name, kind), []).append(part + name)
    return [(name, paths + known.get(name, []), kind) for (name, kind), paths in found.items()]


def p5_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, library entries and profile videos as one typed table with the casts that failed.

    A row per file (record empty) and per member of its lists of records. Renamed fields come under
    the column that the renames between files lead to; fields without a column under ``other_fields``.
    """
    renamed = p5_found(spark, sf_dir).where("change = 'renamed'").groupBy("old_name", "new_name").agg(F.count("*").alias("n"))
    # field names are metadata: one row a pair of names
    columns = drift.with_aliases(_columns(), sorted(tuple(r) for r in renamed.collect()))
    # what lies deeper is in its field's text
    own = drift.path_values(spread(table(spark, sf_dir, "index_file").select("file_id", "content")), texts=True, nested=False)
    return drift.consistent_table(own, columns, others="other_fields")


def _all_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = intervals.whole_ms
    used = table(spark, sf_dir, "usage_interval").select(
        F.lit("source_intervals").alias("origin"), "run_id", "asset_id", ms(F.col("source_start")).alias("start_ms"), ms(F.col("source_end")).alias("end_ms")
    )
    cat = table(spark, sf_dir, "catalog_entry").select("entry_id", F.explode("quality.usable_segments").alias("g"))
    usable = cat.select(
        F.lit("usable_segments").alias("origin"), F.lit("").alias("run_id"), F.col("entry_id").alias("asset_id"), ms(F.col("g.start")).alias("start_ms"), ms(F.col("g.end")).alias("end_ms")
    )
    return used.unionByName(usable)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous periods and gaps of both interval tables."""
    return intervals.periods_and_gaps(_all_intervals(spark, sf_dir), ["origin", "run_id", "asset_id"])


QUERIES = {f.__name__: f for f in (p4_found, p4_rows, p4_slots, p4_videos, p4_pace_over_time, p4_key_shot_positions, p4_groups, p5_found, p5_statistics, p5_table, p6_found)}

_P6_SQL = """
WITH iv AS (
  SELECT 'source_intervals' AS origin, run_id, asset_id,
         CASE WHEN isfinite(source_start) THEN round(source_start * 1000.0, 0)::BIGINT END AS s,
         CASE WHEN isfinite(source_end) THEN round(source_end * 1000.0, 0)::BIGINT END AS e
  FROM usage_interval
  UNION ALL
  SELECT 'usable_segments', '', entry_id,
         CASE WHEN isfinite(g."start") THEN round(g."start" * 1000.0, 0)::BIGINT END,
         CASE WHEN isfinite(g."end") THEN round(g."end" * 1000.0, 0)::BIGINT END
  FROM (SELECT entry_id, unnest(quality.usable_segments) AS g FROM catalog_entry)
), ok AS (SELECT * FROM iv WHERE s IS NOT NULL AND e IS NOT NULL AND e > s),
m AS (SELECT *, max(e) OVER (PARTITION BY origin, run_id, asset_id ORDER BY s, e
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ok),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END)
        OVER (PARTITION BY origin, run_id, asset_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
p AS (SELECT origin, run_id, asset_id, min(s) AS start_ms, max(e) AS end_ms FROM g GROUP BY origin, run_id, asset_id, island),
n AS (SELECT *, lead(start_ms) OVER (PARTITION BY origin, run_id, asset_id ORDER BY start_ms) AS nxt FROM p)
SELECT origin, run_id, asset_id, 'period' AS kind, start_ms, end_ms FROM p
UNION ALL
SELECT origin, run_id, asset_id, 'gap', end_ms, nxt FROM n WHERE nxt IS NOT NULL
"""

SQL = {"p6_found": _P6_SQL}
