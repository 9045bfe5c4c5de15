"""Queries of the sequential programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.norm import scaled
from ..plans import programs
from ..sources.tables import table
from .views import SOUNDS, sounds


def slot_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1, K8: slots of every track from its sounds."""
    return programs.slot_walk(sounds(spark, sf_dir))


def diversified_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4, Q8: diversified order of each batch's candidates."""
    c = table(spark, sf_dir, "candidate_batch").where("batch_no is not null")
    c = c.select(F.col("batch_no").alias("task"), F.col("candidate_id").alias("id"), F.coalesce(scaled(F.col("pre_score")), F.lit(0).cast("long")).alias("score"), F.coalesce(F.element_at(F.split("tags", ", "), 1), F.lit("-")).alias("scene"), F.coalesce("author", F.lit("-")).alias("author"))
    return programs.diversified_order(c, "task")


def assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2, Q3: suppliers assigned to the parts of each order, in line order, under reuse rules."""
    li = table(spark, sf_dir, "lineitem")
    o = li.select(F.col("l_orderkey").alias("plan"), F.col("l_linenumber").cast("long").alias("slot"), F.col("l_suppkey").alias("source"), F.floor("l_quantity").cast("long").alias("score"))
    return programs.assign(o)


def evidence_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to look at in each project, pinned by title, then one of each language."""
    d = table(spark, sf_dir, "documents").where("project_key is not null")
    return programs.evidence(d.select(F.col("project_key").alias("group"), F.col("doc_id").alias("id"), F.coalesce(F.col("title").startswith("Pass"), F.lit(False)).alias("pinned"), F.lower("lang").alias("label")))


QUERIES = {f.__name__: f for f in (slot_plan, diversified_order, assignment, evidence_frames)}
SQL = {
    "slot_plan": f"""WITH RECURSIVE s AS (SELECT track, ms, max(coalesce(strength, 0)) AS strength FROM {SOUNDS} WHERE ms >= 0 GROUP BY 1, 2),
  t AS (SELECT track, max(ms) AS last FROM s GROUP BY 1),
  w AS (SELECT track, -1::BIGINT AS slot, 0::BIGINT AS start_ms, 0::BIGINT AS end_ms, last FROM t
    UNION ALL SELECT track, slot + 1, cur, CASE WHEN last - coalesce(pick, cur + 2000) < 500 THEN last ELSE coalesce(pick, cur + 2000) END, last FROM (
      SELECT w.track, w.slot, w.end_ms AS cur, w.last, arg_min(s.ms, (abs(s.ms - w.end_ms - 2000) - s.strength * 80 // 1000) * 1000000 + s.ms - w.end_ms) AS pick
      FROM w LEFT JOIN s ON s.track = w.track AND s.ms >= w.end_ms + 800 AND s.ms <= w.end_ms + 4000 WHERE w.end_ms < w.last GROUP BY 1, 2, 3, 4))
  SELECT track, CAST(start_ms // 600000 AS BIGINT) AS "window", slot, start_ms, end_ms FROM w WHERE slot >= 0""",
    "assignment": """WITH RECURSIVE o AS (SELECT l_orderkey AS plan, CAST(l_linenumber AS BIGINT) AS slot, l_suppkey AS source, max(CAST(floor(l_quantity) AS BIGINT)) AS score FROM lineitem GROUP BY 1, 2, 3),
  p AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY slot) AS k FROM (SELECT plan, slot, list({'source': source, 'score': score} ORDER BY score DESC, source) AS opts FROM o GROUP BY 1, 2)),
  w AS (SELECT plan, 0::BIGINT AS k, 0::BIGINT AS slot, CAST([] AS STRUCT(source BIGINT, slot BIGINT)[]) AS used, CAST(NULL AS STRUCT(source BIGINT, score BIGINT)) AS pick, CAST(NULL AS VARCHAR) AS reason FROM p WHERE k = 1
    UNION ALL SELECT plan, k, slot, CASE WHEN pick IS NULL THEN used ELSE list_append(used, {'source': pick.source, 'slot': slot}) END, pick,
        CASE WHEN pick IS NULL THEN CASE WHEN len(list_filter(used, lambda u: u.source = opts[1].source)) >= 2 THEN 'max_reuse' ELSE 'repeat_gap' END END FROM (
      SELECT *, coalesce(list_filter(fit, lambda f: len(list_filter(used, lambda u: u.source = f.source)) = 0)[1], fit[1]) AS pick FROM (
        SELECT p.plan, p.k, p.slot, p.opts, w.used, list_filter(p.opts, lambda f: len(list_filter(w.used, lambda u: u.source = f.source)) < 2 AND len(list_filter(w.used, lambda u: u.source = f.source AND p.slot - u.slot <= 2)) = 0) AS fit
        FROM w JOIN p ON p.plan = w.plan AND p.k = w.k + 1)))
  SELECT plan, slot, pick.source AS source, pick.score AS score, reason FROM w WHERE k > 0""",
    "diversified_order": """WITH RECURSIVE c AS (SELECT batch_no AS task, candidate_id AS id, coalesce(CAST(floor(pre_score * 1000.0 + 0.5) AS BIGINT), 0) AS score, coalesce(split_part(tags, ', ', 1), '-') AS scene, coalesce(author, '-') AS author FROM candidate_batch WHERE batch_no IS NOT NULL),
  w AS (SELECT task, -1::BIGINT AS position, CAST(NULL AS STRUCT(g BIGINT, s BIGINT, i BIGINT, scene VARCHAR, author VARCHAR)) AS b, CAST([] AS STRUCT(g BIGINT, s BIGINT, i BIGINT, scene VARCHAR, author VARCHAR)[]) AS picked FROM c GROUP BY 1
    UNION ALL SELECT task, position + 1, b, list_append(picked, b) FROM (
      SELECT task, position, picked, max({'g': score + CASE n WHEN 0 THEN 120 WHEN 1 THEN 50 ELSE -60 * (n - 1) END - 25 * m, 's': score, 'i': -id, 'scene': scene, 'author': author}) AS b FROM (
        SELECT w.*, c.id, c.score, c.scene, c.author, len(list_filter(w.picked, lambda p: p.scene = c.scene)) AS n, len(list_filter(w.picked, lambda p: p.author = c.author)) AS m
        FROM w JOIN c ON c.task = w.task AND len(list_filter(w.picked, lambda p: p.i = -c.id)) = 0) GROUP BY 1, 2, 3))
  SELECT task, -b.i AS id, position, b.g AS adjusted FROM w WHERE position >= 0""",
    "evidence_frames": """WITH d AS (SELECT project_key, doc_id, coalesce(starts_with(title, 'Pass'), false) AS pinned, lower(lang) AS label FROM documents WHERE project_key IS NOT NULL),
      t AS (SELECT *, CASE WHEN pinned THEN 0 WHEN label IS NOT NULL AND row_number() OVER (PARTITION BY project_key, label ORDER BY doc_id) = 1 THEN 1 ELSE 2 END AS tier FROM d)
      SELECT "group", id, tier FROM (SELECT project_key AS "group", doc_id AS id, tier, row_number() OVER (PARTITION BY project_key ORDER BY tier, doc_id) AS r FROM t) WHERE r <= 24""",
}
