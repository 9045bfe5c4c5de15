"""Queries over catalogs: identity, merging, change detection, history, matching and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import norm
from ..operators import catalog as ct
from ..operators import stats
from ..sources.tables import table

_ID_SQL = """coalesce(CASE WHEN lower(trim({s})) <> '' THEN concat('sha:', lower(trim({s}))) END, CASE WHEN {p} <> 0 THEN concat('id:', {p}) END,
  CASE WHEN lower(trim({l})) <> '' THEN concat('path:', lower(trim({l}))) END, concat('row:', {r}))"""


def _identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "catalog_entry")
    return c.withColumn("identity", ct.canonical_identity(F.col("fingerprint.sha256"), F.col("pixabay_id"), F.col("local_path"), F.col("entry_id")))


def canonical_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: entries by identity."""
    return _identified(spark, sf_dir).groupBy("identity").agg(F.count("*").alias("n"), F.min("entry_id").alias("first_id"))


def exact_dedup_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best entry of each identity by score, then id."""
    c = _identified(spark, sf_dir).select("identity", "entry_id", "author", norm.scaled(F.col("quality.overall_score")).alias("score"))
    return ct.keep_best(c, ["identity"], [-F.coalesce("score", F.lit(-1).cast("long")), F.col("entry_id")], ["entry_id", "author", "score"])


def merge_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated hits of one provider id: their queries, first batch and best score."""
    c = table(spark, sf_dir, "candidate_batch").where("pixabay_id <> 0")
    return c.groupBy("pixabay_id").agg(
        F.concat_ws(", ", F.array_sort(F.collect_set("search_query"))).alias("queries"), F.min("batch_no").alias("first_batch"), F.coalesce(F.max(norm.scaled(F.col("pre_score"))), F.lit(-1).cast("long")).alias("score"), F.count("*").alias("hits")
    )


def catalog_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog and candidates merged on the provider id, catalog columns first."""
    a = table(spark, sf_dir, "catalog_entry").where("pixabay_id <> 0").select("pixabay_id", "author", "tags", F.col("quality.scene_category").alias("scene"))
    b = table(spark, sf_dir, "candidate_batch").where("pixabay_id <> 0").select("pixabay_id", "author", "tags", F.lit(None).cast("string").alias("scene"))
    return ct.coalesce_merge([a, b], "pixabay_id", ["author", "tags", "scene"])


def fallback_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates to catalog entries by provider id, else by digest."""
    c = table(spark, sf_dir, "candidate_batch").select("candidate_id", F.when(F.col("pixabay_id") != 0, F.col("pixabay_id")).alias("pid"), norm.first_nonempty(F.lower("fingerprint.sha256")).alias("sha"))
    e = table(spark, sf_dir, "catalog_entry").select("entry_id", F.when(F.col("pixabay_id") != 0, F.col("pixabay_id")).alias("rpid"), norm.first_nonempty(F.lower("fingerprint.sha256")).alias("rsha"))
    return ct.match_with_fallback(c, e, "candidate_id", [("pid", "rpid"), ("sha", "rsha")], "entry_id").where("tier is not null")


def excluded_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries never used, of authors that candidates name."""
    c = table(spark, sf_dir, "catalog_entry").select("entry_id", "author")
    used = table(spark, sf_dir, "usage_interval").select(F.col("asset_id").alias("entry_id")).where("entry_id is not null").distinct()
    named = table(spark, sf_dir, "candidate_batch").select("author").where("author is not null").distinct()
    return c.join(used, "entry_id", "left_anti").join(named, "author", "left_semi").select("entry_id")


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "catalog_entry").select("entry_id", F.coalesce("local_path", F.concat(F.lit("x/"), F.col("entry_id").cast("string"))).alias("p"), norm.first_nonempty(F.lower("fingerprint.sha256")).alias("s"))
    c = c.select("entry_id", F.concat("p", F.lit("#"), F.col("entry_id").cast("string")).alias("path"), F.coalesce("s", F.concat(F.lit("none-"), F.col("entry_id").cast("string"))).alias("digest"))
    before = c.where("entry_id % 7 <> 0").select("path", "digest")
    moved = F.when(F.col("entry_id") % 5 == 0, F.concat(F.lit("new/"), "path")).otherwise(F.col("path"))
    now = c.where("entry_id % 11 <> 0").select(moved.alias("path"), F.when(F.col("entry_id") % 13 == 0, F.concat("digest", F.lit("-edited"))).otherwise(F.col("digest")).alias("digest"))
    return before, now


def catalog_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes between two snapshots of the library that differ by a rule."""
    return ct.library_changes(*_snapshots(spark, sf_dir)).groupBy("action").agg(F.count("*").alias("n"), F.min("path").alias("first_path"), F.max("old_path").alias("last_source"))


def deleted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the earlier snapshot that are gone."""
    before, now = _snapshots(spark, sf_dir)
    return before.join(now, "path", "left_anti").select("path")


def identity_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths whose digests differ between two snapshots."""
    before, now = _snapshots(spark, sf_dir)
    return ct.differences(before, now, ["path"], "digest")


def history_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of each asset, repeated rows once, with runs and total."""
    u = table(spark, sf_dir, "usage_interval").where("usage_id is not null and asset_id is not null").groupBy("usage_id").agg(F.min("asset_id").alias("asset_id"), F.min("run_id").alias("run_id"))
    return u.groupBy("asset_id").agg(F.count("*").alias("uses"), F.count_distinct("run_id").alias("runs"))


def usage_commit_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Committing all runs twice leaves one event a run."""
    u = table(spark, sf_dir, "usage_interval").where("run_id is not null")
    ev = ct.usage_events(u, "run_id", ["usage_id", "asset_id"])
    once = ct.commit_once(ev.where("n % 2 = 0"), ev, "event_id")
    return ct.commit_once(once, ev, "event_id").select("run_id", "n")


def cut_pairs_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders paired by customer: the largest price in thousandths for two states."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", norm.scaled(F.col("o_totalprice")).alias("price"))
    p = ct.pivot_pairs(o.where("o_orderstatus in ('O', 'F')"), "o_custkey", "o_orderstatus", "price", ["F", "O"])
    return p.select("o_custkey", F.coalesce("F", F.lit(0).cast("long")).alias("before"), F.coalesce("O", F.lit(0).cast("long")).alias("after"))


def best_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3, F1: of each provider id the entry that is large enough, else any, by area, size and id."""
    c = table(spark, sf_dir, "catalog_entry").where("pixabay_id <> 0")
    w, h = F.col("fingerprint.width"), F.col("fingerprint.height")
    c = c.select("pixabay_id", "entry_id", (F.greatest(w, h) >= 1280).cast("int").alias("ok"), (w.cast("long") * h).alias("area"), F.col("fingerprint.size_bytes").alias("bytes"))
    c = c.na.fill(0, ["ok", "area", "bytes"])
    return ct.keep_best(c, ["pixabay_id"], [-F.col("ok"), -F.col("area"), -F.col("bytes"), F.col("entry_id")], ["entry_id", "area"])


def channel_cap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8, K2: at most three entries an author, by score."""
    c = table(spark, sf_dir, "catalog_entry").where("author is not null").select("author", "entry_id", F.coalesce(norm.scaled(F.col("quality.overall_score")), F.lit(-1).cast("long")).alias("score"))
    return ct.top_within(c, ["author"], [F.desc("score"), F.asc("entry_id")], 3)


def scene_first_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: the best entry of each scene gets a bonus of 55 thousandths; the 100 best of that order."""
    c = table(spark, sf_dir, "catalog_entry").select("entry_id", F.coalesce(F.col("quality.scene_category"), F.lit("-")).alias("scene"), F.coalesce(norm.scaled(F.col("quality.overall_score")), F.lit(-1).cast("long")).alias("score"))
    first = ct.keep_best(c, ["scene"], [-F.col("score"), F.col("entry_id")], ["entry_id"]).select("entry_id", F.lit(55).alias("bonus"))
    c = c.join(first, "entry_id", "left").withColumn("adjusted", F.col("score") + F.coalesce("bonus", F.lit(0)))
    return c.orderBy(F.desc("adjusted"), F.desc("score"), F.asc("entry_id")).limit(100).select("entry_id", "scene", "adjusted")


def alignment_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: shares of the recorded alignments."""
    return stats.distribution(table(spark, sf_dir, "cut_record").select(norm.label(F.col("primary_alignment")).alias("alignment")), "alignment")


def avg_distribution_renorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: mean over the tracks of their distributions of sound types."""
    from .views import sounds

    return stats.average_distribution(sounds(spark, sf_dir), "type", "track")


def dominant_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: the commonest scene of each author."""
    c = table(spark, sf_dir, "catalog_entry").where("author is not null").select("author", norm.label(F.col("quality.scene_category")).alias("scene"))
    return stats.dominant(c, "scene", ["author"])


def category_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes of each author by mean score, then votes."""
    c = table(spark, sf_dir, "catalog_entry").where("author is not null").select("author", norm.label(F.col("quality.scene_category")).alias("scene"), F.coalesce(norm.scaled(F.col("quality.overall_score")), F.lit(0).cast("long")).alias("s"))
    return stats.votes(c, ["author"], "scene", F.col("s"))


def source_usage_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screen time of each asset within its run and its share."""
    ok = "source_start is not null and source_end is not null and not isnan(source_start) and not isnan(source_end) and abs(source_start) < 1e9 and abs(source_end) < 1e9 and source_end > source_start"
    u = table(spark, sf_dir, "usage_interval").where(ok + " and run_id is not null and asset_id is not null")
    u = u.select("usage_id", "run_id", "asset_id", (norm.scaled(F.col("source_end")) - norm.scaled(F.col("source_start"))).alias("ms")).distinct()
    t = u.groupBy("run_id", "asset_id").agg(F.sum("ms").alias("ms"), F.count("*").alias("n"))
    total = t.groupBy("run_id").agg(F.sum("ms").alias("all"))
    return t.join(total, "run_id").select("run_id", "asset_id", "n", "ms", norm.rounded(F.try_divide("ms", "all")).alias("share"))


def feature_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entries have each feature; missing is not zero."""
    c = table(spark, sf_dir, "catalog_entry")
    feats = {"digest": norm.first_nonempty(F.col("fingerprint.sha256")), "hashes": F.when(F.size("fingerprint.perceptual_hashes") > 0, 1), "duration": F.when(F.col("fingerprint.duration_seconds") > 0, 1), "provider": F.when(F.col("pixabay_id") != 0, 1), "segments": F.when(F.size("quality.usable_segments") > 0, 1)}
    agg = c.agg(F.count("*").alias("n"), *[F.count(x).alias(k) for k, x in feats.items()])
    return agg.select("n", F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(k).alias("have")) for k in feats])).alias("f")).select("f.feature", "f.have", norm.rounded(F.try_divide(F.col("f.have"), F.col("n"))).alias("coverage"))


def usable_windows_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable segments of each entry; entries without one keep one row over the whole clip."""
    c = table(spark, sf_dir, "catalog_entry").select("entry_id", F.col("fingerprint.duration_seconds").alias("d"), F.explode_outer("quality.usable_segments").alias("g"))
    ok = norm.finite(F.col("g.end")) - norm.finite(F.col("g.start")) >= 0.28
    c = c.select("entry_id", "d", F.when(ok, norm.scaled(F.col("g.start"))).alias("s"), F.when(ok, norm.scaled(F.col("g.end"))).alias("e"))
    return c.groupBy("entry_id").agg(F.count("s").alias("segments"), F.coalesce(F.min("s"), F.lit(0).cast("long")).alias("start_ms"), F.coalesce(F.max("e"), F.max(norm.scaled(norm.finite(F.col("d")))), F.lit(0).cast("long")).alias("end_ms"))


QUERIES = {f.__name__: f for f in (
    canonical_identity, exact_dedup_best, merge_hits, catalog_coalesce, fallback_match, excluded_entries, catalog_sync, deleted_paths, identity_diff, history_merge, usage_commit_idempotent, cut_pairs_pivot,
    best_variant, channel_cap_topk, scene_first_bonus, alignment_distribution, avg_distribution_renorm, dominant_label, category_votes, source_usage_shares, feature_coverage, usable_windows_outer,
)}

_I = _ID_SQL.format(s="fingerprint.sha256", p="pixabay_id", l="local_path", r="entry_id")
_R4 = "floor(({0}) * 10000.0 + 0.5) / 10000.0"
_SCORE = "CAST(floor(quality.overall_score * 1000.0 + 0.5) AS BIGINT)"
_SHA = "CASE WHEN trim(lower(fingerprint.sha256)) <> '' THEN lower(fingerprint.sha256) END"
_SCENE = "CASE WHEN lower(trim(quality.scene_category)) NOT IN ('', 'unknown', 'unresolved', 'general', 'none', 'n/a') THEN lower(trim(quality.scene_category)) END"
_SNAP = f"""c AS (SELECT entry_id, concat(coalesce(local_path, concat('x/', entry_id)), '#', entry_id) AS path, coalesce({_SHA}, concat('none-', entry_id)) AS digest FROM catalog_entry),
  b AS (SELECT path, digest FROM c WHERE entry_id % 7 <> 0),
  n AS (SELECT CASE WHEN entry_id % 5 = 0 THEN concat('new/', path) ELSE path END AS path, CASE WHEN entry_id % 13 = 0 THEN concat(digest, '-edited') ELSE digest END AS digest FROM c WHERE entry_id % 11 <> 0)"""
from .views import SOUNDS  # noqa: E402

SQL = {
    "canonical_identity": f"SELECT {_I} AS identity, count(*) AS n, min(entry_id) AS first_id FROM catalog_entry GROUP BY 1",
    "exact_dedup_best": f"""WITH r AS (SELECT {_I} AS identity, entry_id, author, {_SCORE} AS score FROM catalog_entry),
      o AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY coalesce(score, -1) DESC, entry_id) AS k FROM r) SELECT identity, entry_id, author, score FROM o WHERE k = 1""",
    "merge_hits": """SELECT pixabay_id, coalesce(string_agg(DISTINCT search_query, ', ' ORDER BY search_query), '') AS queries, min(batch_no) AS first_batch,
      coalesce(max(CAST(floor(pre_score * 1000.0 + 0.5) AS BIGINT)), -1) AS score, count(*) AS hits FROM candidate_batch WHERE pixabay_id <> 0 GROUP BY 1""",
    "catalog_coalesce": """WITH r AS (SELECT pixabay_id, author, tags, quality.scene_category AS scene, 0 AS k FROM catalog_entry WHERE pixabay_id <> 0 UNION ALL SELECT pixabay_id, author, tags, NULL, 1 FROM candidate_batch WHERE pixabay_id <> 0)
      SELECT pixabay_id, coalesce(min(author) FILTER (k = 0), min(author) FILTER (k = 1)) AS author, coalesce(min(tags) FILTER (k = 0), min(tags) FILTER (k = 1)) AS tags, min(scene) AS scene, count(*) AS merged FROM r GROUP BY 1""",
    "fallback_match": f"""WITH e AS (SELECT entry_id, CASE WHEN pixabay_id <> 0 THEN pixabay_id END AS p, {_SHA} AS s FROM catalog_entry),
      bp AS (SELECT p, min(entry_id) AS e FROM e WHERE p IS NOT NULL GROUP BY p), bs AS (SELECT s, min(entry_id) AS e FROM e WHERE s IS NOT NULL GROUP BY s),
      c AS (SELECT candidate_id, CASE WHEN pixabay_id <> 0 THEN pixabay_id END AS p, {_SHA} AS s FROM candidate_batch)
      SELECT candidate_id, coalesce(bp.e, bs.e) AS entry_id, CASE WHEN bp.e IS NOT NULL THEN 1 WHEN bs.e IS NOT NULL THEN 2 END::INT AS tier FROM c LEFT JOIN bp ON c.p = bp.p LEFT JOIN bs ON c.s = bs.s WHERE bp.e IS NOT NULL OR bs.e IS NOT NULL""",
    "excluded_entries": """SELECT entry_id FROM catalog_entry c WHERE NOT EXISTS (SELECT 1 FROM usage_interval u WHERE u.asset_id = c.entry_id) AND author IN (SELECT author FROM candidate_batch WHERE author IS NOT NULL)""",
    "catalog_sync": f"""WITH {_SNAP}, j AS (SELECT coalesce(n.path, b.path) AS path, n.digest AS nd, b.digest AS bd, n.path AS np, b.path AS bp FROM n FULL JOIN b ON n.path = b.path),
      m AS (SELECT b.digest, min(CASE WHEN n.path IS NULL THEN b.path END) AS src, count(n.path) AS kept FROM b LEFT JOIN n ON b.path = n.path GROUP BY 1),
      a AS (SELECT j.path, CASE WHEN src IS NULL THEN 'added' ELSE 'moved' END AS action, src AS old_path FROM j LEFT JOIN m ON m.digest = nd AND kept = 0 WHERE bp IS NULL),
      r AS (SELECT path, CASE WHEN nd = bd THEN 'reused' ELSE 'changed' END AS action, NULL AS old_path FROM j WHERE np IS NOT NULL AND bp IS NOT NULL
        UNION ALL SELECT * FROM a UNION ALL SELECT path, 'deleted', NULL FROM j WHERE np IS NULL AND path NOT IN (SELECT old_path FROM a WHERE old_path IS NOT NULL))
      SELECT action, count(*) AS n, min(path) AS first_path, max(old_path) AS last_source FROM r GROUP BY 1""",
    "deleted_paths": f"WITH {_SNAP} SELECT path FROM b WHERE path NOT IN (SELECT path FROM n)",
    "identity_diff": f"""WITH {_SNAP} SELECT coalesce(b.path, n.path) AS path, b.digest AS expected, n.digest AS actual FROM b FULL JOIN n ON b.path = n.path WHERE b.digest IS DISTINCT FROM n.digest""",
    "history_merge": """SELECT asset_id, count(*) AS uses, count(DISTINCT run_id) AS runs FROM (SELECT usage_id, min(asset_id) AS asset_id, min(run_id) AS run_id FROM usage_interval WHERE usage_id IS NOT NULL AND asset_id IS NOT NULL GROUP BY 1) GROUP BY 1""",
    "usage_commit_idempotent": "SELECT run_id, count(*) AS n FROM (SELECT DISTINCT run_id, usage_id, asset_id FROM usage_interval WHERE run_id IS NOT NULL) GROUP BY 1",
    "cut_pairs_pivot": """SELECT o_custkey, coalesce(max(CAST(floor(o_totalprice * 1000.0 + 0.5) AS BIGINT)) FILTER (o_orderstatus = 'F'), 0) AS before, coalesce(max(CAST(floor(o_totalprice * 1000.0 + 0.5) AS BIGINT)) FILTER (o_orderstatus = 'O'), 0) AS after
      FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY 1""",
    "best_variant": """WITH r AS (SELECT pixabay_id, entry_id, coalesce(CASE WHEN greatest(fingerprint.width, fingerprint.height) >= 1280 THEN 1 ELSE 0 END, 0) AS ok, coalesce(fingerprint.width::BIGINT * fingerprint.height, 0) AS area, coalesce(fingerprint.size_bytes, 0) AS bytes
        FROM catalog_entry WHERE pixabay_id <> 0) SELECT pixabay_id, entry_id, area FROM (SELECT *, row_number() OVER (PARTITION BY pixabay_id ORDER BY ok DESC, area DESC, bytes DESC, entry_id) AS k FROM r) WHERE k = 1""",
    "channel_cap_topk": f"""WITH r AS (SELECT author, entry_id, coalesce({_SCORE}, -1) AS score FROM catalog_entry WHERE author IS NOT NULL)
      SELECT * FROM (SELECT author, entry_id, score, row_number() OVER (PARTITION BY author ORDER BY score DESC, entry_id) AS rank FROM r) WHERE rank <= 3""",
    "scene_first_bonus": f"""WITH r AS (SELECT entry_id, coalesce(quality.scene_category, '-') AS scene, coalesce({_SCORE}, -1) AS score FROM catalog_entry),
      a AS (SELECT entry_id, scene, score, score + CASE WHEN row_number() OVER (PARTITION BY scene ORDER BY score DESC, entry_id) = 1 THEN 55 ELSE 0 END AS adjusted FROM r)
      SELECT entry_id, scene, adjusted FROM a ORDER BY adjusted DESC, score DESC, entry_id LIMIT 100""",
    "alignment_distribution": f"""WITH r AS (SELECT {_SCENE.replace("quality.scene_category", "primary_alignment")} AS alignment FROM cut_record) SELECT alignment, count(*) AS n, {_R4.format("count(*) / sum(count(*)) OVER ()")} AS share FROM r WHERE alignment IS NOT NULL GROUP BY 1""",
    "avg_distribution_renorm": f"""WITH n AS (SELECT track, type, count(*) AS n FROM {SOUNDS} WHERE type <> '' GROUP BY 1, 2),
      s AS (SELECT track, type, floor(n / sum(n) OVER (PARTITION BY track) * 1000000000.0 + 0.5) / 1000000000.0 AS share FROM n), t AS (SELECT type, sum(CAST(floor(share * 1e9 + 0.5) AS BIGINT)) AS s FROM s GROUP BY 1)
      SELECT type, {_R4.format("s / sum(s) OVER ()")} AS share FROM t""",
    "dominant_label": f"""WITH n AS (SELECT author, {_SCENE} AS scene, count(*) AS n FROM catalog_entry WHERE author IS NOT NULL GROUP BY 1, 2)
      SELECT author, scene, n FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY n DESC, scene DESC) AS k FROM n WHERE scene IS NOT NULL) WHERE k = 1""",
    "category_votes": f"""WITH n AS (SELECT author, {_SCENE} AS scene, count(*) AS votes, sum(coalesce({_SCORE}, 0)) AS c FROM catalog_entry WHERE author IS NOT NULL GROUP BY 1, 2),
      m AS (SELECT author, scene, votes, {_R4.format("c / votes / 1000.0")} AS mean FROM n WHERE scene IS NOT NULL)
      SELECT author, scene, votes, mean, row_number() OVER (PARTITION BY author ORDER BY mean DESC, votes DESC, scene) AS rank FROM m""",
    "source_usage_shares": f"""WITH u AS (SELECT DISTINCT usage_id, run_id, asset_id, CAST(floor(source_end * 1000.0 + 0.5) AS BIGINT) - CAST(floor(source_start * 1000.0 + 0.5) AS BIGINT) AS ms FROM usage_interval
        WHERE isfinite(source_start) AND isfinite(source_end) AND abs(source_start) < 1e9 AND abs(source_end) < 1e9 AND source_end > source_start AND run_id IS NOT NULL AND asset_id IS NOT NULL),
      t AS (SELECT run_id, asset_id, CAST(sum(ms) AS BIGINT) AS ms, count(*) AS n FROM u GROUP BY 1, 2) SELECT run_id, asset_id, n, ms, {_R4.format("ms / nullif(sum(ms) OVER (PARTITION BY run_id), 0)")} AS share FROM t""",
    "feature_coverage": f"""WITH f AS (SELECT count(*) AS n, count(CASE WHEN trim(fingerprint.sha256) <> '' THEN 1 END) AS digest, count(CASE WHEN len(fingerprint.perceptual_hashes) > 0 THEN 1 END) AS hashes,
        count(CASE WHEN fingerprint.duration_seconds > 0 THEN 1 END) AS duration, count(CASE WHEN pixabay_id <> 0 THEN 1 END) AS provider, count(CASE WHEN len(quality.usable_segments) > 0 THEN 1 END) AS segments FROM catalog_entry),
      u AS (UNPIVOT f ON digest, hashes, duration, provider, segments INTO NAME feature VALUE have) SELECT feature, have, {_R4.format("have / nullif(n, 0)")} AS coverage FROM u""",
    "usable_windows_outer": """WITH g AS (SELECT entry_id, fingerprint.duration_seconds AS d, unnest(CASE WHEN len(quality.usable_segments) > 0 THEN quality.usable_segments ELSE [NULL] END) AS g FROM catalog_entry),
      s AS (SELECT entry_id, d, CASE WHEN isfinite(g."end") AND isfinite(g."start") AND g."end" - g."start" >= 0.28 THEN CAST(floor(g."start" * 1000.0 + 0.5) AS BIGINT) END AS s, CASE WHEN isfinite(g."end") AND isfinite(g."start") AND g."end" - g."start" >= 0.28 THEN CAST(floor(g."end" * 1000.0 + 0.5) AS BIGINT) END AS e FROM g)
      SELECT entry_id, count(s) AS segments, coalesce(min(s), 0) AS start_ms, coalesce(max(e), max(CASE WHEN isfinite(d) THEN CAST(floor(d * 1000.0 + 0.5) AS BIGINT) END), 0) AS end_ms FROM s GROUP BY 1""",
}
