"""Further queries over curves, selections and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import norm
from ..operators import catalog as ct
from ..operators import neighbours as nb
from ..operators import sequence as sq
from ..operators import stats
from ..sources.tables import table
from .views import CUTS, DAY_US, EVENTS, SOUNDS, TEN_MIN_MS, cuts, events, sounds


def novelty_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance between the sums of the four values after and before each event; rows without full frames drop out."""
    e = sq.around(events(spark, sf_dir).where("m is not null"), "track", ["us", "id"], "m", 4, DAY_US).where("size(_before) = 4 and size(_after) = 4")
    e = e.select("track", F.abs(sq.total_of("_after") - sq.total_of("_before")).alias("novelty"))
    return e.groupBy("track").agg(F.max("novelty").alias("peak"), F.sum("novelty").alias("total"), F.count("*").alias("n"))


def range_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean strength of the sounds between each cut and the next."""
    c = nb.with_neighbour(cuts(spark, sf_dir), ["track"], "ms", ["ms", "id"], ["ms"], TEN_MIN_MS, "next", after=True)
    spans = c.where("next is not null").select("track", F.col("id").alias("cut"), F.col("ms").alias("lo"), F.col("next.ms").alias("hi"))
    j = nb.range_join(sounds(spark, sf_dir).where("strength is not null"), spans, ["track"], "ms", "lo", "hi", 10_000)
    return j.groupBy("cut").agg(F.count("*").alias("n"), norm.rounded(F.sum("strength") / F.count("*")).alias("mean"))


def meter_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per track the phase of a four-beat meter with the largest summed strength; of equals the smaller."""
    s = sounds(spark, sf_dir).where("strength is not null")
    s = nb.running_total(s, ["track"], "ms", ["ms", "id"], F.lit(1), TEN_MIN_MS, "n")
    g = s.groupBy("track", F.pmod(F.col("n"), F.lit(4)).cast("long").alias("phase")).agg(F.sum("strength").alias("s"))
    return g.groupBy("track").agg(F.max(F.struct("s", (-F.col("phase")).alias("p"))).alias("m")).select("track", (-F.col("m.p")).alias("phase"), F.col("m.s").alias("strength"))


def phrase_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth cut of a track."""
    c = nb.running_total(cuts(spark, sf_dir), ["track"], "ms", ["ms", "id"], F.lit(1), TEN_MIN_MS, "n")
    return c.where("n % 4 = 1").select("track", F.col("id").alias("cut_id"), "ms")


def strongest_sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64 strongest sounds of a track, by strength, then time."""
    s = sounds(spark, sf_dir).where("strength is not null").select("track", "id", "ms", "strength")
    return ct.top_within(s, ["track"], [F.desc("strength"), F.asc("ms"), F.asc("id")], 64)


def coverage_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five cuts of each track in the order of a digest, the same on every run."""
    c = cuts(spark, sf_dir).select("track", "id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    return ct.top_within(c, ["track"], [F.asc("h"), F.asc("id")], 5).select("track", "id", "rank")


def path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that are absolute, climb out, or are missing."""
    p = F.col("local_path")
    kind = F.when(p.isNull() | (F.trim(p) == ""), "missing").when(p.rlike(r"^(/|[A-Za-z]:)"), "absolute").when(p.rlike(r"(^|/)\.\.(/|$)"), "climbs").otherwise("safe")
    return table(spark, sf_dir, "catalog_entry").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts and strong sounds of a track zipped by position; how far they are apart."""
    c = nb.running_total(cuts(spark, sf_dir).select("track", "id", "ms"), ["track"], "ms", ["ms", "id"], F.lit(1), TEN_MIN_MS, "pos")
    s = nb.running_total(sounds(spark, sf_dir).where("strength >= 800").select("track", "id", "ms"), ["track"], "ms", ["ms", "id"], F.lit(1), TEN_MIN_MS, "pos")
    j = c.select("track", "pos", F.col("ms").alias("a")).join(s.select("track", "pos", F.col("ms").alias("b")), ["track", "pos"])
    return j.groupBy("track").agg(F.count("*").alias("n"), F.sum(F.abs(F.col("a") - F.col("b"))).alias("apart"))


def downsampled_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth sound of a track and each minute's strongest."""
    s = nb.running_total(sounds(spark, sf_dir).where("strength is not null"), ["track"], "ms", ["ms", "id"], F.lit(1), TEN_MIN_MS, "n")
    s = s.withColumn("minute", F.floor(F.col("ms") / 60_000).cast("long"))
    top = s.groupBy("track", "minute").agg(F.max(F.struct("strength", "id")).alias("m")).select("track", "minute", F.col("m.id").alias("best"))
    return s.join(top, ["track", "minute"]).where("n % 10 = 1 or id = best").groupBy("track").agg(F.count("*").alias("kept"), F.sum("strength").alias("strength"))


def cache_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose digest the catalog has already, and those that need work."""
    sha = norm.first_nonempty(F.lower("fingerprint.sha256"))
    known = table(spark, sf_dir, "catalog_entry").select(sha.alias("sha")).where("sha is not null").distinct().withColumn("hit", F.lit(True))
    c = table(spark, sf_dir, "candidate_batch").select("batch_no", sha.alias("sha")).join(known, "sha", "left")
    return c.groupBy("batch_no").agg(F.count("hit").alias("reused"), F.sum(F.col("hit").isNull().cast("long")).alias("work"))


def author_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median of the scores of each author."""
    c = table(spark, sf_dir, "catalog_entry").where("author is not null").select("author", norm.scaled(F.col("quality.overall_score")).alias("score"))
    return stats.upper_median(c, "score", ["author"])


def reject_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entries whose text names a rejected term, by term."""
    terms = ["crowd", "neon", "server"]
    text = F.lower(F.concat_ws(" ", "tags", "local_path"))
    hit = norm.reasons(*[(F.col("t").contains(t), t) for t in terms])
    return table(spark, sf_dir, "catalog_entry").select(text.alias("t")).select(F.explode(hit).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table row of marked-up text for each area, bars escaped."""
    return table(spark, sf_dir, "subject_area").select("subject", F.concat(F.lit("| "), F.concat_ws(" | ", F.regexp_replace("subject", r"\|", r"\\|"), F.regexp_replace("description", r"\|", r"\\|")), F.lit(" |")).alias("line"))


QUERIES = {f.__name__: f for f in (
    novelty_curve, range_mean, meter_phase, phrase_boundaries, strongest_sounds, coverage_samples, path_safety, positional_zip, downsampled_curve, cache_reuse, author_medians, reject_terms, report_lines,
)}

_R4 = "floor(({0}) * 10000.0 + 0.5) / 10000.0"
_POS = "row_number() OVER (PARTITION BY track ORDER BY ms, id)"
_SHA = "CASE WHEN trim(lower(fingerprint.sha256)) <> '' THEN lower(fingerprint.sha256) END"
SQL = {
    "novelty_curve": f"""WITH t AS (SELECT track, abs(sum(m) OVER a - sum(m) OVER b) AS novelty, count(*) OVER a AS na, count(*) OVER b AS nb FROM {EVENTS}
        WINDOW a AS (PARTITION BY track ORDER BY us, id ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), b AS (PARTITION BY track ORDER BY us, id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))
      SELECT track, CAST(max(novelty) AS BIGINT) AS peak, CAST(sum(novelty) AS BIGINT) AS total, count(*) AS n FROM t WHERE na = 4 AND nb = 4 GROUP BY track""",
    "range_mean": f"""WITH c AS (SELECT id AS cut, track, ms AS lo, lead(ms) OVER (PARTITION BY track ORDER BY ms, id) AS hi FROM {CUTS})
      SELECT cut, count(*) AS n, {_R4.format("sum(strength) / count(*)")} AS mean FROM {SOUNDS} s JOIN c ON s.track = c.track AND s.ms >= lo AND s.ms < hi WHERE strength IS NOT NULL GROUP BY cut""",
    "meter_phase": f"""WITH t AS (SELECT track, strength, {_POS} % 4 AS phase FROM {SOUNDS} WHERE strength IS NOT NULL), g AS (SELECT track, phase, sum(strength) AS s FROM t GROUP BY 1, 2)
      SELECT track, phase, CAST(s AS BIGINT) AS strength FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY s DESC, phase) AS k FROM g) WHERE k = 1""",
    "phrase_boundaries": f"SELECT track, id AS cut_id, ms FROM (SELECT *, {_POS} AS n FROM {CUTS}) WHERE n % 4 = 1",
    "strongest_sounds": f"SELECT * FROM (SELECT track, id, ms, strength, row_number() OVER (PARTITION BY track ORDER BY strength DESC, ms, id) AS rank FROM {SOUNDS} WHERE strength IS NOT NULL) WHERE rank <= 64",
    "coverage_samples": f"SELECT * FROM (SELECT track, id, row_number() OVER (PARTITION BY track ORDER BY sha256(id::VARCHAR), id) AS rank FROM {CUTS}) WHERE rank <= 5",
    "path_safety": r"""SELECT CASE WHEN local_path IS NULL OR trim(local_path) = '' THEN 'missing' WHEN regexp_matches(local_path, '^(/|[A-Za-z]:)') THEN 'absolute' WHEN regexp_matches(local_path, '(^|/)\.\.(/|$)') THEN 'climbs' ELSE 'safe' END AS kind, count(*) AS n FROM catalog_entry GROUP BY 1""",
    "positional_zip": f"""WITH c AS (SELECT track, ms, {_POS} AS pos FROM {CUTS}), s AS (SELECT track, ms, {_POS} AS pos FROM {SOUNDS} WHERE strength >= 800)
      SELECT c.track, count(*) AS n, CAST(sum(abs(c.ms - s.ms)) AS BIGINT) AS apart FROM c JOIN s ON c.track = s.track AND c.pos = s.pos GROUP BY 1""",
    "downsampled_curve": f"""WITH t AS (SELECT track, strength, {_POS} AS n, row_number() OVER (PARTITION BY track, ms // 60000 ORDER BY strength DESC, id DESC) AS k FROM {SOUNDS} WHERE strength IS NOT NULL)
      SELECT track, count(*) AS kept, CAST(sum(strength) AS BIGINT) AS strength FROM t WHERE n % 10 = 1 OR k = 1 GROUP BY track""",
    "cache_reuse": f"""WITH k AS (SELECT DISTINCT {_SHA} AS sha FROM catalog_entry), c AS (SELECT batch_no, {_SHA} AS sha FROM candidate_batch)
      SELECT batch_no, count(k.sha) AS reused, count(*) - count(k.sha) AS work FROM c LEFT JOIN k ON c.sha = k.sha GROUP BY 1""",
    "author_medians": """WITH r AS (SELECT author, CAST(floor(quality.overall_score * 1000.0 + 0.5) AS BIGINT) AS s FROM catalog_entry WHERE author IS NOT NULL AND quality.overall_score IS NOT NULL),
      o AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY author) AS n FROM r) SELECT author, s AS upper_mid FROM o WHERE i = n // 2""",
    "reject_terms": """WITH t AS (SELECT lower(concat_ws(' ', tags, local_path)) AS t FROM catalog_entry)
      SELECT term, count(*) AS n FROM t JOIN (VALUES ('crowd'), ('neon'), ('server')) v(term) ON contains(t.t, term) GROUP BY 1""",
    "report_lines": r"SELECT subject, concat('| ', replace(subject, '|', '\|'), ' | ', replace(description, '|', '\|'), ' |') AS line FROM subject_area",
}
