"""Queries of scores, gates, alignment, text and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import norm
from ..operators import asof, components, gates, vectors
from ..operators import catalog as ct
from ..operators import neighbours as nb
from ..sources import logs
from ..sources.tables import table
from .views import CUTS, EVENTS, SOUNDS, TEN_MIN_MS, cuts, events, sounds

S = norm.scaled


def cut_alignment_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per track, share of cuts within 120 ms of any sound, and whether it reaches 70 %."""
    n = asof.nearest(cuts(spark, sf_dir).select("track", "ms", "id"), sounds(spark, sf_dir).select("track", "ms", F.col("id").alias("sid")), ["track"], "ms", "sid", TEN_MIN_MS)
    hit = F.sum(F.when(F.abs(F.col("ms") - F.col("near_at")) <= 120, 1).otherwise(0)).cast("long")
    r = n.groupBy("track").agg(F.count("*").alias("cuts"), hit.alias("aligned"))
    return r.select("track", "cuts", "aligned", norm.rounded(F.col("aligned") / F.col("cuts")).alias("share"), (F.col("aligned") * 10 >= F.col("cuts") * 7).alias("passed"))


def nearest_event_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per type of sound, cuts whose nearest sound of that type is within 150 ms, with their summed distance."""
    s = sounds(spark, sf_dir).where("type is not null")
    # a cut asks only for the types that its track has within reach: a cell of 150 ms or a neighbouring one
    cell = F.floor(F.col("ms") / 150).cast("long")
    near = s.select("track", "type", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell")).distinct()
    c = cuts(spark, sf_dir).select("track", "ms", "id", cell.alias("cell")).join(near, ["track", "cell"]).select("track", "ms", "id", "type").distinct()
    n = asof.nearest(c, s.select("track", "type", "ms", F.col("id").alias("sid")), ["track", "type"], "ms", "sid", TEN_MIN_MS)
    d = F.abs(F.col("ms") - F.col("near_at"))
    return n.where(d <= 150).groupBy("type").agg(F.count("*").alias("cuts"), F.sum(d).alias("distance"), F.sum(F.when(F.col("near_at") < F.col("ms"), 1).otherwise(0)).cast("long").alias("early"))


def multi_alignment_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of each recorded alignment among all cuts, and its weight by the largest."""
    c = table(spark, sf_dir, "cut_record").select("cut_id", norm.label(F.col("primary_alignment")).alias("type")).distinct()
    total = c.select("cut_id").distinct().count()
    r = c.where("type is not null").groupBy("type").agg(F.count_distinct("cut_id").alias("cuts")).withColumn("rate", F.col("cuts") / F.lit(total))
    top = r.agg(F.max("rate")).first()[0] or 1.0
    return r.select("type", "cuts", norm.rounded(F.col("rate")).alias("rate"), norm.rounded((F.col("rate") + 0.12) / F.lit(top + 0.12)).alias("weight"))


def reliability_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.42 coverage + 0.30 mean confidence + 0.28 min(1, n / 40) for each track, banded."""
    e = table(spark, sf_dir, "music_event").where("track_key is not null")
    ok = F.col("confidence").isNotNull() & ~F.isnan("confidence")
    g = e.groupBy(F.col("track_key").alias("track")).agg(F.count("*").alias("n"), F.sum(F.when(ok, 1).otherwise(0)).alias("have"), F.sum(F.when(ok, S(F.col("confidence")))).alias("c"))
    score = 0.42 * F.col("have") / F.col("n") + 0.30 * F.coalesce(F.try_divide("c", "have"), F.lit(0.0)) / 1000.0 + 0.28 * F.least(F.lit(1.0), F.col("n") / 40.0)
    g = g.withColumn("score", norm.rounded(score))
    return g.select("track", "n", "score", F.when(F.col("score") >= 0.72, "high").when(F.col("score") >= 0.45, "medium").otherwise("low").alias("band"))


def stats_by_energy_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shot lengths by energy band of the cut that opens them; empty bands stay."""
    c = nb.with_neighbour(cuts(spark, sf_dir), ["track"], "ms", ["ms", "id"], ["ms"], TEN_MIN_MS, "next", after=True).where("next is not null and energy is not null")
    band = F.when(F.col("energy") < 340, "low").when(F.col("energy") < 670, "medium").otherwise("high")
    d = c.select(band.alias("band"), (F.col("next.ms") - F.col("ms")).alias("d"))
    g = d.groupBy("band").agg(F.count("*").alias("n"), F.sum("d").alias("total"), F.sum((F.col("d") < 1500).cast("long")).alias("short"), F.sum((F.col("d") >= 4500).cast("long")).alias("long"))
    dim = spark.createDataFrame([("low",), ("medium",), ("high",)], "band string")
    z = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return dim.join(g, "band", "left").select("band", z("n"), z("total"), z("short"), z("long"))


def phase_pacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts in each quarter of their track; quarters without a cut stay."""
    c = cuts(spark, sf_dir)
    span = c.groupBy("track").agg(F.max("ms").alias("end"))
    q = F.least(F.lit(3).cast("long"), F.floor(F.col("ms") * 4 / F.greatest(F.col("end"), F.lit(1))).cast("long"))
    n = c.join(span, "track").groupBy("track", q.alias("phase")).agg(F.count("*").alias("n"))
    all_ = span.select("track", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("phase"))
    return all_.join(n, ["track", "phase"], "left").select("track", "phase", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean time of a track's sounds weighted by strength."""
    s = sounds(spark, sf_dir).where("strength > 0")
    g = s.groupBy("track").agg(F.sum(F.col("ms") * F.col("strength")).alias("a"), F.sum("strength").alias("w"))
    return g.select("track", F.floor(F.col("a") / F.col("w")).cast("long").alias("centre_ms"))


def event_contract_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sounds of one type within 4 ms of the one before fall together; what stays, by track and type."""
    s = nb.with_neighbour(sounds(spark, sf_dir), ["track", "type"], "ms", ["ms", "id"], ["ms"], TEN_MIN_MS)
    s = s.where(F.col("prev").isNull() | (F.col("ms") - F.col("prev.ms") > 4))
    return s.groupBy("track", "type").agg(F.count("*").alias("n"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.coalesce(F.max("strength"), F.lit(0).cast("long")).alias("strongest"))


def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of a candidate's tags and its search query."""
    c = table(spark, sf_dir, "candidate_batch")
    a, b = norm.tokens(F.col("tags")), norm.tokens(F.col("search_query"))
    return c.select("candidate_id", F.size(a).cast("long").alias("n_tags"), F.size(F.array_intersect(a, b)).cast("long").alias("shared"), norm.rounded(norm.overlap(a, b)).alias("overlap"))


def tag_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the tags by entries, largest first in ties by word; words of two or more entries."""
    t = table(spark, sf_dir, "catalog_entry").select("entry_id", F.explode(norm.tokens(F.col("tags"))).alias("word"))
    return t.groupBy("word").agg(F.count("*").alias("entries"), F.min("entry_id").alias("first_id")).where("entries > 1")


def scene_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule in order whose word stands in the tags names the setting."""
    rules = [("water", "harbour|ferry|waves|coast"), ("night", "neon|night|crowd"), ("work", "lab|server|workshop|kitchen"), ("nature", "trail|snow|forest|mist|harvest")]
    c = table(spark, sf_dir, "catalog_entry").select(F.lower(F.coalesce("tags", F.lit(""))).alias("t"))
    name = F.coalesce(*[F.when(F.col("t").rlike(rf"\b({words})\b"), F.lit(n)) for n, words in rules], F.lit("other"))
    return c.groupBy(name.alias("setting")).agg(F.count("*").alias("n"))


def availability_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1, A.8: weighted mean of the scores an entry has; missing ones are left out with their weight."""
    c = table(spark, sf_dir, "catalog_entry")
    parts = [(norm.finite(F.col("quality.overall_score")), 0.5), (norm.finite(F.col("quality.motion_score")), 0.3), (F.when(F.size("quality.usable_segments") > 0, F.lit(1.0)), 0.2)]
    score, weight = norm.availability_weighted(parts)
    return c.select("entry_id", norm.rounded(score).alias("score"), norm.rounded(weight).alias("weight"))


def hue_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of hues taken from part numbers on the circle of 360 degrees."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", norm.rounded(norm.hue_similarity((F.col("p_partkey") * 37 % 360).cast("double"), (F.col("p_size") * 11 % 360).cast("double"))).alias("similarity"))


def aspect_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by aspect ratio and whether they are large enough either way up."""
    c = table(spark, sf_dir, "catalog_entry").select(F.col("fingerprint.width").alias("w"), F.col("fingerprint.height").alias("h"))
    big = (F.greatest("w", "h") >= 1280) & (F.least("w", "h") >= 720)
    return c.where("w > 0 and h > 0").groupBy(norm.ratio_label(F.col("w"), F.col("h")).alias("ratio")).agg(F.count("*").alias("n"), F.sum(big.cast("long")).alias("large"))


def adjacency_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two consecutive cuts of a track share too much of, by issue."""
    c = nb.with_neighbour(cuts(spark, sf_dir), ["track"], "ms", ["ms", "id"], ["role", "band", "ms"], TEN_MIN_MS).where("prev is not null")
    issues = norm.reasons((F.col("role") == F.col("prev.role"), "same_role"), (F.col("band") == F.col("prev.band"), "same_band"), (F.col("ms") - F.col("prev.ms") < 250, "too_close"))
    return c.select("track", F.explode(issues).alias("issue")).groupBy("track", "issue").agg(F.count("*").alias("n"))


def tie_band_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per author, of the entries within 12 thousandths of the best score the one with the largest jitter."""
    c = table(spark, sf_dir, "catalog_entry").where("author is not null").select("author", "entry_id", S(F.col("quality.overall_score")).alias("score")).where("score is not null")
    top = c.groupBy("author").agg(F.max("score").alias("top"))
    j = F.conv(F.substring(F.sha2(F.col("entry_id").cast("string"), 256), 1, 8), 16, 10).cast("long")
    near = c.join(top, "author").where("score >= top - 12").withColumn("j", j)
    return near.groupBy("author").agg(F.max(F.struct("j", "score", "entry_id")).alias("m")).select("author", "m.entry_id", "m.score")


def quality_gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """why entries fail a media gate; entries can have several reasons."""
    c = table(spark, sf_dir, "catalog_entry")
    why = norm.reasons(
        (F.col("fingerprint.width") < 1280, "narrow"), (F.col("fingerprint.duration_seconds") < 5, "short"), (F.col("quality.overall_score") < 0.3, "low_score"),
        (F.coalesce(F.size("quality.usable_segments"), F.lit(0)) <= 0, "no_segment"), (F.col("quality.passed") == F.lit(False), "failed_before"),
    )
    return c.select(F.explode_outer(why).alias("reason")).groupBy(F.coalesce("reason", F.lit("passed")).alias("reason")).agg(F.count("*").alias("n"))


def plan_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output intervals of a run against the one before: gaps, overlaps, reversed ones."""
    ok = "output_start is not null and output_end is not null and not isnan(output_start) and not isnan(output_end) and abs(output_start) < 1e9 and abs(output_end) < 1e9"
    u = table(spark, sf_dir, "usage_interval").where("run_id is not null and usage_id is not null and " + ok).select("run_id", "usage_id", S(F.col("output_start")).alias("s"), S(F.col("output_end")).alias("e")).distinct()
    u = nb.with_neighbour(u, ["run_id"], "s", ["s", "e", "usage_id"], ["e"], TEN_MIN_MS)
    issue = norm.reasons((F.col("e") <= F.col("s"), "reversed"), (F.col("s") - F.col("prev.e") > 80, "gap"), (F.col("prev.e") - F.col("s") > 80, "overlap"))
    return u.select("run_id", F.explode(issue).alias("issue")).groupBy("run_id", "issue").agg(F.count("*").alias("n"))


def check_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of each entry as rows with verdicts that may be unknown, and the gate over the blocking ones."""
    c = table(spark, sf_dir, "catalog_entry")
    checks = [("has_digest", F.col("fingerprint.sha256") != "", True), ("long_enough", F.col("fingerprint.duration_seconds") >= 5, True), ("scored", F.col("quality.overall_score") >= 0.2, False), ("wide", F.col("fingerprint.width") >= 1280, False)]
    v = gates.verdict(gates.check_table(c, ["entry_id"], checks), ["entry_id"])
    return v.groupBy("passed", "failed", "unknown").agg(F.count("*").alias("entries"))


def capacity_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds that usable material can cover if no entry gives more than 30 % of a minute."""
    c = table(spark, sf_dir, "catalog_entry").select(F.coalesce(F.col("quality.scene_category"), F.lit("-")).alias("scene"), S(norm.finite(F.col("fingerprint.duration_seconds"), 0.0)).alias("d"))
    g = c.groupBy("scene").agg(F.count("*").alias("n"), F.sum(F.least(F.greatest("d", F.lit(0).cast("long")), F.lit(18_000).cast("long"))).alias("covered_ms"))
    return g.withColumn("enough", F.col("covered_ms") >= 57_000)


def climax_vs_calm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sounds a minute in loud and calm stretches of a track; NULL verdict without both."""
    s = sounds(spark, sf_dir).where("strength is not null")
    g = s.groupBy("track").agg(F.sum((F.col("strength") >= 670).cast("long")).alias("loud"), F.sum((F.col("strength") < 340).cast("long")).alias("calm"))
    verdict = F.when((F.col("loud") > 0) & (F.col("calm") > 0), F.when(F.col("loud") >= F.col("calm"), "denser").otherwise("sparser")).otherwise("insufficient_evidence")
    return g.withColumn("verdict", verdict)


def candidate_slot_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that share a word with each slot's terms; slots are the suites of the test items."""
    slots = table(spark, sf_dir, "subject_area").select("subject", F.explode(norm.tokens(F.col("description"))).alias("word"))
    c = table(spark, sf_dir, "candidate_batch").select("candidate_id", F.explode(F.array_distinct(F.concat(norm.tokens(F.col("tags")), norm.tokens(F.col("search_query"))))).alias("word"))
    hit = c.join(slots, "word").groupBy("subject", "candidate_id").agg(F.count("*").alias("k"))
    n = hit.groupBy("subject").agg(F.count("*").alias("candidates"), F.max("k").alias("best"))
    z = lambda x: F.coalesce(x, F.lit(0).cast("long")).alias(x)
    return table(spark, sf_dir, "subject_area").select("subject").join(n, "subject", "left").select("subject", z("candidates"), z("best"))


def source_window_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per entry the best of its segments, five starts and three speeds, by score, then start and speed."""
    c = table(spark, sf_dir, "catalog_entry").select("entry_id", F.explode("quality.usable_segments").alias("g"))
    s, e = norm.finite(F.col("g.start")), norm.finite(F.col("g.end"))
    c = c.select("entry_id", S(s).alias("s"), S(e).alias("e"), F.coalesce(S(norm.finite(F.col("g.score"))), F.lit(0).cast("long")).alias("score")).where("e > s").distinct()
    c = c.select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).select("*", F.explode(F.array(F.lit(90), F.lit(100), F.lit(115))).alias("speed"))
    need = F.floor(F.lit(1500) * F.col("speed") / 100).cast("long")
    c = c.withColumn("need", need).where("e - s >= need").withColumn("start_ms", F.col("s") + F.floor((F.col("e") - F.col("s") - F.col("need")) * F.col("i") / 4).cast("long"))
    edge = F.least(F.col("start_ms") - F.col("s"), F.col("e") - F.col("start_ms") - F.col("need"))
    c = c.withColumn("total", F.col("score") * 58 + F.least(edge, F.lit(450).cast("long")) * 22 - F.abs(F.col("speed") - 100) * 100)
    return ct.keep_best(c, ["entry_id"], [-F.col("total"), -F.col("start_ms"), -F.col("speed")], ["start_ms", "speed", "total"])


def section_cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector and the next of its label; pairs, and those of 0.1 or more."""
    e = nb.with_neighbour(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), ["label"], "vec_id", ["vec_id"], ["embedding"], 100_000).where("prev is not null")
    c = e.select("label", vectors.cosine(F.col("embedding"), F.col("prev.embedding")).alias("c"))
    return c.groupBy("label").agg(F.count("*").alias("pairs"), F.sum((F.col("c") >= 0.1).cast("long")).alias("alike"))


def loop_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of orders linked by sharing a customer within a month, by size."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"))
    p = nb.with_neighbour(o, ["o_custkey"], "us", ["us", "o_orderkey"], ["o_orderkey", "us"], 365 * 86_400_000_000).where("prev is not null")
    links = p.where(F.col("us") - F.col("prev.us") <= 30 * 86_400_000_000).select(F.col("o_orderkey").alias("a"), F.col("prev.o_orderkey").alias("b"))
    comp = components.components(links, "a", "b")
    return comp.groupBy("comp").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("groups"))


def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines in the documents by level, with the first and last time of day."""
    lines = logs.log_lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    return lines.groupBy("level").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"), F.min("clock").alias("first"), F.max("clock").alias("last"))


def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in texts masked; what is left by length."""
    e = table(spark, sf_dir, "catalog_entry").select("entry_id", F.concat(F.coalesce("page_url", F.lit("x")), F.lit("?api_key="), F.col("entry_id").cast("string"), F.lit("&q=1")).alias("u"))
    return e.select("entry_id", norm.redacted(F.col("u")).alias("url"))


def canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of a record's canonical text."""
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", F.sha2(F.concat_ws("|", F.col("n_name"), F.col("n_regionkey").cast("string")), 256).alias("digest"))


QUERIES = {f.__name__: f for f in (
    cut_alignment_qa, nearest_event_by_type, multi_alignment_rates, reliability_score, stats_by_energy_band, phase_pacing, weighted_mean, event_contract_groups, token_overlap, tag_index, scene_rules, availability_weighted,
    hue_similarity, aspect_labels, adjacency_issues, tie_band_pick, quality_gate_reasons, plan_validation, check_matrix, capacity_bound, climax_vs_calm, candidate_slot_coverage, source_window_choice,
    section_cosine_pairs, loop_components, log_parse, redaction, canonical_digest,
)}

_R4 = "floor(({0}) * 10000.0 + 0.5) / 10000.0"
_WC = "OVER (PARTITION BY track ORDER BY ms, id)"
_TOK = "list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '([a-z0-9]+)', 1))"
_K = "CAST(floor(({0}) * 1000.0 + 0.5) AS BIGINT)"
_NEAR = f"""c AS (SELECT * FROM {CUTS}), s AS (SELECT track, ms FROM {SOUNDS} GROUP BY ALL),
  b AS (SELECT c.id, c.ms - s.ms AS d FROM c ASOF JOIN s ON c.track = s.track AND c.ms >= s.ms), a AS (SELECT c.id, s.ms - c.ms AS d FROM c ASOF JOIN s ON c.track = s.track AND c.ms <= s.ms),
  n AS (SELECT id, min(d) AS d FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id)"""
SQL = {
    "cut_alignment_qa": f"""WITH {_NEAR} SELECT track, count(*) AS cuts, CAST(sum(CASE WHEN d <= 120 THEN 1 ELSE 0 END) AS BIGINT) AS aligned, {_R4.format("sum(CASE WHEN d <= 120 THEN 1 ELSE 0 END) / count(*)")} AS share,
      sum(CASE WHEN d <= 120 THEN 1 ELSE 0 END) * 10 >= count(*) * 7 AS passed FROM c LEFT JOIN n USING (id) GROUP BY track""",
    "nearest_event_by_type": f"""WITH c AS (SELECT * FROM {CUTS}), s AS (SELECT track, type, ms FROM {SOUNDS} GROUP BY ALL), ty AS (SELECT DISTINCT type FROM s), ct AS (SELECT c.id, c.track, c.ms, ty.type FROM c, ty),
      b AS (SELECT ct.id, ct.type, ct.ms - s.ms AS d, 0 AS late FROM ct ASOF JOIN s ON ct.track = s.track AND ct.type = s.type AND ct.ms >= s.ms), a AS (SELECT ct.id, ct.type, s.ms - ct.ms AS d, 1 AS late FROM ct ASOF JOIN s ON ct.track = s.track AND ct.type = s.type AND ct.ms <= s.ms),
      n AS (SELECT id, type, min(struct_pack(d := d, late := late)) AS m FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2)
      SELECT type, count(*) AS cuts, CAST(sum(m.d) AS BIGINT) AS distance, CAST(sum(CASE WHEN m.late = 0 AND m.d > 0 THEN 1 ELSE 0 END) AS BIGINT) AS early FROM n WHERE m.d <= 150 GROUP BY type""",
    "multi_alignment_rates": f"""WITH c AS (SELECT DISTINCT cut_id, CASE WHEN lower(trim(primary_alignment)) NOT IN ('', 'unknown', 'unresolved', 'general', 'none', 'n/a') THEN lower(trim(primary_alignment)) END AS type FROM cut_record),
      r AS (SELECT type, count(DISTINCT cut_id) AS cuts, count(DISTINCT cut_id) / (SELECT count(DISTINCT cut_id) FROM c) AS rate FROM c WHERE type IS NOT NULL GROUP BY 1)
      SELECT type, cuts, {_R4.format("rate")} AS rate, {_R4.format("(rate + 0.12) / ((SELECT max(rate) FROM r) + 0.12)")} AS weight FROM r""",
    "reliability_score": f"""WITH g AS (SELECT track_key AS track, count(*) AS n, count(CASE WHEN NOT isnan(confidence) THEN 1 END) AS have, sum(CASE WHEN NOT isnan(confidence) THEN {_K.format("confidence")} END) AS c FROM music_event WHERE track_key IS NOT NULL GROUP BY 1),
      s AS (SELECT track, n, {_R4.format("0.42 * have / n + 0.30 * coalesce(c / nullif(have, 0), 0.0) / 1000.0 + 0.28 * least(1.0, n / 40.0)")} AS score FROM g)
      SELECT track, n, score, CASE WHEN score >= 0.72 THEN 'high' WHEN score >= 0.45 THEN 'medium' ELSE 'low' END AS band FROM s""",
    "stats_by_energy_band": f"""WITH d AS (SELECT CASE WHEN energy < 340 THEN 'low' WHEN energy < 670 THEN 'medium' ELSE 'high' END AS band, energy, lead(ms) {_WC} - ms AS d FROM {CUTS}),
      g AS (SELECT band, count(*) AS n, sum(d) AS total, count(CASE WHEN d < 1500 THEN 1 END) AS short, count(CASE WHEN d >= 4500 THEN 1 END) AS long FROM d WHERE d IS NOT NULL AND energy IS NOT NULL GROUP BY 1)
      SELECT b.band, coalesce(n, 0) AS n, CAST(coalesce(total, 0) AS BIGINT) AS total, coalesce(short, 0) AS short, coalesce(long, 0) AS long FROM (VALUES ('low'), ('medium'), ('high')) b(band) LEFT JOIN g USING (band)""",
    "phase_pacing": f"""WITH c AS (SELECT track, ms, max(ms) OVER (PARTITION BY track) AS fin FROM {CUTS}), q AS (SELECT track, least(3, CAST(floor(ms * 4 / greatest(fin, 1)) AS BIGINT)) AS phase FROM c), n AS (SELECT track, phase, count(*) AS n FROM q GROUP BY 1, 2)
      SELECT t.track, p.phase, coalesce(n, 0) AS n FROM (SELECT DISTINCT track FROM c) t CROSS JOIN range(4) p(phase) LEFT JOIN n ON n.track = t.track AND n.phase = p.phase""",
    "weighted_mean": f"SELECT track, CAST(floor(sum(ms * strength) / sum(strength)) AS BIGINT) AS centre_ms FROM {SOUNDS} WHERE strength > 0 GROUP BY track",
    "event_contract_groups": f"""WITH t AS (SELECT *, lag(ms) OVER (PARTITION BY track, type ORDER BY ms, id) AS p FROM {SOUNDS})
      SELECT track, type, count(*) AS n, min(ms) AS first_ms, max(ms) AS last_ms, coalesce(max(strength), 0) AS strongest FROM t WHERE p IS NULL OR ms - p > 4 GROUP BY 1, 2""",
    "token_overlap": f"""WITH t AS (SELECT candidate_id, {_TOK.format("tags")} AS a, {_TOK.format("search_query")} AS b FROM candidate_batch)
      SELECT candidate_id, len(a) AS n_tags, len(list_intersect(a, b)) AS shared, {_R4.format("CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b)) / least(len(a), len(b)) ELSE 0.0 END")} AS overlap FROM t""",
    "tag_index": f"SELECT word, count(*) AS entries, min(entry_id) AS first_id FROM (SELECT entry_id, unnest({_TOK.format('tags')}) AS word FROM catalog_entry) GROUP BY 1 HAVING count(*) > 1",
    "scene_rules": r"""SELECT CASE WHEN regexp_matches(t, '\b(harbour|ferry|waves|coast)\b') THEN 'water' WHEN regexp_matches(t, '\b(neon|night|crowd)\b') THEN 'night' WHEN regexp_matches(t, '\b(lab|server|workshop|kitchen)\b') THEN 'work'
      WHEN regexp_matches(t, '\b(trail|snow|forest|mist|harvest)\b') THEN 'nature' ELSE 'other' END AS setting, count(*) AS n FROM (SELECT lower(coalesce(tags, '')) AS t FROM catalog_entry) GROUP BY 1""",
    "availability_weighted": f"""WITH v AS (SELECT entry_id, CASE WHEN isfinite(quality.overall_score) THEN greatest(0.0, least(1.0, quality.overall_score)) END AS a, CASE WHEN isfinite(quality.motion_score) THEN greatest(0.0, least(1.0, quality.motion_score)) END AS b,
        CASE WHEN len(quality.usable_segments) > 0 THEN 1.0 END AS c FROM catalog_entry),
      w AS (SELECT *, (CASE WHEN a IS NOT NULL THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN b IS NOT NULL THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END) + CASE WHEN c IS NOT NULL THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS w FROM v)
      SELECT entry_id, {_R4.format("CASE WHEN w > 0 THEN ((coalesce(a, 0.0) * 0.5::DOUBLE + coalesce(b, 0.0) * 0.3::DOUBLE) + coalesce(c, 0.0)::DOUBLE * 0.2::DOUBLE) / w ELSE 0.0 END")} AS score, {_R4.format("w")} AS weight FROM w""",
    "hue_similarity": f"""WITH d AS (SELECT p_partkey, abs(CAST(p_partkey * 37 % 360 AS DOUBLE) - CAST(p_size * 11 % 360 AS DOUBLE)) AS d FROM part) SELECT p_partkey, {_R4.format("1.0 - least(d, 360.0 - d) / 180.0")} AS similarity FROM d""",
    "aspect_labels": """SELECT concat(w // gcd(w, h), ':', h // gcd(w, h)) AS ratio, count(*) AS n, CAST(sum(CASE WHEN greatest(w, h) >= 1280 AND least(w, h) >= 720 THEN 1 ELSE 0 END) AS BIGINT) AS large
      FROM (SELECT fingerprint.width AS w, fingerprint.height AS h FROM catalog_entry) WHERE w > 0 AND h > 0 GROUP BY 1""",
    "adjacency_issues": f"""WITH t AS (SELECT track, role, band, ms, lag(role) {_WC} AS pr, lag(band) {_WC} AS pb, lag(ms) {_WC} AS pm FROM {CUTS}),
      i AS (SELECT track, 'same_role' AS issue FROM t WHERE role = pr UNION ALL SELECT track, 'same_band' FROM t WHERE band = pb UNION ALL SELECT track, 'too_close' FROM t WHERE ms - pm < 250) SELECT track, issue, count(*) AS n FROM i GROUP BY 1, 2""",
    "tie_band_pick": f"""WITH c AS (SELECT author, entry_id, {_K.format("quality.overall_score")} AS score FROM catalog_entry WHERE author IS NOT NULL AND quality.overall_score IS NOT NULL),
      n AS (SELECT *, ('0x' || substr(sha256(entry_id::VARCHAR), 1, 8))::BIGINT AS j, max(score) OVER (PARTITION BY author) AS top FROM c)
      SELECT author, entry_id, score FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY j DESC, score DESC, entry_id DESC) AS k FROM n WHERE score >= top - 12) WHERE k = 1""",
    "quality_gate_reasons": """WITH r AS (SELECT list_filter([CASE WHEN fingerprint.width < 1280 THEN 'narrow' END, CASE WHEN fingerprint.duration_seconds < 5 THEN 'short' END, CASE WHEN quality.overall_score < 0.3 THEN 'low_score' END,
        CASE WHEN coalesce(len(quality.usable_segments), 0) = 0 THEN 'no_segment' END, CASE WHEN quality.passed = false THEN 'failed_before' END], lambda x: x IS NOT NULL) AS w FROM catalog_entry)
      SELECT reason, count(*) AS n FROM (SELECT unnest(CASE WHEN len(w) > 0 THEN w ELSE ['passed'] END) AS reason FROM r) GROUP BY 1""",
    "plan_validation": f"""WITH u AS (SELECT DISTINCT run_id, usage_id, {_K.format("output_start")} AS s, {_K.format("output_end")} AS e FROM usage_interval WHERE run_id IS NOT NULL AND usage_id IS NOT NULL AND isfinite(output_start) AND isfinite(output_end) AND abs(output_start) < 1e9 AND abs(output_end) < 1e9),
      p AS (SELECT *, lag(e) OVER (PARTITION BY run_id ORDER BY s, e, usage_id) AS pe FROM u),
      i AS (SELECT run_id, 'reversed' AS issue FROM p WHERE e <= s UNION ALL SELECT run_id, 'gap' FROM p WHERE s - pe > 80 UNION ALL SELECT run_id, 'overlap' FROM p WHERE pe - s > 80) SELECT run_id, issue, count(*) AS n FROM i GROUP BY 1, 2""",
    "check_matrix": """WITH c AS (SELECT fingerprint.sha256 <> '' AS a, fingerprint.duration_seconds >= 5 AS b, quality.overall_score >= 0.2 AS c, fingerprint.width >= 1280 AS d FROM catalog_entry),
      v AS (SELECT coalesce(a, true) AND coalesce(b, true) AS passed, CAST((a = false)::INT IS NOT NULL AND a = false AS INT) + CAST(coalesce(b = false, false) AS INT) + CAST(coalesce(c = false, false) AS INT) + CAST(coalesce(d = false, false) AS INT) AS failed,
        CAST(a IS NULL AS INT) + CAST(b IS NULL AS INT) + CAST(c IS NULL AS INT) + CAST(d IS NULL AS INT) AS unknown FROM c)
      SELECT passed, coalesce(failed, 0)::BIGINT AS failed, unknown::BIGINT AS unknown, count(*) AS entries FROM v GROUP BY 1, 2, 3""",
    "capacity_bound": f"""WITH c AS (SELECT coalesce(quality.scene_category, '-') AS scene, {_K.format("CASE WHEN isfinite(fingerprint.duration_seconds) THEN fingerprint.duration_seconds ELSE 0.0 END")} AS d FROM catalog_entry)
      SELECT scene, count(*) AS n, CAST(sum(least(greatest(d, 0), 18000)) AS BIGINT) AS covered_ms, sum(least(greatest(d, 0), 18000)) >= 57000 AS enough FROM c GROUP BY 1""",
    "climax_vs_calm": f"""WITH g AS (SELECT track, count(CASE WHEN strength >= 670 THEN 1 END) AS loud, count(CASE WHEN strength < 340 THEN 1 END) AS calm FROM {SOUNDS} WHERE strength IS NOT NULL GROUP BY 1)
      SELECT *, CASE WHEN loud > 0 AND calm > 0 THEN CASE WHEN loud >= calm THEN 'denser' ELSE 'sparser' END ELSE 'insufficient_evidence' END AS verdict FROM g""",
    "candidate_slot_coverage": f"""WITH s AS (SELECT subject, unnest({_TOK.format("description")}) AS word FROM subject_area), c AS (SELECT candidate_id, unnest(list_distinct(list_concat({_TOK.format("tags")}, {_TOK.format("search_query")}))) AS word FROM candidate_batch),
      h AS (SELECT subject, candidate_id, count(*) AS k FROM c JOIN s USING (word) GROUP BY 1, 2), n AS (SELECT subject, count(*) AS candidates, max(k) AS best FROM h GROUP BY 1)
      SELECT subject, coalesce(candidates, 0) AS candidates, coalesce(best, 0) AS best FROM subject_area LEFT JOIN n USING (subject)""",
    "source_window_choice": f"""WITH g AS (SELECT entry_id, unnest(quality.usable_segments) AS g FROM catalog_entry), f AS (SELECT * FROM g WHERE isfinite(g."start") AND isfinite(g."end")),
      c AS (SELECT DISTINCT entry_id, {_K.format('g."start"')} AS s, {_K.format('g."end"')} AS e, coalesce(CASE WHEN isfinite(g.score) THEN {_K.format("g.score")} END, 0) AS score FROM f),
      o AS (SELECT c.*, i, speed, CAST(floor(1500 * speed / 100) AS BIGINT) AS need FROM c, range(5) r(i), (VALUES (90), (100), (115)) v(speed) WHERE e > s),
      p AS (SELECT *, s + CAST(floor((e - s - need) * i / 4) AS BIGINT) AS start_ms FROM o WHERE e - s >= need),
      q AS (SELECT entry_id, start_ms, speed, score * 58 + least(least(start_ms - s, e - start_ms - need), 450) * 22 - abs(speed - 100) * 100 AS total FROM p)
      SELECT entry_id, start_ms, speed, CAST(total AS BIGINT) AS total FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY total DESC, start_ms DESC, speed DESC) AS k FROM q) WHERE k = 1""",
    "section_cosine_pairs": """WITH e AS (SELECT label, embedding::DOUBLE[] AS v, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings)
      SELECT label, count(*) AS pairs, CAST(sum(CASE WHEN list_cosine_similarity(v, p) >= 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS alike FROM e WHERE p IS NOT NULL GROUP BY 1""",
    "loop_components": """WITH t AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) AS us FROM orders), p AS (SELECT *, lag(us) OVER w AS pu, row_number() OVER w AS rn FROM t WINDOW w AS (PARTITION BY o_custkey ORDER BY us, o_orderkey)),
      g AS (SELECT *, sum(CASE WHEN pu IS NULL OR us - pu > 2592000000000 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY us, o_orderkey ROWS UNBOUNDED PRECEDING) AS i FROM p), s AS (SELECT o_custkey, i, count(*) AS n FROM g GROUP BY 1, 2)
      SELECT n, count(*) AS groups FROM s WHERE n > 1 GROUP BY n""",
    "log_parse": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), m AS (SELECT doc_id, regexp_extract(line, '\[(\d\d:\d\d:\d\d)\] ([A-Z]+) ', 1) AS clock, regexp_extract(line, '\[(\d\d:\d\d:\d\d)\] ([A-Z]+) ', 2) AS level FROM l)
      SELECT level, count(*) AS n, count(DISTINCT doc_id) AS docs, min(clock) AS "first", max(clock) AS "last" FROM m WHERE clock <> '' GROUP BY 1""",
    "redaction": "SELECT entry_id, concat(coalesce(page_url, 'x'), '?api_key=***&q=1') AS url FROM catalog_entry",
    "canonical_digest": "SELECT n_nationkey, sha256(concat(n_name, '|', n_regionkey)) AS digest FROM nation",
}
