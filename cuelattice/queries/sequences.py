"""Queries over sequences: gaps, transitions, runs, smoothing, curves and range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.norm import rounded
from ..operators import neighbours as nb
from ..operators import sequence as sq
from ..operators import stats
from ..sources.tables import table
from .views import CUTS, DAY_US, EVENTS, SOUNDS, TEN_MIN_MS, cuts, events, sounds

ORDER_E, ORDER_C = ["us", "id"], ["ms", "id"]


def gap_five_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between a track's events, five numbers by event type."""
    e = nb.with_neighbour(events(spark, sf_dir), ["track"], "us", ORDER_E, ["us"], DAY_US)
    g = e.where("prev is not null").select("type", F.floor((F.col("us") - F.col("prev.us")) / 1_000_000).cast("long").alias("gap"))
    r = stats.five_numbers(g, "gap", ["type"])
    return r.select("type", "n", "low", *[rounded(F.col(c), 2).alias(c) for c in ("q1", "mid", "q3")], "high")


def upper_median_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median of the gaps between cuts by section role."""
    c = nb.with_neighbour(cuts(spark, sf_dir), ["track"], "ms", ORDER_C, ["ms"], TEN_MIN_MS)
    return stats.upper_median(c.where("prev is not null and role is not null").select("role", (F.col("ms") - F.col("prev.ms")).alias("gap")), "gap", ["role"])


def role_transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-normalised transitions between the section roles of a track's cuts."""
    c = nb.with_neighbour(cuts(spark, sf_dir).where("role is not null"), ["track"], "ms", ORDER_C, ["role"], TEN_MIN_MS, "next", after=True)
    return stats.transitions(c.select(F.col("role").alias("src"), F.col("next.role").alias("dst")), "src", "dst")


def argmax_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest following event type."""
    e = nb.with_neighbour(events(spark, sf_dir), ["track"], "us", ORDER_E, ["type"], DAY_US, "next", after=True)
    return stats.best_next(stats.transitions(e.select(F.col("type").alias("src"), F.col("next.type").alias("dst")), "src", "dst"), "src", "dst")


def adjacent_change_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per track, how often role and band change from cut to cut."""
    c = nb.with_neighbour(cuts(spark, sf_dir), ["track"], "ms", ORDER_C, ["role", "band"], TEN_MIN_MS).where("prev is not null")
    same = lambda x: F.sum(F.when(F.col(x).eqNullSafe(F.col(f"prev.{x}")), 0).otherwise(1))
    return c.groupBy("track").agg(F.count("*").alias("steps"), rounded(same("role") / F.count("*")).alias("role_change"), rounded(same("band") / F.count("*")).alias("band_change"))


def repeated_signature_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a track's cuts whose (role, band) was there before."""
    c = cuts(spark, sf_dir).select("track", F.concat_ws("|", F.coalesce("role", F.lit("-")), F.coalesce("band", F.lit("-"))).alias("sig"))
    n = c.groupBy("track", "sig").agg(F.count("*").alias("k")).groupBy("track").agg(F.sum("k").alias("n"), F.count("*").alias("d"))
    return n.select("track", "n", rounded((F.col("n") - F.col("d")) / F.col("n")).alias("repeated"))


def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest run of cuts of one band in each track."""
    c = nb.with_neighbour(cuts(spark, sf_dir), ["track"], "ms", ORDER_C, ["band"], TEN_MIN_MS)
    c = nb.islands(c, ["track"], "ms", ORDER_C, F.col("prev").isNull() | ~F.col("band").eqNullSafe(F.col("prev.band")), TEN_MIN_MS)
    n = c.groupBy("track", "band", "island").agg(F.count("*").alias("n"))
    return n.groupBy("track").agg(F.max("n").alias("longest"))


def quiet_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of a track's cuts with low energy, joined over gaps of up to 4 s, at least 2 s long."""
    c = cuts(spark, sf_dir).where("energy < 340")
    return sq.regions(c, ["track"], "ms", ORDER_C, max_gap=4000, min_length=2000, value="energy", width=TEN_MIN_MS)


def repeat_gap_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of an asset that come less than an hour after its use before."""
    u = table(spark, sf_dir, "usage_interval").where("asset_id is not null and recorded_at is not null").select("usage_id", "asset_id", F.unix_micros(F.col("recorded_at").cast("timestamp")).alias("us")).distinct()
    u = nb.with_neighbour(u, ["asset_id"], "us", ["us", "usage_id"], ["us"], 30 * DAY_US).where("prev is not null")
    u = u.where(F.col("us") - F.col("prev.us") < 3_600_000_000)
    return u.groupBy("asset_id").agg(F.count("*").alias("violations"), F.min(F.col("us") - F.col("prev.us")).alias("least_gap"))


def moving_average_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred mean of five values per track with the edge value repeated beyond the ends."""
    return sq.moving_average_edge(events(spark, sf_dir), "track", ORDER_E, "m", 5, DAY_US).select("id", "track", F.col("smooth").alias("sum5"))


def rolling_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sounds of the track within half a second around each sound."""
    return sq.density(sounds(spark, sf_dir), "track", "ms", 500).groupBy("track").agg(F.max("near").alias("peak"), F.sum("near").alias("total"))


def level_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value three steps later less the value three steps before, ends clamped."""
    return sq.level_change(events(spark, sf_dir), "track", ORDER_E, "m", 3, DAY_US).select("id", "change")


def curve_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each track's values scaled to [0, 1]; 0.5 where all are equal."""
    e = events(spark, sf_dir)
    r = e.groupBy("track").agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    return e.join(r, "track").select("id", rounded(F.when(F.col("hi") > F.col("lo"), (F.col("m") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5)).alias("level"))


def robust_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values between the track's 5th and 95th percentile (nearest rank) scaled and clipped."""
    return sq.robust_normalise(events(spark, sf_dir), "track", "m", 0.05, 0.95).select("id", "level")


def curve_lerp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy curve of the cuts read at each sound by linear interpolation, ends clamped."""
    return sq.lerp(sounds(spark, sf_dir), cuts(spark, sf_dir).where("energy is not null"), "track", "ms", "energy", TEN_MIN_MS)


def section_of_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sounds inside the half-open stretch between two cuts of their track, by the stretch's role."""
    c = nb.with_neighbour(cuts(spark, sf_dir), ["track"], "ms", ORDER_C, ["ms"], TEN_MIN_MS, "next", after=True)
    spans = c.where("next is not null").select("track", F.col("ms").alias("lo"), F.col("next.ms").alias("hi"), "role", "band")
    j = nb.range_join(sounds(spark, sf_dir), spans, ["track"], "ms", "lo", "hi", 10_000)
    return j.groupBy("role", "band", "type").agg(F.count("*").alias("n"))


def interval_overlap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest overlap ratio between two uses of an asset in one run."""
    u = table(spark, sf_dir, "usage_interval")
    ok = " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < 1e9" for c in ("source_start", "source_end"))
    u = u.where(ok + " and run_id is not null and asset_id is not null")
    ms = lambda c: F.floor(F.col(c) * 1000.0 + 0.5).cast("long")
    u = u.select("run_id", "asset_id", "usage_id", ms("source_start").alias("lo"), ms("source_end").alias("hi")).distinct()
    o = nb.overlaps(u, ["run_id", "asset_id"], "lo", "hi", "usage_id", 20_000)
    return o.groupBy("run_id", "asset_id").agg(F.count("*").alias("pairs"), F.max("shared").alias("longest"), F.max(rounded(F.col("ratio"))).alias("ratio"))


def soft_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft transitions beyond 40 % of the track's cuts so far become hard ones."""
    c = cuts(spark, sf_dir).withColumn("soft", F.col("band") == "low")
    c = nb.running_total(c, ["track"], "ms", ORDER_C, F.when(F.col("soft"), 1).otherwise(0), TEN_MIN_MS, "softs")
    c = nb.running_total(c, ["track"], "ms", ORDER_C, F.lit(1), TEN_MIN_MS, "rows")
    over = F.coalesce(F.col("soft"), F.lit(False)) & (F.col("softs") > F.floor(F.col("rows") * 2 / 5))
    return c.groupBy("track").agg(F.sum(F.when(over, 1).otherwise(0)).cast("long").alias("hardened"), F.count("*").alias("n"))


def even_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven evenly spaced positions of each track's list of distinct sound times."""
    s = sounds(spark, sf_dir).groupBy("track").agg(F.count_distinct("ms").alias("n"))
    idx = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.floor(i * (F.col("n") - 1) / 6.0 + 0.5).cast("long"))
    return s.where("n > 0").select("track", F.explode(F.array_distinct(idx)).alias("position"))


def nms_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongest sounds of a track at least two seconds apart, with the minute they lie in."""
    return sq.nms(sounds(spark, sf_dir).where("strength is not null"), ["track"], "ms", "strength", 2000, 60_000)


def thin_sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sounds kept at least 40 ms after the last kept one, with the minute they lie in."""
    return sq.thin(sounds(spark, sf_dir), ["track"], "ms", 40, 60_000)


def frame_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut times on a 25 fps grid; the frames of each shot add up to the track's."""
    c = cuts(spark, sf_dir).select("track", F.floor(F.col("ms") * 25 / 1000.0 + 0.5).cast("long").alias("frame"), "id")
    c = nb.with_neighbour(c, ["track"], "frame", ["frame", "id"], ["frame"], 15_000)
    d = F.col("frame") - F.coalesce("prev.frame", F.lit(0))
    return c.groupBy("track").agg(F.sum(d).alias("frames"), F.sum(F.when(d == 0, 1).otherwise(0)).cast("long").alias("empty"), F.max(d).alias("longest"))


def close_at_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches opened by a signup and closed by the next purchase, or by the track's end."""
    e = events(spark, sf_dir)
    marks = e.where("type in ('signup', 'purchase')")
    m = nb.with_neighbour(marks, ["track"], "us", ORDER_E, ["us", "type"], DAY_US, "next", after=True)
    end = e.groupBy("track").agg(F.max("us").alias("end"))
    m = m.where("type = 'signup'").join(end, "track").select("track", (F.coalesce("next.us", "end") - F.col("us")).alias("d"), F.col("next").isNull().alias("open"))
    return m.groupBy("track").agg(F.count("*").alias("n"), F.sum("d").alias("total_us"), F.max("d").alias("longest_us"), F.sum(F.col("open").cast("long")).alias("open"))


QUERIES = {f.__name__: f for f in (
    gap_five_numbers, upper_median_gap, role_transition_matrix, argmax_transition, adjacent_change_ratio, repeated_signature_ratio, longest_run, quiet_regions, repeat_gap_violations,
    moving_average_edge, rolling_density, level_change, curve_minmax, robust_normalise, curve_lerp, section_of_sound, interval_overlap_ratio, soft_budget, even_cap, nms_peaks, thin_sounds, frame_grid, close_at_end,
)}

R4 = "floor(({0}) * 10000.0 + 0.5) / 10000.0"
_WE, _WC = "OVER (PARTITION BY track ORDER BY us, id)", "OVER (PARTITION BY track ORDER BY ms, id)"
SQL = {
    "nms_peaks": f"""WITH RECURSIVE s AS (SELECT track, ms, max(strength) AS v FROM {SOUNDS} WHERE strength IS NOT NULL AND ms IS NOT NULL GROUP BY 1, 2),
  w AS (SELECT track, CAST(NULL AS BIGINT) AS pick, CAST([] AS BIGINT[]) AS kept FROM s GROUP BY 1
    UNION ALL SELECT track, -best.t, list_append(kept, -best.t) FROM (
      SELECT w.track, w.kept, max({{'v': s.v, 't': -s.ms}}) AS best FROM w JOIN s ON s.track = w.track AND len(list_filter(w.kept, lambda k: abs(k - s.ms) < 2000)) = 0 GROUP BY 1, 2))
  SELECT track, CAST(pick // 60000 AS BIGINT) AS "window", pick AS kept FROM w WHERE pick IS NOT NULL""",
    "thin_sounds": f"""WITH RECURSIVE s AS (SELECT DISTINCT track, ms FROM {SOUNDS} WHERE ms IS NOT NULL),
  r AS (SELECT track, min(ms) AS kept FROM s GROUP BY 1 UNION ALL SELECT r.track, min(s.ms) FROM r JOIN s ON s.track = r.track AND s.ms >= r.kept + 40 GROUP BY 1)
  SELECT track, CAST(kept // 60000 AS BIGINT) AS "window", kept FROM r""",
    "gap_five_numbers": f"""WITH g AS (SELECT type, (us - lag(us) {_WE}) // 1000000 AS gap FROM {EVENTS})
      SELECT type, count(*) AS n, min(gap) AS low, floor(quantile_cont(gap, 0.25) * 100.0 + 0.5) / 100.0 AS q1, floor(quantile_cont(gap, 0.5) * 100.0 + 0.5) / 100.0 AS mid,
      floor(quantile_cont(gap, 0.75) * 100.0 + 0.5) / 100.0 AS q3, max(gap) AS high FROM g WHERE gap IS NOT NULL GROUP BY type""",
    "upper_median_gap": f"""WITH g AS (SELECT role, ms - lag(ms) {_WC} AS gap FROM {CUTS}),
      r AS (SELECT role, gap, row_number() OVER (PARTITION BY role ORDER BY gap) - 1 AS i, count(*) OVER (PARTITION BY role) AS n FROM g WHERE gap IS NOT NULL AND role IS NOT NULL)
      SELECT role, gap AS upper_mid FROM r WHERE i = n // 2""",
    "role_transition_matrix": f"""WITH t AS (SELECT role AS src, lead(role) {_WC} AS dst FROM {CUTS} WHERE role IS NOT NULL),
      n AS (SELECT src, dst, count(*) AS n FROM t WHERE dst IS NOT NULL GROUP BY 1, 2)
      SELECT src, dst, n, {R4.format("n / sum(n) OVER (PARTITION BY src)")} AS p FROM n""",
    "argmax_transition": f"""WITH t AS (SELECT type AS src, lead(type) {_WE} AS dst FROM {EVENTS}), n AS (SELECT src, dst, count(*) AS n FROM t WHERE dst IS NOT NULL GROUP BY 1, 2)
      SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst DESC) AS r FROM n) WHERE r = 1""",
    "adjacent_change_ratio": f"""WITH t AS (SELECT track, role, band, lag(role) {_WC} AS pr, lag(band) {_WC} AS pb, lag(id) {_WC} AS pi FROM {CUTS})
      SELECT track, count(*) AS steps, {R4.format("sum(CASE WHEN role IS DISTINCT FROM pr THEN 1 ELSE 0 END) / count(*)")} AS role_change,
      {R4.format("sum(CASE WHEN band IS DISTINCT FROM pb THEN 1 ELSE 0 END) / count(*)")} AS band_change FROM t WHERE pi IS NOT NULL GROUP BY track""",
    "repeated_signature_ratio": f"""SELECT track, count(*) AS n, {R4.format("(count(*) - count(DISTINCT concat(coalesce(role, '-'), '|', coalesce(band, '-')))) / count(*)")} AS repeated FROM {CUTS} GROUP BY track""",
    "longest_run": f"""WITH t AS (SELECT *, lag(band) {_WC} AS pb, lag(id) {_WC} AS pi FROM {CUTS}),
      g AS (SELECT *, sum(CASE WHEN pi IS NULL OR band IS DISTINCT FROM pb THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY ms, id ROWS UNBOUNDED PRECEDING) AS island FROM t),
      n AS (SELECT track, island, count(*) AS n FROM g GROUP BY 1, 2) SELECT track, max(n) AS longest FROM n GROUP BY track""",
    "quiet_regions": f"""WITH t AS (SELECT *, lag(ms) {_WC} AS p FROM {CUTS} WHERE energy < 340),
      g AS (SELECT *, sum(CASE WHEN p IS NULL OR ms - p > 4000 THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY ms, id ROWS UNBOUNDED PRECEDING) AS island FROM t),
      r AS (SELECT track, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS n, {R4.format("sum(energy) / count(*)")} AS mean FROM g GROUP BY track, island)
      SELECT * FROM r WHERE end_ms - start_ms >= 2000""",
    "repeat_gap_violations": """WITH u AS (SELECT DISTINCT usage_id, asset_id, epoch_us(recorded_at) AS us FROM usage_interval WHERE asset_id IS NOT NULL AND recorded_at IS NOT NULL),
      g AS (SELECT asset_id, us - lag(us) OVER (PARTITION BY asset_id ORDER BY us, usage_id) AS d FROM u)
      SELECT asset_id, count(*) AS violations, min(d) AS least_gap FROM g WHERE d < 3600000000 GROUP BY asset_id""",
    "moving_average_edge": f"""WITH t AS (SELECT id, track, m, first_value(m) OVER (PARTITION BY track ORDER BY us, id) AS f, last_value(m) OVER (PARTITION BY track ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l,
        lag(m, 1) {_WE} AS a1, lag(m, 2) {_WE} AS a2, lead(m, 1) {_WE} AS b1, lead(m, 2) {_WE} AS b2 FROM {EVENTS})
      SELECT id, track, CAST(m + coalesce(a1, f) + coalesce(a2, f) + coalesce(b1, l) + coalesce(b2, l) AS BIGINT) AS sum5 FROM t""",
    "rolling_density": f"""WITH t AS (SELECT track, count(*) OVER (PARTITION BY track ORDER BY ms RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS near FROM {SOUNDS})
      SELECT track, max(near) AS peak, CAST(sum(near) AS BIGINT) AS total FROM t GROUP BY track""",
    "level_change": f"""SELECT id, coalesce(lead(m, 3) {_WE}, last_value(m) OVER (PARTITION BY track ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
      - coalesce(lag(m, 3) {_WE}, first_value(m) {_WE}) AS change FROM {EVENTS}""",
    "curve_minmax": f"""SELECT id, {R4.format("CASE WHEN max(m) OVER w > min(m) OVER w THEN (m - min(m) OVER w) / (max(m) OVER w - min(m) OVER w) ELSE 0.5 END")} AS level FROM {EVENTS} WINDOW w AS (PARTITION BY track)""",
    "robust_normalise": f"""WITH r AS (SELECT track, quantile_disc(m, 0.05) AS lo, quantile_disc(m, 0.95) AS hi FROM {EVENTS} GROUP BY track)
      SELECT e.id, {R4.format("CASE WHEN hi > lo THEN greatest(0.0, least(1.0, (m - lo) / (hi - lo))) ELSE 0.0 END")} AS level FROM {EVENTS} e JOIN r USING (track)""",
    "curve_lerp": f"""WITH c AS (SELECT track, ms, min(energy) AS v FROM {CUTS} WHERE energy IS NOT NULL GROUP BY 1, 2), s AS (SELECT * FROM {SOUNDS}),
      b AS (SELECT s.id, c.ms AS t0, c.v AS v0 FROM s ASOF LEFT JOIN c ON s.track = c.track AND s.ms >= c.ms),
      a AS (SELECT s.id, c.ms AS t1, c.v AS v1 FROM s ASOF LEFT JOIN c ON s.track = c.track AND s.ms <= c.ms)
      SELECT s.id, {R4.format("CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (s.ms - t0) / (t1 - t0) END")} AS level
      FROM s JOIN b USING (id) JOIN a USING (id) WHERE t0 IS NOT NULL OR t1 IS NOT NULL""",
    "section_of_sound": f"""WITH c AS (SELECT track, ms AS lo, lead(ms) {_WC} AS hi, role, band FROM {CUTS})
      SELECT c.role, c.band, s.type, count(*) AS n FROM {SOUNDS} s JOIN c ON s.track = c.track AND s.ms >= c.lo AND s.ms < c.hi GROUP BY 1, 2, 3""",
    "interval_overlap_ratio": f"""WITH u AS (SELECT DISTINCT run_id, asset_id, usage_id, CAST(floor(source_start * 1000.0 + 0.5) AS BIGINT) AS lo, CAST(floor(source_end * 1000.0 + 0.5) AS BIGINT) AS hi FROM usage_interval
        WHERE isfinite(source_start) AND isfinite(source_end) AND abs(source_start) < 1e9 AND abs(source_end) < 1e9 AND run_id IS NOT NULL AND asset_id IS NOT NULL), v AS (SELECT * FROM u WHERE lo < hi),
      o AS (SELECT a.run_id, a.asset_id, least(a.hi, b.hi) - greatest(a.lo, b.lo) AS shared, least(a.hi - a.lo, b.hi - b.lo) AS shorter
        FROM v a JOIN v b ON a.run_id = b.run_id AND a.asset_id = b.asset_id AND a.usage_id < b.usage_id AND a.lo < b.hi AND b.lo < a.hi)
      SELECT run_id, asset_id, count(*) AS pairs, max(shared) AS longest, max({R4.format("shared / shorter")}) AS ratio FROM o GROUP BY 1, 2""",
    "soft_budget": f"""WITH t AS (SELECT track, band = 'low' AS soft, sum(CASE WHEN band = 'low' THEN 1 ELSE 0 END) OVER w AS softs, count(*) OVER w AS rows FROM {CUTS} WINDOW w AS (PARTITION BY track ORDER BY ms, id ROWS UNBOUNDED PRECEDING))
      SELECT track, CAST(sum(CASE WHEN coalesce(soft, false) AND softs > floor(rows * 2 / 5) THEN 1 ELSE 0 END) AS BIGINT) AS hardened, count(*) AS n FROM t GROUP BY track""",
    "even_cap": f"""WITH n AS (SELECT track, count(DISTINCT ms) AS n FROM {SOUNDS} GROUP BY track)
      SELECT DISTINCT track, CAST(floor(i * (n - 1) / 6.0 + 0.5) AS BIGINT) AS position FROM n, range(7) r(i)""",
    "frame_grid": f"""WITH f AS (SELECT track, id, CAST(floor(ms * 25 / 1000.0 + 0.5) AS BIGINT) AS frame FROM {CUTS}),
      d AS (SELECT track, frame - coalesce(lag(frame) OVER (PARTITION BY track ORDER BY frame, id), 0) AS d FROM f)
      SELECT track, CAST(sum(d) AS BIGINT) AS frames, CAST(sum(CASE WHEN d = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty, max(d) AS longest FROM d GROUP BY track""",
    "close_at_end": f"""WITH m AS (SELECT track, us, type, lead(us) {_WE} AS nx FROM {EVENTS} WHERE type IN ('signup', 'purchase')), e AS (SELECT track, max(us) AS fin FROM {EVENTS} GROUP BY track)
      SELECT track, count(*) AS n, CAST(sum(coalesce(nx, fin) - us) AS BIGINT) AS total_us, max(coalesce(nx, fin) - us) AS longest_us, CAST(sum(CASE WHEN nx IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS open
      FROM m JOIN e USING (track) WHERE type = 'signup' GROUP BY track""",
}
