"""Queries of rules, roll-ups, schedules, gates and reuse over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import norm
from ..operators import neighbours as nb
from ..operators import rules
from ..operators import sequence as sq
from ..sources.tables import table
from .views import CUTS, SOUNDS, TEN_MIN_MS, cuts, sounds

def zero() -> Column:
    """A whole zero."""
    return F.lit(0).cast("long")


def _area_rules(spark: SparkSession, sf_dir: str):
    """Rules from the words of the areas' descriptions, in order of area; long words weigh more."""
    a = table(spark, sf_dir, "subject_area").where("subject is not null and description is not null")
    w = a.select("subject", F.explode(F.split(F.lower("description"), "[^a-z]+")).alias("needle")).where("length(needle) >= 5")
    return rules.read_rules(w.select(F.ascii("subject").cast("long").alias("priority"), F.col("subject").alias("category"), "needle", F.length("needle").cast("long").alias("weight")))


def keyword_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the first of ordered keyword rules that matches, rules from a table."""
    r = _area_rules(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select(rules.first_category(F.concat_ws(" ", "title", "text"), r).alias("category"))
    return d.groupBy("category").agg(F.count("*").alias("n"))


def keyword_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest weight of the rules that a document's text matches, or of its length in thousands."""
    r = _area_rules(spark, sf_dir)
    d = table(spark, sf_dir, "documents").select("doc_id", rules.risk(F.col("text"), r, F.floor(F.col("n_chars") / 1000).cast("long")).alias("risk"))
    return d.where("risk > 0")


def region_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per track and type of sound: median time, p10 and p90 of strength, mean confidence, share with one, largest, spread."""
    e = sounds(spark, sf_dir).where("strength is not null and type is not null")
    q = lambda c, p: F.percentile(F.col(c).cast("double"), F.lit(p))
    n, s, ss = F.count("*"), F.sum("strength"), F.sum(F.col("strength") * F.col("strength"))
    g = e.groupBy("track", "type").agg(n.alias("n"), q("ms", 0.5).alias("centre"), q("strength", 0.1).alias("p10"), q("strength", 0.9).alias("p90"), F.max("strength").alias("top"), s.alias("s"), ss.alias("ss"))
    # population spread from whole sums: exact, whatever the order
    var = (F.col("n") * F.col("ss") - F.col("s") * F.col("s")).cast("double") / (F.col("n") * F.col("n"))
    r = norm.rounded
    return g.select("track", "type", "n", r(F.col("centre"), 1).alias("centre"), r(F.col("p10"), 1).alias("p10"), r(F.col("p90"), 1).alias("p90"), "top", r(F.sqrt(var), 2).alias("spread"))


def corpus_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all tracks: cuts, minutes, cuts a minute, mean energy, medians of the tracks, dominant band and role, a label."""
    c = cuts(spark, sf_dir)
    t = c.groupBy("track").agg(F.count("*").alias("n"), (F.max("ms") - F.min("ms")).alias("ms")).where("ms > 0")
    a = t.agg(F.count("*").alias("tracks"), F.sum("n").alias("cuts"), F.sum("ms").alias("ms"), F.percentile(F.col("n").cast("double"), F.lit(0.5)).alias("mid"))
    e = c.where("energy is not null").agg(F.sum("energy").alias("e"), F.count("*").alias("ne"))
    top = lambda k: c.where(F.col(k).isNotNull()).groupBy(k).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", k))[k].alias(k))
    # four tables of one row each
    one = a.withColumn("_k", zero()).join(e.withColumn("_k", zero()), "_k").join(top("band").withColumn("_k", zero()), "_k").join(top("role").withColumn("_k", zero()), "_k")
    rate = F.col("cuts") * 60_000.0 / F.col("ms")
    pace = F.when(rate >= 30, "fast").when(rate >= 12, "medium").otherwise("slow")
    return one.select("tracks", "cuts", norm.rounded(F.col("ms") / 60_000.0, 2).alias("minutes"), norm.rounded(rate, 2).alias("per_minute"), norm.rounded(F.try_divide("e", "ne"), 2).alias("energy"), norm.rounded(F.col("mid"), 1).alias("median_cuts"), "band", "role", pace.alias("pace"))


def sequence_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of neighbouring cuts over the dimensions that both have, and tracks with too many poor pairs."""
    c = nb.with_neighbour(cuts(spark, sf_dir), ["track"], "ms", ["ms", "id"], ["energy", "band", "role"], TEN_MIN_MS).where("prev is not null")
    same = lambda k: F.when(F.col(k).isNotNull() & F.col(f"prev.{k}").isNotNull(), (F.col(k) == F.col(f"prev.{k}")).cast("double"))
    apart = F.abs(F.col("energy") - F.col("prev.energy"))
    energy = F.when(apart.isNotNull(), F.greatest(F.lit(0.0), 1.0 - apart / 500.0))
    score = rules.available_score([(energy, 0.5), (same("band"), 0.2), (same("role"), 0.3)])
    p = c.select("track", norm.scaled(score).alias("score")).where("score is not null")
    g = p.groupBy("track").agg(F.count("*").alias("pairs"), F.sum("score").alias("s"), F.sum((F.col("score") < 350).cast("long")).alias("poor"))
    return g.select("track", "pairs", norm.rounded(F.col("s") / F.col("pairs"), 2).alias("score"), "poor", (F.col("poor") > F.ceil(F.col("pairs") * 18 / 100)).alias("severe"))


def merged_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sounds as boundaries; of two nearer than 1.3 s the stronger stays."""
    return sq.merge_boundaries(sounds(spark, sf_dir).where("type in ('downbeat', 'phrase_boundary', 'section_boundary')"), ["track"], "ms", "strength", 1300, 60_000)


def section_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections between cuts by energy: the first of the track's highest is the peak, then rises and falls against the one before."""
    c = nb.with_neighbour(cuts(spark, sf_dir).where("energy is not null"), ["track"], "ms", ["ms", "id"], ["energy"], TEN_MIN_MS)
    peak = c.groupBy("track").agg(F.max(F.struct("energy", (-F.col("ms")).alias("m"), (-F.col("id")).alias("i"))).alias("p")).select("track", (-F.col("p.i")).alias("peak"))
    jump = F.col("energy") - F.col("prev.energy")
    label = F.when(F.col("id") == F.col("peak"), "peak").when(jump >= 150, "rise").when(jump <= -150, "fall").when(jump.isNull(), "opening").otherwise("steady")
    return c.join(peak, "track").groupBy("track", label.alias("label")).agg(F.count("*").alias("n"))


def sample_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two evenly spaced samples a second (16 to 96) within the track's margins, without those nearer than 200 ms to a cut, and the cuts."""
    c = cuts(spark, sf_dir).select("track", "ms").distinct()
    d = c.groupBy("track").agg(F.max("ms").alias("d")).where("d > 0")
    margin = F.least(F.lit(250).cast("long"), F.floor(F.col("d") / 40).cast("long"))
    n = F.greatest(F.lit(16).cast("long"), F.least(F.lit(96).cast("long"), F.floor(F.col("d") / 500).cast("long")))
    s = d.select("track", margin.alias("m"), n.alias("n"), "d").select("track", "m", "n", "d", F.explode(F.sequence(zero(), F.col("n") - 1)).alias("i"))
    s = s.select("track", (F.col("m") + F.floor((F.col("d") - 2 * F.col("m")) * F.col("i") / (F.col("n") - 1)).cast("long")).alias("ms")).distinct()
    cell = F.floor(F.col("ms") / 200).cast("long")
    near = c.select("track", F.col("ms").alias("cut"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    far = s.withColumn("cell", cell).join(near, ["track", "cell"], "left").groupBy("track", "ms").agg(F.min(F.abs(F.col("ms") - F.col("cut"))).alias("gap")).where("gap is null or gap >= 200")
    return far.select("track", "ms", F.lit("even").alias("kind")).unionByName(c.select("track", "ms", F.lit("cut").alias("kind"))).groupBy("track", "kind").agg(F.count("*").alias("n"), F.sum("ms").alias("total"))


def boundary_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: for each cut the sound within 300 ms of the best kind; lively cuts put other kinds first than calm ones."""
    c = cuts(spark, sf_dir).select("track", "id", F.col("ms").alias("cut"), (F.coalesce("energy", zero()) >= 500).alias("lively"))
    s = sounds(spark, sf_dir).where("type is not null").select("track", "ms", "type", F.col("id").alias("sid"))
    lively, calm = ["drop", "climax", "surge", "accent", "downbeat", "beat"], ["section_boundary", "phrase_boundary", "downbeat", "beat", "onset"]
    place = lambda kinds: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, kinds)), F.col("type")), zero()), F.lit(99).cast("long"))
    cell = F.floor(F.col("ms") / 300).cast("long")
    j = c.withColumn("cell", F.floor(F.col("cut") / 300).cast("long")).join(s.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1))), ["track", "cell"])
    j = j.where(F.abs(F.col("ms") - F.col("cut")) <= 300).withColumn("p", F.when(F.col("lively"), place(lively)).otherwise(place(calm)))
    g = j.groupBy("id").agg(F.min(F.struct("p", F.abs(F.col("ms") - F.col("cut")).alias("d"), "ms", "sid")).alias("m"))
    return g.select(F.col("id").alias("cut_id"), F.col("m.p").alias("priority"), F.col("m.d").alias("apart"), F.col("m.sid").alias("sound"))


def key_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five cuts of highest energy of a track, with their place between its first and last cut."""
    c = cuts(spark, sf_dir).where("energy is not null").select("track", "id", "ms", "energy")
    r = c.groupBy("track").agg(F.min("ms").alias("lo"), F.max("ms").alias("hi"))
    w = Window.partitionBy("track").orderBy(F.desc("energy"), "ms", "id")
    top = c.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5")
    return top.join(r, "track").select("track", "id", "rank", norm.rounded(F.coalesce(F.try_divide(F.col("ms") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))).alias("place"))


def meter_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per track the meter of 3 or 4 and the phase whose beats are strongest on average; of equals the smaller meter and phase."""
    s = nb.running_total(sounds(spark, sf_dir).where("strength is not null and type in ('beat', 'downbeat')"), ["track"], "ms", ["ms", "id"], F.lit(1), TEN_MIN_MS, "n")
    s = s.select("track", "n", "strength", F.explode(F.array(F.lit(3).cast("long"), F.lit(4).cast("long"))).alias("meter"))
    g = s.groupBy("track", "meter", F.pmod(F.col("n") - 1, F.col("meter")).cast("long").alias("phase")).agg(F.sum("strength").alias("s"), F.count("*").alias("k"))
    mean = norm.rounded(F.col("s") / F.col("k"), 3)
    best = g.groupBy("track").agg(F.max(F.struct(mean.alias("mean"), (-F.col("meter")).alias("m"), (-F.col("phase")).alias("p"))).alias("b"))
    return best.select("track", (-F.col("b.m")).alias("meter"), (-F.col("b.p")).alias("phase"), F.col("b.mean").alias("mean"))


def downbeat_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth downbeat of a track, at least two seconds after the last one kept."""
    d = nb.running_total(sounds(spark, sf_dir).where("type = 'downbeat'"), ["track"], "ms", ["ms", "id"], F.lit(1), TEN_MIN_MS, "n").where("n % 4 = 1")
    return sq.thin(d, ["track"], "ms", 2000, 60_000)


def capped_rises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest sounds of a track, as many as a quarter of its seconds and two at least; drops gain 60."""
    s = sounds(spark, sf_dir).where("strength is not null")
    n = s.groupBy("track").agg(F.greatest(F.lit(2).cast("long"), F.ceil(F.max("ms") / 4000)).alias("most"))
    score = F.col("strength") + F.when(F.col("type") == "drop", 60).otherwise(0)
    w = Window.partitionBy("track").orderBy(F.desc("score"), "ms", "id")
    r = s.withColumn("score", score).join(n, "track").withColumn("r", F.row_number().over(w)).where("r <= most")
    return r.groupBy("track").agg(F.count("*").alias("n"), F.sum("score").alias("score"), F.max("ms").alias("last"))


def alignment_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of each alignment among all cuts and among aligned ones, and 0.12 + rate + share over the largest."""
    c = table(spark, sf_dir, "cut_record").select("cut_id", norm.label(F.col("primary_alignment")).alias("type")).distinct()
    n = c.agg(F.count_distinct("cut_id").alias("cuts"), F.count_distinct(F.when(F.col("type").isNotNull(), F.col("cut_id"))).alias("aligned")).withColumn("_k", zero())
    g = c.where("type is not null").groupBy("type").agg(F.count_distinct("cut_id").alias("n")).withColumn("_k", zero()).join(n, "_k")
    g = g.select("type", "n", (0.12 + F.col("n") / F.col("cuts") + F.col("n") / F.col("aligned")).alias("raw"), (F.col("n") / F.col("cuts")).alias("rate"), "_k")
    top = g.groupBy("_k").agg(F.max("raw").alias("top"))
    return g.join(top, "_k").select("type", "n", norm.rounded(F.col("rate")).alias("rate"), norm.rounded(F.col("raw") / F.col("top")).alias("weight"))


def curve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each track's sounds every tenth, the first, the strongest and the twentieth part that changes most, counted."""
    s = nb.with_neighbour(sounds(spark, sf_dir).where("strength is not null"), ["track"], "ms", ["ms", "id"], ["strength"], TEN_MIN_MS)
    s = nb.running_total(s, ["track"], "ms", ["ms", "id"], F.lit(1), TEN_MIN_MS, "n").withColumn("change", F.abs(F.col("strength") - F.coalesce("prev.strength", "strength")))
    # the threshold comes from counts of distinct changes, so no track is sorted
    k = s.groupBy("track", "change").agg(F.count("*").alias("k"))
    w = Window.partitionBy("track").orderBy(F.desc("change"))
    k = k.withColumn("before", F.sum("k").over(w) - F.col("k")).withColumn("all", F.sum("k").over(Window.partitionBy("track")))
    least = k.where(F.col("before") < F.ceil(F.col("all") / 20)).groupBy("track").agg(F.min("change").alias("least"))
    top = s.groupBy("track").agg(F.max(F.struct("strength", (-F.col("ms")).alias("m"), (-F.col("id")).alias("i")))["i"].alias("i")).select("track", (-F.col("i")).alias("top"))
    s = s.join(least, "track").join(top, "track")
    kept = s.where((F.col("n") % 10 == 1) | (F.col("change") >= F.col("least")) | (F.col("id") == F.col("top")))
    return kept.groupBy("track").agg(F.count("*").alias("kept"), F.sum("strength").alias("strength"), F.sum("change").alias("change"))


def beat_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track's beat: the upper median gap of its beats if it is 0.2 to 2 s, else half a second; and where it came from."""
    b = nb.with_neighbour(sounds(spark, sf_dir).where("type in ('beat', 'downbeat')"), ["track"], "ms", ["ms", "id"], ["ms"], TEN_MIN_MS).where("prev is not null")
    from ..operators import stats

    m = stats.upper_median(b.select("track", (F.col("ms") - F.col("prev.ms")).alias("gap")).where("gap > 0"), "gap", ["track"])
    t = sounds(spark, sf_dir).select("track").distinct().join(m, "track", "left")
    ok = F.col("upper_mid").between(200, 2000)
    return t.select("track", F.when(ok, F.col("upper_mid")).otherwise(F.lit(500).cast("long")).alias("period"), F.when(ok, "gaps").otherwise("default").alias("origin"))


def source_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows written as ``ID=a-b`` read back, clipped to the clip's length, valid ones once; clips over 30 s without one get a middle window."""
    u = table(spark, sf_dir, "usage_interval").select(F.concat(F.col("asset_id").cast("string"), F.lit("="), norm.scaled(F.col("source_start")).cast("string"), F.lit("-"), norm.scaled(F.col("source_end")).cast("string")).alias("text"))
    part = lambda i: F.regexp_extract("text", r"^(\d+)=(\d{1,15})-(\d{1,15})$", i).try_cast("long")
    w = u.select(part(1).alias("id"), part(2).alias("a"), part(3).alias("b")).where("id is not null")
    d = F.col("fingerprint.duration_seconds")
    clip = table(spark, sf_dir, "catalog_entry").where(d.isNotNull() & ~F.isnan(d) & (d > 0)).select(F.col("entry_id").alias("id"), norm.scaled(d).alias("d"))
    w = w.join(clip, "id").select("id", "a", F.least("b", "d").alias("b")).where("a < b").distinct()
    rest = clip.where("d > 30000").join(w.select("id").distinct(), "id", "left_anti")
    start = F.greatest(F.lit(2000).cast("long"), F.floor(F.col("d") * 18 / 100).cast("long"))
    rest = rest.select("id", start.alias("a"), F.least(start + 12_000, F.col("d")).alias("b"))
    both = w.withColumn("kind", F.lit("stated")).unionByName(rest.withColumn("kind", F.lit("automatic")))
    return both.select("id", "a", "b", "kind", F.format_string("%d@%d.%03d", "id", F.floor(F.col("a") / 1000).cast("long"), F.col("a") % 1000).alias("window_key"))


def material_sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """per author whether there are enough clips, scenes and passed ones, good enough on average and not of one scene alone."""
    c = table(spark, sf_dir, "catalog_entry").where("author is not null").select("author", "entry_id", F.col("quality.scene_category").alias("scene"), F.coalesce("quality.passed", F.lit(False)).alias("ok"), norm.scaled(F.col("quality.overall_score")).alias("score"))
    by = c.groupBy("author", "scene").agg(F.count("*").alias("n"), F.sum(F.col("ok").cast("long")).alias("ok"), F.sum("score").alias("s"), F.count("score").alias("k"))
    g = by.groupBy("author").agg(F.sum("n").alias("n"), F.count("scene").alias("scenes"), F.sum("ok").alias("ok"), F.sum("s").alias("s"), F.sum("k").alias("k"), F.max(F.when(F.col("scene").isNotNull(), F.col("n"))).alias("top"))
    passed, failed = rules.gate(clips=F.col("n") >= 12, scenes=F.col("scenes") >= 6, passed=F.col("ok") * 2 >= F.col("n"), quality=F.col("s") >= F.col("k") * 550, variety=F.col("top") * 4 <= F.col("n"))
    return g.select("author", "n", "scenes", passed.alias("enough"), F.array_join(failed, ",").alias("failed"))


def clip_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by query words in their tags, length within bounds and earlier score, over what is there, less a penalty for very short ones."""
    c = table(spark, sf_dir, "candidate_batch")
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: w != ""))
    d = F.when(~F.isnan("fingerprint.duration_seconds") & (F.col("fingerprint.duration_seconds") > 0), norm.scaled(F.col("fingerprint.duration_seconds")))
    q, t = words(F.col("search_query")), words(F.col("tags"))
    cover = F.when(F.size(q) > 0, F.size(F.array_intersect(q, F.coalesce(t, F.array().cast("array<string>")))).cast("double") / F.size(q))
    # rises to 5 s, flat to 25 s, falls to 60 s
    fit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), d / 5000.0, (60_000 - d) / 35_000.0))
    score = rules.available_score([(cover, 0.5), (F.when(d.isNotNull(), fit), 0.2), (F.when(~F.isnan("pre_score"), F.col("pre_score")), 0.3)], ((d < 2000).cast("double"), 0.1))
    return c.select("candidate_id", norm.rounded(score, 3).alias("score"))


def lazy_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best entries of an old record time get a new digest of what they are selected by; the rest stay as they are."""
    c = table(spark, sf_dir, "catalog_entry").select("entry_id", F.coalesce(norm.scaled(F.col("quality.overall_score")), zero()).alias("score"), F.col("author"), F.unix_micros(F.col("recorded_at").cast("timestamp")).alias("us"))
    cut = c.agg(F.min("us").alias("lo"), F.max("us").alias("hi")).select((F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2).cast("long")).alias("mid"), zero().alias("_k"))
    c = c.withColumn("_k", zero()).join(F.broadcast(cut), "_k").withColumn("old", F.coalesce(F.col("us") < F.col("mid"), F.lit(True)))
    todo = c.where("old").orderBy(F.desc("score"), "entry_id").limit(50).select("entry_id", F.lit(True).alias("todo"))
    digest = F.sha2(F.concat_ws("|", F.coalesce("author", F.lit("")), F.col("score").cast("string")), 256)
    r = c.join(F.broadcast(todo), "entry_id", "left").select("entry_id", F.when(F.col("todo"), digest).alias("digest"), F.when(F.col("todo"), "migrated").when(F.col("old"), "stale").otherwise("current").alias("state"))
    return r.groupBy("state").agg(F.count("*").alias("n"), F.min("digest").alias("first"))


def bounded_fine_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2, Q8: the best clips of each author, three for each passed one and two for each scene, 16 to 64 if there are so many."""
    c = table(spark, sf_dir, "catalog_entry").where("author is not null").select("author", "entry_id", F.col("quality.scene_category").alias("scene"), F.coalesce("quality.passed", F.lit(False)).alias("ok"), F.coalesce(norm.scaled(F.col("quality.overall_score")), zero()).alias("score"))
    scenes = c.where("scene is not null").select("author", "scene").distinct().groupBy("author").agg(F.count("*").alias("scenes"))
    size = c.groupBy("author").agg(F.sum(F.col("ok").cast("long")).alias("k")).join(scenes, "author", "left")
    most = F.least(F.lit(64).cast("long"), F.greatest(F.lit(16).cast("long"), F.col("k") * 3, F.coalesce("scenes", zero()) * 2))
    # a window group limit keeps 64 at most before the sizes are known
    w = Window.partitionBy("author").orderBy(F.desc("score"), "entry_id")
    top = c.withColumn("r", F.row_number().over(w).cast("long")).where("r <= 64").join(size.select("author", most.alias("most")), "author").where("r <= most")
    return top.groupBy("author").agg(F.count("*").alias("n"), F.sum("score").alias("score"), F.max("r").alias("last"))


QUERIES = {f.__name__: f for f in (
    keyword_category, keyword_risk, region_rollup, corpus_rollup, sequence_consistency, merged_boundaries, section_labels, sample_times, boundary_by_priority, key_shots, meter_estimate,
    downbeat_phrases, capped_rises, alignment_weights, curve_points, beat_period, source_windows, material_sufficiency, clip_relevance, lazy_migration, bounded_fine_set,
)}

_R = "floor(({0}) * {1}.0 + 0.5) / {1}.0"
_RULES = """r AS (SELECT DISTINCT ascii(subject) AS priority, subject AS category, needle, CAST(length(needle) AS BIGINT) AS weight FROM (SELECT subject, unnest(regexp_split_to_array(lower(description), '[^a-z]+')) AS needle FROM subject_area) WHERE length(needle) >= 5)"""
_DOWN = f"(SELECT track, ms, id, row_number() OVER (PARTITION BY track ORDER BY ms, id) AS n FROM {SOUNDS} WHERE type = 'downbeat')"
SQL = {
    "keyword_category": f"""WITH {_RULES}, m AS (SELECT d.doc_id, arg_min(r.category, (r.priority, r.category)) AS category FROM documents d JOIN r ON contains(lower(concat_ws(' ', d.title, d.text)), r.needle) GROUP BY 1)
      SELECT m.category, count(*) AS n FROM documents d LEFT JOIN m USING (doc_id) GROUP BY 1""",
    "keyword_risk": f"""WITH {_RULES} SELECT doc_id, risk FROM (SELECT d.doc_id, greatest(coalesce(max(r.weight), 0), coalesce(any_value(d.n_chars) // 1000, 0)) AS risk FROM documents d LEFT JOIN r ON contains(lower(d.text), r.needle) GROUP BY 1) WHERE risk > 0""",
    "region_rollup": f"""WITH g AS (SELECT track, type, count(*) AS n, quantile_cont(ms, 0.5) AS c, quantile_cont(strength, 0.1) AS a, quantile_cont(strength, 0.9) AS b, max(strength) AS top, sum(strength)::BIGINT AS s, sum(strength * strength)::BIGINT AS ss
        FROM {SOUNDS} WHERE strength IS NOT NULL AND type IS NOT NULL GROUP BY 1, 2)
      SELECT track, type, n, {_R.format("c", 10)} AS centre, {_R.format("a", 10)} AS p10, {_R.format("b", 10)} AS p90, top, {_R.format("sqrt((n * ss - s * s)::DOUBLE / (n * n))", 100)} AS spread FROM g""",
    "corpus_rollup": f"""WITH c AS (SELECT * FROM {CUTS}), t AS (SELECT track, count(*) AS n, max(ms) - min(ms) AS ms FROM c GROUP BY 1 HAVING max(ms) - min(ms) > 0),
      a AS (SELECT count(*) AS tracks, sum(n)::BIGINT AS cuts, sum(ms)::BIGINT AS ms, quantile_cont(n, 0.5) AS mid FROM t), e AS (SELECT sum(energy)::BIGINT AS e, count(energy) AS ne FROM c),
      b AS (SELECT band FROM c WHERE band IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, band DESC LIMIT 1), r AS (SELECT role FROM c WHERE role IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, role DESC LIMIT 1)
      SELECT tracks, cuts, {_R.format("ms / 60000.0", 100)} AS minutes, {_R.format("cuts * 60000.0 / ms", 100)} AS per_minute, {_R.format("e / ne", 100)} AS energy, {_R.format("mid", 10)} AS median_cuts, band, role,
        CASE WHEN cuts * 60000.0 / ms >= 30 THEN 'fast' WHEN cuts * 60000.0 / ms >= 12 THEN 'medium' ELSE 'slow' END AS pace FROM a, e, b, r""",
    "sequence_consistency": f"""WITH c AS (SELECT *, lag(energy) OVER w AS pe, lag(band) OVER w AS pb, lag(role) OVER w AS pr, row_number() OVER w AS rn FROM {CUTS} WINDOW w AS (PARTITION BY track ORDER BY ms, id)),
      d AS (SELECT track, greatest(0.0, 1.0 - abs(energy - pe) / 500.0) + 0 * energy * pe AS e, (band = pb)::INT AS b, (role = pr)::INT AS r FROM c WHERE rn > 1),
      p AS (SELECT track, floor(greatest(0.0, least(1.0, (coalesce(e * 0.5::DOUBLE, 0) + coalesce(b * 0.2::DOUBLE, 0) + coalesce(r * 0.3::DOUBLE, 0)) / ((CASE WHEN e IS NULL THEN 0 ELSE 0.5::DOUBLE END) + (CASE WHEN b IS NULL THEN 0 ELSE 0.2::DOUBLE END) + (CASE WHEN r IS NULL THEN 0 ELSE 0.3::DOUBLE END)))) * 1000.0 + 0.5)::BIGINT AS score FROM d WHERE NOT (e IS NULL AND b IS NULL AND r IS NULL))
      SELECT track, count(*) AS pairs, {_R.format("sum(score) / count(*)", 100)} AS score, count_if(score < 350) AS poor, count_if(score < 350) > ceil(count(*) * 18 / 100) AS severe FROM p GROUP BY 1""",
    "merged_boundaries": f"""WITH RECURSIVE s AS (SELECT track, ms, max(strength) AS v, row_number() OVER (PARTITION BY track ORDER BY ms) AS n FROM {SOUNDS} WHERE strength IS NOT NULL AND type IN ('downbeat', 'phrase_boundary', 'section_boundary') GROUP BY 1, 2),
      w AS (SELECT track, n, ms AS kept, v, 1::BIGINT AS no FROM s WHERE n = 1
        UNION ALL SELECT s.track, s.n, CASE WHEN s.ms - w.kept >= 1300 OR s.v > w.v THEN s.ms ELSE w.kept END, CASE WHEN s.ms - w.kept >= 1300 OR s.v > w.v THEN s.v ELSE w.v END, w.no + (s.ms - w.kept >= 1300)::BIGINT FROM w JOIN s ON s.track = w.track AND s.n = w.n + 1)
      SELECT track, CAST(kept // 60000 AS BIGINT) AS "window", kept FROM (SELECT track, no, arg_max(kept, n) AS kept FROM w GROUP BY 1, 2)""",
    "section_labels": f"""WITH c AS (SELECT track, id, energy, energy - lag(energy) OVER (PARTITION BY track ORDER BY ms, id) AS j, row_number() OVER (PARTITION BY track ORDER BY energy DESC, ms, id) AS k FROM {CUTS} WHERE energy IS NOT NULL)
      SELECT track, CASE WHEN k = 1 THEN 'peak' WHEN j >= 150 THEN 'rise' WHEN j <= -150 THEN 'fall' WHEN j IS NULL THEN 'opening' ELSE 'steady' END AS label, count(*) AS n FROM c GROUP BY 1, 2""",
    "sample_times": f"""WITH c AS (SELECT DISTINCT track, ms FROM {CUTS}), d AS (SELECT track, max(ms) AS d, least(250, max(ms) // 40) AS m, greatest(16, least(96, max(ms) // 500)) AS n FROM c GROUP BY 1 HAVING max(ms) > 0),
      s AS (SELECT DISTINCT track, m + CAST(floor((d - 2 * m) * i / (n - 1)) AS BIGINT) AS ms FROM (SELECT *, unnest(range(n)) AS i FROM d)),
      u AS (SELECT track, ms, 'even' AS kind FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.track = s.track AND abs(c.ms - s.ms) < 200) UNION ALL SELECT track, ms, 'cut' FROM c)
      SELECT track, kind, count(*) AS n, sum(ms)::BIGINT AS total FROM u GROUP BY 1, 2""",
    "boundary_by_priority": f"""WITH c AS (SELECT track, id, ms AS cut, CASE WHEN coalesce(energy, 0) >= 500 THEN ['drop', 'climax', 'surge', 'accent', 'downbeat', 'beat'] ELSE ['section_boundary', 'phrase_boundary', 'downbeat', 'beat', 'onset'] END AS kinds FROM {CUTS}),
      j AS (SELECT c.id, coalesce(nullif(list_position(kinds, s.type), 0), 99) AS p, abs(s.ms - cut) AS d, s.ms, s.id AS sid FROM c JOIN {SOUNDS} s ON s.track = c.track AND s.type IS NOT NULL AND s.ms BETWEEN cut - 300 AND cut + 300)
      SELECT id AS cut_id, p::BIGINT AS priority, d AS apart, sid AS sound FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p, d, ms, sid) AS k FROM j) WHERE k = 1""",
    "key_shots": f"""WITH c AS (SELECT track, id, ms, min(ms) OVER (PARTITION BY track) AS lo, max(ms) OVER (PARTITION BY track) AS hi, row_number() OVER (PARTITION BY track ORDER BY energy DESC, ms, id) AS rank FROM {CUTS} WHERE energy IS NOT NULL)
      SELECT track, id, rank, {_R.format("CASE WHEN hi > lo THEN (ms - lo) / (hi - lo) ELSE 0.0 END", 10000)} AS place FROM c WHERE rank <= 5""",
    "meter_estimate": f"""WITH s AS (SELECT track, strength, row_number() OVER (PARTITION BY track ORDER BY ms, id) - 1 AS n FROM {SOUNDS} WHERE strength IS NOT NULL AND type IN ('beat', 'downbeat')),
      g AS (SELECT track, meter, n % meter AS phase, {_R.format("sum(strength) / count(*)", 1000)} AS mean FROM s, (VALUES (3::BIGINT), (4::BIGINT)) v(meter) GROUP BY 1, 2, 3)
      SELECT track, meter, phase, mean FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY mean DESC, meter, phase) AS k FROM g) WHERE k = 1""",
    "downbeat_phrases": f"""WITH RECURSIVE s AS (SELECT DISTINCT track, ms FROM {_DOWN} WHERE n % 4 = 1), r AS (SELECT track, min(ms) AS kept FROM s GROUP BY 1
        UNION ALL SELECT r.track, min(s.ms) FROM r JOIN s ON s.track = r.track AND s.ms >= r.kept + 2000 GROUP BY 1)
      SELECT track, CAST(kept // 60000 AS BIGINT) AS "window", kept FROM r""",
    "capped_rises": f"""WITH s AS (SELECT *, strength + CASE WHEN type = 'drop' THEN 60 ELSE 0 END AS score, greatest(2, ceil(max(ms) OVER (PARTITION BY track) / 4000)) AS most FROM {SOUNDS} WHERE strength IS NOT NULL)
      SELECT track, count(*) AS n, sum(score)::BIGINT AS score, max(ms) AS last FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY score DESC, ms, id) AS r FROM s) WHERE r <= most GROUP BY 1""",
    "alignment_weights": f"""WITH c AS (SELECT DISTINCT cut_id, CASE WHEN lower(trim(primary_alignment)) NOT IN ('', 'unknown', 'unresolved', 'general', 'none', 'n/a') THEN lower(trim(primary_alignment)) END AS type FROM cut_record),
      n AS (SELECT count(DISTINCT cut_id) AS cuts, count(DISTINCT CASE WHEN type IS NOT NULL THEN cut_id END) AS aligned FROM c), g AS (SELECT type, count(DISTINCT cut_id) AS n, any_value(cuts) AS cuts, any_value(aligned) AS aligned FROM c, n WHERE type IS NOT NULL GROUP BY 1)
      SELECT type, n, {_R.format("n / cuts", 10000)} AS rate, {_R.format("(0.12::DOUBLE + n / cuts + n / aligned) / max(0.12::DOUBLE + n / cuts + n / aligned) OVER ()", 10000)} AS weight FROM g""",
    "curve_points": f"""WITH s AS (SELECT track, id, ms, strength, row_number() OVER w AS n, abs(strength - coalesce(lag(strength) OVER w, strength)) AS change FROM {SOUNDS} WHERE strength IS NOT NULL WINDOW w AS (PARTITION BY track ORDER BY ms, id)),
      t AS (SELECT *, rank() OVER (PARTITION BY track ORDER BY change DESC) - 1 AS before, count(*) OVER (PARTITION BY track) AS k, row_number() OVER (PARTITION BY track ORDER BY strength DESC, ms, id) AS top FROM s)
      SELECT track, count(*) AS kept, sum(strength)::BIGINT AS strength, sum(change)::BIGINT AS change FROM t WHERE n % 10 = 1 OR before < ceil(k / 20) OR top = 1 GROUP BY 1""",
    "beat_period": f"""WITH b AS (SELECT track, ms - lag(ms) OVER (PARTITION BY track ORDER BY ms, id) AS gap FROM {SOUNDS} WHERE type IN ('beat', 'downbeat')), o AS (SELECT track, gap, row_number() OVER (PARTITION BY track ORDER BY gap) - 1 AS i, count(*) OVER (PARTITION BY track) AS n FROM b WHERE gap > 0),
      m AS (SELECT track, gap FROM o WHERE i = n // 2)
      SELECT t.track, CASE WHEN gap BETWEEN 200 AND 2000 THEN gap ELSE 500 END AS period, CASE WHEN gap BETWEEN 200 AND 2000 THEN 'gaps' ELSE 'default' END AS origin FROM (SELECT DISTINCT track FROM {SOUNDS}) t LEFT JOIN m USING (track)""",
    "source_windows": """WITH clip AS (SELECT entry_id AS id, CAST(floor(fingerprint.duration_seconds * 1000.0 + 0.5) AS BIGINT) AS d FROM catalog_entry WHERE fingerprint.duration_seconds > 0 AND NOT isnan(fingerprint.duration_seconds)),
      u AS (SELECT asset_id AS id, CAST(floor(source_start * 1000.0 + 0.5) AS BIGINT) AS a, CAST(floor(source_end * 1000.0 + 0.5) AS BIGINT) AS b FROM usage_interval WHERE isfinite(source_start) AND isfinite(source_end)),
      w AS (SELECT DISTINCT id, a, least(b, d) AS b FROM u JOIN clip USING (id) WHERE a >= 0 AND b >= 0 AND a < least(b, d)),
      r AS (SELECT id, greatest(2000, d * 18 // 100) AS a, d FROM clip WHERE d > 30000 AND id NOT IN (SELECT id FROM w)),
      x AS (SELECT id, a, b, 'stated' AS kind FROM w UNION ALL SELECT id, a, least(a + 12000, d), 'automatic' FROM r)
      SELECT id, a, b, kind, printf('%d@%d.%03d', id, a // 1000, a % 1000) AS window_key FROM x""",
    "material_sufficiency": """WITH c AS (SELECT author, quality.scene_category AS scene, coalesce(quality.passed, false) AS ok, CAST(floor(quality.overall_score * 1000.0 + 0.5) AS BIGINT) AS score FROM catalog_entry WHERE author IS NOT NULL),
      b AS (SELECT author, scene, count(*) AS n, count_if(ok) AS ok, sum(score) AS s, count(score) AS k FROM c GROUP BY 1, 2),
      g AS (SELECT author, sum(n)::BIGINT AS n, count(scene) AS scenes, sum(ok) AS ok, sum(s) AS s, sum(k) AS k, max(CASE WHEN scene IS NOT NULL THEN n END) AS top FROM b GROUP BY 1),
      f AS (SELECT author, n, scenes, concat_ws(',', CASE WHEN n < 12 THEN 'clips' END, CASE WHEN scenes < 6 THEN 'scenes' END, CASE WHEN ok * 2 < n THEN 'passed' END, CASE WHEN NOT coalesce(s >= k * 550, false) THEN 'quality' END, CASE WHEN NOT coalesce(top * 4 <= n, false) THEN 'variety' END) AS failed FROM g)
      SELECT author, n, scenes, failed = '' AS enough, failed FROM f""",
    "clip_relevance": """WITH c AS (SELECT candidate_id, list_distinct(list_filter(regexp_split_to_array(lower(search_query), '[^a-z0-9]+'), lambda w: w <> '')) AS q, coalesce(list_filter(regexp_split_to_array(lower(tags), '[^a-z0-9]+'), lambda w: w <> ''), []) AS t,
        CASE WHEN fingerprint.duration_seconds > 0 AND NOT isnan(fingerprint.duration_seconds) THEN CAST(floor(fingerprint.duration_seconds * 1000.0 + 0.5) AS BIGINT) END AS d, CASE WHEN NOT isnan(pre_score) THEN pre_score END AS s FROM candidate_batch),
      p AS (SELECT candidate_id, CASE WHEN len(q) > 0 THEN len(list_filter(q, lambda w: list_contains(t, w))) / len(q) END AS a, CASE WHEN d IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, d / 5000.0::DOUBLE, (60000 - d) / 35000.0::DOUBLE)) END AS b, s, d FROM c)
      SELECT candidate_id, floor(greatest(0.0, least(1.0, (coalesce(a * 0.5::DOUBLE, 0) + coalesce(b * 0.2::DOUBLE, 0) + coalesce(s * 0.3::DOUBLE, 0)) / nullif((CASE WHEN a IS NULL THEN 0 ELSE 0.5::DOUBLE END) + (CASE WHEN b IS NULL THEN 0 ELSE 0.2::DOUBLE END) + (CASE WHEN s IS NULL THEN 0 ELSE 0.3::DOUBLE END), 0) - CASE WHEN d < 2000 THEN 0.1::DOUBLE ELSE 0 END)) * 1000.0 + 0.5) / 1000.0 AS score FROM p""",
    "bounded_fine_set": """WITH c AS (SELECT author, entry_id, quality.scene_category AS scene, coalesce(quality.passed, false) AS ok, coalesce(CAST(floor(quality.overall_score * 1000.0 + 0.5) AS BIGINT), 0) AS score FROM catalog_entry WHERE author IS NOT NULL),
      s AS (SELECT author, least(64, greatest(16, count_if(ok) * 3, count(DISTINCT scene) * 2)) AS most FROM c GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY score DESC, entry_id) AS r FROM c)
      SELECT author, count(*) AS n, sum(score)::BIGINT AS score, max(r) AS last FROM r JOIN s USING (author) WHERE r <= most GROUP BY 1""",
    "lazy_migration": """WITH c AS (SELECT entry_id, coalesce(CAST(floor(quality.overall_score * 1000.0 + 0.5) AS BIGINT), 0) AS score, author, epoch_us(recorded_at) AS us FROM catalog_entry),
      o AS (SELECT *, coalesce(us < (SELECT min(us) + (max(us) - min(us)) // 2 FROM c), true) AS old FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY old ORDER BY score DESC, entry_id) AS k FROM o),
      x AS (SELECT CASE WHEN old AND k <= 50 THEN 'migrated' WHEN old THEN 'stale' ELSE 'current' END AS state, CASE WHEN old AND k <= 50 THEN sha256(concat_ws('|', coalesce(author, ''), score::VARCHAR)) END AS digest FROM r)
      SELECT state, count(*) AS n, min(digest) AS first FROM x GROUP BY 1""",
}
