"""Queries of the problems on large collections, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, spread, write_out
from ..sources.tables import table
from . import fingerprints, graphindex, leakage, lshforest, mixing, nearest, subjects


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of catalog entries in one group of alike entries."""
    rec = fingerprints.prepared(table(spark, sf_dir, "catalog_entry"), "entry_id")
    return lshforest.group_pairs(lshforest.groups(rec)).select(F.col("a").alias("entry_id_a"), F.col("b").alias("entry_id_b"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per catalog entry with its group; entries alike to none are groups of their own."""
    entries = table(spark, sf_dir, "catalog_entry")
    found = lshforest.groups(fingerprints.prepared(entries, "entry_id"))
    return entries.select("entry_id").join(found.withColumnRenamed("id", "entry_id"), "entry_id", "left").select("entry_id", F.coalesce("comp", "entry_id").alias("group_id"))


def _batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Catalog and candidates with ``pid``, the provider id or NULL."""

    def pid(df: DataFrame) -> DataFrame:
        return df.withColumn("pid", F.when(F.col("pixabay_id") != 0, F.col("pixabay_id")))

    cat = fingerprints.prepared(pid(table(spark, sf_dir, "catalog_entry")), "entry_id", extra=("pid",))
    cand = fingerprints.prepared(pid(table(spark, sf_dir, "candidate_batch")), "candidate_id", extra=("pid", "batch_no"))
    return cat, cand


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which candidates repeat which accepted records, batch by batch."""
    return graphindex.repeats(*_batches(spark, sf_dir))


def p2_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``p2_found`` by two runs on one index: all batches but the newest, then the newest, then compaction."""
    cat, cand = _batches(spark, sf_dir)
    path = scratch_path(spark, "p2-index")
    newest = cand.agg(F.max("batch_no")).first()[0]
    late = F.coalesce(F.col("batch_no") == F.lit(newest), F.lit(False))
    before = graphindex.Index(spark, path).create(cat).append(cand.where(~late))
    index = graphindex.Index(spark, path)
    rows = before.unionByName(index.append(cand.where(late)))
    index.compact()
    return rows


def p2_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each segment of the index: values, sorted orders that give entries, recall of the walk and of its entries alone."""
    cat, cand = _batches(spark, sf_dir)
    index = graphindex.Index(spark, scratch_path(spark, "p2-index")).create(cat)
    index.append(cand)
    return index.shards()


def _cuts_and_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key = F.when(F.col("track_key") != "", F.col("track_key")).alias("entity")
    cuts = table(spark, sf_dir, "cut_record").select(
        key, F.col("cut_id").alias("id"), nearest.ticks(F.col("time_seconds")).alias("tick"), nearest.tolerance_ticks(F.col("tolerance_seconds")).alias("tolerance")
    )
    events = table(spark, sf_dir, "music_event").select(key, F.col("event_id").alias("id"), nearest.ticks(F.col("time_seconds")).alias("tick"))
    return cuts, events


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest event of each cut within its tolerance."""
    cuts, events = _cuts_and_events(spark, sf_dir)
    return nearest.nearest_in_time(cuts, events).select(F.col("left_id").alias("cut_id"), F.col("right_id").alias("event_id"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item, with the item."""
    return leakage.leaks(_texts(spark, sf_dir), table(spark, sf_dir, "eval_item")).select("doc_id", "item_id").distinct()


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: documents with a passage of it, documents that hold all of it with small edits (similarity of 0.8 or more) and no passage, and places."""
    found = leakage.leaks(_texts(spark, sf_dir), table(spark, sf_dir, "eval_item"), least=0.8)
    near = (F.col("windows") == 0) & F.col("similarity").isNotNull()
    return found.groupBy("item_id").agg(
        F.count_distinct("doc_id").alias("docs"), F.count_distinct(F.when(F.col("windows") > 0, F.col("doc_id"))).alias("exact_docs"), F.count_distinct(F.when(near, F.col("doc_id"))).alias("near_docs"), F.sum("windows").alias("windows")
    )


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.token_counts(_texts(spark, sf_dir).drop("lang"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of the mix that fall short of their share even at their cap: those that the water-filling clamps first."""
    sizes = mixing.source_sizes(_counted(spark, sf_dir), table(spark, sf_dir, "mix_target"))
    return mixing.short_sources(spark, mixing.water_fill(mixing.plan_rows(sizes)))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix: each document that occurs in it, and how often."""
    counted = write_out(_counted(spark, sf_dir), "p8-counted")
    sizes = mixing.source_sizes(counted, table(spark, sf_dir, "mix_target"))
    return mixing.sample(counted, mixing.water_fill(mixing.plan_rows(sizes)).repeats).select("doc_id", F.col("s").alias("source"), "n_tokens", "times")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached by the mix, source by source."""
    counted = write_out(_counted(spark, sf_dir), "p8-counted")
    sizes = write_out(mixing.source_sizes(counted, table(spark, sf_dir, "mix_target")), "p8-sizes")
    fill = mixing.water_fill(mixing.plan_rows(sizes))
    return mixing.report(mixing.sample(counted, fill.repeats), sizes, fill)


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = leakage.item_blocks(table(spark, sf_dir, "eval_item"), "item_id", "question")
    feat, model = subjects.fit(_texts(spark, sf_dir), table(spark, sf_dir, "subject_label"), table(spark, sf_dir, "subject_area"), items)
    return subjects.assigned(feat, model)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject areas of the documents that have no hand label."""
    labelled = table(spark, sf_dir, "subject_label").select("doc_id").where("doc_id is not null").distinct()
    return _subjects(spark, sf_dir).join(labelled, "doc_id", "left_anti").select("doc_id", "subject")


def p9_makeup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Make-up of the corpus by area: documents and sentences of each."""
    return _subjects(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("docs"), F.sum("sentences").alias("sentences"))


QUERIES = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p2_appended": p2_appended,
    "p2_recall": p2_recall,
    "p3_found": p3_found,
    "p7_found": p7_found,
    "p7_report": p7_report,
    "p8_found": p8_found,
    "p8_mix": p8_mix,
    "p8_report": p8_report,
    "p9_found": p9_found,
    "p9_makeup": p9_makeup,
}
