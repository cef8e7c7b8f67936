"""Topics over content units: statistics, overlaps, layout, detail and the validity of references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.operators.projection import with_rank


def stats(members: DataFrame, observed: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Units, pages and domains of each topic, and its display size. members(topic_id, canonical_unit_id);
    observed(canonical_unit_id, page_instance_id, observed_at, domain); times compare as strings, both ends in."""
    seen = observed
    if start is not None:
        seen = seen.where(F.col("observed_at") >= start)
    if end is not None:
        seen = seen.where(F.col("observed_at") <= end)
    links = members.select("topic_id", "canonical_unit_id").distinct()
    units = links.groupBy("topic_id").agg(F.count("*").alias("n_units"))
    places = links.join(seen, "canonical_unit_id").groupBy("topic_id").agg(F.count_distinct("page_instance_id").alias("n_pages"), F.count_distinct("domain").alias("n_domains"))
    out = units.join(places, "topic_id", "left").select("topic_id", "n_units", F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.coalesce("n_domains", F.lit(0)).alias("n_domains"))
    return out.withColumn("display_size", F.least(F.lit(72), F.greatest(F.lit(18), F.round(18 + F.sqrt("n_units") * 14))).cast("int"))


def relations(members: DataFrame) -> DataFrame:
    """(topic_a, topic_b, shared, jaccard) of topics that share units: counted by way of the shared unit, each unit's
    topics being few, never topic against topic."""
    links = members.select("topic_id", "canonical_unit_id").distinct()
    size = links.groupBy("topic_id").agg(F.count("*").alias("n"))
    a, b = links.withColumnRenamed("topic_id", "topic_a"), links.withColumnRenamed("topic_id", "topic_b")
    shared = a.join(b, "canonical_unit_id").where("topic_a < topic_b").groupBy("topic_a", "topic_b").agg(F.count("*").alias("shared"))
    both = shared.join(size.select(F.col("topic_id").alias("topic_a"), F.col("n").alias("n_a")), "topic_a").join(size.select(F.col("topic_id").alias("topic_b"), F.col("n").alias("n_b")), "topic_b")
    jaccard = F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))
    return both.select("topic_a", "topic_b", "shared", F.round(jaccard, 6).alias("jaccard"), F.greatest(F.lit(1), F.round(jaccard * 4)).cast("int").alias("width"))


def layout(sized: DataFrame, width: int = 960, height: int = 640) -> DataFrame:
    """Grid places of topics in id order, each centred in its cell; no task holds all topics."""
    width, height = max(240, width), max(180, height)
    ranked = with_rank(sized, ["topic_id"], "i")
    df = ranked.join(sized.agg(F.count("*").alias("n"))).withColumn("i", F.col("i") - 1).withColumn("columns", F.greatest(F.lit(1), F.floor(F.sqrt("n"))))
    df = df.withColumn("rows", F.ceil(F.col("n") / F.col("columns"))).withColumn("cell_w", F.lit(width) / F.col("columns")).withColumn("cell_h", F.lit(height) / F.col("rows"))
    x, y = ((F.col("i") % F.col("columns")) + 0.5) * F.col("cell_w"), (F.floor(F.col("i") / F.col("columns")) + 0.5) * F.col("cell_h")
    w = F.least(F.col("cell_w") * 0.86, F.greatest(F.lit(90), F.col("display_size") * 2.2))
    h = F.least(F.col("cell_h") * 0.72, F.greatest(F.lit(42), F.col("display_size") * 0.9))
    return df.select("topic_id", F.round(x).cast("int").alias("x"), F.round(y).cast("int").alias("y"), F.round(w).cast("int").alias("w"), F.round(h).cast("int").alias("h"))


def dangling(refs: DataFrame, ref_col: str, known: DataFrame, known_col: str) -> DataFrame:
    """References to nothing."""
    return refs.join(known.select(F.col(known_col).alias(ref_col)).distinct(), ref_col, "left_anti")


def detail(members: DataFrame, evidence: DataFrame, blobs: DataFrame) -> DataFrame:
    """(topic_id, canonical_unit_id, block_id, ordinal, chars): the evidence behind each topic; a missing text is empty."""
    rows = members.select("topic_id", "canonical_unit_id").distinct().join(evidence, "canonical_unit_id")
    text = blobs.dropDuplicates(["id"]).select(F.col("id").alias("evidence_blob_id"), F.length("text").alias("chars"))
    return rows.join(text, "evidence_blob_id", "left").select("topic_id", "canonical_unit_id", "block_id", "ordinal", F.coalesce("chars", F.lit(0)).alias("chars"))
