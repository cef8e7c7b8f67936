"""Content units: identities, versions, evidence links, merges and what deletion leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.functions import text as X
from pagestrata.session import written


def once(rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.dropDuplicates([key])


def identity_strings(units: DataFrame) -> DataFrame:
    """(id, identity): the string that a unit's id is made from."""
    k = F.col("identity_key")
    text = (
        F.when(k["kind"] == "permalink", F.concat_ws("|", F.lit("permalink"), k["url"], F.lit("")))
        .when(k["kind"] == "anchor", F.concat_ws("|", F.lit("anchor"), k["origin"], k["canonical_page_url"], k["stable_anchor"], F.lit("")))
        .otherwise(F.lit("unkeyed|"))
    )
    return once(units).select("id", text.alias("identity"), k["kind"].alias("kind"))


def unit_ids(units: DataFrame) -> DataFrame:
    """(id, derived_id): ids as they follow from the identities."""
    return identity_strings(units).withColumn("derived_id", X.short_id("unit-", F.col("identity"))).select("id", "kind", "derived_id")


def evidence(units: DataFrame) -> DataFrame:
    """One row per evidence block of each unit observation."""
    return once(units).select(F.col("id").alias("unit_observation_id"), "canonical_unit_id", "session_id", "page_instance_id", "observed_at", F.explode("evidence_blocks").alias("b")).select(
        "unit_observation_id", "canonical_unit_id", "session_id", "page_instance_id", "observed_at", F.col("b.id").alias("block_id"), "b.evidence_blob_id", "b.state_version", "b.ordinal"
    )


def evidence_block_ids(units: DataFrame) -> DataFrame:
    """(unit_observation_id, ordinal, text_hash, derived_id): block ids as they follow from observation, text and ordinal."""
    each = once(units).select(F.col("id").alias("unit_observation_id"), F.explode("evidence_blocks").alias("b")).select("unit_observation_id", "b.ordinal", "b.text_hash")
    return each.withColumn("derived_id", X.short_id("ueb-", F.concat_ws("|", "unit_observation_id", "text_hash", F.col("ordinal").cast("string"))))


def _versioned(units: DataFrame, canonical: DataFrame) -> DataFrame:
    """Observations in full of known units, with their version."""
    full = once(units).where("capture_extent = 'full'").join(canonical.select(F.col("id").alias("canonical_unit_id")).distinct(), "canonical_unit_id", "left_semi")
    return full.withColumn("version_id", X.short_id("uver-", F.concat_ws("|", "canonical_unit_id", "normalizer_version", "stable_content_fingerprint")))


def versions(units: DataFrame, canonical: DataFrame) -> DataFrame:
    """Versions of known units that were observed in full: one per normaliser and stable fingerprint."""
    return _versioned(units, canonical).groupBy("version_id", "canonical_unit_id", "normalizer_version", "stable_content_fingerprint").agg(
        F.count("*").alias("n_observations"), F.min_by("id", F.struct("observed_at", "id")).alias("first_observation")
    )


def version_observations(units: DataFrame, canonical: DataFrame) -> DataFrame:
    """(version_id, unit_observation_id, linked_at): the observations that support each version."""
    return _versioned(units, canonical).select("version_id", F.col("id").alias("unit_observation_id"), F.col("observed_at").alias("linked_at"))


def version_links(units: DataFrame, canonical: DataFrame) -> DataFrame:
    """(version_id, evidence_block_id): the evidence blocks of each version."""
    return _versioned(units, canonical).select("version_id", F.explode("evidence_blocks.id").alias("evidence_block_id"))


def latest(units: DataFrame) -> DataFrame:
    """The latest observation of each unit, by time and id as one string."""
    key = F.concat_ws("|", "observed_at", "id")
    return once(units).groupBy("canonical_unit_id").agg(F.max_by(F.struct("id", "observed_at", "capture_extent", "confidence"), key).alias("o"), F.count("*").alias("n_observations")).select("canonical_unit_id", "n_observations", F.col("o.id").alias("observation_id"), "o.observed_at", "o.capture_extent", "o.confidence")


def across_snapshots(units: DataFrame) -> DataFrame:
    """Observations that repeat one unit's stable content on one page, as one, first kept."""
    key = ["session_id", "page_instance_id", "canonical_unit_id", "stable_content_fingerprint", "capture_extent"]
    return once(units).groupBy(*key).agg(F.min_by("id", F.struct("observed_at", "id")).alias("kept_id"), F.count("*").alias("n_links"))


def occurrences(units: DataFrame) -> DataFrame:
    """Repeats of identical raw content on a page."""
    return once(units).groupBy("page_instance_id", "raw_fingerprint").agg(F.count("*").alias("n"), (F.count("*") - 1).alias("last_occurrence")).where("n > 1")


def resolved(units: DataFrame) -> DataFrame:
    """(id, root): where each unit's merges lead; null for cycles and unknown targets. Links are doubled twice a round, so a
    chain of n merges takes half of log2 n rounds, most chains one."""
    own = once(units).select("id", F.col("merged_into").alias("next"))
    state = own.select("id", F.when(F.col("next").isNull(), F.col("id")).alias("root"), "next")

    def doubled(links: DataFrame) -> DataFrame:
        far = links.select(F.col("id").alias("next"), F.col("root").alias("far_root"), F.col("next").alias("far"))
        both = links.join(far, "next", "left")
        return both.select("id", F.coalesce("root", "far_root").alias("root"), F.when(F.coalesce("root", "far_root").isNull(), F.col("far")).alias("next"))

    state, before = written(doubled(doubled(state)), "merge-state"), None
    done = state.where("root is not null").select("id", "root")
    while True:
        left = state.where("root is null and next is not null")
        n = left.count()
        if n in (0, before):  # what is left when a round closes nothing are cycles
            return own.select("id").join(done, "id", "left")
        step = left.unionByName(done.withColumn("next", F.lit(None).cast("string")))
        state, before = written(doubled(doubled(step)), "merge-state"), n
        done = state.where("root is not null").select("id", "root")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The keyed union of two tables, the old row kept; ``conflict`` where both have the key with other values."""
    rest = [c for c in old.columns if c != key]
    o, n = old.select(key, F.struct(*rest).alias("o")), new.select(key, F.struct(*rest).alias("n"))
    both = o.join(n, key, "full_outer")
    conflict = F.col("o").isNotNull() & F.col("n").isNotNull() & ~F.col("o").eqNullSafe(F.col("n"))
    return both.select(key, F.coalesce("o", "n").alias("v"), conflict.alias("conflict"), F.col("o").isNull().alias("added")).select(key, "v.*", "conflict", "added")


def collect_garbage(units: DataFrame, canonical: DataFrame, blobs: DataFrame, gone: DataFrame) -> DataFrame:
    """(kind, kept, removed): what stays reachable after the unit observations ``gone`` (id) are deleted."""
    left = once(units).join(gone.select("id"), "id", "left_anti")
    used_units = left.select(F.col("canonical_unit_id").alias("id")).distinct()
    used_blobs = left.select(F.explode("evidence_blocks.evidence_blob_id").alias("id")).distinct()

    def count(kind: str, all_rows: DataFrame, used: DataFrame) -> DataFrame:
        seen = all_rows.select("id").distinct().join(used.withColumn("used", F.lit(1)), "id", "left")
        return seen.agg(F.count("used").alias("kept"), (F.count("*") - F.count("used")).alias("removed")).select(F.lit(kind).alias("kind"), "kept", "removed")

    return count("observations", once(units), left.select("id")).unionByName(count("units", canonical, used_units)).unionByName(count("blobs", blobs, used_blobs))
