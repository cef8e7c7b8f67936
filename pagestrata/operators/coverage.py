"""What a scope of the journal covers and what it is known to miss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.functions import url as U
from pagestrata.operators import journal

# fixed values: reasons in the order in which a manifest names them, and those that always hold
REASONS = (
    "unvisited_pagination", "unmounted_infinite_scroll", "cross_origin_iframe", "hidden_or_lazy_content", "editor_page_dropped",
    "oversized_page", "denied_sensitive_url", "authorization_gap", "capture_failure", "indistinguishable_absence",
)
STRUCTURAL = ("unmounted_infinite_scroll", "cross_origin_iframe", "hidden_or_lazy_content", "indistinguishable_absence")


def watermarked(obs: DataFrame, states: DataFrame) -> DataFrame:
    """Rows up to their page's last applied sequence number; pages without a state are not cut."""
    cut = states.select("page_instance_id", "last_applied_seq")
    return journal.accepted(obs).join(cut, "page_instance_id", "left").where("last_applied_seq is null or seq_no <= last_applied_seq").drop("last_applied_seq")


def domains(obs: DataFrame) -> DataFrame:
    """(origin, first_ord, n): origins seen; first_ord is their order of first sight."""
    return journal.accepted(obs).withColumn("origin", U.origin(F.col("url"))).where("origin is not null").groupBy("origin").agg(F.min("ord").alias("first_ord"), F.count("*").alias("n"))


def pagination(states: DataFrame) -> DataFrame:
    """(origin, path, n_selectors, first_selector, last_selector): paginated lists among canonical urls."""
    u = F.col("canonical_url")
    facts = states.select(U.origin(u).alias("origin"), U.page_path(u).alias("path"), U.page_selector(u).alias("selector")).where("selector is not null and origin is not null").distinct()
    return facts.groupBy("origin", "path").agg(F.count("*").alias("n_selectors"), F.min("selector").alias("first_selector"), F.max("selector").alias("last_selector"))


def span(obs: DataFrame) -> DataFrame:
    """One row: first and last receipt as strings, sessions, pages, rows, failures."""
    rows = journal.accepted(obs)
    return rows.agg(
        F.coalesce(F.min("received_at"), F.lit("")).alias("captured_from"),
        F.coalesce(F.max("received_at"), F.lit("")).alias("captured_to"),
        F.count_distinct("session_id").alias("n_sessions"),
        F.count_distinct("page_instance_id").alias("n_pages"),
        F.count("*").alias("n_observations"),
        F.count_if(F.col("obs_type") == "capture_failed").alias("n_failures"),
    )


def missing_reasons(obs: DataFrame, states: DataFrame) -> DataFrame:
    """(reason, position): the structural reasons always, the others if the scope shows them."""
    spark = obs.sparkSession
    out = spark.createDataFrame([(r, REASONS.index(r)) for r in STRUCTURAL], "reason string, position int")
    seen = (
        ("unvisited_pagination", pagination(states).select("origin")),
        ("authorization_gap", journal.authorization_spans(obs).select("tab_id")),
        ("capture_failure", obs.where("obs_type = 'capture_failed'").select("id")),
    )
    for reason, rows in seen:  # one row is enough to show a reason
        out = out.unionByName(rows.limit(1).select(F.lit(reason).alias("reason"), F.lit(REASONS.index(reason)).alias("position")))
    return out


def snapshot_groups(snapshots: DataFrame) -> DataFrame:
    """(group_key, n_snapshots, n_pages, first_msg, last_msg): snapshots of one page, whatever its number or query order."""
    once = snapshots.dropDuplicates(["msg_id"])
    return once.withColumn("group_key", U.snapshot_group(F.col("url"), F.col("title"))).groupBy("group_key").agg(
        F.count("*").alias("n_snapshots"), F.count_distinct("page_instance_id").alias("n_pages"), F.min("msg_id").alias("first_msg"), F.max("msg_id").alias("last_msg")
    )
