"""Deletion, expiry and reachability: what stays of the journal and what goes with the rows that leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata import limits
from pagestrata.operators import journal


def expired(received_at: Column, now: Column, days: int = limits.TTL_DAYS) -> Column:
    """Older than the time to live; times that cannot be read never expire."""
    return F.coalesce(F.try_to_timestamp(received_at) < now - F.expr(f"interval {days} days"), F.lit(False))


def surviving(obs: DataFrame, gone: Column) -> DataFrame:
    return obs.where(~F.coalesce(gone, F.lit(False)))


def deletion_report(obs: DataFrame, gone: Column) -> DataFrame:
    """(removed_observations, removed_pages, removed_payloads): a page or payload goes if no row of it stays. One
    aggregation per key, no list of what was deleted."""
    flag = F.coalesce(gone, F.lit(False))
    rows = obs.withColumn("gone", flag)
    lost = lambda key: rows.groupBy(key).agg(F.min("gone").alias("all_gone")).where("all_gone").agg(F.count("*").alias("n"))
    n = rows.agg(F.count_if("gone").alias("removed_observations"))
    return n.join(lost("page_instance_id").withColumnRenamed("n", "removed_pages")).join(lost("payload_hash").withColumnRenamed("n", "removed_payloads"))


def delete_rows(obs: DataFrame, snapshots: DataFrame, gone: Column) -> dict[str, DataFrame]:
    """The store's tables after the rows for which gone holds are deleted: the journal, the states of its pages made anew from what
    is left, and the payloads that a row still names."""
    left = surviving(obs, gone)
    hashed = snapshots.withColumn("payload_hash", F.concat(F.lit("sha256:"), F.sha2("payload_json", 256))).dropDuplicates(["payload_hash"])
    return {"observations": left, "page_states": journal.page_state(left, snapshots), "payloads": hashed.join(left.select("payload_hash").distinct(), "payload_hash", "left_semi")}


def unreferenced(blobs: DataFrame, blob_key: str, used: DataFrame, used_key: str) -> DataFrame:
    """Blobs that nothing refers to."""
    return blobs.join(used.select(F.col(used_key).alias(blob_key)).distinct(), blob_key, "left_anti")


def reconciled(stored: DataFrame, replayed: DataFrame) -> DataFrame:
    """(page_instance_id, status): stored page states (page_instance_id, state_version) against the replayed ones."""
    s, r = stored.select("page_instance_id", F.col("state_version").alias("stored")), replayed.select("page_instance_id", F.col("state_version").alias("replayed"))
    status = F.when(F.col("replayed").isNull() | (F.col("stored") > F.col("replayed")), "ahead").when(F.col("stored").isNull(), "missing").when(F.col("stored") < F.col("replayed"), "behind").otherwise("equal")
    return s.join(r, "page_instance_id", "full_outer").select("page_instance_id", status.alias("status"))
