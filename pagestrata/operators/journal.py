"""Reads of the observation journal: de-duplication, verdicts, applied rows, page state, sessions and pages.

The journal's order is ``ord``, a page's own order ``seq_no``. Running values over a page are computed in blocks of
``ord``: each block is reduced first, the blocks of a page are carried on, and rows see only their own block, so a page
with a third of all rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata import limits
from pagestrata.functions import url as U

BLOCK = 100_000


def accepted(obs: DataFrame) -> DataFrame:
    """The first delivery of each observation."""
    first = obs.groupBy("id").agg(F.min("ord").alias("ord"))
    return obs.join(first, ["id", "ord"], "left_semi")


def journal(obs: DataFrame, session: str | None = None, page: str | None = None, types: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a session, a page and a set of types, each if given."""
    out = obs
    if session is not None:
        out = out.where(F.col("session_id") == session)
    if page is not None:
        out = out.where(F.col("page_instance_id") == page)
    return out.where(F.col("obs_type").isin(*types)) if types else out


def with_prior_max(df: DataFrame, key: str, order: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """The largest value of all earlier rows of the key; null for the first."""
    b = df.withColumn("_block", F.floor(F.col(order) / block))
    blocks = b.groupBy(key, "_block").agg(F.max(value).alias("_top"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(key, "_block", F.max("_top").over(before).alias("_before"))
    inside = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return b.join(blocks, [key, "_block"]).withColumn(name, F.greatest(F.col("_before"), F.max(value).over(inside))).drop("_block", "_before")


def with_running_count(df: DataFrame, key: str, order: str, name: str, block: int = BLOCK) -> DataFrame:
    """How many rows of the key came so far, this one counted."""
    b = df.withColumn("_block", F.floor(F.col(order) / block))
    blocks = b.groupBy(key, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(key, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, "_block").orderBy(order)
    return b.join(blocks, [key, "_block"]).withColumn(name, F.col("_before") + F.row_number().over(inside)).drop("_block", "_before")


def with_prior(df: DataFrame, key: str, order: str, values: tuple[str, ...], block: int = BLOCK) -> DataFrame:
    """prior: a struct of the values of the row before, within the key; null for its first row."""
    b = df.withColumn("_block", F.floor(F.col(order) / block)).withColumn("_row", F.struct(order, *values))
    ends = b.groupBy(key, "_block").agg(F.max("_row").alias("_last"))
    ends = ends.select(key, "_block", F.lag("_last").over(Window.partitionBy(key).orderBy("_block")).alias("_before"))
    inside = Window.partitionBy(key, "_block").orderBy(order)
    return b.join(ends, [key, "_block"]).withColumn("prior", F.coalesce(F.lag("_row").over(inside), F.col("_before"))).drop("_block", "_row", "_before")


def verdicts(obs: DataFrame) -> DataFrame:
    """What a store says to each delivery in journal order: accepted, deduplicated, hash_mismatch or sequence_violation.
    A redelivery repeats a known id; a row whose sequence number is not above all accepted ones before is late."""
    first = obs.groupBy("id").agg(F.min_by(F.struct("ord", "payload_hash"), "ord").alias("first"))
    known = obs.join(first, "id")
    fresh = with_prior_max(known.where("ord = first.ord"), "page_instance_id", "ord", "seq_no", "high_water")
    fresh = fresh.withColumn("verdict", F.when(F.col("seq_no") <= F.col("high_water"), "sequence_violation").otherwise("accepted"))
    again = known.where("ord != first.ord").withColumn("high_water", F.lit(None).cast("long"))
    again = again.withColumn("verdict", F.when(F.col("payload_hash") == F.col("first.payload_hash"), "deduplicated").otherwise("hash_mismatch"))
    cols = ["ord", "id", "page_instance_id", "seq_no", "verdict"]
    return fresh.select(cols).unionByName(again.select(cols))


def applied(obs: DataFrame) -> DataFrame:
    """The rows that change a page's state: sequence number above all earlier ones; with previous sequence number and state version."""
    fresh = with_prior_max(accepted(obs), "page_instance_id", "ord", "seq_no", "prev_seq")
    fresh = fresh.where("prev_seq is null or seq_no > prev_seq")
    return with_running_count(fresh, "page_instance_id", "ord", "state_version")


def gaps(obs: DataFrame) -> DataFrame:
    """(page_instance_id, gap_from, gap_to): sequence numbers that were passed over."""
    return applied(obs).where("seq_no > prev_seq + 1").select("page_instance_id", (F.col("prev_seq") + 1).alias("gap_from"), (F.col("seq_no") - 1).alias("gap_to"))


def page_state(obs: DataFrame, snapshots: DataFrame, most_gaps: int = limits.MAX_GAPS) -> DataFrame:
    """The state of each page after its whole journal."""
    rows = applied(obs)
    snap = snapshots.select(F.concat(F.lit("sha256:"), F.sha2("payload_json", 256)).alias("payload_hash"), F.col("url").alias("snap_url"), F.col("title").alias("snap_title")).dropDuplicates(["payload_hash"])
    rows = rows.join(snap, "payload_hash", "left")
    is_snap = F.col("obs_type") == "dom_snapshot"
    n_gaps = F.sum(F.when(F.col("seq_no") > F.col("prev_seq") + 1, 1).otherwise(0))
    return rows.groupBy("page_instance_id").agg(
        F.count("*").alias("observation_count"),
        F.max("state_version").alias("state_version"),
        F.max("seq_no").alias("last_applied_seq"),
        F.coalesce(F.max_by(F.when(is_snap, F.coalesce("snap_url", "url")), F.when(is_snap, F.col("ord"))), F.min_by("url", "ord")).alias("canonical_url"),
        F.coalesce(F.max_by(F.when(is_snap, F.coalesce("snap_title", F.lit(""))), F.when(is_snap, F.col("ord"))), F.lit("")).alias("title"),
        F.coalesce(F.max_by(F.when(is_snap, F.col("payload_hash")), F.when(is_snap, F.col("ord"))), F.lit("")).alias("snapshot_hash"),
        F.max_by("obs_type", "ord").alias("last_event_type"),
        F.max_by("received_at", "ord").alias("last_event_received_at"),
        F.least(n_gaps, F.lit(most_gaps)).cast("long").alias("n_gaps"),
        (n_gaps > most_gaps).alias("gaps_truncated"),
    )


#: A page state's fields in the order in which they are written.
STATE = {
    "pageInstanceId": "page_instance_id", "stateVersion": "state_version", "lastAppliedSequence": "last_applied_seq", "canonicalUrl": "canonical_url", "title": "title", "payloadHash": "snapshot_hash",
    "lastEventType": "last_event_type", "lastEventReceivedAt": "last_event_received_at", "sequenceGapsTruncated": "gaps_truncated", "observationCount": "observation_count",
}
_LONG = ("stateVersion", "lastAppliedSequence", "observationCount")
_STATE_TYPE = ", ".join(f"{k} {'bigint' if k in _LONG else 'boolean' if k == 'sequenceGapsTruncated' else 'string'}" for k in STATE)


def state_text(states: DataFrame) -> DataFrame:
    """(page_instance_id, doc): page states as JSON, whose bytes follow from the content alone."""
    return states.select("page_instance_id", F.to_json(F.struct(F.lit(1).alias("schemaVersion"), *(F.col(c).alias(k) for k, c in STATE.items()))).alias("doc"))


def parsed_states(docs: DataFrame) -> DataFrame:
    """(page_instance_id, state): state documents read again; null state for one that is no JSON or lacks its page."""
    state = F.from_json("doc", f"struct<{', '.join(x.replace(' ', ':', 1) for x in ('schemaVersion int, ' + _STATE_TYPE).split(', '))}>")
    return docs.withColumn("state", state).withColumn("state", F.when(F.col("state.pageInstanceId").isNotNull(), F.col("state"))).select("page_instance_id", "state")


def sessions(obs: DataFrame) -> DataFrame:
    """One row per session: its first and last receipt (as strings), pages, rows and place in the order of first sight."""
    rows = accepted(obs)
    pages = rows.select("session_id", "page_instance_id").distinct().groupBy("session_id").agg(F.count("*").alias("n_pages"))
    out = rows.groupBy("session_id").agg(F.min("received_at").alias("first_received_at"), F.max("received_at").alias("last_received_at"), F.count("*").alias("n_observations"), F.min("ord").alias("first_ord"))
    return out.join(pages, "session_id")


def session_pages(obs: DataFrame) -> DataFrame:
    """(session_id, page_instance_id, first_ord): a session's pages; first_ord is their order of first sight."""
    return accepted(obs).groupBy("session_id", "page_instance_id").agg(F.min("ord").alias("first_ord"))


def pages(obs: DataFrame) -> DataFrame:
    """One row per page: session and tab of its first row, and its event of the greatest sequence number (the earliest of equals)."""
    last = F.struct("seq_no", -F.col("ord"))
    return accepted(obs).groupBy("page_instance_id").agg(
        F.min_by("session_id", "ord").alias("session_id"),
        F.min_by("tab_id", "ord").alias("tab_id"),
        F.count("*").alias("n_observations"),
        F.max("seq_no").alias("high_water"),
        F.max_by("obs_type", last).alias("last_type"),
        F.max_by("received_at", last).alias("last_received_at"),
        F.min("ord").alias("first_ord"),
    )


def latest_session(obs: DataFrame) -> DataFrame:
    """The session seen first last."""
    return sessions(obs).agg(F.max_by("session_id", "first_ord").alias("session_id"), F.max("first_ord").alias("first_ord"))


def type_histogram(obs: DataFrame) -> DataFrame:
    return accepted(obs).groupBy("obs_type").agg(F.count("*").alias("n"), F.count_distinct("page_instance_id").alias("n_pages"))


def id_conflicts(obs: DataFrame) -> DataFrame:
    """Ids that were delivered with different payloads."""
    return obs.groupBy("id").agg(F.min("payload_hash").alias("lo"), F.max("payload_hash").alias("hi"), F.count("*").alias("deliveries")).where("lo != hi").select("id", "deliveries")


def authorization_spans(obs: DataFrame) -> DataFrame:
    """Grant and revocation of a tab where the revocation is the tab's next such event after the grant."""
    rows = accepted(obs).where(F.col("obs_type").isin("authorization_granted", "authorization_revoked"))
    rows = with_prior(rows, "tab_id", "ord", ("obs_type", "received_at", "url"))
    rows = rows.where("obs_type = 'authorization_revoked' and prior.obs_type = 'authorization_granted'")
    return rows.select("tab_id", F.col("prior.ord").alias("grant_ord"), F.col("ord").alias("revoke_ord"), F.col("prior.received_at").alias("granted_at"), F.col("received_at").alias("revoked_at"), U.origin(F.col("prior.url")).alias("origin"))


def content_epochs(obs: DataFrame) -> DataFrame:
    """How often a page's url changed, in sequence order."""
    rows = accepted(obs).groupBy("page_instance_id", "seq_no").agg(F.min_by("url", "ord").alias("url"))
    rows = with_prior(rows, "page_instance_id", "seq_no", ("url",))
    return rows.groupBy("page_instance_id").agg(F.sum(F.when(F.col("prior.url") != F.col("url"), 1).otherwise(0)).alias("url_changes"), F.count("*").alias("n_sequences"))


def in_scope(obs: DataFrame, kind: str, **scope) -> DataFrame:
    """Rows of a page, a session or a closed time range; times compare as strings."""
    if kind == "page":
        return obs.where(F.col("page_instance_id") == scope["page"])
    if kind == "session":
        return obs.where(F.col("session_id") == scope["session"])
    if kind == "time_range":
        return obs.where(F.col("received_at").between(scope["start"], scope["end"]))
    raise ValueError(f"unknown scope {kind}")


def absolute_time(c: Column) -> Column:
    """A timestamp of an ISO time with any offset; null where it is none."""
    return F.try_to_timestamp(c)


def session_bytes(obs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Bytes of the distinct payloads of each session, and whether they exceed the quota."""
    size = snapshots.select(F.concat(F.lit("sha256:"), F.sha2("payload_json", 256)).alias("payload_hash"), F.octet_length("payload_json").cast("long").alias("bytes")).dropDuplicates(["payload_hash"])
    held = accepted(obs).select("session_id", "payload_hash").distinct().join(size, "payload_hash")
    return held.groupBy("session_id").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n_payloads")).withColumn("over_quota", F.col("bytes") > limits.SESSION_QUOTA_BYTES)


def global_bytes(obs: DataFrame, snapshots: DataFrame) -> DataFrame:
    size = snapshots.select(F.concat(F.lit("sha256:"), F.sha2("payload_json", 256)).alias("payload_hash"), F.octet_length("payload_json").cast("long").alias("bytes")).dropDuplicates(["payload_hash"])
    held = accepted(obs).select("payload_hash").distinct().join(size, "payload_hash")
    return held.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count("*").alias("n_payloads")).withColumn("over_quota", F.col("bytes") > limits.GLOBAL_QUOTA_BYTES)


def missing_blobs(obs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Snapshot observations whose payload is not held."""
    have = snapshots.select(F.concat(F.lit("sha256:"), F.sha2("payload_json", 256)).alias("payload_hash")).distinct()
    return accepted(obs).where("obs_type = 'dom_snapshot'").join(have, "payload_hash", "left_anti").select("id", "payload_hash")
