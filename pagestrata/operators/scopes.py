"""Whole answers per scope: what a session's capture covers, its blocks as one projection, and its units as topic input.

Every operator gives one row per session over all sessions at once; lists per session are made from rows that are already
one per entry (page, origin, block), never from raw observations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata import limits
from pagestrata.functions import text as X
from pagestrata.functions import url as U
from pagestrata.operators import coverage, extraction, journal, projection, units

# fixed values: versions that the input hashes name, and the form of an instant
PROJECTION_VERSION, TOPIC_VERSION, PROMPT_VERSION = 1, 1, "topic-v1"
ISO_INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,3})?(?:Z|[+-]\d{2}:\d{2})$"


def parse_scope(raw: str, latest_session: str | None = None) -> tuple[str, str]:
    """("page" or "session", id) of page:<id>, session:<id> or latest-session; ValueError for anything else."""
    if raw == "latest-session":
        if latest_session is None:
            raise ValueError("there is no session")
        return "session", latest_session
    kind, _, name = raw.partition(":")
    if kind not in ("page", "session") or not name:
        raise ValueError(f"no scope: {raw}")
    return kind, name


def range_error(start: Column, end: Column) -> Column:
    """Why a time range must be refused: length, form or order; null if it may be used."""
    form = lambda c: F.coalesce(c.rlike(ISO_INSTANT) & F.try_to_timestamp(c).isNotNull(), F.lit(False))
    return F.when((F.length(start) > 64) | (F.length(end) > 64), "length").when(~(form(start) & form(end)), "form").when(F.try_to_timestamp(start) > F.try_to_timestamp(end), "order")


def last_days(at: Column, now: Column, days: int) -> Column:
    """Whether an instant lies within so many days before now; false if it cannot be read."""
    t = F.try_to_timestamp(at)
    return F.coalesce((t >= now - F.expr(f"interval {days} days")) & (t <= now), F.lit(False))


def in_range(at: Column, start: str, end: str) -> Column:
    t = F.try_to_timestamp(at)
    return F.coalesce(t.between(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))), F.lit(False))


def _in_order(key: list[str], rows: DataFrame, order: str, name: str, text: Column, by: str = " ") -> DataFrame:
    """(key, name): the rows' texts of each key, joined in order."""
    got = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))).alias("l"))
    return got.select(*key, F.array_join(F.transform("l", lambda x: x["t"]), by).alias(name))


def coverage_manifest(obs: DataFrame, states: DataFrame, unit_counts: DataFrame) -> DataFrame:
    """What is known to be captured of each session, up to the watermarks of its pages, and what is known to be missing.
    unit_counts(session_id, n_units). States count for the session of their page's first row, if the session has rows of it."""
    rows = coverage.watermarked(obs, states)
    base = rows.groupBy("session_id").agg(
        F.min("received_at").alias("captured_from"), F.max("received_at").alias("captured_to"), F.count_distinct("page_instance_id").alias("n_pages"), F.count("*").alias("n_observations"), F.count_if(F.col("obs_type") == "capture_failed").alias("n_failures")
    )
    origins = rows.select("session_id", "ord", U.origin(F.col("url")).alias("origin")).where("origin is not null").groupBy("session_id", "origin").agg(F.min("ord").alias("o"))
    domains = _in_order(["session_id"], origins, "o", "domains", F.col("origin"))
    first = journal.pages(obs).select("page_instance_id", "session_id", "first_ord")
    own = states.select("page_instance_id", "state_version", "last_applied_seq", "canonical_url").join(first, "page_instance_id")
    own = own.join(rows.select("session_id", "page_instance_id").distinct(), ["session_id", "page_instance_id"], "left_semi")
    marks = _in_order(["session_id"], own, "page_instance_id", "watermarks", F.concat_ws(":", "page_instance_id", "state_version", "last_applied_seq"))
    u = F.col("canonical_url")
    paged = own.select("session_id", "first_ord", U.origin(u).alias("origin"), U.page_path(u).alias("path"), U.page_selector(u).alias("selector")).where("selector is not null and origin is not null")
    paged = paged.groupBy("session_id", "origin", "path", "selector").agg(F.min("first_ord").alias("o"))
    group = ["session_id", "origin", "path"]
    paged = _in_order(group, paged, "o", "selectors", F.col("selector"), ",").join(paged.groupBy(*group).agg(F.min("o").alias("o")), group)
    pagination = _in_order(["session_id"], paged, "o", "pagination", F.concat_ws("|", F.concat("origin", "path"), "selectors"))
    gaps = journal.authorization_spans(rows.withColumn("tab_id", F.concat_ws("|", "session_id", "tab_id"))).select(F.substring_index("tab_id", "|", 1).alias("session_id")).groupBy("session_id").agg(F.count("*").alias("n_gaps"))
    out = base.join(domains, "session_id", "left").join(marks, "session_id", "left").join(pagination, "session_id", "left").join(gaps, "session_id", "left").join(unit_counts, "session_id", "left")
    shown = {"unvisited_pagination": F.col("pagination").isNotNull(), "authorization_gap": F.col("n_gaps").isNotNull(), "capture_failure": F.col("n_failures") > 0} | dict.fromkeys(coverage.STRUCTURAL, F.lit(True))
    reasons = F.array_join(F.array_compact(F.array(*(F.when(shown[r], F.lit(r)) for r in coverage.REASONS if r in shown))), " ")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return out.select("session_id", "captured_from", "captured_to", "n_pages", "n_observations", "n_failures", empty("domains"), empty("watermarks"), empty("pagination"), F.coalesce("n_gaps", F.lit(0)).alias("n_gaps"), F.coalesce("n_units", F.lit(0)).alias("n_units"), reasons.alias("reasons"))


def scope_blocks(evidence: DataFrame, blobs: DataFrame, question: str = "", context: int = 128_000) -> tuple[DataFrame, DataFrame]:
    """Each session's evidence as one projection: (session_id, n_pages, n_blocks, n_bytes, n_tokens, status) of all sessions, and
    (session_id, block_id, text_hash, text, n_sources, sources) of those within the limits. Equal texts are one block, with all
    its sources in the order of time, page and ordinal; blocks are numbered in the order of their first sources."""
    source = F.struct(F.col("observed_at").alias("capturedAt"), F.col("page_instance_id").alias("pageInstanceId"), "ordinal", F.col("state_version").alias("stateVersion"))
    each = evidence.select("session_id", F.col("evidence_blob_id").alias("text_hash"), source.alias("source")).distinct()
    text = blobs.dropDuplicates(["id"]).select(F.col("id").alias("text_hash"), "text")
    first = each.groupBy("session_id", "text_hash").agg(F.min("source").alias("first"), F.count("*").alias("n_sources")).join(text, "text_hash")
    pages = evidence.groupBy("session_id").agg(F.count_distinct("page_instance_id").alias("n_pages"))
    used = first.groupBy("session_id").agg(F.count("*").alias("n_blocks"), F.sum(X.utf8_bytes(F.col("text"))).alias("n_bytes"), (F.sum(X.estimated_tokens(F.col("text"))) + X.estimated_tokens(F.lit(question))).alias("n_tokens"))
    used = projection.with_status(pages.join(used, "session_id"), context)
    # limits bound a session's blocks before they are numbered in one window and their sources listed
    fit = first.join(used.where("status = 'ok'").select("session_id"), "session_id", "left_semi")
    no = F.row_number().over(Window.partitionBy("session_id").orderBy("first", "text_hash")).cast("string")
    fit = fit.withColumn("block_id", F.concat(F.lit("b-"), F.when(F.length(no) < 4, F.lpad(no, 4, "0")).otherwise(no))).drop("first")
    listed = each.join(fit.select("session_id", "text_hash"), ["session_id", "text_hash"], "left_semi").groupBy("session_id", "text_hash").agg(F.array_sort(F.collect_list("source")).alias("sources"))
    return used, fit.join(listed, ["session_id", "text_hash"])


def projection_hashes(used: DataFrame, blocks: DataFrame, manifests: DataFrame, question: str = "", context: int = 128_000) -> DataFrame:
    """(session_id, status, input_hash): the hash of all that a projection is made from, in one fixed order of keys; null for
    sessions that are refused."""
    digest = F.struct(F.col("block_id").alias("id"), F.col("text_hash").alias("textHash"), "sources")
    listed = blocks.groupBy("session_id").agg(F.array_sort(F.collect_list(digest)).alias("blockDigests"))
    out = used.join(listed, "session_id", "left").join(manifests.select("session_id", "watermarks", "captured_from", "captured_to", "domains", "pagination", "reasons"), "session_id", "left")
    bounds = F.struct(*(F.lit(v).alias(k) for k, v in (("maxPages", limits.PROJECTION_PAGES), ("maxBlocks", limits.PROJECTION_BLOCKS), ("maxUtf8Bytes", limits.PROJECTION_BYTES), ("maxEstimatedTokens", limits.token_limit(context)))))
    canonical = F.to_json(
        F.struct(
            F.lit(1).alias("schemaVersion"), F.lit(PROJECTION_VERSION).alias("projectionVersion"), F.lit(question).alias("question"), F.lit("demo_session").alias("scope"), F.coalesce("watermarks", F.lit("")).alias("pageStateWatermarks"),
            F.struct(*(F.coalesce(c, F.lit("")).alias(c) for c in ("captured_from", "captured_to", "domains", "pagination", "reasons")), F.col("n_blocks").alias("unitCount")).alias("coverage"),
            "blockDigests", bounds.alias("limits"), F.col("n_tokens").alias("estimatedTokens"),
        )
    )
    return out.select("session_id", "status", F.when(F.col("status") == "ok", X.sha256_ref(canonical)).alias("input_hash"))


def input_error(pages: DataFrame, states: DataFrame, question: str, context: int) -> DataFrame:
    """(reason, n_pages): why pages(page_instance_id) cannot be projected, the first reason that holds; empty if they can."""
    spark = pages.sparkSession
    if not question.strip() or context <= limits.TOKEN_RESERVE:
        return spark.createDataFrame([("question" if not question.strip() else "context", 0)], "reason string, n_pages long")
    missing = pages.select("page_instance_id").distinct().join(states.select("page_instance_id"), "page_instance_id", "left_anti")
    none = pages.limit(1).agg(F.count("*").alias("n")).where("n = 0").select(F.lit("pages").alias("reason"), F.col("n").alias("n_pages"))
    return none.unionByName(missing.agg(F.count("*").alias("n_pages")).where("n_pages > 0").select(F.lit("watermark").alias("reason"), "n_pages"))


def topic_previews(observations: DataFrame, canonical: DataFrame, blobs: DataFrame, start: str, end: str) -> DataFrame:
    """(session_id, n_units, n_pages, n_domains, n_bytes, n_tokens, status, input_hash): what a session's units within a time range, each by its
    latest observation, would send to an analyser. Sizes follow from sums; only what is within the limits is put together."""
    rows = units.once(observations).where(in_range(F.col("observed_at"), start, end))
    key = F.concat_ws("|", "observed_at", "id")
    latest = rows.groupBy("session_id", "canonical_unit_id").agg(F.max_by(F.struct("page_instance_id", "capture_extent", "evidence_blocks"), key).alias("o")).select("session_id", "canonical_unit_id", "o.*")
    host = units.once(canonical).select(F.col("id").alias("canonical_unit_id"), U.host(F.col("url")).alias("domain"))
    text = blobs.dropDuplicates(["id"]).select(F.col("id").alias("evidence_blob_id"), "text")
    blocks = latest.select("session_id", "canonical_unit_id", F.posexplode("evidence_blocks").alias("pos", "b")).select("session_id", "canonical_unit_id", "pos", F.col("b.id").alias("blockId"), "b.ordinal", "b.evidence_blob_id")
    blocks = blocks.join(text, "evidence_blob_id", "left").groupBy("session_id", "canonical_unit_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "blockId", F.coalesce("text", F.lit("")).alias("text")))).alias("evidence"), F.array_sort(F.collect_list(F.struct("ordinal", "pos", "blockId"))).alias("refs")
    )
    records = latest.drop("evidence_blocks").join(blocks, ["session_id", "canonical_unit_id"], "left").join(host, "canonical_unit_id", "left")
    parts = F.transform(F.coalesce("evidence", F.array().cast("array<struct<pos:int,blockId:string,text:string>>")), lambda x: F.struct(x["blockId"].alias("blockId"), x["text"].alias("text")))
    records = records.withColumn("json", F.to_json(F.struct(F.col("canonical_unit_id").alias("unitId"), F.col("capture_extent").alias("extent"), parts.alias("evidence"))))
    other = F.length(F.regexp_replace("json", r"[\x{00}-\x{7F}]", ""))
    records = records.withColumn("other", other).withColumn("plain", F.length("json") - other)
    used = records.groupBy("session_id").agg(
        F.count("*").alias("n_units"), F.count_distinct("page_instance_id").alias("n_pages"), F.count_distinct("domain").alias("n_domains"),
        (F.sum(X.utf8_bytes(F.col("json"))) + F.count("*") + 1).alias("n_bytes"), (F.ceil((F.sum("plain") + F.count("*") + 1) / 4) + F.sum("other")).cast("long").alias("n_tokens"),
    )
    over = (F.col("n_units") > limits.TOPIC_UNITS) | (F.col("n_pages") > limits.PROJECTION_PAGES) | (F.col("n_bytes") > limits.PROJECTION_BYTES) | (F.col("n_tokens") > limits.TOKEN_CAP)
    used = used.withColumn("status", F.when(over, "limit_exceeded").otherwise("ok"))
    fit = records.join(used.where("status = 'ok'").select("session_id"), "session_id", "left_semi").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("canonical_unit_id", "json", "refs"))).alias("r"))
    body = F.concat(F.lit("["), F.array_join(F.transform("r", lambda x: x["json"]), ","), F.lit("]"))
    named = F.array_join(F.transform("r", lambda x: x["canonical_unit_id"]), "|")
    refs = F.array_join(F.flatten(F.transform("r", lambda x: F.transform(F.coalesce(x["refs"], F.array().cast("array<struct<ordinal:bigint,pos:int,blockId:string>>")), lambda y: y["blockId"]))), "|")
    fit = fit.select("session_id", X.sha256_ref(F.concat_ws("|", F.lit(str(TOPIC_VERSION)), F.lit(PROMPT_VERSION), F.lit(start), F.lit(end), named, refs, body)).alias("input_hash"))
    return used.join(fit, "session_id", "left")


def latest_page(states: DataFrame) -> DataFrame:
    """The page of the greatest last receipt (as a string; of equals the first by id), with its last event."""
    return states.orderBy(F.desc("last_event_received_at"), "page_instance_id").limit(1).select("page_instance_id", "last_event_type", "last_event_received_at")


def scope_snapshots(obs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The snapshots that each page was seen with, each payload once at its first applied row: (page_instance_id, session_id, payload_hash,
    state_version, source_observation_id, received_at, n_rows, current), current if it belongs to the group of the page's
    latest snapshot. Snapshots whose payload is not held are left out, and so are pages without any."""
    rows = journal.applied(obs).where("obs_type = 'dom_snapshot'")
    seen = rows.groupBy("page_instance_id", "payload_hash").agg(F.min_by(F.struct("state_version", "id", "received_at"), "ord").alias("f"), F.count("*").alias("n_rows"), F.max("ord").alias("last_ord"))
    held = snapshots.select(F.concat(F.lit("sha256:"), F.sha2("payload_json", 256)).alias("payload_hash"), U.snapshot_group(F.get_json_object("payload_json", "$.url"), F.get_json_object("payload_json", "$.title")).alias("g")).dropDuplicates(["payload_hash"])
    seen = seen.join(held, "payload_hash")
    latest = seen.groupBy("page_instance_id").agg(F.max_by("g", "last_ord").alias("now"))
    own = seen.join(latest, "page_instance_id").join(journal.pages(obs).select("page_instance_id", "session_id"), "page_instance_id")
    return own.select("page_instance_id", "session_id", "payload_hash", "f.state_version", F.col("f.id").alias("source_observation_id"), "f.received_at", "n_rows", F.col("g").eqNullSafe(F.col("now")).alias("current"))


def rebuilt_units(obs: DataFrame, snapshots: DataFrame, current_only: bool = False) -> DataFrame:
    """The units of each page's snapshots, made anew from the journal: (session_id, page_instance_id, unit_id, observation_id, stable_fingerprint,
    raw_fingerprint, identity, mode, confidence, type, author, published_at, observed_at, n_sources). Of a page's repeats of a unit's stable
    content the first is kept, with how many rows show it."""
    seen = scope_snapshots(obs, snapshots)
    seen = seen.where("current") if current_only else seen
    payload = snapshots.select(F.concat(F.lit("sha256:"), F.sha2("payload_json", 256)).alias("payload_hash"), F.get_json_object("payload_json", "$.url").alias("page_url"), F.get_json_object("payload_json", "$.html").alias("html")).dropDuplicates(["payload_hash"])
    pages = seen.join(payload, "payload_hash").select(F.col("source_observation_id").alias("record_id"), "page_url", "html")
    got = extraction.observations(extraction.extracted(pages)).withColumnRenamed("record_id", "source_observation_id")
    got = got.join(seen.select("source_observation_id", "session_id", "page_instance_id", "state_version", "received_at", "n_rows"), "source_observation_id")
    first = F.struct("state_version", "source_observation_id", "position")
    kept = F.struct("observation_id", "raw_fingerprint", "identity", "mode", "confidence", "type", "author", "published_at", F.col("received_at").alias("observed_at"))
    out = got.groupBy("session_id", "page_instance_id", "unit_id", "stable_fingerprint").agg(F.min_by(kept, first).alias("o"), F.sum("n_rows").alias("n_sources"))
    return out.select("session_id", "page_instance_id", "unit_id", "stable_fingerprint", "o.*", "n_sources")
