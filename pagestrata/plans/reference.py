"""Named queries over the given tables, each with the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagestrata import limits
from pagestrata.functions import text as X
from pagestrata.functions import url as U
from pagestrata.operators import coverage, extraction, journal, ledger, maintenance, projection, scopes, topics, units, validate
from pagestrata.session import table
from pagestrata.sources.frames import chunks, reassembled
from pagestrata.streaming import journal_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = "2026-09-01 00:00:00"
#: The journal without redeliveries, applied rows with their predecessors, and snapshots by hash, for the SQL side.
_J = "j AS (SELECT * FROM observations QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1)"
_P = f"{_J}, p AS (SELECT *, max(seq_no) OVER (PARTITION BY page_instance_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_seq FROM j)"
_A = f"{_P}, a AS (SELECT *, row_number() OVER (PARTITION BY page_instance_id ORDER BY ord) AS state_version FROM p WHERE prev_seq IS NULL OR seq_no > prev_seq)"
_S = "s AS (SELECT DISTINCT 'sha256:' || sha256(payload_json) AS payload_hash, url AS snap_url, title AS snap_title, strlen(payload_json)::BIGINT AS bytes FROM dom_snapshots)"
_UO = "uo AS (SELECT * FROM unit_observations QUALIFY row_number() OVER (PARTITION BY id ORDER BY observed_at) = 1)"
_CU = "cu AS (SELECT * FROM canonical_units QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at) = 1)"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- journal


@query(f"WITH {_J} SELECT session_id, page_instance_id, obs_type, count(*) AS n FROM j WHERE obs_type IN ('dom_snapshot', 'capture_failed') GROUP BY ALL")
def journal_filter(spark, d):
    rows = journal.journal(journal.accepted(table(spark, d, "observations")), types=("dom_snapshot", "capture_failed"))
    return rows.groupBy("session_id", "page_instance_id", "obs_type").agg(F.count("*").alias("n"))


@query(f"WITH {_J} SELECT obs_type, count(*) AS n FROM j WHERE received_at BETWEEN '2026-04-01' AND '2026-06-30T23' GROUP BY ALL")
def scope_time_range(spark, d):
    rows = journal.in_scope(journal.accepted(table(spark, d, "observations")), "time_range", start="2026-04-01", end="2026-06-30T23")
    return rows.groupBy("obs_type").agg(F.count("*").alias("n"))


@query(f"WITH {_J} SELECT count(*) AS n, count(DISTINCT page_instance_id) AS n_pages FROM j WHERE received_at::TIMESTAMPTZ BETWEEN '2026-04-01T00:00:00Z'::TIMESTAMPTZ AND '2026-07-01T00:00:00Z'::TIMESTAMPTZ")
def absolute_time_range(spark, d):
    t = journal.absolute_time(F.col("received_at"))
    rows = journal.accepted(table(spark, d, "observations")).where(t.between(F.to_timestamp(F.lit("2026-04-01T00:00:00Z")), F.to_timestamp(F.lit("2026-07-01T00:00:00Z"))))
    return rows.agg(F.count("*").alias("n"), F.count_distinct("page_instance_id").alias("n_pages"))


@query(f"WITH {_J} SELECT session_id, min(received_at) AS first_received_at, max(received_at) AS last_received_at, count(*) AS n_observations, min(ord) AS first_ord, count(DISTINCT page_instance_id) AS n_pages FROM j GROUP BY session_id")
def session_summary(spark, d):
    return journal.sessions(table(spark, d, "observations"))


@query(f"WITH {_J} SELECT session_id, page_instance_id, min(ord) AS first_ord FROM j GROUP BY ALL")
def session_pages(spark, d):
    return journal.session_pages(table(spark, d, "observations"))


@query(
    f"WITH {_J} SELECT page_instance_id, arg_min(session_id, ord) AS session_id, arg_min(tab_id, ord) AS tab_id, count(*) AS n_observations, max(seq_no) AS high_water, "
    "arg_max(obs_type, seq_no * 1000000000 - ord) AS last_type, arg_max(received_at, seq_no * 1000000000 - ord) AS last_received_at, min(ord) AS first_ord FROM j GROUP BY page_instance_id"
)
def page_summary(spark, d):
    return journal.pages(table(spark, d, "observations"))


@query(f"WITH {_A} SELECT ord, page_instance_id, seq_no, prev_seq, state_version FROM a")
def applied_rows(spark, d):
    return journal.applied(table(spark, d, "observations")).select("ord", "page_instance_id", "seq_no", "prev_seq", "state_version")


@query(f"WITH {_A} SELECT page_instance_id, prev_seq + 1 AS gap_from, seq_no - 1 AS gap_to FROM a WHERE seq_no > prev_seq + 1")
def sequence_gaps(spark, d):
    return journal.gaps(table(spark, d, "observations"))


@query(
    f"""WITH {_A}, {_S}, x AS (SELECT a.*, snap_url, snap_title, obs_type = 'dom_snapshot' AS is_snap FROM a LEFT JOIN s USING (payload_hash))
SELECT page_instance_id, count(*) AS observation_count, max(state_version) AS state_version, max(seq_no) AS last_applied_seq,
  coalesce(arg_max(coalesce(snap_url, url), ord) FILTER (is_snap), arg_min(url, ord)) AS canonical_url,
  coalesce(arg_max(coalesce(snap_title, ''), ord) FILTER (is_snap), '') AS title, coalesce(arg_max(payload_hash, ord) FILTER (is_snap), '') AS snapshot_hash,
  arg_max(obs_type, ord) AS last_event_type, arg_max(received_at, ord) AS last_event_received_at,
  least(count(*) FILTER (seq_no > prev_seq + 1), {limits.MAX_GAPS})::BIGINT AS n_gaps, count(*) FILTER (seq_no > prev_seq + 1) > {limits.MAX_GAPS} AS gaps_truncated
FROM x GROUP BY page_instance_id"""
)
def page_state(spark, d):
    return journal.page_state(table(spark, d, "observations"), table(spark, d, "dom_snapshots"))


@query(f"WITH {_A}, b AS (SELECT page_instance_id, max(state_version) AS v, max(seq_no) AS m, count(*) AS n, arg_max(obs_type, ord) AS t, arg_max(received_at, ord) AS r FROM a GROUP BY ALL) SELECT page_instance_id, to_json({{'pageInstanceId': page_instance_id, 'stateVersion': v, 'lastAppliedSequence': m, 'lastEventType': t, 'lastEventReceivedAt': r, 'observationCount': n}})::VARCHAR AS doc FROM b")
def page_state_text(spark, d):
    doc = journal.state_text(journal.page_state(table(spark, d, "observations"), table(spark, d, "dom_snapshots")))
    fields = ("pageInstanceId", "stateVersion", "lastAppliedSequence", "lastEventType", "lastEventReceivedAt", "observationCount")
    return journal.parsed_states(doc).select("page_instance_id", F.to_json(F.struct(*(F.col(f"state.{f}") for f in fields))).alias("doc"))


@query(
    """WITH k AS (SELECT *, first_value(ord) OVER w AS first_ord, first_value(payload_hash) OVER w AS first_hash FROM observations WINDOW w AS (PARTITION BY id ORDER BY ord)),
f AS (SELECT *, max(seq_no) OVER (PARTITION BY page_instance_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hw FROM k WHERE ord = first_ord)
SELECT ord, id, page_instance_id, seq_no, CASE WHEN seq_no <= hw THEN 'sequence_violation' ELSE 'accepted' END AS verdict FROM f
UNION ALL SELECT ord, id, page_instance_id, seq_no, CASE WHEN payload_hash = first_hash THEN 'deduplicated' ELSE 'hash_mismatch' END FROM k WHERE ord != first_ord"""
)
def sequence_verdicts(spark, d):
    return journal.verdicts(table(spark, d, "observations"))


@query(f"WITH {_J} SELECT page_instance_id, max(seq_no) AS high_water, count(DISTINCT seq_no) AS n_sequences FROM j GROUP BY ALL")
def high_water(spark, d):
    return journal.accepted(table(spark, d, "observations")).groupBy("page_instance_id").agg(F.max("seq_no").alias("high_water"), F.count_distinct("seq_no").alias("n_sequences"))


@query("SELECT count(*) AS deliveries, count(DISTINCT id) AS accepted, count(*) - count(DISTINCT id) AS redelivered FROM observations")
def idempotent_dedup(spark, d):
    obs = table(spark, d, "observations")
    return obs.groupBy("id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("deliveries"), F.count("*").alias("accepted"), F.sum(F.col("n") - 1).alias("redelivered"))


@query("SELECT id, count(*) AS deliveries FROM observations GROUP BY id HAVING min(payload_hash) != max(payload_hash)")
def id_hash_conflicts(spark, d):
    return journal.id_conflicts(table(spark, d, "observations"))


@query(f"WITH {_J} SELECT obs_type, count(*) AS n, count(DISTINCT page_instance_id) AS n_pages FROM j GROUP BY ALL")
def type_histogram(spark, d):
    return journal.type_histogram(table(spark, d, "observations"))


@query(f"WITH {_J}, f AS (SELECT session_id, min(ord) AS first_ord FROM j GROUP BY ALL) SELECT session_id, first_ord FROM f ORDER BY first_ord DESC LIMIT 1")
def latest_session(spark, d):
    return journal.latest_session(table(spark, d, "observations"))


@query(
    f"""WITH {_J}, g AS (SELECT *, lag(obs_type) OVER w AS t, lag(ord) OVER w AS o, lag(received_at) OVER w AS r, lag(url) OVER w AS u FROM j WHERE obs_type IN ('authorization_granted', 'authorization_revoked') WINDOW w AS (PARTITION BY tab_id ORDER BY ord))
SELECT tab_id, o AS grant_ord, ord AS revoke_ord, r AS granted_at, received_at AS revoked_at, regexp_extract(u, '^(https?://[^/?#]+)', 1) AS origin FROM g WHERE obs_type = 'authorization_revoked' AND t = 'authorization_granted'"""
)
def authorization_gaps(spark, d):
    return journal.authorization_spans(table(spark, d, "observations"))


@query(
    f"""WITH {_J}, q AS (SELECT page_instance_id, seq_no, arg_min(url, ord) AS url FROM j GROUP BY ALL), l AS (SELECT *, lag(url) OVER (PARTITION BY page_instance_id ORDER BY seq_no) AS u FROM q)
SELECT page_instance_id, count(*) FILTER (u != url) AS url_changes, count(*) AS n_sequences FROM l GROUP BY ALL"""
)
def content_epoch(spark, d):
    return journal.content_epochs(table(spark, d, "observations"))


@query(f"WITH {_J}, {_S}, h AS (SELECT DISTINCT session_id, payload_hash FROM j) SELECT session_id, sum(bytes)::BIGINT AS bytes, count(*) AS n_payloads, sum(bytes) > {limits.SESSION_QUOTA_BYTES} AS over_quota FROM h JOIN s USING (payload_hash) GROUP BY ALL")
def session_bytes(spark, d):
    return journal.session_bytes(table(spark, d, "observations"), table(spark, d, "dom_snapshots"))


@query(f"WITH {_J}, {_S}, h AS (SELECT DISTINCT payload_hash FROM j) SELECT coalesce(sum(bytes), 0)::BIGINT AS bytes, count(*) AS n_payloads, coalesce(sum(bytes), 0) > {limits.GLOBAL_QUOTA_BYTES} AS over_quota FROM h JOIN s USING (payload_hash)")
def global_bytes(spark, d):
    return journal.global_bytes(table(spark, d, "observations"), table(spark, d, "dom_snapshots"))


@query(f"WITH {_J}, {_S} SELECT id, payload_hash FROM j WHERE obs_type = 'dom_snapshot' AND payload_hash NOT IN (SELECT payload_hash FROM s)")
def missing_blobs(spark, d):
    return journal.missing_blobs(table(spark, d, "observations"), table(spark, d, "dom_snapshots"))


@query(f"WITH {_J} SELECT session_id, count(*) FILTER (obs_type = 'capture_failed') AS failures, count(*) FILTER (obs_type = 'dom_snapshot') AS snapshots FROM j GROUP BY ALL")
def capture_failures(spark, d):
    return journal.accepted(table(spark, d, "observations")).groupBy("session_id").agg(F.count_if(F.col("obs_type") == "capture_failed").alias("failures"), F.count_if(F.col("obs_type") == "dom_snapshot").alias("snapshots"))


@query(
    f"""WITH {_J}, f AS (SELECT page_instance_id, min(session_id) AS lo, max(session_id) AS hi, arg_min(session_id, ord) AS session_id FROM j GROUP BY ALL)
SELECT session_id, count(*) AS n_pages, count(*) FILTER (lo != hi) AS n_moved FROM f GROUP BY ALL"""
)
def pages_by_first_session(spark, d):
    first = journal.accepted(table(spark, d, "observations")).groupBy("page_instance_id").agg(F.min("session_id").alias("lo"), F.max("session_id").alias("hi"), F.min_by("session_id", "ord").alias("session_id"))
    return first.groupBy("session_id").agg(F.count("*").alias("n_pages"), F.count_if(F.col("lo") != F.col("hi")).alias("n_moved"))


@query(
    f"""WITH {_J}, p AS (SELECT page_instance_id, arg_max(obs_type, seq_no * 1000000000 - ord) AS t FROM j GROUP BY ALL)
SELECT CASE t WHEN 'capture_failed' THEN 'failed' WHEN 'authorization_revoked' THEN 'revoked' WHEN 'capture_paused' THEN 'paused' WHEN 'dom_snapshot' THEN 'captured' ELSE 'watching' END AS status, count(*) AS n_pages FROM p GROUP BY ALL"""
)
def page_status(spark, d):
    t = F.col("last_type")
    status = F.when(t == "capture_failed", "failed").when(t == "authorization_revoked", "revoked").when(t == "capture_paused", "paused").when(t == "dom_snapshot", "captured").otherwise("watching")
    return journal.pages(table(spark, d, "observations")).groupBy(status.alias("status")).agg(F.count("*").alias("n_pages"))


@query(
    f"""WITH {_J}, g AS (SELECT obs_type, octet_length(encode(url)) AS v FROM j), r AS (SELECT obs_type, v, row_number() OVER (PARTITION BY obs_type ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY obs_type) AS n FROM g)
SELECT obs_type, max(v) FILTER (i = least(n - 1, floor(n * 0.5)))::BIGINT AS p50, max(v) FILTER (i = least(n - 1, floor(n * 0.95)))::BIGINT AS p95, max(v)::BIGINT AS most FROM r GROUP BY obs_type"""
)
def percentile_floor(spark, d):
    # a value's rank follows from counts of equal values, so no group is sorted row by row
    v = journal.accepted(table(spark, d, "observations")).select("obs_type", F.octet_length("url").cast("long").alias("v")).groupBy("obs_type", "v").agg(F.count("*").alias("c"))
    w = Window.partitionBy("obs_type")
    up = v.withColumn("upto", F.sum("c").over(w.orderBy("v"))).withColumn("n", F.sum("c").over(w))
    at = lambda q: F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * q)), F.col("v")))
    return up.groupBy("obs_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("v").alias("most"))


# ---- maintenance


@query(f"WITH {_J}, g AS (SELECT *, coalesce(try_cast(received_at AS TIMESTAMPTZ) < TIMESTAMPTZ '{NOW}+00' - INTERVAL {limits.TTL_DAYS} DAY, false) AS gone FROM j) SELECT count(*) FILTER (gone) AS removed_observations, (SELECT count(*) FROM (SELECT 1 FROM g GROUP BY page_instance_id HAVING bool_and(gone))) AS removed_pages, (SELECT count(*) FROM (SELECT 1 FROM g GROUP BY payload_hash HAVING bool_and(gone))) AS removed_payloads FROM g")
def ttl_prune(spark, d):
    obs = journal.accepted(table(spark, d, "observations"))
    return maintenance.deletion_report(obs, maintenance.expired(F.col("received_at"), F.to_timestamp(F.lit(NOW))))


@query(f"WITH {_J}, z AS (SELECT max(session_id) AS m FROM j), g AS (SELECT j.*, session_id = m AS gone FROM j, z) SELECT count(*) FILTER (gone) AS removed_observations, (SELECT count(*) FROM (SELECT 1 FROM g GROUP BY page_instance_id HAVING bool_and(gone))) AS removed_pages, (SELECT count(*) FROM (SELECT 1 FROM g GROUP BY payload_hash HAVING bool_and(gone))) AS removed_payloads FROM g")
def delete_session_gc(spark, d):
    obs = journal.accepted(table(spark, d, "observations"))
    session = obs.agg(F.max("session_id")).first()[0]
    return maintenance.deletion_report(obs, F.col("session_id") == session)


@query(f"WITH {_UO}, u AS (SELECT DISTINCT unnest(evidence_blocks).evidence_blob_id AS id FROM uo) SELECT count(*) AS n_unreferenced, sum(strlen(text))::BIGINT AS bytes FROM (SELECT DISTINCT id, text FROM evidence_blobs) WHERE id NOT IN (SELECT id FROM u)")
def unreferenced_blobs(spark, d):
    used = units.evidence(table(spark, d, "unit_observations"))
    left = maintenance.unreferenced(units.once(table(spark, d, "evidence_blobs")), "id", used, "evidence_blob_id")
    return left.agg(F.count("*").alias("n_unreferenced"), F.sum(F.octet_length("text")).alias("bytes"))


@query(f"WITH {_A}, r AS (SELECT page_instance_id, count(*) AS v FROM a GROUP BY ALL), o AS (SELECT page_instance_id, count(*) AS v FROM j GROUP BY ALL) SELECT CASE WHEN r.v IS NULL OR o.v > r.v THEN 'ahead' WHEN o.v IS NULL THEN 'missing' WHEN o.v < r.v THEN 'behind' ELSE 'equal' END AS status, count(*) AS n FROM o FULL JOIN r USING (page_instance_id) GROUP BY 1")
def reconciled_states(spark, d):
    obs = table(spark, d, "observations")
    stored = journal.accepted(obs).groupBy("page_instance_id").agg(F.count("*").alias("state_version"))
    replayed = journal.applied(obs).groupBy("page_instance_id").agg(F.max("state_version").alias("state_version"))
    return maintenance.reconciled(stored, replayed).groupBy("status").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_J}, {_S}, z AS (SELECT min(page_instance_id) AS p FROM j), l AS (SELECT j.* FROM j, z WHERE page_instance_id != p)
SELECT 'observations' AS kind, id FROM l UNION ALL SELECT DISTINCT 'page_states', page_instance_id FROM l UNION ALL SELECT DISTINCT 'payloads', payload_hash FROM s WHERE payload_hash IN (SELECT payload_hash FROM l)"""
)
def delete_page(spark, d):
    obs = journal.accepted(table(spark, d, "observations"))
    page = obs.agg(F.min("page_instance_id")).first()[0]
    left = maintenance.delete_rows(obs, table(spark, d, "dom_snapshots"), F.col("page_instance_id") == page)
    ids = {"observations": "id", "page_states": "page_instance_id", "payloads": "payload_hash"}
    return reduce(DataFrame.unionByName, (left[k].select(F.lit(k).alias("kind"), F.col(c).alias("id")) for k, c in ids.items()))


@query(f"WITH {_J}, {_S} SELECT DISTINCT payload_hash, bytes, true AS intact FROM j JOIN s USING (payload_hash) WHERE obs_type = 'dom_snapshot'")
def blob_verify(spark, d):
    body = F.col("payload_json").cast("binary")
    held = table(spark, d, "dom_snapshots").select(F.concat(F.lit("sha256:"), F.sha2(body, 256)).alias("h"), F.octet_length("payload_json").cast("long").alias("bytes")).dropDuplicates(["h"])
    named = journal.accepted(table(spark, d, "observations")).where("obs_type = 'dom_snapshot'").select("payload_hash").distinct()
    return named.join(held, F.col("payload_hash") == F.col("h")).select("payload_hash", "bytes", (F.col("h") == F.col("payload_hash")).alias("intact"))


@query(f"WITH {_J} SELECT page_instance_id, count(*) AS n, min(seq_no) AS lowest, max(seq_no) AS highest, count(DISTINCT payload_hash) AS n_payloads FROM j GROUP BY ALL")
def page_sequences(spark, d):
    return journal.accepted(table(spark, d, "observations")).groupBy("page_instance_id").agg(F.count("*").alias("n"), F.min("seq_no").alias("lowest"), F.max("seq_no").alias("highest"), F.count_distinct("payload_hash").alias("n_payloads"))


# ---- coverage


@query(f"WITH {_J} SELECT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, min(ord) AS first_ord, count(*) AS n FROM j GROUP BY 1")
def domains_first_seen(spark, d):
    return coverage.domains(table(spark, d, "observations"))


@query(f"WITH {_J} SELECT coalesce(min(received_at), '') AS captured_from, coalesce(max(received_at), '') AS captured_to, count(DISTINCT session_id) AS n_sessions, count(DISTINCT page_instance_id) AS n_pages, count(*) AS n_observations, count(*) FILTER (obs_type = 'capture_failed') AS n_failures FROM j")
def coverage_span(spark, d):
    return coverage.span(table(spark, d, "observations"))


_PAGED = "regexp_replace(url, '#.*$', '')"


@query(
    f"""WITH u AS (SELECT DISTINCT {_PAGED} AS url FROM observations), f AS (SELECT DISTINCT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin,
  regexp_extract(url, '^https?://[^/?#]+([^?]*)', 1) || coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract(url, '[?](.*)$', 1), '&'), lambda x: x != '' AND NOT regexp_matches(lower(x), '^(page|p|pg)=[0-9]+$')), '&'), ''), '') AS path,
  list_filter(string_split(regexp_extract(url, '[?](.*)$', 1), '&'), lambda x: regexp_matches(lower(x), '^(page|p|pg)=[0-9]+$')) AS hits FROM u)
SELECT origin, path, count(DISTINCT hits[1]) AS n_selectors, min(hits[1]) AS first_selector, max(hits[1]) AS last_selector FROM f WHERE len(hits) > 0 GROUP BY ALL"""
)
def pagination_groups(spark, d):
    return coverage.pagination(table(spark, d, "observations").select(F.col("url").alias("canonical_url")).distinct())


_URL_STATE = f"{_A}, {_S}, sx AS (SELECT a.*, snap_url, obs_type = 'dom_snapshot' AS is_snap FROM a LEFT JOIN s USING (payload_hash)), st AS (SELECT page_instance_id, coalesce(arg_max(coalesce(snap_url, url), ord) FILTER (is_snap), arg_min(url, ord)) AS u FROM sx GROUP BY ALL)"


@query(
    f"""WITH {_URL_STATE}, g AS (SELECT obs_type, lag(obs_type) OVER (PARTITION BY tab_id ORDER BY ord) AS t FROM j WHERE obs_type IN ('authorization_granted', 'authorization_revoked'))
SELECT reason, position FROM (VALUES ('unmounted_infinite_scroll', 1, true), ('cross_origin_iframe', 2, true), ('hidden_or_lazy_content', 3, true), ('indistinguishable_absence', 9, true),
  ('unvisited_pagination', 0, (SELECT count(*) FROM st WHERE regexp_matches(u, '(?i)[?&](page|p|pg)=[0-9]+(&|#|$)') OR regexp_matches(u, '^https?://[^/?#]+[^?#]*/(page|p)/[0-9]+(/|[?#]|$)')) > 0),
  ('authorization_gap', 7, (SELECT count(*) FROM g WHERE obs_type = 'authorization_revoked' AND t = 'authorization_granted') > 0), ('capture_failure', 8, (SELECT count(*) FROM j WHERE obs_type = 'capture_failed') > 0)) v(reason, position, shown) WHERE shown"""
)
def missing_reasons(spark, d):
    obs = journal.accepted(table(spark, d, "observations"))
    return coverage.missing_reasons(obs, journal.page_state(obs, table(spark, d, "dom_snapshots")))


@query(
    """WITH o AS (SELECT * FROM dom_snapshots QUALIFY row_number() OVER (PARTITION BY msg_id ORDER BY url) = 1),
k AS (SELECT msg_id, page_instance_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '|' || regexp_replace(regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/{2,}', '/', 'g'), '(?:/[0-9]+)*/?$', '') || '|' ||
  array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda x: x != '' AND NOT regexp_matches(lower(x), '^(page|p|pg)=[0-9]+$'))), '&') || '|' || coalesce(title, '') AS group_key FROM o)
SELECT group_key, count(*) AS n_snapshots, count(DISTINCT page_instance_id) AS n_pages, min(msg_id) AS first_msg, max(msg_id) AS last_msg FROM k GROUP BY ALL"""
)
def snapshot_groups(spark, d):
    return coverage.snapshot_groups(table(spark, d, "dom_snapshots"))


@query(f"WITH {_A}, w AS (SELECT page_instance_id, max(seq_no) AS m FROM a GROUP BY ALL) SELECT page_instance_id, count(*) AS n FROM j JOIN w USING (page_instance_id) WHERE seq_no <= m GROUP BY ALL")
def watermark_cut(spark, d):
    obs = table(spark, d, "observations")
    states = journal.applied(obs).groupBy("page_instance_id").agg(F.max("seq_no").alias("last_applied_seq"))
    return coverage.watermarked(obs, states).groupBy("page_instance_id").agg(F.count("*").alias("n"))


# ---- scalar functions


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS bytes, (ceil((length(text) - length(regexp_replace(text, '[\\x{00}-\\x{7F}]', '', 'g'))) / 4.0) + length(regexp_replace(text, '[\\x{00}-\\x{7F}]', '', 'g')))::BIGINT AS tokens, (length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))::BIGINT AS utf16 FROM documents WHERE text IS NOT NULL")
def text_sizes(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.utf8_bytes(t).alias("bytes"), X.estimated_tokens(t).alias("tokens"), X.utf16_length(t).alias("utf16"))


_SP = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


@query(f"SELECT doc_id, 'sha256:' || sha256(trim(regexp_replace(nfc_normalize(text), '{_SP}', ' ', 'g'))) AS text_hash, length(regexp_replace(text, '{_SP}', '', 'g')) AS non_space FROM documents WHERE text IS NOT NULL")
def normal_text_hash(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.sha256_ref(X.normal_block(t)).alias("text_hash"), X.non_space_length(t).cast("long").alias("non_space"))


@query(
    f"""WITH t AS (SELECT DISTINCT id, nfc_normalize(text) AS t FROM evidence_blobs),
r AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\b\\d[\\d,]*(?:\\.\\d+)?\\s*(?:likes?|赞|点赞|replies?|回复|views?|浏览|在线|online)\\b', '[volatile]', 'gi'), '\\b(?:just now|\\d+\\s*(?:seconds?|minutes?|hours?|days?)\\s*ago)\\b', '[volatile]', 'gi'), '\\b\\d+\\s*(?:秒|分钟|小时|天)前\\b', '[volatile]', 'g'), '\\b(?:edited|已编辑|编辑于)\\b', '[volatile]', 'gi') AS t FROM t)
SELECT id, 'sha256:' || sha256(trim(regexp_replace(t, '{_SP}', ' ', 'g'))) AS fingerprint FROM r"""
)
def stable_fingerprints(spark, d):
    blobs = units.once(table(spark, d, "evidence_blobs"))
    return blobs.select("id", X.stable_fingerprint(F.col("text")).alias("fingerprint"))


# a key of each known form beside each text
_KEYS = (
    ("-----BEGIN PRIVATE KEY-----x", "-----END PRIVATE KEY-----", "-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[\\s\\S]*?-----END [A-Z0-9 ]*PRIVATE KEY-----"), ("eyJabcdefgh.abcdefgh.", "", "\\beyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\b"),
    ("Bearer abcd", "", "(?i)\\bbearer\\s+[A-Za-z0-9._~+/=-]{20,}"), ("AKIA", "", "\\b(?:AKIA|ASIA)[0-9A-Z]{16}\\b"), ("sk-", "", "(^|[^A-Za-z0-9])sk-[A-Za-z0-9_-]{16,}"), ("ghp_abcd", "", "\\bghp_[A-Za-z0-9]{20,}\\b"),
    ("github_pat_abcd", "", "\\bgithub_pat_[A-Za-z0-9_]{20,}\\b"), ("xoxb-", "", "\\bxox[baprs]-[A-Za-z0-9-]{10,}\\b"), ("AIzaabcdefghijklmnopqrs", "", "\\bAIza[0-9A-Za-z_-]{35}"),
)
_MIXED = "text" + "".join(f" || ' {a}' || upper(md5(doc_id::VARCHAR)[1:16]) || '{b}'" for a, b, _ in _KEYS) + " || ' end'"
for _a, _b, _form in _KEYS:
    _MIXED = f"regexp_replace({_MIXED}, '{_form}', '{chr(92) + '1' if _a == 'sk-' else ''}[REDACTED:secret]', 'g')"


@query(f"SELECT doc_id, {_MIXED} AS text FROM documents WHERE text IS NOT NULL")
def secret_redaction(spark, d):
    key = F.upper(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 16))
    parts = [x for a, b, _ in _KEYS for x in (F.lit(f" {a}"), key, F.lit(b))]
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.without_secrets(F.concat("text", *parts, F.lit(" end"))).alias("text"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '^\\s*```[A-Za-z]*\\s*\\n[\\s\\S]*\\n?```\\s*$') THEN md5(nullif(regexp_extract(text, '^\\s*```[A-Za-z]*\\s*\\n([\\s\\S]*?)\\n?```\\s*$', 1), '')) ELSE md5(trim(text, ' ')) END AS body FROM documents WHERE text IS NOT NULL")
def unfenced(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(X.without_fences(F.col("text")).cast("binary")).alias("body"))


@query("SELECT DISTINCT id, base64(encode(text)) AS encoded, true AS intact FROM evidence_blobs")
def base64_round_trip(spark, d):
    code = F.regexp_replace(F.base64(F.col("text").cast("binary")), r"\s", "")  # without the line ends of mail
    return units.once(table(spark, d, "evidence_blobs")).select("id", code.alias("encoded"), (X.strict_unbase64(code) == F.col("text").cast("binary")).alias("intact"))


@query(r"""SELECT msg_id, left(trim(regexp_replace(regexp_replace(title, '[\x{00}-\x{1F}\x{7F}<>:"/\\|?*]', ' ', 'g'), '""" + _SP + r"""', ' ', 'g')), 512) AS title FROM (SELECT DISTINCT msg_id, title FROM dom_snapshots)""")
def title_sanitize(spark, d):
    return table(spark, d, "dom_snapshots").select("msg_id", "title").distinct().select("msg_id", X.clean_title(F.col("title")).alias("title"))


@query("SELECT url, lower(regexp_extract(url, '^(https?)://', 1)) || '://' || lower(regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), ':(443|80)$', '')) AS origin, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), ':[0-9]+$', '') AS host FROM (SELECT DISTINCT url FROM topic_sources WHERE url IS NOT NULL)")
def url_origins(spark, d):
    u = F.col("url")
    return table(spark, d, "topic_sources").where("url is not null").select("url").distinct().select("url", U.origin(u).alias("origin"), U.host(u).alias("host"))


_STEMS, _PARAMS, _HOSTS = ("', '".join(x) for x in (U.SENSITIVE_STEMS, U.CREDENTIAL_PARAMS, U.SENSITIVE_HOSTS))


@query(
    f"""WITH g AS (SELECT DISTINCT split_part(url, '#', 1) || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'token=abc&x=1' AS given FROM observations),
p AS (SELECT given, regexp_extract(given, '^(https?://[^/?#]+)', 1) AS origin, regexp_extract(given, '^https?://([^/?#:]+)', 1) AS host, regexp_extract(given, '^https?://[^/?#]+([^?#]*)', 1) AS path, list_filter(string_split(regexp_extract(given, '[?]([^#]*)', 1), '&'), lambda x: x != '') AS q FROM g),
f AS (SELECT *, list_has_any(string_split(lower(url_decode(path)), '/'), ['{_STEMS}']) AS sensitive, len(list_filter(['{_HOSTS}'], lambda h: host = h OR ends_with(host, '.' || h))) > 0 AS listed,
  list_filter(q, lambda x: lower(url_decode(string_split(x, '=')[1])) NOT IN ('{_PARAMS}')) AS kept FROM p),
r AS (SELECT *, CASE WHEN listed THEN 'host' WHEN sensitive THEN 'path' END AS deny_reason FROM f)
SELECT given, deny_reason, CASE WHEN deny_reason IS NULL THEN origin || path || coalesce('?' || nullif(array_to_string(kept, '&'), ''), '') END AS safe_url, (len(q) - len(kept))::INT AS redacted, sensitive FROM r"""
)
def url_sanitize(spark, d):
    u = table(spark, d, "observations").select("url").distinct()
    with_token = F.concat(F.split("url", "#")[0], F.when(F.col("url").contains("?"), F.lit("&")).otherwise(F.lit("?")), F.lit("token=abc&x=1"))
    u = u.withColumn("given", with_token)
    return u.select("given", U.deny_reason(F.col("given")).alias("deny_reason"), U.sanitized(F.col("given")).alias("safe_url"), U.redacted_params(F.col("given")).alias("redacted"), U.is_sensitive_path(F.col("given")).alias("sensitive"))


@query(f"WITH {_CU} SELECT id, identity_key.kind AS kind, 'unit-' || left(sha256(CASE identity_key.kind WHEN 'permalink' THEN concat_ws('|', 'permalink', identity_key.url, '') WHEN 'anchor' THEN concat_ws('|', 'anchor', identity_key.origin, identity_key.canonical_page_url, identity_key.stable_anchor, '') ELSE 'unkeyed|' END), 17) AS derived_id FROM cu")
def content_ids(spark, d):
    return units.unit_ids(table(spark, d, "canonical_units"))


@query("SELECT DISTINCT msg_id, greatest(1, ceil(octet_length(encode(payload_json)) / 262144.0))::BIGINT AS chunks, octet_length(encode(payload_json)) <= 5242880 AS fits FROM dom_snapshots")
def chunk_counts(spark, d):
    n = F.octet_length("payload_json")
    return table(spark, d, "dom_snapshots").select("msg_id", F.greatest(F.lit(1), F.ceil(n / limits.CHUNK_BYTES)).cast("long").alias("chunks"), (n <= limits.SNAPSHOT_MAX_BYTES).alias("fits")).distinct()


@query("SELECT DISTINCT msg_id, 'sha256:' || sha256(payload_json) AS payload_hash FROM dom_snapshots")
def chunk_reassembly(spark, d):
    snaps = table(spark, d, "dom_snapshots").dropDuplicates(["msg_id"])
    parts = chunks(snaps.select(F.col("msg_id").cast("string").alias("transfer_id"), F.col("payload_json").cast("binary").alias("payload")), 1024)
    return reassembled(parts).where("complete").select(F.col("transfer_id").cast("long").alias("msg_id"), "payload_hash")


# ---- blocks and projection


@query()
def html_blocks(spark, d):
    pages = table(spark, d, "projector_pages").dropDuplicates(["input_id"])
    return projection.extracted_blocks(pages, "input_id", "sanitized_html").withColumnRenamed("key", "input_id")


@query(
    f"WITH {_UO}, e AS (SELECT id, page_instance_id, observed_at, unnest(evidence_blocks) AS b FROM uo), x AS (SELECT b.text_hash AS text_hash, page_instance_id, observed_at, id, b.ordinal AS ordinal FROM e) "
    "SELECT text_hash, count(*) AS n_sources, count(DISTINCT page_instance_id) AS n_pages, arg_min(id, observed_at || '|' || id) AS first_source FROM x GROUP BY text_hash"
)
def block_dedup_sources(spark, d):
    ev = units.evidence(table(spark, d, "unit_observations"))
    key = F.concat_ws("|", "observed_at", "unit_observation_id")
    return ev.groupBy(F.col("evidence_blob_id").alias("text_hash")).agg(F.count("*").alias("n_sources"), F.count_distinct("page_instance_id").alias("n_pages"), F.min_by("unit_observation_id", key).alias("first_source"))


@query("SELECT id, 'b-' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END AS block_id FROM (SELECT id, row_number() OVER (ORDER BY id) AS n FROM (SELECT DISTINCT id FROM evidence_blobs))")
def block_numbering(spark, d):
    return projection.numbered(table(spark, d, "evidence_blobs").select("id").distinct(), ["id"]).select("id", "block_id")


_USED = f"""{_UO}, e AS (SELECT session_id, page_instance_id, unnest(evidence_blocks) AS b FROM uo), x AS (SELECT DISTINCT session_id, page_instance_id, b.evidence_blob_id AS id FROM e), t AS (SELECT DISTINCT id, text FROM evidence_blobs),
u AS (SELECT session_id, count(DISTINCT page_instance_id) AS n_pages, count(*) AS n_blocks, sum(octet_length(encode(text)))::BIGINT AS n_bytes, sum(ceil((length(text) - length(regexp_replace(text, '[\\x{{00}}-\\x{{7F}}]', '', 'g'))) / 4.0) + length(regexp_replace(text, '[\\x{{00}}-\\x{{7F}}]', '', 'g')))::BIGINT AS n_tokens FROM x JOIN t USING (id) GROUP BY ALL)"""


def _used(spark, d):
    ev = units.evidence(table(spark, d, "unit_observations")).select("session_id", "page_instance_id", F.col("evidence_blob_id").alias("id")).distinct()
    return projection.usage(ev.join(units.once(table(spark, d, "evidence_blobs")), "id"), ["session_id"])


@query(f"WITH {_USED} SELECT * FROM u")
def projection_usage(spark, d):
    return _used(spark, d)


@query(
    f"WITH {_USED} SELECT *, CASE WHEN n_pages > {limits.PROJECTION_PAGES} OR n_blocks > {limits.PROJECTION_BLOCKS} OR n_bytes > {limits.PROJECTION_BYTES} OR n_tokens > {limits.token_limit(128_000)} THEN 'limit_exceeded' WHEN n_blocks = 0 THEN 'empty' ELSE 'ok' END AS status FROM u"
)
def projection_status(spark, d):
    return projection.with_status(_used(spark, d))


# ---- units and ledger


@query(f"WITH {_UO} SELECT page_instance_id, raw_fingerprint, count(*) AS n, count(*) - 1 AS last_occurrence FROM uo GROUP BY ALL HAVING count(*) > 1")
def occurrence_counter(spark, d):
    return units.occurrences(table(spark, d, "unit_observations"))


_V = "'uver-' || left(sha256(canonical_unit_id || '|' || normalizer_version || '|' || stable_content_fingerprint), 17)"


_FULL = f"{_UO}, {_CU}, v AS (SELECT *, {_V} AS version_id FROM uo WHERE capture_extent = 'full' AND canonical_unit_id IN (SELECT id FROM cu))"


@query(f"WITH {_FULL} SELECT version_id, canonical_unit_id, normalizer_version, stable_content_fingerprint, count(*) AS n_observations, arg_min(id, observed_at || '|' || id) AS first_observation FROM v GROUP BY ALL")
def unit_versions(spark, d):
    return units.versions(table(spark, d, "unit_observations"), table(spark, d, "canonical_units"))


@query(f"WITH {_FULL} SELECT version_id, unnest(evidence_blocks).id AS evidence_block_id FROM v")
def version_links(spark, d):
    return units.version_links(table(spark, d, "unit_observations"), table(spark, d, "canonical_units"))


@query(f"WITH {_FULL} SELECT version_id, id AS unit_observation_id, observed_at AS linked_at FROM v")
def version_observation_links(spark, d):
    return units.version_observations(table(spark, d, "unit_observations"), table(spark, d, "canonical_units"))


@query(f"WITH {_UO}, e AS (SELECT id, unnest(evidence_blocks) AS b FROM uo) SELECT id AS unit_observation_id, b.ordinal AS ordinal, b.text_hash AS text_hash, 'ueb-' || left(sha256(id || '|' || b.text_hash || '|' || b.ordinal), 17) AS derived_id FROM e")
def evidence_block_ids(spark, d):
    return units.evidence_block_ids(table(spark, d, "unit_observations"))


# units that share a stable fingerprint are merged: each with the least of them
_PAIRS = "f AS (SELECT DISTINCT stable_content_fingerprint AS f, canonical_unit_id AS id FROM uo), pairs AS (SELECT DISTINCT min(id) OVER (PARTITION BY f) AS a, id AS b FROM f)"


@query(
    f"""WITH RECURSIVE {_UO}, {_CU}, r AS (SELECT id, id AS root, 0 AS k FROM cu UNION ALL SELECT r.id, cu.merged_into, k + 1 FROM r JOIN cu ON r.root = cu.id WHERE cu.merged_into IS NOT NULL AND k < 64),
t AS (SELECT r.id, r.root FROM r JOIN cu ON r.root = cu.id WHERE cu.merged_into IS NULL), {_PAIRS}, l AS (SELECT DISTINCT x.root AS x, y.root AS y FROM pairs JOIN t x ON a = x.id JOIN t y ON b = y.id WHERE x.root != y.root),
b AS (SELECT x, y FROM l UNION SELECT y, x FROM l), c AS (SELECT x AS id, x AS y FROM b UNION SELECT c.id, b.y FROM c JOIN b ON c.y = b.x),
o AS (SELECT c.id, arg_min(cu.id, cu.created_at || '|' || cu.id) AS target FROM c JOIN cu ON c.y = cu.id GROUP BY c.id)
SELECT cu.id, created_at, CASE WHEN target != cu.id THEN target ELSE merged_into END AS merged_into FROM cu LEFT JOIN o ON cu.id = o.id"""
)
def ledger_merge(spark, d):
    shared = units.once(table(spark, d, "unit_observations")).select(F.col("stable_content_fingerprint").alias("f"), F.col("canonical_unit_id").alias("second_id")).distinct()
    pairs = shared.join(shared.groupBy("f").agg(F.min("second_id").alias("first_id")), "f").where("first_id != second_id")
    return ledger.merge(table(spark, d, "canonical_units"), pairs)


@query(
    f"""WITH {_UO}, {_CU}, l AS (SELECT * FROM uo WHERE NOT observed_at < '2026-06'), e AS (SELECT unnest(evidence_blocks) AS b FROM l), lv AS (SELECT * FROM cu WHERE id IN (SELECT canonical_unit_id FROM l)), w AS (SELECT DISTINCT {_V} AS id FROM l WHERE capture_extent = 'full' AND canonical_unit_id IN (SELECT id FROM lv))
SELECT 'observations' AS kind, id FROM l UNION ALL SELECT 'canonical_units', id FROM lv UNION ALL SELECT 'evidence_blocks', b.id FROM e UNION ALL SELECT DISTINCT 'evidence_blobs', id FROM evidence_blobs WHERE id IN (SELECT b.evidence_blob_id FROM e) UNION ALL SELECT 'versions', id FROM w"""
)
def ledger_after_delete(spark, d):
    uo = table(spark, d, "unit_observations")
    left = ledger.delete_observations(uo, table(spark, d, "canonical_units"), table(spark, d, "evidence_blobs"), units.once(uo).where("observed_at < '2026-06'"))
    ids = {"observations": "id", "canonical_units": "id", "evidence_blocks": "block_id", "evidence_blobs": "id", "versions": "version_id"}
    return reduce(DataFrame.unionByName, (left[k].select(F.lit(k).alias("kind"), F.col(c).alias("id")) for k, c in ids.items()))


@query(f"WITH {_UO} SELECT canonical_unit_id, count(*) AS n_observations, arg_max(id, observed_at || '|' || id) AS observation_id, arg_max(observed_at, observed_at || '|' || id) AS observed_at, arg_max(capture_extent, observed_at || '|' || id) AS capture_extent, arg_max(confidence, observed_at || '|' || id) AS confidence FROM uo GROUP BY ALL")
def latest_per_unit(spark, d):
    return units.latest(table(spark, d, "unit_observations"))


@query(f"WITH {_UO} SELECT session_id, page_instance_id, canonical_unit_id, stable_content_fingerprint, capture_extent, arg_min(id, observed_at || '|' || id) AS kept_id, count(*) AS n_links FROM uo GROUP BY ALL")
def cross_snapshot_dedup(spark, d):
    return units.across_snapshots(table(spark, d, "unit_observations"))


@query(f"WITH RECURSIVE {_CU}, r AS (SELECT id, id AS root, 0 AS k FROM cu UNION ALL SELECT r.id, cu.merged_into, k + 1 FROM r JOIN cu ON r.root = cu.id WHERE cu.merged_into IS NOT NULL AND k < 64), t AS (SELECT r.id, r.root FROM r JOIN cu ON r.root = cu.id WHERE cu.merged_into IS NULL) SELECT cu.id, t.root FROM cu LEFT JOIN t ON cu.id = t.id")
def canonical_resolve(spark, d):
    return units.resolved(table(spark, d, "canonical_units"))


@query(f"WITH {_CU} SELECT count(*) FILTER (created_at >= '2026-06') AS added, count(*) FILTER (created_at < '2026-06' AND merged_into IS NOT NULL) AS conflicts, count(*) AS n FROM cu")
def ledger_upsert(spark, d):
    all_units = units.once(table(spark, d, "canonical_units")).select("id", "created_at", "merged_into", "url")
    old = all_units.where("created_at < '2026-06'").withColumn("merged_into", F.lit(None).cast("string"))
    out = units.upsert(old, all_units, "id")
    return out.agg(F.count_if("added").alias("added"), F.count_if("conflict").alias("conflicts"), F.count("*").alias("n"))


@query(
    f"""WITH {_UO}, {_CU}, l AS (SELECT * FROM uo WHERE NOT observed_at < '2026-06'), b AS (SELECT DISTINCT unnest(evidence_blocks).evidence_blob_id AS id FROM l), eb AS (SELECT DISTINCT id FROM evidence_blobs)
SELECT 'observations' AS kind, (SELECT count(*) FROM l) AS kept, (SELECT count(*) FROM uo) - (SELECT count(*) FROM l) AS removed
UNION ALL SELECT 'units', (SELECT count(*) FROM cu WHERE id IN (SELECT canonical_unit_id FROM l)), (SELECT count(*) FROM cu WHERE id NOT IN (SELECT canonical_unit_id FROM l))
UNION ALL SELECT 'blobs', (SELECT count(*) FROM eb WHERE id IN (SELECT id FROM b)), (SELECT count(*) FROM eb WHERE id NOT IN (SELECT id FROM b))"""
)
def reachability_gc(spark, d):
    uo = table(spark, d, "unit_observations")
    gone = units.once(uo).where("observed_at < '2026-06'")
    return units.collect_garbage(uo, table(spark, d, "canonical_units"), table(spark, d, "evidence_blobs"), gone)


@query(f"WITH {_UO} SELECT extraction_mode, count(*) AS n, count(*) FILTER (confidence >= {limits.UNIT_THRESHOLD}) AS n_kept, round(min(confidence), 6) AS lowest FROM uo GROUP BY ALL")
def confidence_filter(spark, d):
    return units.once(table(spark, d, "unit_observations")).groupBy("extraction_mode").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= limits.UNIT_THRESHOLD).alias("n_kept"), F.round(F.min("confidence"), 6).alias("lowest"))


@query(f"WITH {_UO} SELECT id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY observed_at || '|' || id) AS position FROM uo")
def session_observation_order(spark, d):
    # of a repeated id the earliest row, without a time last
    seen = F.struct(F.col("observed_at").isNull().alias("untimed"), "observed_at", "session_id")
    rows = table(spark, d, "unit_observations").groupBy("id").agg(F.min(seen).alias("s")).select("id", "s.session_id", F.concat("s.observed_at", F.lit("|"), "id").alias("k"))
    ranked = projection.with_rank(rows, [F.col("k").asc_nulls_last(), "id"], "position", within=("session_id",))
    return ranked.select("id", "session_id", "position")


# ---- topics: a site is a topic, and so is each capture extent


_MEM = "ts AS (SELECT DISTINCT canonical_unit_id, evidence_block_id, url, capture_extent, observed_at, page_instance_id FROM topic_sources), m AS (SELECT DISTINCT 'site:' || regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)), ':[0-9]+$', ''), '^www\\.', '') AS topic_id, canonical_unit_id FROM ts WHERE url IS NOT NULL UNION SELECT DISTINCT 'extent:' || capture_extent, canonical_unit_id FROM ts), o AS (SELECT DISTINCT canonical_unit_id, page_instance_id, observed_at, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)), ':[0-9]+$', ''), '^www\\.', '') AS domain FROM ts)"


def _members(spark, d):
    ts = table(spark, d, "topic_sources")
    site = F.regexp_replace(U.host(F.col("url")), r"^www\.", "")
    members = ts.where("url is not null").select(F.concat(F.lit("site:"), site).alias("topic_id"), "canonical_unit_id").union(ts.select(F.concat(F.lit("extent:"), "capture_extent"), "canonical_unit_id")).distinct()
    return members, ts.select("canonical_unit_id", "page_instance_id", "observed_at", site.alias("domain")).distinct()


@query(f"WITH {_MEM}, n AS (SELECT topic_id, count(*) AS n_units FROM m GROUP BY ALL), p AS (SELECT topic_id, count(DISTINCT page_instance_id) AS n_pages, count(DISTINCT domain) AS n_domains FROM m JOIN o USING (canonical_unit_id) WHERE observed_at >= '2026-03' AND observed_at <= '2026-08' GROUP BY ALL) SELECT topic_id, n_units, coalesce(n_pages, 0) AS n_pages, coalesce(n_domains, 0) AS n_domains, least(72, greatest(18, round(18 + sqrt(n_units) * 14)))::INT AS display_size FROM n LEFT JOIN p USING (topic_id)")
def topic_stats(spark, d):
    return topics.stats(*_members(spark, d), start="2026-03", end="2026-08")


@query(f"WITH {_MEM}, n AS (SELECT topic_id, count(*) AS n FROM m GROUP BY ALL), s AS (SELECT a.topic_id AS topic_a, b.topic_id AS topic_b, count(*) AS shared FROM m a JOIN m b USING (canonical_unit_id) WHERE a.topic_id < b.topic_id GROUP BY ALL) SELECT topic_a, topic_b, shared, round(shared / (x.n + y.n - shared), 6) AS jaccard, greatest(1, round(shared / (x.n + y.n - shared) * 4))::INT AS width FROM s JOIN n x ON topic_a = x.topic_id JOIN n y ON topic_b = y.topic_id")
def topic_relations(spark, d):
    return topics.relations(_members(spark, d)[0])


@query(
    f"""WITH {_MEM}, n AS (SELECT topic_id, count(*) AS k FROM m GROUP BY ALL), z AS (SELECT topic_id, least(72, greatest(18, round(18 + sqrt(k) * 14)))::INT AS size, row_number() OVER (ORDER BY topic_id) - 1 AS i, count(*) OVER () AS total FROM n),
c AS (SELECT *, greatest(1, floor(sqrt(total))) AS cols FROM z), g AS (SELECT *, 960 / cols AS cw, 640 / ceil(total / cols) AS ch FROM c)
SELECT topic_id, round((i % cols + 0.5) * cw)::INT AS x, round((floor(i / cols) + 0.5) * ch)::INT AS y, round(least(cw * 0.86, greatest(90, size * 2.2)))::INT AS w, round(least(ch * 0.72, greatest(42, size * 0.9)))::INT AS h FROM g"""
)
def topic_layout(spark, d):
    return topics.layout(topics.stats(*_members(spark, d)))


@query(f"WITH {_MEM}, {_UO}, e AS (SELECT canonical_unit_id, unnest(evidence_blocks) AS b FROM uo), t AS (SELECT DISTINCT id, text FROM evidence_blobs) SELECT topic_id, count(*) AS n_blocks, sum(coalesce(length(text), 0))::BIGINT AS chars FROM m JOIN e USING (canonical_unit_id) LEFT JOIN t ON b.evidence_blob_id = t.id GROUP BY ALL")
def topic_detail(spark, d):
    rows = topics.detail(_members(spark, d)[0], units.evidence(table(spark, d, "unit_observations")), table(spark, d, "evidence_blobs"))
    return rows.groupBy("topic_id").agg(F.count("*").alias("n_blocks"), F.sum("chars").alias("chars"))


@query(f"WITH {_UO}, k AS (SELECT unnest(evidence_blocks).id AS id FROM uo), t AS (SELECT DISTINCT evidence_block_id FROM topic_sources) SELECT evidence_block_id FROM t WHERE evidence_block_id NOT IN (SELECT id FROM k)")
def dangling_refs(spark, d):
    refs = table(spark, d, "topic_sources").select("evidence_block_id").distinct()
    return topics.dangling(refs, "evidence_block_id", units.evidence(table(spark, d, "unit_observations")), "block_id")


@query(f"WITH {_UO} SELECT id, len(evidence_blocks) AS n, len(list_distinct(list_transform(evidence_blocks, lambda b: b.text_hash))) AS n_distinct FROM uo WHERE len(evidence_blocks) != len(list_distinct(list_transform(evidence_blocks, lambda b: b.text_hash)))")
def duplicate_claims(spark, d):
    n, u = F.size("evidence_blocks"), F.size(F.array_distinct("evidence_blocks.text_hash"))
    return units.once(table(spark, d, "unit_observations")).select("id", n.cast("long").alias("n"), u.cast("long").alias("n_distinct")).where("n != n_distinct")


# ---- whole scopes

_STATES = f"""{_A}, {_S}, sx AS (SELECT a.*, snap_url, obs_type = 'dom_snapshot' AS is_snap FROM a LEFT JOIN s USING (payload_hash)),
st AS (SELECT page_instance_id, max(state_version) AS v, max(seq_no) AS m, coalesce(arg_max(coalesce(snap_url, url), ord) FILTER (is_snap), arg_min(url, ord)) AS u, arg_max(obs_type, ord) AS last_event_type, arg_max(received_at, ord) AS last_event_received_at FROM sx GROUP BY ALL)"""
_PAGE = "'(?i)^(page|p|pg)=[0-9]+$'"
_MANIFEST = f"""{_STATES}, r AS (SELECT j.* FROM j LEFT JOIN st USING (page_instance_id) WHERE m IS NULL OR seq_no <= m), fp AS (SELECT page_instance_id, arg_min(session_id, ord) AS session_id, min(ord) AS first_ord FROM j GROUP BY ALL),
mb AS (SELECT session_id, min(received_at) AS captured_from, max(received_at) AS captured_to, count(DISTINCT page_instance_id) AS n_pages, count(*) AS n_observations, count(*) FILTER (obs_type = 'capture_failed') AS n_failures FROM r GROUP BY ALL),
dm AS (SELECT session_id, string_agg(origin, ' ' ORDER BY o) AS domains FROM (SELECT session_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, min(ord) AS o FROM r GROUP BY ALL) GROUP BY ALL),
ow AS (SELECT session_id, page_instance_id, v, m, u, first_ord FROM st JOIN fp USING (page_instance_id) WHERE (session_id, page_instance_id) IN (SELECT (session_id, page_instance_id) FROM r)),
wm AS (SELECT session_id, string_agg(page_instance_id || ':' || v || ':' || m, ' ' ORDER BY page_instance_id) AS watermarks FROM ow GROUP BY ALL),
pp AS (SELECT *, list_filter(string_split(regexp_extract(u, '[?]([^#]*)', 1), '&'), lambda x: x != '') AS q, regexp_extract(u, '^(https?://[^/?#]+)', 1) AS origin, regexp_extract(u, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM ow),
pq AS (SELECT *, list_position(list_transform(q, lambda x: regexp_matches(x, {_PAGE})), true) AS k FROM pp),
pg AS (SELECT session_id, origin, CASE WHEN k > 0 THEN path || coalesce('?' || nullif(array_to_string(q[:k - 1] || q[k + 1:], '&'), ''), '') ELSE regexp_replace(regexp_replace(regexp_replace(path, '^(.*?/)(?:page|p)/[0-9]+(/.*)?$', '\\1\\2'), '/{{2,}}', '/', 'g'), '(.)/$', '\\1') END AS path,
  CASE WHEN k > 0 THEN lower(q[k]) ELSE '/page/' || nullif(regexp_extract(path, '^.*?/(?:page|p)/([0-9]+)(?:/.*)?$', 1), '') END AS selector, min(first_ord) AS o FROM pq GROUP BY ALL),
pr AS (SELECT session_id, origin || path || '|' || string_agg(selector, ',' ORDER BY o) AS g, min(o) AS o FROM pg WHERE selector IS NOT NULL GROUP BY session_id, origin, path),
pn AS (SELECT session_id, string_agg(g, ' ' ORDER BY o) AS pagination FROM pr GROUP BY ALL),
gp AS (SELECT session_id, count(*) AS n_gaps FROM (SELECT session_id, obs_type, lag(obs_type) OVER (PARTITION BY session_id, tab_id ORDER BY ord) AS t FROM r WHERE obs_type IN ('authorization_granted', 'authorization_revoked')) WHERE obs_type = 'authorization_revoked' AND t = 'authorization_granted' GROUP BY ALL),
uu AS (SELECT session_id, count(DISTINCT b.text_hash) AS n_units FROM (SELECT session_id, unnest(evidence_blocks) AS b FROM uo) GROUP BY ALL),
mf AS (SELECT mb.*, coalesce(domains, '') AS domains, coalesce(watermarks, '') AS watermarks, coalesce(pagination, '') AS pagination, coalesce(n_gaps, 0) AS n_gaps, coalesce(n_units, 0) AS n_units,
  concat_ws(' ', CASE WHEN pagination IS NOT NULL THEN 'unvisited_pagination' END, 'unmounted_infinite_scroll', 'cross_origin_iframe', 'hidden_or_lazy_content', CASE WHEN n_gaps > 0 THEN 'authorization_gap' END, CASE WHEN n_failures > 0 THEN 'capture_failure' END, 'indistinguishable_absence') AS reasons
  FROM mb LEFT JOIN dm USING (session_id) LEFT JOIN wm USING (session_id) LEFT JOIN pn USING (session_id) LEFT JOIN gp USING (session_id) LEFT JOIN uu USING (session_id))"""


def _manifest(spark, d):
    obs = table(spark, d, "observations")
    counts = units.evidence(table(spark, d, "unit_observations")).groupBy("session_id").agg(F.count_distinct("evidence_blob_id").alias("n_units"))
    return scopes.coverage_manifest(obs, journal.page_state(obs, table(spark, d, "dom_snapshots")), counts)


@query(f"WITH {_UO}, {_MANIFEST} SELECT * FROM mf")
def coverage_manifest(spark, d):
    return _manifest(spark, d)


@query(
    f"""WITH {_A}, h AS (SELECT DISTINCT 'sha256:' || sha256(payload_json) AS payload_hash, payload_json ->> '$.url' AS u, coalesce(payload_json ->> '$.title', '') AS t FROM dom_snapshots),
g AS (SELECT payload_hash, regexp_extract(u, '^(https?://[^/?#]+)', 1) || '|' || regexp_replace(regexp_replace(regexp_extract(u, '^https?://[^/?#]+([^?#]*)', 1), '/{{2,}}', '/', 'g'), '(?:/[0-9]+)*/?$', '') || '|' ||
  array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '[?]([^#]*)', 1), '&'), lambda x: x != '' AND NOT regexp_matches(lower(x), '^(page|p|pg)=[0-9]+$'))), '&') || '|' || t AS g FROM h),
n AS (SELECT page_instance_id, payload_hash, arg_min(state_version, ord) AS state_version, arg_min(id, ord) AS source_observation_id, arg_min(received_at, ord) AS received_at, count(*) AS n_rows, max(ord) AS o FROM a WHERE obs_type = 'dom_snapshot' GROUP BY ALL),
x AS (SELECT * FROM n JOIN g USING (payload_hash)), w AS (SELECT page_instance_id, arg_max(g, o) AS now FROM x GROUP BY ALL), f AS (SELECT page_instance_id, arg_min(session_id, ord) AS session_id FROM j GROUP BY ALL)
SELECT page_instance_id, session_id, payload_hash, state_version, source_observation_id, received_at, n_rows, g = now AS current FROM x JOIN w USING (page_instance_id) JOIN f USING (page_instance_id)"""
)
def scope_snapshots(spark, d):
    return scopes.scope_snapshots(table(spark, d, "observations"), table(spark, d, "dom_snapshots"))


@query()
def ledger_rebuilt(spark, d):
    return scopes.rebuilt_units(table(spark, d, "observations"), table(spark, d, "dom_snapshots"))


_TOKENS = "ceil((length({0}) - length(regexp_replace({0}, '[\\x{{00}}-\\x{{7F}}]', '', 'g'))) / 4.0) + length(regexp_replace({0}, '[\\x{{00}}-\\x{{7F}}]', '', 'g'))"
_BLOCKS = f"""ev AS (SELECT DISTINCT session_id, b.evidence_blob_id AS text_hash, {{{{'capturedAt': observed_at, 'pageInstanceId': page_instance_id, 'ordinal': b.ordinal, 'stateVersion': b.state_version}}}} AS source FROM (SELECT session_id, page_instance_id, observed_at, unnest(evidence_blocks) AS b FROM uo)),
tx AS (SELECT DISTINCT id AS text_hash, text FROM evidence_blobs), fb AS (SELECT session_id, text_hash, text, min(source) AS f, count(*) AS n_sources, list_sort(list(source)) AS sources FROM ev JOIN tx USING (text_hash) GROUP BY ALL),
ub AS (SELECT session_id, count(*) AS n_blocks, sum(octet_length(encode(text)))::BIGINT AS n_bytes, sum({_TOKENS.format("text")})::BIGINT AS n_tokens FROM fb GROUP BY ALL),
us AS (SELECT *, CASE WHEN n_pages > {limits.PROJECTION_PAGES} OR n_blocks > {limits.PROJECTION_BLOCKS} OR n_bytes > {limits.PROJECTION_BYTES} OR n_tokens > {limits.token_limit(128_000)} THEN 'limit_exceeded' ELSE 'ok' END AS status
  FROM (SELECT session_id, count(DISTINCT source.pageInstanceId) AS n_pages FROM ev GROUP BY ALL) JOIN ub USING (session_id)),
nb AS (SELECT session_id, 'b-' || lpad((row_number() OVER (PARTITION BY session_id ORDER BY f, text_hash))::VARCHAR, 4, '0') AS block_id, text_hash, text, n_sources, sources FROM fb WHERE session_id IN (SELECT session_id FROM us WHERE status = 'ok'))""".replace("{{", "{").replace("}}", "}")


def _scope_blocks(spark, d):
    return scopes.scope_blocks(units.evidence(table(spark, d, "unit_observations")), table(spark, d, "evidence_blobs"))


@query(f"WITH {_UO}, {_BLOCKS} SELECT session_id, block_id, text_hash, n_sources, sources[1].pageInstanceId AS first_page, sources[1].capturedAt AS first_at, list_last(sources).pageInstanceId AS last_page FROM nb")
def projection_blocks(spark, d):
    first, last = F.col("sources")[0], F.element_at("sources", -1)
    return _scope_blocks(spark, d)[1].select("session_id", "block_id", "text_hash", "n_sources", first["pageInstanceId"].alias("first_page"), first["capturedAt"].alias("first_at"), last["pageInstanceId"].alias("last_page"))


_LIMITS = f"{{'maxPages': {limits.PROJECTION_PAGES}, 'maxBlocks': {limits.PROJECTION_BLOCKS}, 'maxUtf8Bytes': {limits.PROJECTION_BYTES}, 'maxEstimatedTokens': {limits.token_limit(128_000)}}}"


@query(
    f"""WITH {_UO}, {_MANIFEST}, {_BLOCKS}, dg AS (SELECT session_id, list({{'id': block_id, 'textHash': text_hash, 'sources': sources}} ORDER BY block_id) AS digests FROM nb GROUP BY ALL)
SELECT session_id, status, CASE WHEN status = 'ok' THEN 'sha256:' || sha256(to_json({{'schemaVersion': 1, 'projectionVersion': 1, 'question': '', 'scope': 'demo_session', 'pageStateWatermarks': coalesce(watermarks, ''),
  'coverage': {{'captured_from': coalesce(captured_from, ''), 'captured_to': coalesce(captured_to, ''), 'domains': coalesce(domains, ''), 'pagination': coalesce(pagination, ''), 'reasons': coalesce(reasons, ''), 'unitCount': n_blocks}},
  'blockDigests': digests, 'limits': {_LIMITS}, 'estimatedTokens': us.n_tokens}})::VARCHAR) END AS input_hash FROM us LEFT JOIN dg USING (session_id) LEFT JOIN mf USING (session_id)"""
)
def projection_hashes(spark, d):
    used, blocks = _scope_blocks(spark, d)
    return scopes.projection_hashes(used, blocks, _manifest(spark, d))


_FROM, _TO = "2026-03-01T00:00:00Z", "2026-08-31T23:59:59Z"


@query(
    f"""WITH {_UO}, {_CU}, i AS (SELECT * FROM uo WHERE observed_at::TIMESTAMPTZ BETWEEN '{_FROM}'::TIMESTAMPTZ AND '{_TO}'::TIMESTAMPTZ), la AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY session_id, canonical_unit_id ORDER BY observed_at || '|' || id DESC) = 1),
tx AS (SELECT DISTINCT id AS blob, text FROM evidence_blobs), bl AS (SELECT session_id, canonical_unit_id, unnest(evidence_blocks) AS b, generate_subscripts(evidence_blocks, 1) AS pos FROM la),
ag AS (SELECT session_id, canonical_unit_id, list({{'blockId': b.id, 'text': coalesce(text, '')}} ORDER BY pos) AS evidence, list(b.id ORDER BY b.ordinal, pos) AS refs FROM bl LEFT JOIN tx ON b.evidence_blob_id = blob GROUP BY ALL),
rc AS (SELECT la.session_id, canonical_unit_id, page_instance_id, refs, regexp_extract(lower(cu.url), '^https?://([^/?#:]+)', 1) AS domain, cu.url AS url, to_json({{'unitId': canonical_unit_id, 'extent': capture_extent, 'evidence': evidence}})::VARCHAR AS json FROM la LEFT JOIN ag USING (session_id, canonical_unit_id) LEFT JOIN cu ON canonical_unit_id = cu.id),
bd AS (SELECT session_id, count(*) AS n_units, count(DISTINCT page_instance_id) AS n_pages, count(DISTINCT domain) FILTER (url IS NOT NULL) AS n_domains, '[' || string_agg(json, ',' ORDER BY canonical_unit_id) || ']' AS body, string_agg(canonical_unit_id, '|' ORDER BY canonical_unit_id) AS named, string_agg(nullif(array_to_string(refs, '|'), ''), '|' ORDER BY canonical_unit_id) AS refs FROM rc GROUP BY ALL),
sz AS (SELECT *, octet_length(encode(body))::BIGINT AS n_bytes, ({_TOKENS.format("body").replace("{{", "{").replace("}}", "}")})::BIGINT AS n_tokens FROM bd)
SELECT session_id, n_units, n_pages, n_domains, n_bytes, n_tokens, CASE WHEN n_units > {limits.TOPIC_UNITS} OR n_pages > {limits.PROJECTION_PAGES} OR n_bytes > {limits.PROJECTION_BYTES} OR n_tokens > {limits.TOKEN_CAP} THEN 'limit_exceeded' ELSE 'ok' END AS status,
  CASE WHEN n_units > {limits.TOPIC_UNITS} OR n_pages > {limits.PROJECTION_PAGES} OR n_bytes > {limits.PROJECTION_BYTES} OR n_tokens > {limits.TOKEN_CAP} THEN NULL ELSE 'sha256:' || sha256('{scopes.TOPIC_VERSION}|{scopes.PROMPT_VERSION}|{_FROM}|{_TO}|' || named || '|' || refs || '|' || body) END AS input_hash FROM sz"""
)
def topic_preview(spark, d):
    return scopes.topic_previews(table(spark, d, "unit_observations"), table(spark, d, "canonical_units"), table(spark, d, "evidence_blobs"), _FROM, _TO)


@query(f"WITH {_STATES} SELECT page_instance_id, last_event_type, last_event_received_at FROM st ORDER BY last_event_received_at DESC, page_instance_id LIMIT 1")
def latest_page(spark, d):
    return scopes.latest_page(journal.page_state(table(spark, d, "observations"), table(spark, d, "dom_snapshots")))


# ---- validation


@query("SELECT code, count(*) AS n FROM (SELECT CASE WHEN observed_at < 0 THEN 'observed_at' WHEN try_cast(received_at AS TIMESTAMPTZ) IS NULL THEN 'received_at' WHEN schema_version != 1 THEN 'schema_version' WHEN payload_ref != payload_hash THEN 'payload_ref' END AS code FROM observations) WHERE code IS NOT NULL GROUP BY ALL")
def observation_violations(spark, d):
    bad = validate.observations(table(spark, d, "observations"))
    return bad.select(F.explode("violations").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query()
def snapshot_violations(spark, d):
    bad = validate.snapshots(table(spark, d, "dom_snapshots"))
    return bad.select("msg_id", F.explode("violations").alias("code"))


@query("SELECT id, length(regexp_replace(text, '" + _SP + "', '', 'g')) > 0 AND length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) <= 600 AND NOT regexp_matches(text, '[\\x{00}-\\x{08}\\x{0B}\\x{0C}\\x{0E}-\\x{1F}]') AS bounded, regexp_matches(text, '(?i)<\\s*/?\\s*(?:script|iframe|[a-z][a-z0-9]*(?:\\s[^>]*)?)>') AS markup FROM (SELECT DISTINCT id, text FROM evidence_blobs)")
def text_bounds(spark, d):
    return validate.topic_texts(units.once(table(spark, d, "evidence_blobs")), "id", "text", 600)


# ---- streams over the journal, drained


@query(f"WITH {_J} SELECT page_instance_id, count(*) AS n_observations, max(seq_no) AS high_water, max(received_at) AS last_received_at FROM j GROUP BY ALL")
def stream_live_pages(spark, d):
    return journal_stream.drained(journal_stream.live_pages(journal_stream.journal_stream(spark, f"{d}/observations.parquet")), "complete", "live-pages")


@query(f"WITH {_J} SELECT obs_type, count(*) AS n FROM j GROUP BY ALL")
def stream_type_counts(spark, d):
    return journal_stream.drained(journal_stream.live_types(journal_stream.journal_stream(spark, f"{d}/observations.parquet")), "complete", "live-types")


@query("SELECT DISTINCT id, page_instance_id FROM observations")
def stream_idempotent_intake(spark, d):
    stream = journal_stream.deduplicated(journal_stream.journal_stream(spark, f"{d}/observations.parquet").select("id", "page_instance_id", "received_at"))
    return journal_stream.drained(stream.select("id", "page_instance_id"), "append", "intake")


@query()
def mutation_gate(spark, d):
    marks = journal.accepted(table(spark, d, "observations")).where("obs_type = 'dom_mutation_trigger'")
    return journal_stream.mutation_gate(marks, "page_instance_id", "observed_at")


# ---- units of raw pages


def _inputs(spark, d):
    rows = table(spark, d, "extractor_inputs").dropDuplicates(["source_observation_id"])
    return rows.select(F.col("source_observation_id").alias("record_id"), F.col("safe_url").alias("page_url"), "html")


@query()
def html_units(spark, d):
    return extraction.observations(extraction.extracted(_inputs(spark, d))).drop("text")


@query()
def extraction_status(spark, d):
    return extraction.extracted(_inputs(spark, d)).groupBy("status").agg(F.count("*").alias("n_pages"), F.sum(F.size("units")).alias("n_units"))


@query()
def safe_pages(spark, d):
    return extraction.safe_pages(_inputs(spark, d)).drop("html")


@query()
def question_projection(spark, d):
    """Distinct blocks of the projector's pages per page instance, with usage and verdict: all or nothing."""
    pages = table(spark, d, "projector_pages").dropDuplicates(["input_id"])
    blocks = projection.extracted_blocks(pages, "input_id", "sanitized_html").withColumnRenamed("key", "input_id")
    of_page = pages.select("input_id", "page_instance_id", "captured_at")
    first = blocks.join(of_page, "input_id").groupBy("page_instance_id", "text_hash").agg(F.min_by("text", F.struct("captured_at", "input_id", "ordinal")).alias("text"), F.count("*").alias("n_sources"))
    return projection.with_status(projection.usage(first, ["page_instance_id"]).withColumnRenamed("page_instance_id", "scope"))


@query(f"WITH {_A}, {_S} SELECT page_instance_id, payload_hash, count(*) AS n_rows, min(state_version) AS first_version, max(state_version) AS last_version FROM a WHERE obs_type = 'dom_snapshot' GROUP BY ALL")
def snapshot_versions(spark, d):
    rows = journal.applied(table(spark, d, "observations")).where("obs_type = 'dom_snapshot'")
    return rows.groupBy("page_instance_id", "payload_hash").agg(F.count("*").alias("n_rows"), F.min("state_version").alias("first_version"), F.max("state_version").alias("last_version"))


@query(f"WITH {_J}, n AS (SELECT page_instance_id, session_id, count(*) AS n FROM j GROUP BY ALL), f AS (SELECT page_instance_id, arg_min(session_id, ord) AS first_session FROM j GROUP BY ALL) SELECT session_id, count(*) AS n_pages, count(*) FILTER (session_id = first_session) AS n_own, sum(n)::BIGINT AS n_rows FROM n JOIN f USING (page_instance_id) GROUP BY ALL")
def scope_rows_and_pages(spark, d):
    rows = journal.accepted(table(spark, d, "observations"))
    per = rows.groupBy("page_instance_id", "session_id").agg(F.count("*").alias("n"), F.min("ord").alias("o"))
    first = per.groupBy("page_instance_id").agg(F.min_by("session_id", "o").alias("first_session"))
    return per.join(first, "page_instance_id").groupBy("session_id").agg(F.count("*").alias("n_pages"), F.count_if(F.col("session_id") == F.col("first_session")).alias("n_own"), F.sum("n").alias("n_rows"))


@query(f"WITH {_UO}, {_CU} SELECT uo.id, canonical_unit_id FROM uo WHERE canonical_unit_id NOT IN (SELECT id FROM cu)")
def orphan_observations(spark, d):
    uo = units.once(table(spark, d, "unit_observations")).select("id", "canonical_unit_id")
    return topics.dangling(uo, "canonical_unit_id", table(spark, d, "canonical_units"), "id").select("id", "canonical_unit_id")


@query(f"WITH {_UO} SELECT session_id, capture_extent, count(*) AS n, count(DISTINCT canonical_unit_id) AS n_units, count(DISTINCT stable_content_fingerprint) AS n_contents, count(DISTINCT raw_fingerprint) AS n_raw FROM uo GROUP BY ALL")
def session_units(spark, d):
    return units.once(table(spark, d, "unit_observations")).groupBy("session_id", "capture_extent").agg(
        F.count("*").alias("n"), F.count_distinct("canonical_unit_id").alias("n_units"), F.count_distinct("stable_content_fingerprint").alias("n_contents"), F.count_distinct("raw_fingerprint").alias("n_raw")
    )


@query("SELECT event_type, count(*) AS n, min(ts)::TIMESTAMP AS first_at, max(ts)::TIMESTAMP AS last_at, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def event_summary(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.round(F.avg("value"), 6).alias("mean"))
