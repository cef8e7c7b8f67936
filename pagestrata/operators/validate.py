"""Structural checks: every violation of a row as a list of codes, none thrown away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.functions import text as X

# fixed values: what an observation may be, and the fields of a snapshot payload
TYPES = ("authorization_granted", "authorization_revoked", "capture_paused", "capture_resumed", "document_started", "dom_snapshot", "capture_failed", "dom_mutation_trigger", "navigation_metadata_changed")
SNAPSHOT_KEYS = ("schemaVersion", "kind", "captureVersion", "reason", "url", "title", "contentEpoch", "html", "stats")


def violations(*rules: tuple[str, Column]) -> Column:
    """Codes of the rules that fail; a rule that cannot be decided fails."""
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules)), lambda c: c.isNotNull())


def observations(obs: DataFrame) -> DataFrame:
    """(ord, id, violations) of journal rows."""
    hash_ok = lambda c: F.col(c).rlike("^sha256:[0-9a-f]{64}$")
    rules = (
        ("schema_version", F.col("schema_version") == 1),
        ("id", F.length("id").between(1, 128)),
        ("type", F.col("obs_type").isin(*TYPES)),
        ("sequence", F.col("seq_no") >= 0),
        ("content_epoch", F.col("content_epoch") >= 0),
        ("received_at", F.try_to_timestamp("received_at").isNotNull()),
        ("payload_hash", hash_ok("payload_hash")),
        ("payload_ref", F.col("payload_ref") == F.col("payload_hash")),
        ("url", F.try_parse_url("url", F.lit("HOST")).isNotNull()),
        ("observed_at", F.col("observed_at").isNull() | (F.col("observed_at") >= 0)),
    )
    return obs.select("ord", "id", violations(*rules).alias("violations"))


def snapshots(snaps: DataFrame) -> DataFrame:
    """(msg_id, violations) of snapshot payloads: JSON, exactly the known fields, and stats that agree with the html."""
    j = F.col("payload_json")
    keys, html = F.json_object_keys(j), F.get_json_object(j, "$.html")
    rules = (
        ("json", keys.isNotNull()),
        ("unknown_key", F.size(F.array_except(keys, F.array(*map(F.lit, SNAPSHOT_KEYS)))) == 0),
        ("missing_key", F.size(F.array_except(F.array(*map(F.lit, SNAPSHOT_KEYS)), keys)) == 0),
        ("kind", F.get_json_object(j, "$.kind") == "dom_snapshot"),
        ("html_bytes", F.get_json_object(j, "$.stats.htmlUtf8Bytes").cast("long") == X.utf8_bytes(html)),
        ("content_epoch", F.get_json_object(j, "$.contentEpoch").cast("long") == F.col("content_epoch")),
        ("title", X.utf16_length(F.coalesce(F.get_json_object(j, "$.title"), F.lit(""))) <= 512),
    )
    return snaps.select("msg_id", violations(*rules).alias("violations")).dropDuplicates(["msg_id"])


def topic_texts(rows: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """(id, bounded, html): whether a text is in bounds and whether it looks like markup."""
    t = F.col(text_col)
    return rows.select(id_col, X.is_bounded(t, most).alias("bounded"), t.rlike(r"(?i)<\s*/?\s*(?:script|iframe|[a-z][a-z0-9]*(?:\s[^>]*)?)>").alias("markup"))
