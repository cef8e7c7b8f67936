"""Payloads in transfer: cut into numbered chunks, put together again and checked by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata import limits


def chunks(payloads: DataFrame, size: int = limits.CHUNK_BYTES) -> DataFrame:
    """(transfer_id, chunk_no, chunk_count, bytes, payload_hash, chunk) of payloads(transfer_id, payload BINARY)."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("payload") / size)).cast("int")
    each = payloads.withColumn("chunk_count", n).withColumn("payload_hash", F.concat(F.lit("sha256:"), F.sha2("payload", 256))).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("chunk_count") - 1)))
    part = F.expr(f"substring(payload, chunk_no * {int(size)} + 1, {int(size)})")
    return each.select("transfer_id", "chunk_no", "chunk_count", F.octet_length("payload").alias("bytes"), "payload_hash", part.alias("chunk"))


def reassembled(parts: DataFrame) -> DataFrame:
    """(transfer_id, payload_hash, payload, complete): repeated chunks count once; complete if all are there, the length is
    as announced and the hash agrees. A transfer is bounded by the largest payload allowed."""
    once = parts.dropDuplicates(["transfer_id", "chunk_no"])
    got = once.groupBy("transfer_id").agg(
        F.first("payload_hash").alias("payload_hash"), F.first("bytes").alias("bytes"), F.first("chunk_count").alias("chunk_count"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("chunk_no", "chunk"))).alias("c")
    )
    whole = F.unhex(F.array_join(F.transform("c", lambda x: F.hex(x["chunk"])), ""))
    got = got.withColumn("payload", whole)
    ok = (F.col("n") == F.col("chunk_count")) & (F.octet_length("payload") == F.col("bytes")) & (F.concat(F.lit("sha256:"), F.sha2("payload", 256)) == F.col("payload_hash"))
    return got.select("transfer_id", "payload_hash", "payload", ok.alias("complete"))
