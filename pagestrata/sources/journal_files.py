"""The journal as lines of JSON, and payloads by hash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBSERVATION = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("ord", T.LongType()), ("schema_version", T.IntegerType()), ("id", T.StringType()), ("session_id", T.StringType()), ("tab_id", T.StringType()), ("page_instance_id", T.StringType()),
        ("content_epoch", T.LongType()), ("frame_id", T.StringType()), ("seq_no", T.LongType()), ("observed_at", T.DoubleType()), ("received_at", T.StringType()), ("url", T.StringType()),
        ("obs_source", T.StringType()), ("obs_type", T.StringType()), ("payload_ref", T.StringType()), ("payload_hash", T.StringType()), ("redaction_policy", T.StringType()), ("capture_version", T.StringType()),
    )]
)


#: Fields that a whole observation must have.
REQUIRED = tuple(f.name for f in OBSERVATION.fields if f.name not in ("ord", "frame_id", "observed_at"))


def read_journal(spark: SparkSession, path: str, required: tuple[str, ...] = ("id",)) -> DataFrame:
    """The rows of a journal of JSON lines. Blank lines are skipped; a file's last line may be torn and is then left out;
    any other line that lacks a required field, or has it in another type, fails the read with its file (``REQUIRED`` for whole observations)."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")).where(F.length(F.trim("value")) > 0)
    rows = lines.withColumn("r", F.from_json("value", OBSERVATION)).withColumn("ok", reduce(Column.__and__, (F.col(f"r.{c}").isNotNull() for c in required)))
    last = lines.groupBy("file").agg(F.max("line").alias("line")).withColumn("last", F.lit(True))
    bad = rows.where("not ok").join(last, ["file", "line"], "left").where("last is null").select("file").limit(1).collect()
    if bad:
        raise ValueError(f"corrupt journal line in {bad[0][0]}")
    return rows.where("ok").select("r.*")


def write_journal(rows: DataFrame, path: str) -> None:
    rows.select(*(F.col(f.name).cast(f.dataType) for f in OBSERVATION.fields)).write.mode("append").json(path)


def write_payloads(payloads: DataFrame, path: str, key: str = "payload_hash") -> None:
    """Payloads not yet held, by the first two digits of their hash."""
    spark = payloads.sparkSession
    new = payloads.dropDuplicates([key]).withColumn("shard", F.substring(key, 8, 2))
    try:
        held = spark.read.parquet(path).select(key)
    except Exception as e:  # nothing there yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        held = None
    if held is not None:
        new = new.join(held, key, "left_anti")
    new.write.mode("append").partitionBy("shard").parquet(path)


def read_payloads(spark: SparkSession, path: str, key: str = "payload_hash", body: str = "payload") -> DataFrame:
    """Held payloads with ``intact``: whether the bytes still have their hash."""
    return spark.read.parquet(path).withColumn("intact", F.concat(F.lit("sha256:"), F.sha2(F.col(body).cast("binary"), 256)) == F.col(key))
