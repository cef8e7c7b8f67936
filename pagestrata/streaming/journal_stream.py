"""The journal as a stream: idempotent intake, live page watermarks, and the gate that merges bursts of changes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagestrata import limits
from pagestrata.operators.journal import with_prior
from pagestrata.session import shared_dir


def journal_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """New files of a journal folder as they come."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    files = spark.read.parquet(path).inputFiles()
    if len(files) == 1 and files[0].rpartition("/")[2] == path.rpartition("/")[2]:  # a journal of one file: its folder, that name
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def drained(stream: DataFrame, mode: str, tag: str) -> DataFrame:
    """What a stream gives over all that is there now, as a table in the shared folder. Each batch writes a folder of its own,
    so that a batch that comes twice takes its own place; the last batch of a complete stream holds the whole result."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/pagestrata/{tag}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={0 if mode == 'complete' else k}")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/rows").select(stream.columns)


def deduplicated(stream: DataFrame, days: int = limits.TTL_DAYS) -> DataFrame:
    """Each observation once, however often it is delivered within so many days of receipt: what is older leaves the state, and
    rows received that much before the latest are late and left out. Rows without a readable time of receipt are left out."""
    timed = stream.withColumn("_at", F.try_to_timestamp("received_at")).where("_at is not null")
    return timed.withWatermark("_at", f"{days} days").dropDuplicatesWithinWatermark(["id"]).drop("_at")


def live_pages(stream: DataFrame) -> DataFrame:
    """Rows, highest sequence number and last receipt of each page so far."""
    return deduplicated(stream).groupBy("page_instance_id").agg(F.count("*").alias("n_observations"), F.max("seq_no").alias("high_water"), F.max("received_at").alias("last_received_at"))


def live_types(stream: DataFrame) -> DataFrame:
    return deduplicated(stream).groupBy("obs_type").agg(F.count("*").alias("n"))


def append_new(batch: DataFrame, path: str, key: str = "id") -> None:
    """A sink for foreachBatch: appends the rows whose key the table does not hold, so a batch may come twice."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates([key])
    try:
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    except Exception as e:  # the first batch
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
    fresh.write.mode("append").parquet(path)


def _fires(quiet: float, most: float):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Marks come sorted by burst and time; a round ends ``most`` after its first mark, or ``quiet`` after its last."""
        at = None  # (burst, page, first mark, last mark, marks)
        for part in parts:
            out = []
            for burst, page, t in zip(part.burst_key, part.page, part.t, strict=True):
                if at and (burst != at[0] or t >= min(at[2] + most, at[3] + quiet)):
                    out.append((at[1], min(at[2] + most, at[3] + quiet), at[4]))
                    at = None
                at = (burst, page, at[2], t, at[4] + 1) if at else (burst, page, t, t, 1)
            yield pd.DataFrame(out, columns=["page", "fired_at", "n_marks"])
        if at:
            yield pd.DataFrame([(at[1], min(at[2] + most, at[3] + quiet), at[4])], columns=["page", "fired_at", "n_marks"])

    return run


def mutation_gate(marks: DataFrame, page: str, time: str, quiet_ms: float = limits.DEBOUNCE_MS, most_ms: float = limits.MAX_WAIT_MS) -> DataFrame:
    """(page, fired_at, n_marks): when bursts of marks are let through. A pause of quiet_ms always ends a round, so a page's
    marks are parted at its pauses first and bursts are dealt out one by one."""
    m = marks.select(F.col(page).alias("page"), F.col(time).cast("double").alias("t")).where("page is not null and t is not null")
    prior = with_prior(m.withColumn("tick", (F.col("t") * 1000).cast("long")), "page", "tick", ("t",), block=3_600_000_000)
    starts = prior.where(F.col("prior").isNull() | (F.col("t") - F.col("prior.t") >= quiet_ms)).select("page", F.col("tick").alias("burst_tick")).distinct()
    # the burst of a mark is the number of burst starts up to it
    both = prior.select("page", "tick", "t", F.lit(0).alias("start")).unionByName(starts.select("page", F.col("burst_tick").alias("tick"), F.lit(None).cast("double").alias("t"), F.lit(1).alias("start")))
    numbered = with_running_sum(both, "page", "tick", "start")
    keyed = numbered.where("t is not null").withColumn("burst_key", F.xxhash64("page", "burst"))
    return keyed.repartition("burst_key").sortWithinPartitions("burst_key", "t").select("burst_key", "page", "t").mapInPandas(_fires(quiet_ms, most_ms), "page string, fired_at double, n_marks long")


def with_running_sum(df: DataFrame, key: str, order: str, value: str, block: int = 3_600_000_000) -> DataFrame:
    """df with ``burst``: the sum of the value over the key's rows up to and with each, starts before marks of one time."""
    b = df.withColumn("_block", F.floor(F.col(order) / block))
    per = b.groupBy(key, "_block").agg(F.sum(value).alias("_n"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(key, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, "_block").orderBy(F.col(order), F.col(value).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return b.join(per, [key, "_block"]).withColumn("burst", F.col("_before") + F.sum(value).over(inside)).drop("_block", "_before")
