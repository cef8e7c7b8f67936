"""Problem 6: documents packed into containers of fixed token capacity, by conflict-constrained best fit.

Documents are sized in tokens of a public tokenizer whose file is a parameter. One that exceeds the capacity is
split into full pieces, each a container of its own, and a rest that is packed like any other item. Items are
dealt to shards of about ``shard_items`` by a hash of their id, so that a hot source or a group of copies is
spread over all shards; each shard is packed by itself and leaves at most its last containers unfilled.

Within a shard, items come largest first, but copies of a text that need most of the containers anyway before all others. Open containers are ordered by residual capacity and carry bitmaps of
their sources and of their clusters of copies. The successor search starts at the smallest residual that holds the
item and goes on until it meets the tightest compatible container: two copies of one text never share a
container; a container that would get a second document of one source is passed over while one without it
leaves at most ``slack`` of the capacity more. A new container is opened only if no open one is compatible.

Defined cases: null and empty texts are in no container; documents with equal words are copies of each other unless
``cluster`` names a column of classes; null sources conflict with nothing; extra columns are ignored; repeated
doc_ids count once; a plan whose capacity is null or under 1 gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import reduce
from itertools import batched
from pathlib import Path

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagestrata.llm.words import words
from pagestrata.session import written

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# the published splitting pattern of byte-level BPE vocabularies of this kind
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SIZED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("cluster", T.LongType()), T.StructField("n_tokens", T.LongType())])
PACKED = "plan_id int, container_id string, doc_id long, piece int, n_tokens long, capacity_tokens long"
_loaded: dict = {}


def encoder(name: str, lines: bytes):
    """The tokenizer of a vocabulary file's lines, built once a process."""
    if name not in _loaded:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        _loaded[name] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[name]


def _sizes(vocabulary: str, lines: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, lines.value)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            n = [len(enc.encode_ordinary(t)) for t in texts]
            copy = [xxhash.xxh64_intdigest(" ".join(words(t)).encode("utf-8", "surrogatepass")) - 2**63 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(copy, pa.int64()), pa.array(n, pa.int64())], names=_SIZED.names)

    return run


def sized(documents: DataFrame, vocabulary: str = VOCABULARY, cluster: str | None = None) -> DataFrame:
    """(doc_id, source, cluster, n_tokens) of each document with text."""
    src = documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text").where("doc_id is not null and text is not null and text != ''")
    # a vocabulary is a file of some MB, whatever the input: the driver's copy is sent
    lines = documents.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    out = src.mapInArrow(_sizes(vocabulary, lines), _SIZED).dropDuplicates(["doc_id"])
    if cluster:
        out = out.drop("cluster").join(documents.select(F.col("doc_id").cast("long"), F.xxhash64(cluster).alias("cluster")).dropDuplicates(["doc_id"]), "doc_id")
    return out


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, slack: int, hard: bool = False) -> list[int]:
    """The container of each item; sources and clusters are bitmaps of one bit or none. Items must come largest
    first, those of one cluster together. If hard, no container gets two items of one source."""
    held, by_residual, open_at = [], [[] for _ in range(capacity + 1)], 0
    out, run = [], (0, 0, 0)
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        # containers passed over for an item's copies just before hold one of them: go on behind them
        level, start = run[1:] if cluster and run[0] == cluster else (size, 0)
        level, found, second, seen = max(level, size), None, None, (level, start)
        while True:
            rest = open_at >> level
            if not rest:
                break
            level_now = level + (rest & -rest).bit_length() - 1
            if second and level_now - second[0] > slack:
                break
            row = by_residual[level_now]
            for j in range(start if level_now == level else 0, len(row)):
                b = held[row[j]]
                if b[1] & cluster:
                    continue
                if b[0] & source:
                    second = second or (None if hard else (level_now, j))
                    continue
                found = (level_now, j)
                break
            if found:
                break
            level, start = level_now + 1, 0
        take = second if second and not (found and found[0] - second[0] <= slack) else found
        if take:
            k = by_residual[take[0]].pop(take[1])
            if not by_residual[take[0]]:
                open_at &= ~(1 << take[0])
            left = take[0] - size
            held[k][0] |= source
            held[k][1] |= cluster
            seen = take if not second or take == second else seen
        else:
            k, left = len(held), capacity - size
            held.append([source, cluster])
            seen = (capacity + 1, 0)
        run = (cluster, *seen)
        by_residual[left].append(k)
        if left:
            open_at |= 1 << left
        out.append(k)
    return out


def _bits(values: pd.Series, most: int | None = None) -> list[int]:
    """A bit for each value that stands more than once, none for the others and for nulls."""
    often = values[values.notna() & values.duplicated(keep=False)].unique()
    bit = {v: 1 << k for k, v in enumerate(often)}
    return [bit.get(v, 0) for v in values]


def _pack(slack: float, hard: bool):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        capacity, plan, no = int(shard.capacity_tokens.iloc[0]), int(shard.plan_id.iloc[0]), int(shard.shard.iloc[0])
        # copies that need more than half of all containers anyway come first, that the others may fill these up
        copies = shard.groupby("cluster")["doc_id"].transform("size")
        shard = shard.assign(first=(copies > 1) & (2 * copies > -(-int(shard.n_tokens.sum()) // capacity)))
        shard = shard.sort_values(["first", "n_tokens", "cluster", "doc_id", "piece"], ascending=[False, False, True, True, True], kind="stable")
        full = shard.n_tokens >= capacity
        rest = shard[~full]
        at = best_fit(rest.n_tokens.tolist(), _bits(rest.source), _bits(rest.cluster), capacity, int(slack * capacity), hard)
        first = max(at, default=-1) + 1
        shard = pd.concat([rest.assign(k=at), shard[full].assign(k=range(first, first + int(full.sum())))])
        return pd.DataFrame(
            {"plan_id": plan, "container_id": [f"{plan}-{no}-{k}" for k in shard.k], "doc_id": shard.doc_id, "piece": shard.piece.astype("Int32"), "n_tokens": shard.n_tokens, "capacity_tokens": capacity}
        )

    return run


def pack(documents: DataFrame, plans: DataFrame, vocabulary: str = VOCABULARY, cluster: str | None = None, shard_items: int = 20_000, slack: float = 1 / 64, hard: bool = False, at_once: int = 1000) -> DataFrame:
    """(plan_id, container_id, doc_id, piece, n_tokens, capacity_tokens) for documents(doc_id, source, text) and
    plans(plan_id, capacity_tokens); piece is null for a document that is whole, else its number from 1. Every document goes
    into every plan; plans are settings, read ``at_once`` at a time."""
    items = written(sized(documents, vocabulary, cluster).where("n_tokens > 0"), "p6-sized")
    plan = plans.select(F.col("plan_id").cast("int"), F.col("capacity_tokens").cast("long")).where("plan_id is not null and capacity_tokens >= 1").distinct()
    shards = max(1, -(-items.count() // shard_items))
    cap, parts = F.col("capacity_tokens"), []
    n = F.ceil(F.col("n_tokens") / cap).cast("int")
    for settings in batched(plan.toLocalIterator(), at_once):
        listed = F.array(*(F.struct(F.lit(int(r[0])).alias("plan_id"), F.lit(int(r[1])).cast("long").alias("capacity_tokens")) for r in settings))
        each = items.withColumn("plan", F.explode(listed)).select("*", "plan.*").drop("plan")
        each = each.withColumn("piece", F.explode(F.when(n > 1, F.sequence(F.lit(1), n)).otherwise(F.array(F.lit(None).cast("int")))))
        each = each.withColumn("n_tokens", F.when(F.col("piece").isNull(), F.col("n_tokens")).otherwise(F.least(cap, F.col("n_tokens") - (F.col("piece") - 1) * cap)))
        each = each.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
        parts.append(each.groupBy("plan_id", "shard").applyInPandas(_pack(slack, hard), PACKED))
    return reduce(DataFrame.unionByName, parts) if parts else documents.sparkSession.createDataFrame([], PACKED)


def repeated_sources(packed: DataFrame, documents: DataFrame) -> DataFrame:
    """(plan_id, n_containers, n_repeated): in how many containers of each plan a source has more than one document."""
    source = documents.select(F.col("doc_id").cast("long"), "source").dropDuplicates(["doc_id"])
    per = packed.select("plan_id", "container_id", "doc_id").join(source, "doc_id", "left").groupBy("plan_id", "container_id", "source").agg(F.count("*").alias("n"))
    per = per.groupBy("plan_id", "container_id").agg(F.max(F.when(F.col("source").isNotNull(), F.col("n") > 1)).alias("again"))
    return per.groupBy("plan_id").agg(F.count("*").alias("n_containers"), F.count_if(F.coalesce("again", F.lit(False))).alias("n_repeated"))


def fill(packed: DataFrame) -> DataFrame:
    """(plan_id, n_containers, n_documents, n_split, n_tokens, fill): how full the containers of each plan are."""
    return packed.groupBy("plan_id").agg(
        F.count_distinct("container_id").alias("n_containers"),
        F.count_distinct("doc_id").alias("n_documents"),
        F.count_distinct(F.when(F.col("piece").isNotNull(), F.col("doc_id"))).alias("n_split"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_tokens") / (F.count_distinct("container_id") * F.max("capacity_tokens"))).alias("fill"),
    )
