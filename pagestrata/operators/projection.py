"""Text blocks of pages, their global de-duplication, numbering, usage and limits."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagestrata import limits
from pagestrata.functions import text as X
from pagestrata.functions.html import attributes, blocks, squeezed
from pagestrata.session import written

# fixed values: elements whose text is never evidence, and roles
_STRIPPED = frozenset("nav header footer aside form dialog svg template".split())
_CONTROLS = "script style noscript button select option label textarea object iframe canvas video audio picture map".split()
_ROLES = frozenset("navigation search banner contentinfo menu menubar toolbar".split())
_CONTROL = re.compile(rf"<({'|'.join(_CONTROLS)})\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>.*?</\1\s*>", re.S | re.I)
_KINDS = {"li": "list_item", "blockquote": "quote", "pre": "code", "td": "table", "th": "table"} | {f"h{k}": "heading" for k in range(1, 7)}
BLOCK = T.StructType([T.StructField("ordinal", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())])


def is_stripped(tag: str, attrs: str | None) -> bool:
    """Whether an element is taken out with all it holds: by its tag, hidden, modal, or by its role."""
    if tag in _STRIPPED:
        return True
    if not attrs or attrs.isspace():
        return False
    a = attributes(attrs)
    return "hidden" in a or "aria-modal" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in _ROLES


def page_blocks(source: str | None, least: int = limits.MIN_BLOCK_CHARS) -> list[dict]:
    """The evidence blocks of a page: text of its main, else its first article, else its body, without what is
    stripped; headings if not empty, others from ``least`` characters without spaces."""
    source = source or ""
    # controls within controls: the outer one closes last
    while (kept := _CONTROL.sub(" ", source)) != source:
        source = kept
    found, boxes = blocks(source)
    bad = {i for i, b in enumerate(boxes) if is_stripped(b.tag, b.attrs)}
    found = [b for b in found if not bad.intersection(b.path)]
    size: dict[int, int] = {}
    for b in found:
        for i in b.path:
            if boxes[i].tag in ("main", "article"):
                size[i] = size.get(i, 0) + len("".join(b.text.split()))
    mains = [i for i in size if boxes[i].tag == "main"]
    root = max(mains, key=lambda i: (size[i], -i)) if mains else next((i for i in sorted(size) if boxes[i].tag == "article" and size[i] >= least), None)
    out, rows = [], {}
    for b in found:
        if root is not None and root not in b.path:
            continue
        row = next((i for i in reversed(b.path) if boxes[i].tag == "tr"), None)
        kind, text = _KINDS.get(b.tag, "paragraph"), squeezed(b.text)
        if kind == "table" and row in rows:
            rows[row]["text"] += " " + text
            continue
        out.append({"kind": kind, "text": text})
        if kind == "table" and row is not None:
            rows[row] = out[-1]
    out = [b for b in out if b["text"] and (b["kind"] == "heading" or len("".join(b["text"].split())) >= least)]
    return [b | {"ordinal": k} for k, b in enumerate(out)]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("ordinal", pa.int32()), ("kind", pa.string()), ("text", pa.string())]))
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([page_blocks(h) for h in batch.column(1).to_pylist()], kind)], names=["key", "blocks"])


def extracted_blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, ordinal, kind, text, text_hash): the evidence blocks of each page."""
    got = pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInArrow(_extract, T.StructType([T.StructField("key", pages.schema[key].dataType), T.StructField("blocks", T.ArrayType(BLOCK))]))
    each = got.select("key", F.explode("blocks").alias("b")).select("key", "b.*")
    return each.withColumn("text", X.normal_block(F.col("text"))).withColumn("text_hash", X.sha256_ref(F.col("text")))


def deduplicated(blocks: DataFrame, order: list[str]) -> DataFrame:
    """One row per text hash: kind and text of its first block in the order given, and how many sources it has."""
    first = F.struct(*order)
    return blocks.groupBy("text_hash").agg(F.min_by(F.struct("kind", "text"), first).alias("f"), F.min(first).alias("first_at"), F.count("*").alias("n_sources")).select("text_hash", "f.kind", "f.text", "first_at", "n_sources")


def with_rank(rows: DataFrame, order: list[str | Column], name: str, parts: int = 256, within: tuple[str, ...] = ()) -> DataFrame:
    """rows with their number, from 1, in a total order, or in that order within each group. Rows are ranged, each range
    counted and numbered from its predecessors' sum, so that no task holds the whole order. The ranges are written: their
    bounds are sampled, so that ranging again to count them would give others."""
    n = min(parts, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = written(rows.repartitionByRange(n, *within, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    size = ranged.groupBy(*within, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = size.select(*(F.col(c).alias(f"_of_{c}") for c in within), F.col("_part").alias("_of_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    same = F.col("_part") == F.col("_of_part")
    for c in within:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    no = F.row_number().over(Window.partitionBy(*within, "_part").orderBy(*order)) + F.col("_base")
    # without groups base has one row a range
    return ranged.join(base if within else F.broadcast(base), same).withColumn(name, no).drop("_part", "_of_part", "_base", *(f"_of_{c}" for c in within))


def numbered(blocks: DataFrame, order: list[str], parts: int = 256) -> DataFrame:
    """blocks with block_id b-0001, b-0002, … in a total order."""
    text = F.col("_no").cast("string")
    return with_rank(blocks, order, "_no", parts).withColumn("block_id", F.concat(F.lit("b-"), F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text))).drop("_no")


def usage(blocks: DataFrame, group: list[str]) -> DataFrame:
    """Pages, blocks, bytes and tokens of each group."""
    return blocks.groupBy(*group).agg(
        F.count_distinct("page_instance_id").alias("n_pages"), F.count("*").alias("n_blocks"), F.sum(X.utf8_bytes(F.col("text"))).alias("n_bytes"), F.sum(X.estimated_tokens(F.col("text"))).alias("n_tokens")
    )


def with_status(used: DataFrame, context: int = 128_000) -> DataFrame:
    """Usage with its verdict: over any limit is refused whole, nothing is cut."""
    over = (F.col("n_pages") > limits.PROJECTION_PAGES) | (F.col("n_blocks") > limits.PROJECTION_BLOCKS) | (F.col("n_bytes") > limits.PROJECTION_BYTES) | (F.col("n_tokens") > limits.token_limit(context))
    return used.withColumn("status", F.when(over, "limit_exceeded").when(F.col("n_blocks") == 0, "empty").otherwise("ok"))
