"""Problem 4: lines that stand on a large share of one site's documents.

Lines are masked (numbers, dates and punctuation fall out with everything that is not a letter; months, titles and runs of
two and more capitalised words inside a line, which are names, are left out of the signature) and the distinct masked lines of
a site are clustered: locality-sensitive hashing (min-wise samples over letter shingles, cut into bands) tells which to
compare; within a bucket each line is compared with the bucket's leaders, lines near to none of them becoming leaders: near are
lines whose sketches (256 bits, each the mark of shingles) do not show that they differ in too many shingles. What is near is then
compared shingle by shingle and linked if the similarity is at least ``SIMILAR``; linked lines, and lines of equal letters, are one cluster.
Clusters that enough documents hold are repeated, each document counting once however many of the lines it has; their
lines are removed. A pair of lines at a similarity of 0.7 shares no bucket in 0.6 % of cases, at 0.8 in 0.02 %.

For the exact form of the problem, a line of a repeated cluster must itself, letter for letter, stand in enough documents.

Counting is done on (cluster, document) pairs of hashes, aggregated before they are shuffled, so a site with a third of
all rows is no heavier than its distinct lines. A bucket is read as a stream of which the leaders are held.

Defined cases: rows with null text or without a url that names a host are left out (and kept unchanged by
``cleaned``); lines without letters are never repeated; repeated rows (same id) count once; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagestrata.llm.near_duplicates import groups
from pagestrata.llm.words import mix, nfc
from pagestrata.llm.wrappers import MONTHS
from pagestrata.session import written

SHARE, LEAST, BANDS, ROWS, GRAM, SIMILAR = 0.05, 5, 12, 3, 5, 0.7
_LINES = "id string, site string, line_no int, key long, node long, mask string"
_ENTRY = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("node", T.LongType())])
_SKETCH = T.StructType([T.StructField(n, T.LongType()) for n in ("node", "n", "b0", "b1", "b2", "b3")])
_LINK = T.StructType([T.StructField("id_a", T.LongType()), T.StructField("id_b", T.LongType())])
_NO_LETTER = bytes(k for k in range(128) if not chr(k).isalpha())
_UPPER = "A-ZÀ-ÖØ-Þ"
# fixed values: titles before a name
_TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra|Don|Doña"
_NAMED = re.compile(rf"(?<=\S\s)(?:(?:{_TITLES})\.?\s+[{_UPPER}][\w'’-]*|[{_UPPER}][\w'’-]*)(?:\s+(?:[{_UPPER}]\.\s+)?[{_UPPER}][\w'’-]+)+|(?<=\S\s)(?:{_TITLES})\.?\s+[{_UPPER}][\w'’-]+")
# no name is without two capitalised words in a row, no date without a digit
_TWO, _DIGIT = re.compile(rf"\s[{_UPPER}]\S*\s+[{_UPPER}]"), re.compile(r"\d")
_MONTHS = tuple(MONTHS.split())
_DATED = re.compile(rf"\d[\W_]*(?:{'|'.join(MONTHS.split())})\b|\b(?:{'|'.join(MONTHS.split())})[\W_]*\d", re.I)


def site_of(url: Column) -> Column:
    """The url's host in lower case without port and leading www.; null where there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:\\]+)", 1)
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def letters(line: str) -> str:
    """A line's letters, in lower case."""
    return line.lower().encode().translate(None, _NO_LETTER).decode() if line.isascii() else "".join(filter(str.isalpha, nfc(line).lower()))


def masked(line: str) -> str:
    """A line's letters without names and dates; all letters if nothing else is there."""
    own = _NAMED.sub(" ", line) if _TWO.search(line) else line
    if _DIGIT.search(own):
        low = own.lower()
        own = _DATED.sub(" ", own) if any(m in low for m in _MONTHS) else own
    return letters(own) or letters(line)


def _shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the letter shingles of all texts, and how many each has; shorter texts are one shingle."""
    codes = np.frombuffer("".join(t.ljust(GRAM) for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = np.fromiter((max(len(t), GRAM) for t in texts), np.int64, len(texts))
    grams, starts = np.zeros(len(codes), np.uint64), np.append(0, np.cumsum(n))[:-1]
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            grams[: len(codes) - k] = grams[: len(codes) - k] * np.uint64(0x9E3779B97F4A7C15) + codes[k:]
    grams = mix(grams, 3)
    inside = np.arange(len(codes)) - np.repeat(starts, n) <= np.repeat(n, n) - GRAM
    return grams[inside], n - GRAM + 1


def _buckets(texts: list[str]) -> np.ndarray:
    """Band hashes of each text's shingles."""
    grams, count = _shingles(texts)
    starts = np.append(0, np.cumsum(count))[:-1]
    out = np.empty((len(texts), BANDS), np.uint64)
    factors, turned = mix(np.arange(BANDS * ROWS, dtype=np.uint64), 100) | np.uint64(1), np.empty_like(grams)
    for b in range(BANDS):
        key = np.full(len(texts), b, np.uint64)
        for r in range(ROWS):
            # shingles are hashes already: an odd factor orders them anew
            np.multiply(grams, factors[b * ROWS + r], out=turned)
            key = mix(key ^ np.minimum.reduceat(turned, starts), 9)
        out[:, b] = key
    return out.view(np.int64)


def _hash(site: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{site}\n{text}".encode("utf-8", "surrogatepass")) - 2**63


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines with letters; a masked line is spelled out once a task, and known by its node, which is null where it is the key."""
    told: set[int] = set()
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            row, no, keys, nodes, masks, memo = [], [], [], [], [], {}
            for k, (site, text) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                for j, line in enumerate(text.split("\n")):
                    at = memo.get((site, line))
                    if at is None:
                        key = letters(line)
                        mask = masked(line) if key and (_TWO.search(line) or _DIGIT.search(line)) else key
                        at = memo[site, line] = (_hash(site, key), _hash(site, mask), mask) if key else ()
                    if at:
                        row.append(k)
                        no.append(j + 1)
                        keys.append(at[0])
                        nodes.append(at[1] if at[1] != at[0] else None)
                        masks.append(None if at[1] in told else at[2])
                        if len(told) > 1_000_000:
                            told.clear()
                        told.add(at[1])
            if row:
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(row) for c in range(2)), pa.array(no, pa.int32()), pa.array(keys, pa.int64()), pa.array(nodes, pa.int64()), pa.array(masks, pa.string())],
                    names=["id", "site", "line_no", "key", "node", "mask"],
                )


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 5000):
            part = batch.slice(lo, 5000)
            site, node = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            buckets = mix(_buckets(part.column(2).to_pylist()).view(np.uint64) ^ site.view(np.uint64)[:, None], 11).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(buckets.reshape(-1)), pa.array(np.repeat(node, BANDS))], names=_ENTRY.names)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bucket and node, those of buckets of more than one node, each once."""
    last, told = np.zeros((0, 2), np.int64), False  # the last row, and whether it has been given already
    for batch in batches:
        rows = np.concatenate([last, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)])
        if not len(rows):
            continue
        rows = rows[np.append(True, (rows[1:] != rows[:-1]).any(1))]
        same = rows[1:, 0] == rows[:-1, 0]
        keep = np.append(False, same) | np.append(same, False)
        keep[0] &= not told
        last, told = rows[-1:], bool(keep[-1]) or told and len(rows) == 1
        yield pa.RecordBatch.from_arrays([pa.array(rows[keep, k].copy()) for k in (0, 1)], names=_ENTRY.names)


def _distinct(masks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, as 40 bits of their hashes behind the number of the text, and how many each has."""
    grams, count = _shingles(masks)
    both = np.sort(np.repeat(np.arange(len(masks)).astype(np.uint64), count) << np.uint64(40) | grams >> np.uint64(24))
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    return both, np.bincount((both >> np.uint64(40)).astype(np.int64), minlength=len(masks))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, n, b0, b1, b2, b3): how many distinct shingles a masked line has, and 256 bits that they mark."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 5000):
            part = batch.slice(lo, 5000)
            both, count = _distinct(part.column(1).to_pylist())
            starts, bits = np.cumsum(count) - count, []
            for k in range(4):
                one = np.where((both >> np.uint64(6)) & np.uint64(3) == k, np.uint64(1) << (both & np.uint64(63)), np.uint64(0))
                bits.append(np.bitwise_or.reduceat(one, starts).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count.astype(np.int64)), *map(pa.array, bits)], names=_SKETCH.names)


class Leaders:
    """Of blocks of rows (bucket, node, n, bits) sorted by bucket: each line with the leaders of its bucket that it is near to.
    A line that is near to none becomes a leader; the last bucket's leaders are held for the next block."""

    def __init__(self):
        self.held = [np.zeros(0, np.int64)] * 7

    def __call__(self, cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        old = len(self.held[0])
        bucket, node, count, *bits = (np.concatenate(x) for x in zip(self.held, cols, strict=True))
        reach = (1 - SIMILAR) / (1 + SIMILAR)
        # leaders of the block before come first in their bucket and are not compared with each other
        todo, free, out, tops = np.arange(len(node)), np.ones(len(node), bool), [], []
        while len(todo):
            first = np.append(True, bucket[todo[1:]] != bucket[todo[:-1]])
            group = np.cumsum(first) - 1
            # the first line of each bucket that is near to no leader so far
            lead = np.full(group[-1] + 1, -1)
            some = np.flatnonzero(free[todo])[::-1]
            lead[group[some]] = todo[some]
            todo, group = todo[lead[group] >= 0], group[lead[group] >= 0]
            b = lead[group]
            tops.append(lead[lead >= 0])
            todo, b = todo[todo != b], b[todo != b]
            apart = sum(np.bitwise_count((x[todo] ^ x[b]).view(np.uint64)).astype(np.int64) for x in bits)
            near = (apart <= reach * (count[todo] + count[b]) + 1e-9) & ~((todo < old) & (b < old))
            out.append((node[todo[near]], node[b[near]]))
            free[b] = False
            free[todo[near]] = False
        keep = np.concatenate(tops) if tops else np.zeros(0, np.int64)
        keep = np.sort(keep[bucket[keep] == bucket[-1]]) if len(bucket) else keep
        self.held = [x[keep] for x in (bucket, node, count, *bits)]
        return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    leaders = Leaders()
    for batch in batches:
        for lo in range(0, batch.num_rows, 20_000):
            part = batch.slice(lo, 20_000)
            cols = [c.to_numpy(zero_copy_only=False) for c in part.columns]
            a, b = leaders(cols)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=_LINK.names)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (id_a, id_b, mask_a, mask_b), the pairs whose shingles are similar enough."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 5000):
            part = batch.slice(lo, 5000)
            (a, n_a), (b, n_b) = (_distinct(part.column(k).to_pylist()) for k in (2, 3))
            common = np.bincount((np.intersect1d(a, b, assume_unique=True) >> np.uint64(40)).astype(np.int64), minlength=part.num_rows)
            hit = pa.array(common >= SIMILAR * (n_a + n_b - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([part.column(k).filter(hit) for k in (0, 1)], names=_LINK.names)


def clusters(lines: DataFrame) -> DataFrame:
    """(node, cluster) of the masked lines that are not their own cluster alone."""
    told = lines.where("mask is not null").select("at", "node", "mask")
    shared = told.mapInArrow(_entries, _ENTRY).repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(_shared, _ENTRY)
    nodes = told.groupBy("node").agg(F.min("mask").alias("mask"))
    near = shared.join(nodes.mapInArrow(_sketches, _SKETCH), "node").select("bucket", *_SKETCH.names)
    near = written(near.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_near, _LINK).distinct(), "p4-near")
    side = lambda k: nodes.select(F.col("node").alias(f"id_{k}"), F.col("mask").alias(f"mask_{k}"))
    near = near.join(side("a"), "id_a").join(side("b"), "id_b").select("id_a", "id_b", "mask_a", "mask_b").mapInArrow(_alike, _LINK)
    equal = lines.select("key", "node").distinct()
    least = equal.groupBy("key").agg(F.min("node").alias("id_b"), F.max("node").alias("top")).where("top != id_b").drop("top")
    equal = equal.join(least, "key").where("node != id_b").select(F.col("node").alias("id_a"), "id_b")
    return groups(near.unionByName(equal).distinct()).select(F.col("id").alias("node"), F.col("class_id").alias("cluster"))


def repeated_lines(sources: DataFrame, id_col: str = "evidence_block_id", text_col: str = "text", url_col: str = "url", share: float = SHARE, least: int = LEAST, exact: bool = True) -> DataFrame:
    """(id, line_no) of each line whose cluster stands in at least share of its site's documents and in at least
    ``least`` of them; if exact, whose own letters do so too."""
    src = sources.select(F.col(id_col).cast("string").alias("id"), site_of(F.col(url_col)).alias("site"), F.col(text_col).alias("text"))
    src = src.where("id is not null and site is not null and text is not null")
    site, row = F.xxhash64("site").alias("at"), F.xxhash64("id").alias("row")
    lines = written(src.mapInArrow(_lines, _LINES), "p4-lines").select("id", row, site, "line_no", "key", F.coalesce("node", "key").alias("node"), "mask")
    # a repeated row is dropped by its id alone: the texts stay where they are
    limit = src.select(site, row).distinct().groupBy("at").agg(F.greatest(F.lit(least), F.ceil(F.count("*") * F.lit(share) - 1e-9)).alias("limit"))
    limit = written(limit, "p4-limits")

    def often(rows: DataFrame, by: str) -> DataFrame:
        """Of rows(by, at, row), the values of by that stand in enough documents."""
        df = rows.select(by, "at", "row").distinct().groupBy(by, "at").agg(F.count("*").alias("df")).where(F.col("df") >= least)
        return df.join(limit, "at").where("df >= limit").select(by)

    of = written(clusters(lines), "p4-clusters")
    hot = often(lines.join(of, "node", "left").withColumn("cluster", F.coalesce("cluster", "node")), "cluster")
    hot = written(hot, "p4-hot")
    nodes = hot.join(of, "cluster").select("node").unionByName(hot.select(F.col("cluster").alias("node"))).distinct()
    out = lines.join(nodes, "node", "left_semi")
    if exact:
        out = out.join(often(out, "key"), "key", "left_semi")
    return out.select("id", "line_no").distinct()


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            drop = set(gone or ())
            out.append(text if not drop else "\n".join(x for k, x in enumerate(text.split("\n"), 1) if k not in drop))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array([len(g or ()) for g in batch.column(2).to_pylist()], pa.int32())], names=["id", "text", "n_removed"])


def cleaned(sources: DataFrame, id_col: str = "evidence_block_id", text_col: str = "text", url_col: str = "url", **how) -> DataFrame:
    """(id, text, n_removed): each text without the lines of its site's repeated clusters."""
    gone = repeated_lines(sources, id_col, text_col, url_col, **({"exact": False} | how)).groupBy("id").agg(F.collect_list("line_no").alias("gone"))
    texts = sources.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).dropDuplicates(["id"])
    return texts.join(gone, "id", "left").select("id", "text", "gone").mapInArrow(_strip, "id string, text string, n_removed int")
