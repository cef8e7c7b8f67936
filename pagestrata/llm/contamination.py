"""Problem 7: evaluation items inside documents, by a prefix-filtered set join of word shingles.

An item leaks into a document that holds window words of it in a row (or all its words, if it has fewer). Items
and documents are cut into shingles of ``shingle`` words. A window lies in a document only if all its shingles
do, so one of them is enough as its prefix: the rarest in the whole corpus. Documents are joined on these prefix
shingles only, the window's place follows from the shingle's place in both (positional bound), windows that would
reach over the document's start or end are dropped (length bound), and what is left is compared word for word.

The items' shingles go to the tasks as a set only after their number has been checked against ``most_shipped``;
beyond it the document's shingles are joined with them by a shuffle. Both ways give the same rows.

Defined cases: null and empty texts contain nothing, items without words are found nowhere; repeated items and
documents give one row per pair of ids; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagestrata.llm.words import Coder, mix, words
from pagestrata.session import written

WINDOW, SHINGLE = 12, 4
_PLACED = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_words", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("shingle", T.LongType())])


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words in a row, at each start."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n if len(out) else 0):
        out = mix(out ^ h[k : k + len(out)], 11 + k)
    return out


def _placed(widths: tuple[int, ...], among: np.ndarray | None, own_width: bool):
    """Shingles with their places; only those of a sorted array, if one is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                h, n = coder([words(t) for t in part.column(1).to_pylist()])
                ids, ends = part.column(0).to_numpy(zero_copy_only=False), np.cumsum(n)
                doc = np.repeat(np.arange(len(n)), n)
                for w in widths:
                    s = _rolled(h, w).view(np.int64)
                    at = np.arange(len(s))
                    d = doc[: len(s)]
                    keep = at + w <= ends[d]
                    if own_width:  # an item shorter than a shingle is one shingle of its own width
                        keep &= np.minimum(n[d], max(widths)) == w
                    if among is not None and len(among):
                        keep &= among[np.minimum(np.searchsorted(among, s), len(among) - 1)] == s
                    elif among is not None:
                        keep[:] = False
                    at, d = at[keep], d[keep]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[d]), pa.array(n[d].astype(np.int32)), pa.array(np.full(len(at), w, np.int32)), pa.array((at - ends[d] + n[d]).astype(np.int32)), pa.array(s[keep])],
                        names=_PLACED.names,
                    )

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, item_id, item_text, places) whose windows hold the same words."""
    for batch in batches:
        doc_id, text, item_id, item_text, places = (c.to_pylist() for c in batch.columns)
        hit, seen = [], {}
        for k, t in enumerate(text):
            if t not in seen:
                seen = {t: words(t)}
            d, i = seen[t], words(item_text[k])
            hit.append(any(d[p["doc_at"] : p["doc_at"] + p["length"]] == i[p["item_at"] : p["item_at"] + p["length"]] for p in places[k]))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(hit)) for c in (batch.column(0), batch.column(2))], names=["doc_id", "item_id"])


def leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, most_shipped: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id): documents(doc_id, text) that hold window consecutive words of items(item_id, text), or
    all words of a shorter one."""
    docs = documents.select(F.col("doc_id").cast("long").alias("id"), "text").where("text is not null and id is not null")
    evals = items.select(F.col("item_id").cast("long").alias("id"), "text").where("text is not null and id is not null").distinct()
    widths = tuple(range(1, shingle + 1))
    cut = written(evals.mapInArrow(_placed(widths, None, True), _PLACED), "p7-items")
    wanted = cut.select("shingle", "width").distinct()
    n_wanted = wanted.count()
    if n_wanted <= most_shipped:
        at = np.sort(np.array([r[0] for r in wanted.select("shingle").collect()], np.int64))
        used = tuple(sorted(r[0] for r in wanted.select("width").distinct().collect()))
        held = docs.mapInArrow(_placed(used, at, False), _PLACED)
    else:
        held = docs.mapInArrow(_placed(widths, None, False), _PLACED)
    held = written(held.join(wanted, ["shingle", "width"], "left_semi"), "p7-held")
    df = held.groupBy("shingle", "width").agg(F.count_distinct("id").alias("df"))
    # each window of an item and its rarest shingle; a window with one that no document has is nowhere
    length = F.least(F.lit(window), F.col("n_words"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("at") - length + F.col("width")), F.least(F.col("at"), F.col("n_words") - length))
    ranked = cut.join(df, ["shingle", "width"], "left").select("id", "n_words", "width", "at", "shingle", F.coalesce("df", F.lit(0)).alias("df"), length.alias("length"), F.explode(starts).alias("start"))
    prefix = ranked.groupBy("id", "start", "length").agg(F.min_by(F.struct("shingle", "width", "at", "df"), F.struct("df", "at")).alias("p"))
    prefix = prefix.where("p.df > 0").select(F.col("id").alias("item_id"), "start", "length", "p.shingle", "p.width", (F.col("p.at") - F.col("start")).alias("offset"))
    place = F.col("at") - F.col("offset")
    near = held.join(prefix, ["shingle", "width"]).where((place >= 0) & (place + F.col("length") <= F.col("n_words")))
    near = near.groupBy(F.col("id").alias("doc_id"), "item_id").agg(F.collect_set(F.struct(place.alias("doc_at"), F.col("start").alias("item_at"), "length")).alias("places"))
    full = near.join(docs.withColumnRenamed("id", "doc_id"), "doc_id").join(evals.select(F.col("id").alias("item_id"), F.col("text").alias("item_text")), "item_id")
    return full.select("doc_id", "text", "item_id", "item_text", "places").mapInArrow(_verify, "doc_id long, item_id long").distinct()


def affected(documents: DataFrame, items: DataFrame, **how) -> DataFrame:
    """(doc_id, n_items, item_ids): each document with the items found in it."""
    return leaks(documents, items, **how).groupBy("doc_id").agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list("item_id")).alias("item_ids"))
