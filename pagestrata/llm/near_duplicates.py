"""Problem 1: records that say almost the same, found by vantage-point trees over Hamming fingerprints.

A record's words, each occurrence an element of its own, are hashed to a 192-bit parity fingerprint: one
differing element flips one bit, so the Hamming distance of two fingerprints is never more than the number of
elements in which the multisets differ. For a similarity of t that number is at most (1 - t) / (1 + t) of all
words of both, which gives every pair a search radius that loses nothing.

Over texts that share most of their function words, distances from any vantage point crowd within less than one
radius, so a tree over the whole collection could not prune (README, problem 1). The collection is therefore
first cut into shards by rare elements: in one fixed order from rare to common, the rarest element that a record shares
with any partner is among its first (1 - t) n + 1, so that each pair has a shard in common and nothing is lost. How
common elements are is told from a sample; it bears on the shards' sizes only. Within a shard, cut by size,
a vantage-point tree splits the fingerprints by Hamming distance, prunes branches by
the triangle inequality and queries both sides where a ball crosses the boundary. A shard of more than
``DEEP`` times ``shard_rows`` records is parted by its records' second rarest common elements, in the same way; one that is
still larger than ``shard_rows`` is split by distance rings about a vantage point (a record searches its own ring
and the next), and rings that are still larger in blocks against blocks, so no group is ever collected whole.
What remains is compared exactly, on the words themselves.

Defined cases: null and empty texts and records under ``min_words`` words take no part; repeated rows (same id)
count once; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagestrata.llm.words import Coder, mix, words
from pagestrata.session import written

LEAF = 48
#: Records looked at and elements kept to tell which elements are common.
SAMPLE, COMMON = 50_000, 200_000
#: From how many times the largest cell on a shard is parted by a second element instead of by distance.
DEEP = 5
#: What part of the records is looked at to see which shards are too large for one task; it decides only how they are cut.
HOT_PART = 16
_SIGNED = T.StructType([T.StructField(n, T.LongType()) for n in ("doc", "n", "f0", "f1", "f2")] + [T.StructField("shards", T.ArrayType(T.LongType()))])
_PAIR = T.StructType([T.StructField(n, T.LongType()) for n in ("a", "b")])


def radius(n_a: np.ndarray, n_b: np.ndarray, similarity: float) -> np.ndarray:
    """The most elements in which two multisets of these sizes can differ at this similarity."""
    return np.floor((1 - similarity) / (1 + similarity) * (n_a + n_b) + 1e-9)


def _elements(h: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of word and occurrence number, document) sorted by document."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.arange(len(h))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    return mix(h + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1), doc


def _parity(e: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Three 64-bit words of parity per document."""
    bit = (e >> np.uint64(32)) % np.uint64(192)
    one, word = np.uint64(1) << (bit & np.uint64(63)), bit >> np.uint64(6)
    return np.stack([np.bitwise_xor.reduceat(np.where(word == k, one, np.uint64(0)), starts) for k in range(3)], 1)


def _shards(e: np.ndarray, n: np.ndarray, known: np.ndarray, share: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, element, whether only to be queried) sorted by document: the rarest elements of each document. Two documents have at
    least similarity / (1 + similarity) of all words of both in common, so that the rarest common element is among the first
    n - similarity * n + 1 of each, and of the shorter one among the fewer that a partner of its own size allows; the last element
    is not for shards of their own."""
    at = np.minimum(np.searchsorted(known, e), max(len(known) - 1, 0))
    f = np.where(known[at] == e, share[at], 0) if len(known) else np.zeros(len(e), np.int64)
    e = e[np.lexsort((e, f, np.repeat(np.arange(len(n)), n)))]
    # one element more than names shards: of any two common elements the second is among these
    rows = np.minimum(n, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 2)
    data = n - np.ceil(2 * similarity / (1 + similarity) * n - 1e-9).astype(np.int64) + 1
    doc = np.repeat(np.arange(len(n)), rows)
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(rows) - rows, rows)
    return doc, e[(np.cumsum(n) - n)[doc] + pos], pos >= data[doc]


def _signed(min_words: int, *how):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                docs = [words(t) for t in part.column(1).to_pylist()]
                keep = np.array([len(d) >= min_words for d in docs], bool)
                if not keep.any():
                    continue
                doc = part.column(0).to_numpy(zero_copy_only=False)[keep]
                h, n = coder([d for d in docs if len(d) >= min_words])
                e, at = _elements(h, n)
                f = _parity(e, np.searchsorted(at, np.arange(len(n))))
                at, keys, only = _shards(e, n, *how)
                keys = keys & ~np.uint64(1) | only  # the last bit of a shard's name tells the role
                at = np.searchsorted(at, np.arange(len(n) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc), pa.array(n), *(pa.array(f[:, k].copy().view(np.int64)) for k in (0, 1, 2)), pa.ListArray.from_arrays(pa.array(at), pa.array(keys.view(np.int64)))],
                    names=_SIGNED.names,
                )

    return run


def _counted(min_words: int):
    """(element, documents) of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder()
        for batch in batches:
            e, count = np.unique(_elements(*coder([d for d in map(words, batch.column(0).to_pylist()) if len(d) >= min_words]))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(e.view(np.int64)), pa.array(count)], names=["e", "n"])

    return run


def _common(src: DataFrame, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent elements, sorted, and how many records of a sample have each. It only decides the order of the
    elements, any of which loses nothing: a poorer one makes larger shards."""
    total = src.count()
    sample = src.where(F.pmod(F.xxhash64("doc", F.lit(3)), F.lit(1_000_000)) < F.lit(max(1, SAMPLE * 1_000_000 // max(total, 1))))
    seen = sample.select("text").mapInArrow(_counted(min_words), "e long, n long").groupBy("e").agg(F.sum("n").alias("n")).where("n > 1")
    top = seen.orderBy(F.desc("n"), "e").limit(COMMON).toArrow()
    e, n = top["e"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(e)
    return e[order], n[order]


def _distance(f: np.ndarray, i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
    return sum(np.bitwise_count(f[i, k] ^ f[j, k]).astype(np.int64) for k in range(3))


def vp_pairs(f: np.ndarray, n: np.ndarray, similarity: float, data: np.ndarray, query: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs (data, query) within their radius, by a vantage-point tree over data; query rows go down every
    branch that their ball touches."""
    out, todo = [], [(data, query)]
    reach = (1 - similarity) / (1 + similarity)
    while todo:
        d, q = todo.pop()
        if not len(d) or not len(q):
            continue
        if len(d) <= LEAF:
            apart = sum(np.bitwise_count(f[d, k][:, None] ^ f[q, k]) for k in range(3))
            i, j = np.nonzero(apart <= np.minimum(np.floor(reach * (n[q] + n[d].max()) + 1e-9), 192).astype(np.uint8))
            hit = apart[i, j] <= np.floor(reach * (n[d[i]] + n[q[j]]) + 1e-9)
            out.append((d[i[hit]], q[j[hit]]))
            continue
        v = d[len(d) // 2]
        dd, dq = _distance(f, v, d), _distance(f, v, q)
        mu = int(np.median(dd))
        near = dd <= mu
        if near.all():
            mu -= 1
            near = dd <= mu
        if not near.any():  # all at one distance: no ball can part them
            for lo in range(0, len(d), LEAF):
                todo.append((d[lo : lo + LEAF], q))
            continue
        most_near, most_far = n[d[near]].max(), n[d[~near]].max()
        todo.append((d[near], q[dq <= mu + np.floor(reach * (n[q] + most_near) + 1e-9)]))
        todo.append((d[~near], q[dq > mu - np.floor(reach * (n[q] + most_far) + 1e-9)]))
    return out


def _search(similarity: float):
    """Pairs within each shard of rows sorted by shard. The size of a record is held with its roles in rn: whether it is
    only to be queried, as the longer of two; and 0 for all pairs of a cell, 1 and 2 for its two sides."""

    def whole(key, doc, rn, f):
        role, only, n = rn & 3, rn >> 2 & 1, rn >> 3
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(new, len(key)))
        big = size > LEAF
        i = np.flatnonzero(np.repeat(~big, size))
        left, right = [], []
        for k in range(1, int(size[~big].max(initial=1))):
            i = i[i + k < len(key)]
            i = i[key[i] == key[i + k]]
            if not len(i):
                break
            j = i + k
            near = (role[i] == 0) & (role[j] == 0) | (role[i] + role[j] == 3)
            near &= np.where(n[i] <= n[j], only[i], only[j]) == 0
            near &= _distance(f, i, j) <= radius(n[i], n[j], similarity)
            left.append(i[near])
            right.append(j[near])
        for at, rows in zip(new[big], size[big], strict=True):
            own = at + np.argsort(n[at : at + rows], kind="stable")
            for one, two in ((2, 1), (1, 2)) if role[own].any() else ((2, 1),):
                data, query = own[(role[own] != one) & (only[own] == 0)], own[role[own] != two]
                while len(data):  # a tree for every tenth of size, queried by what is longer, up to the similarity
                    cut = np.searchsorted(n[data], n[data[0]] * 1.1, "right")
                    lo, hi = np.searchsorted(n[query], n[data[0]]), np.searchsorted(n[query], n[data[cut - 1]] / similarity + 1e-6, "right")
                    for a, b in vp_pairs(f, n, similarity, data[:cut], query[lo:hi]):
                        left.append(a)
                        right.append(b)
                    data = data[cut:]
        a, b = (doc[np.concatenate(x or [np.zeros(0, np.int64)])] for x in (left, right))
        pairs = np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b]
        pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=_PAIR.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            key = held[0]
            other = np.flatnonzero(key != key[-1]) if len(key) else key
            if len(other):  # all but the last shard are complete
                cut = int(other[-1]) + 1
                done, held = [c[:cut] for c in held], [c[cut:] for c in held]
                yield whole(*done[:3], np.stack(done[3:], 1).view(np.uint64))
        if held is not None and len(held[0]):
            yield whole(*held[:3], np.stack(held[3:], 1).view(np.uint64))

    return run


def _cut(rows: DataFrame, similarity: float, shard_rows: int) -> DataFrame:
    """Rows of oversize shards as rows of cells of at most about twice shard_rows: distance rings about a
    vantage point, as wide as the largest search radius, so that partners lie in one ring or in neighbours; a
    ring's blocks meet each other and those of the next ring."""
    reach = 2 * (1 - similarity) / (1 + similarity)
    about = rows.groupBy("shard").agg(F.min_by(F.struct("f0", "f1", "f2"), "doc").alias("v"), F.greatest(F.lit(1), F.floor(F.max(F.shiftright("rn", 3)) * reach)).alias("width"))
    dist = sum(F.bit_count(F.col(c).bitwiseXOR(F.col(f"v.{c}"))) for c in ("f0", "f1", "f2"))
    ringed = rows.join(about, "shard").withColumn("ring", F.floor(dist / F.col("width"))).drop("v", "width")
    sizes = ringed.groupBy("shard", "ring").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("blocks"))
    up = sizes.select("shard", (F.col("ring") - 1).alias("ring"), F.col("blocks").alias("above"))
    down = sizes.select("shard", (F.col("ring") + 1).alias("ring"), F.col("blocks").alias("below"))
    own = ringed.join(sizes, ["shard", "ring"]).join(up, ["shard", "ring"], "left").join(down, ["shard", "ring"], "left")
    own = own.withColumn("block", F.pmod(F.xxhash64("doc", F.lit(1)), F.col("blocks")).cast("int"))

    def cells(role: int, lo, hi, ring, data_first: bool):
        at = F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
        mine, other = (F.col("ring"), F.col("block")), (lambda j: (ring, j))
        name = lambda j: F.xxhash64("shard", *(mine + other(j) if data_first else other(j) + mine))
        return F.transform(at, lambda j: F.struct(name(j).alias("cell"), F.lit(role).cast("long").alias("role")))

    one = F.lit(1)
    spread = F.concat(
        cells(0, F.col("block"), F.col("block"), F.col("ring"), True),
        cells(1, F.col("block") + 1, F.col("blocks") - 1, F.col("ring"), True),
        cells(2, F.lit(0), F.col("block") - 1, F.col("ring"), False),
        cells(1, F.lit(0), F.coalesce("above", F.lit(0)) - one, F.col("ring") + 1, True),
        cells(2, F.lit(0), F.coalesce("below", F.lit(0)) - one, F.col("ring") - 1, False),
    )
    each = own.select(F.explode(spread).alias("c"), "doc", "rn", "f0", "f1", "f2")
    return each.select(F.col("c.cell").alias("shard"), "doc", (F.col("rn") + F.col("c.role")).alias("rn"), "f0", "f1", "f2")


def _name(shard: str) -> Column:
    """A shard's name without the bit that tells the role."""
    return F.shiftrightunsigned(shard, 1)


def _oversize(entries: DataFrame, shard_rows: int) -> DataFrame:
    """(shard, rows) of the shards that are too large for one task, as a part of the records tells."""
    part = entries.where(F.pmod(F.xxhash64("doc", F.lit(2)), F.lit(HOT_PART)) == 0)
    return part.groupBy("shard").agg((F.count("*") * HOT_PART).alias("rows")).where(F.col("rows") > shard_rows)


def _deepened(signed: DataFrame, deep: DataFrame) -> DataFrame:
    """Entries of the shards deep(shard) by a second element: records of a pair whose rarest common element is e1 also share the second
    rarest, which is behind e1 among the elements of each. It loses nothing and makes at most as many copies as a record has
    elements, however large the shard."""
    at = signed.select("doc", "n", "f0", "f1", "f2", "shards", F.posexplode(F.slice("shards", F.lit(1), F.size("shards") - 1)).alias("i", "s")).withColumn("shard", _name("s"))
    at = at.join(deep, "shard").select("*", F.explode(F.sequence(F.col("i") + 1, F.size("shards") - 1)).alias("j"))
    second, only = F.expr("shiftrightunsigned(shards[j], 1)"), F.expr("shards[j - 1] & 1")
    return at.select(F.xxhash64("shard", second).alias("shard"), "doc", (F.shiftleft("n", 3) + only * 4).alias("rn"), "f0", "f1", "f2")


def candidate_pairs(records: DataFrame, id_col: str, text_col: str, similarity: float = 0.7, min_words: int = 25, shard_rows: int = 20_000) -> DataFrame:
    """(a, b) LONG, a < b: hashed ids of records whose fingerprints lie within their radius in a common shard."""
    src = records.select(F.xxhash64(F.col(id_col)).alias("doc"), F.col(text_col).alias("text")).where("doc is not null and text is not null")
    signed = written(src.mapInArrow(_signed(min_words, *_common(src, min_words), similarity), _SIGNED).dropDuplicates(["doc"]), "p1-signed")
    each = signed.select(F.posexplode(F.slice("shards", F.lit(1), F.size("shards") - 1)).alias("i", "s"), "doc", "n", "f0", "f1", "f2")
    entry = ["doc", (F.shiftleft("n", 3) + F.col("s").bitwiseAND(F.lit(1)) * 4).alias("rn"), "f0", "f1", "f2"]
    entries = each.select(_name("s").alias("shard"), *entry)
    hot = written(_oversize(entries, shard_rows), "p1-hot")
    if hot.isEmpty():
        rest = []
    else:
        deep, cut = hot.where(F.col("rows") > DEEP * shard_rows).select("shard"), hot.where(F.col("rows") <= DEEP * shard_rows).select("shard")
        rest = [_cut(entries.join(cut, "shard"), similarity, shard_rows)]
        entries = entries.join(hot.select("shard"), "shard", "left_anti")
        if not deep.isEmpty():
            finer = written(_deepened(signed, deep), "p1-deep")
            hot = written(_oversize(finer, shard_rows).select("shard"), "p1-hot")
            rest += [finer.join(hot, "shard", "left_anti"), _cut(finer.join(hot, "shard"), similarity, shard_rows)]
    entries = reduce(DataFrame.unionByName, rest, entries)
    found = entries.repartition("shard").sortWithinPartitions("shard").mapInArrow(_search(similarity), _PAIR)
    return found.distinct()


_ELEMENTS = T.StructType([T.StructField("doc", T.LongType()), T.StructField("id", T.StringType()), T.StructField("n", T.LongType()), T.StructField("elements", T.ArrayType(T.LongType()))])


def _element_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder = Coder()
    for batch in batches:
        h, n = coder([words(t) for t in batch.column(2).to_pylist()])
        e, _ = _elements(h, n)
        at = np.append(0, np.cumsum(n)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.ListArray.from_arrays(pa.array(at), pa.array(e.view(np.int64)))], names=_ELEMENTS.names)


def similar_pairs(records: DataFrame, id_col: str, text_col: str, similarity: float = 0.7, min_words: int = 25, **how) -> DataFrame:
    """(id_a, id_b, common, n_a, n_b): each pair of different records of at least min_words words whose common
    words, counted as often as both have them, are at least similarity of all words of both; id_a < id_b."""
    pairs = written(candidate_pairs(records, id_col, text_col, similarity, min_words, **how), "p1-pairs")
    named = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    text = records.select(F.xxhash64(F.col(id_col)).alias("doc"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    full = text.join(named, "doc", "left_semi").dropDuplicates(["doc", "id"]).mapInArrow(_element_rows, _ELEMENTS)
    full = written(full, "p1-elements")
    side = lambda k: full.select(*(F.col(c).alias(f"{c}_{k}") for c in full.columns))
    both = pairs.join(side("a"), F.col("a") == F.col("doc_a")).join(side("b"), F.col("b") == F.col("doc_b"))
    both = both.withColumn("common", F.size(F.array_intersect("elements_a", "elements_b"))).where("common >= %r * (n_a + n_b - common) - 1e-9 and id_a != id_b" % similarity)
    flip = F.col("id_a") > F.col("id_b")
    pick = lambda x, y: F.when(flip, F.col(x)).otherwise(F.col(y))
    return both.select(pick("id_b", "id_a").alias("id_a"), pick("id_a", "id_b").alias("id_b"), "common", pick("n_b", "n_a").alias("n_a"), pick("n_a", "n_b").alias("n_b")).distinct()


def groups(pairs: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """(id, class_id, links): connected classes of pairs, each named by its least member. Every round a record takes the
    least name among its own and its neighbours' names, and then the name that its name has, so chains halve; it ends when a
    round changes nothing."""
    links = written(pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(pairs.select(F.col(b).alias("x"), F.col(a).alias("y"))), "p1-links")
    state = written(links.groupBy(F.col("x").alias("id")).agg(F.least(F.col("x"), F.min("y")).alias("class_id"), F.count("*").alias("links")), "p1-class")
    while True:
        seen = links.join(state.select(F.col("id").alias("y"), F.col("class_id").alias("c")), "y").groupBy(F.col("x").alias("id")).agg(F.min("c").alias("c"))
        step = state.join(seen, "id").select("id", F.least("class_id", "c").alias("new"), "class_id", "links")
        jump = step.select(F.col("id").alias("new"), F.col("new").alias("far"))
        step = written(step.join(jump, "new").select("id", F.least("new", "far").alias("class_id"), F.col("class_id").alias("old"), "links"), "p1-class")
        state = step.drop("old")
        if step.where("class_id != old").isEmpty():
            return state


_COPY = "id string, copy long, n int"


def _copies(min_words: int):
    """A record's words in no order, hashed; records under min_words words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, xxhash.xxh64_intdigest(" ".join(sorted(w)).encode("utf-8", "surrogatepass")) - 2**63, len(w)) for i, w in zip(batch.column(0).to_pylist(), map(words, batch.column(1).to_pylist()), strict=True) if len(w) >= min_words]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in ((0, pa.string()), (1, pa.int64()), (2, pa.int32()))], names=["id", "copy", "n"])

    return run


def near_groups(records: DataFrame, id_col: str, text_col: str, similarity: float = 0.7, min_words: int = 25, **how) -> DataFrame:
    """(id, class_id, links) of each record that has a near copy: its class, named by its least member, and with how many other
    records it agrees. Records of the same words are one for the search, so that a text of a third of all rows costs a row
    for each copy and no pairs among them."""
    own = records.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    each = written(own.mapInArrow(_copies(min_words), _COPY).dropDuplicates(["id"]), "p1-copies")
    heads = written(each.groupBy("copy", "n").agg(F.min("id").alias("head"), F.count("*").alias("size")), "p1-heads")
    pairs = written(similar_pairs(own.join(heads.select(F.col("head").alias("id")), "id", "left_semi"), "id", "text", similarity, min_words, **how).select("id_a", "id_b"), "p1-head-pairs")
    of = groups(pairs).select(F.col("id").alias("head"), "class_id")
    both = pairs.unionByName(pairs.select(F.col("id_a").alias("id_b"), F.col("id_b").alias("id_a")))
    near = both.join(heads.select(F.col("head").alias("id_b"), "size"), "id_b").groupBy(F.col("id_a").alias("head")).agg(F.sum("size").alias("others"))
    known = heads.join(of, "head", "left").join(near, "head", "left").select("copy", "n", F.coalesce("class_id", "head").alias("class_id"), (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    return each.join(known.where("links > 0"), ["copy", "n"]).select("id", "class_id", "links")


def unit_texts(units: DataFrame, blobs: DataFrame) -> DataFrame:
    """(id, text): the texts of all evidence blocks of each unit observation, in their order."""
    each = units.select("id", F.posexplode("evidence_blocks").alias("pos", "b")).select("id", "pos", "b.ordinal", F.col("b.evidence_blob_id").alias("blob_id"))
    each = each.join(blobs.dropDuplicates(["id"]).select(F.col("id").alias("blob_id"), "text"), "blob_id")
    parts = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "pos", "text"))).alias("p"))
    return parts.select("id", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))


def unit_groups(units: DataFrame, blobs: DataFrame, **how) -> DataFrame:
    """(unit_observation_id, class_id, links): unit observations joined by equal raw or stable fingerprints, or by near copies of the texts of
    all their evidence blocks. Units are linked to what they share, never to each other, so a fingerprint of a third of all units
    costs one link a unit. Units that share nothing are left out."""
    once = units.dropDuplicates(["id"]).where("id is not null")
    hub = lambda kind, c: once.where(F.col(c).isNotNull()).select("id", F.concat(F.lit(kind), c).alias("hub"))
    near = near_groups(unit_texts(once, blobs), "id", "text", **how).select("id", F.concat(F.lit("~c:"), "class_id").alias("hub"))
    links = hub("~s:", "stable_content_fingerprint").unionByName(hub("~r:", "raw_fingerprint")).unionByName(near).distinct()
    shared = links.groupBy("hub").agg(F.count("*").alias("n")).where("n > 1").select("hub")
    out = groups(links.join(shared, "hub", "left_semi").select(F.col("id").alias("id_a"), F.col("hub").alias("id_b")))
    return out.where("id not like '~%'").withColumnRenamed("id", "unit_observation_id")
