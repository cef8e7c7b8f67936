"""Problem 5: the main piece of a page, told from menus, notices, teasers, sidebars and footers by wrappers.

Pages of one host are cut from the same templates. A text token (a sentence with numbers, months and the site's own
name taken out) that recurs on a large share of the host's pages, or of all pages of a language with the site's name
masked, can be matched between pages; every other text is a slot. A page is then a stream of matched tokens, each with
the slots that follow in its box. Wrappers are inferred by union-free expressions: the streams of a host are aligned one
after the other with the wrapper so far (longest common subsequence), and mismatches are resolved:

- a token that the wrapper lacks at its place, or that a page lacks, becomes an *optional* group;
- slots after a token whose number differs from page to page, or is more than one, and most of which open with a link
  over all pages of the host, become a *repeated* group ``token (link slot?)+``;
- all other slots are text slots.

Streams are folded in shards of about ``SHARD`` pages, and the shards' wrappers are aligned with each other in the same way,
``FAN`` at a time, until each host has one; every page takes part. A token keeps at most ``PLACES`` places in a wrapper, beyond which
it counts for the nearest of them, so that a wrapper is bounded by its host's matched tokens.

The wrapper is applied to each page: a box whose first token opens a repeated group is left out with all its units; boxes
off the piece's own line that hold wrapper tokens are optional groups and left out; lists and tables
are groups of one kind, wrapper or slot as a whole. The piece is the box whose slots hold most unlinked
text, with the slots of the boxes around it and of the plain boxes in it. Boxes carry no names in part of the data and
differ from page to page in the rest, so they are told by their texts, not their tags.

Defined cases: rows with null html or id give nothing; a page without wrapper tokens is all piece but for what is
mostly links; repeated rows count once; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagestrata.functions.html import blocks, squeezed
from pagestrata.llm.words import HAN, nfc
from pagestrata.session import written

#: Shares of pages from which a text is template; chance repeats on few pages are allowed for by SPREAD.
LANG_SHARE, HOST_SHARE, LEAST, SPREAD = 0.035, 0.04, 2, 1.5
#: Pages folded into one wrapper in one task, wrappers aligned in one task, and places of a token in a wrapper.
SHARD, FAN, PLACES = 500, 16, 4
#: Keys of sentences without letters, and of sentences that are never template text.
BLANK, OWN = 0, 1
#: Template texts of all languages that are sent to the tasks; beyond it they are joined.
MOST_SHARED = 200_000
STRUCTURES = frozenset("ul ol li dl table tbody thead tfoot tr figure blockquote figcaption pre p h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# fixed values: month names and frequent function words of the languages covered
MONTHS = (
    "january february march april may june july august september october november december "
    "januar februar märz mai juni juli oktober dezember "
    "janvier février mars avril juin juillet août septembre octobre novembre décembre "
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre"
)
FUNCTION_WORDS = {
    "en": "the of and to that which with is",
    "de": "der die das und von den bei bevor",
    "fr": "les des et du une que avant dans",
    "es": "los las el y que unos antes cuando",
}
_MONTH = frozenset(MONTHS.split())
_VOTES = {w: tuple(k for k, v in FUNCTION_WORDS.items() if w in v.split()) for v in FUNCTION_WORDS.values() for w in v.split()}
_GAP, _NUMBER, _LETTER = re.compile(r"[\W_]+"), re.compile(r"\d+"), re.compile(r"[^\W\d_]")
# where sentences and the parts of one-line menus end, in text of single spaces
_ENDS = tuple((f"{c} ", f"{c}\n") for c in ".!?") + tuple((c, f"{c}\n") for c in "。！？") + ((" | ", "\n"), (" · ", "\n"))
_HAN = re.compile(f"[{HAN}]")

_OUTLINE = T.StructType(
    [T.StructField("record_table", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("host", T.StringType()), T.StructField("doc", T.LongType()), T.StructField("lang", T.StringType())]
    + [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("no", "kind", "box", "structure", "link", "at", "size", "parent")]
    + [T.StructField("key", T.ArrayType(T.LongType()))]
)


def masked(sentence: str, site: str) -> str:
    """A text token: in lower case without the site's name; in one with numbers, words only, with numbers and months made
    alike; empty without letters."""
    s = sentence.lower()
    if site:
        s = s.replace(site, " ")
    if _NUMBER.search(s):
        words = ["0" if w in _MONTH else w for w in _NUMBER.sub("0", _GAP.sub(" ", s)).split()]
        return " ".join(words) if any(w != "0" for w in words) else ""
    return s.strip() if _LETTER.search(s) else ""


def sentences(text: str) -> list[str]:
    """The sentences of a line of single spaces."""
    for end, cut in _ENDS:
        text = text.replace(end, cut)
    return text.split("\n")


def hashed(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - 2**63


class Keys:
    """The key of each sentence of a site: a hash of its token, BLANK if it has no letters. Kept within a task."""

    def __init__(self, most: int = 300_000):
        self.most, self.held = most, {}

    def __call__(self, sentence: str, site: str) -> int:
        at = (sentence, site)
        key = self.held.get(at)
        if key is None:
            if len(self.held) >= self.most:
                self.held.clear()
            token = masked(sentence, site)
            key = self.held[at] = hashed(token) if token else BLANK
        return key


def host_and_site(url: str | None) -> tuple[str, str]:
    try:
        host = (urlsplit(url or "").hostname or "").removeprefix("www.")
    except ValueError:
        host = ""
    return host, re.split(r"[.-]", host)[0] if host else ""


def language(texts: list[str]) -> str:
    """The language of most function words; zh where Han characters lead; und if neither is there."""
    joined = " ".join(texts).lower()
    if not joined.isascii() and len(_HAN.findall(joined)) * 4 > len(joined):
        return "zh"
    votes = dict.fromkeys(FUNCTION_WORDS, 0)
    for word in joined.split():
        for k in _VOTES.get(word, ()):
            votes[k] += 1
    best = max(votes, key=votes.get)
    return best if votes[best] else "und"


def outline(source: str, url: str | None, key_of=masked) -> dict | None:
    """A page's blocks with the boxes they lie in and the keys of their sentences."""
    found, boxes = blocks(source)
    if not found:
        return None
    host, site = host_and_site(url)
    no, kind, inside, structure, link, at, size, key, raw = ([] for _ in range(9))
    texts, boxed = [], [b.tag not in STRUCTURES for b in boxes]
    for k, b in enumerate(found):
        text = squeezed(nfc(b.text))
        texts.append(text)
        cell, box, inner = b.tag in ("td", "th"), -1, -1
        for i in reversed(b.path[:-1]):
            if boxed[i] and not (cell and boxes[i].tag in ("td", "th")):
                box = i
                break
            inner = i
        no.append(b.no)
        kind.append(int(b.tag in HEADINGS))
        inside.append(box)
        structure.append(inner if inner >= 0 else (b.path[-1] if cell else -1))
        link.append(2 if b.linked >= 0.9 * max(1, len(text)) else int(b.linked >= 4 and (b.linked >= len(squeezed(b.text.split("\n")[0])) - 2 or text[: b.linked].strip() != "" and b.linked * 12 >= len(text) and b.linked < len(text))))
        for line in b.text.split("\n") if "\n" in b.text else (text,):
            for s in sentences(line if line is text else squeezed(nfc(line))):
                s = s.strip()
                if s:
                    at.append(k)
                    size.append(len(s))
                    raw.append(s)
                    key.append(key_of(s, site))
    out = {"no": no, "kind": kind, "box": inside, "structure": structure, "link": link, "at": at, "size": size, "key": key, "raw": raw}
    return out | {"host": host, "lang": language(texts), "parent": [x.parent for x in boxes]}


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = Keys()
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            rows = []
            for name, rid, url, source in zip(*(c.to_pylist() for c in part.columns), strict=True):
                o = outline(source, url, keys)
                if o:
                    rows.append(o | {"record_table": name, "record_id": rid, "doc": address(o["host"], url or rid)})
            if rows:
                yield batched(rows, _ARROW)


def address(host: str, url: str) -> int:
    """A page's address without query and fragment, hashed."""
    return hashed(host + url.split("?")[0].split("#")[0])


def batched(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """A batch of rows, its lists laid end to end."""
    out = []
    for f in schema:
        if pa.types.is_list(f.type):
            lists = [r[f.name] for r in rows]
            ends = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=ends[1:])
            out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array([v for x in lists for v in x], f.type.value_type)))
        else:
            out.append(pa.array([r[f.name] for r in rows], f.type))
    return pa.RecordBatch.from_arrays(out, schema=schema)


class Known:
    """What a task knows of each host, put together once a host: its template texts, or the kinds of its wrapper's tokens."""

    def __init__(self, build, most: int = 2000):
        self.build, self.most, self.held = build, most, {}

    def __call__(self, host: str | None, k: int):
        if host not in self.held:
            if len(self.held) >= self.most:
                self.held.clear()
            self.held[host] = self.build(k)
        return self.held[host]


def unbatched(cols: dict, names: tuple[str, ...]) -> list[dict]:
    """The rows of list columns."""
    lists = []
    for n in names:
        ends, values = cols[n].offsets.to_numpy().tolist(), cols[n].values.to_numpy(zero_copy_only=False).tolist()
        lists.append([values[lo:hi] for lo, hi in zip(ends, ends[1:], strict=False)])
    return [dict(zip(names, row, strict=True)) for row in zip(*lists, strict=True)]


_ARROW = pa.schema([pa.field(n, pa.string()) for n in ("record_table", "record_id", "host")] + [pa.field("doc", pa.int64()), pa.field("lang", pa.string())] + [pa.field(n, pa.list_(pa.int32())) for n in ("no", "kind", "box", "structure", "link", "at", "size", "parent")] + [pa.field("key", pa.list_(pa.int64()))])


#: Kinds of a wrapper's tokens: on every page, on some, and the opener of a repeated group.
FIXED, OPTIONAL, REPEATED = 0, 1, 2


def matched(o: dict, template) -> tuple[list[int], list[int], list[bool], list[int]]:
    """Of each block of an outline: letters, letters in template texts, whether it is template text, and its first template text."""
    n = len(o["no"])
    size, fixed, first, opener = [0] * n, [0] * n, [None] * n, [BLANK] * n
    for at, length, key in zip(o["at"], o["size"], o["key"], strict=True):
        is_fixed = key in template
        size[at] += length if key else 0
        if is_fixed:
            fixed[at] += length
            opener[at] = opener[at] or key
        if first[at] is None and key:
            first[at] = is_fixed
    whole = [f > 0 and (f >= 0.5 * s or bool(a) and f >= 0.25 * s) for f, s, a in zip(fixed, size, first, strict=True)]
    return size, fixed, whole, opener


def main_blocks(o: dict, wrapper: dict[int, int]) -> list[int]:
    """Numbers of the blocks of the piece, given an outline and the kinds of the wrapper's tokens."""
    n = len(o["no"])
    size, fixed, whole, opener = matched(o, wrapper)
    some = [f > 0 for f in fixed]
    parent, box, link = o["parent"], o["box"], o["link"]

    lines: dict[int, list[int]] = {}
    for b in set(box):
        up, lines[b] = b, []
        while up >= 0:
            lines[b].append(up)
            up = parent[up]
    # repeated groups: their opener, then units
    members: dict[int, list[int]] = {}
    for k in range(n):
        members.setdefault(box[k], []).append(k)
    teaser = {b for b, ks in members.items() if b >= 0 and len(ks) > 1 and whole[ks[0]] and wrapper[opener[ks[0]]] == REPEATED and not all(whole[k] for k in ks)}
    out_of = {b: not teaser.isdisjoint(line) for b, line in lines.items()}
    gone = [out_of[b] for b in box]
    score: dict[int, float] = {}
    for k in range(n):
        if not gone[k] and not whole[k] and link[k] < 2:
            score[box[k]] = score.get(box[k], 0) + size[k] - fixed[k]
    if not score:
        score = {box[k]: 1.0 for k in range(n) if not gone[k] and not whole[k]}
        if not score:
            return []
    top = max(score, key=lambda b: (score[b], -b))
    around = {*lines[top], -1, top}
    # optional groups: boxes off the piece's own line that hold template text
    optional = {b for k in range(n) if some[k] for b in lines[box[k]]} - around
    left = {b: out_of[b] or not optional.isdisjoint(line) for b, line in lines.items()}
    apart = {b: b not in around and top not in line for b, line in lines.items()}
    kinds: dict[int, list[int]] = {}
    for k in range(n):
        if o["structure"][k] >= 0:
            kinds.setdefault(o["structure"][k], []).append(k)
    keep = []
    for k in range(n):
        if left[box[k]]:
            continue
        s = o["structure"][k]
        if s >= 0 and len(kinds[s]) > 1:
            if 2 * sum(whole[i] for i in kinds[s]) >= len(kinds[s]):
                continue
        elif whole[k]:
            continue
        if apart[box[k]] and link[k] == 2 and not o["kind"][k]:
            continue
        keep.append(o["no"][k])
    return keep


def stream(o: dict, template) -> tuple[list[int], list[int], list[int]]:
    """A page as its matched tokens in order, each with the slots that follow it in its box before the next template text,
    and how many of these open with a link."""
    _, _, whole, opener = matched(o, template)
    tokens, seen = [], set()
    units, linked, last = {}, {}, {}
    for k, b in enumerate(o["box"]):
        if whole[k]:
            last[b] = opener[k]
        elif b in last:
            units[last[b]] = units.get(last[b], 0) + 1
            linked[last[b]] = linked.get(last[b], 0) + (o["link"][k] > 0)
    for key in o["key"]:
        if key in template and key not in seen:
            seen.add(key)
            tokens.append(key)
    return tokens, [units.get(t, 0) for t in tokens], [linked.get(t, 0) for t in tokens]


class Wrapper:
    """A union-free expression: tokens in order, on how many pages each was met, and the slots after it."""

    def __init__(self):
        self.pages, self.nodes, self.places = 0, [], {}

    def align(self, keys: list[int]) -> list[int]:
        """The place of each key in a longest common subsequence with the wrapper, or -1."""
        tails, ends = [], []
        for i, key in enumerate(keys):
            for p in reversed(self.places.get(key, ())):
                j = bisect_left(tails, p)
                entry = (i, p, ends[j - 1] if j else None)
                if j == len(tails):
                    tails.append(p)
                    ends.append(entry)
                elif p < tails[j]:
                    tails[j], ends[j] = p, entry
        at, entry = [-1] * len(keys), ends[-1] if ends else None
        while entry:
            at[entry[0]], entry = entry[1], entry[2]
        return at

    def fold(self, pages: int, nodes: list[tuple[int, int, int, int, int, int]]) -> None:
        """Take in nodes (key, support, fewest units, most units, units, linked) of another expression over so many pages."""
        self.pages += pages
        at, anchor, new = self.align([n[0] for n in nodes]), -1, {}
        for p, n in zip(at, nodes, strict=True):
            if p < 0 and len(own := self.places.get(n[0], ())) >= PLACES:
                p = min(own, key=lambda q: abs(q - anchor))  # a token that has moved once more
                own = self.nodes[p]
                self.nodes[p] = (own[0], own[1] + n[1], min(own[2], n[2]), max(own[3], n[3]), own[4] + n[4], own[5] + n[5])
            elif p < 0:
                new.setdefault(anchor, []).append(n)
            else:
                own = self.nodes[p]
                self.nodes[p] = (own[0], own[1] + n[1], min(own[2], n[2]), max(own[3], n[3]), own[4] + n[4], own[5] + n[5])
                anchor = p
        if new:
            out = list(new.get(-1, ()))
            for p, n in enumerate(self.nodes):
                out.append(n)
                out += new.get(p, ())
            self.nodes, self.places = out, {}
            for p, n in enumerate(out):
                self.places.setdefault(n[0], []).append(p)


def kind_of(pages: int, support: int, fewest: int, most: int, units: int, linked: int) -> int:
    """What a token is in its wrapper, from all its places."""
    if units and (most > 1 or fewest != most) and linked >= 0.45 * units:
        return REPEATED
    return OPTIONAL if support < pages else FIXED


_NODE = ("key", "support", "fewest", "most", "units", "linked")
_WRAPPER = T.StructType([T.StructField("host", T.StringType()), T.StructField("shard", T.LongType()), T.StructField("pages", T.LongType())] + [T.StructField(n, T.ArrayType(T.LongType())) for n in _NODE])


def _folded(part: pd.DataFrame) -> pd.DataFrame:
    """One wrapper of the expressions of a shard, in a fixed order."""
    w = Wrapper()
    part = part.sort_values("at", kind="stable")
    for pages, *lists in zip(part["pages"], *(part[n] for n in _NODE), strict=True):
        w.fold(int(pages), list(zip(*(x.tolist() for x in lists), strict=True)))
    cols = [list(x) for x in zip(*w.nodes, strict=True)] if w.nodes else [[] for _ in _NODE]
    return pd.DataFrame({"host": [part["host"].iloc[0]], "shard": [int(part["shard"].iloc[0])], "pages": [w.pages]} | {n: [c] for n, c in zip(_NODE, cols, strict=True)})


def _streams(shared: frozenset[int]):
    names = ("no", "box", "link", "at", "size", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Known(None)
        for batch in batches:
            cols = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
            held.build = lambda k, cols=cols: frozenset(cols["of_host"][k].as_py() or ()) | shared
            hosts, own, rows = cols["host"].to_pylist(), cols["of_shared"].to_pylist(), []
            for k, o in enumerate(unbatched(cols, names)):
                of_host = held(hosts[k], k)
                tokens, units, linked = stream(o, of_host.union(own[k]) if own[k] else of_host)
                rows.append({"host": hosts[k], "key": tokens, "support": [1] * len(tokens), "fewest": units, "most": units, "units": units, "linked": linked})
            doc = cols["doc"]
            out = batched(rows, _STREAM)
            yield pa.RecordBatch.from_arrays([*out.columns, doc], names=[*_STREAM.names, "at"])

    return run


_STREAM = pa.schema([pa.field("host", pa.string())] + [pa.field(n, pa.list_(pa.int64())) for n in _NODE])


def wrappers(outlines: DataFrame, of_host: DataFrame, of_lang: DataFrame, most: int = MOST_SHARED) -> DataFrame:
    """(host, pages, key, support, fewest, most, units, linked): the wrapper of each host, as lists of its nodes in order."""
    # recaptures of one address that show the same tokens count once
    marked, shared = with_shared(outlines.select("record_table", "record_id", "host", "doc", "no", "box", "link", "at", "size", "key"), of_lang, most)
    schema = ", ".join(["host string", *(f"{n} array<long>" for n in _NODE), "at long"])
    streams = marked.join(of_host, "host", "left").mapInArrow(_streams(shared), schema)
    streams = streams.dropDuplicates(["host", "at", "key"]).withColumn("pages", F.lit(1).cast("long"))
    n = F.greatest(F.lit(1), F.ceil(F.col("docs") / SHARD))
    hosts = outlines.groupBy("host").agg(F.approx_count_distinct("doc").alias("docs")).withColumn("n", n)
    shards = hosts.agg(F.max("n")).first()[0] or 1
    out = streams.join(hosts.select("host", "n"), "host").withColumn("shard", F.pmod(F.xxhash64("at"), F.col("n")))
    out = out.groupBy("host", "shard").applyInPandas(_folded, _WRAPPER)
    while shards > 1:  # each round FAN wrappers of a host become one
        shards = -(-shards // FAN)
        out = out.withColumn("at", F.col("shard")).withColumn("shard", F.floor(F.col("shard") / FAN)).groupBy("host", "shard").applyInPandas(_folded, _WRAPPER)
    return written(out.drop("shard"), "p5-wrappers")


def kinds(wrapped: DataFrame) -> DataFrame:
    """(host, w_key, w_kind): the kinds of each wrapper's tokens, those of one token at several places taken together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            for r in batch.to_pylist():
                got: dict[int, list[int]] = {}
                for key, *x in zip(*(r[n] for n in _NODE), strict=True):
                    own = got.get(key)
                    got[key] = x if own is None else [own[0] + x[0], min(own[1], x[1]), max(own[2], x[2]), own[3] + x[3], own[4] + x[4]]
                keys.append(list(got))
                out.append([kind_of(r["pages"], *x) for x in got.values()])
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("host")), pa.array(keys, pa.list_(pa.int64())), pa.array(out, pa.list_(pa.int32()))], names=["host", "w_key", "w_kind"])

    return wrapped.mapInArrow(run, "host string, w_key array<long>, w_kind array<int>")


def expressions(wrapped: DataFrame) -> DataFrame:
    """(host, n_pages, n_fixed, n_optional, n_repeated, expression): wrappers to look at; t stands for a token, s for slots."""
    node = F.arrays_zip("support", "fewest", "most", "units", "linked")
    repeated = lambda x: (x["units"] > 0) & ((x["most"] > 1) | (x["fewest"] != x["most"])) & (x["linked"] >= 0.45 * x["units"])
    shape = lambda x: F.when(repeated(x), "(t (link s?)+)?").when(x["support"] < F.col("pages"), F.when(x["units"] > 0, "(t s*)?").otherwise("t?")).when(x["units"] > 0, "t s*").otherwise("t")
    out = wrapped.withColumn("shape", F.transform(node, shape))
    count = lambda test: F.size(F.filter("shape", test)).cast("long")
    return out.select(
        "host", F.col("pages").alias("n_pages"), count(lambda x: ~x.endswith("?")).alias("n_fixed"), count(lambda x: x.endswith("?") & ~x.contains("+")).alias("n_optional"), count(lambda x: x.contains("+")).alias("n_repeated"), F.array_join("shape", " ").alias("expression")
    )


def _classified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("no", "kind", "box", "structure", "link", "at", "size", "parent", "key")
    held = Known(None)
    for batch in batches:
        cols = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
        held.build = lambda k, cols=cols: wrapper_of(cols, k)
        table, rid, no = [], [], []
        tables, ids, hosts = cols["record_table"].to_pylist(), cols["record_id"].to_pylist(), cols["host"].to_pylist()
        for k, o in enumerate(unbatched(cols, names)):
            got = main_blocks(o, held(hosts[k], k))
            table += [tables[k]] * len(got)
            rid += [ids[k]] * len(got)
            no += got
        yield pa.RecordBatch.from_arrays([pa.array(table, pa.string()), pa.array(rid, pa.string()), pa.array(no, pa.int32())], names=["record_table", "record_id", "block_no"])


def wrapper_of(cols: dict, k: int) -> dict[int, int]:
    return dict(zip(cols["w_key"][k].as_py() or (), cols["w_kind"][k].as_py() or (), strict=True))


def templates(outlines: DataFrame, lang_share: float = LANG_SHARE, host_share: float = HOST_SHARE, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(host, of_host), with a host's keys of template texts as an array, and (key) of those of any language. Recaptures
    of one address count once."""
    each = outlines.select("host", "lang", "doc", F.explode(F.array_distinct("key")).alias("key")).where("key not in (0, 1)").distinct()
    count = written(each.groupBy("key", "lang", "host").agg(F.count("*").alias("n")), "p5-counts")
    docs = written(outlines.select("host", "lang", "doc").distinct().groupBy("host", "lang").agg(F.count("*").alias("docs")), "p5-docs")
    # a line for each language: bounded, whatever the input
    langs = F.broadcast(docs.groupBy("lang").agg(F.sum("docs").alias("docs")))
    by_lang = count.groupBy("key", "lang").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    of_lang = by_lang.join(langs, "lang").where(F.col("n") >= F.greatest(F.lit(least), F.col("docs") * lang_share + SPREAD)).select("key").distinct()
    by_host = count.groupBy("key", "host").agg(F.sum("n").alias("n")).where(F.col("n") > least)
    hosts = docs.groupBy("host").agg(F.sum("docs").alias("docs"))
    of_host = by_host.join(hosts, "host").where(F.col("n") >= F.greatest(F.lit(least + 1), F.col("docs") * host_share)).groupBy("host").agg(F.collect_list("key").alias("of_host"))
    return of_host, written(of_lang, "p5-of-lang")


def with_shared(outlines: DataFrame, of_lang: DataFrame, most: int = MOST_SHARED) -> tuple[DataFrame, frozenset[int]]:
    """Outlines with of_shared, and the template texts of all languages, as short pages do not tell theirs. Up to ``most`` of these
    are sent to the tasks and of_shared is null; of more, each page gets its own by a join."""
    keys = of_lang.limit(most + 1).collect()
    if len(keys) <= most:
        return outlines.withColumn("of_shared", F.lit(None).cast("array<long>")), frozenset(r[0] for r in keys)
    page = ["record_table", "record_id", "doc"]
    own = outlines.select(*page, F.explode(F.array_distinct("key")).alias("k")).join(of_lang.select(F.col("key").alias("k")), "k", "left_semi")
    return outlines.join(own.groupBy(*page).agg(F.collect_set("k").alias("of_shared")), page, "left"), frozenset()


def outlined(pages: DataFrame) -> DataFrame:
    """Outlines of pages(record_table, record_id, url, html)."""
    return written(pages.where("html is not null and record_id is not null").select("record_table", "record_id", "url", "html").mapInArrow(_outlines, _OUTLINE), "p5-outlines")


def inferred(outlines: DataFrame, most: int = MOST_SHARED, **how) -> DataFrame:
    """The wrapper of each host of the outlines."""
    return wrappers(outlines, *templates(outlines, **how), most)


def main_content(pages: DataFrame, **how) -> DataFrame:
    """(record_table, record_id, block_no) of each block of each page's main piece."""
    out = outlined(pages)
    return out.drop("doc").join(kinds(inferred(out, **how)), "host", "left").mapInArrow(_classified, "record_table string, record_id string, block_no int").distinct()
