"""Content units of raw pages, and pages made safe to keep."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagestrata import limits
from pagestrata.functions import text as X
from pagestrata.functions import url as U
from pagestrata.functions.html import attributes, blocks, squeezed, start_tags

# fixed values: boxes and roles that are no content, and where units name their address, author and time
_NOISE = frozenset(("nav", "header", "footer", "aside"))
_NOISE_ROLES = frozenset("navigation menu menubar toolbar menuitem button".split())
_CONTROLS = frozenset("button input select textarea".split())
_PERMALINK = ((("a", "rel", "permalink"), ("a", "itemprop", "url"), ("", "itemprop", "url"), ("", "data-permalink", None)), ("href", "content", "data-permalink"))
_AUTHOR = ((("", "rel", "author"), ("", "itemprop", "author"), ("", "data-author", None)), ("content", "datetime", "data-author"))
_PUBLISHED = ((("time", "datetime", None), ("", "itemprop", "datePublished")), ("datetime", "content"))
_UNIT = T.StructType([T.StructField("mode", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("anchor", T.StringType()), T.StructField("position", T.IntegerType()), T.StructField("permalink", T.StringType()), T.StructField("author", T.StringType()), T.StructField("published_at", T.StringType()), T.StructField("type", T.StringType()), T.StructField("n_blocks", T.IntegerType()), T.StructField("text", T.StringType())])
UNITS = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("page_url", T.StringType()), T.StructField("status", T.StringType()), T.StructField("units", T.ArrayType(_UNIT))])


def first_attribute(tags: list[tuple[str, dict[str, str]]], where: tuple, names: tuple[str, ...]) -> str | None:
    """The first filled attribute of the first tag that a condition (tag or any, attribute, word in it or any) holds for, conditions
    in order."""
    for tag, name, word in where:
        hit = next((a for t, a in tags if (not tag or t == tag) and name in a and (word is None or (word in a[name].split() if name == "rel" else a[name] == word))), None)
        value = next((hit[n] for n in names if hit.get(n)), None) if hit else None
        if value:
            return value
    return None


def resolved(raw: str | None, base: str | None) -> str | None:
    """A url against the page it stands on; null if it cannot be read."""
    try:
        out = urljoin(base or "", raw) if raw else None
        return out if out and urlsplit(out).scheme else None
    except ValueError:
        return None


def unit_type(tag: str, attrs: dict[str, str], size: int) -> str:
    role, kind = attrs.get("role", "").lower(), attrs.get("itemtype", "").lower()
    if role == "comment" or "comment" in kind:
        return "comment"
    if "article" in kind or "discussionforumposting" in kind or tag == "article" or role == "article":
        return "article"
    return "content" if size >= limits.READABLE_MIN_CHARS else "unknown"


def eligible_item(attrs: dict[str, str], tags: list[tuple[str, dict[str, str]]], size: int) -> bool:
    """Whether a list item may be a unit: no button or menu entry, and with controls only if it says more."""
    if attrs.get("role", "").lower() in ("button", "menuitem"):
        return False
    return size >= limits.MIN_BLOCK_CHARS * (2 if any(t in _CONTROLS for t, _ in tags) else 1)


def page_units(source: str | None, page_url: str | None = None) -> tuple[str, list[dict]]:
    """(status, units) of a page. Articles are units by their meaning; three or more siblings of one shape are units by
    repetition; a page with neither is one unit of its main, first article or body. Limits refuse a page whole."""
    if source and len(source.encode("utf-8", "surrogatepass")) > limits.SNAPSHOT_MAX_BYTES:
        return "input_too_large", []
    found, boxes = blocks(source)
    if not found:
        return "empty", []
    depth = [0] * len(boxes)
    for i, b in enumerate(boxes):
        depth[i] = 0 if b.parent < 0 else depth[b.parent] + 1
    if len(boxes) > limits.SNAPSHOT_MAX_NODES or max(depth) > limits.UNIT_MAX_DEPTH:
        return "resource_limit", []
    noisy = [False] * len(boxes)
    attrs = [attributes(b.attrs) if b.attrs and not b.attrs.isspace() else {} for b in boxes]
    role = [a.get("role", "").lower() for a in attrs]
    article = [b.tag == "article" or role[i] == "article" for i, b in enumerate(boxes)]
    for i, b in enumerate(boxes):
        noisy[i] = b.tag in _NOISE or role[i] in _NOISE_ROLES or (b.parent >= 0 and noisy[b.parent])

    def tags_of(i: int) -> list[tuple[str, dict[str, str]]]:
        """The start tags of a box and what it holds."""
        end = i + 1
        while end < len(boxes) and boxes[end].parent >= i:
            end += 1
        piece = source[boxes[i].at : boxes[end].at if end < len(boxes) else len(source)]
        close = piece.lower().rfind(f"</{boxes[i].tag}")
        return start_tags(piece[:close] if close > 0 else piece)
    inside: dict[int, list] = {}
    for b in found:
        for i in b.path:
            inside.setdefault(i, []).append(b)
    size = {i: sum(len("".join(b.text.split())) for b in bs) for i, bs in inside.items()}
    children: dict[int, list[int]] = {}
    for i in inside:
        children.setdefault(boxes[i].parent, []).append(i)
    picked: dict[int, tuple[str, float]] = {i: ("semantic", 0.95) for i in sorted(inside) if article[i] and not noisy[i]}
    for parent in sorted(children):
        if parent >= 0 and noisy[parent]:
            continue
        shapes: dict[tuple, list[int]] = {}
        for i in sorted(children[parent]):
            tags = tuple(boxes[j].tag for j in sorted(children.get(i, ())))[:16]
            links = sum(b.linked > 0 for b in inside[i])
            shapes.setdefault((boxes[i].tag, role[i], tags, min(9, size[i] // 100), min(9, links)), []).append(i)
        for group in shapes.values():
            if len(group) >= 3:
                for i in group:
                    if size[i] >= limits.MIN_BLOCK_CHARS and not noisy[i] and (boxes[i].tag != "li" or eligible_item(attrs[i], tags_of(i), size[i])):
                        picked.setdefault(i, ("repeated_structure", limits.UNIT_THRESHOLD + 0.05))
    if len(picked) > limits.UNIT_MAX_UNITS:
        return "resource_limit", []
    if not picked:
        roots = [i for i in inside if boxes[i].tag == "main"] or [i for i in inside if boxes[i].tag == "body"] or [found[0].path[0]]
        picked = {max(roots, key=lambda i: (size[i], -i)): ("fallback", 0.55)}
    out = []
    for i, (mode, confidence) in sorted(picked.items()):
        own = [b for b in inside[i] if not any(article[j] for j in b.path[b.path.index(i) + 1 :])]
        own = [squeezed(b.text) for b in own if len("".join(b.text.split())) >= (1 if b.tag[0] == "h" else limits.MIN_BLOCK_CHARS)]
        if own:
            tags = tags_of(i)
            named = {"permalink": resolved(first_attribute(tags, *_PERMALINK), page_url), "author": first_attribute(tags, *_AUTHOR), "published_at": first_attribute(tags, *_PUBLISHED), "type": unit_type(boxes[i].tag, attrs[i], size[i])}
            out.append({"mode": mode, "confidence": min(1.0, max(0.0, confidence)), "anchor": attrs[i].get("id") or None, "position": len(out)} | named | {"n_blocks": len(own), "text": "\n\n".join(own)})
    return ("ok", out) if out else ("empty", [])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("mode", pa.string()), ("confidence", pa.float64()), ("anchor", pa.string()), ("position", pa.int32()), *((n, pa.string()) for n in ("permalink", "author", "published_at", "type")), ("n_blocks", pa.int32()), ("text", pa.string())]))
    for batch in batches:
        got = [page_units(h, u) for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got]), pa.array([g[1] for g in got], kind)], names=UNITS.names)


def extracted(pages: DataFrame) -> DataFrame:
    """(record_id, page_url, status, units) of pages(record_id, page_url, html)."""
    return pages.select("record_id", "page_url", "html").mapInArrow(_units, UNITS)


def observations(got: DataFrame, threshold: float = limits.UNIT_THRESHOLD) -> DataFrame:
    """One row per unit, with its identity and fingerprints: by its permalink, made safe, if that may be shown; else by origin, page and
    anchor; else by its repeat number among equal texts of a page. A fallback is kept whatever its confidence."""
    each = got.where("status = 'ok'").select("record_id", "page_url", F.explode("units").alias("u")).select("record_id", "page_url", "u.*").where((F.col("confidence") >= threshold) | (F.col("mode") == "fallback"))
    each = each.withColumn("raw_fingerprint", X.sha256_ref(F.col("text"))).withColumn("stable_fingerprint", X.stable_fingerprint(F.col("text")))
    repeat = F.row_number().over(Window.partitionBy("record_id", "raw_fingerprint").orderBy("position")) - 1
    keyed = F.concat_ws("|", F.lit("anchor"), U.origin(F.col("page_url")), F.col("page_url"), F.col("anchor"))
    each = each.withColumn("permalink", U.sanitized(F.col("permalink")))
    by_link = F.concat(F.lit("permalink|"), F.col("permalink"), F.lit("|"))
    each = each.withColumn("identity", F.when(F.col("permalink").isNotNull(), by_link).when(F.col("anchor").isNotNull(), F.concat(keyed, F.lit("|"))).otherwise(F.concat(F.lit("unkeyed|"), repeat.cast("string"))))
    each = each.withColumn("unit_id", X.short_id("unit-", F.col("identity")))
    return each.withColumn("observation_id", X.short_id("uobs-", F.concat_ws("|", "record_id", "unit_id", "raw_fingerprint")))


# ---- pages made safe to keep

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|iframe|object|textarea|select)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([A-Za-z][A-Za-z0-9-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
_SAFE_TAGS = {"a": ("href",), "img": ("src", "alt"), "td": ("colspan", "rowspan"), "th": ("colspan", "rowspan")}
# fixed values: elements that are left out with all they hold or stand alone, and words in class or id that tell an advertisement
_DROPPED = frozenset("nav header footer aside form dialog button label fieldset legend datalist output option optgroup title video audio picture canvas map input link meta base embed source track area".split())
_VOID = frozenset("input link meta base embed source track area br hr img wbr col".split())
AD_WORDS = frozenset("ad ads advert adverts advertisement advertisements advertising banner banners promo promos sponsor sponsored".split())
AD_MOST = 64
_RELATIVE = re.compile(r"^(?:[/#.]|[\w-]+(?:[/?#.]|$))")
SAFE = "record_id string, html string, status string, n_nodes int, n_dropped int, html_bytes long"


def is_advertisement(attrs: dict[str, str]) -> bool:
    """Whether a word of class or id, parted at dashes, underscores and spaces, is one of an advertisement's."""
    return any(not AD_WORDS.isdisjoint(re.split(r"[-_\s]+", attrs.get(n, "").lower())) for n in ("class", "id"))


def is_editable(attrs: dict[str, str]) -> bool:
    return "contenteditable" in attrs and attrs["contenteditable"].lower() != "false" or attrs.get("role", "").lower() == "textbox"


def numeric(value: str | None) -> str | None:
    return value if value is not None and re.fullmatch(r"[0-9]+", value) else None


def _end(tokens: list, k: int) -> tuple[int, int]:
    """Where the element that token k opens ends (the token after it), and how many elements it holds; an unclosed one ends the page."""
    name, open_, held = tokens[k][1], 1, 0
    for j in range(k + 1, len(tokens)):
        closing, other = tokens[j][0], tokens[j][1]
        if other == name:
            open_ += -1 if closing else other not in _VOID
            if open_ == 0:
                return j + 1, held
        held += not closing and other != ""
    return len(tokens), held


def safe_page(source: str | None, page_url: str | None = None) -> dict:
    """The markup without scripts, forms, furniture, comments, editable parts and small advertisements, and without all attributes but a few;
    addresses stand against the page's url, if that is known, and are made safe; and whether the page may be kept."""
    source = source or ""
    tokens, out, nodes, dropped = [], [], 0, 0
    for m in _TAG.finditer(source):
        tokens.append((bool(m.group(2)), (m.group(3) or "").lower(), m.group(4), m.start(), m.end(), bool(m.group(1))))
    at, k = 0, 0
    while k < len(tokens):
        closing, name, raw, begin, end, whole = tokens[k]
        out.append(source[at:begin])
        at, k = end, k + 1
        if not name:
            dropped += whole
            continue
        if closing:
            out.append("" if name in _DROPPED else f"</{name}>")
            continue
        attrs = attributes(raw) if raw and not raw.isspace() else {}
        leave = name in _DROPPED or is_editable(attrs)
        if not leave and name not in ("html", "body") and attrs and is_advertisement(attrs):
            leave = _end(tokens, k - 1)[1] <= AD_MOST
        if leave:
            dropped += 1
            if name not in _VOID:
                k = _end(tokens, k - 1)[0]
                at = tokens[k - 1][4] if k > 0 else at
            continue
        nodes += 1
        kept = []
        for n in _SAFE_TAGS.get(name, ()):
            v = attrs.get(n)
            if v is None:
                continue
            if n in ("href", "src") and (page_url or not _RELATIVE.match(v)):
                v = U.safe(resolved(v, page_url) or "")
            elif name in ("td", "th"):
                v = numeric(v)
            if v is not None:
                kept.append(f' {n}="{_html.escape(v)}"')
            else:
                dropped += 1
        out.append(f"<{name}{''.join(kept)}>")
    out.append(source[at:])
    html = "".join(out)
    size = len(html.encode("utf-8", "surrogatepass"))
    readable = len("".join(re.sub(r"<[^>]*>", "", html).split()))
    over = size > limits.SNAPSHOT_MAX_BYTES or nodes > limits.SNAPSHOT_MAX_NODES
    status = "limit_exceeded" if over else "too_little_content" if readable < limits.READABLE_MIN_CHARS else "ok"
    return {"html": html if status == "ok" else None, "status": status, "n_nodes": nodes, "n_dropped": dropped, "html_bytes": size}


def _safe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [safe_page(h, u) for h, u in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([g["html"] for g in got], pa.string()), pa.array([g["status"] for g in got]), pa.array([g["n_nodes"] for g in got], pa.int32()), pa.array([g["n_dropped"] for g in got], pa.int32()), pa.array([g["html_bytes"] for g in got], pa.int64())],
            names=["record_id", "html", "status", "n_nodes", "n_dropped", "html_bytes"],
        )


def safe_pages(pages: DataFrame) -> DataFrame:
    """(record_id, html, status, n_nodes, n_dropped, html_bytes) of pages(record_id, page_url, html); refused pages keep no html, and pages whose own
    address must not be shown are denied. Secrets in the kept markup are replaced."""
    page_url = F.col("page_url") if "page_url" in pages.columns else F.lit(None).cast("string")
    deny = pages.select("record_id", U.deny_reason(page_url).alias("deny")) if "page_url" in pages.columns else None
    out = pages.select("record_id", "html", page_url.alias("page_url")).mapInArrow(_safe, SAFE).withColumn("html", X.without_secrets(F.col("html")))
    if deny is None:
        return out
    denied = deny.where("deny is not null").select("record_id").distinct().withColumn("denied", F.lit(True))
    out = out.join(denied, "record_id", "left")
    return out.withColumn("status", F.when(F.col("denied"), "denied").otherwise(F.col("status"))).withColumn("html", F.when(F.col("denied").isNull(), F.col("html"))).drop("denied")
