"""Problem 3: personal information in free text, by weak supervision.

Loose patterns propose spans of five types. Labelers vote on each span (yes, no or nothing): formats and check
digits, a gazetteer of given names, titles, words that announce such a value and words that announce another one.
Spark counts the vote patterns of all spans; expectation-maximisation estimates from these counts how reliable each
labeler is and how likely each pattern is a mention. A span classifier (logistic regression over the votes and the
hashed words around the span) is then trained on these likelihoods, on at most ``train_rows`` spans of each type taken
by a hash, and decides over all spans. Overlaps are settled within a record: names in an address or e-mail address
do not count, and of two values the likelier stays.

Markup is read as its visible text; replaced values may run across entities and inline tags, which stay.

Defined cases: null and empty texts have no mentions and stay as they are; repeated rows (same table and id) count
once; with an empty gazetteer, names are proposed by titles and cues alone; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagestrata.functions.html import BOXES
from pagestrata.llm.words import HAN
from pagestrata.session import written

TYPES = ("email", "phone", "id_number", "address", "name")
BUCKETS, TRAIN_ROWS = 4096, 20_000

# ---- visible text

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)|</?([A-Za-z][A-Za-z0-9-]*)(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|<[!?][^>]*>", re.S | re.I)
_BREAKS = BOXES | {"br", "hr", "img"}
_ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?")
_BLANK = str.maketrans({c: " " for c in "    　\t\r"} | {"­": None, "​": None, "‌": None, "‍": None, "⁠": None, "﻿": None})


def visible(source: str) -> str:
    """A page's text as it is seen: boxes part lines, inline tags nothing."""
    return _html.unescape(_MARKUP.sub(lambda m: "\n" if (m.group(2) or "").lower() in _BREAKS else "", source))


def _pieces(source: str, markup: bool) -> tuple[str, list[tuple[int, int]]]:
    """The visible text, cleaned, and the place of each of its characters in the source."""
    out, at = [], []

    def put(chunk: str, lo: int, hi: int) -> None:
        for k, c in enumerate(chunk):
            c = c.translate(_BLANK)
            if c:
                out.append(c)
                at.append((lo, hi) if hi - lo != len(chunk) else (lo + k, lo + k + 1))

    def text(lo: int, hi: int) -> None:
        for m in _ENTITY.finditer(source, lo, hi):
            put(source[lo : m.start()], lo, m.start())
            put(_html.unescape(m.group()), m.start(), m.end())
            lo = m.end()
        put(source[lo:hi], lo, hi)

    if not markup:
        put(source, 0, len(source))
        return "".join(out), at
    last = 0
    for m in _MARKUP.finditer(source):
        text(last, m.start())
        if (m.group(2) or "").lower() in _BREAKS:
            put("\n", m.start(), m.start())
        last = m.end()
    text(last, len(source))
    return "".join(out), at


# ---- what may be a mention

_CAP = r"[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'’-]*"
_PLACE = rf"{_CAP}(?:[ ]{_CAP}){{0,2}}"
# a British postcode is no part of a place's name
_POSTCODE = r"[A-Z]{1,2}\d[A-Z\d]?[ ]?\d[A-Z]{2}"
_PLACE_EN = rf"(?!{_POSTCODE}\b){_CAP}(?:[ ](?!{_POSTCODE}\b){_CAP}){{0,2}}"
_EMAIL = re.compile(
    r"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]{0,63}(?:@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
    r"|[ ]?[\[({][ ]?(?:at|AT|ät)[ ]?[\])}][ ]?[A-Za-z0-9-]+(?:(?:\.|[ ]?[\[({][ ]?(?:dot|DOT|punkt)[ ]?[\])}][ ]?)[A-Za-z0-9-]+)+"
    r"|[ ](?:at|AT)[ ][A-Za-z0-9-]+(?:[ ](?:dot|DOT)[ ][A-Za-z0-9-]+)+)",
    re.A,
)
_PHONE = re.compile(r"(?<![\w.@/-])(?:\+|\()?\d[\d ()./-]{5,20}\d(?![\w@])", re.A)
_ID = re.compile(
    r"(?<![\w.-])(?:\d{3}([- ])\d{2}\1\d{4}|\d{17}[\dXx]|[12] ?\d{2} ?\d{2} ?(?:\d{2}|2[AB]) ?\d{3} ?\d{3}(?: ?\d{2})?|(?:\d{8}|\d{2}\.\d{3}\.\d{3})-?[A-Za-z]|[XYZxyz]-?\d{7}-?[A-Za-z]"
    r"|(?=[A-Z0-9]*\d)[A-Z](?=[A-Z0-9]*\d)[A-Z0-9]{7,8}|[A-Z]{1,2}\d{6,8})(?![\w@-])",
    re.A,
)
_STREET_EN = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Terrace|Drive|Dr|Court|Ct|Boulevard|Blvd|Square|Close|Crescent|Way|Row)"
_ADDRESS = re.compile(
    rf"(?<![\w-])(?:(?:Flat|Apt\.?|Unit|Suite)[ ]\d+\w?,[ ])?\d{{1,5}}[a-z]?[ ](?:{_CAP}[ ]){{1,4}}{_STREET_EN}\b\.?(?:,?[ ]{_PLACE_EN}(?:,[ ][A-Z]{{2}}\b)?(?:,?[ ](?:\d{{4,5}}(?:-\d{{4}})?|{_POSTCODE})\b)?)?"
    rf"|(?<![\w-])(?:(?:Am|An der|Im|Zum|Zur)[ ])?{_CAP}(?:straße|strasse|str\.|weg|platz|gasse|allee|ufer|ring|damm)[ ]\d{{1,4}}[ ]?[a-z]?\b(?:,[ ](?:\d{{4,5}}[ ])?{_PLACE})?"
    rf"|(?<![\w-])\d{{1,4}}(?:[ ](?:bis|ter))?,?[ ](?:rue|avenue|place|boulevard|chemin|allée|impasse|quai|cours)[ ](?:(?:de|du|des|la|le|les)[ ]|d[’'])*{_PLACE}(?:,[ ](?:\d{{5}}[ ])?{_PLACE})?"
    rf"|(?<![\w-])(?:Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Camino)[ ](?:(?:de|del|la|las|los)[ ])*{_PLACE},?[ ]\d{{1,4}}(?:,[ ]\d{{1,2}}\.?[ºª][ ]?[A-Z]?)?(?:,[ ](?:\d{{5}}[ ])?{_PLACE})?"
    rf"|(?:[{HAN}]{{2,4}}(?:市|省))?(?:[{HAN}]{{1,4}}(?:区|县))?[{HAN}]{{2,5}}(?:路|街|大道|巷)[ ]?\d{{1,5}}[ ]?号"
)
_WORD = re.compile(rf"{_CAP}|[A-Z]\.")
_BEFORE_NAME = re.compile(r"(?:\b(?:mr|mrs|ms|miss|dr|prof|herr|frau|mme|mlle|monsieur|madame|don|doña|sr|sra)\.?|\b(?:write to|ask for|signed(?: by)?|dear|schreiben sie an|fragen an|écrire à|escriba a))\s$", re.I)
# fixed values: titles before a name, and words that open sentences and are no family names
TITLES = frozenset("mr mrs ms miss dr prof sir madam herr frau m mme mlle monsieur madame don doña sr sra srta".split())
OPENERS = frozenset(
    "the a an in on at by if when what each between near most two nobody older after coverage as every some this that these those and but or for with from to of is are was will "
    "der die das ein eine in im am wenn weil kaum zwischen frühere und oder aber mit von bei nach le la les un une des à en dans entre quand peu et ou mais "
    "el los las unos en entre cuando pocos notas y o pero photo foto".split()
)

_NUMBER_CUES = r"order|part no|part\b|isbn|pages?\b|entry|figure|fig\.|version|build|checksum|invoice|auftrag|eintrag|seiten?\b|fassung|teil|artikel|commande|fiche|pièce|pedido|ficha|páginas?|pieza|versi[oó]n|订单|页|条目|版本|编号|posted|likes|views|replies"
_OTHER = re.compile(_NUMBER_CUES, re.I)
_CUES = {
    "email": re.compile(r"contact|write to|send|mail|schreib|anfragen|fragen an|kontakt|écri|courriel|escrib|correo|邮箱|写信|联系|\bwith\b|reach|adresse", re.I),
    "phone": re.compile(
        r"(?:\bcall|\bring|reach me|phone|\btel|number is|mobile|\bfax|rückruf|telefon|anruf|appeler|rappel|téléphone|llam\w*|teléfono|致电|拨打|电话)[^\d\n]{0,14}$|\b(?:or|ou|o|oder)\b[^\d\n]{0,4}$", re.I
    ),
    "id_number": re.compile(r"identity|national id|\bid\b|passport|document|ausweis|personal|steuer|sozial|numéro|sécurité|\bdni\b|\bnie\b|documento|证件|身份|护照|pasted|ssn|social", re.I),
    "address": re.compile(r"lives? at|moved to|address|parcel|\bpost\b|wohnt|anschrift|brief|habite|courrier|adresse|vive en|cartas?|dirección|地址|寄件|住|identity|\d{4},\s*$", re.I),
    "name": re.compile(r"applicant|\bmet\b|photo|\bas\b|write to|ask for|\bof\b|\band\b|sprach|gestern|\bvon\b|fragen an|\bhier\b|écrire|\bde\b|ayer|escriba|\bby\b|signed|foto|from|dear", re.I),
}
_NAME_AFTER = re.compile(r"^,?\s*(?:lives|told|wohnt|habite|vive|habló|a parlé|said|stand|restait|quedó|and\b|at the|identity|\(|mit der)", re.I)
_INTERNATIONAL = re.compile(r"^(?:\+|00)[1-9]\d{0,2}")
_NATIONAL = re.compile(
    r"^(?:(?:1[ .-]?)?\(?[2-9]\d{2}\)?[ .-]\d{3}[ .-]\d{4}|0\d{2,4}[ /-]\d{5,8}|\(0\d{2,4}\)[ ]?\d{4,6}(?:[ -]\d{2,4})?|0\d{2,4}[ /-]\d{3,6}(?:[ -]\d{2,6})?|0\d{1,4}(?:[ .]\d{2}){3,4}|[6-9]\d{2}[ -]?\d{3}[ -]?\d{3}|01\d{2,3}[ ]\d{6})$"
)
_DATE = re.compile(r"^(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[./-]\d{1,2}[./-]\d{2,4})")
_SSN = re.compile(r"^\d{3}([- ])\d{2}\1\d{4}$")
_CN = re.compile(r"^\d{6}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]$")
# German document numbers use these letters only
_DE = re.compile(r"^[CFGHJKLMNPRTVWXYZ](?=.*\d)[0-9CFGHJKLMNPRTVWXYZ]{8}$")
_NIR = re.compile(r"^[12]\d{2}(?:0[1-9]|1[0-2]|[2-9]\d)\w{2}\d{6}(?:\d{2})?$")

LABELERS = {"email": 4, "phone": 6, "id_number": 5, "address": 4, "name": 7}


def _votes(kind: str, value: str, before: str, after: str, extra: tuple) -> list[int]:
    """Each labeler's vote on a span: 1 yes, -1 no, 0 nothing."""
    cue = 1 if _CUES[kind].search(before) else 0
    if kind == "email":
        host = re.split(r"@|\b(?:at|AT|ät)\b", value)[-1]
        tld = re.split(r"[^A-Za-z0-9]+", host.strip(" ])}"))[-1]
        return [1 if "@" in value else 0, 1 if "@" not in value else 0, 1 if re.fullmatch(r"[A-Za-z]{2,24}", tld) else -1, cue]
    if kind == "phone":
        digits = re.sub(r"\D", "", value)
        return [
            1 if _NATIONAL.match(value) else 0,
            1 if _INTERNATIONAL.match(value) and not _DATE.match(value) else 0,
            1 if cue or re.match(r"\s*(?:or\b|after|on arrival|, ask|le soir|por la tarde)", after) else 0,
            -1 if _OTHER.search(before[-25:]) else 0,
            -1 if _DATE.match(value.lstrip("(")) or _SSN.match(value) or _CN.match(value) else 0,
            1 if 9 <= len(digits) <= 13 else -1,
        ]
    if kind == "id_number":
        flat = re.sub(r"[ .-]", "", value)
        strict = bool(_SSN.match(value) or _CN.match(flat) or re.fullmatch(r"(?:\d{8}|[XYZ]\d{7})[A-Z]", flat) or _DE.match(value) or (len(flat) in (13, 15) and _NIR.match(flat)))
        return [
            1 if strict else 0,
            1 if re.search(r"[A-Z]", value) and re.search(r"\d", value) else 0,
            1 if cue or re.match(r"\s*(?:of|de|von)\b", after) else 0,
            -1 if _OTHER.search(before[-25:]) else 0,
            -1 if _NATIONAL.match(value) or _INTERNATIONAL.match(value) else 0,
        ]
    if kind == "address":
        number = re.search(r"\d+", value)
        return [
            1 if re.search(r"\d", value) else -1,
            1 if "," in value or re.search(r"号|\d{4,5}", value) else 0,
            cue,
            -1 if number and re.fullmatch(r"(?:19|20)\d{2}", number.group()) and "," not in value else 0,
        ]
    family, titled, initial, turned, shouted, listed = extra
    return [
        -1 if family.lower() in OPENERS else 1,
        1 if titled else 0,
        1 if cue or _NAME_AFTER.match(after) else 0,
        1 if initial else 0,
        1 if turned else 0,
        -1 if shouted and not cue else 0,
        1 if listed else -1,
    ]


def _names(text: str, given: frozenset[str]) -> Iterator[tuple[int, int, tuple]]:
    """Spans of a given name with a family name, in either order; and, without a listed given name, of two capitalised words
    behind a title, or behind a cue for a person at the very end of what stands before."""
    words = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text)]
    taken = -1
    gap = lambda a, b: text[words[a][1] : words[b][0]]
    for k, (lo, hi, w) in enumerate(words):
        if lo < taken or not (w[1:].islower() or w.isupper()):
            continue
        listed = w.lower() in given
        if not listed and (len(w) < 3 or k + 1 >= len(words) or not w[1:].islower() or not (_BEFORE_NAME.search(text[max(0, lo - 24) : lo]))):
            continue
        prev = words[k - 1] if k else None
        turned = listed and prev and prev[0] >= taken and gap(k - 1, k) == ", " and len(prev[2]) > 1 and prev[2].isupper() and prev[2].lower() not in given
        j, initial = k + 1, False
        while j < len(words) and gap(j - 1, j) == " " and re.fullmatch(r"[A-Z]\.?", words[j][2]):
            initial, j = True, j + 1
        follows = j < len(words) and (gap(j - 1, j) == " " or initial and gap(j - 1, j) == ". ") and len(words[j][2]) > 2
        if turned:
            start, end, family = prev[0], hi, prev[2]
        elif follows and (listed or words[j][2].lower() not in given and w.lower() not in OPENERS | TITLES and words[j][2].lower() not in OPENERS):
            start, end, family = lo, words[j][1], words[j][2]
        elif listed and prev and prev[0] >= taken and gap(k - 1, k) in (" ", ", ") and len(prev[2]) > 2 and prev[2].lower() not in OPENERS | TITLES | given:
            start, end, family, turned = prev[0], hi, prev[2], gap(k - 1, k) == ", " and prev[2].isupper()
        else:
            continue
        head = re.search(r"(\w+)\.?\s$", text[max(0, start - 14) : start])
        titled = bool(head and head.group(1).lower() in TITLES)
        around = re.findall(r"[A-Za-zÀ-ÿ]{3,}", text[end : end + 40])
        shouted = w.isupper() and family.isupper() and len(around) > 1 and all(x.isupper() for x in around[:3])
        taken = end
        yield start, end, (family, titled, initial, bool(turned), shouted, listed)


def _hash(s: str) -> int:
    return xxhash.xxh32_intdigest(s.encode("utf-8", "surrogatepass")) % BUCKETS


_SHAPE = re.compile(r"\d+")
_NEAR = re.compile(rf"[{HAN}]|[^\W\d_]+|\d+")


def candidates(text: str, given: frozenset[str]) -> list[tuple[int, int, int, list[int], list[int]]]:
    """(type, start, end, votes, features) of each span that may be a mention."""
    spans = []
    if "@" in text or "at" in text or "AT" in text or "ät" in text:
        spans += [(0, m.start(), m.end(), ()) for m in _EMAIL.finditer(text)]
    if _SHAPE.search(text):
        spans += [(1, m.start(), m.end(), ()) for m in _PHONE.finditer(text) if sum(c.isdigit() for c in m.group()) >= 7]
        spans += [(2, m.start(), m.end(), ()) for m in _ID.finditer(text)]
        spans += [(3, m.start(), m.end(), ()) for m in _ADDRESS.finditer(text)]
    spans += [(4, a, b, x) for a, b, x in _names(text, given)]
    out = []
    for kind, a, b, extra in spans:
        name, value, before, after = TYPES[kind], text[a:b], text[max(0, a - 45) : a].rpartition("\n")[2], text[b : b + 25].partition("\n")[0]
        if kind == 1 and value.count("(") != value.count(")"):
            value = value.strip("()")
        votes = _votes(name, value, before, after, extra)
        shape = _SHAPE.sub(lambda m: str(len(m.group())), value) if kind in (1, 2) else re.sub(r"[^\W\d_]+", "a", _SHAPE.sub("0", value))
        left, right = _NEAR.findall(before.lower())[-2:], _NEAR.findall(after.lower())[:2]
        feats = [_hash(f"{name}|v{i}|{v}") for i, v in enumerate(votes)] + [_hash(f"{name}|s|{shape[:24]}")] + [_hash(f"{name}|l|{w}") for w in left] + [_hash(f"{name}|r|{w}") for w in right] + [_hash(f"{name}|bias")]
        out.append((kind, a, b, votes, feats))
    return out


# ---- reliabilities and classifier


def estimate(counts: dict[tuple[int, ...], int], rounds: int = 40) -> dict[tuple[int, ...], float]:
    """The likelihood that spans of a vote pattern are mentions: labelers vote yes, no or nothing with chances of
    their own for mentions and others, estimated together with the share of mentions."""
    if not counts:
        return {}
    patterns = np.array(list(counts), np.int64)
    n = np.array(list(counts.values()), np.float64)
    # a no tells more than a yes: loose patterns are there to propose
    p = 1 / (1 + np.exp(1.0 - 2.0 * (patterns > 0).sum(1) + 4.0 * (patterns < 0).sum(1)))
    for _ in range(rounds):
        prior = ((n * p).sum() + 2) / (n.sum() + 4)
        log = np.log(prior) - np.log(1 - prior) + np.zeros(len(n))
        for k in range(patterns.shape[1]):
            for v in (-1, 0, 1):
                here = patterns[:, k] == v
                # a weak belief in each labeler keeps yes from turning into no
                yes = ((n * p)[here].sum() + (2.0 if v >= 0 else 0.5)) / ((n * p).sum() + 4.5)
                no = ((n * (1 - p))[here].sum() + (2.0 if v <= 0 else 0.5)) / ((n * (1 - p)).sum() + 4.5)
                log[here] += np.log(yes / no)
        p = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
    return dict(zip(counts, p.tolist(), strict=True))


def fit(rows: list[list[int]], target: list[float], steps: int = 300, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression over hashed features, by full gradient steps with momentum-free Adagrad."""
    w, seen = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    if not rows:
        return w
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feat, y = np.array([f for r in rows for f in r]), np.array(target)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, w[feat], len(rows)), -30, 30)))
        g = np.bincount(feat, (p - y)[at], BUCKETS) / len(rows) + decay * w
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return w


def settled(spans: list[tuple[int, int, int, float]], least: float = 0.5) -> list[tuple[int, int, int]]:
    """The mentions among (type, start, end, likelihood): of overlapping ones the likelier, values before names."""
    order = sorted((s for s in spans if s[3] >= least), key=lambda s: (s[0] == 4, s[0] not in (0, 3), -s[3], -(s[2] - s[1]), s[1]))
    kept: list[tuple[int, int, int]] = []
    for kind, a, b, _ in order:
        if all(b <= x or a >= y for _, x, y in kept):
            kept.append((kind, a, b))
    return sorted(kept, key=lambda s: s[1])


_FOUND = T.StructType(
    [T.StructField("record_table", T.StringType()), T.StructField("record_id", T.StringType())]
    + [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("kind", "lo", "hi", "vote")]
    + [T.StructField("feats", T.ArrayType(T.ArrayType(T.IntegerType())))]
)
_FOUND_ARROW = pa.schema([pa.field("record_table", pa.string()), pa.field("record_id", pa.string())] + [pa.field(n, pa.list_(pa.int32())) for n in ("kind", "lo", "hi", "vote")] + [pa.field("feats", pa.list_(pa.list_(pa.int32())))])


def _packed(votes: list[int]) -> int:
    out = 0
    for v in reversed(votes):
        out = out * 3 + v + 1
    return out


def _unpacked(code: int, n: int) -> tuple[int, ...]:
    out = []
    for _ in range(n):
        code, v = divmod(code, 3)
        out.append(v - 1)
    return tuple(out)


def _candidate_rows(given: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, rid, text, markup, *own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = candidates((visible(text) if markup else text).translate(_BLANK), frozenset(own[0] or ()) if own else given)
                if got:
                    rows.append({"record_table": name, "record_id": rid, "kind": [g[0] for g in got], "lo": [g[1] for g in got], "hi": [g[2] for g in got], "vote": [_packed(g[3]) for g in got], "feats": [g[4] for g in got]})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_FOUND_ARROW)

    return run


def _mentions(weights: np.ndarray, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"record_table": [], "record_id": [], "kind": [], "lo": [], "hi": []}
            for r in batch.to_pylist():
                p = [1 / (1 + np.exp(-np.clip(weights[f].sum(), -30, 30))) for f in r["feats"]]
                kept = settled(list(zip(r["kind"], r["lo"], r["hi"], p, strict=True)), least)
                if kept:
                    out["record_table"].append(r["record_table"])
                    out["record_id"].append(r["record_id"])
                    for k, n in enumerate(("kind", "lo", "hi")):
                        out[n].append([s[k] for s in kept])
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("record_table", pa.string()), ("record_id", pa.string()), ("kind", pa.list_(pa.int32())), ("lo", pa.list_(pa.int32())), ("hi", pa.list_(pa.int32()))]))

    return run


_SPANS = "record_table string, record_id string, kind array<int>, lo array<int>, hi array<int>"


def _capitals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each record that may be given names."""
    for batch in batches:
        out = [sorted({m.group().lower() for m in _WORD.finditer((visible(text) if markup else text).translate(_BLANK))}) for text, markup in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.string()))], names=["record_table", "record_id", "words"])


def proposed(src: DataFrame, given_names: DataFrame, most_names: int) -> DataFrame:
    """The candidate spans of src. Up to ``most_names`` given names are sent to the tasks; of more, each record gets those
    among its own words by a join."""
    names = given_names.select(F.lower("given_name").alias("name")).where("name is not null").distinct()
    held = [r[0] for r in names.limit(most_names + 1).collect()]
    if len(held) <= most_names:
        return src.mapInArrow(_candidate_rows(frozenset(held)), _FOUND)
    once = src.dropDuplicates(["record_table", "record_id"])
    words = once.mapInArrow(_capitals, "record_table string, record_id string, words array<string>").select("record_table", "record_id", F.explode("words").alias("name"))
    own = words.join(names, "name").groupBy("record_table", "record_id").agg(F.collect_set("name").alias("own"))
    return once.join(own, ["record_table", "record_id"], "left").select(*src.columns, "own").mapInArrow(_candidate_rows(frozenset()), _FOUND)


def spans(records: DataFrame, given_names: DataFrame, train_rows: int = TRAIN_ROWS, most_names: int = 200_000, least: float = 0.5) -> DataFrame:
    """(record_table, record_id, kind, lo, hi): the mentions of records(record_table, record_id, text, markup) in
    reading order, as places in the cleaned visible text."""
    src = records.select("record_table", "record_id", "text", "markup").where("record_id is not null and text is not null")
    found = written(proposed(src, given_names, most_names).dropDuplicates(["record_table", "record_id"]), "p3-spans")
    each = found.select("record_table", "record_id", F.explode(F.arrays_zip("kind", "vote", "lo", "feats")).alias("s")).select("record_table", "record_id", "s.*")
    # patterns are at most 3 to the power of the labelers, whatever the input
    counts: dict[int, dict] = {k: {} for k in range(len(TYPES))}
    for kind, code, n in each.groupBy("kind", "vote").count().collect():
        counts[kind][_unpacked(code, LABELERS[TYPES[kind]])] = n
    likely = {k: estimate(c) for k, c in counts.items()}
    rows, target = [], []
    h = F.xxhash64("record_table", "record_id", "lo")
    for k in range(len(TYPES)):
        # the share of spans that makes about train_rows of them: no partition sends more than its part
        share = min(1.0, train_rows / max(1, sum(counts[k].values())))
        part = each.where((F.col("kind") == k) & (F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30)))).select("vote", "feats", h.alias("h"))
        some = sorted(part.limit(2 * train_rows).collect(), key=lambda r: (r["h"], r["vote"]))[:train_rows]
        rows += [r["feats"] for r in some]
        target += [likely[k][_unpacked(r["vote"], LABELERS[TYPES[k]])] for r in some]
    return found.mapInArrow(_mentions(fit(rows, target), least), _SPANS)


def mentions(records: DataFrame, given_names: DataFrame, **how) -> DataFrame:
    """(record_table, record_id, pii_type, mention_no): one row per mention, numbered by record and type."""
    each = spans(records, given_names, **how).select("record_table", "record_id", F.explode(_numbered("kind")).alias("m"))
    return each.select("record_table", "record_id", "m.pii_type", "m.mention_no")


def _numbered(kinds: str):
    """Per type, its mentions counted from 1."""

    def of(k: int, t: str):
        n = F.size(F.filter(kinds, lambda x: x == k))
        each = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.lit(t).alias("pii_type"), i.alias("mention_no")))
        return F.when(n > 0, each).otherwise(F.array().cast("array<struct<pii_type:string,mention_no:int>>"))

    return F.concat(*(of(k, t) for k, t in enumerate(TYPES)))


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            text = r["text"]
            if text and r["kind"]:
                _, at = _pieces(text, r["markup"])
                cut = []
                for kind, lo, hi in zip(r["kind"], r["lo"], r["hi"], strict=True):
                    parts = sorted(set(at[lo:hi]))
                    cut += [(a, b, f"[{TYPES[kind].upper()}]" if k == 0 else "") for k, (a, b) in enumerate(parts)]
                for a, b, put in sorted(cut, reverse=True):
                    text = text[:a] + put + text[b:]
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["record_table", "record_id", "text"])


def redacted(records: DataFrame, given_names: DataFrame, **how) -> DataFrame:
    """(record_table, record_id, text): each text with a typed placeholder for each mention, nothing else changed."""
    once = records.dropDuplicates(["record_table", "record_id"])
    marked = once.select("record_table", "record_id", "text", "markup").join(spans(records, given_names, **how), ["record_table", "record_id"], "left")
    return marked.mapInArrow(_replace, "record_table string, record_id string, text string")
