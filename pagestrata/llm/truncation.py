"""Problem 8: texts that were cut off, in SQL over word trigrams.

Every sentence or line of every distinct text gives its word trigrams, counted inside and at ends. A text that
does not close with a sentence's end is joined with the counts of its final trigram, and where that has not been seen
often enough with those of its last two words and of its last word. Numbers count as one word, as do capitalised
words inside a sentence, so that names do not make every trigram unique. The rules, of which the first that holds names
the text's ``rule``:

- ``trigram``, ``bigram``, ``word``: the end is frequent inside and almost never last, on the longest of the three that
  has been seen ``seen`` times; a mark of omission is taken off before the look-up, so a writer's own dots ("We will
  see...") count as a common end;
- ``fragment``: a last word that is seen nowhere else and with which a known word begins;
- ``broken``: the text ends in a broken character or entity;
- ``length``: the text stands at the very length at which its source's texts pile up and end, and closes no sentence;
- ``open``: too rare for any count, or an end that counts allow, in a line of a sentence's length that is no heading, list
  item, code, signature or link and does not close: an open sentence is a cut unless its final trigram mostly ends one.

Lines that may end a complete text without a full stop (headings, list items) are held to the counts alone; code,
signatures and links that are whole are no cuts.

Texts are keyed by a hash of 64 bits and their length; whole texts are shuffled once, to tell the distinct ones.

Defined cases: null and blank texts are never cut and do not count; equal texts count once in the statistics and
each get the same verdict; sources that are null form one group in the rates; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.session import written

# in the SQL below, braces are fields: patterns are written without them
_HAN = "㐀-䶿一-鿿豈-﫿"
# the first part is a shortcut for the scripts whose letters the engine finds in a table
_W = rf"[0-9A-Za-zÀ-ÖØ-öø-ɏ\\u0300-\\u036F]+|[{_HAN}]|[\\pL\\pM\\pN&&[^{_HAN}]]+"
_MARK = r"\\s*(?:…+|\\.\\.\\.+|\\[\\s*(?:…|\\.\\.\\.)\\s*\\])\\s*$"
_CLOSED = r"""[.!?。！？][\\s"\\u0027”“»«’)\\]）」』*_]*$"""
_TAIL = r"[\\s🌀-🫿☀-➿\\uFE0F\\u200D]+$"

# one row per distinct text: base is the text without trailing space, pictographs and a mark of omission. LATERAL VIEW
# keeps each pattern from being run anew by every column that is made from its result.
_ENDS = f"""
SELECT h, chars, marked, broken, concat(head, stem) AS base, NOT broken AND stem RLIKE '{_CLOSED}' AS closed
FROM (SELECT h, chars, trim(TRAILING ' \\t\\r\\n' FROM text) AS body FROM (SELECT h, chars, any_value(text) AS text FROM {{docs}} GROUP BY h, chars))
LATERAL VIEW inline(array(struct(left(body, greatest(0, length(body) - 80)) AS head, regexp_replace(right(body, 80), '{_TAIL}', '') AS tail))) h
LATERAL VIEW inline(array(struct(tail RLIKE '{_MARK}' AS marked, tail RLIKE '(&[#A-Za-z0-9]*|�)$' AS broken, regexp_replace(tail, '{_MARK}', '') AS stem))) m"""

# ends of sentences as ends of lines: a pattern of so many signs takes longer than to find words
_SPLIT = "base"
for _end in ".!?。！？":
    _SPLIT = f"replace({_SPLIT}, '{_end}', '\\n')"

# the words of r hashed, numbers and names (as a letter of no language at hand) made alike
_MASKED = """transform(r, (x, j) -> xxhash64(CASE WHEN x >= '0' AND x < ':' THEN '0'
  WHEN j > 0 AND (x >= 'A' AND x < '[' OR x >= 'À' AND x < 'ß' OR x >= 'Ā' AND x < '⺀' AND left(x, 1) != lower(left(x, 1))) THEN 'ǂ' ELSE lower(x) END))"""

# one row per sentence or line of a text, its words in r and m; open: the last one of a text that does not close, which alone
# carries the text's key
_UNITS = f"""
SELECT e IS NOT NULL AS open, e, r, m
FROM (SELECT struct(h, chars, marked, broken, substring_index(base, '\\n', -1) AS line) AS last, closed, split({_SPLIT}, '\\n') AS units FROM {{ends}})
LATERAL VIEW inline(array(struct(filter(transform(units, u -> regexp_extract_all(u, '{_W}', 0)), r -> size(r) > 0) AS kept))) k
LATERAL VIEW inline(transform(kept, (r, i) -> struct(r, {_MASKED} AS m, if(NOT closed AND i = size(kept) - 1, last, NULL) AS e))) x"""

# keys of the i-th word of m from 0 with the two, the one and none before it: of as many words as k
def _key(k: int, i: str) -> str:
    return f"xxhash64({', '.join(f'coalesce(get(m, {i} - {n}), 0)' for n in range(k))})"


# how often a trigram stands inside, at a closed end, and at an open one
_COUNTS = f"""
SELECT g3, max(g2) AS g2, max(g1) AS g1, sum(if(i < n, 1L, 0L)) AS inside, sum(if(i = n AND NOT open, 1L, 0L)) AS ending, sum(if(i = n AND open, 1L, 0L)) AS opened FROM (
  SELECT open, n, i, {_key(3, "i")} AS g3, {_key(2, "i")} AS g2, {_key(1, "i")} AS g1
  FROM (SELECT open, m, size(m) - 1 AS n, posexplode(m) AS (i, x) FROM {{units}}))
GROUP BY g3"""

_WORDS = """
SELECT lower(x) AS x, sum(n) AS n FROM (SELECT x, count(*) AS n FROM (SELECT explode(if(open, slice(r, 1, size(r) - 1), r)) AS x FROM {units}) GROUP BY x) GROUP BY lower(x)"""

# the last trigram, bigram and word of each text that doesn't close, with their counts
_JUDGED = f"""
WITH tri AS (SELECT * FROM {{counts}}),
bi AS (SELECT g2, sum(inside) AS inside, sum(ending) AS ending FROM tri GROUP BY g2),
uni AS (SELECT g1, sum(inside) AS inside, sum(ending) AS ending FROM tri GROUP BY g1),
stems AS (SELECT x, sum(n) AS n FROM (SELECT explode(transform(sequence(1, length(x) - 1), k -> left(x, k))) AS x, n FROM {{words}} WHERE length(x) > 1) GROUP BY x),
last AS (
  SELECT *, {_key(3, "n - 1")} AS g3, {_key(2, "n - 1")} AS g2, {_key(1, "n - 1")} AS g1 FROM (
    SELECT e.*, size(r) AS n, element_at(r, -1) AS w, lower(element_at(r, -1)) AS r1, m FROM {{units}} WHERE open))
SELECT h, chars, marked, broken, get(m, last.n - 1) = xxhash64('ǂ') OR w RLIKE '[{_HAN}]' AS named,
       coalesce(tri.inside, 0) AS in3, coalesce(tri.ending, 0) AS end3, coalesce(tri.opened, 1) - 1 AS open3,
       coalesce(bi.inside, 0) AS in2, coalesce(bi.ending, 0) AS end2, coalesce(uni.inside, 0) AS in1, coalesce(uni.ending, 0) AS end1,
       whole.x IS NULL AND coalesce(stems.n, 0) >= 2 AS fragment,
       line RLIKE '^\\\\s*([-*•+]|[0-9]+[.)])\\\\s' AS listed,
       line RLIKE '^\\\\s*(```|~~~)\\\\s*$' AS fence, line RLIKE '^\\\\s*(--|—|–)\\\\s*\\\\S+' AS signed,
       line RLIKE '(https?://|www\\\\.)\\\\S+$' AS linked,
       NOT line RLIKE '[,;:，；：、。.!?！？]' AND last.n <= if(line RLIKE '[{_HAN}]', 14, 8) AS bare
FROM last LEFT JOIN tri ON last.g3 = tri.g3 LEFT JOIN bi ON last.g2 = bi.g2 LEFT JOIN uni ON last.g1 = uni.g1
     LEFT JOIN stems ON r1 = stems.x LEFT JOIN {{words}} AS whole ON r1 = whole.x"""

_CUT = """
SELECT j.h, j.chars, CASE
  WHEN tried IN ('trigram', 'bigram', 'word') AND final_share < {share} AND NOT (fence OR signed OR linked OR marked AND own_dots) THEN tried
  WHEN broken THEN 'broken' WHEN fragment AND NOT (fence OR signed OR linked) THEN 'fragment' WHEN piled THEN 'length' ELSE 'open' END AS rule
FROM (
  SELECT *, CASE WHEN in3 + end3 >= {seen} THEN 'trigram' WHEN in2 + end2 >= {seen} THEN 'bigram' WHEN in1 + end1 >= {seen} THEN 'word' ELSE 'none' END AS tried,
         CASE WHEN in3 + end3 >= {seen} THEN end3 / (in3 + end3) WHEN in2 + end2 >= {seen} THEN end2 / (in2 + end2)
              WHEN in1 + end1 >= {seen} THEN end1 / (in1 + end1) ELSE 0 END AS final_share,
         end3 + open3 >= {seen} AND (end3 + open3) / (in3 + end3 + open3) >= 0.5 AS own_dots
  FROM {judged}) j LEFT JOIN (SELECT DISTINCT d.h, d.chars, true AS piled FROM {docs} d JOIN {limits} l ON d.source <=> l.source AND d.chars = l.chars) p ON j.h = p.h AND j.chars = p.chars
WHERE broken OR piled AND NOT (fence OR marked OR signed OR linked) OR CASE
  WHEN fence OR signed OR linked THEN false
  WHEN fragment THEN true
  WHEN marked THEN NOT own_dots
  WHEN listed THEN end1 = 0 OR final_share < {share} / 20 AND NOT named
  WHEN bare THEN final_share < {share}
  ELSE NOT (tried = 'trigram' AND final_share >= 0.9) END"""

_LIMITS = """
SELECT source, max(chars) AS chars FROM (SELECT source, chars, count(DISTINCT h) AS n FROM {docs} GROUP BY source, chars)
GROUP BY source HAVING max_by(n, chars) >= 4"""


def _keyed(documents: DataFrame) -> DataFrame:
    """documents with the key of their text: h and chars."""
    return documents.where(F.col("text").rlike(r"\S")).withColumns({"h": F.xxhash64("text"), "chars": F.length("text")})


def cut_texts(documents: DataFrame, seen: int = 3, share: float = 0.05) -> DataFrame:
    """(h, chars, rule): the keys of the distinct texts of documents(text, source) that were cut, and by what this is told."""
    sql = documents.sparkSession.sql
    docs = _keyed(documents)
    units = written(sql(_UNITS, ends=sql(_ENDS, docs=docs.select("h", "chars", "text"))), "p8-units")
    judged = sql(_JUDGED, counts=written(sql(_COUNTS, units=units), "p8-counts"), words=sql(_WORDS, units=units), units=units)
    judged, keys = written(judged, "p8-judged"), docs.select("h", "chars", "source")
    return sql(_CUT.replace("{seen}", str(int(seen))).replace("{share}", repr(float(share))), judged=judged, docs=keys, limits=sql(_LIMITS, docs=keys))


def cut_documents(documents: DataFrame, **how) -> DataFrame:
    """(doc_id, rule): each document whose text was cut."""
    return _keyed(documents.select("doc_id", "text")).drop("text").join(cut_texts(documents, **how), ["h", "chars"]).select("doc_id", "rule")


def cut_rates(documents: DataFrame, **how) -> DataFrame:
    """(source, n_documents, n_cut, cut_rate): how often each source cuts its texts."""
    each = _keyed(documents.select("source", "text")).drop("text").join(cut_texts(documents, **how), ["h", "chars"], "left")
    return each.groupBy("source").agg(F.count("*").alias("n_documents"), F.count("rule").alias("n_cut"), (F.count("rule") / F.count("*")).alias("cut_rate"))


def cut_rules(documents: DataFrame, **how) -> DataFrame:
    """(rule, n_texts): how many distinct texts each rule told to be cut."""
    return cut_texts(documents, **how).groupBy("rule").agg(F.count("*").alias("n_texts"))
