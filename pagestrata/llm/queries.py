"""Named queries of the numbered problems, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.llm import contamination, near_duplicates, packing, personal, residue, site_lines, truncation, wrappers
from pagestrata.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_duplicates.similar_pairs(table(spark, sf_dir, "evidence_blobs"), "id", "text")
    return pairs.select(F.col("id_a").alias("blob_id_a"), F.col("id_b").alias("blob_id_b"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each blob that has a near copy, with its class and its number of links."""
    return near_duplicates.near_groups(table(spark, sf_dir, "evidence_blobs"), "id", "text").withColumnRenamed("id", "blob_id")


def p1_unit_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit observations that say almost the same, over both fingerprints and the texts of all their evidence blocks."""
    return near_duplicates.unit_groups(table(spark, sf_dir, "unit_observations"), table(spark, sf_dir, "evidence_blobs")).drop("links")


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = table(spark, sf_dir, "dom_snapshots")
    return snaps.select(F.lit("dom_snapshots").alias("record_table"), F.col("msg_id").cast("string").alias("record_id"), "url", F.get_json_object("payload_json", "$.html").alias("html"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = residue.residue_texts(table(spark, sf_dir, "evidence_blobs"), "id", "text").select(F.lit("evidence_blobs").alias("record_table"), "record_id")
    return texts.unionByName(residue.residue_pages(_snapshots(spark, sf_dir)).select(F.lit("dom_snapshots").alias("record_table"), "record_id"))


def _free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs = table(spark, sf_dir, "evidence_blobs").select(F.lit("evidence_blobs").alias("record_table"), F.col("id").alias("record_id"), "text", F.lit(False).alias("markup"))
    pages = table(spark, sf_dir, "projector_pages").select(F.lit("projector_pages").alias("record_table"), F.col("input_id").cast("string").alias("record_id"), F.col("sanitized_html").alias("text"), F.lit(True).alias("markup"))
    return blobs.unionByName(pages)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.mentions(_free_text(spark, sf_dir), table(spark, sf_dir, "given_names"))


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.redacted(_free_text(spark, sf_dir), table(spark, sf_dir, "given_names"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.repeated_lines(table(spark, sf_dir, "topic_sources")).withColumnRenamed("id", "evidence_block_id")


def p4_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.cleaned(table(spark, sf_dir, "topic_sources")).withColumnRenamed("id", "evidence_block_id")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of both tables that hold page markup."""
    pages = table(spark, sf_dir, "projector_pages").select(F.lit("projector_pages").alias("record_table"), F.col("input_id").cast("string").alias("record_id"), F.col("safe_url").alias("url"), F.col("sanitized_html").alias("html"))
    inputs = table(spark, sf_dir, "extractor_inputs").select(F.lit("extractor_inputs").alias("record_table"), F.col("source_observation_id").alias("record_id"), F.col("safe_url").alias("url"), "html")
    return pages.unionByName(inputs)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_content(_pages(spark, sf_dir))


def p5_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wrapper of each host as an expression."""
    return wrappers.expressions(wrappers.inferred(wrappers.outlined(_pages(spark, sf_dir))))


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_plans"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p6_packing(spark, sf_dir))


def p6_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many containers a source stands twice or more."""
    return packing.repeated_sources(p6_packing(spark, sf_dir), table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.affected(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_documents(table(spark, sf_dir, "documents")).select("doc_id")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.cut_rates(table(spark, sf_dir, "documents"))


def p8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which evidence told how many of the cut texts."""
    return truncation.cut_rules(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_groups, p1_unit_groups, p2_found, p3_found, p3_redacted, p4_found, p4_cleaned, p5_found, p5_wrappers, p6_packing, p6_fill, p6_sources, p7_found, p7_affected, p8_found, p8_rates, p8_rules)}


_HAN = "㐀-䶿一-鿿豈-﫿"
_WORDS = f"list_filter(regexp_split_to_array(regexp_replace(lower(nfc_normalize(text)), '([{_HAN}])', ' \\1 ', 'g'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x != '')"
_WINDOWS = "array_to_string(w[k:k + n - 1], ' ')"


def _PAIRS(texts: str) -> str:
    """Similar pairs p1(a, b) of texts(id, text), counted word by word; f are the texts of enough words."""
    return f"""d AS (SELECT id, {_WORDS} AS w FROM ({texts})), f AS (SELECT id, w, len(w) AS n FROM d WHERE len(w) >= 25),
e AS (SELECT id, n, unnest(w) AS x FROM f), o AS (SELECT id, n, x, row_number() OVER (PARTITION BY id, x) AS k FROM e),
p0 AS (SELECT a.id AS a, b.id AS b, count(*) AS c, a.n + b.n AS n FROM o a JOIN o b ON a.x = b.x AND a.k = b.k AND a.id < b.id AND least(a.n, b.n) >= 0.7 * greatest(a.n, b.n) GROUP BY a.id, b.id, a.n + b.n),
p1 AS (SELECT a, b FROM p0 WHERE c >= 0.7 * (n - c))"""


_CLASSES = "b AS (SELECT a AS x, b AS y FROM p1 UNION SELECT b, a FROM p1), r AS (SELECT DISTINCT x, x AS y FROM b UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x), c AS (SELECT x, min(y) AS class_id FROM r GROUP BY x)"
_ORACLES = {
    "p1_found": f"""
WITH d AS (SELECT DISTINCT id, {_WORDS} AS w FROM evidence_blobs WHERE text IS NOT NULL), f AS (SELECT id, w, len(w) AS n FROM d WHERE len(w) >= 25),
e AS (SELECT id, n, unnest(w) AS x FROM f), o AS (SELECT id, n, x, row_number() OVER (PARTITION BY id, x) AS k FROM e),
p AS (SELECT a.id AS blob_id_a, b.id AS blob_id_b, count(*) AS c, a.n + b.n AS n FROM o a JOIN o b ON a.x = b.x AND a.k = b.k AND a.id < b.id AND least(a.n, b.n) >= 0.7 * greatest(a.n, b.n) GROUP BY a.id, b.id, a.n + b.n)
SELECT blob_id_a, blob_id_b FROM p WHERE c >= 0.7 * (n - c)""",
    "p1_groups": f"""
WITH RECURSIVE {_PAIRS("SELECT DISTINCT id, text FROM evidence_blobs WHERE text IS NOT NULL")},
{_CLASSES}, n AS (SELECT x, count(*) AS links FROM b WHERE x != y GROUP BY x)
SELECT x AS blob_id, class_id, links FROM c JOIN n USING (x)""",
    "p1_unit_groups": f"""
WITH RECURSIVE uo AS (SELECT * FROM unit_observations QUALIFY row_number() OVER (PARTITION BY id ORDER BY observed_at) = 1), eb AS (SELECT id, unnest(evidence_blocks) AS b, generate_subscripts(evidence_blocks, 1) AS k FROM uo), bt AS (SELECT DISTINCT id AS blob, text FROM evidence_blobs),
ut AS (SELECT eb.id, string_agg(text, chr(10) ORDER BY b.ordinal, k) AS text FROM eb JOIN bt ON b.evidence_blob_id = blob GROUP BY eb.id), tk AS (SELECT text, min(id) AS head FROM ut GROUP BY text),
{_PAIRS("SELECT head AS id, text FROM tk")}, hubs AS (SELECT id, 's' || stable_content_fingerprint AS h FROM uo UNION SELECT id, 'r' || raw_fingerprint FROM uo UNION SELECT ut.id, 't' || head FROM ut JOIN tk USING (text) WHERE head IN (SELECT id FROM f)
  UNION SELECT a, 't' || b FROM p1 UNION SELECT b, 't' || a FROM p1), least_of AS (SELECT h, min(id) AS lo FROM hubs GROUP BY h HAVING count(DISTINCT id) > 1), l AS (SELECT DISTINCT id AS a, lo AS b FROM hubs JOIN least_of USING (h)),
b AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l), r AS (SELECT DISTINCT x, x AS y FROM b UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x), c AS (SELECT x, min(y) AS class_id FROM r GROUP BY x)
SELECT x AS unit_observation_id, class_id FROM c""",
    "p4_found": """
WITH r AS (SELECT DISTINCT evidence_block_id, text, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)), ':[0-9]+$', ''), '^www\\.', '') AS site FROM topic_sources WHERE url IS NOT NULL),
n AS (SELECT site, count(*) AS total FROM r GROUP BY site),
s AS (SELECT evidence_block_id, site, string_split(text, chr(10)) AS lines FROM r),
l AS (SELECT evidence_block_id, site, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM s),
k AS (SELECT evidence_block_id, site, line_no::INT AS line_no, regexp_replace(lower(nfc_normalize(line)), '[^\\p{L}]', '', 'g') AS key FROM l),
d AS (SELECT site, key, count(DISTINCT evidence_block_id) AS df FROM k WHERE key != '' GROUP BY ALL)
SELECT evidence_block_id, line_no FROM k JOIN d USING (site, key) JOIN n USING (site) WHERE df >= 5 AND df >= 0.05 * total""",
    "p7_found": f"""
WITH i AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL), iw AS (SELECT item_id, w, least(12, len(w)) AS n FROM i WHERE len(w) > 0),
ik AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM iw), ix AS (SELECT DISTINCT item_id, n, {_WINDOWS} AS win FROM ik),
d AS (SELECT DISTINCT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), dn AS (SELECT doc_id, w, s.n AS n FROM d, (SELECT DISTINCT n FROM ix) s WHERE len(w) >= s.n),
dk AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM dn), dx AS (SELECT DISTINCT doc_id, n, {_WINDOWS} AS win FROM dk)
SELECT DISTINCT doc_id, item_id FROM dx JOIN ix USING (n, win)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
