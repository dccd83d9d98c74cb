"""Queries of the training-data operators, over whole tables, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiteloom.llm import addresses, encodings, history, leakage, markup, mixing, reading_level, residue, truncation
from kiteloom.plans.runtime import load

MARKUP_FIELDS = [("feed_items", "item_id", "summary"), ("articles", "seq", "body"), ("articles", "seq", "subtitle")]
ENCODING_FIELDS = [("articles", "seq", "title"), ("page_meta", "page_id", "title"), ("feed_items", "item_id", "summary")]
TRUNCATION_FIELDS = [("articles", "seq", "subtitle"), ("feed_items", "item_id", "summary")]
#: Longer texts that a cut value may begin like.
PARTNER_FIELDS = [("articles", "seq", "body"), ("page_meta", "page_id", "subtitle")]
RESIDUE_FIELDS = [("articles", "seq", "body"), ("page_meta", "page_id", "subtitle")]
CASE = ["tab", "rec_id", "field"]


def _parts(spark: SparkSession, sf_dir: str, fields: list[tuple[str, str, str]]) -> list[tuple[str, DataFrame, str, str]]:
    return [(tab, load(spark, sf_dir, tab), key, column) for tab, key, column in fields]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.marked_values(_parts(spark, sf_dir, MARKUP_FIELDS))


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.cleaned_values(_parts(spark, sf_dir, MARKUP_FIELDS))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encodings.garbled_values(_parts(spark, sf_dir, ENCODING_FIELDS)).select(*CASE)


def p2_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encodings.garbled_values(_parts(spark, sf_dir, ENCODING_FIELDS))


def _truncations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_verdicts(_parts(spark, sf_dir, TRUNCATION_FIELDS), partners=_parts(spark, sf_dir, PARTNER_FIELDS))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truncations(spark, sf_dir).filter("cut").select(*CASE)


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_rates(_truncations(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = addresses.address_copies(load(spark, sf_dir, "feed_items"), "item_id", "link").withColumn("tab", F.lit("feed_items"))
    stored = addresses.address_copies(load(spark, sf_dir, "articles"), "seq", "url").withColumn("tab", F.lit("articles"))
    return feed.unionByName(stored).select("tab", "first_id", "copy_id")


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = addresses.copy_counts(load(spark, sf_dir, "feed_items"), "item_id", "link").withColumn("tab", F.lit("feed_items"))
    stored = addresses.copy_counts(load(spark, sf_dir, "articles"), "seq", "url").withColumn("tab", F.lit("articles"))
    return feed.unionByName(stored).select("tab", "first_id", "n_copies", "collided")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.repeated_articles(load(spark, sf_dir, "articles"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.scored_residue(_parts(spark, sf_dir, RESIDUE_FIELDS)).filter("excluded").select(*CASE)


def p7_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.scored_residue(_parts(spark, sf_dir, RESIDUE_FIELDS))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leak_report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_blocks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_shares(p9_mix(spark, sf_dir), load(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_level.reading_levels(load(spark, sf_dir, "documents"), load(spark, sf_dir, "reading_labels")).select("doc_id", "band")


def p10_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents")
    return reading_level.level_profile(reading_level.reading_levels(documents, load(spark, sf_dir, "reading_labels")), documents)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        p1_found, p1_clean, p2_found, p2_restored, p4_found, p4_rates, p5_found, p5_counts, p6_found, p7_found, p7_scores,
        p8_found, p8_report, p9_mix, p9_shares, p10_found, p10_profile,
    ]
    return {f.__name__: f for f in named}


_LEAKS = r"""
WITH w AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL),
     e AS (SELECT CAST(item_id AS BIGINT) AS item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM eval_items WHERE text IS NOT NULL),
     dg AS (SELECT doc_id, array_to_string(ws[i:i+11], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 10)) AS i FROM w WHERE len(ws) >= 12)),
     eg AS (SELECT DISTINCT item_id, array_to_string(ws[i:i+11], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 10)) AS i FROM e WHERE len(ws) >= 12)),
     leaks AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g))
"""

_ADDRESSES = r"""
WITH raw AS (
  SELECT 'feed_items' AS tab, CAST(item_id AS BIGINT) AS id, link AS u FROM feed_items
  UNION ALL SELECT 'articles', CAST(seq AS BIGINT), url FROM articles),
t0 AS (SELECT tab, id, replace(replace(regexp_replace(coalesce(u, ''), '[\s\p{Z}\p{C}]+', '', 'g'), '&amp;', '&'), '&#38;', '&') AS t FROM raw),
t1 AS (SELECT tab, id, split_part(t, '#', 1) AS t FROM t0),
t2 AS (SELECT tab, id, split_part(t, '?', 1) AS path, CASE WHEN contains(t, '?') THEN substr(t, length(split_part(t, '?', 1)) + 2) ELSE '' END AS q FROM t1),
t3 AS (
  SELECT tab, id, regexp_replace(lower(url_decode(path)), '[^\p{L}\p{M}\p{N}]+', '', 'g') AS path,
    list_sort(list_filter(list_transform(regexp_split_to_array(q, '[&;?]'), lambda f:
      CASE WHEN regexp_matches(lower(split_part(f, '=', 1)), '^(utm_.*|source|ref|fbclid|gclid)$') THEN ''
           ELSE regexp_replace(lower(url_decode(split_part(f, '=', 1))), '[^\p{L}\p{M}\p{N}]+', '', 'g') || '=' ||
                regexp_replace(lower(url_decode(substr(f, length(split_part(f, '=', 1)) + 2))), '[^\p{L}\p{M}\p{N}]+', '', 'g') END),
      lambda f: f NOT IN ('', '='))) AS fields FROM t2),
keyed AS (SELECT tab, id, concat_ws('&', path, nullif(array_to_string(fields, '&'), '')) AS canon FROM t3),
grouped AS (SELECT tab, id, canon, min(id) OVER (PARTITION BY tab, canon) AS first_id FROM keyed WHERE canon <> '')
"""


def oracles() -> dict[str, str]:
    return {
        "p8_found": _LEAKS + "SELECT doc_id, item_id FROM leaks",
        "p8_report": _LEAKS + "SELECT CAST(i.item_id AS BIGINT) AS item_id, i.kind, count(l.doc_id) AS n_docs FROM eval_items i LEFT JOIN leaks l USING (item_id) GROUP BY 1, 2",
        "p5_found": _ADDRESSES + "SELECT DISTINCT tab, first_id, id AS copy_id FROM grouped WHERE id > first_id",
        "p5_counts": _ADDRESSES + "SELECT tab, first_id, count(*) AS n_copies, false AS collided FROM grouped GROUP BY tab, canon, first_id",
    }
