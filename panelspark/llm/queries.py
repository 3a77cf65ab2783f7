"""One query for each corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25, decontam, langid, maglev, neardup, orc_tokens, packing, quality, urlfilter, warc
from .common import bucket_of_id

END_ID = 2

OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha1(payload) AS h FROM p),
bits AS (SELECT *, list_aggregate(list_transform(range(1, 41), lambda k: lpad(bin(strpos('0123456789abcdef', h[k]) - 1), 4, '0')), 'string_agg', '') AS b FROM d),
k AS (SELECT page_id, payload_bytes, max(page_id) OVER (PARTITION BY h) AS keeper,
  list_aggregate(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(
    16 * CAST(b[5 * k + 1] AS INTEGER) + 8 * CAST(b[5 * k + 2] AS INTEGER) + 4 * CAST(b[5 * k + 3] AS INTEGER) + 2 * CAST(b[5 * k + 4] AS INTEGER) + CAST(b[5 * k + 5] AS INTEGER) AS BIGINT) + 1]), 'string_agg', '') AS payload_digest FROM bits)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM k
"""

OP7_SQL = """
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, coalesce(rest, '') AS rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw FROM cut),
u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(rule, rule_host, rule_path, verdict) AS (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
  ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
met AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict FROM u JOIN rules
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN met USING (page_id)
"""


def op4_sql() -> str:
    """The slots as a list; the table is filled by turns, which SQL can't express in reasonable space."""
    table = maglev.lookup_table(SHARDS)
    return f"""
WITH slots AS (SELECT [{", ".join(map(str, table))}] AS held),
d AS (SELECT doc_id, source, CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15)) AS BIGINT) % {len(table)} AS slot FROM documents)
SELECT doc_id, source, slot, 'shard-' || lpad(CAST(held[slot + 1] AS VARCHAR), 3, '0') AS shard FROM d, slots
"""


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
runs AS (
  SELECT DISTINCT item_id, len(run) AS k, array_to_string(run, ' ') AS run FROM (
    SELECT item_id, w[i + 1 : i + 13] AS run FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS i FROM b WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT k FROM runs),
places AS (SELECT doc_id, k, w, unnest(range(0, len(w) - k + 1)) AS i FROM d, sizes WHERE len(w) >= k),
found AS (SELECT a.doc_id, r.item_id, a.i, a.k FROM (SELECT doc_id, k, i, array_to_string(w[i + 1 : i + k], ' ') AS run FROM places) a JOIN runs r ON a.k = r.k AND a.run = r.run),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id),
u AS (SELECT item_id, len(w) + 8 AS reach, len(list_distinct(w)) AS k, unnest(list_distinct(w)) AS word FROM b WHERE len(w) > 0),
ev AS (SELECT doc_id, p, item_id, reach, k, u.word FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d) JOIN u USING (word)),
able AS (SELECT doc_id, item_id FROM ev GROUP BY doc_id, item_id, k HAVING count(DISTINCT word) = k),
few AS (SELECT ev.* FROM ev JOIN able USING (doc_id, item_id)),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM (SELECT e.doc_id, e.item_id FROM few e JOIN few c ON c.doc_id = e.doc_id AND c.item_id = e.item_id AND c.p <= e.p AND c.p > e.p - e.reach
  GROUP BY e.doc_id, e.item_id, e.p, e.k HAVING count(DISTINCT c.word) = e.k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_tokens.token_orc(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)


def op2_block_max_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return bm25.search(documents, documents.filter("doc_id % 50 = 0"), k=10)


def fitted_languages(documents: DataFrame) -> langid.LanguageModel:
    """Learned from documents whose crc32(doc_id) mod 5 isn't 0."""
    return langid.fit(documents.filter(bucket_of_id("doc_id", 5) != 0))


def op3_nearest_centroid_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    found = langid.predict(documents.select("doc_id", "text"), fitted_languages(documents))
    return found.select("doc_id", F.coalesce(bucket_of_id("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


SHARDS = [f"shard-{k:03d}" for k in range(64)]


def op4_maglev_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maglev.place(_table(spark, sf_dir, "documents"), "doc_id", SHARDS).select("doc_id", "source", "slot", "shard")


def op5_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, _table(spark, sf_dir, "pages"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return packing.pack(pieces)


URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op7_url_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"), urlfilter.rule_table(spark, URL_RULES))


def op8_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("tie")


def fitted_quality(documents: DataFrame, labels: DataFrame) -> quality.RuleEnsemble:
    """Learned from labels whose crc32(doc_id) mod 3 isn't 1."""
    return quality.fit(documents, labels.filter(bucket_of_id("doc_id", 3) != 1))


def op10_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = fitted_quality(documents, _table(spark, sf_dir, "labels"))
    found = quality.scored(documents.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(bucket_of_id("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op9_chosen_path_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_orc": op1_token_orc,
        "op2_block_max_bm25": op2_block_max_bm25,
        "op3_nearest_centroid_lang": op3_nearest_centroid_lang,
        "op4_maglev_sharding": op4_maglev_sharding,
        "op5_dictionary_warc": op5_dictionary_warc,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_url_expressions": op7_url_expressions,
        "op8_positional_decontamination": op8_positional_decontamination,
        "op9_chosen_path_near_dedup": op9_chosen_path_near_dedup,
        "op10_rule_ensemble_quality": op10_rule_ensemble_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_maglev_sharding": op4_sql(),
        "op5_dictionary_warc": OP5_SQL,
        "op7_url_expressions": OP7_SQL,
        "op8_positional_decontamination": OP8_SQL,
    }
