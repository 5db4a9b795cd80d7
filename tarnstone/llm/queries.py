"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_chunks, entropy_difference, extendible, host_reputation, line_templates, minhash_forest, packing, phrase_fingerprints, quality_forest, rank_profiles

URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: Share of good pages that a host should surely reach (lower bound), and bytes of a shard (small, as the test tables are).
LEAST_GOOD, SHARD_BYTES = 0.8, 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The quality label of the document that a page shows; its id is the number behind the language in the path."""
    shown = F.try_to_number(F.regexp_extract("url", "/[a-z]+/([0-9]{1,18})", 1), F.lit("9" * 18)).cast("long")
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("good"))
    return pages.select(host_reputation.host_of(F.col("url")).alias("host"), shown.alias("doc_id")).join(good, "doc_id").select("host", "good")


def op1_host_reputation(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return host_reputation.filter_urls(pages, page_outcomes(pages, table(spark, sf_dir, "labels")), URL_RULES, least_good=LEAST_GOOD, bound="lower")


def op2_phrase_fingerprints(spark, sf_dir):
    return phrase_fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op8_minhash_forest(spark, sf_dir):
    return minhash_forest.jaccard_groups(table(spark, sf_dir, "documents")).drop("row", "group")


def op3_bpe_chunks(spark, sf_dir):
    return bpe_chunks.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_quality_forest(spark, sf_dir):
    return quality_forest.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("n_lines", "n_upper", "n_marks", "n_distinct", "threshold")


def op5_entropy_difference(spark, sf_dir):
    return entropy_difference.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_templates(spark, sf_dir):
    rows = line_templates.drop_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_rank_profiles(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    profiles = rank_profiles.fit(docs.where(~rank_profiles.held_out(F.col("doc_id"))))
    return rank_profiles.identify(docs, profiles).withColumn("held_out", rank_profiles.held_out(F.col("doc_id")))


def op10_extendible(spark, sf_dir):
    return extendible.shard(table(spark, sf_dir, "documents"), SHARD_BYTES)


def queries():
    return {f.__name__: f for f in (op1_host_reputation, op2_phrase_fingerprints, op8_minhash_forest, op3_bpe_chunks, op4_quality_forest, op5_entropy_difference, op6_line_templates, op7_packing, op9_rank_profiles, op10_extendible)}


_MEAN = "(k.good + k.prior * k.s) / (k.n + k.s)"
_LEVEL = """, {name}_g AS (SELECT {name} AS key, {up_cols} sum(n) AS n, sum(good) AS good FROM own GROUP BY {name} {up_group})
, {name}_p AS (SELECT g.*, {prior} AS prior FROM {name}_g g {join})
, {name}_s AS (SELECT round(1 / least(0.5, greatest(0.005, CASE WHEN sum(n * (n - 1)) > 0
    THEN (sum((good - n * prior) * (good - n * prior) / (prior * (1 - prior))) - sum(n)) / sum(n * (n - 1)) ELSE 0.5 END)) - 1, 6) AS s FROM {name}_p)
, {name}_m AS (SELECT k.key, k.n, s.s, (k.good + k.prior * s.s) / (k.n + s.s) AS mean FROM {name}_p k, {name}_s s)
, {name} AS (SELECT key, mean, greatest(0.0, mean - 1.64 * sqrt(mean * (1 - mean) / (n + s + 1))) AS bound FROM {name}_m)"""
_DOMAIN = "array_to_string(list_slice(string_split({h}, '.'), greatest(1, len(string_split({h}, '.')) - {back}), len(string_split({h}, '.'))), '.')"


def _host_sql() -> str:
    two = _DOMAIN.format(h="host", back=1)
    long = ", ".join(f"'{x}'" for x in host_reputation.LONG_SUFFIXES)
    parts = f"CASE WHEN {two} IN ({long}) THEN {_DOMAIN.format(h='host', back=2)} ELSE {two} END AS domain, CASE WHEN {two} IN ({long}) THEN {two} ELSE {_DOMAIN.format(h='host', back=0)} END AS suffix"
    rules = sorted(URL_RULES, key=lambda r: -len(r[1]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')", a, r) for a, r in rules for h, _, p in [r.partition("/")]]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, _, r in fits) + " END"
    action = "CASE " + " ".join(f"WHEN {c} THEN '{a}'" for c, a, _ in fits) + " END"
    url = r"'^(?s:.*?)://([^/?#]*)([^?#]*)'"
    levels = _LEVEL.format(name="suffix", up_cols="", up_group="", prior="(SELECT (coalesce(sum(good), 0) + 1.0) / (coalesce(sum(n), 0) + 2) FROM own)", join="")
    levels += _LEVEL.format(name="domain", up_cols="suffix,", up_group=", suffix", prior="u.mean", join="JOIN suffix u ON u.key = g.suffix")
    levels += _LEVEL.format(name="host", up_cols="domain,", up_group=", domain", prior="u.mean", join="JOIN domain u ON u.key = g.domain")
    return f"""WITH seen AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, {url}, 1), ''), '{host_reputation.UPPER}', '{host_reputation.LOWER}') AS host,
  coalesce(regexp_extract(url, {url}, 2), '') AS path FROM pages)
, named AS (SELECT *, {parts} FROM seen)
, good AS (SELECT doc_id, min(quality) AS good FROM labels GROUP BY doc_id)
, own AS (SELECT host, domain, suffix, count(*) AS n, sum(g.good) AS good FROM named JOIN good g
  ON g.doc_id = try_cast(regexp_extract(url, '/[a-z]+/([0-9]{{1,18}})', 1) AS BIGINT) WHERE g.good IS NOT NULL GROUP BY ALL)
{levels}
SELECT page_id, n.host, path, {rule.replace('host', 'n.host')} AS rule,
  coalesce({action.replace('host', 'n.host')}, CASE WHEN coalesce(h.bound, d.bound, s.bound, 1.0) < {LEAST_GOOD} THEN 'block' ELSE 'allow' END) AS verdict,
  round(coalesce(h.bound, d.bound, s.bound, 1.0), 6) AS bound
FROM named n LEFT JOIN host h ON h.key = n.host LEFT JOIN domain d ON d.key = n.domain LEFT JOIN suffix s ON s.key = n.suffix"""


def _shard_sql() -> str:
    return f"""WITH h AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h,
  CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes FROM documents)
, n AS (SELECT d, h >> (60 - d)::INT AS p, sum(bytes) AS b FROM h, range(0, 40) t(d) GROUP BY ALL)
, leaf AS (SELECT n.d, n.p FROM n LEFT JOIN n u ON u.d = n.d - 1 AND u.p = n.p >> 1 WHERE n.b <= {SHARD_BYTES} AND (n.d = 0 OR u.b > {SHARD_BYTES}))
SELECT doc_id, bytes, CAST(d AS BIGINT) AS depth, CAST(p AS BIGINT) AS prefix, CAST(0 AS BIGINT) AS overflow FROM h JOIN leaf ON h.h >> (60 - leaf.d)::INT = leaf.p"""


def oracle_sql():
    return {"op1_host_reputation": _host_sql(), "op10_extendible": _shard_sql()}
