"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import ann, bpe, html_extract, langid, media, packing, quality, simhash, toxicity, urlfilter
from .common import fold

#: Vocabulary file of the public byte-level tokenizer, installed on every machine.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


#: Thresholds of the two classifiers.
TOXIC, GOOD = 0.5, 0.3


def _held_out(folds: int, held: int):
    return fold(F.col("doc_id"), folds) == held


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~_held_out(5, 0))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", _held_out(5, 0).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "worst_sentence", "worst_score", "n_sentences")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~_held_out(5, 0))
    return quality.score(docs, model).select("doc_id", _held_out(5, 0).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~_held_out(4, 2))
    return langid.predict(docs, model).select("doc_id", _held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary_path())


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_media(table(spark, sf_dir, "documents"), with_keyframes=True)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_quality": op2_quality,
        "op3_simhash": op3_simhash,
        "op4_language": op4_language,
        "op5_packing": op5_packing,
        "op6_html": op6_html,
        "op7_nearest": op7_nearest,
        "op8_bpe": op8_bpe,
        "op9_media": op9_media,
        "op10_url_filter": op10_url_filter,
    }


def _url_sql() -> str:
    """The rules as a CASE, the vocabulary as patterns with boundaries."""
    rules = sorted(urlfilter.RULES, key=lambda r: (-len(r[1]), r[1]))
    fits = {}
    for _, rule in rules:
        host, slash, tail = rule.partition("/")
        fits[rule] = f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{tail}'))"
    rule_case = " ".join(f"WHEN {fits[r]} THEN '{r}'" for _, r in rules)
    act_case = " ".join(f"WHEN rule = '{r}' THEN '{a}'" for a, r in rules)
    near = lambda term: f"regexp_matches(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"
    strict = " OR ".join(near(t) for t in urlfilter.STRICT_TERMS)
    soft = " + ".join(f"CAST({near(t)} AS INT)" for t in urlfilter.SOFT_TERMS)
    return f"""
WITH parts AS (
  SELECT page_id, url,
    coalesce(CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END, '') AS host,
    coalesce(CASE WHEN contains(url, '://') THEN regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) END, '') AS path
  FROM pages),
ruled AS (SELECT *, CASE {rule_case} END AS rule FROM parts)
SELECT page_id, host, path, rule,
  CASE {act_case} WHEN {strict} THEN 'block' WHEN {soft} >= {urlfilter.SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""


def oracle_sql() -> dict[str, str]:
    return {"op10_url_filter": _url_sql()}
