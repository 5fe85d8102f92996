"""Registered queries of the library's own operators, each beside its SQL.

A query is a function of (spark, folder of tables); its SQL runs on the same
tables and gives the same columns. Queries without SQL fold in order or encode
by dynamic programming; the tests hold them against plain Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scripts as S
from ..functions import text as X
from ..operators import analysis as A
from ..operators import documents as D
from ..operators import encoding as E
from ..operators import morphology as M
from ..operators import recovery as R
from ..operators import vocabulary as V
from ..operators.ranking import number_rows
from ..session import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

VAL_RATIO, SHARD_TOKENS, SLOTS, GUARANTEE = 0.1, 100_000, 1000, 50
WORDS_SQL = r"regexp_extract_all(text, '[^\p{Z}\x09-\x0d\x1c-\x20\x{85}]+')"
SHA_SQL = "sha256(text)"
BYTES_SQL = "octet_length(encode(text))"
#: Word rows, and (token, lang, freq) of words, as common table expressions.
WORD_CTE = f"words AS (SELECT doc_id, lang, source, unnest({WORDS_SQL}) AS token FROM documents)"
LONG_CTE = f"{WORD_CTE}, long AS (SELECT token, lang, count(*) AS freq FROM words GROUP BY ALL)"
CHARS_SQL = "regexp_extract_all({}, '(?s).')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


def _printed(spark: SparkSession, d: str) -> DataFrame:
    return D.fingerprint(_docs(spark, d))


def _split(spark: SparkSession, d: str) -> DataFrame:
    return D.assign_split(_printed(spark, d), VAL_RATIO)


SPLIT_SQL = f"CASE WHEN CAST(CAST('0x' || substr(h, 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0 < {VAL_RATIO} THEN 'val' ELSE 'train' END"
SPLIT_CTE = f"hashed AS (SELECT doc_id, text, lang, source, {SHA_SQL} AS h, {BYTES_SQL} AS raw_bytes FROM documents), split AS (SELECT *, {SPLIT_SQL} AS split FROM hashed)"


# ---- fingerprints, splits, exact duplicates -------------------------------------------------


@query(f"SELECT doc_id, {BYTES_SQL} AS raw_bytes, {SHA_SQL} AS content_sha256 FROM documents")
def doc_fingerprint(spark, d):
    return _printed(spark, d).select("doc_id", "raw_bytes", "content_sha256")


@query(f"WITH {SPLIT_CTE} SELECT doc_id, split FROM split")
def hash_split(spark, d):
    return _split(spark, d).select("doc_id", "split")


@query(f"""WITH {SPLIT_CTE}, firsts AS (SELECT h, min(doc_id) AS doc_id, any_value(split) AS split, max(raw_bytes) AS raw_bytes FROM split GROUP BY h)
SELECT split, count(*) AS documents, CAST(sum(raw_bytes) AS BIGINT) AS bytes, min(doc_id) AS first_doc FROM firsts GROUP BY split""")
def split_summary(spark, d):
    firsts = D.assign_split(D.first_occurrences(_docs(spark, d)), VAL_RATIO)
    return firsts.groupBy("split").agg(F.count("*").alias("documents"), F.sum("raw_bytes").alias("bytes"), F.min("doc_id").alias("first_doc"))


@query(f"SELECT doc_id, CAST('0x' || substr({SHA_SQL}, 57, 8) AS BIGINT) % 10000 = 0 AS selected FROM documents")
def roundtrip_sample(spark, d):
    return _printed(spark, d).select("doc_id", D.roundtrip_selected(F.col("content_sha256")).alias("selected"))


@query(f"SELECT {SHA_SQL} AS content_sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def exact_dedup(spark, d):
    return D.first_occurrences(_docs(spark, d)).select("content_sha256", "doc_id", "copies")


@query(f"""WITH g AS (SELECT {SHA_SQL} AS h, count(*) AS n, max({BYTES_SQL}) AS b, max(len({WORDS_SQL})) + 1 AS t FROM documents GROUP BY 1)
SELECT CAST(sum(n - 1) AS BIGINT) AS exact_duplicates, CAST(sum((n - 1) * b) AS BIGINT) AS duplicate_bytes_skipped, CAST(sum((n - 1) * t) AS BIGINT) AS tokens_avoided FROM g""")
def dup_accounting(spark, d):
    counted = _printed(spark, d).withColumn("t", F.size(X.words("text")) + 1)
    g = counted.groupBy("content_sha256").agg((F.count("*") - 1).alias("m"), F.max("raw_bytes").alias("b"), F.max("t").alias("t"))
    return g.agg(F.sum("m").alias("exact_duplicates"), F.sum(F.col("m") * F.col("b")).alias("duplicate_bytes_skipped"), F.sum(F.col("m") * F.col("t")).alias("tokens_avoided"))


@query(f"WITH {SPLIT_CTE} SELECT h AS content_sha256, count(DISTINCT split) AS splits FROM split GROUP BY h HAVING count(DISTINCT split) > 1")
def split_leakage(spark, d):
    return _split(spark, d).groupBy("content_sha256").agg(F.countDistinct("split").alias("splits")).where("splits > 1")


@query(f"SELECT {SHA_SQL} AS content_sha256, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_groups(spark, d):
    return _printed(spark, d).groupBy("content_sha256").agg(F.count("*").alias("copies")).where("copies > 1")


@query(f"SELECT doc_id, sha256(source || chr(0) || CAST(doc_id AS VARCHAR) || chr(0) || {SHA_SQL}) AS doc_key FROM documents")
def doc_key(spark, d):
    zero = F.lit("\0")
    return _printed(spark, d).select("doc_id", F.sha2(F.concat(F.col("source"), zero, F.col("doc_id").cast("string"), zero, F.col("content_sha256")), 256).alias("doc_key"))


_LABELS = "map_from_entries([x for x in [{'k': 'language', 'v': left(lang, 512)}, {'k': 'source', 'v': left(source, 512)}] if x.v IS NOT NULL])"


@query(f"SELECT doc_id, map_keys(m) AS label_names, map_values(m) AS label_values FROM (SELECT doc_id, {_LABELS} AS m FROM documents)")
def label_projection(spark, d):
    """The labels of every document; a null language or source is left out of its map."""
    made = _docs(spark, d).select("doc_id", D.labels_of({"language": F.col("lang"), "source": F.col("source")}).alias("m"))
    return made.select("doc_id", F.map_keys("m").alias("label_names"), F.map_values("m").alias("label_values"))


# ---- quality --------------------------------------------------------------------------------

_CODE = " OR ".join([f"contains(lower(source), '{p}')" for p in D.CODE_PATHS] + [f"contains(substr(text, 1, 400), '{w}')" for w in D.CODE_WORDS])
QUALITY_CTE = rf"""
base AS (SELECT doc_id, text, lang, source, {BYTES_SQL} AS raw_bytes, ({_CODE}) AS is_code, {WORDS_SQL} AS w FROM documents),
grams AS (SELECT doc_id, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) AS g FROM base WHERE NOT is_code AND len(w) >= 15),
tri AS (SELECT doc_id, max(c) / sum(c) AS share FROM (SELECT doc_id, g, count(*) AS c FROM grams GROUP BY ALL) GROUP BY doc_id),
bytes AS (SELECT doc_id, unnest(regexp_extract_all(substr(hex(encode(text)), 1, 131072), '..')) AS b FROM base),
top AS (SELECT doc_id, max(c) / sum(c) AS share, coalesce(sum(c) FILTER (b = '00'), 0) / sum(c) AS nul FROM (SELECT doc_id, b, count(*) AS c FROM bytes GROUP BY ALL) GROUP BY doc_id),
flags AS (SELECT base.*, len(w) AS word_count, raw_bytes = 0 AS empty,
  CASE WHEN length(text) > 0 AND NOT is_code THEN len(w) < 15 OR raw_bytes < 80 WHEN length(text) > 0 THEN octet_length(encode(regexp_replace(text, '^[ \t\n\r\x0b\f]+|[ \t\n\r\x0b\f]+$', '', 'g'))) < 15 ELSE false END AS short,
  (raw_bytes >= 128 AND coalesce(top.share, 0) >= 0.95) OR coalesce(tri.share, 0) > 0.15 AS extreme_repetition,
  CASE WHEN NOT is_code AND length(text) > 50 THEN length(regexp_replace(text, '[^\p{{L}}\p{{N}}\x{{900}}-\x{{D7F}}]', '', 'g')) / length(text) < 0.40 ELSE false END AS noisy_symbols,
  coalesce(top.nul, 0) > 0.01 AS nul_heavy, raw_bytes >= 8388608 AS extremely_long, text IS NULL AS ambiguous
  FROM base LEFT JOIN tri USING (doc_id) LEFT JOIN top USING (doc_id))"""
DISPOSED_CTE = rf"""{QUALITY_CTE},
marked AS (SELECT *, sha256(text) AS h, CASE WHEN ambiguous THEN 'ambiguous' WHEN empty THEN 'empty' WHEN short THEN 'short' WHEN extreme_repetition THEN 'extreme_repetition' WHEN noisy_symbols THEN 'noisy_symbols' END AS reason FROM flags),
firsts AS (SELECT h, min(doc_id) AS f FROM marked WHERE reason IS NULL GROUP BY h),
disposed AS (SELECT marked.*, CASE WHEN reason IS NOT NULL THEN 'skip' WHEN doc_id > f THEN 'duplicate' ELSE 'unique' END AS disposition FROM marked LEFT JOIN firsts USING (h))"""
FLAG_NAMES = ("is_code", "empty", "short", "nul_heavy", "extreme_repetition", "noisy_symbols", "extremely_long", "ambiguous")


@query(f"WITH {QUALITY_CTE} SELECT doc_id, raw_bytes, word_count, {', '.join(FLAG_NAMES)} FROM flags")
def quality_flags(spark, d):
    return D.quality_flags(_docs(spark, d)).select("doc_id", "raw_bytes", F.col("word_count").cast("long").alias("word_count"), *FLAG_NAMES)


@query(f"WITH {DISPOSED_CTE} SELECT doc_id, reason, disposition FROM disposed")
def disposition(spark, d):
    return D.dispositions(D.quality_flags(_docs(spark, d))).select("doc_id", "reason", "disposition")


@query(f"""WITH {DISPOSED_CTE} SELECT count(*) AS documents_scanned, count(*) FILTER (disposition = 'unique') AS documents_written, count(*) FILTER (disposition = 'duplicate') AS exact_duplicates,
{', '.join(f"count(*) FILTER ({n}) AS {n}_documents" for n in FLAG_NAMES)}, CAST(sum(raw_bytes) AS BIGINT) AS raw_bytes FROM disposed""")
def quality_counters(spark, d):
    rows = D.dispositions(D.quality_flags(_docs(spark, d)))
    return rows.agg(
        F.count("*").alias("documents_scanned"), F.count_if(F.col("disposition") == "unique").alias("documents_written"), F.count_if(F.col("disposition") == "duplicate").alias("exact_duplicates"),
        *[F.count_if(n).alias(f"{n}_documents") for n in FLAG_NAMES], F.sum("raw_bytes").alias("raw_bytes"),
    )


@query(f"""WITH {DISPOSED_CTE} SELECT source, count(*) AS scanned, count(*) FILTER (disposition = 'unique') AS written, CAST(coalesce(sum(word_count + 1) FILTER (disposition = 'unique'), 0) AS BIGINT) AS tokens,
CAST(coalesce(sum(raw_bytes) FILTER (disposition = 'unique'), 0) AS BIGINT) AS bytes, round(coalesce(sum(raw_bytes) FILTER (disposition = 'unique') / sum(word_count + 1) FILTER (disposition = 'unique'), 0), 6) AS bytes_per_token,
list_sort(list(DISTINCT lang)) AS languages FROM disposed GROUP BY source""")
def source_stats(spark, d):
    rows = D.dispositions(D.quality_flags(_docs(spark, d)))
    kept = F.col("disposition") == "unique"
    tokens, size = F.sum(F.when(kept, F.col("word_count") + 1)), F.sum(F.when(kept, F.col("raw_bytes")))
    return rows.groupBy("source").agg(
        F.count("*").alias("scanned"), F.count_if(kept).alias("written"), F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"), F.coalesce(size, F.lit(0)).alias("bytes"),
        F.round(F.coalesce(size / tokens, F.lit(0.0)), 6).alias("bytes_per_token"), F.array_sort(F.collect_set("lang")).alias("languages"),
    )


@query(rf"""WITH base AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
grams AS (SELECT doc_id, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) AS g FROM base WHERE len(w) >= 3)
SELECT doc_id, round(max(c) / sum(c), 6) AS share FROM (SELECT doc_id, g, count(*) AS c FROM grams GROUP BY ALL) GROUP BY doc_id""")
def trigram_repetition(spark, d):
    rows = _docs(spark, d).select("doc_id", F.round(D.trigram_share(X.words("text")), 6).alias("share"))
    return rows.where("share is not null")


# ---- n-grams --------------------------------------------------------------------------------


def _ngram_sql(n: int, least: int) -> str:
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return rf"""WITH base AS (SELECT {WORDS_SQL} AS w FROM documents), g AS (SELECT unnest([{gram} for i in range(1, len(w) - {n - 2})]) AS phrase FROM base WHERE len(w) >= {n})
SELECT phrase, count(*) AS freq FROM g WHERE length(phrase) BETWEEN 4 AND 120 GROUP BY phrase HAVING count(*) >= {least}"""


def _ngrams(n: int, least: int) -> None:
    def run(spark, d):
        return V.ngram_counts(_docs(spark, d), n, least)

    run.__name__ = f"word_ngrams_{n}"
    query(_ngram_sql(n, least))(run)


for _n, _least in ((2, 4), (3, 3), (4, 3), (5, 3)):
    _ngrams(_n, _least)


@query()
def superword_candidates(spark, d):
    docs = _docs(spark, d)
    return V.append_to_vocabulary(V.ngram_counts(docs, 2, 4), V.word_counts(docs, ()), V.FIRST_ID).select("phrase", "freq", F.col("token_id").cast("long").alias("token_id"))


_SQL["superword_candidates"] = f"""WITH {WORD_CTE}, base AS (SELECT {WORDS_SQL} AS w FROM documents), g AS (SELECT unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS phrase FROM base WHERE len(w) >= 2),
c AS (SELECT phrase, count(*) AS freq FROM g WHERE length(phrase) BETWEEN 4 AND 120 GROUP BY phrase HAVING count(*) >= 4)
SELECT phrase, freq, row_number() OVER (ORDER BY freq DESC, length(phrase) DESC, phrase) - 1 + {V.FIRST_ID} AS token_id FROM c WHERE phrase NOT IN (SELECT token FROM words)"""


@query(f"""SELECT doc_id, start_byte FROM (SELECT doc_id, {BYTES_SQL} AS b, CAST(coalesce(sum({BYTES_SQL}) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_byte FROM documents) WHERE start_byte < 500000""")
def bytes_sample_prefix(spark, d):
    """Documents of the corpus head that starts below half a million bytes: a sampling operator."""
    return D.running_sum(_printed(spark, d).select("doc_id", "raw_bytes"), "doc_id", "raw_bytes", "start_byte").where("start_byte < 500000").select("doc_id", "start_byte")


# ---- conversations and fields ---------------------------------------------------------------

_MESSAGE = "'<|message:' || substr(replace(replace(coalesce(role, 'unknown'), chr(10), ' '), '|>', ''), 1, 80) || '|>' || chr(10) || text || chr(10) || '<|end_message|>'"


@query(f"SELECT conv_id, count(*) AS messages, sha256(string_agg({_MESSAGE}, chr(10) ORDER BY turn)) AS text_sha256 FROM conversations GROUP BY conv_id")
def chat_serialize(spark, d):
    return D.chat_text(table(spark, d, "conversations")).select("conv_id", "messages", F.sha2("text", 256).alias("text_sha256"))


@query("SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role")
def chat_stats(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("conversations"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("""WITH p AS (SELECT a.conv_id, a.turn, a.text AS prompt, b.text AS response FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')
SELECT conv_id, turn, CASE WHEN prompt <> '' AND response <> '' THEN sha256('<|field:prompt|>' || chr(10) || prompt || chr(10) || '<|end_field|>' || chr(10) || '<|field:response|>' || chr(10) || response || chr(10) || '<|end_field|>') END AS text_sha256 FROM p""")
def field_pairs(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    answered = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return asked.join(answered, ["conv_id", "turn"]).select("conv_id", "turn", F.sha2(D.paired_fields("prompt", "response"), 256).alias("text_sha256"))


# ---- scripts and token types ----------------------------------------------------------------

_CHAR_CASE = S.sql_case("ch", S.SCRIPT_RULES, "UNKNOWN", lambda p: f"[{p}]")


@query(f"SELECT script, CAST(sum(n) AS BIGINT) AS chars FROM (SELECT {_CHAR_CASE} AS script, n FROM (SELECT ch, count(*) AS n FROM (SELECT unnest({CHARS_SQL.format('text')}) AS ch FROM documents) GROUP BY ch)) GROUP BY script")
def char_script_hist(spark, d):
    chars = _docs(spark, d).select(F.explode(X.characters("text")).alias("ch")).groupBy("ch").agg(F.count("*").alias("n"))
    return chars.withColumn("script", S.char_script(F.col("ch"))).groupBy("script").agg(F.sum("n").alias("chars"))


@query(f"""WITH c AS (SELECT doc_id, unnest({CHARS_SQL.format('text')}) AS ch, generate_subscripts({CHARS_SQL.format('text')}, 1) AS i FROM documents),
s AS (SELECT doc_id, i, {_CHAR_CASE} AS script FROM c), g AS (SELECT doc_id, script, count(*) AS n, min(i) AS f FROM s WHERE script NOT IN ('PUNCTUATION_SPACE', 'NUMERIC', 'UNKNOWN') GROUP BY ALL),
b AS (SELECT doc_id, arg_max(script, n * 1000000000 - f) AS script FROM g GROUP BY doc_id)
SELECT doc_id, coalesce(b.script, 'LATIN') AS script FROM documents LEFT JOIN b USING (doc_id)""")
def doc_script(spark, d):
    """Script of each document, from counts of its distinct characters."""
    chars = _docs(spark, d).select("doc_id", F.posexplode(X.characters("text")).alias("i", "ch")).groupBy("doc_id", "ch").agg(F.count("*").alias("n"), F.min("i").alias("f"))
    scripts = chars.withColumn("script", S.char_script(F.col("ch"))).where(~F.col("script").isin(*S.NEUTRAL)).groupBy("doc_id", "script").agg(F.sum("n").alias("n"), F.min("f").alias("f"))
    best = scripts.groupBy("doc_id").agg(F.max_by("script", F.struct("n", (-F.col("f")).alias("f"))).alias("script"))
    return _docs(spark, d).select("doc_id").join(best, "doc_id", "left").select("doc_id", F.coalesce("script", F.lit(S.DEFAULT_SCRIPT)).alias("script"))


@query(f"WITH {LONG_CTE}, t AS (SELECT token, sum(freq) AS freq FROM long GROUP BY token) SELECT token, CASE WHEN octet_length(encode(token)) = 1 THEN 'RAW_BYTE' ELSE {S.sql_case('token', S.TOKEN_RULES, 'SUBWORD')} END AS token_type FROM t")
def token_type(spark, d):
    return V.word_counts(_docs(spark, d), ()).select("token", S.token_type(F.col("token")).alias("token_type"))


@query(f"WITH {LONG_CTE}, t AS (SELECT token, sum(freq) AS freq FROM long GROUP BY token), s AS (SELECT freq, CASE WHEN octet_length(encode(token)) = 1 THEN 'BYTE' ELSE {S.sql_case('token', S.STRUCTURE_RULES, 'SUBWORD')} END AS kind FROM t) SELECT kind, count(*) AS tokens, CAST(sum(freq) AS BIGINT) AS uses FROM s GROUP BY kind")
def structural_type(spark, d):
    typed = V.word_counts(_docs(spark, d), ()).select("freq", S.structural_type(F.col("token")).alias("kind"))
    return typed.groupBy("kind").agg(F.count("*").alias("tokens"), F.sum("freq").alias("uses"))


@query(f"WITH {WORD_CTE} SELECT " + ", ".join(f"count(*) FILTER (regexp_matches(token, '[{r}]')) AS {k}" for k, r in S.RANGES.items()) + " FROM (SELECT DISTINCT token FROM words)")
def script_range_counts(spark, d):
    tokens = V.word_counts(_docs(spark, d), ())
    return tokens.agg(*[F.count_if(S.has_any(F.col("token"), k)).alias(k) for k in S.RANGES])


@query(f"SELECT doc_id, coalesce(regexp_matches(text, '{S.TABLE_RISK_CLASS}'), false) AS risky FROM documents")
def table_risk(spark, d):
    return _docs(spark, d).select("doc_id", S.table_risk(F.col("text")).alias("risky"))


# ---- language statistics and fairness --------------------------------------------------------

LANG_SQL = f"SELECT lang, count(*) AS documents, CAST(sum({BYTES_SQL}) AS BIGINT) AS bytes, CAST(sum(len({WORDS_SQL})) AS BIGINT) AS words, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang"


def _lang_stats(spark, d):
    return _docs(spark, d).groupBy("lang").agg(F.count("*").alias("documents"), F.sum(X.utf8_bytes("text")).alias("bytes"), F.sum(F.size(X.words("text"))).cast("long").alias("words"), F.sum(F.length("text")).cast("long").alias("chars"))


@query(f"SELECT *, round(bytes / words, 6) AS bytes_per_word, round(chars / words, 6) AS chars_per_word FROM ({LANG_SQL})")
def lang_word_stats(spark, d):
    return _lang_stats(spark, d).withColumns({"bytes_per_word": F.round(F.col("bytes") / F.col("words"), 6), "chars_per_word": F.round(F.col("chars") / F.col("words"), 6)})


@query(f"""WITH v AS (SELECT bytes / words AS v FROM ({LANG_SQL})), r AS (SELECT v, row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n FROM v), m AS (SELECT avg(v) AS mu FROM v)
SELECT round(max(v), 6) AS best, round(min(v), 6) AS worst, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std,
round(stddev_pop(v) / avg(v), 6) AS cv, round(sum((2 * i - n - 1) * v) / (max(n) * sum(v)), 6) AS gini, round(avg(v / mu * ln(v / mu)), 6) AS theil, round(max(v) / min(v), 6) AS max_to_min FROM r, m""")
def fairness_by_lang(spark, d):
    return A.fairness(_lang_stats(spark, d).select((F.col("bytes") / F.col("words")).alias("v")), "v")


@query(f"""SELECT lang, split, count(*) AS documents, CAST(sum(raw_bytes) AS BIGINT) AS bytes, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS lines
FROM (WITH {SPLIT_CTE} SELECT * FROM split) GROUP BY lang, split""")
def provenance_stats(spark, d):
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return _split(spark, d).groupBy("lang", "split").agg(F.count("*").alias("documents"), F.sum("raw_bytes").alias("bytes"), F.sum(F.length("text")).cast("long").alias("chars"), F.sum(lines).cast("long").alias("lines"))


@query(f"""WITH s AS (SELECT lang, source, length(text) AS c, len({WORDS_SQL}) AS w FROM documents)
SELECT lang, source, count(*) AS documents, count(*) FILTER (5 * w < c) AS wins, count(*) FILTER (5 * w > c) AS losses, count(*) FILTER (5 * w = c) AS ties, CAST(sum(c) - 5 * sum(w) AS BIGINT) AS saved FROM s GROUP BY GROUPING SETS ((lang), (source), ())""")
def head_to_head(spark, d):
    """Two token counts a document, five a word against one a character, by language, source and overall."""
    rows = _docs(spark, d).select("lang", "source", F.length("text").alias("c"), F.size(X.words("text")).alias("w"))
    return rows.groupingSets([[F.col("lang")], [F.col("source")], []], "lang", "source").agg(
        F.count("*").alias("documents"),
        F.count_if(5 * F.col("w") < F.col("c")).alias("wins"),
        F.count_if(5 * F.col("w") > F.col("c")).alias("losses"),
        F.count_if(5 * F.col("w") == F.col("c")).alias("ties"),
        (F.sum("c") - 5 * F.sum("w")).cast("long").alias("saved"),
    )


@query(f"""WITH b AS (SELECT source, lang, sum(length(text)) / sum(len({WORDS_SQL})) AS cpw FROM documents GROUP BY source, lang)
SELECT source, round(var_pop(cpw), 6) AS variance, round(avg(cpw), 6) AS mean, count(*) AS groups FROM b GROUP BY source HAVING count(*) > 1""")
def variant_spread(spark, d):
    b = _docs(spark, d).groupBy("source", "lang").agg((F.sum(F.length("text")) / F.sum(F.size(X.words("text")))).alias("cpw"))
    return b.groupBy("source").agg(F.round(F.var_pop("cpw"), 6).alias("variance"), F.round(F.avg("cpw"), 6).alias("mean"), F.count("*").alias("groups")).where("groups > 1")


# ---- vocabulary -----------------------------------------------------------------------------

_TOKEN_TYPE = f"CASE WHEN octet_length(encode(token)) = 1 THEN 'RAW_BYTE' ELSE {S.sql_case('token', S.TOKEN_RULES, 'SUBWORD')} END"
METRICS_CTE = f"""{LONG_CTE}, mass AS (SELECT lang, sum(freq) AS mass FROM long GROUP BY lang),
languages AS (SELECT greatest(count(*), 2) AS n FROM mass),
metrics AS (SELECT token, CAST(sum(freq) AS BIGINT) AS total_freq, count(*) AS n_langs,
  CAST((octet_length(encode(token)) - 1) * sum(freq) AS BIGINT) AS bytes_saved, CAST((length(token) - 1) * sum(freq) AS BIGINT) AS positions_saved,
  CASE WHEN count(*) > 1 THEN (log2(sum(freq)) - sum(freq * log2(freq)) / sum(freq)) / log2((SELECT n FROM languages)) ELSE 0.0 END AS entropy,
  CAST(CASE WHEN length(token) <= 2 AND count(*) > 4 AND {_TOKEN_TYPE} = 'WHOLE_WORD' THEN 0.5 ELSE 0.0 END AS DOUBLE) AS collision_risk
  FROM long GROUP BY token),
weights AS (SELECT lang, pow(mass / (SELECT sum(mass) FROM mass), 1.0 / 2.5) / (mass / (SELECT sum(mass) FROM mass)) AS smooth,
  sqrt((SELECT max(mass) FROM mass) / mass) AS fair FROM mass)"""


def _long(spark, d):
    return V.word_counts(_docs(spark, d))


@query(f"WITH {METRICS_CTE} SELECT token, total_freq, n_langs, bytes_saved, positions_saved, round(entropy, 6) AS entropy, collision_risk FROM metrics")
def candidate_metrics(spark, d):
    return V.candidate_metrics(_long(spark, d)).withColumn("entropy", F.round("entropy", 6))



def _alloc_sql(body: str, order: str = "score DESC, token") -> str:
    return f"WITH {METRICS_CTE}, scored AS ({body}) SELECT token, score, row_number() OVER (ORDER BY {order}) AS rank FROM scored ORDER BY {order} LIMIT {SLOTS}"


def _alloc(letter: str):
    def run(spark, d):
        return V.allocate(_long(spark, d), letter, SLOTS, GUARANTEE).select("token", "score", F.col("rank").cast("long").alias("rank"))

    run.__name__ = f"alloc_{letter}"
    return run


_SCRIPT_CTE = f"""chars AS (SELECT token, unnest({CHARS_SQL.format('token')}) AS ch, generate_subscripts({CHARS_SQL.format('token')}, 1) AS i FROM (SELECT DISTINCT token FROM long)),
counted AS (SELECT token, script, count(*) AS n, min(i) AS f FROM (SELECT token, i, {_CHAR_CASE} AS script FROM chars) WHERE script NOT IN ('PUNCTUATION_SPACE', 'NUMERIC', 'UNKNOWN') GROUP BY ALL),
scripts AS (SELECT token, arg_max(script, n * 1000000 - f) AS script FROM counted GROUP BY token)"""
query(_alloc_sql("SELECT token, CAST(total_freq AS DOUBLE) AS score FROM metrics"))(_alloc("a"))
query(_alloc_sql("SELECT token, round(sum(freq * smooth), 6) AS score FROM long JOIN weights USING (lang) GROUP BY token"))(_alloc("b"))
query(
    f"""WITH {METRICS_CTE}, {_SCRIPT_CTE}, r AS (SELECT m.token, CAST(total_freq AS DOUBLE) AS score, row_number() OVER (PARTITION BY coalesce(s.script, 'LATIN') ORDER BY total_freq DESC, m.token) AS k FROM metrics m LEFT JOIN scripts s USING (token)),
t AS (SELECT token, score, CAST(k > {GUARANTEE} AS INT) AS tier FROM r) SELECT token, score, row_number() OVER (ORDER BY tier, score DESC, token) AS rank FROM t ORDER BY tier, score DESC, token LIMIT {SLOTS}"""
)(_alloc("c"))
query(_alloc_sql("SELECT token, CAST(positions_saved AS DOUBLE) AS score FROM metrics"))(_alloc("d"))
query(
    f"""WITH {METRICS_CTE}, {_SCRIPT_CTE}, u AS (SELECT token, sum(freq * (octet_length(encode(token)) - 1) * fair) AS u FROM long JOIN weights USING (lang) GROUP BY token),
scored AS (SELECT token, round(u * (1 + entropy * 1.2) * (CASE WHEN coalesce(script, 'LATIN') IN ('LATIN', 'PUNCTUATION_SPACE') THEN 1.0 ELSE 1.3 END) * (1 - collision_risk), 6) AS score FROM u JOIN metrics USING (token) LEFT JOIN scripts USING (token))
SELECT token, score, row_number() OVER (ORDER BY score DESC, token) AS rank FROM scored ORDER BY score DESC, token LIMIT {SLOTS}"""
)(_alloc("e"))

ROOTS = ("the", "de", "in", "that", "que")


@query(f"""WITH {METRICS_CTE}, s AS (SELECT token, n_langs, bytes_saved, entropy, lower(trim(token)) AS b, CASE WHEN octet_length(encode(token)) = 1 THEN 'RAW_BYTE' ELSE {S.sql_case('token', S.TOKEN_RULES, 'SUBWORD')} END AS tt FROM metrics),
p AS (SELECT *, b IN {ROOTS} AS is_shared_root, CASE WHEN length(b) <= 2 AND n_langs > 5 AND b NOT IN {ROOTS} AND tt <> 'WHITESPACE_FACTOR' THEN 0.4 ELSE 0.0 END AS cp, bytes_saved * (1 + entropy * 1.5) AS eff FROM s)
SELECT token, n_langs, is_shared_root, CAST(cp AS DOUBLE) AS collision_penalty, round(eff, 4) AS sharing_efficiency, round(eff * (1 - cp), 4) AS net_utility FROM p""")
def sharing_analysis(spark, d):
    found = V.sharing_analysis(V.candidate_metrics(_long(spark, d)), ROOTS)
    return found.withColumns({"sharing_efficiency": F.round("sharing_efficiency", 4), "net_utility": F.round("net_utility", 4)})


@query(f"""WITH {METRICS_CTE}, sources AS (SELECT token, count(DISTINCT source) AS k FROM words GROUP BY token), u AS (SELECT token, sum(greatest(1, octet_length(encode(token)) - 1) * freq * smooth) AS u, sum(freq) AS f FROM long JOIN weights USING (lang) GROUP BY token)
SELECT token, CAST(f AS BIGINT) AS corpus_frequency, k AS consensus_count, round(u * (1.0 + 0.15 * k), 4) AS empirical_utility FROM u JOIN sources USING (token)""")
def utility_smoothed(spark, d):
    """Language-balanced utility of words, with the bonus for the sources that agree."""
    docs = _docs(spark, d)
    long = V.word_counts(docs)
    weights = V.language_weights(long)
    size = F.greatest(F.lit(1), F.octet_length("token") - 1)
    utility = long.join(F.broadcast(weights), "lang").groupBy("token").agg(F.sum(size * F.col("freq") * F.col("smooth")).alias("u"), F.sum("freq").alias("corpus_frequency"))  # a row a language
    sources = V.word_counts(docs, ("source",)).groupBy("token").agg(F.count("*").alias("consensus_count"))
    return utility.join(sources, "token").select("token", "corpus_frequency", "consensus_count", F.round(F.col("u") * (1.0 + 0.15 * F.col("consensus_count")), 4).alias("empirical_utility"))


POOL_CTE = f"{WORD_CTE}, pool AS (SELECT DISTINCT token, lang AS source FROM words)"


def _pool(spark, d):
    return V.word_counts(_docs(spark, d)).select("token", F.col("lang").alias("source"))


@query(f"WITH {POOL_CTE}, s AS (SELECT token, count(*) AS k FROM pool GROUP BY token), h AS (SELECT k, count(*) AS exactly FROM s GROUP BY k) SELECT k, exactly, CAST(sum(exactly) OVER (ORDER BY k DESC) AS BIGINT) AS at_least FROM h")
def consensus_hist(spark, d):
    return V.consensus(_pool(spark, d))


@query(f"""WITH {POOL_CTE}, z AS (SELECT source, count(*) AS n FROM pool GROUP BY source), s AS (SELECT a.source AS a, b.source AS b, count(*) AS shared FROM pool a JOIN pool b USING (token) WHERE a.source <> b.source GROUP BY ALL)
SELECT x.source AS a, y.source AS b, coalesce(shared, 0) AS shared, x.n + y.n - coalesce(shared, 0) AS either, round(coalesce(shared, 0) / (x.n + y.n - coalesce(shared, 0)), 6) AS jaccard FROM z x JOIN z y ON x.source <> y.source LEFT JOIN s ON s.a = x.source AND s.b = y.source""")
def vocab_overlap(spark, d):
    return V.overlap(_pool(spark, d)).withColumn("jaccard", F.round("jaccard", 6))


@query(f"WITH {POOL_CTE} SELECT source, count(*) AS unique_tokens FROM (SELECT token, min(source) AS source FROM pool GROUP BY token HAVING count(*) = 1) GROUP BY source")
def unique_contrib(spark, d):
    return _pool(spark, d).groupBy("token").agg(F.count("*").alias("k"), F.min("source").alias("source")).where("k = 1").groupBy("source").agg(F.count("*").alias("unique_tokens"))


BUDGETS = {"WORD": 200, "SUBWORD": 100, "PUNCTUATION": 50, "ROMANIZED": 100, "NUMBER": 30}
_BUDGET_CASE = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in BUDGETS.items()) + " ELSE 0 END"


@query(f"""WITH {LONG_CTE}, t AS (SELECT token, CAST(sum(freq) AS BIGINT) AS freq, CASE WHEN octet_length(encode(token)) = 1 THEN 'BYTE' ELSE {S.sql_case('token', S.STRUCTURE_RULES, 'SUBWORD')} END AS kind FROM long GROUP BY token),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY freq DESC, octet_length(encode(token)), token) AS k FROM t), m AS (SELECT token, freq, kind, CAST(k > {_BUDGET_CASE} AS INT) AS tier FROM r)
SELECT token, freq, kind, tier, row_number() OVER (ORDER BY tier, freq DESC, octet_length(encode(token)), token) AS rank FROM m ORDER BY tier, freq DESC, octet_length(encode(token)), token LIMIT 800""")
def budget_allocation(spark, d):
    return V.budgeted(V.word_counts(_docs(spark, d), ()), BUDGETS, 800).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {LONG_CTE}, base AS (SELECT {WORDS_SQL} AS w FROM documents), g AS (SELECT unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS token FROM base WHERE len(w) >= 2),
t AS (SELECT token, CAST(sum(freq) AS BIGINT) AS freq FROM long GROUP BY token UNION ALL SELECT token, count(*) FROM g WHERE length(token) BETWEEN 4 AND 120 GROUP BY token)
SELECT token, freq, row_number() OVER (ORDER BY freq DESC, token) - 1 + {V.FIRST_ID} AS token_id FROM t WHERE NOT (contains(trim(token), ' ') AND freq < 4)
AND NOT regexp_matches(token, '[{S.RANGES["cjk_strict"]}]') AND NOT regexp_matches(token, '[{S.RANGES["cyrillic"]}]')""")
def pruned_vocabulary(spark, d):
    """All words, however rare, and the two-word phrases that pruning leaves."""
    docs = _docs(spark, d)
    phrases = V.ngram_counts(docs, 2, 1).select(F.col("phrase").alias("token"), "freq")
    return V.pruned(V.word_counts(docs, ()).unionByName(phrases), 4).withColumn("token_id", F.col("token_id").cast("long"))


@query(f"""WITH {LONG_CTE}, p AS (SELECT token, freq, CASE lang WHEN 'es' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS pool FROM long), b AS (SELECT token, min(pool) AS pool, arg_min(freq, pool) AS freq FROM p GROUP BY token)
SELECT token, pool, row_number() OVER (ORDER BY pool, freq DESC, token) - 1 + {V.FIRST_ID} AS token_id FROM b ORDER BY pool, freq DESC, token LIMIT 3000""")
def merged_pools(spark, d):
    long = _long(spark, d)
    pools = [long.where(F.col("lang") == x).select("token", "freq") for x in ("es", "fr", "de")] + [long.where(~F.col("lang").isin("es", "fr", "de")).select("token", "freq")]
    return V.merge_pools(pools, 3000).withColumn("token_id", F.col("token_id").cast("long"))


@query(f"""WITH {WORD_CTE}, p AS (SELECT DISTINCT token FROM words), c AS (SELECT token AS word, unnest(range(1, length(token))) AS i FROM p), b AS (SELECT word, i FROM c WHERE left(word, i) IN (SELECT token FROM p)),
two AS (SELECT word, [left(word, i), substr(word, i + 1)] AS pieces, i FROM b WHERE substr(word, i + 1) IN (SELECT token FROM p)), d AS (SELECT word, i, unnest(range(i + 1, length(word))) AS j FROM b),
three AS (SELECT word, [left(word, i), substr(word, i + 1, j - i), substr(word, j + 1)] AS pieces, i, j FROM d WHERE substr(word, i + 1, j - i) IN (SELECT token FROM p) AND substr(word, j + 1) IN (SELECT token FROM p))
SELECT word, pieces FROM (SELECT word, pieces FROM two QUALIFY row_number() OVER (PARTITION BY word ORDER BY i) <= 6) UNION ALL SELECT word, pieces FROM (SELECT word, pieces FROM three QUALIFY row_number() OVER (PARTITION BY word ORDER BY i, j) <= 4)""")
def word_splits(spark, d):
    """Splits of every word, of any length, into two and into three words."""
    words = V.word_counts(_docs(spark, d), ()).select("token")
    return V.word_compositions(words.withColumnRenamed("token", "word"), words)


@query(f"WITH {WORD_CTE}, t AS (SELECT DISTINCT token FROM words) SELECT token, hex(encode(replace('▁' || token, '▁', ' '))) AS bytes_hex FROM t")
def spm_pieces(spark, d):
    tokens = V.word_counts(_docs(spark, d), ()).select("token")
    return tokens.select("token", F.hex(V.spm_piece(F.concat(F.lit("▁"), "token"))).alias("bytes_hex"))


# ---- shards ---------------------------------------------------------------------------------

TOKENS_CTE = f"{SPLIT_CTE}, sized AS (SELECT doc_id, split, raw_bytes, len({WORDS_SQL}) + 1 AS n_tokens FROM split), run AS (SELECT *, CAST(coalesce(sum(n_tokens) OVER (PARTITION BY split ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM sized), sharded AS (SELECT *, s // {SHARD_TOKENS} AS shard_id, s - min(s) OVER (PARTITION BY split, s // {SHARD_TOKENS}) AS token_offset FROM run)"


def _sized(spark, d):
    return _split(spark, d).select("doc_id", "split", "raw_bytes", (F.size(X.words("text")) + 1).alias("n_tokens"))


@query(f"WITH {TOKENS_CTE} SELECT doc_id, split, shard_id, token_offset FROM sharded")
def running_offsets(spark, d):
    return D.bucket_shards(_sized(spark, d), SHARD_TOKENS).select("doc_id", "split", "shard_id", "token_offset")


@query(f"WITH {TOKENS_CTE} SELECT split, shard_id, count(*) AS documents, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(raw_bytes) AS BIGINT) AS bytes, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM sharded GROUP BY ALL")
def shard_stats(spark, d):
    rows = D.bucket_shards(_sized(spark, d), SHARD_TOKENS)
    return rows.groupBy("split", "shard_id").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"), F.sum("raw_bytes").alias("bytes"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@query(f"""WITH RECURSIVE {SPLIT_CTE}, sized AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS k, doc_id, split, len({WORDS_SQL}) + 1 AS n FROM split),
step AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS doc_id, '' AS split, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS shard_id, CAST(0 AS BIGINT) AS token_offset, CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS v, CAST(0 AS BIGINT) AS g
UNION ALL SELECT k, doc_id, split, n, g + cut, off, CASE WHEN off + n >= {SHARD_TOKENS} THEN 0 WHEN split = 'val' THEN (1 - cut) * t ELSE off + n END, CASE WHEN off + n >= {SHARD_TOKENS} THEN 0 WHEN split = 'val' THEN off + n ELSE (1 - cut) * v END, g + cut + CAST(off + n >= {SHARD_TOKENS} AS INT)
FROM (SELECT *, (1 - cut) * had AS off FROM (SELECT *, CAST(had > 0 AND had + n > {SHARD_TOKENS} AS INT) AS cut FROM (SELECT z.k, z.doc_id, z.split, z.n, p.t, p.v, p.g, CASE WHEN z.split = 'val' THEN p.v ELSE p.t END AS had FROM step p JOIN sized z ON z.k = p.k + 1))))
SELECT doc_id, split, CAST(n AS INT) AS n_tokens, shard_id, token_offset FROM step WHERE k > 0""")
def shard_packing(spark, d):
    return D.pack_shards(_sized(spark, d), SHARD_TOKENS)


@query(f"WITH {TOKENS_CTE} SELECT split, CAST(max(shard_id) + 1 AS BIGINT) AS next_shard FROM sharded GROUP BY split")
def next_shards(spark, d):
    """Where a build that has written the shards of all documents goes on."""
    return R.next_shards(D.bucket_shards(_sized(spark, d), SHARD_TOKENS), _split(spark, d).select("split"))


@query(f"""WITH h AS (SELECT source, doc_id, {BYTES_SQL} AS b, {SHA_SQL} AS h FROM documents), f AS (SELECT min(doc_id) AS doc_id FROM h GROUP BY h),
a AS (SELECT source, count(*) AS documents, CAST(sum(b) AS BIGINT) AS bytes FROM h GROUP BY source), b AS (SELECT source, count(*) AS documents, CAST(sum(b) AS BIGINT) AS bytes FROM h WHERE doc_id IN (SELECT doc_id FROM f) GROUP BY source),
j AS (SELECT a.source AS source, b.source IS NULL AS gone, a.documents <> b.documents AS d, a.bytes <> b.bytes AS y FROM a LEFT JOIN b ON a.source IS NOT DISTINCT FROM b.source)
SELECT source, 'missing' AS problem FROM j WHERE gone UNION ALL SELECT source, 'documents' FROM j WHERE NOT gone AND d UNION ALL SELECT source, 'bytes' FROM j WHERE NOT gone AND y""")
def record_mismatches(spark, d):
    """Sources whose figures over all documents differ from those without exact copies."""
    totals = lambda rows: rows.groupBy("source").agg(F.count("*").alias("documents"), F.sum("raw_bytes").alias("bytes"))
    printed, firsts = _printed(spark, d), D.first_occurrences(_docs(spark, d)).select("doc_id")
    return R.mismatches(totals(printed), totals(printed.join(firsts, "doc_id", "left_semi")), ("source",))


@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1")
def latest_turns(spark, d):
    """The last turn of each conversation: of records with one key the last stays."""
    return R.latest(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), ("conv_id",), ("turn", "role", "text"))


@query(f"""WITH {TOKENS_CTE} SELECT split, shard_id, token_offset AS valid_from, token_offset + n_tokens - 1 AS valid_to, doc_id FROM sharded WHERE n_tokens > 64""")
def window_spans(spark, d):
    rows = D.bucket_shards(_sized(spark, d), SHARD_TOKENS).where("n_tokens > 64")
    return rows.select("split", "shard_id", F.col("token_offset").alias("valid_from"), (F.col("token_offset") + F.col("n_tokens") - 1).alias("valid_to"), "doc_id")


@query(f"""WITH sized AS (SELECT doc_id, len({WORDS_SQL}) + 1 AS n FROM documents), spans AS (SELECT doc_id, CAST(sum(n) OVER (ORDER BY doc_id) - n AS BIGINT) AS first, CAST(sum(n) OVER (ORDER BY doc_id) - 1 AS BIGINT) AS last FROM sized),
p AS (SELECT CAST(max(last) + 1 AS HUGEINT) AS n FROM spans), g AS (SELECT i, (CAST(xor(i, 42) AS UHUGEINT) + 11400714819323198485) % 18446744073709551616 AS z FROM range(200) t(i)),
a AS (SELECT i, (xor(z, z >> 30) * 13787848793156543929) % 18446744073709551616 AS z FROM g), b AS (SELECT i, (xor(z, z >> 27) * 10723151780598845931) % 18446744073709551616 AS z FROM a), c AS (SELECT i, xor(z, z >> 31) AS z FROM b),
drawn AS (SELECT i, CAST(z % CAST(n AS UHUGEINT) AS BIGINT) AS draw FROM c, p) SELECT i, draw, doc_id, draw - first AS position FROM drawn JOIN spans ON draw BETWEEN first AND last""")
def window_sample_lookup(spark, d):
    """Two hundred deterministic draws of token positions and the documents they fall in."""
    sized = _docs(spark, d).select("doc_id", (F.size(X.words("text")) + 1).alias("n"))
    spans = D.running_sum(sized, "doc_id", "n", "first").select("doc_id", "first", (F.col("first") + F.col("n") - 1).alias("last"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    found = A.locate(A.draws(spark, 200, 42, total), spans, 1 << 14)
    return found.select("i", "draw", "doc_id", (F.col("draw") - F.col("first")).alias("position"))


# ---- token frequencies ----------------------------------------------------------------------

COUNT_CTE = f'{WORD_CTE}, counts AS (SELECT token, count(*) AS "count" FROM words GROUP BY token)'
RANK_CTE = f'{COUNT_CTE}, ranked AS (SELECT *, row_number() OVER (ORDER BY "count" DESC, token) - 1 AS rank FROM counts)'


def _counts(spark, d):
    return V.word_counts(_docs(spark, d), ()).withColumnRenamed("freq", "count")


@query(f'WITH {COUNT_CTE} SELECT count(*) FILTER ("count" = 1) AS seen_once, count(*) FILTER ("count" < 10) AS seen_less_than_10, count(*) FILTER ("count" < 100) AS seen_less_than_100, count(*) FILTER ("count" < 1000) AS seen_less_than_1000, count(*) AS seen FROM counts')
def freq_bands(spark, d):
    return _counts(spark, d).agg(F.count_if(F.col("count") == 1).alias("seen_once"), *[F.count_if(F.col("count") < n).alias(f"seen_less_than_{n}") for n in (10, 100, 1000)], F.count("*").alias("seen"))


@query(f'WITH {COUNT_CTE} SELECT token, "count" FROM counts ORDER BY "count" DESC, token LIMIT 50')
def top_tokens(spark, d):
    return _counts(spark, d).orderBy(F.desc("count"), "token").limit(50)


@query(f"WITH {RANK_CTE} SELECT token, rank FROM ranked")
def freq_permutation(spark, d):
    return A.frequency_ranks(_counts(spark, d)).select("token", "rank")


@query(f"""WITH {RANK_CTE}, c AS (SELECT CASE WHEN rank < 16384 THEN 'head' WHEN rank < 131072 THEN 'tail0' WHEN rank < 524288 THEN 'tail1' ELSE 'tail2' END AS cluster, "count" FROM ranked) SELECT cluster, count(*) AS tokens, CAST(sum("count") AS BIGINT) AS mass FROM c GROUP BY cluster""")
def cluster_mass(spark, d):
    ranked = A.frequency_ranks(_counts(spark, d)).withColumn("cluster", A.band(F.col("rank"), A.CLUSTERS, "tail2"))
    return ranked.groupBy("cluster").agg(F.count("*").alias("tokens"), F.sum("count").alias("mass"))


@query(f"""WITH {RANK_CTE}, c AS (SELECT CASE WHEN rank < 1000 THEN 'top_1k' WHEN rank < 10000 THEN 'top_10k' WHEN rank < 100000 THEN 'top_100k' WHEN rank < 500000 THEN 'top_500k' ELSE 'rest' END AS band, "count", octet_length(encode(token)) AS b FROM ranked) SELECT band, count(*) AS tokens, CAST(sum("count") AS BIGINT) AS uses, round(avg(b), 6) AS mean_bytes FROM c GROUP BY band""")
def freq_band_eval(spark, d):
    ranked = A.frequency_ranks(_counts(spark, d)).withColumn("band", A.band(F.col("rank"), A.FREQUENCY_BANDS, "rest"))
    return ranked.groupBy("band").agg(F.count("*").alias("tokens"), F.sum("count").alias("uses"), F.round(F.avg(F.octet_length("token")), 6).alias("mean_bytes"))


@query(f'WITH {RANK_CTE} SELECT count(*) FILTER (rank > 65535) AS ids_over, CAST(sum("count") FILTER (rank > 65535) AS BIGINT) AS uses_over, count(*) AS ids FROM ranked')
def uint16_audit(spark, d):
    over = F.col("rank") > 65535
    return A.frequency_ranks(_counts(spark, d)).agg(F.count_if(over).alias("ids_over"), F.sum(F.when(over, F.col("count"))).alias("uses_over"), F.count("*").alias("ids"))


@query(f'WITH {COUNT_CTE}, t AS (SELECT sum("count") AS t FROM counts) SELECT token, "count", round(-log2(("count" + 1.0) / (t + 50000)), 6) AS bits FROM counts, t')
def entropy_table(spark, d):
    return A.entropy_table(_counts(spark, d), 50000)


@query(f'WITH {COUNT_CTE}, t AS (SELECT sum("count") AS t FROM counts) SELECT round(4.0 * sum("count" * -log2(("count" + 1.0) / (t + 50000))) / sum("count"), 4) AS threshold FROM counts, t')
def entropy_threshold(spark, d):
    table_ = A.entropy_table(_counts(spark, d), 50000)
    return table_.agg(F.round(4.0 * F.sum(F.col("count") * F.col("bits")) / F.sum("count"), 4).alias("threshold"))


@query(f"WITH b AS (SELECT doc_id, len({WORDS_SQL}) AS n FROM documents) SELECT doc_id, CAST(ceil(n / 4) AS BIGINT) AS patches, CAST(n AS BIGINT) AS tokens, round(CASE WHEN n > 0 THEN n / ceil(n / 4) ELSE 0 END, 6) AS tokens_per_patch FROM b")
def fixed_patches(spark, d):
    n = F.size(X.words("text"))
    rows = _docs(spark, d).select("doc_id", F.ceil(n / 4).alias("patches"), n.cast("long").alias("tokens"))
    return rows.withColumn("tokens_per_patch", F.round(F.when(F.col("tokens") > 0, F.col("tokens") / F.col("patches")).otherwise(0.0), 6))


@query(f"""WITH p AS (SELECT doc_id, unnest({WORDS_SQL}) AS token, generate_subscripts({WORDS_SQL}, 1) AS pos FROM documents), m AS (SELECT doc_id, pos, min(pos) OVER (PARTITION BY doc_id, token) AS f FROM p)
SELECT doc_id, count(*) AS tokens, count(*) FILTER (f <= pos - 32) AS repeated FROM m GROUP BY doc_id""")
def repeat_mask(spark, d):
    rows = _docs(spark, d).select("doc_id", F.posexplode(X.words("text")).alias("pos", "token"))
    first = rows.groupBy("doc_id", "token").agg(F.min("pos").alias("f"), F.collect_list("pos").alias("all"))
    kept = first.select("doc_id", F.size("all").alias("n"), F.size(F.filter("all", lambda p: p >= F.col("f") + 32)).alias("r"))
    return kept.groupBy("doc_id").agg(F.sum("n").alias("tokens"), F.sum("r").alias("repeated"))


@query()
def entropy_patch_lengths(spark, d):
    """Causal entropy patches of every document over its words: count, longest, tokens."""
    bits = A.entropy_table(_counts(spark, d), 50000).select("token", "bits")
    rows = _docs(spark, d).select("doc_id", F.posexplode(X.words("text")).alias("pos", "token")).join(bits, "token")
    run = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "bits"))).alias("r"))
    lengths = run.select("doc_id", A.entropy_patches(F.col("r"), F.transform("r", lambda x: x["bits"]), 40.0).alias("l"))
    return lengths.select("doc_id", F.size("l").alias("patches"), F.array_max("l").alias("longest"), F.aggregate("l", F.lit(0), lambda a, x: a + x).alias("tokens"))


# ---- totals and samples --------------------------------------------------------------------


@query(f"""WITH {RANK_CTE}, d AS (SELECT count(*) AS documents, CAST(sum({BYTES_SQL}) AS BIGINT) AS bytes FROM documents), t AS (SELECT CAST(sum("count") AS BIGINT) AS tokens, count(*) AS unique_ids, min(rank) AS min_id, max(rank) AS max_id FROM ranked)
SELECT documents, bytes, tokens, unique_ids, min_id, max_id, round(bytes / tokens, 6) AS bytes_per_token, round(tokens / documents, 6) AS tokens_per_document, round(tokens / (bytes / 1048576.0), 4) AS tokens_per_mb FROM d, t""")
def global_stats(spark, d):
    """Totals of the corpus over words, whose ids are their ranks by frequency."""
    docs = _docs(spark, d).agg(F.count("*").alias("documents"), F.sum(X.utf8_bytes("text")).alias("bytes"))
    ids = A.frequency_ranks(_counts(spark, d)).agg(F.sum("count").alias("tokens"), F.count("*").alias("unique_ids"), F.min("rank").alias("min_id"), F.max("rank").alias("max_id"))
    both = docs.join(F.broadcast(ids))  # one row each
    return both.withColumns({
        "bytes_per_token": F.round(F.col("bytes") / F.col("tokens"), 6), "tokens_per_document": F.round(F.col("tokens") / F.col("documents"), 6),
        "tokens_per_mb": F.round(F.col("tokens") / (F.col("bytes") / 1048576.0), 4),
    })


@query("""WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS total FROM documents)
SELECT doc_id, k FROM n WHERE k IN (SELECT least(total - 1, CAST(floor(i * total / 64.0) AS BIGINT)) FROM n, range(64) t(i))""")
def slot_sample(spark, d):
    """Documents at 64 evenly spread places of the corpus, wherever it ends: a sampling operator."""
    numbered = number_rows(_docs(spark, d).select("doc_id"), "k", F.col("doc_id").asc_nulls_last())
    total = numbered.count()
    places = sorted({min(total - 1, i * total // 64) for i in range(64)}) if total else []
    return numbered.where(F.col("k").isin(places))


@query(f"""SELECT source, doc_id, k FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS k FROM documents) WHERE k <= 64""")
def source_sample(spark, d):
    """The first 64 documents of every source in the order of a hash of the id: a sampling operator."""
    hashed = _docs(spark, d).select("source", "doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    order = Window.partitionBy("source").orderBy("h", "doc_id")  # only the first rows of each task go to the window
    return hashed.withColumn("k", F.row_number().over(order)).where("k <= 64").select("source", "doc_id", F.col("k").cast("long").alias("k"))


_CATEGORIES = (
    ("URL_OR_NUMBER", r"^\p{Nd}+([.,]\p{Nd}+)*$|http"), ("CODE", r"[{}();=<>]"), ("MATH", "[∑∫√≠≤≥±πλ]"), ("CJK", r"[\x{4E00}-\x{9FFF}]"), ("KANA", r"[\x{3040}-\x{30FF}]"),
    ("HANGUL", r"[\x{AC00}-\x{D7AF}]"), ("ARABIC", r"[\x{600}-\x{6FF}]"), ("INDIC", r"[\x{900}-\x{D7F}]"), ("CYRILLIC_GREEK", r"[\x{370}-\x{52F}]"), ("ACCENTED", r"^\p{L}*[^\x00-\x7F]\p{L}*$"), ("PLAIN", r"^[A-Za-z]+$"),
)


@query(f"""WITH {COUNT_CTE}, c AS (SELECT token, "count", {S.sql_case('token', _CATEGORIES, 'OTHER')} AS category FROM counts)
SELECT category, token, "count", k FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY "count" DESC, token) AS k FROM c) WHERE k <= 5""")
def categorised_examples(spark, d):
    """The five most frequent words of each category; the first category that fits counts."""
    named = F.lit("OTHER")
    for name, pattern in reversed(_CATEGORIES):
        named = F.when(F.col("token").rlike(pattern), name).otherwise(named)
    order = Window.partitionBy("category").orderBy(F.desc("count"), "token")
    ranked = _counts(spark, d).withColumn("category", named).withColumn("k", F.row_number().over(order).cast("long"))
    return ranked.where("k <= 5").select("category", "token", "count", "k")


@query(f"""WITH {LONG_CTE}, t AS (SELECT token, sum(freq) AS f FROM long GROUP BY token), m AS (SELECT sum(f) AS n FROM t), b AS (SELECT lang, octet_length(encode(token)) * freq AS bytes, freq, -log2((f + 1.0) / (n + 50000)) AS bits FROM long JOIN t USING (token), m)
SELECT lang, round(sum(freq * bits) / sum(bytes), 6) AS bits_per_byte FROM b GROUP BY lang""")
def bits_per_byte(spark, d):
    """Bits a byte of each language's words under the smoothed unigram model of the corpus."""
    bits = A.entropy_table(_counts(spark, d), 50000).select("token", "bits")
    rows = _long(spark, d).join(bits, "token")
    exact = F.sum(F.col("freq") * F.col("bits")) / F.sum(F.octet_length("token") * F.col("freq"))
    return rows.groupBy("lang").agg(F.round(exact, 6).alias("bits_per_byte"))


@query(f"WITH {RANK_CTE} SELECT rank AS token_id, CAST(octet_length(encode(token)) AS BIGINT) AS n_bytes FROM ranked UNION ALL SELECT -1 - i, 0 FROM range(3) t(i)")
def byte_lengths(spark, d):
    """Bytes of the token of each id; special ids, here below zero, have none."""
    ranked = A.frequency_ranks(_counts(spark, d)).select(F.col("rank").alias("token_id"), F.octet_length("token").cast("long").alias("n_bytes"))
    return ranked.unionByName(spark.range(3).select((-1 - F.col("id")).alias("token_id"), F.lit(0).cast("long").alias("n_bytes")))


@query(f"""WITH {WORD_CTE}, base AS (SELECT token, row_number() OVER (ORDER BY token) - 1 + {V.FIRST_ID} AS token_id FROM (SELECT DISTINCT token FROM words WHERE lang = 'en')),
o AS (SELECT token, min(doc_id) AS o FROM words GROUP BY token HAVING token NOT IN (SELECT token FROM base))
SELECT hex(encode(token)) AS bytes_hex, token_id FROM base UNION ALL SELECT hex(encode(token)), (SELECT max(token_id) FROM base) + row_number() OVER (ORDER BY o, encode(token)) FROM o""")
def vocabulary_insertion(spark, d):
    """English words, numbered, then the others in the order of the documents that bring them."""
    of = lambda rows: rows.select("doc_id", F.explode(X.words("text")).alias("token")).select("doc_id", F.encode("token", "utf-8").alias("token_bytes"))
    docs = _docs(spark, d)
    english = of(docs.where("lang = 'en'")).select("token_bytes").distinct()
    base = number_rows(english, "token_id", F.asc("token_bytes")).withColumn("token_id", F.col("token_id") + V.FIRST_ID)
    found = V.inserted(base, of(docs).withColumnRenamed("doc_id", "order"))
    return found.select(F.hex("token_bytes").alias("bytes_hex"), "token_id")


_SWEEP = f"SELECT lang AS name, bytes / words AS macro_bpt, chars / words AS worst_bpt, 1.0 / documents AS gini, 2.0 * (words * 128 + 128 * 4096) / 1000000.0 AS params_m, bytes / 1048576.0 AS thru_mb_s FROM ({LANG_SQL})"


@query(f"""WITH c AS ({_SWEEP}), s AS (SELECT name, macro_bpt * 0.5 + worst_bpt * 0.5 - gini * 2.0 AS a, macro_bpt / 10.0 + worst_bpt / 5.0 - gini * 1.5 - params_m / 1000.0 * 0.15 + thru_mb_s / 10.0 * 0.1 AS b FROM c)
SELECT 'compression' AS ranking, arg_max(name, a) AS winner, round(max(a), 6) AS score FROM s UNION ALL SELECT 'end_to_end', arg_max(name, b), round(max(b), 6) FROM s""")
def sweep_winners(spark, d):
    """The best candidate by compression alone and with the costs of a model; languages stand for candidates."""
    c = _lang_stats(spark, d).selectExpr(
        "lang AS name", "bytes / words AS macro_bpt", "chars / words AS worst_bpt", "1D / documents AS gini", "2D * (words * 128 + 128 * 4096) / 1000000D AS params_m", "bytes / 1048576D AS thru_mb_s"
    )
    return A.sweep_winners(c)


# ---- selection over small tables ------------------------------------------------------------

_PARETO = "SELECT lang AS name, round(bytes / words, 6) AS macro_bpt, round(chars / words, 6) AS worst_bpt, round(bytes / chars, 6) AS overall_bpt, round(words / documents, 6) AS lm_quality, round(100.0 * words / bytes, 6) AS utilization, documents AS vocab_size, round(words / 1000.0, 6) AS throughput, round(1.0 / documents, 6) AS rare_fraction, lang <> 'xx' AS lossless"


def _candidates(spark, d):
    return _lang_stats(spark, d).selectExpr(
        "lang AS name", "round(bytes / words, 6) AS macro_bpt", "round(chars / words, 6) AS worst_bpt", "round(bytes / chars, 6) AS overall_bpt", "round(words / documents, 6) AS lm_quality",
        "round(100.0D * words / bytes, 6) AS utilization", "documents AS vocab_size", "round(words / 1000.0D, 6) AS throughput", "round(1.0D / documents, 6) AS rare_fraction", "lang <> 'xx' AS lossless",
    )


@query(f"""WITH c AS ({_PARETO} FROM ({LANG_SQL})), t AS (SELECT max(macro_bpt) m1, max(worst_bpt) m2, max(overall_bpt) m3, max(lm_quality) m4, max(utilization) m5, max(throughput) m6, max(vocab_size) m7 FROM c)
SELECT name, round(0.20 * macro_bpt / m1 + 0.20 * worst_bpt / m2 + 0.15 * overall_bpt / m3 + 0.15 * lm_quality / m4 + 0.10 * utilization / m5 + 0.08 * throughput / m6 + 0.07 * (1 - vocab_size / (2 * m7)) + 0.05 * (1 - rare_fraction), 6) AS score,
NOT EXISTS (SELECT 1 FROM c o WHERE o.name <> c.name AND o.macro_bpt >= c.macro_bpt AND o.worst_bpt >= c.worst_bpt AND o.vocab_size <= c.vocab_size AND o.throughput >= c.throughput AND (o.macro_bpt > c.macro_bpt OR o.worst_bpt > c.worst_bpt OR o.vocab_size < c.vocab_size)) AS on_frontier FROM c, t""")
def pareto_frontier(spark, d):
    return A.pareto(_candidates(spark, d))


@query("""WITH s(vocab_size) AS (VALUES (96000), (128000), (256000), (512000), (1000000), (1551017))
SELECT vocab_size, r AS representation, round(p / 1e6, 6) AS params_m, round(p * 2 / 1048576, 6) AS mem_mb FROM (
SELECT vocab_size, 'dense' AS r, CAST(2.0 * vocab_size * 4096 AS DOUBLE) AS p FROM s UNION ALL SELECT vocab_size, 'lexical_projection', CAST(2.0 * (vocab_size * 128 + 128 * 4096) AS DOUBLE) FROM s
UNION ALL SELECT vocab_size, 'cluster_offset', CAST((1024 * 128 + vocab_size * 16 + 128 * 4096) + (4096 * 128 + 128 * vocab_size) AS DOUBLE) FROM s UNION ALL SELECT vocab_size, 'large_in_compact_out', CAST((vocab_size * 128 + 128 * 4096) + CAST(65536 AS BIGINT) * 4096 AS DOUBLE) FROM s)""")
def rep_costs(spark, d):
    return A.representation_costs(spark.createDataFrame([(n,) for n in (96000, 128000, 256000, 512000, 1000000, 1551017)], "vocab_size int"))


@query(f"""WITH t AS (SELECT sum({BYTES_SQL}) / sum(len({WORDS_SQL}) + 1) AS bpt FROM documents), s(tb) AS (VALUES (1), (10), (20)), e AS (SELECT tb, CAST(floor(tb * 1000000000000 / bpt) AS BIGINT) AS n FROM s, t)
SELECT tb, n AS estimated_tokens, n * 4 AS estimated_uint32_bytes, CAST(ceil(CAST(n AS DOUBLE) * 21 / 8) AS BIGINT) AS estimated_packed21_bytes FROM e""")
def projection(spark, d):
    t = _docs(spark, d).agg((F.sum(X.utf8_bytes("text")) / F.sum(F.size(X.words("text")) + 1)).alias("bpt"))
    sizes = spark.createDataFrame([(1,), (10,), (20,)], "tb int")
    n = F.floor(F.col("tb").cast("double") * 1000000000000 / F.col("bpt"))
    rows = sizes.join(F.broadcast(t)).select("tb", n.alias("estimated_tokens"))  # one row beside three
    return rows.withColumns({"estimated_uint32_bytes": F.col("estimated_tokens") * 4, "estimated_packed21_bytes": F.ceil(F.col("estimated_tokens").cast("double") * 21 / 8)})


@query(f"SELECT lang, quantile_cont(CAST({BYTES_SQL} AS DOUBLE), 0.5) AS p50, round(quantile_cont(CAST({BYTES_SQL} AS DOUBLE), 0.95), 6) AS p95 FROM documents GROUP BY lang")
def percentiles(spark, d):
    b = X.utf8_bytes("text").cast("double")
    return _docs(spark, d).groupBy("lang").agg(F.percentile(b, F.lit(0.5)).alias("p50"), F.round(F.percentile(b, F.lit(0.95)), 6).alias("p95"))


@query(f"""WITH {WORD_CTE}, a AS (SELECT DISTINCT token FROM words WHERE lang = 'en'), b AS (SELECT DISTINCT token FROM words WHERE lang = 'de')
SELECT 'union' AS op, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS n UNION ALL SELECT 'intersect', (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) UNION ALL SELECT 'except', (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b))""")
def set_operations(spark, d):
    long = _long(spark, d)
    a, b = long.where("lang = 'en'").select("token"), long.where("lang = 'de'").select("token")
    named = lambda df, op: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return named(a.union(b).distinct(), "union").unionByName(named(a.intersect(b), "intersect")).unionByName(named(a.subtract(b), "except"))


# ---- morphology -----------------------------------------------------------------------------

_AFFIX_VALUES = ", ".join("('{}', '{}', '{}', '{}', {})".format(f, k, a.replace("'", "''"), r, n) for f, k, a, r, n in M.AFFIXES)
_FAMILY_CASE = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in M.FAMILY_OF.items()) + " END"


@query(f"""WITH {WORD_CTE}, w AS (SELECT DISTINCT token AS word, {_FAMILY_CASE} AS family FROM words), a(family, kind, affix, rest, least) AS (VALUES {_AFFIX_VALUES}),
f AS (SELECT word, kind, affix, rest, kind IN ('PREFIX', 'CLITIC') AS front FROM w JOIN a USING (family) WHERE length(word) > 2 AND length(word) >= length(affix) + least AND CASE WHEN kind IN ('PREFIX', 'CLITIC') THEN starts_with(lower(word), affix) ELSE ends_with(lower(word), affix) END),
u AS (SELECT word, affix AS unit, kind FROM f UNION ALL SELECT word, CASE WHEN front THEN substr(word, length(affix) + 1) ELSE left(word, length(word) - length(affix)) END, rest FROM f UNION ALL SELECT word, word, 'ROOT' FROM w WHERE length(word) <= 2)
SELECT unit, kind, count(*) AS uses FROM u GROUP BY ALL""")
def morphology_affixes(spark, d):
    family = F.create_map(*[F.lit(x) for kv in M.FAMILY_OF.items() for x in kv])[F.col("lang")]
    words = _long(spark, d).select(F.col("token").alias("word"), family.alias("family")).distinct()
    return M.affix_candidates(words, M.affix_table(spark)).groupBy("unit", "kind").agg(F.count("*").alias("uses"))


@query("SELECT DISTINCT lower(r || e) AS word FROM (VALUES " + ", ".join(f"('{r}')" for r in M.VERB_ROOTS) + ") a(r), (VALUES " + ", ".join(f"('{e}')" for e in M.VERB_ENDINGS) + ") b(e)")
def verb_lexicon(spark, d):
    return M.verb_lexicon(spark)


@query(f"WITH {WORD_CTE}, w AS (SELECT DISTINCT token FROM words) SELECT DISTINCT t AS token FROM (SELECT unnest([token, ' ' || token]) AS t FROM w)")
def space_prefix(spark, d):
    return M.spaced(V.word_counts(_docs(spark, d), ()).withColumnRenamed("token", "word"))


@query(f"""WITH {LONG_CTE}, v AS (SELECT token, lang FROM long), e AS (SELECT DISTINCT token FROM v WHERE lang = 'en') SELECT v.lang, count(*) AS words, count(*) FILTER (e.token IS NOT NULL) AS overlapping, count(*) FILTER (e.token IS NULL) AS new_words FROM v LEFT JOIN e USING (token) WHERE v.lang <> 'en' GROUP BY v.lang""")
def language_audit(spark, d):
    """Words of each language that the English vocabulary has or lacks."""
    v = _pool(spark, d)
    known = v.where("source = 'en'").select("token", F.lit(True).alias("known"))
    rows = v.where("source <> 'en'").join(known, "token", "left")
    return rows.groupBy(F.col("source").alias("lang")).agg(F.count("*").alias("words"), F.count_if(F.col("known").isNotNull()).alias("overlapping"), F.count_if(F.col("known").isNull()).alias("new_words"))


# ---- tokenizers ------------------------------------------------------------------------------


@query()
def pretokenize(spark, d):
    """Chunks of every document and whether they give the text again."""
    chunks = _docs(spark, d).select("doc_id", "text", X.pretokens("text").alias("chunks"))
    return chunks.select("doc_id", F.size("chunks").alias("n_chunks"), (F.array_join("chunks", "") == F.col("text")).alias("lossless"))


def _vocabulary(spark, d, slots: int = 4000) -> DataFrame:
    """The candidates that save most bytes, numbered: a vocabulary of ``slots`` rows, mined once."""
    mined = V.mined_candidates(_docs(spark, d)).groupBy("token").agg(F.sum("freq").alias("freq"))
    scored = mined.where(F.octet_length("token") > 1).withColumn("score", F.col("freq") * (F.octet_length("token") - 1))
    rows = V.top(scored, slots, F.desc("score"), F.asc("token")).select("token", (F.col("rank") - 1 + V.FIRST_ID).alias("token_id")).collect()
    return spark.createDataFrame(rows, "token string, token_id int")


def _encoding(mode: str) -> None:
    def run(spark, d):
        coded = E.encode(_docs(spark, d), _vocabulary(spark, d), mode)
        return coded.select("doc_id", F.size("ids").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"))

    run.__name__ = f"encode_{mode}"
    query()(run)


for _mode in E.MODES:
    _encoding(_mode)


@query()
def decode_roundtrip(spark, d):
    vocabulary = _vocabulary(spark, d)
    coded = E.encode(_docs(spark, d), vocabulary)
    return coded.select("doc_id", F.size("ids").alias("n_tokens"), (E.decode(F.col("ids"), vocabulary) == F.col("text")).alias("lossless"))


@query()
def encode_stats(spark, d):
    """Bytes, words, tokens and byte fallback by language."""
    coded = E.encode(_docs(spark, d), _vocabulary(spark, d))
    rows = coded.select("lang", X.utf8_bytes("text").alias("b"), F.size(X.words("text")).alias("w"), F.size("ids").alias("t"), F.size(F.filter("ids", lambda i: i < 256)).alias("f"))
    return rows.groupBy("lang").agg(F.round(F.sum("b") / F.sum("t"), 6).alias("bytes_per_token"), F.round(F.sum("t") / F.sum("w"), 6).alias("tokens_per_word"), F.round(100 * F.sum("f") / F.sum("t"), 6).alias("fallback_percent"))


@query()
def minimal_vs_bounded(spark, d):
    """Documents with fewer, equal or other tokens when chunks don't bound the search."""
    vocabulary, docs = _vocabulary(spark, d), _docs(spark, d)
    once = E.encode(docs, vocabulary, "bounded").withColumnRenamed("ids", "a")
    both = E.encode(once, vocabulary, "minimal").select("a", F.col("ids").alias("b"))
    same = F.size("a") == F.size("b")
    return both.agg(F.count_if(F.size("b") < F.size("a")).alias("fewer"), F.count_if(F.col("a") == F.col("b")).alias("identical"), F.count_if(same & (F.col("a") != F.col("b"))).alias("same_count_different"), F.count_if(F.size("b") > F.size("a")).alias("more"))


def _model_counts(spark, d, models: tuple[str, ...]) -> DataFrame:
    """(sample, area, model, tokens, bytes, lines) of all documents under several encoders, encoded in one pass."""
    vocabulary, rows = _vocabulary(spark, d), _docs(spark, d)
    for m in models:
        rows = E.encode(rows, vocabulary, m).withColumn(m, F.size("ids")).drop("ids")
    mixed = sum((S.has_any(F.col("text"), k).cast("int") for k in ("cyrillic", "cjk_strict")), F.col("text").rlike("[A-Za-z]").cast("int")) > 1
    area = F.when(mixed, "mixed scripts").otherwise(F.coalesce("lang", F.lit("unknown")))
    lines = F.size(F.split("text", "\n"))
    per_model = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("tokens")) for m in models])).alias("m")
    return rows.select(F.col("doc_id").alias("sample"), area.alias("area"), X.utf8_bytes("text").alias("bytes"), lines.alias("lines"), per_model).select("sample", "area", "bytes", "lines", "m.*")


@query()
def encoder_audit(spark, d):
    """Tokens, bytes a token and tokens a line of each encoder by language, and over texts of mixed scripts."""
    return A.audit_matrix(_model_counts(spark, d, ("bounded", "greedy", "minimal")))


@query()
def encoder_regressions(spark, d):
    """By the better of two encoders: documents, those on which the greedy one takes over a tenth more tokens, and the worst excess."""
    counts = _model_counts(spark, d, ("bounded", "greedy", "minimal"))
    compared = A.regressions(counts, "greedy", ("bounded", "minimal"), 0.0)
    worse = F.count_if(F.col("tokens") > F.col("best_tokens") * 1.10)
    return compared.groupBy("best_model").agg(F.count("*").alias("samples"), worse.alias("regressed"), F.round(F.max("regression_percent"), 6).alias("worst_percent"))


@query()
def coverage_by_language(spark, d):
    """Whole and fragmented words by language: each distinct word is encoded once, behind a space."""
    vocabulary = _vocabulary(spark, d)
    words = _long(spark, d).select("lang", "freq", F.concat(F.lit(" "), "token").alias("text"))
    coded = E.encode(words, vocabulary, "bounded")
    return A.coverage(coded.select("lang", "freq", E.pieces(F.col("ids"), vocabulary).alias("pieces")))


@query()
def pack21(spark, d):
    coded = E.encode(_docs(spark, d), _vocabulary(spark, d)).select("doc_id", "ids", E.packed21("ids").alias("packed"))
    return coded.select("doc_id", F.size("ids").alias("n_tokens"), F.octet_length("packed").alias("packed_bytes"), E.unpacks_to("packed", "ids").alias("reversible"))


@query()
def minhash_near_dup(spark, d):
    docs = D.quality_flags(_docs(spark, d)).where(D.skip_reason().isNull()).select("doc_id", "text", "is_code")
    return D.near_duplicates(docs)


@query("SELECT doc_id, item_id FROM documents JOIN benchmark ON contains(documents.text, benchmark.text)")
def contamination_substring(spark, d):
    """Documents that hold a benchmark passage; candidates share the passage's first five words."""
    passages = table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"), X.words("text").alias("pw"))
    n = 5
    keyed = passages.where(F.size("pw") > n).select("item_id", "passage", F.concat_ws(" ", F.slice("pw", 2, n - 1)).alias("key"))
    short = passages.where(F.size("pw") <= n).select("item_id", "passage")
    docs = _docs(spark, d).select("doc_id", "text")
    grams = docs.select("doc_id", F.explode(F.array_distinct(X.ngrams(X.words("text"), n - 1))).alias("key"))
    hits = grams.join(keyed, "key").select("doc_id", "item_id", "passage").distinct()
    found = hits.join(docs, "doc_id").where(F.contains("text", "passage")).select("doc_id", "item_id")
    if short.isEmpty():
        return found
    return found.unionByName(docs.join(short, F.contains("text", "passage")).select("doc_id", "item_id"))
