"""Readers of vocabulary files: (token_id, token_bytes) rows whatever the format.

Every reader goes through Spark. A file of one JSON object is one row while it is
taken apart, as such files hold a vocabulary and not a corpus. Lines and entries
that hold no token are left out; an id below ``first_id`` is a reserved byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.vocabulary import BYTE_TOKENS, spm_piece

#: Bytes that byte-level BPE files write as themselves; the others follow from U+0100 on.
_SHOWN = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))


def byte_letters(piece: Column) -> Column:
    """Bytes of a byte-level BPE entry; characters that stand for no byte are dropped."""
    hidden = [b for b in range(256) if b not in _SHOWN]
    pairs = [(chr(b), b) for b in _SHOWN] + [(chr(256 + k), b) for k, b in enumerate(hidden)]
    names = F.create_map(*[F.lit(v) for letter, b in pairs for v in (letter, f"{b:02X}")])
    return F.unhex(F.array_join(F.transform(X.characters(piece), lambda c: F.try_element_at(names, c)), ""))


def read_own(spark: SparkSession, path: str, first_id: int = BYTE_TOKENS) -> DataFrame:
    """What ``write_vocabulary`` has written, also gzipped."""
    rows = spark.read.schema("token_id long, bytes_hex string").json(path)
    return _tokens(rows.select("token_id", F.unhex("bytes_hex").alias("token_bytes")), first_id)


def read_token_list(spark: SparkSession, path: str, first_id: int = BYTE_TOKENS) -> DataFrame:
    """A JSON object with ``tokens``: objects of ``id`` and ``bytes_hex``; plain or gzipped."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "tokens array<struct<id:long,bytes_hex:string>>").alias("v"))
    items = rows.select(F.explode("v.tokens").alias("t"))
    return _tokens(items.select(F.col("t.id").alias("token_id"), F.unhex("t.bytes_hex").alias("token_bytes")), first_id)


def read_byte_bpe(spark: SparkSession, path: str) -> DataFrame:
    """The ``model.vocab`` of a tokenizer JSON file with byte-level pieces."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "model struct<vocab:map<string,long>>").alias("v"))
    items = rows.select(F.explode("v.model.vocab").alias("piece", "token_id"))
    return _tokens(items.select("token_id", byte_letters(F.col("piece")).alias("token_bytes")), 0)


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a base64 token and its rank."""
    parts = spark.read.text(path).select(F.split("value", " ").alias("p")).where(F.size("p") == 2)
    return _tokens(parts.select(F.expr("try_cast(p[1] AS bigint)").alias("token_id"), F.expr("try_to_binary(p[0], 'base64')").alias("token_bytes")), 0)


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """Sentence pieces, a line each and perhaps a tab and a score behind; the id is the line's number."""
    rows = _numbered(spark, path).select("token_id", F.split("value", "\t")[0].alias("piece"))
    return _tokens(rows.select("token_id", spm_piece(F.col("piece")).alias("token_bytes")), 0)


def read_word_pieces(spark: SparkSession, path: str) -> DataFrame:
    """Word pieces, a line each; the id is the line's number. ``##`` marks one that goes on a word, others start with a space."""
    rows = _numbered(spark, path)
    text = F.when(F.col("value").startswith("##"), F.expr("substring(value, 3)")).otherwise(F.concat(F.lit(" "), "value"))
    return _tokens(rows.where("value <> ''").select("token_id", F.encode(text, "utf-8").alias("token_bytes")), 0)


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("token_id", "value"))
    return lines.select(F.col("token_id").cast("long").alias("token_id"), "value")


def _tokens(rows: DataFrame, first_id: int) -> DataFrame:
    """Sound rows; of ids with the same bytes the least stays."""
    sound = rows.where((F.octet_length("token_bytes") > 0) & (F.col("token_id") >= first_id))
    return sound.groupBy("token_bytes").agg(F.min("token_id").alias("token_id")).select("token_id", "token_bytes")
