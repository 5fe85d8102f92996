"""Sinks: token shards, packed binaries, manifests, vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.encoding import packed21


def write_shards(tokens: DataFrame, path: str) -> None:
    """Token rows (split, shard_id, doc_id, ids) as zstd Parquet, a folder a shard."""
    tokens.repartition("split", "shard_id").sortWithinPartitions("split", "shard_id", "doc_id").write.mode("overwrite").partitionBy("split", "shard_id").option("compression", "zstd").parquet(path)


def shard_records(tokens: DataFrame) -> DataFrame:
    """Tokens, documents, least and largest id and a content digest of each shard.

    The digest is the hash of the sorted hashes of its documents' ids, so it needs
    no order among tasks.
    """
    per_doc = tokens.select("split", "shard_id", F.size("ids").alias("n"), F.array_min("ids").alias("lo"), F.array_max("ids").alias("hi"), F.xxhash64("doc_id", "ids").alias("h"))
    return per_doc.groupBy("split", "shard_id").agg(
        F.sum("n").alias("token_count"), F.count("*").alias("source_document_count"), F.min("lo").alias("min_token_id"), F.max("hi").alias("max_token_id"),
        F.sum((F.col("h") % 1_000_000_007)).alias("digest"),
    )


def verify_shards(path: str, records: DataFrame) -> DataFrame:
    """Shards whose written rows differ from their records; none if all is well."""
    written = shard_records(records.sparkSession.read.parquet(path)).withColumn("split", F.col("split").cast("string"))
    columns = [c for c in records.columns if c not in ("split", "shard_id")]
    a, b = records.alias("a"), written.alias("b")
    joined = a.join(b, (F.col("a.split") == F.col("b.split")) & (F.col("a.shard_id") == F.col("b.shard_id")), "full_outer")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return joined.where(~same).select(F.coalesce("a.split", "b.split").alias("split"), F.coalesce("a.shard_id", "b.shard_id").alias("shard_id"))


def write_packed21(tokens: DataFrame, path: str) -> None:
    """Ids at 21 bits each, with their count to unpack them."""
    tokens.select("doc_id", F.size("ids").alias("n_tokens"), packed21("ids").alias("packed")).write.mode("overwrite").parquet(path)


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """Vocabulary rows as gzipped JSON lines: id, bytes in hex, text."""
    rows = vocabulary.select("token_id", F.hex(F.encode("token", "utf-8")).alias("bytes_hex"), F.col("token").alias("str"))
    rows.write.mode("overwrite").option("compression", "gzip").json(path)


def write_manifest(summary: DataFrame, path: str) -> None:
    """A small summary as JSON, committed as a whole."""
    summary.coalesce(1).write.mode("overwrite").json(path)
