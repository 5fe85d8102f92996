"""Sources of mixed files and the document rows they give.

Every reader goes through Spark, so any store that Spark reads will do.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators.documents import chat_text, extract_text, labels_of

#: Fixed value: names of text fields in the order of their priority.
TEXT_FIELDS = ("messages", "text", "content", "body", "prompt", "response", "question", "answer")
TEXT_KINDS = (".txt", ".md", ".txt.gz")
SUPPORTED = (*TEXT_KINDS, ".jsonl", ".jsonl.gz", ".json", ".csv", ".tsv", ".parquet")
BINARY_KINDS = (".bin", ".zip", ".tar", ".gz", ".zst", ".7z", ".rar", ".exe", ".so", ".png", ".jpg", ".jpeg", ".gif", ".mp4", ".mp3", ".npy", ".pt")
SNIFF_BYTES, NUL_SHARE, CONTROL_SHARE = 64 << 10, 0.001, 0.20


def extension(name: Column) -> Column:
    """Lower-case extension; compound for gzipped text and JSON lines."""
    return F.regexp_extract(F.lower(name), r"(\.jsonl\.gz|\.txt\.gz|\.[^./]+)$", 1)


@F.pandas_udf(T.BooleanType())
def looks_binary(head: pd.Series) -> pd.Series:
    """Too many NUL or control bytes in the first 64 KiB."""
    out = []
    for data in head:
        x = np.frombuffer((data or b"")[:SNIFF_BYTES], dtype=np.uint8)
        control = (x < 32) & ~np.isin(x, (9, 10, 12, 13))
        out.append(bool(len(x)) and ((x == 0).mean() > NUL_SHARE or control.mean() > CONTROL_SHARE))
    return pd.Series(out)


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Files below a folder: path, filename, ext, size_bytes, supported, reason (null if supported)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    ext = extension(F.element_at(F.split("path", "/"), -1))
    sniffed = looks_binary(F.substring("content", 1, SNIFF_BYTES))
    reason = (
        F.when(F.col("ext").isin(*BINARY_KINDS), "binary or archive type")
        .when(~F.col("ext").isin(*SUPPORTED), "unsupported extension")
        .when(F.col("ext").isin(".txt", ".md", ".csv", ".tsv", ".json", ".jsonl") & F.col("_binary"), "binary-looking content")
    )
    named = files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), ext.alias("ext"), F.col("length").alias("size_bytes"), sniffed.alias("_binary"))
    return named.withColumn("reason", reason).withColumn("supported", F.col("reason").isNull()).drop("_binary")


def inventory_summary(files: DataFrame) -> DataFrame:
    """Files and bytes by extension and reason."""
    return files.groupBy("ext", "reason").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def _documents(rows: DataFrame, source: Column, fields: tuple[str, ...]) -> DataFrame:
    """Document rows of records whose text fields are string columns."""
    made = extract_text(rows.withColumn("_source", source), fields)
    labels = {("language" if c in ("lang", "language") else c): F.col(c) for c in ("lang", "language", "domain", "source", "dataset") if c in rows.columns}
    return made.select(
        "text", F.col("_source").alias("source"), X.utf8_bytes("text").alias("raw_bytes"), X.content_hash("text").alias("content_sha256"),
        "fields", (labels_of(labels) if labels else F.create_map().cast("map<string,string>")).alias("labels"), "ambiguity",
    )


def read_text(spark: SparkSession, paths: list[str], chunk_bytes: int = 1 << 20) -> DataFrame:
    """Plain text, also gzipped, in chunks of about ``chunk_bytes`` cut after a line end where there is one."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("value"), F.col("_metadata.file_path").alias("source"))

    @F.pandas_udf("array<string>")
    def chunks(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            data, parts, at = v.encode("utf-8", "surrogatepass"), [], 0
            while at < len(data):
                end = min(len(data), at + chunk_bytes)
                if end < len(data):
                    cut = data.rfind(b"\n", at, end) + 1
                    end = cut if cut > at else end
                    while end > at + 1 and end < len(data) and data[end] & 0xC0 == 0x80:
                        end -= 1  # never within a character
                parts.append(data[at:end].decode("utf-8", "replace"))
                at = end
            out.append(parts)
        return pd.Series(out)

    return _documents(raw.select("source", F.explode(chunks("value")).alias("text")).withColumnRenamed("source", "_path"), F.col("_path"), ("text",))


def read_json_lines(spark: SparkSession, paths: list[str], fields: tuple[str, ...] = TEXT_FIELDS, max_bytes: int = 64 << 20) -> DataFrame:
    """JSON lines, also gzipped. Lines over ``max_bytes`` are left out; broken ones have no text and say why."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("_path")).where((F.trim("value") != "") & (F.octet_length("value") <= max_bytes))
    names = dict.fromkeys((*fields, "language", "lang", "domain", "dataset"))
    schema = ", ".join("messages array<struct<role:string,content:string>>" if n == "messages" else f"`{n}` string" for n in names) + ", _broken string"
    parsed = lines.select("_path", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}).alias("r"), "value").select("_path", "r.*", "value")
    chat = F.array_join(
        F.transform("messages", lambda m: F.concat(F.lit("<|message:"), F.substring(F.replace(F.replace(F.coalesce(m["role"], F.lit("unknown")), F.lit("\n"), F.lit(" ")), F.lit("|>"), F.lit("")), 1, 80), F.lit("|>\n"), m["content"], F.lit("\n<|end_message|>"))),
        "\n",
    )
    sound = F.forall("messages", lambda m: m["content"].isNotNull()) & (F.size("messages") > 0)
    plain = _documents(parsed.where("messages is null and _broken is null").drop("messages", "_broken", "value"), F.col("_path"), tuple(f for f in fields if f != "messages"))
    talks = parsed.where("messages is not null and _broken is null").select(F.when(sound, chat).alias("text"), "_path", "language", "lang", "domain", "dataset")
    talked = _documents(talks, F.col("_path"), ("text",)).withColumns(
        {"fields": F.array(F.lit("messages")), "ambiguity": F.when(F.col("text").isNull(), "messages is not a valid role/content array")}
    )
    broken = _documents(parsed.where("_broken is not null").select("_path", F.lit(None).cast("string").alias("text")), F.col("_path"), ("text",)).withColumn("ambiguity", F.lit("invalid JSON"))
    return reduce(DataFrame.unionByName, (plain, talked, broken))


def read_json_array(spark: SparkSession, paths: list[str], fields: tuple[str, ...] = TEXT_FIELDS) -> DataFrame:
    """Files of one JSON array or object; string records are texts themselves."""
    rows = spark.read.text(paths, wholetext=True).select(F.trim("value").alias("v"), F.col("_metadata.file_path").alias("_path"))
    items = rows.select("_path", F.explode(F.when(F.col("v").startswith("["), F.from_json("v", "array<string>")).otherwise(F.array("v"))).alias("item"))
    names = [f for f in fields if f != "messages"] + ["language", "domain"]
    parsed = items.withColumn("r", F.from_json("item", ", ".join(f"`{n}` string" for n in names)))
    is_object = F.col("item").startswith("{")
    flat = parsed.select("_path", *[F.when(is_object, F.col(f"r.{n}")).otherwise(F.col("item") if n == "text" else F.lit(None)).alias(n) for n in names])
    return _documents(flat, F.col("_path"), tuple(fields))


def read_csv(spark: SparkSession, paths: list[str], separator: str = ",", fields: tuple[str, ...] = TEXT_FIELDS) -> DataFrame:
    """CSV or TSV with a header; quoted fields may hold separators and line ends."""
    rows = spark.read.csv(paths, header=True, sep=separator, multiLine=True, escape='"').withColumn("_path", F.col("_metadata.file_path"))
    return _documents(rows, F.col("_path"), fields)


def read_parquet(spark: SparkSession, paths: list[str], fields: tuple[str, ...] = TEXT_FIELDS) -> DataFrame:
    """Parquet rows; only the text and label columns that exist are read."""
    rows = spark.read.parquet(*paths)
    wanted = [c for c in rows.columns if c in (*fields, "language", "lang", "domain", "source", "dataset") and c != "messages"]
    return _documents(rows.select(*wanted, F.col("_metadata.file_path").alias("_path")), F.col("_path"), fields)


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    """A table of conversation turns as one document a conversation."""
    return chat_text(spark.read.parquet(path))


READERS = {".jsonl": read_json_lines, ".jsonl.gz": read_json_lines, ".json": read_json_array, ".csv": read_csv, ".parquet": read_parquet}


def read_folder(spark: SparkSession, folder: str, fields: tuple[str, ...] = TEXT_FIELDS, chunk_bytes: int = 1 << 20) -> DataFrame:
    """All supported files below a folder as documents."""
    by_kind: dict[str, list[str]] = {}
    for r in inventory(spark, folder).where("supported").select("path", "ext").collect():  # names of files, not their content
        by_kind.setdefault(r["ext"], []).append(r["path"])
    parts = []
    for kind, paths in sorted(by_kind.items()):
        if kind in TEXT_KINDS:
            parts.append(read_text(spark, paths, chunk_bytes))
        elif kind == ".tsv":
            parts.append(read_csv(spark, paths, "\t", fields))
        else:
            parts.append(READERS[kind](spark, paths, fields=fields))
    if not parts:
        raise ValueError(f"no supported file below {folder}")
    return reduce(DataFrame.unionByName, parts)
