"""Incremental ingestion: new files become accepted documents exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import documents as D


def stream_documents(spark: SparkSession, folder: str, schema: str, files_a_trigger: int = 64) -> DataFrame:
    """New Parquet files below a folder as a stream of fingerprinted documents."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)
    return D.fingerprint(rows)


def ingest(stream: DataFrame, accepted: str, checkpoint: str, val_ratio: float = 0.005) -> StreamingQuery:
    """Append documents of unseen content to ``accepted``, partitioned by split.

    Each batch drops skipped documents and repeats within itself, then what the
    accepted table already holds. Offsets are in the checkpoint; a batch that is
    run again after a failure finds its own rows accepted and adds none.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        unique = D.dispositions(D.quality_flags(rows)).where("disposition = 'unique'").drop("lang", "source", "raw_bytes")
        new = D.assign_split(unique.join(rows.select("doc_id", "text", "lang", "source", "raw_bytes"), "doc_id"), val_ratio).select("doc_id", "text", "lang", "source", "raw_bytes", "content_sha256", "split").withColumn("batch", F.lit(number))
        try:
            seen = spark.read.parquet(accepted).select("content_sha256")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            new = new.join(seen, "content_sha256", "left_anti")
        new.write.mode("append").partitionBy("split").parquet(accepted)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
