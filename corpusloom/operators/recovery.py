"""State of long builds: latest records, resume plans, verification and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(records: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """One row a key: the last by ``order``, which must tell a key's rows apart.

    Null keys are a key of their own, null order values come first. Partial
    maxima are taken before the shuffle, so a hot key costs one row a task.
    """
    rest = [c for c in records.columns if c not in keys]
    best = records.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col("_row").getField(c).alias(c) for c in rest])


def upserted(table: DataFrame, changes: DataFrame, keys: tuple[str, ...], generation: str = "generation") -> DataFrame:
    """``table`` with ``changes`` put over it; the row of the greatest generation wins, changes over equals."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return latest(both, keys, (generation, "_new")).drop("_new")


def after_cursor(rows: DataFrame, index: str, done: int) -> DataFrame:
    """Rows from the cursor on: those whose index is not among the ``done`` first ones. The filter reaches the scan."""
    return rows.where(F.col(index) >= done)


def next_shards(records: DataFrame, splits: DataFrame) -> DataFrame:
    """(split, next_shard): one beyond the largest known shard, zero for a split without shards."""
    known = records.groupBy("split").agg((F.max("shard_id") + 1).cast("long").alias("next_shard"))
    return splits.select("split").distinct().join(known, "split", "left").select("split", F.coalesce("next_shard", F.lit(0)).alias("next_shard"))


def orphans(files: DataFrame, records: DataFrame) -> DataFrame:
    """Files (path) that no record names: what an interrupted build has left behind."""
    return files.join(records.select("path").distinct(), "path", "left_anti")


def same_identity(spark_conf: dict[str, str], saved: dict[str, str]) -> None:
    """Refuse to go on with another configuration than the one that began."""
    changed = sorted(k for k in spark_conf.keys() | saved.keys() if spark_conf.get(k) != saved.get(k))
    if changed:
        raise ValueError(f"the build was begun with other values of {', '.join(changed)}")


def mismatches(records: DataFrame, found: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, problem): records whose figures differ from what was found, one row a problem.

    ``missing`` is recorded only, ``unknown`` found only; else the names of the
    columns that differ, nulls being equal to nulls.
    """
    figures = [c for c in records.columns if c not in keys]
    a = records.select(*keys, F.struct(*figures).alias("_a"), F.lit(True).alias("_in_a"))
    b = found.select(*keys, F.struct(*figures).alias("_b"), F.lit(True).alias("_in_b"))
    joined = a.join(b, list(keys), "full_outer")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in figures]))
    problems = F.when(F.col("_in_b").isNull(), F.array(F.lit("missing"))).when(F.col("_in_a").isNull(), F.array(F.lit("unknown"))).otherwise(differ)
    return joined.select(*keys, F.explode(problems).alias("problem"))


def gate(rows: DataFrame, sound: Column, message: str) -> DataFrame:
    """``rows`` as they are; a row that isn't sound, or of which that is unknown, stops the job with ``message``."""
    return rows.where(F.when(F.coalesce(sound, F.lit(False)), True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def merged_frequencies(saved: DataFrame, counted: DataFrame) -> DataFrame:
    """(token_id, count, generation): saved counts with those of a further run, one generation on."""
    both = saved.select("token_id", "count", "generation").unionByName(counted.select("token_id", "count", F.lit(None).cast("long").alias("generation")))
    last = saved.agg((F.coalesce(F.max("generation"), F.lit(0)) + 1).cast("long").alias("generation"))
    return both.groupBy("token_id").agg(F.sum("count").alias("count")).join(F.broadcast(last))  # one row beside
