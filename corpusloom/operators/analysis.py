"""Evaluation, inequality, Pareto selection, patches, permutations and sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import number_rows

#: Weights of the composite score.
PARETO_WEIGHTS = {
    "macro_bpt": 0.20,
    "worst_lang_bpt": 0.20,
    "overall_bpt": 0.15,
    "lm_learning_quality": 0.15,
    "vocab_utilization": 0.10,
    "throughput": 0.08,
    "param_efficiency": 0.07,
    "rare_fraction_penalty": 0.05,
}
CLUSTERS = (("head", 16_384), ("tail0", 131_072), ("tail1", 524_288))
FREQUENCY_BANDS = (("top_1k", 1_000), ("top_10k", 10_000), ("top_100k", 100_000), ("top_500k", 500_000))


def rounded(value: Column, places: int = 6) -> Column:
    return F.round(value.cast("double"), places)


def fairness(values: DataFrame, value: str) -> DataFrame:
    """One row of spread and inequality measures over a few values (one a language)."""
    order = Window.orderBy(value)  # one row a language
    ranked = values.select(F.col(value).cast("double").alias("v")).withColumn("i", F.row_number().over(order).cast("double"))
    n, total, mean = F.count("*").cast("double"), F.sum("v"), F.avg("v")
    basic = ranked.agg(
        F.max("v").alias("best"), F.min("v").alias("worst"), F.percentile("v", F.lit(0.1)).alias("p10"), F.percentile("v", F.lit(0.5)).alias("p50"),
        F.percentile("v", F.lit(0.9)).alias("p90"), mean.alias("mean"), F.stddev_pop("v").alias("std"),
        (F.sum((2 * F.col("i")) * F.col("v")) - (n + 1) * total).alias("_g"), (n * total).alias("_nt"), F.sum(F.col("v") * F.ln("v")).alias("_vlnv"), total.alias("_t"), n.alias("_n"),
    )
    return basic.select(
        *[rounded(F.col(c)).alias(c) for c in ("best", "worst", "p10", "p50", "p90", "mean", "std")],
        rounded(F.col("std") / F.col("mean")).alias("cv"),
        rounded(F.col("_g") / F.col("_nt")).alias("gini"),
        rounded(F.col("_vlnv") / F.col("_t") - F.ln("mean")).alias("theil"),
        rounded(F.when(F.col("worst") > 0, F.col("best") / F.col("worst")).otherwise(999.0)).alias("max_to_min"),
    )


def pareto(candidates: DataFrame) -> DataFrame:
    """name, composite score and whether nothing dominates it; lossy candidates score 0."""
    tops = candidates.agg(*[F.max(c).alias(f"_{c}") for c in ("macro_bpt", "worst_bpt", "overall_bpt", "lm_quality", "utilization", "throughput", "vocab_size")])
    joined = candidates.join(F.broadcast(tops))  # one row beside
    share = lambda c: F.col(c) / F.when(F.col(f"_{c}") == 0, 1.0).otherwise(F.col(f"_{c}"))
    w = PARETO_WEIGHTS
    score = (
        w["macro_bpt"] * share("macro_bpt") + w["worst_lang_bpt"] * share("worst_bpt") + w["overall_bpt"] * share("overall_bpt")
        + w["lm_learning_quality"] * share("lm_quality") + w["vocab_utilization"] * share("utilization") + w["throughput"] * share("throughput")
        + w["param_efficiency"] * (1 - F.col("vocab_size") / (2 * F.col("_vocab_size"))) + w["rare_fraction_penalty"] * (1 - F.col("rare_fraction"))
    )
    scored = joined.select(*candidates.columns, rounded(F.when(F.col("lossless"), score).otherwise(0.0)).alias("score"))
    other = candidates.select(*[F.col(c).alias(f"o_{c}") for c in ("name", "macro_bpt", "worst_bpt", "vocab_size", "throughput")])
    beats = (
        (F.col("o_name") != F.col("name")) & (F.col("o_macro_bpt") >= F.col("macro_bpt")) & (F.col("o_worst_bpt") >= F.col("worst_bpt"))
        & (F.col("o_vocab_size") <= F.col("vocab_size")) & (F.col("o_throughput") >= F.col("throughput"))
        & ((F.col("o_macro_bpt") > F.col("macro_bpt")) | (F.col("o_worst_bpt") > F.col("worst_bpt")) | (F.col("o_vocab_size") < F.col("vocab_size")))
    )
    best = scored.join(other, beats, "left_anti").select("name", F.lit(True).alias("_best"))  # a handful of tokenizers
    return scored.join(best, "name", "left").select("name", "score", (F.coalesce("_best", F.lit(False)) & F.col("lossless")).alias("on_frontier"))


def representation_costs(sizes: DataFrame, width: int = 4096) -> DataFrame:
    """(vocab_size, representation, params_m, mem_mb) of four embedding layouts at 2 bytes a weight."""
    v = F.col("vocab_size").cast("double")
    params = {
        "dense": 2 * v * width,
        "lexical_projection": 2 * (v * 128 + 128 * width),
        "cluster_offset": (1024 * 128 + v * 16 + 128 * width) + (width * 128 + 128 * v),
        "large_in_compact_out": (v * 128 + 128 * width) + 65536.0 * width,
    }
    parts = F.array(*[F.struct(F.lit(k).alias("representation"), p.alias("p")) for k, p in params.items()])
    rows = sizes.select("vocab_size", F.explode(parts).alias("x"))
    return rows.select("vocab_size", "x.representation", rounded(F.col("x.p") / 1e6).alias("params_m"), rounded(F.col("x.p") * 2 / 1048576).alias("mem_mb"))


def band(rank: Column, bands: tuple[tuple[str, int], ...], last: str) -> Column:
    """Name of the first band whose upper rank is above ``rank``."""
    out = F.lit(last)
    for name, upper in reversed(bands):
        out = F.when(rank < upper, name).otherwise(out)
    return out


def frequency_ranks(counts: DataFrame) -> DataFrame:
    """Add ``rank`` from 0: by falling count, then token."""
    return number_rows(counts.select("token", "count"), "rank", F.desc("count"), F.asc("token"))


def entropy_table(counts: DataFrame, vocab_size: int) -> DataFrame:
    """Add ``bits``: -log2 of the add-one probability of a token."""
    total = counts.agg(F.sum("count").alias("_t"))
    return counts.join(F.broadcast(total)).select("token", "count", rounded(-F.log2((F.col("count") + 1.0) / (F.col("_t") + F.lit(vocab_size)))).alias("bits"))  # one row beside


def entropy_patches(ids: Column, bits: Column, threshold: float, longest: int = 8) -> Column:
    """Lengths of causal patches: one ends where its bits reach ``threshold`` or at ``longest``.

    ``bits`` runs along ``ids``; whether a patch ends depends only on what came before.
    """
    start = F.struct(F.array().cast("array<int>").alias("done"), F.lit(0).alias("n"), F.lit(0.0).alias("sum"))

    def step(acc: Column, b: Column) -> Column:
        n, total = acc["n"] + 1, acc["sum"] + b
        end = (total >= threshold) | (n >= longest)
        return F.struct(
            F.when(end, F.array_append(acc["done"], n)).otherwise(acc["done"]).alias("done"), F.when(end, 0).otherwise(n).alias("n"), F.when(end, 0.0).otherwise(total).alias("sum")
        )

    return F.aggregate(bits, start, step, lambda acc: F.when(acc["n"] > 0, F.array_append(acc["done"], acc["n"])).otherwise(acc["done"]))


def splitmix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 mix of unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def draws(spark, count: int, seed: int, positions: int) -> DataFrame:
    """(i, draw): splitmix64(seed xor i) modulo the number of positions."""

    @F.pandas_udf("long")
    def mixed(i: pd.Series) -> pd.Series:
        x = i.to_numpy().astype(np.uint64) ^ np.uint64(seed)
        return pd.Series((splitmix64(x) % np.uint64(max(1, positions))).astype(np.int64))

    return spark.range(count).select(F.col("id").alias("i"), mixed("id").alias("draw"))


def locate(drawn: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """Span of each draw: a range join by buckets of ``width`` positions.

    ``spans`` has key, first and last position. Every span is listed in the
    buckets it touches, so the join is on equal buckets.
    """
    listed = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))))
    found = drawn.withColumn("_b", F.floor(F.col("draw") / width)).join(listed, "_b")
    return found.where(F.col("draw").between(F.col("first"), F.col("last"))).drop("_b")


def sweep_winners(candidates: DataFrame) -> DataFrame:
    """(ranking, winner, score) of candidate vocabularies (name, macro_bpt, worst_bpt, gini, params_m, thru_mb_s).

    One ranking is by compression alone, the other weighs parameters and throughput
    as well. Of candidates that tie, the greatest name wins; without candidates the
    winners are null.
    """
    compression = F.col("macro_bpt") * 0.5 + F.col("worst_bpt") * 0.5 - F.col("gini") * 2.0
    whole = F.col("macro_bpt") / 10.0 + F.col("worst_bpt") / 5.0 - F.col("gini") * 1.5 - F.col("params_m") / 1000.0 * 0.15 + F.col("thru_mb_s") / 10.0 * 0.1
    best = lambda score: F.max(F.struct(score.alias("score"), F.col("name").alias("winner")))
    both = candidates.agg(best(compression).alias("compression"), best(whole).alias("end_to_end"))
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("ranking"), F.col(n).alias("b")) for n in ("compression", "end_to_end")]))
    return both.select(rows.alias("r")).select("r.ranking", "r.b.winner", F.round("r.b.score", 6).alias("score"))


def audit_matrix(rows: DataFrame) -> DataFrame:
    """(area, model, tokens, bytes_per_token, tokens_per_line) of rows (sample, area, model, tokens, bytes, lines)."""
    sums = rows.groupBy("area", "model").agg(F.sum("tokens").alias("tokens"), F.sum("bytes").alias("_b"), F.sum("lines").alias("_l"))
    return sums.select("area", "model", "tokens", F.try_divide("_b", "tokens").alias("bytes_per_token"), F.try_divide("tokens", "_l").alias("tokens_per_line"))


def regressions(rows: DataFrame, model: str, rivals: tuple[str, ...], slack: float = 1.10) -> DataFrame:
    """Samples on which ``model`` takes over ``slack`` times the tokens of its best rival.

    ``rows`` are (sample, model, tokens). Of equal rivals the first named is the
    best. Samples without the model or without rivals are left out.
    """
    place = F.lit(len(rivals))
    for k, name in reversed(list(enumerate(rivals))):
        place = F.when(F.col("model") == name, k).otherwise(place)
    best = F.min(F.when(F.col("model").isin(*rivals), F.struct("tokens", place.alias("place"), "model")))
    both = rows.groupBy("sample").agg(F.max(F.when(F.col("model") == model, F.col("tokens"))).alias("tokens"), best.alias("b"))
    worse = both.where(F.col("tokens") > F.col("b.tokens") * slack)
    percent = F.try_divide((F.col("tokens") - F.col("b.tokens")) * 100.0, F.col("b.tokens"))
    return worse.select("sample", "tokens", F.col("b.tokens").alias("best_tokens"), F.col("b.model").alias("best_model"), percent.alias("regression_percent"))


def coverage(words: DataFrame) -> DataFrame:
    """Coverage by language of words (lang, freq, pieces), ``pieces`` being the texts of a word's tokens.

    A word of one token is whole, others are fragmented; a root is kept if any
    piece has three characters or more besides white space. Languages without
    fragmented words have one fragment on average.
    """
    n, f = F.size("pieces"), F.col("freq")
    rooted = F.exists("pieces", lambda p: F.length(F.trim(p)) >= 3)
    total = F.sum(f)
    parts, broken = F.sum(F.when(n > 1, n * f)), F.sum(F.when(n > 1, f))
    return words.groupBy("lang").agg(
        total.alias("words"),
        (F.sum(F.when(n == 1, f).otherwise(0)) * 100.0 / total).alias("whole_word_percent"),
        (F.sum(F.when(n != 1, f).otherwise(0)) * 100.0 / total).alias("fragmented_percent"),
        F.coalesce(parts / broken, F.lit(1.0)).alias("fragments_per_broken_word"),
        (F.sum(F.when(rooted, f).otherwise(0)) * 100.0 / total).alias("root_kept_percent"),
    )
