"""Vocabulary mining, scoring, allocation, merging and pruning.

Candidates are long rows (token, lang, freq): every measure is an aggregate over
them, and no language needs a column of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scripts as S
from ..functions import text as X
from ..session import shared_checkpoint
from .ranking import number_rows

FIRST_ID, BYTE_TOKENS, TEMPERATURE = 265, 256, 2.5


def word_counts(docs: DataFrame, by: tuple[str, ...] = ("lang",)) -> DataFrame:
    """(token, *by, freq) of the words of all documents."""
    return docs.select(*by, F.explode(X.words("text")).alias("token")).groupBy("token", *by).agg(F.count("*").alias("freq"))


def ngram_counts(docs: DataFrame, n: int, least: int, low: int = 4, high: int = 120) -> DataFrame:
    """(phrase, freq) of n-word phrases within documents, frequent and of fitting length."""
    grams = docs.select(F.explode(X.ngrams(X.words("text"), n)).alias("phrase"))
    return grams.where(F.length("phrase").between(low, high)).groupBy("phrase").agg(F.count("*").alias("freq")).where(F.col("freq") >= least)


def append_to_vocabulary(candidates: DataFrame, vocabulary: DataFrame, first_id: int) -> DataFrame:
    """Candidates that the vocabulary lacks, numbered by falling frequency and length."""
    new = candidates.join(vocabulary.select(F.col("token").alias("phrase")), "phrase", "left_anti")
    numbered = number_rows(new, "token_id", F.desc("freq"), F.desc(F.length("phrase")), F.asc("phrase"))
    return numbered.withColumn("token_id", F.col("token_id") + first_id)


def mined_candidates(docs: DataFrame, longest: int = 16, affix: int = 5) -> DataFrame:
    """(token, lang, freq): chunks three times, their prefixes and suffixes twice.

    Chunks are counted first, so affixes are cut from distinct chunks only.
    """
    chunks = docs.select("lang", F.explode(X.pretokens("text")).alias("token")).groupBy("token", "lang").agg(F.count("*").alias("n"))
    whole = chunks.where(F.octet_length("token") <= longest).select("token", "lang", (F.col("n") * 3).alias("freq"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(affix), F.length("token")))
    long = chunks.where(F.length("token") > 1)
    front = long.select(F.explode(F.transform(lengths, lambda k: F.substring(F.col("token"), F.lit(1), k))).alias("token"), "lang", (F.col("n") * 2).alias("freq"))
    back = long.select(F.explode(F.transform(lengths, lambda k: F.right(F.col("token"), k))).alias("token"), "lang", (F.col("n") * 2).alias("freq"))
    return whole.unionByName(front).unionByName(back).groupBy("token", "lang").agg(F.sum("freq").alias("freq"))


def candidate_metrics(long: DataFrame) -> DataFrame:
    """Per token: total, languages, bytes and positions saved, entropy over languages, collision risk.

    The entropy is normalised by that of an even spread over all languages of the
    corpus, not only those of the token. Short whole words of many languages run
    the risk of meaning different things.
    """
    f = F.col("freq").cast("double")
    grouped = long.groupBy("token").agg(F.sum("freq").alias("total_freq"), F.count("*").alias("n_langs"), F.sum(f * F.log2(f)).alias("_flogf"))
    languages = long.groupBy("lang").agg(F.lit(1).alias("_one")).agg(F.count("*").cast("double").alias("_all"))
    total = F.col("total_freq").cast("double")
    most = F.when(F.col("_all") > 1, F.log2("_all")).otherwise(1.0)
    entropy = F.when(F.col("n_langs") > 1, (F.log2(total) - F.col("_flogf") / total) / most).otherwise(0.0)
    risky = (F.length("token") <= 2) & (F.col("n_langs") > 4) & (S.token_type(F.col("token")) == "WHOLE_WORD")
    return grouped.join(F.broadcast(languages)).select(  # one row beside
        "token",
        "total_freq",
        "n_langs",
        (F.greatest(F.lit(0), F.octet_length("token") - 1) * F.col("total_freq")).alias("bytes_saved"),
        (F.greatest(F.lit(0), F.length("token") - 1) * F.col("total_freq")).alias("positions_saved"),
        entropy.alias("entropy"),
        F.when(risky, 0.5).otherwise(0.0).alias("collision_risk"),
    )


def language_weights(long: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """(lang, mass, smooth, fair): smoothed weights p^(1/T)/p and root-of-ratio weights."""
    mass = long.groupBy("lang").agg(F.sum("freq").alias("mass"))
    totals = mass.agg(F.sum("mass").alias("_all"), F.max("mass").alias("_top"))
    p = F.col("mass") / F.col("_all")
    return mass.join(F.broadcast(totals)).select("lang", "mass", (F.pow(p, F.lit(1.0 / temperature)) / p).alias("smooth"), F.sqrt(F.col("_top") / F.col("mass")).alias("fair"))  # one row beside


def top(scored: DataFrame, slots: int, *order: Column) -> DataFrame:
    """The first ``slots`` rows in ``order`` with their rank from 1."""
    first = scored.orderBy(*order).limit(slots)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # slots rows at most


def allocate(long: DataFrame, strategy: str, slots: int, guarantee: int = 500) -> DataFrame:
    """(rank, token, score) by one of the five allocation strategies, ties by token.

    a frequency, b smoothed over languages, c a guarantee a script and then by
    frequency, d positions saved, e fairness-weighted utility.
    """
    metrics = candidate_metrics(long)
    by_score = (F.desc("score"), F.asc("token"))
    if strategy == "a":
        return top(metrics.select("token", F.col("total_freq").cast("double").alias("score")), slots, *by_score)
    if strategy == "d":
        return top(metrics.select("token", F.col("positions_saved").cast("double").alias("score")), slots, *by_score)
    if strategy == "c":
        scripted = metrics.withColumn("script", token_script(F.col("token")))
        within = Window.partitionBy("script").orderBy(F.desc("total_freq"), "token")
        ranked = scripted.withColumn("_r", F.row_number().over(within)).where(F.col("_r") <= slots)
        marked = ranked.select("token", F.col("total_freq").cast("double").alias("score"), (F.col("_r") > guarantee).cast("int").alias("tier"))
        return top(marked, slots, F.asc("tier"), *by_score)
    weights = language_weights(long)
    joined = long.join(F.broadcast(weights), "lang")  # one row a language
    if strategy == "b":
        scored = joined.groupBy("token").agg(F.round(F.sum(F.col("freq") * F.col("smooth")), 6).alias("score"))
        return top(scored, slots, *by_score)
    if strategy == "e":
        utility = joined.groupBy("token").agg(F.sum(F.col("freq") * (F.octet_length("token") - 1) * F.col("fair")).alias("_u"))
        bonus = F.when(token_script(F.col("token")).isin("LATIN", "PUNCTUATION_SPACE"), 1.0).otherwise(1.3)
        scored = utility.join(metrics.select("token", "entropy", "collision_risk"), "token").select(
            "token", F.round(F.col("_u") * (1 + F.col("entropy") * 1.2) * bonus * (1 - F.col("collision_risk")), 6).alias("score")
        )
        return top(scored, slots, *by_score)
    raise ValueError(f"unknown strategy {strategy!r}")


def token_script(token: Column) -> Column:
    """Script of a token: the most frequent of its characters' scripts, the first seen of equals."""
    kinds = F.filter(F.transform(X.characters(token), S.char_script), lambda s: ~s.isin(*S.NEUTRAL))
    distinct = F.array_distinct(kinds)  # in the order of first sight
    best = F.reduce(
        distinct,
        F.struct(F.lit(S.DEFAULT_SCRIPT).alias("s"), F.lit(0).alias("n")),
        lambda acc, s: F.when(F.size(F.filter(kinds, lambda k: k == s)) > acc["n"], F.struct(s.alias("s"), F.size(F.filter(kinds, lambda k: k == s)).alias("n"))).otherwise(acc),
    )
    return best["s"]


def sharing_analysis(metrics: DataFrame, roots: tuple[str, ...]) -> DataFrame:
    """Sharing efficiency, collision penalty and net utility of each token."""
    bare = F.lower(F.trim("token"))
    root = bare.isin(*roots)
    penalty = F.when((F.length(bare) <= 2) & (F.col("n_langs") > 5) & ~root & (S.token_type(F.col("token")) != "WHITESPACE_FACTOR"), 0.4).otherwise(0.0)
    efficiency = F.col("bytes_saved") * (1 + F.col("entropy") * 1.5)
    return metrics.select("token", "n_langs", root.alias("is_shared_root"), penalty.alias("collision_penalty"), efficiency.alias("sharing_efficiency"), (efficiency * (1 - penalty)).alias("net_utility"))


def consensus(pool: DataFrame) -> DataFrame:
    """(k, exactly, at_least): tokens by number of sources; ``pool`` is (token, source)."""
    sizes = pool.groupBy("token").agg(F.countDistinct("source").alias("k")).groupBy("k").agg(F.count("*").alias("exactly"))
    down = Window.orderBy(F.desc("k"))  # one row a number of sources
    return sizes.withColumn("at_least", F.sum("exactly").over(down))


def overlap(pool: DataFrame) -> DataFrame:
    """(a, b, shared, either, jaccard) of all ordered pairs of sources.

    Tokens become sorted sets of sources; equal sets are counted once, so the
    expansion to pairs runs over distinct sets, not tokens.
    """
    sets = pool.groupBy("token").agg(F.array_sort(F.collect_set("source")).alias("sources")).groupBy("sources").agg(F.count("*").alias("n"))
    sizes = sets.select(F.explode("sources").alias("source"), "n").groupBy("source").agg(F.sum("n").alias("size"))
    pairs = sets.select(F.explode("sources").alias("a"), "sources", "n").select("a", F.explode("sources").alias("b"), "n").where("a <> b")
    shared = pairs.groupBy("a", "b").agg(F.sum("n").alias("shared"))
    names = sizes.select(F.col("source").alias("a"), F.col("size").alias("sa"))
    other = sizes.select(F.col("source").alias("b"), F.col("size").alias("sb"))
    everyone = names.join(other, F.col("a") != F.col("b"))  # sources, not tokens
    both = everyone.join(shared, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    either = F.col("sa") + F.col("sb") - F.col("shared")
    return both.select("a", "b", "shared", either.alias("either"), (F.col("shared") / either).alias("jaccard"))


def merge_pools(pools: list[DataFrame], slots: int, first_id: int = FIRST_ID) -> DataFrame:
    """(token, pool, token_id): the first pool that has a token wins; pools are (token, freq)."""
    tagged = None
    for k, pool in enumerate(pools):
        part = pool.select("token", "freq", F.lit(k).alias("pool"))
        tagged = part if tagged is None else tagged.unionByName(part)
    best = tagged.groupBy("token").agg(F.min(F.struct("pool", (-F.col("freq")).alias("f"))).alias("m")).select("token", "m.pool", F.col("m.f").alias("_f"))
    chosen = best.orderBy("pool", "_f", "token").limit(slots)
    return chosen.select("token", "pool", (F.row_number().over(Window.orderBy("pool", "_f", "token")) - 1 + F.lit(first_id)).alias("token_id"))


def pruned(vocabulary: DataFrame, least: int, drop: tuple[str, ...] = ("cjk_strict", "cyrillic"), first_id: int = FIRST_ID) -> DataFrame:
    """Vocabulary (token, freq) without rare phrases and dropped scripts, numbered anew."""
    phrase = F.trim("token").contains(" ")
    keep = ~(phrase & (F.col("freq") < least))
    for kind in drop:
        keep = keep & ~S.has_any(F.col("token"), kind)
    numbered = number_rows(vocabulary.where(keep).select("token", "freq"), "token_id", F.desc("freq"), F.asc("token"))
    return numbered.withColumn("token_id", F.col("token_id") + first_id)


def budgeted(vocabulary: DataFrame, budgets: dict[str, int], slots: int) -> DataFrame:
    """Tokens within a budget a type, then the best of the rest, up to ``slots``."""
    kind = S.structural_type(F.col("token"))
    typed = vocabulary.withColumn("kind", kind)
    within = Window.partitionBy("kind").orderBy(F.desc("freq"), F.octet_length("token"), "token")
    ranked = typed.withColumn("_r", F.row_number().over(within)).where(F.col("_r") <= slots)
    limit = F.lit(0)
    for name, n in budgets.items():
        limit = F.when(F.col("kind") == name, n).otherwise(limit)
    marked = ranked.select("token", "freq", "kind", (F.col("_r") > limit).cast("int").alias("tier"))
    return top(marked, slots, F.asc("tier"), F.desc("freq"), F.octet_length("token"), F.asc("token"))


def spm_piece(piece: Column) -> Column:
    """Bytes of a sentence-piece entry: <0xXX> is a byte, the bar a space."""
    return F.when(piece.rlike("^<0x[0-9A-Fa-f]{2}>$"), F.unhex(F.substring(piece, 4, 2))).otherwise(F.encode(F.replace(piece, F.lit("▁"), F.lit(" ")), "utf-8"))


def word_compositions(words: DataFrame, pool: DataFrame, keep: tuple[int, int] = (6, 4)) -> DataFrame:
    """(word, pieces): a word's first splits into two and into three pool tokens, shortest first parts first.

    The first piece may be in the pool bare or behind a space. A word is only cut
    into lengths that pool tokens have, so a very long one has few cuts. Words, pool
    and begun cuts are written once, so the corpus behind them is read once.
    """
    known = shared_checkpoint(pool.select("token").distinct())
    starts = known.unionByName(known.where(F.col("token").startswith(" ")).select(F.expr("substring(token, 2)").alias("token"))).distinct()
    lengths = starts.agg(F.collect_set(F.length("token")).alias("_l"))
    found = None
    sized = shared_checkpoint(words.select("word").distinct()).join(F.broadcast(lengths)).withColumn("_n", F.length("word"))  # one row beside
    fits = lambda n: F.array_contains("_l", n)
    cuts = sized.where("_n > 1").select("*", F.explode(F.filter("_l", lambda i: (i > 0) & (i < F.col("_n")))).alias("_i"))
    begun = shared_checkpoint(cuts.select("*", F.left("word", F.col("_i")).alias("token")).join(starts, "token", "left_semi").drop("token"))
    two = begun.where(fits(F.col("_n") - F.col("_i"))).select("word", F.array("_i").alias("_at"), "_n")
    more = begun.select("*", F.explode(F.filter("_l", lambda k: (k > 0) & (F.col("_i") + k < F.col("_n")) & fits(F.col("_n") - F.col("_i") - k))).alias("_k"))
    three = more.select("word", F.array(F.col("_i"), F.col("_i") + F.col("_k")).alias("_at"), "_n")
    for k, (splits, most) in enumerate(zip((two, three), keep), 2):
        bounds = [F.lit(0), *[F.get("_at", F.lit(x)) for x in range(k - 1)], F.col("_n")]
        pieces = F.array(*[F.substring(F.col("word"), start + 1, end - start) for start, end in zip(bounds, bounds[1:])])
        split = splits.select("word", "_at", pieces.alias("pieces"))
        for piece in range(1, k):
            split = split.withColumn("token", F.get("pieces", F.lit(piece))).join(known, "token", "left_semi").drop("token")
        order = Window.partitionBy("word").orderBy("_at")
        kept = split.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).select("word", "pieces")
        found = kept if found is None else found.unionByName(kept)
    return found


def inserted(vocabulary: DataFrame, tokens: DataFrame, first_id: int = FIRST_ID) -> DataFrame:
    """``vocabulary`` (token_bytes, token_id) with further tokens (token_bytes, order) inserted in order.

    Bytes that are known keep their id, the first of equals wins, and null or empty
    bytes are left out. New ids go on from the largest; an empty vocabulary starts at
    ``first_id``.
    """
    fresh = tokens.where(F.octet_length("token_bytes") > 0).groupBy("token_bytes").agg(F.min("order").alias("_o"))
    new = fresh.join(vocabulary.select("token_bytes"), "token_bytes", "left_anti")
    top = vocabulary.agg(F.greatest(F.coalesce(F.max("token_id") + 1, F.lit(first_id)), F.lit(first_id)).cast("long").alias("_next"))
    numbered = number_rows(new, "_k", F.asc("_o"), F.asc("token_bytes")).join(F.broadcast(top))  # one row beside
    made = numbered.select("token_bytes", (F.col("_next") + F.col("_k")).cast("long").alias("token_id"))
    return vocabulary.select("token_bytes", F.col("token_id").cast("long").alias("token_id")).unionByName(made)
