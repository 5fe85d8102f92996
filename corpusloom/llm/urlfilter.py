"""URL filter: explicit host rules first, then a weighted vocabulary of URL terms.

The vocabulary has strict terms (one hit rejects) and soft terms (several
distinct hits reject). One Aho-Corasick automaton finds all terms in one pass
over the URL; a hit counts only at word boundaries, that is, where the
characters beside it are no ASCII letters or digits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Production vocabulary: URL words of adult, gambling, drug-selling and spam sites. ``load_terms`` reads a longer one.
STRICT_TERMS = (
    "adult", "blackjack", "camgirl", "camgirls", "casino", "casinos", "cialis", "erotic", "escort", "escorts", "hardcore", "hentai",
    "milf", "nsfw", "nude", "nudes", "phentermine", "pills", "porn", "porno", "pornstar", "roulette", "sexcam", "spam", "tramadol",
    "viagra", "warez", "xanax", "xxx",
)
SOFT_TERMS = (
    "bet", "bets", "betting", "bingo", "bonus", "buy", "cash", "cheap", "click", "coupon", "coupons", "crack", "deal", "deals", "discount",
    "farm", "free", "gamble", "jackpot", "keygen", "loan", "loans", "lottery", "naked", "payday", "pharmacy", "poker", "prize", "promo",
    "replica", "sale", "sex", "sexy", "slots", "torrent", "win", "winner",
)
#: Distinct soft terms that reject a URL.
SOFT_LIMIT = 2
#: Terms that a loaded vocabulary may have: the automaton goes to every executor.
MAX_TERMS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)

#: (action, rule); a rule is host, slash, path.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(action, rule) of the longest rule that fits; null if none does."""
    action = rule = F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # a longer rule is tried before, so it wraps
        name, slash, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        action, rule = F.when(fits, act).otherwise(action), F.when(fits, text).otherwise(rule)
    return action, rule


@lru_cache(maxsize=8)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    """Terms to (length, is strict, number of the term); a term in both lists is strict."""
    found = ahocorasick.Automaton()
    for k, term in enumerate(dict.fromkeys((*soft, *strict))):
        found.add_word(term, (len(term), term in strict, k))
    found.make_automaton()
    return found


def load_terms(terms: DataFrame, most: int = MAX_TERMS) -> tuple[list[str], list[str]]:
    """Strict and soft terms of a vocabulary table (term, weight): weight 1 or more is strict, above 0 soft.

    A-Z are lower-cased; null, empty and weightless terms are left out; a term that
    comes more than once has its greatest weight. More than ``most`` terms are an error.
    """
    named = terms.select(F.translate("term", UPPER, LOWER).alias("term"), "weight").where("term <> '' and weight > 0")
    rows = named.groupBy("term").agg(F.max("weight").alias("weight")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a vocabulary of more than {most} terms is too large to send out")
    return sorted(r["term"] for r in rows if r["weight"] >= 1), sorted(r["term"] for r in rows if r["weight"] < 1)


def _inside(text: str, at: int) -> bool:
    return 0 <= at < len(text) and text[at].isascii() and text[at].isalnum()


def term_hits(text: str, strict: Iterable[str], soft: Iterable[str]) -> tuple[int, int]:
    """(strict hits, distinct soft hits) in a lower-cased text, boundaries checked."""
    hard, kinds = 0, set()
    for end, (size, is_strict, k) in automaton(tuple(strict), tuple(soft)).iter(text):
        if _inside(text, end - size) or _inside(text, end + 1):
            continue
        if is_strict:
            hard += 1
        else:
            kinds.add(k)
    return hard, len(kinds)


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    strict: Sequence[str] = STRICT_TERMS,
    soft: Sequence[str] = SOFT_TERMS,
    soft_limit: int = SOFT_LIMIT,
    url: str = "url",
) -> DataFrame:
    """Add host, path, rule, strict_hits, soft_hits and verdict to ``pages``.

    A fitting rule decides; else one strict or ``soft_limit`` distinct soft hits
    block. Null URLs and those without ``://`` have an empty host and path and no
    rule, and the vocabulary judges what text there is (none: allow). Columns of
    the input that have one of the new names are replaced; all others stay, whatever
    their names. Only A-Z count as upper case. Without strict and soft terms nothing is
    hit. No shuffle: one narrow pass over the URL column.
    """
    strict, soft = tuple(sorted(set(strict))), tuple(sorted(set(soft)))

    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            rows = [term_hits(u.translate(FOLD), strict, soft) if isinstance(u, str) and (strict or soft) else (0, 0) for u in urls]
            yield pd.DataFrame(rows, columns=["strict_hits", "soft_hits"], dtype="int32")

    count = F.pandas_udf(hits, "strict_hits int, soft_hits int")
    action, rule = matching_rule(F.col("host"), F.col("path"), rules)
    vocabulary = F.when((F.col("strict_hits") > 0) | (F.col("soft_hits") >= soft_limit), "block").otherwise("allow")
    hit = "_hits"
    while hit in pages.columns:
        hit += "_"
    return (
        pages.withColumn(hit, count(F.col(url)))
        .withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
        .withColumns({"strict_hits": F.col(f"{hit}.strict_hits"), "soft_hits": F.col(f"{hit}.soft_hits")})
        .withColumns({"rule": rule, "verdict": F.coalesce(action, vocabulary)})
        .drop(hit)
    )
