"""Column expressions over text: words, bytes, hashes, pre-tokens."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Runs of anything but white space (with the separators 1C to 1F).
WORD = r"[^\p{IsWhite_Space}\x1c-\x1f]+"

#: Fixed value: the script-aware pre-tokenizer, first alternative wins, in Java's dialect.
PRETOKEN = "|".join(
    (
        r"'(?i:[sdmt]|ll|ve|re)",
        r"\p{IsHan}{1,2}",
        r"[\p{IsHiragana}\p{IsKatakana}]{1,2}",
        r"\p{IsHangul}{1,2}",
        r"[\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]\p{M}*",
        r" ?[\p{IsDevanagari}\p{IsBengali}\p{IsTamil}\p{IsTelugu}\p{IsKannada}\p{IsMalayalam}\p{IsGujarati}\p{IsGurmukhi}\p{IsOriya}\p{M}]+",
        r" ?[\p{IsArabic}\p{IsHebrew}\p{M}]+",
        r" ?[\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}\p{IsGeorgian}\p{IsEthiopic}\p{M}]+",
        r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?:'(?i:[sdmt]|ll|ve|re))?",
        r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?:'(?i:[sdmt]|ll|ve|re))?",
        r"\p{N}{1,3}",
        r" ?[^\p{IsWhite_Space}\p{L}\p{N}]+[\r\n]*",
        r"\p{IsWhite_Space}*[\r\n]+",
        r"\p{IsWhite_Space}+(?!\P{IsWhite_Space})",
        r"\p{IsWhite_Space}+",
    )
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once a row, however often it is used.

    A lambda variable binds it; a plain column would be evaluated again at every
    use, and again for every element within a higher-order function.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column | str) -> Column:
    """The words of a text, none for null."""
    return F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(WORD), F.lit(0))


def pretokens(text: Column | str) -> Column:
    """Chunks of the pre-tokenizer; joined they give the text."""
    return F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(PRETOKEN), F.lit(0))


def characters(text: Column | str) -> Column:
    """The code points of a text as strings."""
    return F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit("(?s)."), F.lit(0))


def utf8_bytes(text: Column | str) -> Column:
    """Bytes of a text in UTF-8, 0 for null."""
    return F.coalesce(F.octet_length(col(text)), F.lit(0)).cast("long")


def content_hash(text: Column | str) -> Column:
    """SHA-256 of the UTF-8 bytes in hex; null for null."""
    return F.sha2(col(text), 256)


def hash_fraction(sha: Column | str) -> Column:
    """The first 64 bits of a hex digest as a fraction of 2^64."""
    return F.conv(F.substring(col(sha), 1, 16), 16, 10).cast("double") / F.lit(18446744073709551616.0)


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined runs of n words; none for shorter texts."""

    def of(w: Column) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat_ws(" ", F.slice(w, i, n)))

    return let(tokens, of)


def occurrences(text: Column, piece: Column) -> Column:
    """Non-overlapping occurrences of ``piece`` in ``text``."""
    return F.when(
        F.length(piece) > 0, ((F.length(text) - F.length(F.replace(text, piece, F.lit("")))) / F.length(piece)).cast("long")
    ).otherwise(F.lit(0).cast("long"))


def top_run(values: Column) -> Column:
    """How often the most frequent value of an array comes, by one walk over it sorted."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["last"] == x, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(F.sort_array(values), start, step, lambda acc: acc["best"])


@F.pandas_udf(T.DoubleType())
def top_byte_share(text: pd.Series) -> pd.Series:
    """Share of the most frequent byte in the first 64 KiB; 0 without bytes."""
    out = []
    for t in text:
        data = np.frombuffer((t or "").encode("utf-8", "surrogatepass")[: 64 << 10], dtype=np.uint8)
        out.append(float(np.bincount(data).max() / len(data)) if len(data) else 0.0)
    return pd.Series(out, dtype="float64")
