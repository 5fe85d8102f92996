"""Affixes by language family, generated verb forms, space-prefixed words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Affixes of the families of the test corpus: (family, kind, affix, name of the rest, least letters left).
AFFIXES = (
    *[("GERMANIC", "PREFIX", a, "STEM", 3) for a in ("un", "re", "ver", "be", "ent", "ge", "auf", "ein")],
    *[("GERMANIC", "SUFFIX", a, "STEM", 3) for a in ("ing", "ed", "ness", "tion", "ung", "heit", "keit", "lich", "isch", "er")],
    *[("ROMANCE", "CLITIC", a, "STEM", 3) for a in ("l'", "d'", "qu'", "c'")],
    *[("ROMANCE", "SUFFIX", a, "STEM", 3) for a in ("ment", "tion", "mente", "ción", "ado", "ar", "er", "ir")],
)
FAMILY_OF = {"en": "GERMANIC", "de": "GERMANIC", "fr": "ROMANCE", "es": "ROMANCE"}
#: Roots and endings of regular Spanish verbs, for generated lexicons.
VERB_ROOTS = ("habl", "camin", "trabaj", "estudi", "cant", "mir")
VERB_ENDINGS = ("o", "as", "a", "amos", "an", "ar", "ando", "ado")


def affix_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(AFFIXES), "family string, kind string, affix string, rest string, least int")


def affix_candidates(words: DataFrame, affixes: DataFrame) -> DataFrame:
    """(word, unit, kind) for every affix that fits; words of one or two letters are roots.

    ``words`` has word and family. The affix table is a few dozen fixed rows, so
    it is broadcast and joined on the family.
    """
    lower = F.lower("word")
    n = F.length("affix")
    front = F.col("kind").isin("PREFIX", "CLITIC")
    fits = F.when(front, lower.startswith(F.col("affix"))).otherwise(lower.endswith(F.col("affix"))) & (F.length("word") >= n + F.col("least"))
    found = words.where(F.length("word") > 2).join(F.broadcast(affixes), "family").where(fits)
    rest = F.when(front, F.substring(F.col("word"), n + 1, F.length("word"))).otherwise(F.left("word", F.length("word") - n))
    units = F.explode(F.array(F.struct(F.col("affix").alias("unit"), "kind"), F.struct(rest.alias("unit"), F.col("rest").alias("kind"))))
    long = found.select("word", units.alias("u")).select("word", "u.unit", "u.kind")
    return long.unionByName(words.where(F.length("word") <= 2).select("word", F.col("word").alias("unit"), F.lit("ROOT").alias("kind")))


def verb_lexicon(spark: SparkSession, roots=VERB_ROOTS, endings=VERB_ENDINGS) -> DataFrame:
    """Every root with every ending, lower-cased and distinct."""
    both = spark.createDataFrame([(r, list(endings)) for r in roots], "root string, endings array<string>")
    return both.select("root", F.explode("endings").alias("ending")).select(F.lower(F.concat("root", "ending")).alias("word")).distinct()


def spaced(words: DataFrame) -> DataFrame:
    """Each word as it is and with a space before it."""
    return words.select(F.explode(F.array(F.col("word"), F.concat(F.lit(" "), F.col("word")))).alias("token")).distinct()
