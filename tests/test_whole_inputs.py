"""Queries over unfiltered input, held against plain Python."""

import pytest

from corpusloom.operators import vocabulary as V
from corpusloom.plans import catalogue

TEXTS = ["the sun flower sunflower sunflowerfield field the sun the sun", "rare word sun flower sun flower sun flower", "слово word", None]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    rows = [(k, t, None if k == 1 else "en", None if k > 1 else "web", len(t or "")) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def brute_compositions(word, pool):
    first, n = (lambda p: p in pool or " " + p in pool), len(word)
    two = [(word[:i], word[i:]) for i in range(1, n) if first(word[:i]) and word[i:] in pool]
    three = [(word[:i], word[i:j], word[j:]) for i in range(1, n - 1) for j in range(i + 1, n) if first(word[:i]) and word[i:j] in pool and word[j:] in pool]
    return two[:6] + three[:4]


def test_word_compositions(spark):
    words = ["a", "ab", "abc", "aaaaaaaaaaaaaaaaaaaa", "sunflowerfield", "цветок", "x" * 5000]
    pool = ["a", "aa", "aaa", "b", "c", "ab", " sun", "flower", "field", "flowerfield", "цве", "то", "к", "ток", "", " "]
    made = V.word_compositions(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(p,) for p in pool], "token string"))
    got = sorted((r["word"], tuple(r["pieces"])) for r in made.collect())
    assert got == sorted((w, p) for w in words for p in brute_compositions(w, set(pool)))


def test_queries_take_all_input(spark, folder):
    split = {(r["word"], tuple(r["pieces"])) for r in catalogue.queries()["word_splits"](spark, folder).collect()}
    assert ("sunflowerfield", ("sunflower", "field")) in split  # longer than 12 characters
    kept = {r["token"]: r["freq"] for r in catalogue.queries()["pruned_vocabulary"](spark, folder).collect()}
    assert kept["rare"] == 1 and kept["sun flower"] == 4 and "the sun" not in kept and "слово" not in kept
    labels = {r["doc_id"]: dict(zip(r["label_names"], r["label_values"])) for r in catalogue.queries()["label_projection"](spark, folder).collect()}
    assert labels == {0: {"language": "en", "source": "web"}, 1: {"source": "web"}, 2: {"language": "en"}, 3: {"language": "en"}}
