"""Toxicity, quality and language: held-out accuracy, edge cases, defined results."""

import os
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import langid, queries, quality, toxicity
from corpusloom.llm.common import char_ngrams

DATA = os.environ.get("TEST_LLM_SF_DIR", "/root/testdata/sf0.01")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = [(1, None), (2, ""), (3, " \n "), (4, "a" * 50_000), (5, "x " * 30_000), (6, "same"), (6, "same"), (None, "no id"), (7, "!!!...\n\n"), (8, "١٢٣ 中文 é"), (9, "½ ² Ⅷ ① ٣ _ 12")]


def edge_docs(spark):
    rows = [(i, t, "en", "s", 1, "extra", 0.5) for i, t in EDGES]
    return spark.createDataFrame(rows, DOCS + ", score string, predicted double")


LARGE = os.environ.get("TEST_LLM_LARGE_DIR", "/root/testdata/sf0.1")


@pytest.mark.parametrize("name,column,bad,found,spoilt", [("op1_toxicity", "toxic", 1, 0.8, 0.02), ("op2_quality", "quality", 0, 0.9, 0.02)])
def test_held_out_accuracy(spark, name, column, bad, found, spoilt):
    """Of the held-out documents, most bad ones are found and hardly a good one is taken for bad."""
    got = queries.queries()[name](spark, LARGE).cache()
    docs = spark.read.parquet(f"{LARGE}/documents.parquet")
    assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    rows = got.where("held_out").join(spark.read.parquet(f"{LARGE}/labels.parquet").select("doc_id", column), "doc_id").collect()
    hits = [r["predicted"] == bad for r in rows if r[column] == bad]
    false = [r["predicted"] == bad for r in rows if r[column] != bad]
    assert len(hits) > 50 and np.mean(hits) >= found and np.mean(false) <= spoilt
    for r in got.limit(200).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_language_accuracy(spark):
    got = queries.op4_language(spark, DATA)
    rows = got.where("held_out").join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) >= 0.95


def toy_toxicity():
    texts = [f"fine words here {k}. and more of them {k % 7}." for k in range(60)] + [f"fine words {k}. you vile scoundrel! and more {k % 7}." for k in range(60)]
    return toxicity.train(texts, np.repeat([0.0, 1.0], 60), np.ones(120))


def test_offending_sentences_are_located(spark):
    text = "fine words. what a vile scoundrel! and more."
    docs = spark.createDataFrame([(1, text), (2, "fine words. and more.")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toy_toxicity(), spans=True).collect()}
    assert [text[s["start"] : s["end"]] for s in got[1]["offending"]] == ["what a vile scoundrel!"]
    assert got[1]["worst_sentence"] == 1 and got[1]["score"] > 0.5 > got[2]["score"] and got[2]["offending"] == []


def test_noisy_or_is_the_product():
    z = np.array([-2.0, 0.5, -9.0])
    assert toxicity.noisy_or(z) == pytest.approx(1 - np.prod(1 - toxicity.sigmoid(z)))
    assert toxicity.noisy_or(np.array([])) == 0


def test_edge_rows(spark):
    docs = edge_docs(spark)
    tox = toy_toxicity()
    for frame in (toxicity.score(docs, tox), quality.score(docs, quality.train(["good text"] * 4 + ["bad!!"] * 4, np.repeat([1.0, 0.0], 4), np.ones(8)))):
        rows = frame.collect()
        assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] == 6}) == 1
    model = langid.train(["hello there"] * 10 + ["hola amigo"] * 10, ["en"] * 10 + ["es"] * 10, np.ones(langid.BUCKETS), 20)
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (1, 2, 3, 7, 9))
    assert got[4]["lang_pred"] in ("en", "es")


def test_every_language_is_learned(spark, monkeypatch):
    """More than 200 languages, one of them with long documents only; beyond the stated number it is an error."""
    word = lambda k: "".join(chr(0x4E00 + 40 * k + j) for j in range(6))
    rows = [(3 * k + j, f"{word(k)} {word(k)[::-1]} {j}", f"l{k:03}", "s", 1) for k in range(220) for j in range(3)]
    rows += [(9000 + j, "lengthy " * 3000, "long", "s", 1) for j in range(3)] + [(None, f"{word(230)}", "none", "s", 1)] * 2
    docs = spark.createDataFrame(rows, DOCS)
    seen = {}
    monkeypatch.setattr(langid, "train", lambda texts, langs, *_: seen.update(texts=texts, langs=langs))
    langid.fit(docs, F.lit(True), max_rows=444)
    assert sorted(seen["langs"]) == sorted([f"l{k:03}" for k in range(220)] * 2 + ["long", "none"])
    assert [len(t) for t, x in zip(seen["texts"], seen["langs"]) if x == "long"] == [24_000]
    langid.fit(docs, F.lit(True), max_rows=1)
    assert len(seen["langs"]) == 222
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 221)
    with pytest.raises(ValueError):
        langid.fit(docs, F.lit(True))


def test_filters_keep_columns(spark):
    docs = edge_docs(spark)
    kept = toxicity.keep_clean(docs, toy_toxicity())
    assert kept.schema == docs.schema and kept.count() == len(EDGES)
    none = quality.keep_good(docs, quality.train([], np.zeros(0), np.zeros(0)), threshold=0.9)
    assert none.schema == docs.schema and none.count() == 0


def test_without_labels_or_rows(spark):
    docs, labels = edge_docs(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels, F.lit(True))).count() == len(EDGES)
    assert quality.score(docs, quality.fit(docs, labels, F.lit(True))).count() == len(EDGES)
    empty = docs.limit(0)
    model = langid.fit(empty, F.lit(True))
    assert langid.predict(docs, model).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(empty, model).count() == 0 and toxicity.score(empty, toy_toxicity()).count() == 0


def test_sample_is_bounded_and_the_fold_unseen(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    from corpusloom.llm.common import fold, labelled_sample

    texts, y, w = labelled_sample(docs, labels, "toxic", fold(F.col("doc_id"), 5) != 0, 40, 1000)
    assert len(texts) == 40 and y.sum() == 20
    assert all(zlib.crc32(t.split()[1].encode()) % 5 for t in texts)
    assert (w * y).sum() / w.sum() == pytest.approx(1 / 3, abs=0.03)


def test_sample_is_taken_among_the_documents_at_hand(spark):
    """Labels of other documents take no place; long texts teach; a repeated id has one text."""
    from corpusloom.llm.common import labelled_sample

    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    rows = [(k, f"text {k}") for k in range(2990, 3000)] + [(2990, "another"), (None, "none"), (2980, "long " * 50_000), (2981, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    texts, y, _ = labelled_sample(docs, labels, "toxic", F.lit(True), 40, 600_000)
    assert len(texts) == 11 and y.sum() == 5 and max(map(len, texts)) == 250_000
    assert len({"another", "text 2990"} & set(texts)) == 1
    assert labelled_sample(docs.limit(0), labels, "toxic", F.lit(True), 40, 100)[0] == []


def plain_ngrams(word, low, high, buckets, whole):
    """Hashed n-grams of one fenced word in plain Python."""
    mask, base, mix = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD
    points, out = [ord(c) for c in f"<{word}>"], []
    for n in range(low, high + 1):
        for k in range(len(points) - n + 1):
            h = 0
            for p in points[k : k + n]:
                h = (h * base + p + 1) & mask
            out.append((h + n) & mask)
    if whole:
        out.append(sum(p * pow(base, k, 1 << 64) for k, p in enumerate(points)) % (1 << 64) ^ mix)
    mixed = [((h ^ (h >> 33)) * mix) & mask for h in out]
    return [(h ^ (h >> 29)) % buckets for h in mixed]


SAMPLES = ["Fine words. You VILE scoundrel! more\n\nwords...and", "one", "", "ein zwei zwei drei. vier? fünf", "a" * 200 + " b. c"]


PARTED = ["Fine words here. You vile man! more words " * 6, "ein zwei zwei drei. vier? " * 9, "", "one"]


@pytest.mark.parametrize("part,samples", [(1 << 20, SAMPLES), (40, PARTED)])
def test_toxicity_scores_equal_plain_python(monkeypatch, part, samples):
    """Sentence by sentence, feature by feature; long texts in parts as well."""
    monkeypatch.setattr(toxicity, "PART_CHARS", part)
    model = toxicity.ToxicityModel(np.random.default_rng(1).normal(size=toxicity.BUCKETS).astype(np.float32) * 0.05, -1.0)

    def plain(text):
        keep, z, open_end = 1.0, None, False
        for run in re.findall(r"\w{1,64}|[.!?\n]+", text.lower()):
            if run[0] in ".!?\n":
                keep, z = keep * (1 - 1 / (1 + np.exp(-(z if z is not None else model.bias)))), None
                continue
            z = (model.bias if z is None else z) + sum(float(model.weights[i]) for i in plain_ngrams(run, toxicity.LOW, toxicity.HIGH, toxicity.BUCKETS, True))
        ended = re.search(r"[.!?\n]\W*$", text)
        if z is not None or not re.search(r"[\w.!?\n]", text):
            keep *= 1 - 1 / (1 + np.exp(-(z if z is not None else model.bias)))
        assert ended or z is not None or not text
        return 1 - keep

    judge = toxicity.Judge(model)
    got = [toxicity.noisy_or(z) for z in judge.logits(samples)]
    assert got == pytest.approx([plain(t) for t in samples], rel=1e-6)


@pytest.mark.parametrize("part,samples", [(1 << 20, SAMPLES), (40, PARTED)])
def test_quality_scores_equal_plain_python(monkeypatch, part, samples):
    monkeypatch.setattr(quality, "PART_CHARS", part)
    rng = np.random.default_rng(2)
    model = quality.QualityModel(rng.normal(size=(quality.BUCKETS, 4)).astype(np.float32), rng.normal(size=(2, 4)).astype(np.float32), np.array([0.1, -0.2]))

    def plain(text):
        total, n, last = np.zeros(4), 0, None
        for word in text.split():
            token, last = (quality.REPEAT if word == last else word), word
            for k in range(0, len(token), quality.TOKEN_CHARS):
                for i in plain_ngrams(token[k : k + quality.TOKEN_CHARS], quality.LOW, quality.HIGH, quality.BUCKETS, True):
                    total, n = total + model.vectors[i], n + 1
        z = model.output @ (total / max(n, 1)) + model.bias
        return np.exp(z[1]) / np.exp(z).sum()

    assert quality.scorer(model)(samples) == pytest.approx([plain(t) for t in samples], rel=1e-5)


@pytest.mark.parametrize("part,samples", [(1 << 20, SAMPLES), (40, PARTED)])
def test_language_scores_equal_plain_python(monkeypatch, part, samples):
    monkeypatch.setattr(langid, "PART_CHARS", part)
    rng = np.random.default_rng(3)
    model = langid.LanguageModel(["a", "b", "c"], rng.uniform(1, 3, langid.BUCKETS), rng.normal(size=(langid.BUCKETS, 3)).astype(np.float32) * 0.01, np.array([0.0, 0.3, -0.1]), 1.7)

    def plain(text):
        z, n = np.zeros(3), 0
        for word in re.findall(r"[^\W\d_]{1,32}", text.lower()):
            letters = "".join(c for c in word if unicodedata.category(c)[0] == "L")
            for i in plain_ngrams(letters, langid.LOW, langid.HIGH, langid.BUCKETS, False) if letters else ():
                z, n = z + model.weights[i] * model.idf[i], n + 1
        if not n:
            return "und", 0.0
        e = np.exp((langid.SCALE * z / n + model.bias) / model.temperature)
        return model.languages[int(e.argmax())], e.max() / e.sum()

    from corpusloom.llm.common import WordTable

    texts = [*samples, "x² ½ eine Ⅷ"]
    got = [model.predict(t) for t in langid.document_rows(texts, WordTable(model.word_rows, 4))]
    assert [g[0] for g in got] == [plain(t)[0] for t in texts] and [g[1] for g in got] == pytest.approx([plain(t)[1] for t in texts], rel=1e-5)


def test_training_tells_the_labels_apart():
    texts, y = ["vile words. calm here", "calm here. calm words", "vile here", "calm calm"], np.array([1.0, 0.0, 1.0, 0.0])
    model = toxicity.train(texts * 3, np.tile(y, 3), np.ones(12))
    judge = toxicity.Judge(model)
    p = [toxicity.noisy_or(z) for z in judge.logits(texts)]
    assert p[0] > 0.9 and p[2] > 0.9 and p[1] < 0.1 and p[3] < 0.1


def test_long_words_take_little_memory():
    import tracemalloc

    judge = toxicity.Judge(toxicity.ToxicityModel(np.zeros(toxicity.BUCKETS, dtype=np.float32), -5.0))
    tracemalloc.start()
    list(judge.logits(["a" * 4_000_000, "!" * 4_000_000]))
    assert tracemalloc.get_traced_memory()[1] < 300_000_000
    tracemalloc.stop()


def test_ngram_rows_hold_every_fenced_ngram():
    words = ["idiot", "", "é", "中文字", "idiot"]
    indptr, index = char_ngrams(words, 2, 3, 1 << 20)
    count = [sum(max(0, len(w) + 2 - n + 1) for n in (2, 3)) + 1 for w in words]
    assert np.diff(indptr).tolist() == count
    rows = [set(index[a:b]) for a, b in zip(indptr, indptr[1:])]
    assert rows[0] == rows[4] and not rows[0] & rows[3]


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    s = rng.normal(size=(400, 3))
    p = np.exp(s) / np.exp(s).sum(axis=1, keepdims=True)
    y = [int(rng.choice(3, p=q)) for q in p]
    assert langid.temperature([(4 * a, b) for a, b in zip(s, y)]) == pytest.approx(4, rel=0.35)
    assert langid.temperature([]) == 1.0
