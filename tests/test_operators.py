"""Goldens and brute-force comparisons of the library's own operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import scripts as S
from corpusloom.functions import text as X
from corpusloom.operators import analysis as A
from corpusloom.operators import documents as D
from corpusloom.operators import encoding as E
from corpusloom.operators import vocabulary as V


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(df, column):
    return [r[column] for r in df.collect()]


def test_pretoken_golden(spark):
    text = "Hello  world's 12345 x+=1;\n\n  नमस्ते दुनिया 中文分词 日本語カナ 한국어 a"
    want = ["Hello", " ", " world's", " ", "123", "45", " x", "+=", "1", ";\n\n", " ", " नमस्ते", " दुनिया", " 中文分词", " 日本語カナ", " 한국어", " a"]
    assert frame(spark, [(text,)], "t string").select(X.pretokens("t").alias("c")).first()["c"] == want


@pytest.mark.parametrize("text", ["a\x1cb\x1f c\x85d", "ⅷ ½ ٣٤٥٦ １２３４", "don't WE'LL it's", "　　", "é ö ǅ", "", "👩‍🚀 x", "\tzz\r\n\r\n"])
def test_pretokens_are_lossless(spark, text):
    assert "".join(frame(spark, [(text,)], "t string").select(X.pretokens("t").alias("c")).first()["c"]) == text


def test_words_split_like_python(spark):
    texts = ["a\x1cb\x1f c\x85d", " x  y\n", "", "　x y"]
    got = values(frame(spark, [(t,) for t in texts], "t string").select(X.words("t").alias("w")), "w")
    assert got == [t.split() for t in texts]


TOY = {b"ab": 265, b"abc": 266, b"cd": 267, b"d e": 268}


def test_encoder_goldens():
    e = E.Encoder(TOY)
    assert e.fewest(b"abcd") == [265, 267]  # the earlier start wins among equals
    assert e.greedy(b"abcd") == [266, 100]
    assert e.greedy(b"d e") == e.fewest(b"d e") == [268]
    assert e.decode([265, 267, 258]) == b"abcd<|eos|>"


def test_bounded_encoding_stops_at_chunks(spark):
    vocabulary = frame(spark, [(k.decode(), v) for k, v in TOY.items()], "token string, token_id int")
    docs = frame(spark, [(1, "d e"), (2, None), (3, "abcd")], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in E.encode(docs, vocabulary, eos=True).collect()}
    assert got == {1: [100, 32, 101, 258], 2: [258], 3: [265, 267, 258]}
    whole = {r["doc_id"]: r["ids"] for r in E.encode(docs, vocabulary, "minimal").collect()}
    assert whole[1] == [268]


def test_pack21_inverts():
    ids = np.random.default_rng(7).integers(0, 1 << 21, 101)
    data = E.pack21(ids)
    assert len(data) == -(-101 // 8) * 21
    assert (E.unpack21(data, 101) == ids).all()
    assert E.pack21([]) == b"" and len(E.unpack21(b"", 0)) == 0
    with pytest.raises(ValueError):
        E.pack21([1 << 21])


def test_splitmix_golden():
    assert int(A.splitmix64(np.array([42], dtype=np.uint64))[0]) == 13679457532755275413


def test_split_golden(spark):
    row = D.assign_split(D.fingerprint(frame(spark, [(1, "abc")], "doc_id long, text string")), 0.005).select(X.hash_fraction("content_sha256").alias("f"), "split").first()
    assert row["f"] == pytest.approx(0.7283949105904022) and row["split"] == "train"


def test_quality_flags(spark):
    prose = "the quick brown fox jumps over a lazy dog while seven small birds sing in old trees today again"
    rows = [
        (1, prose, "a.txt"), (2, "short", "a.txt"), (3, None, "a.txt"), (4, "", "a.txt"), (5, "x = 1; y = 2;;;;", "b.json"), (6, "one two three " * 20, "a.txt"),
        (7, "*** " * 60, "a.txt"), (8, "a" * 400, "a.txt"),
    ]
    got = {r["doc_id"]: r for r in D.dispositions(D.quality_flags(frame(spark, rows, "doc_id long, text string, source string"))).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {1: None, 2: "short", 3: "ambiguous", 4: "empty", 5: None, 6: "extreme_repetition", 7: "extreme_repetition", 8: "short"}
    assert got[7]["noisy_symbols"] and got[5]["is_code"] and got[8]["extreme_repetition"]
    loose = {r["doc_id"]: r["short"] for r in D.quality_flags(frame(spark, rows, "doc_id long, text string, source string"), pruning=False).collect()}
    assert loose[2] and not loose[1]


def test_strict_code_paths(spark):
    rows = frame(spark, [("data.csv",), ("main.c",), ("x.jsonl",)], "source string").withColumn("text", F.lit("plain"))
    assert values(rows.select(D.is_code(F.col("text"), F.col("source")).alias("c")), "c") == [True, True, True]
    assert values(rows.select(D.is_code(F.col("text"), F.col("source"), strict=True).alias("c")), "c") == [False, True, False]


def test_running_sum(spark):
    """Sparse, repeated and null orders, null values: every row keeps its place."""
    rows = [(k * k * 1_000_003, 3 * k + 1) for k in range(50)] + [(16_000_048, 5), (16_000_048, None), (None, 7), (None, 9)]
    got = D.running_sum(frame(spark, rows, "k long, v int").repartition(5), "k", "v", "s").collect()
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0))
    want = [(*r, sum(v or 0 for _, v in ordered[:i])) for i, r in enumerate(ordered)]
    assert sorted(map(repr, ((r["k"], r["v"], r["s"]) for r in got))) == sorted(map(repr, want))
    assert D.running_sum(frame(spark, [], "k long, v int"), "k", "v", "s").count() == 0


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_shard_fold_is_the_same_in_blocks(block):
    rng = np.random.default_rng(4)
    for target in (1, 7, 100, 10_000):
        val, tokens = rng.integers(0, 2, 300).astype(np.uint8), rng.integers(0, 60, 300).astype(np.int64)
        fold, starts = D.ShardFold(target), [0]
        for k in range(0, 300, block):
            starts += fold.feed(val[k : k + block], tokens[k : k + block])
        fill, group, want = [0, 0], 0, [0]
        for k, (s, n) in enumerate(zip(val, tokens)):
            if fill[s] and fill[s] + n > target:
                fill = [0, 0]
                want.append(k)
            fill[s] += n
            if fill[s] >= target:
                fill = [0, 0]
                want.append(k + 1)
        assert starts == want


def test_shard_fold(spark):
    rng = np.random.default_rng(3)
    rows = [(k, "val" if rng.random() < 0.3 else "train", int(rng.integers(1, 40))) for k in range(200)] + [(200, "train", 500)]
    got = {r["doc_id"]: (r["shard_id"], r["token_offset"]) for r in D.pack_shards(frame(spark, rows, "doc_id long, split string, n_tokens int"), 100).collect()}
    fill, group = {"train": 0, "val": 0}, 0
    for k, split, n in rows:
        if fill[split] and fill[split] + n > 100:
            group, fill = group + 1, {"train": 0, "val": 0}
        assert got[k] == (group, fill[split])
        fill[split] += n
        if fill[split] >= 100:
            group, fill = group + 1, {"train": 0, "val": 0}


def test_near_duplicates_equal_the_sequential_fold(spark):
    rng = np.random.default_rng(5)
    pool = [f"w{k}" for k in range(400)]
    texts = []
    for k in range(160):
        if k % 4 and texts:
            words = texts[int(rng.integers(len(texts)))].split()
            for _ in range(int(rng.integers(0, 12))):
                words[int(rng.integers(len(words)))] = str(rng.choice(pool))
        else:
            words = [str(w) for w in rng.choice(pool, int(rng.integers(2, 60)))]
        texts.append(" ".join(words))
    rows = [(k, t, k % 5 == 0) for k, t in enumerate(dict.fromkeys(texts))]
    got = {r["doc_id"]: (r["matching_bands"], r["is_near_duplicate"]) for r in D.near_duplicates(frame(spark, rows, "doc_id long, text string, is_code boolean")).collect()}
    seen: set = set()
    for k, t, code in rows:
        mine = set(enumerate(D.band_values(t.split())))
        matching = len(mine & seen)
        rejected = matching >= (12 if code else 3)
        assert got[k] == (matching, rejected), k
        if not rejected:
            seen |= mine
    assert any(r for _, r in got.values())


def test_entropy_patches(spark):
    bits = [10.0, 35.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 50.0, 3.0]
    got = frame(spark, [(bits,)], "b array<double>").select(A.entropy_patches(F.col("b"), F.col("b"), 40.0).alias("l")).first()["l"]
    assert got == [2, 8, 1, 1]


def test_scripts_and_types(spark):
    chars = {"a": "LATIN", "é": "LATIN", "5": "NUMERIC", "٣": "NUMERIC", ".": "PUNCTUATION_SPACE", "я": "CYRILLIC", "न": "DEVANAGARI", "中": "CJK_HAN", "カ": "JAPANESE_KANA", "한": "HANGUL", "α": "GREEK", "€": "EMOJI_SYMBOL"}
    got = {r["c"]: r["s"] for r in frame(spark, [(c,) for c in chars], "c string").select("c", S.char_script(F.col("c")).alias("s")).collect()}
    assert got == chars
    tokens = {
        "x": "RAW_BYTE", "<|eos|>": "SPECIAL_CONTROL", "  ": "WHITESPACE_FACTOR", "https://a.b": "URL_EMAIL", "a@b.cd": "URL_EMAIL", "$12.50": "CURRENCY", "2024-01-02": "DATE_TIME",
        "12.5": "NUMBER", "def": "CODE_SYNTAX", "...": "PUNCTUATION", "new york": "MULTI_WORD_PHRASE", " world": "WHITESPACE_FACTOR", "é": "UNICODE_CHAR", "##ing": "MORPHOLOGY_UNIT",
        "NASA": "CASE_FACTOR", "bhai": "TRANSLITERATION_UNIT", "cat": "SUBWORD", "house": "WHOLE_WORD", "a1b2": "SUBWORD",
    }
    got = {r["t"]: r["k"] for r in frame(spark, [(t,) for t in tokens], "t string").select("t", S.token_type(F.col("t")).alias("k")).collect()}
    assert got == tokens
    pool = {" house": "SPACE_WORD", "a b": "MULTIWORD", "नम": "INDIC", "中": "CJK", "да": "CYRILLIC", "while": "CODE", "thing": "ROMANIZED", "é": "CHARACTER", "word": "WORD", "ab": "SUBWORD"}
    got = {r["t"]: r["k"] for r in frame(spark, [(t,) for t in pool], "t string").select("t", S.structural_type(F.col("t")).alias("k")).collect()}
    assert got == pool


def test_pieces_and_byte_letters(spark):
    got = values(frame(spark, [("<0x41>",), ("▁hi",)], "p string").select(V.spm_piece(F.col("p")).alias("b")), "b")
    assert [bytes(b) for b in got] == [b"A", b" hi"]
    assert E.byte_letter_bytes("Ġa→") == b" a"


def test_allocation_guarantees_scripts(spark):
    rows = [("aaa", "en", 100), ("bbb", "en", 90), ("ccc", "en", 80), ("नमस", "hi", 2)]
    long = frame(spark, rows, "token string, lang string, freq long")
    assert values(V.allocate(long, "c", 2, guarantee=1).orderBy("rank"), "token") == ["aaa", "नमस"]
    assert values(V.allocate(long, "a", 2).orderBy("rank"), "token") == ["aaa", "bbb"]
    with pytest.raises(ValueError):
        V.allocate(long, "z", 2)


def test_extraction_priority(spark):
    rows = frame(spark, [("t", None, None, None), (None, "q", "a", None), (None, None, None, "m")], "text string, prompt string, response string, meta string")
    got = D.extract_text(rows, ("text", "prompt", "response")).collect()
    assert [r["text"] for r in got] == ["t", "<|field:prompt|>\nq\n<|end_field|>\n<|field:response|>\na\n<|end_field|>", None]
    assert got[2]["ambiguity"] == "no configured text field; string fields=['meta']"


def test_candidate_metrics_golden(spark):
    """Entropy over all languages of the corpus, by hand: of two even ones among four it is a half."""
    long = frame(spark, [("ab", "en", 4), ("ab", "de", 4), ("x", "fr", 1), ("y", "es", 1), ("abc", "en", 2)], "token string, lang string, freq long")
    got = {r["token"]: r for r in V.candidate_metrics(long).collect()}
    assert got["ab"]["entropy"] == pytest.approx(0.5) and got["abc"]["entropy"] == 0
    assert (got["ab"]["bytes_saved"], got["abc"]["positions_saved"], got["x"]["bytes_saved"]) == (8, 4, 0)
    assert {r["collision_risk"] for r in got.values()} == {0.0}
    one = V.candidate_metrics(frame(spark, [("ab", "en", 4)], "token string, lang string, freq long")).first()
    assert one["entropy"] == 0


def test_fair_allocation_golden(spark):
    """Utility by hand: weights sqrt(10 / 10) and sqrt(10 / 2.5), no halving without a collision risk."""
    long = frame(spark, [("aaa", "en", 6), ("bb", "en", 4), ("bb", "de", 1), ("cc", "de", 1)], "token string, lang string, freq long")
    got = {r["token"]: r["score"] for r in V.allocate(long, "e", 5).collect()}
    fair = np.sqrt(10 / 2)
    spread = -(0.8 * np.log2(0.8) + 0.2 * np.log2(0.2))
    assert got == {"aaa": pytest.approx(12.0), "bb": pytest.approx((4 + fair) * (1 + 1.2 * spread), abs=1e-5), "cc": pytest.approx(fair, abs=1e-5)}


def test_nul_heavy_counts_bytes(spark):
    rows = [("é" * 40_000 + "\0" * 5000,), ("a" * 900 + "\0" * 10,), ("a" * 990 + "\0" * 9,), ("10 02 00 0",), (None,), ("\0" * 50,)]
    got = D.quality_flags(frame(spark, [(*r, "s") for r in rows], "text string, source string"), pruning=False).collect()
    assert [r["nul_heavy"] for r in got] == [False, True, False, False, False, True]


def test_near_duplicates_settle_on_long_chains(spark):
    """A chain in which each text shares words with the next only."""
    words = [f"w{k}" for k in range(900)]
    rows = [(k, " ".join(words[3 * k : 3 * k + 24]), False) for k in range(260)] + [(300, None, False), (301, None, False)]
    got = D.near_duplicates(frame(spark, rows, "doc_id long, text string, is_code boolean")).collect()
    assert len(got) == 261


def test_tokens_are_inserted_in_order(spark):
    base = frame(spark, [(b"a", 300), (b"b", 7)], "token_bytes binary, token_id int")
    tokens = frame(spark, [(b"c", 2), (b"a", 1), (b"d", 1), (b"c", 0), (b"", 0), (None, 0)], "token_bytes binary, order int")
    assert {bytes(r["token_bytes"]): r["token_id"] for r in V.inserted(base, tokens).collect()} == {b"a": 300, b"b": 7, b"c": 301, b"d": 302}
    assert {bytes(r["token_bytes"]): r["token_id"] for r in V.inserted(base.limit(0), tokens, 5).collect()} == {b"c": 5, b"a": 6, b"d": 7}


def test_chunks_are_encoded_as_lists(spark):
    vocabulary = frame(spark, [("ab", 265), ("abc", 266), ("cd", 267)], "token string, token_id int")
    docs = frame(spark, [(1, "abcd abcd"), (2, None), (3, "")], "doc_id long, text string")
    for mode in E.MODES:
        got = {r["doc_id"]: r["ids"] for r in E.encode(docs, vocabulary, mode).collect()}
        assert got[2] == [] and got[3] == [] and len(got[1]) == 5
    back = E.encode(docs, vocabulary).select("doc_id", E.decode(F.col("ids"), vocabulary).alias("t")).collect()
    assert {r["doc_id"]: r["t"] for r in back} == {1: "abcd abcd", 2: "", 3: ""}
    assert [r["t"] for r in frame(spark, [([97, None, -5, 10**6, 258],), (None,)], "ids array<int>").select(E.decode(F.col("ids"), vocabulary).alias("t")).collect()] == ["a<|eos|>", None]
