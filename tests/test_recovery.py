"""Vocabulary files, recovery of builds, audits and coverage, against figures worked out by hand."""

import base64
import gzip
import json

import pytest

from corpusloom.functions import scripts as S
from corpusloom.operators import analysis as A
from corpusloom.operators import recovery as R
from corpusloom.sources import vocabularies as W
from corpusloom.sources.sinks import write_vocabulary


def tokens(df):
    return {r["token_id"]: bytes(r["token_bytes"]) for r in df.collect()}


def test_own_vocabulary_comes_back(spark, tmp_path):
    write_vocabulary(spark.createDataFrame([(265, "ab"), (266, " é"), (97, "a")], "token_id int, token string"), str(tmp_path / "v"))
    assert tokens(W.read_own(spark, str(tmp_path / "v"))) == {265: b"ab", 266: " é".encode()}


def test_foreign_vocabularies(spark, tmp_path):
    listed = {"name": "x", "tokens": [{"id": 5, "bytes_hex": "05"}, {"id": 300, "bytes_hex": "6162"}, {"id": 301, "bytes_hex": ""}, {"id": 302, "bytes_hex": "6162"}]}
    with gzip.open(tmp_path / "list.json.gz", "wt") as f:
        json.dump(listed, f)
    assert tokens(W.read_token_list(spark, str(tmp_path / "list.json.gz"))) == {300: b"ab"}
    (tmp_path / "bpe.json").write_text(json.dumps({"model": {"vocab": {"Ġthe": 0, "Ã©": 1, "Ċ": 2, "!": 3}}}, ensure_ascii=False), encoding="utf-8")
    assert tokens(W.read_byte_bpe(spark, str(tmp_path / "bpe.json"))) == {0: b" the", 1: "é".encode(), 2: b"\n", 3: b"!"}
    (tmp_path / "ranks").write_text("\n".join([base64.b64encode(b"hi").decode() + " 7", "broken", "%%% 8", base64.b64encode(b"\xff").decode() + " x", ""]))
    assert tokens(W.read_ranks(spark, str(tmp_path / "ranks"))) == {7: b"hi"}
    (tmp_path / "spm").write_text("<0x0A>\t0\n▁the\t-1\nré\t-2\n", encoding="utf-8")
    assert tokens(W.read_pieces(spark, str(tmp_path / "spm"))) == {0: b"\n", 1: b" the", 2: "ré".encode()}
    (tmp_path / "words").write_text("the\n##ing\n\nun\r\n", encoding="utf-8")
    assert tokens(W.read_word_pieces(spark, str(tmp_path / "words"))) == {0: b" the", 1: b"ing", 3: b" un"}


def test_latest_and_upserted(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 2, 20), (None, 1, 1)], "k string, generation int, v int")
    new = spark.createDataFrame([("a", 1, 11), ("b", 1, 21), ("c", 1, None)], "k string, generation int, v int")
    got = {r["k"]: r["v"] for r in R.upserted(old, new, ("k",)).collect()}
    assert got == {"a": 11, "b": 20, None: 1, "c": None}  # equals give way, later generations stay


def test_resume(spark):
    records = spark.createDataFrame([("train", 0, "t0"), ("train", 3, "t3")], "split string, shard_id int, path string")
    splits = spark.createDataFrame([("train",), ("val",), ("val",)], "split string")
    assert {r["split"]: r["next_shard"] for r in R.next_shards(records, splits).collect()} == {"train": 4, "val": 0}
    assert [r["path"] for r in R.orphans(spark.createDataFrame([("t0",), ("t9",)], "path string"), records).collect()] == ["t9"]
    assert R.after_cursor(spark.range(10), "id", 7).count() == 3
    R.same_identity({"a": "1"}, {"a": "1"})
    with pytest.raises(ValueError, match="a, b"):
        R.same_identity({"a": "1"}, {"a": "2", "b": "3"})
    saved = spark.createDataFrame([(1, 5, 2), (2, 1, 2)], "token_id int, count long, generation long")
    more = spark.createDataFrame([(2, 3), (9, 4)], "token_id int, count long")
    assert sorted(map(tuple, R.merged_frequencies(saved, more).collect())) == [(1, 5, 3), (2, 4, 3), (9, 4, 3)]
    assert {tuple(r) for r in R.merged_frequencies(saved.limit(0), more).collect()} == {(2, 3, 1), (9, 4, 1)}


def test_mismatches_and_gate(spark):
    a = spark.createDataFrame([(0, 5, "x"), (1, 6, None), (2, 7, "z"), (3, 1, "q")], "s int, n int, sha string")
    b = spark.createDataFrame([(0, 5, "x"), (1, 6, None), (2, 8, "y"), (4, 1, "q")], "s int, n int, sha string")
    got = sorted((r["s"], r["problem"]) for r in R.mismatches(a, b, ("s",)).collect())
    assert got == [(2, "n"), (2, "sha"), (3, "missing"), (4, "unknown")]
    assert R.gate(a, a.n > 0, "no tokens").count() == 4
    for sound in (a.n > 1, a.sha == "x"):  # false for one row; unknown for another
        with pytest.raises(Exception, match="no tokens"):
            R.gate(a, sound, "no tokens").collect()


def test_regressions_and_matrix(spark):
    rows = [(1, "x", "m", 12, 40, 2), (1, "x", "p", 10, 40, 2), (1, "x", "q", 10, 40, 2), (2, "x", "m", 11, 30, 1), (2, "x", "q", 10, 30, 1), (3, "y", "m", 9, 9, 1)]
    df = spark.createDataFrame(rows, "sample int, area string, model string, tokens int, bytes int, lines int")
    got = [tuple(r) for r in A.regressions(df, "m", ("q", "p")).collect()]
    assert got == [(1, 12, 10, "q", 20.0)]  # 11 is not over 1.1 times 10; the third has no rival
    matrix = {(r["area"], r["model"]): (r["tokens"], r["bytes_per_token"], r["tokens_per_line"]) for r in A.audit_matrix(df).collect()}
    assert matrix[("x", "m")] == (23, 70 / 23, 23 / 3) and matrix[("y", "m")] == (9, 1.0, 9.0)


def test_coverage(spark):
    rows = [("en", 3, [" the"]), ("en", 1, [" f", "o"]), ("en", 2, [" un", "happ", "y"]), ("de", 4, [" ja"])]
    got = {r["lang"]: tuple(r)[1:] for r in A.coverage(spark.createDataFrame(rows, "lang string, freq long, pieces array<string>")).collect()}
    assert got["en"] == pytest.approx((6, 50.0, 50.0, 8 / 3, 500 / 6))
    assert got["de"] == pytest.approx((4, 100.0, 0.0, 1.0, 0.0))


def test_table_risk(spark):
    rows = [("plain é 字",), ("ʕ",), ("\U000187f9",), ("\U00010958x",), (None,), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(S.table_risk(S.F.col("t"))).collect()]
    assert got == [False, True, True, True, False, False]
    assert sum(b - a + 1 for a, b in S.TABLE_RISK) == 4734
