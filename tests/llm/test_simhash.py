"""SimHash fingerprints and components against brute force."""

import os
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import components, simhash
from corpusloom.llm import queries as Q

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    out = 0
    for bit in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(s.encode(), 42) >> bit & 1 for s in shingles) > len(shingles):
            out |= 1 << bit
    return out


def brute_components(prints):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= simhash.LIMIT and root(a) != root(b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "A b C", "one two three four", "ÀÉ İ ß a\x1cb c\x85d e f", "x y z w " * 300, "a\u00a0b c d e\u3000f g"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert simhash.fingerprint(text, piece=3) == plain_fingerprint(text)


def test_query_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t) for i, t in docs.items()}
    want = brute_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in Q.op3_simhash(spark, DATA).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in docs}


def flip(rng, fp, n):
    for b in rng.choice(64, n, replace=False):
        fp ^= 1 << int(b)
    return fp


@pytest.mark.parametrize("hot,full", [(100, 4096), (3, 1000), (3, 5)])
def test_links_connect_what_brute_force_connects(spark, hot, full):
    """Random neighbourhoods, chains at the limit and one crowded group, with and without longer keys."""
    rng = np.random.default_rng(hot)
    prints = [0, (1 << 64) - 1, 1]
    for _ in range(60):
        fp = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(2))
        prints.append(fp)
        for _ in range(int(rng.integers(0, 4))):
            fp = flip(rng, fp, int(rng.integers(1, 7)))
            prints.append(fp)
    centre = int(rng.integers(0, 1 << 63))
    prints += [flip(rng, centre, int(rng.integers(1, 5))) for _ in range(60)]
    prints = list(dict.fromkeys(prints))
    want = brute_components(dict(enumerate(prints)))
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    number = {s: k for k, s in enumerate(signed)}
    edges = [(number[r["u"]], number[r["v"]]) for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), hot, full).collect()]
    assert all((prints[a] ^ prints[b]).bit_count() <= 4 for a, b in edges)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {k: got.get(k, k) for k in want} == want


def test_spanning_links_are_a_forest():
    import pandas as pd

    fps = np.arange(16, dtype=np.int64) << 52  # all within four bits of each other, in the last segment of the chain
    pdf = pd.DataFrame({"start": 0, "key": 0, "fp": np.concatenate([fps, fps]), "side": [0] * 16 + [1] * 16})
    assert len(simhash.spanning_links(pdf)) == 15


def test_components_of_long_chains(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100, 103), (103, 101), (200, 200)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100, 103: 100}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_edge_rows(spark):
    rows = [(5, None), (3, ""), (9, "  "), (2, "only one"), (4, "only one"), (4, "only one"), (None, "only one"), (7, "x y z " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("component_id", F.lit("x"))
    got = sorted(((r["doc_id"] or -1, r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()))
    assert len(got) == len(rows)
    assert {c for i, _, c in got if i in (3, 5, 9)} == {3} and {f for i, f, _ in got if i in (3, 5, 9)} == {"0" * 16}
    assert {c for i, _, c in got if i in (2, 4, -1)} == {2}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [2, 3, 7]


def test_one_row_of_each_component_stays(spark):
    """Repeated and null ids: rows are told apart by their fingerprints, no text is lost."""
    rows = [(1, "a b c d"), (2, "a b c d"), (2, "another text"), (5, "third one"), (5, "third one"), (None, "fourth"), (None, "fourth"), (None, "fifth"), (None, "a b c d"), (7, None), (7, ""), (6, "x y")]
    docs = spark.createDataFrame([(i, t, str(k)) for k, (i, t) in enumerate(rows)], "doc_id int, text string, _id string")
    kept = simhash.keep_one(docs)
    got = kept.collect()
    assert kept.columns == docs.columns and kept.schema["doc_id"] == docs.schema["doc_id"]
    assert sorted(((r["doc_id"] or -1, r["text"] or "") for r in got)) == [(-1, "fifth"), (-1, "fourth"), (1, "a b c d"), (2, "another text"), (5, "third one"), (6, "x y"), (7, "")]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_heavy_keys_are_joined_where_they_lie(spark):
    rows = spark.range(500).select(F.when(F.col("id") < 300, 1).otherwise(F.col("id")).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = components.join_weighted(rows, facts, "k", "n", 500)
    assert sorted((r["k"], r["id"], r["top"]) for r in got.collect()) == sorted((1 if i < 300 else i, i, 299 if i < 300 else i) for i in range(500))
    star = [(0, k) for k in range(1, 400)] + [(k, 1000 + k) for k in range(1, 200)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(star, "u long, v long")).collect()}
    assert found == {x: 0 for edge in star for x in edge}
