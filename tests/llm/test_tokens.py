"""Byte-level BPE and packing against the tokenizer library and brute force."""

import hashlib
import os
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import bpe, packing
from corpusloom.llm import queries as Q

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PATH = Q.vocabulary_path()
EDGES = [(1, None), (2, ""), (3, " "), (4, "a" * 3000), (5, " x" * 4000), (6, "twin"), (6, "twin"), (None, "no id"), (7, "é中👩‍🚀\x00\x1c\u0301 <|endoftext|> 's 'll")]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def in_chunks(machine, text, step):
    return [i for ids in machine.encode(text[k : k + step] for k in range(0, len(text), step)) for i in ids.tolist()]


PARTS = ["x" * 700, " " * 700, "!" * 600, "\n" * 600, "<|end", "r", "e", "a", "b", " ", "  ", "\n", "\t", "'", "'s", "'re", "'l", "é", "the", " of", "1", "23", "!", "…", "\xa0", "\x1c", "\u3000", "中", "👩", "\u0301", "<|endoftext|>", "ing", "\U00010d40", "Ᲊ", "x" * 7]


def test_encoding_equals_the_library(library):
    _, machine, table = bpe.loaded(PATH)
    rng = random.Random(1)
    for _ in range(800):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))
        want = ids_of(library, text)
        assert machine.feed([bpe.Stream()], [text], [True])[0].tolist() == want, text
        assert in_chunks(machine, text, rng.choice((1, 2, 3, 4) if len(text) < 100 else (100, 700, 1500))) == want, text
        assert "".join(bpe.decode_pieces(np.array(want, dtype=np.int64), table, 3)) == library.decode(want, skip_special_tokens=False)


def test_long_pretokens_need_a_window_only(library):
    """A pre-token without an end goes through the window: its stable ids come before it is over."""
    merges, machine, _ = bpe.loaded(PATH)
    rng = random.Random(2)
    for kind in ("abcdethionrs", "a", "=", "-_", "\n", "中文字"):
        text = "".join(rng.choice(kind) for _ in range(6000))
        stream, most, out, early = bpe.Stream(), 0, [], 0
        for k in range(0, len(text), 50):
            out += machine.feed([stream], [text[k : k + 50]], [False])[0].tolist()
            most = max(most, len(stream.window) + 3 * len(stream.tail))
        early = len(out)
        out += machine.feed([stream], [""], [True])[0].tolist()
        assert out == ids_of(library, text)
        assert most <= merges.window + 3 * (bpe.OPEN_CHARS + 50) and early > 0.7 * len(out)


def test_many_streams_at_once(library):
    machine, rng = bpe.loaded(PATH)[1], random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9))) for _ in range(40)]
    streams, out = [bpe.Stream() for _ in texts], [[] for _ in texts]
    for k in range(0, 3000, 150):
        for row, ids in zip(out, machine.feed(streams, [t[k : k + 150] for t in texts], [False] * len(texts))):
            row += ids.tolist()
    for row, ids in zip(out, machine.feed(streams, [t[3000:] for t in texts], [True] * len(texts))):
        row += ids.tolist()
    assert out == [ids_of(library, t) for t in texts]


def test_a_full_memo_gives_way_without_changing_ids(library):
    rng = random.Random(5)
    machine = bpe.Transducer(bpe.Merges.load(PATH), limit=40)
    for _ in range(12):
        texts = ["".join(rng.choices(PARTS[4:], k=rng.randrange(30))) for _ in range(40)]
        found = machine.feed([bpe.Stream() for _ in texts], texts, [True] * len(texts))
        assert [f.tolist() for f in found] == [ids_of(library, t) for t in texts]
    assert machine.older


def test_memory_is_constant_on_a_long_text():
    """50 MB in one row: what is held beside the text is a small part of it and doesn't grow with it."""
    merges, _, table = bpe.loaded(PATH)
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(120, 250))) for _ in range(3000)] + ["x" * 40_000]
    text = " ".join(rng.choice(words) for _ in range(300_000))[:50_000_000]
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])
    trip, machine, held = bpe.RoundTrip(table, False), bpe.Transducer(merges), []
    tracemalloc.start()
    for _, _, ids, end in machine.rows(batch, 1):
        trip.feed(ids)
        held.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.reset_peak()
    tracemalloc.stop()
    assert end and trip.finish()[2] == hashlib.sha256(text.encode()).hexdigest()
    assert max(held) < 30_000_000 and max(held[100:]) < 1.3 * max(held[:100])


def test_lists_without_a_bound_are_refused():
    tokens = {ord(c): c.encode() for c in "abc"} | {1: b"ab", 2: b"abc", 3: b"bc"}
    for rules in ([(1, ord("c"), 2), (ord("a"), ord("b"), 1)], [(ord("a"), ord("b"), 1), (1, ord("c"), 2), (ord("b"), ord("c"), 3), (ord("a"), 3, 2)]):
        with pytest.raises(ValueError):
            bpe.Merges(tokens, rules, {})


def test_lossy_decoding_equals_the_library(library):
    table = bpe.loaded(PATH)[2]
    rng = random.Random(3)
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(20)]
        assert "".join(bpe.decode_pieces(np.array(ids), table, 2)) == library.decode(ids, skip_special_tokens=False)


def toy(rules):
    tokens, merges = {ord(c): c.encode() for c in "abc"}, []
    for k, (u, v) in enumerate(rules):
        tokens[1000 + k] = u.encode() + v.encode()
        back = {t: i for i, t in tokens.items()}
        merges.append((back[u.encode()], back[v.encode()], 1000 + k))
    return bpe.Merges(tokens, merges, {})


@pytest.mark.parametrize("rules", [[("a", "b"), ("b", "c")], [("a", "a"), ("aa", "a"), ("b", "aa")], [("b", "c"), ("c", "a"), ("a", "b"), ("ab", "bc")], [("a", "b"), ("b", "a"), ("ab", "ab"), ("a", "ab")]])
def test_lookahead_suffices(rules):
    """With any longer continuation, tokens that end K bytes before the end stay."""
    m = toy(rules)
    for text in map("".join, product("abc", repeat=7)):
        ends = np.cumsum([len(m.tokens[i]) for i in m.merge(text.encode())])
        for size in range(1, 7):
            seen = np.cumsum([len(m.tokens[i]) for i in m.merge(text[:size].encode())])
            assert set(e for e in seen if e <= size - m.lookahead) <= set(ends), (text, size)


def test_bpe_query(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = Q.op8_bpe(spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = ids_of(library, texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def edge_docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in EDGES], "doc_id long, text string, n_tokens string")


def test_bpe_edge_rows(spark, library):
    rows = bpe.encode_decode(edge_docs(spark), PATH, with_ids=True).collect()
    assert sorted((r["doc_id"] or -1, tuple(r["ids"])) for r in rows) == sorted((i or -1, tuple(ids_of(library, t))) for i, t in EDGES)
    assert {r["decoded"] for r in rows} == {t or "" for _, t in EDGES}
    assert bpe.encode_decode(edge_docs(spark).limit(0), PATH).count() == 0


def check_packing(rows, ids_by_doc):
    """Every id in one piece, pieces gapless within sequences of at most a window."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, copies in ids_by_doc.items():
        want = Counter()
        for ids in copies:
            for s in range(0, len(ids), 1024):
                want[s, len(ids[s : s + 1024]), zlib.crc32(np.array(ids[s : s + 1024], dtype="<u4").tobytes()), len(ids)] += 1
        assert Counter((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in pieces[doc]) == want
    waste = 0
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
        waste += packing.padding(at)
    return waste / sum(length for spans in sequences.values() for _, length in spans)


def test_packing_query(spark, library):
    ids = {r["doc_id"]: [ids_of(library, r["text"]) + [0]] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert check_packing(Q.op5_packing(spark, DATA).collect(), ids) < 0.02


def test_packing_edge_rows(spark, library):
    ids = defaultdict(list)
    for i, t in EDGES:
        ids[i].append(ids_of(library, t) + [0])
    check_packing(packing.pack_documents(edge_docs(spark), PATH).collect(), ids)
    assert packing.pack_documents(edge_docs(spark).limit(0), PATH).count() == 0


def test_ranks_hold_over_salts(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_A_SALT", 3)
    docs = spark.createDataFrame([(k, "same words") for k in range(40)], "doc_id long, text string")
    check_packing(packing.pack_documents(docs, PATH).collect(), {k: [ids_of(library, "same words") + [0]] for k in range(40)})


def test_windows_are_filled_as_by_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        counts = {x: rng.randint(1, 3) for x in rng.sample(range(1, 25), rng.randint(0, 5))}
        target = rng.randint(0, 40)
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * k for s in sums for k in range(n + 1)}
        used = packing.fill_window(counts, target)
        assert all(used[x] <= counts[x] for x in used)
        assert sum(x * n for x, n in used.items()) == max(s for s in sums if s <= target)


def test_plan_uses_every_piece():
    rng = random.Random(6)
    histogram = Counter(rng.randint(1, 1024) for _ in range(20_000))
    plan = packing.plan_windows(dict(histogram))
    used = Counter()
    for pattern, times in plan:
        assert sum(x * n for x, n in pattern.items()) <= 1024
        for x, n in pattern.items():
            used[x] += n * times
    assert used == histogram
    waste = sum(packing.padding(sum(x * n for x, n in p.items())) * t for p, t in plan)
    assert waste < 0.005 * sum(x * n for x, n in histogram.items())
    assert packing.plan_windows({}) == []
