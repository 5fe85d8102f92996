"""SimHash near-duplicates, linked through a pigeonring of fingerprint segments.

The 64 bits are cut into a ring of five segments. Two fingerprints with at most
four different bits have a segment from which every chain of l consecutive
segments differs in at most floor(4 l / 5) bits: none in the first, one in two,
two in three, three in four. The first two links of the chain are the join key
(the first segment as it is, the second with at most one bit changed), the
longer ones prune the candidates before the full Hamming check.

Equal fingerprints are one row from the start. Keys that many fingerprints share
(groups of near copies) never give all their pairs: each gives at most the edges of a
spanning forest. Keys that more share than a task should compare, as they do in a
large corpus, are made longer by the next link of the chain, with all changes that its
budget allows, until they are small; four links leave so few bits that a key can't
have more than 8,192 fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_checkpoint
from .common import slices
from .components import components, join_weighted

SHINGLE, SEED, LIMIT = 4, 42, 4
#: The ring: first bit and width of each segment.
RING = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Bits that a chain of one, two, ... segments may differ in.
BUDGET = tuple(LIMIT * n // len(RING) for n in range(1, len(RING) + 1))
#: Keys of more fingerprints than the first give a spanning forest, of more than the second take another link.
HOT_KEY, FULL_KEY = 100, 4096
#: Links of the longest key.
MOST_LINKS = 4
WORDS = regex.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Characters other than those below that split() takes as white space.
OTHER_SPACE = regex.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def words_of(text: str) -> list[str]:
    """Words between spaces, tabs and line ends, A-Z lower-cased."""
    text = text.lower() if text.isascii() else text.translate(LOWER)
    return WORDS.findall(text) if OTHER_SPACE.search(text) else text.split()


def fingerprint(text: str | None, piece: int = 1 << 16) -> int:
    """The 64-bit SimHash of a text, unsigned; zero for a text without words."""
    words = words_of(text or "")
    if not words:
        return 0
    total = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, total, piece):  # long texts piece by piece
        part = words[k : k + piece + SHINGLE - 1]
        shingles = map(" ".join, zip(part, part[1:], part[2:], part[3:])) if len(words) >= SHINGLE else [" ".join(words)]
        hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = [fingerprint(t) for t in batch.column(1).to_pylist()]
            signed = np.array(found, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed)], ["doc_id", "fp"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, "doc_id long, fp long")


def segment(fp: Column, k: int) -> Column:
    first, width = RING[k % len(RING)]
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))


def index_keys(reps: DataFrame) -> DataFrame:
    """(start, key, fp): the chain of two as it is, from each of the five starts."""
    keys = [F.struct(F.lit(s).alias("start"), _longer(segment(F.col("fp"), s), F.col("fp"), s, 1).alias("key")) for s in range(len(RING))]
    return reps.select(F.explode(F.array(*keys)).alias("k"), "fp").select("k.*", "fp")


def _longer(key: Column, fp: Column, start: int, links: int, change: int = 0) -> Column:
    """A key with one more link: the next segment, some of its bits changed."""
    width = RING[(start + links) % len(RING)][1]
    return F.shiftleft(key, width).bitwiseOR(segment(fp, start + links).bitwiseXOR(F.lit(change).cast("long")))


def probe_keys(reps: DataFrame) -> DataFrame:
    """(start, key, used, fp): the second link as it is, and with each of its zero bits set.

    Of two fingerprints that differ in one bit of the second link, one has a zero
    there, so its probe meets the other's index row. ``used`` is how many bits are changed.
    """
    keys, fp = [], F.col("fp")
    for s in range(len(RING)):
        first, second = segment(fp, s), segment(fp, s + 1)
        of = lambda change, used: F.struct(F.lit(s).alias("start"), _longer(first, fp, s, 1, change).alias("key"), F.lit(used).alias("used"))  # noqa: B023, E731
        keys.append(of(0, 0))
        for bit in range(RING[(s + 1) % len(RING)][1]):
            keys.append(F.when(second.bitwiseAND(F.lit(1 << bit)) == 0, of(1 << bit, 1)))
    return reps.select(F.explode(F.array_compact(F.array(*keys))).alias("k"), "fp").select("k.*", "fp")


def lengthened(index: DataFrame, probe: DataFrame, links: int) -> tuple[DataFrame, DataFrame]:
    """Index and probe rows with keys of one more link than ``links``, all changes within the budget probed."""
    longer, changed = F.col("key"), F.array().cast("array<struct<key:bigint,used:int>>")
    for s in range(len(RING)):
        width = RING[(s + links) % len(RING)][1]
        longer = F.when(F.col("start") == s, _longer(F.col("key"), F.col("fp"), s, links)).otherwise(longer)
        changes = [(sum(1 << b for b in bits), n) for n in range(BUDGET[links] + 1) for bits in combinations(range(width), n)]
        table = F.array(*[F.struct(F.lit(m).cast("long").alias("change"), F.lit(n).alias("n")) for m, n in changes])
        plain = _longer(F.col("key"), F.col("fp"), s, links)
        fit = F.filter(table, lambda c: c["n"] + F.col("used") <= BUDGET[links])
        rows = F.transform(fit, lambda c: F.struct(plain.bitwiseXOR(c["change"]).alias("key"), (c["n"] + F.col("used")).cast("int").alias("used")))  # noqa: B023
        changed = F.when(F.col("start") == s, rows).otherwise(changed)
    return index.select("start", longer.alias("key"), "fp"), probe.select("start", F.explode(changed).alias("k"), "fp").select("start", "k.*", "fp")


def chain_masks() -> list[list[int]]:
    """For each start: the masks of its chains of three, four and five segments."""
    masks = []
    for s in range(len(RING)):
        chain, row = 0, []
        for k in range(len(RING)):
            first, width = RING[(s + k) % len(RING)]
            chain |= ((1 << width) - 1) << first
            row.append(chain)
        masks.append(row[2:])
    return masks


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def within_budget(a: Column, b: Column, start: Column) -> Column:
    """The longer chains from ``start`` stay within budget; the last is the Hamming check."""
    differ = a.bitwiseXOR(b)
    out = F.lit(False)
    for s, masks in reversed(list(enumerate(chain_masks()))):
        fits = F.lit(True)
        for n, mask in enumerate(masks, start=3):
            fits = fits & (F.bit_count(differ.bitwiseAND(F.lit(_signed(mask)))) <= BUDGET[n - 1])
        out = F.when(start == s, fits).otherwise(out)
    return out


def sparse_links(index: DataFrame, probe: DataFrame) -> DataFrame:
    """Links through keys of few fingerprints, by an equi-join on the key."""
    a, b = index.select("start", "key", F.col("fp").alias("u")), probe.select("start", "key", F.col("fp").alias("v"))
    return a.join(b, ["start", "key"]).where((F.col("u") != F.col("v")) & within_budget(F.col("u"), F.col("v"), F.col("start"))).select("u", "v")


def spanning_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links between a key's fingerprints and a block of its probes.

    A fingerprint already in the component of its counterpart needs no further edge.
    """
    left = np.unique(pdf.loc[pdf["side"] == 0, "fp"].to_numpy()).view(np.uint64)
    right = np.unique(pdf.loc[pdf["side"] == 1, "fp"].to_numpy()).view(np.uint64)
    masks = chain_masks()[int(pdf["start"].iloc[0])]
    nodes = np.unique(np.concatenate([left, right]))
    parent = np.arange(len(nodes))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    edges = []
    of_right = np.searchsorted(nodes, right)
    for fp, mine in zip(left, np.searchsorted(nodes, left)):
        differ = right ^ fp
        near = np.arange(len(right))
        for n, mask in enumerate(masks, start=3):
            near = near[np.bitwise_count(differ[near] & np.uint64(mask)) <= BUDGET[n - 1]]
        for other in of_right[near]:
            a, b = root(mine), root(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((nodes[mine], nodes[other]))
    flat = np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"u": flat[:, 0], "v": flat[:, 1]})


def dense_links(index: DataFrame, probe: DataFrame, full: int = FULL_KEY) -> DataFrame:
    """Links through keys of many, but a bounded number of fingerprints: all of them against blocks of the probes."""
    sizes = probe.groupBy("start", "key").agg(F.ceil(F.count("*") / full).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = index.join(sizes, ["start", "key"]).select("start", "key", "fp", every.alias("block"), F.lit(0).alias("side"))
    right = probe.join(sizes, ["start", "key"]).select("start", "key", "fp", block.alias("block"), F.lit(1).alias("side"))
    return left.unionByName(right).groupBy("start", "key", "block").applyInPandas(spanning_links, "u long, v long")


def links(reps: DataFrame, hot: int = HOT_KEY, full: int = FULL_KEY) -> DataFrame:
    """Edges (u, v) that connect all fingerprints within LIMIT bits of each other.

    ``reps`` holds distinct fingerprints and is read a few times.
    """
    index, probe, found, on = index_keys(reps), probe_keys(reps), None, ["start", "key"]
    for length in range(2, MOST_LINKS + 1):
        crowded = shared_checkpoint(index.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > hot))
        cold = sparse_links(index.join(crowded, on, "left_anti"), probe)
        found = cold if found is None else found.unionByName(cold)
        if crowded.isEmpty():
            break
        whole = crowded if length == MOST_LINKS else crowded.where(F.col("n") <= full)
        found = found.unionByName(dense_links(index.join(whole, on, "left_semi"), probe.join(whole, on, "left_semi"), full))
        over = crowded.where(F.col("n") > full)
        if length == MOST_LINKS or over.isEmpty():
            break
        index, probe = map(shared_checkpoint, lengthened(index.join(over, on, "left_semi"), probe.join(over, on, "left_semi"), length))
    return found


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component and component_id of every row.

    A component is named by one of its fingerprints; its id is the least doc_id in it,
    null if all are. Copies of one text, however many, stay where they lie.
    """
    prints = shared_checkpoint(fingerprints(docs))
    reps = shared_checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    size = reps.agg(F.count("*").alias("texts"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    joined = components(links(reps.select("fp")))
    named = shared_checkpoint(reps.join(joined, reps["fp"] == joined["node"], "left").select("fp", "rep", "n", F.coalesce("component", "fp").alias("component")))
    least = shared_checkpoint(named.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("texts")))
    of_text = join_weighted(named.drop("rep"), least, "component", "texts", size["texts"])
    return join_weighted(prints, shared_checkpoint(of_text), "fp", "n", size["rows"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Null and empty texts have fingerprint zero and are linked like any other.
    Repeated rows give repeated results. Null ids keep their own fingerprint's
    component; a component of null ids alone has a null id. Empty table: no rows.
    """
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, all columns: that of the least id.

    Ids that come once, which are all as a rule, are kept or dropped by the id. Rows
    of null or repeated ids are told apart by their fingerprint: among those of the
    component's id the least fingerprint stays, of rows alike in both any one.
    """
    rows = shared_checkpoint(grouped(docs))
    by_id = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("component_id"))
    single = (F.col("n") == 1) & F.col("doc_id").isNotNull()
    odd = shared_checkpoint(by_id.where(~single).select(F.col("doc_id").alias("_id")))
    gone = by_id.where(single & (F.col("doc_id") != F.col("component_id"))).select(F.col("doc_id").alias("_id")).unionByName(odd)
    number = docs["doc_id"].cast("long")
    kept = docs.where(docs["doc_id"].isNotNull()).join(gone, number == gone["_id"], "left_anti")
    if odd.isEmpty():
        return kept.select(*docs.columns)
    best = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("fp").alias("_best"), F.first("component_id").alias("_of"))
    again = with_fingerprint(docs.join(odd, number.eqNullSafe(odd["_id"]), "left_semi"), "_fp")
    same = again.join(best, (again["_fp"] == best["_best"]) & again["doc_id"].cast("long").eqNullSafe(best["_of"]), "left_semi")
    return kept.select(*docs.columns).unionByName(same.dropDuplicates(["doc_id", "_fp"]).select(*docs.columns))


def with_fingerprint(docs: DataFrame, out: str) -> DataFrame:
    """``docs`` with the signed fingerprint of its texts as a further column."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            found = np.array([fingerprint(t) for t in batch.column(at).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())]))
