"""What several training-data operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Odd multipliers of the polynomial n-gram hash and its finaliser.
HASH_BASE = np.uint64(0x9E3779B97F4A7C15)
HASH_MIX = np.uint64(0xFF51AFD7ED558CCD)


def slices(batches: Iterable[pa.RecordBatch], at: int, rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of at most ``rows`` rows and about ``size`` bytes of column ``at``.

    A longer row is a part of its own. No setting of the session is touched.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < len(ends):
            upto = (ends[first - 1] if first else 0) + size
            last = min(first + rows, max(first + 1, int(np.searchsorted(ends, upto, side="right"))))
            yield batch.slice(first, last - first)
            first = last


def text_parts(text: str, size: int = 1 << 20) -> Iterator[str]:
    """A long text in parts, cut behind white space within a line; a run without any is cut at ``size``."""
    at = 0
    while len(text) - at > size:
        cut = next((k for k in range(at + size, at + size // 2, -1) if text[k - 1].isspace() and text[k - 1] != "\n"), at + size)
        yield text[at:cut]
        at = cut
    yield text[at:]


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; null ids fall in fold -1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def bounded_sample(rows: DataFrame, max_rows: int, max_chars: int, seed: str, classes: int | None = None) -> tuple[dict, list[tuple]]:
    """Rows of each class, and (doc_id, class, text hash) of a bounded sample of them.

    ``rows`` has doc_id, class, hash and size (characters) of the texts that may be
    learned from. Every class has an equal share of ``max_rows`` documents and
    ``max_chars`` characters, one document at least: they are taken in the order of a
    hash of the id, until the next one would bring the class over its characters; a
    text that is longer alone than these is passed over, but for the shortest one where
    there are no others. Of several texts of one
    id the one with the least hash counts. Each class is thinned by the hash to little
    more than its quota before anything goes to the driver; where too few came
    (ids that repeat), that class is thinned less. More than ``classes`` classes
    are an error.
    """
    spark = rows.sparkSession
    counted = rows.groupBy("class").agg(F.count("*").alias("n"))
    found = (counted.limit(classes + 1) if classes else counted).collect()
    if classes and len(found) > classes:
        raise ValueError(f"more than {classes} classes to learn")
    counts = {r["class"]: r["n"] for r in found}
    quota, max_chars = max(1, max_rows // max(1, len(counts))), max_chars // max(1, len(counts))
    share, out = {c: min(1.0, (2 * quota + 20) / n) for c, n in counts.items()}, []
    ordered = rows.withColumn("order", F.xxhash64("doc_id", F.lit(seed)))
    kind = rows.schema["class"].dataType.simpleString()
    while share:
        # the lowest hashes first: a share is a bound of the hash
        bounds = [(c, (1 << 63) - 1 if s >= 1 else int(s * (1 << 64)) - (1 << 63)) for c, s in share.items()]
        limits = F.broadcast(spark.createDataFrame(bounds, f"class {kind}, bound long"))  # one row a class
        near = ordered.join(limits, "class").where(F.col("order") <= F.col("bound"))
        by_class: dict = {c: [] for c in share}
        for r in near.groupBy("class", "order", "doc_id").agg(F.min(F.struct("hash", "size")).alias("t")).collect():
            by_class[r["class"]].append((r["order"], r["doc_id"] is not None, r["doc_id"], r["t"]["hash"], r["t"]["size"]))
        for c, some in by_class.items():
            if len(some) < quota and share[c] < 1:
                share[c] = min(1.0, 4 * share[c])
                continue
            del share[c]
            room = max_chars
            fit = sorted(x for x in some if x[4] <= max_chars) or [min(some, key=lambda x: (x[4], x))]
            for _, _, doc_id, digest, size in fit[:quota]:
                room -= size
                if room < 0 and len(fit) > 1:
                    break
                out.append((doc_id, c, digest))
    return counts, out


def sampled_texts(docs: DataFrame, picked: list[tuple], kind: str) -> list:
    """(doc_id, text, class) of the sampled documents, in the order of their ids."""
    ids = F.broadcast(docs.sparkSession.createDataFrame([(d, h, c) for d, c, h in picked], f"_id long, _hash long, class {kind}"))  # the sample's bound
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    taken = text.join(ids, text["doc_id"].eqNullSafe(ids["_id"]) & (F.xxhash64("text") == ids["_hash"]))
    rows = taken.select("doc_id", "text", "class").dropDuplicates(["doc_id", "class"]).collect()
    return sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"], str(r["class"])))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, condition: Column, max_rows: int, max_chars: int
) -> tuple[list[str], np.ndarray, np.ndarray]:
    """A bounded, deterministic training sample: texts, labels, row weights.

    ``labels`` is reduced to one label a document (the largest, if repeated; others
    than 0 and 1 and null ids teach nothing) and joined with the documents at hand,
    so labels of documents that are not there take no place. At most ``max_rows``
    documents and ``max_chars`` characters come of it, see ``bounded_sample``. Weights give each class its share among all labelled
    documents again. Scoring never looks at these bounds.
    """
    lab = labels.where(F.col(label).isin(0, 1) & condition).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("class"))
    text = F.struct(F.xxhash64("text").alias("hash"), F.length("text").cast("long").alias("size"))
    firsts = docs.where(F.col("text").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(text).alias("t"))
    counts, picked = bounded_sample(firsts.join(lab, "doc_id").select("doc_id", "class", "t.hash", "t.size"), max_rows, max_chars, label)
    if not picked:
        return [], np.zeros(0), np.zeros(0)
    rows = sampled_texts(docs, picked, "int")
    y = np.array([r["class"] for r in rows], dtype=np.float64)
    got = {c: max(1, int((y == c).sum())) for c in counts}
    total, taken = sum(counts.values()), max(1, len(rows))
    w = np.array([counts[int(c)] / total * taken / got[int(c)] for c in y])
    return [r["text"] for r in rows], y, w


def char_ngrams(words: list[str], low: int, high: int, buckets: int, whole: bool = True, piece: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of each word as compressed rows (indptr, indices).

    Every word is fenced as ``<word>``; n-grams of ``low`` to ``high`` code points
    are hashed into ``buckets``, and with ``whole`` the fenced word itself too.
    Words are taken ``piece`` at a time, which bounds the memory in between.
    """
    counts, index = [np.zeros(1, dtype=np.int64)], []
    for k in range(0, len(words), piece):
        n, found = _char_ngrams(words[k : k + piece], low, high, buckets, whole)
        counts.append(n)
        index.append(found)
    return np.cumsum(np.concatenate(counts)), np.concatenate(index) if index else np.zeros(0, dtype=np.int32)


def _char_ngrams(words: list[str], low: int, high: int, buckets: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    joined = "".join([f"<{w}>" for w in words])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lens = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lens)
    starts = ends - lens
    owner = np.repeat(np.arange(len(words)), lens)
    left = np.repeat(ends, lens) - np.arange(len(points))  # code points up to the word's end
    owners, hashes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
    with np.errstate(over="ignore"):
        h = np.zeros(len(points), dtype=np.uint64)
        for n in range(1, min(high, len(points)) + 1):
            h[: len(points) - n + 1] = h[: len(points) - n + 1] * HASH_BASE + points[n - 1 :] + np.uint64(1)
            if n >= low:
                keep = left >= n
                owners.append(owner[keep])
                hashes.append(h[keep] + np.uint64(n))
        if whole:
            power = np.ones(int(lens.max()), dtype=np.uint64)
            power[1:] = HASH_BASE
            power = np.cumprod(power)
            inside = np.arange(len(points)) - np.repeat(starts, lens)
            owners.append(np.arange(len(words)))
            hashes.append(np.add.reduceat(points * power[inside], starts) ^ HASH_MIX)
        owner, h = np.concatenate(owners), np.concatenate(hashes)
        h = (h ^ (h >> np.uint64(33))) * HASH_MIX
        h ^= h >> np.uint64(29)
    order = np.argsort(owner, kind="stable")
    return np.bincount(owner, minlength=len(words)), (h[order] % np.uint64(buckets)).astype(np.int32)


def keep_rows(docs: DataFrame, make_mask) -> DataFrame:
    """Rows of ``docs``, all columns, where a mask over their texts is true.

    ``make_mask()`` is called once a task and gives a function from a list of texts
    (null ones empty) to a boolean array. Narrow: no join and no shuffle.
    """
    at = docs.columns.index("text")

    def run(batches):
        mask = make_mask()
        for batch in slices(batches, at):
            yield batch.filter(pa.array(mask([t or "" for t in batch.column(at).to_pylist()]), type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


class WordTable:
    """Words seen so far and a row of numbers for each, computed once a word.

    ``compute(words)`` gives the rows of new words. The table is emptied when it
    holds ``limit`` words, so a worker's memory stays bounded.
    """

    def __init__(self, compute, width: int, limit: int = 400_000):
        self.compute, self.width, self.limit = compute, width, limit
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((1024, self.width))

    def learn(self, docs: list[list[str]]) -> None:
        """Make sure that every word of these documents has a row."""
        if len(self.ids) > self.limit:
            self.clear()
        new = set().union(*docs).difference(self.ids)
        if not new:
            return
        words = sorted(new)
        first = len(self.ids)
        if first + len(words) > len(self.rows):
            grown = np.zeros((max(2 * len(self.rows), first + len(words)), self.width))
            grown[:first] = self.rows[:first]
            self.rows = grown
        for k in range(0, len(words), 20_000):  # bounds the memory in between
            some = words[k : k + 20_000]
            self.rows[first + k : first + k + len(some)] = self.compute(some)
        self.ids.update(zip(words, range(first, first + len(words))))

    def of(self, words: list[str]) -> np.ndarray:
        """Row numbers of the words of a document."""
        return np.fromiter(map(self.ids.__getitem__, words), dtype=np.int64, count=len(words))
