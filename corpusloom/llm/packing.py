"""Packing by minimum bin slack over a histogram of lengths.

Every document's ids are cut into pieces of one window and a remainder. Only the
number of pieces of each length matters for a plan, and there are as many lengths
as window positions, so the plan is made from a histogram of bounded size, on the
driver, whatever the corpus holds. Each window takes the largest length that is
left and fills the rest by a subset-sum dynamic program over bit sets, closest to
capacity; backtracked counts say how many pieces of each length it takes, and the
pattern is used as often as the counts allow. Pieces then find their place by
their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_checkpoint
from .bpe import loaded

WINDOW = 1024
END_ID = 0
#: Pieces ranked together in one task: a length's pieces are dealt to as many salts.
PIECES_A_SALT = 50_000


def padding(fill: int, window: int = WINDOW) -> int:
    """Padding of a sequence: up to the window, but none at a power of two."""
    return 0 if fill & (fill - 1) == 0 else window - fill


def fill_window(counts: dict[int, int], target: int) -> dict[int, int]:
    """The multiset within ``counts`` with the largest sum up to ``target``.

    ``layers`` holds, for each length taken in, the bit set of reachable sums;
    the walk back through them gives how often each length is used. Large lengths
    come first, so among equal sums few pieces are taken.
    """
    mask = (1 << target + 1) - 1
    reach, layers = 1, []
    for length in sorted((x for x in counts if x <= target and counts[x] > 0), reverse=True):
        layers.append((length, reach))
        left, step = min(counts[length], target // length), 1
        while left > 0:  # binary splitting: at most left copies by doubling shifts
            take = min(step, left)
            reach |= reach << take * length & mask
            left, step = left - take, step * 2
        if reach >> target & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, before in reversed(layers):
        while not before >> total & 1:
            total -= length
            used[length] = used.get(length, 0) + 1
    return used


def plan_windows(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """Patterns (length to pieces) and how often each is used, over all pieces."""
    counts = {x: n for x, n in histogram.items() if n > 0}
    plan = []
    while counts:
        largest = max(counts)
        counts[largest] -= 1
        pattern = fill_window(counts, window - largest)
        counts[largest] += 1
        pattern[largest] = pattern.get(largest, 0) + 1
        times = min(counts[x] // n for x, n in pattern.items())
        plan.append((pattern, times))
        for x, n in pattern.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
    return plan


class Places:
    """Where the pieces of each length go: rank to (sequence, offset)."""

    def __init__(self, plan: list[tuple[dict[int, int], int]]):
        spans: dict[int, list[tuple[int, int, int, int]]] = {}
        self.sequences = 0
        ranks: dict[int, int] = {}
        for pattern, times in plan:
            offset = 0
            for length in sorted(pattern, reverse=True):
                spans.setdefault(length, []).append((ranks.get(length, 0), pattern[length], self.sequences, offset))
                ranks[length] = ranks.get(length, 0) + pattern[length] * times
                offset += length * pattern[length]
            self.sequences += times
        self.spans = {x: np.array(s, dtype=np.int64).T for x, s in spans.items()}

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros_like(ranks), np.zeros_like(ranks)
        for length in np.unique(lengths):
            here = lengths == length
            first, copies, opening, at = self.spans[int(length)]
            k = np.searchsorted(first, ranks[here], side="right") - 1
            inside = ranks[here] - first[k]
            sequence[here] = opening[k] + inside // copies[k]
            offset[here] = at[k] + inside % copies[k] * length
        return sequence, offset


class Cutter:
    """Pieces of one document's ids as they come: at most a window each, the end id last."""

    def __init__(self, window: int, end_id: int, keep: bool):
        self.window, self.keep = window, keep
        self.end = np.array([end_id], dtype="<u4")
        self.start, self.rest, self.rows = 0, self.end[:0], []

    def feed(self, ids: np.ndarray) -> None:
        self.rest = np.concatenate([self.rest, ids])
        whole = len(self.rest) - len(self.rest) % self.window
        for k in range(0, whole, self.window):
            self._piece(self.rest[k : k + self.window])
        self.rest = self.rest[whole:]

    def _piece(self, piece: np.ndarray) -> None:
        self.rows.append((self.start, len(piece), zlib.crc32(piece.tobytes()), *([piece.tolist()] if self.keep else ())))
        self.start += len(piece)

    def finish(self) -> tuple[int, list[tuple]]:
        """Ids of the document and its pieces: (start, length, checksum[, ids])."""
        self.feed(self.end)
        if len(self.rest):
            self._piece(self.rest)
        return self.start, self.rows


def cut_pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Encode whole texts and cut the ids at every ``window``: one row a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, transducer, _ = loaded(vocabulary)
        for batch in batches:
            rows, cutter = [], None
            for part, k, ids, end in transducer.rows(batch, 1):
                cutter = cutter or Cutter(window, end_id, with_ids)
                cutter.feed(ids)
                if end:
                    doc_id = part.column(0)[k].as_py()
                    total, found = cutter.finish()
                    rows += [(doc_id, start, length, crc, total, *more) for start, length, crc, *more in found]
                    cutter = None
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names)

    names, types = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"], [pa.int64()] * 5
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    if with_ids:
        names, types, schema = [*names, "ids"], [*types, pa.list_(pa.int32())], schema + ", ids array<int>"
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, schema)


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Give every piece its ``sequence_id`` and ``offset``.

    ``pieces`` is read three times (histogram, salted counts, ranks), so it should
    be a written table or a checkpoint. Pieces of one length may be a third of all
    rows: they are ranked within salts of about PIECES_A_SALT pieces, and a salt's
    first rank comes from the small table of counts by length and salt.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most window rows
    places = spark.sparkContext.broadcast(Places(plan_windows(counts, window)))
    salts = max(1, -(-sum(counts.values()) // PIECES_A_SALT))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "start")
    ranked = salted.withColumn("_rank", F.row_number().over(within) - 1).join(firsts, ["length", "_salt"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths, ranks):
        import pandas as pd

        sequence, offset = places.value.find(lengths.to_numpy(), ranks.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    found = ranked.withColumn("_at", place("length", (F.col("_first") + F.col("_rank")).cast("long")))
    return found.select(*pieces.columns, "_at.sequence_id", "_at.offset")


def pack_documents(docs: DataFrame, vocabulary: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack all documents.

    Null and empty texts are one piece with the end id alone. Repeated rows are
    packed as often as they come. An empty table gives an empty result. Other
    columns of ``docs`` are not carried.
    """
    return pack(shared_checkpoint(cut_pieces(docs, vocabulary, window, with_ids=with_ids)), window)
