"""Nearest neighbours by collision counting on query-centred windows.

Vectors are dealt to blocks. A block's index is a number of random projections,
each a sorted array of its own. For a query, a window around the query's own
projection is opened in every array and widened round by round (virtual
rehashing: the hash bucket is centred on the query and grows with the radius). A
vector collides once for each window that covers it; those with enough
collisions are verified by their exact distance. The search stops when a vector
at the distance of the k-th nearest verified one would have exceeded the
threshold with the asked-for confidence, so any nearer one has been verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Projections, share of them that must collide, confidence in standard deviations, window growth.
PROJECTIONS, SHARE, CONFIDENCE, GROWTH, SEED = 32, 0.5, 2.5, 1.4, 5
#: First half-width, as a share of the projections' deviation.
OPENING = 0.35
#: Vectors of a block: at most about the first; small tables are dealt to a few blocks for parallelism.
BLOCK, LEAST_BLOCK = 65_536, 4096


def usable(vector: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(sound, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def reach_of(share: float, projections: int, confidence: float) -> float:
    """Half-width, as a multiple of a vector's distance, at which it collides often enough.

    A projection of a difference of length d is normal with deviation d, so the
    chance of a collision within half-width h is erf(h / (d sqrt 2)).
    """
    low, high = share, 1.0
    for _ in range(60):
        p = (low + high) / 2
        low, high = (p, high) if p - confidence * sqrt(p * (1 - p) / projections) < share else (low, p)
    goal, low, high = high, 0.0, 10.0
    for _ in range(60):
        x = (low + high) / 2
        low, high = (x, high) if erf(x / sqrt(2)) < goal else (low, x)
    return high


class BlockIndex:
    """Sorted projections of the vectors of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS):
        self.ids, self.vectors = ids, vectors
        rng = np.random.default_rng((SEED, vectors.shape[1]))
        self.axes = rng.standard_normal((vectors.shape[1], projections))
        along = vectors @ self.axes
        self.order = np.argsort(along, axis=0, kind="stable").T.astype(np.int32).ravel()
        self.scale = float(np.median(along.std(axis=0))) or 1.0
        # All sorted arrays behind each other, each moved up by more than any window, so one search serves all.
        self.gap = 4.0 * float(np.abs(along).max()) + 1.0
        self.moved = np.arange(projections) * self.gap
        self.sorted = (np.sort(along, axis=0) + self.moved).T.ravel()
        self.norms = (vectors * vectors).sum(axis=1)

    def windows(self, at: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """First and last place, within all sorted arrays, of a window in each."""
        n, half = len(self.ids), min(half, self.gap / 2)
        base = np.arange(len(at)) * n
        low = np.clip(np.searchsorted(self.sorted, at - half) - base, 0, n) + base
        high = np.clip(np.searchsorted(self.sorted, at + half, side="right") - base, 0, n) + base
        return low, high

    def verified(self, rows: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Exact distances and ids of the k nearest of ``rows`` and those as near but for rounding."""
        rough = self.norms[rows] + query @ query - 2.0 * (self.vectors[rows] @ query)
        if len(rows) > k:
            edge = np.partition(rough, k - 1)[k - 1]
            rows = rows[rough <= edge + 1e-9 * (abs(edge) + self.norms[rows].max() + query @ query)]
        return np.sqrt(((self.vectors[rows] - query) ** 2).sum(axis=1)), self.ids[rows]

    def search(self, own: int, query: np.ndarray, k: int, reach: float, needed: int) -> list[tuple[float, int]]:
        """(distance, id) of the k nearest found, ties to smaller ids, ``own`` left out."""
        n = len(self.ids)
        at = query @ self.axes
        limit = np.abs(at).max() + self.gap / 4  # a window of this covers every array
        at = np.clip(at, -self.gap / 4, self.gap / 4) + self.moved
        hits, pending = np.zeros(n, dtype=np.int64), self.ids != own
        found_d, found_i = np.zeros(0), np.zeros(0, dtype=np.int64)
        half, low, high = OPENING * self.scale, None, None
        while True:
            wider_low, wider_high = self.windows(at, half if half < limit else np.inf)
            low, high = (wider_low, wider_low) if low is None else (low, high)
            parts = [self.order[a:b] for a, b in zip((*wider_low, *high), (*low, *wider_high)) if b > a]
            low, high = wider_low, wider_high
            if parts:
                hits += np.bincount(np.concatenate(parts), minlength=n)
            ready = np.flatnonzero(pending & (hits >= needed))
            if len(ready):
                pending[ready] = False
                d, i = self.verified(ready, query, k)
                found_d, found_i = np.concatenate([found_d, d]), np.concatenate([found_i, i])
                best = np.lexsort((found_i, found_d))[:k]
                found_d, found_i = found_d[best], found_i[best]
            enough = reach * found_d[k - 1] if len(found_d) >= k else np.inf
            if half >= min(enough, limit):
                return list(zip(found_d.tolist(), found_i.tolist()))
            half = min(half * GROWTH, max(enough, half * 1.001), limit)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance, double).

    Queries are the usable rows that meet ``is_query``, candidates all usable rows
    but those of the query's own id, of the query's dimension. Null ids, and
    vectors null, zero or with null or non-finite components, take no part. A
    query id that comes more than once is searched once, with the least of its vectors.
    Fewer than k candidates give fewer rows. Every row is indexed; nothing is fitted on
    a sample. Components so large that their squares would overflow are scaled by a
    power of two, which changes no distance.

    Each block meets every query: queries (a stated share of the rows) are copied
    to the blocks, sorted behind the block's vectors and streamed past its index,
    so a task holds one block and one batch of queries.
    """
    spark = vectors.sparkSession
    valid = vectors.where(F.col(id_column).isNotNull() & usable(F.col(vector))).select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v"))
    size = F.array_max(F.transform(F.col("v"), F.abs)).cast("double")
    about = valid.agg(F.count("*").alias("n"), F.max(size).alias("top")).first()
    total, scale = about["n"], 2.0 ** -max(0, int(np.frexp(about["top"] or 1.0)[1]) - 480)
    blocks = max(1, -(-total // BLOCK), min(spark.sparkContext.defaultParallelism, total // LEAST_BLOCK))
    data = valid.select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "v")
    asked = vectors.where(is_query & F.col(id_column).isNotNull() & usable(F.col(vector))).select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v"))
    asked = asked.groupBy("id").agg(F.min("v").alias("v"))
    copies = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "v")
    reach, needed = reach_of(SHARE, PROJECTIONS, CONFIDENCE), int(np.ceil(SHARE * PROJECTIONS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = None, {}, {}
        for batch in batches:
            block, kind, ids = (batch.column(c).to_numpy() for c in (0, 1, 2))
            lists = batch.column(3)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            out: list[tuple] = []
            cuts = np.flatnonzero(np.diff(block) | np.diff(kind)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(ids)]):
                if a == b:
                    continue
                if block[a] != now:
                    now, held, index = block[a], {}, {}
                for i in range(a, b):
                    v = flat[ends[i - 1] if i else 0 : ends[i]]
                    if kind[a] == 0:
                        held.setdefault(len(v), []).append((ids[i], v))
                        continue
                    if len(v) in held:
                        rows = held.pop(len(v))
                        index[len(v)] = BlockIndex(np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows]))
                    if len(v) in index:
                        out += [(ids[i], found, d / scale) for d, found in index[len(v)].search(int(ids[i]), v, k, reach, needed)]
            columns = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])

    found = (
        data.unionByName(copies)
        .repartition(blocks, "block")
        .sortWithinPartitions("block", "kind")
        .mapInArrow(run, "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
