"""Token encoding by a vocabulary: fewest tokens, greedy, whole-text, weighted; and decoding."""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

MODES = ("bounded", "greedy", "minimal", "weighted")
SPECIAL = {"<|bos|>": 256, "<|pad|>": 257, "<|eos|>": 258}
#: Encoded chunks that a worker keeps.
MEMO = 200_000


class Encoder:
    """Byte strings to ids; single bytes are always known."""

    def __init__(self, tokens: dict[bytes, int], costs: dict[int, float] | None = None):
        self.ids = {bytes([b]): b for b in range(256)} | tokens
        self.bytes = {i: t for t, i in self.ids.items()}
        self.costs = costs or {}
        # Nested tables by byte: a node's token, if it is one, is at key -1. A walk ends where no token goes on.
        self.root: dict = {}
        for token, i in self.ids.items():
            node = self.root
            for b in token:
                node = node.setdefault(b, {})
            if token:
                node[-1] = i

    def greedy(self, data: bytes) -> list[int]:
        """The longest token at every position."""
        out, at, n = [], 0, len(data)
        while at < n:
            node, k = self.root, at
            while k < n and (node := node.get(data[k])) is not None:
                k += 1
                if -1 in node:
                    found, end = node[-1], k
            out.append(found)
            at = end
        return out

    def fewest(self, data: bytes) -> list[int]:
        """A path of fewest tokens; of equals the one whose last step starts first."""
        return self._path(data, None)

    def cheapest(self, data: bytes) -> list[int]:
        """A path of least cost by token; tokens without one cost 10."""
        return self._path(data, self.costs)

    def _path(self, data: bytes, costs: dict[int, float] | None) -> list[int]:
        n, root = len(data), self.root
        if n == 1:
            return [root[data[0]][-1]]
        best, start_of, token_of = [0.0] + [float("inf")] * n, array("q", bytes(8 * (n + 1))), array("q", bytes(8 * (n + 1)))
        for start in range(n):
            node, end, so_far, plain = root, start, best[start], best[start] + 1.0
            while end < n and (node := node.get(data[end])) is not None:
                end += 1
                token = node.get(-1)
                if token is not None:
                    cost = plain if costs is None else so_far + costs.get(token, 10.0)
                    if cost < best[end]:
                        best[end], start_of[end], token_of[end] = cost, start, token
        out, at = [], n
        while at:
            out.append(token_of[at])
            at = start_of[at]
        return out[::-1]

    def decode(self, ids) -> bytes:
        names = {i: s.encode() for s, i in SPECIAL.items()}
        return b"".join(self.bytes.get(i) or names.get(i, b"") for i in ids)


def broadcast_vocabulary(vocabulary: DataFrame, limit: int = 2_000_000):
    """The vocabulary on every executor; its size is checked against ``limit``."""
    rows = vocabulary.select(F.encode("token", "utf-8").alias("token"), "token_id").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a vocabulary of more than {limit} tokens is no broadcast table")
    return vocabulary.sparkSession.sparkContext.broadcast({bytes(r["token"]): r["token_id"] for r in rows})


def encode(docs: DataFrame, vocabulary: DataFrame, mode: str = "bounded", eos: bool = False) -> DataFrame:
    """Add ``ids``. Bounded modes encode each pre-token alone, with a memo a worker."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    shared = broadcast_vocabulary(vocabulary)
    whole = mode in ("greedy", "minimal")

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = encoder_of(shared.value)
        step = {"bounded": encoder.fewest, "greedy": encoder.greedy, "minimal": encoder.fewest, "weighted": encoder.cheapest}[mode]
        memo: dict[str, np.ndarray] = {}
        for batch in batches:
            if whole:
                yield pa.array([step((t or "").encode("utf-8", "surrogatepass")) for t in batch.to_pylist()], pa.list_(pa.int32()))
            else:
                yield encode_chunks(batch, step, memo)

    found = F.arrow_udf(run, "array<int>")(F.col("text") if whole else X.pretokens("text"))
    return docs.withColumn("ids", F.concat(found, F.array(F.lit(SPECIAL["<|eos|>"]))) if eos else found)


def encoder_of(tokens: dict[bytes, int]) -> Encoder:
    return Encoder(tokens, {i: 1.0 / (1.0 + math.log1p(len(t))) for t, i in tokens.items()})


def encode_chunks(lists: pa.Array, step, memo: dict[str, np.ndarray]) -> pa.Array:
    """Ids of lists of chunks. Arrow tells the chunks apart, so each distinct one of a batch is looked up once."""
    codes = pc.dictionary_encode(lists.flatten())
    pieces = codes.dictionary.to_pylist()
    if len(memo) > MEMO:
        memo.clear()
    for p in pieces:
        if p not in memo:
            memo[p] = np.array(step(p.encode("utf-8", "surrogatepass")), dtype=np.int32)
    known = [memo[p] for p in pieces]
    sizes = np.fromiter(map(len, known), dtype=np.int64, count=len(known))
    flat = np.concatenate(known) if known else np.zeros(0, dtype=np.int32)
    at = codes.indices.to_numpy(zero_copy_only=False)
    each, first = sizes[at], (np.cumsum(sizes) - sizes)[at]
    upto = np.concatenate([[0], np.cumsum(each)])
    ids = flat[np.repeat(first - upto[:-1], each) + np.arange(upto[-1])]
    rows = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
    return pa.ListArray.from_arrays(pa.array(upto[rows], pa.int32()), pa.array(ids, pa.int32()))


def decode(ids: Column, vocabulary: DataFrame) -> Column:
    """Text of token ids; malformed bytes give U+FFFD, unknown and null ids nothing; null for null."""
    shared = broadcast_vocabulary(vocabulary)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(shared.value)
        names = {i: s.encode() for s, i in SPECIAL.items()} | encoder.bytes
        table = [names.get(i, b"") for i in range(max(names) + 2)]
        sizes = np.fromiter(map(len, table), dtype=np.int64, count=len(table))
        starts, buffer = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(table), dtype=np.uint8)
        for batch in batches:
            flat = pc.fill_null(batch.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = np.where((flat < 0) | (flat >= len(table)), len(table) - 1, flat)
            each = sizes[flat]
            upto = np.concatenate([[0], np.cumsum(each)])
            spelt = buffer[np.repeat(starts[flat] - upto[:-1], each) + np.arange(upto[-1])].tobytes()
            rows = upto[np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False))])].tolist()
            valid = pc.is_valid(batch).to_pylist()
            yield pa.array([spelt[a:b].decode("utf-8", "replace") if ok else None for a, b, ok in zip(rows, rows[1:], valid)], pa.string())

    return F.arrow_udf(run, "string")(ids)


def pieces(ids: Column, vocabulary: DataFrame) -> Column:
    """The text of each token of a list alone; null for null. Cut-off characters give U+FFFD."""
    shared = broadcast_vocabulary(vocabulary)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(shared.value)
        names = {i: s for s, i in SPECIAL.items()} | {i: t.decode("utf-8", "replace") for i, t in encoder.bytes.items()}
        for batch in batches:
            yield pa.array([None if row is None else [names.get(i, "") for i in row] for row in batch.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(ids)


def pack21(ids: np.ndarray) -> bytes:
    """21 bits an id, least bit first, filled up to eight ids."""
    ids = np.asarray(ids, dtype=np.int64)
    if len(ids) and (ids.min() < 0 or ids.max() >= 1 << 21):
        raise ValueError("an id needs more than 21 bits")
    ids = np.append(ids, np.zeros(-len(ids) % 8, dtype=np.int64))
    return np.packbits((ids[:, None] >> np.arange(21)) & 1, bitorder="little").tobytes()


def unpack21(data: bytes, count: int) -> np.ndarray:
    """The first ``count`` ids of packed bytes."""
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little")[: count * 21].astype(np.int64)
    return (bits.reshape(count, 21) << np.arange(21)).sum(axis=1)


@F.pandas_udf(T.BinaryType())
def packed21(ids: pd.Series) -> pd.Series:
    return pd.Series([pack21(np.asarray(x)) for x in ids])


@F.pandas_udf(T.BooleanType())
def unpacks_to(data: pd.Series, ids: pd.Series) -> pd.Series:
    return pd.Series([bool(np.array_equal(unpack21(d, len(x)), np.asarray(x))) for d, x in zip(data, ids)])


def byte_letter_bytes(piece: str) -> bytes:
    """Bytes of a byte-level BPE entry; characters that stand for no byte are dropped."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}
    return bytes(back[c] for c in piece if c in back)
