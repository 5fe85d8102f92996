"""Quality classifier by supervised subword embeddings.

Every white-space token and its character n-grams are hashed to learned vectors;
their average over a document goes through a softmax. Trained by stochastic
gradient descent in numpy. A token that repeats its predecessor counts as the
repeat token, so that runs of one word are told from prose.

For scoring, the output layer is applied to every token once (averaging and the
output layer commute), so a document costs one lookup a token.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .common import WordTable, char_ngrams, keep_rows, labelled_sample, slices, text_parts

BUCKETS, DIMENSION = 1 << 16, 12
LOW, HIGH = 2, 4
#: The training sample: labelled documents, and characters of all their texts.
MAX_ROWS, MAX_CHARS = 3000, 10_000_000
#: Longer texts are scored in parts of about so many characters.
PART_CHARS = 1 << 20
EPOCHS, RATE, SEED = 4, 0.5, 7
#: Longer tokens are cut up for their n-grams, so that one token can't fill memory.
TOKEN_CHARS = 64
REPEAT = "\x00repeat"


@dataclass
class QualityModel:
    """Feature vectors, output layer and output bias."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def token_rows(self, tokens: list[str]) -> np.ndarray:
        """For each token: summed outputs of its features, then their number."""
        indptr, index = char_ngrams(tokens, LOW, HIGH, len(self.vectors))
        values = (self.vectors @ self.output.T).astype(np.float64)[index]
        sums = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)])
        return np.column_stack([sums[indptr[1:]] - sums[indptr[:-1]], np.diff(indptr)])

    def probability(self, total: np.ndarray) -> float:
        """Softmax probability of class 1 for the sum of a document's token rows."""
        z = total[:-1] / max(total[-1], 1.0) + self.bias
        e = np.exp(z - z.max())
        return float(e[1] / e.sum())


def tokens_of(text: str, before: str | None = None) -> list[str]:
    """White-space tokens, repeats marked (also of the token ``before``), long ones cut into pieces."""
    words = text.split()
    out = [REPEAT if a == b else a for a, b in zip(words, [before, *words])]
    if max(map(len, out), default=0) > TOKEN_CHARS:
        out = [w[k : k + TOKEN_CHARS] for w in out for k in range(0, len(w), TOKEN_CHARS)]
    return out


def train(texts: list[str], y: np.ndarray, weight: np.ndarray) -> QualityModel:
    """Normalised SGD, one document at a time, in a fixed random order.

    With one class only, or none, the vectors stay zero and the bias says how
    often class 1 was seen.
    """
    rng = np.random.default_rng(SEED)
    share = float(np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 0.01, 0.99)) if len(y) else 0.5
    bias = np.log(np.array([1 - share, share]))
    vectors, output = np.zeros((BUCKETS, DIMENSION), dtype=np.float32), np.zeros((2, DIMENSION), dtype=np.float32)
    if len(set(y.tolist())) < 2:
        return QualityModel(vectors, output, bias)
    vectors[:] = rng.uniform(-1, 1, vectors.shape) / DIMENSION
    number: dict[str, int] = {}
    docs = []
    for text in texts:
        tokens = tokens_of(text)
        docs.append(np.fromiter((number.setdefault(t, len(number)) for t in tokens), dtype=np.int32, count=len(tokens)))
    indptr, index = char_ngrams(list(number), LOW, HIGH, BUCKETS)
    sizes = np.diff(indptr)
    bags = []
    for tokens in docs:
        which, copies = np.unique(tokens, return_counts=True)
        spans = np.repeat(indptr[which] - np.cumsum(sizes[which]) + sizes[which], sizes[which]) + np.arange(sizes[which].sum())
        counts = np.bincount(index[spans], weights=np.repeat(copies, sizes[which]), minlength=BUCKETS) if len(tokens) else np.zeros(BUCKETS)
        used = np.flatnonzero(counts)
        bags.append((used.astype(np.uint16 if BUCKETS <= 1 << 16 else np.int32), (counts[used] / max(counts.sum(), 1)).astype(np.float32)))
    target = np.eye(2)[y.astype(int)]
    steps = EPOCHS * len(docs)
    for step in range(steps):
        if step % len(docs) == 0:
            order = rng.permutation(len(docs))
        k = order[step % len(docs)]
        used, part = bags[k]
        if not len(used):
            continue
        rate = RATE * (1 - step / steps) * weight[k]
        hidden = part @ vectors[used]
        z = output @ hidden + bias
        e = np.exp(z - z.max())
        wrong = e / e.sum() - target[k]
        back = wrong @ output
        output -= (rate * np.outer(wrong, hidden) / max(hidden @ hidden, 0.05)).astype(np.float32)
        bias -= 0.1 * rate * wrong
        vectors[used] -= (rate / (part @ part)) * np.outer(part, back).astype(np.float32)
    return QualityModel(vectors, output, bias)


def fit(docs: DataFrame, labels: DataFrame, condition: Column, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> QualityModel:
    """Learn from at most ``max_rows`` labelled documents of ``max_chars`` characters in all that meet ``condition``."""
    return train(*labelled_sample(docs, labels, "quality", condition, max_rows, max_chars))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score of every row.

    Null and empty texts get what the bias says; repeated rows give repeated
    results; other columns are not carried. Narrow: one pass over whole texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = scorer(shared.value)
        for batch in slices(batches, 1):
            scores = rate([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, type=pa.float64())], ["doc_id", "score"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, "doc_id long, score double")


def scorer(model: QualityModel):
    """A function from texts to their scores, with the tokens seen so far scored once."""
    memo = WordTable(model.token_rows, 3)

    def long(text: str) -> np.ndarray:
        total, last = np.zeros(3), None
        for part in text_parts(text, PART_CHARS):
            tokens = tokens_of(part, last)
            memo.learn([tokens])
            total += memo.rows[memo.of(tokens)].sum(axis=0)
            last = next(reversed(part.split()), last)
        return total

    def rate(texts: list[str]) -> list[float]:
        docs = [tokens_of(t) if len(t) <= PART_CHARS else None for t in texts]
        totals = [long(t) if d is None else None for t, d in zip(texts, docs)]
        memo.learn([d for d in docs if d is not None])
        return [model.probability(memo.rows[memo.of(d)].sum(axis=0) if d is not None else total) for d, total in zip(docs, totals)]

    return rate


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """Rows that score ``threshold`` or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make_mask():
        rate = scorer(shared.value)
        return lambda texts: [s >= threshold for s in rate(texts)]

    return keep_rows(docs, make_mask)
