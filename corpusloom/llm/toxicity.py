"""Toxicity by multiple-instance learning: sentences are judged, documents labelled.

A document is a bag of sentences. Each sentence has a probability from a linear
model over hashed words and character n-grams; a document is toxic if any of its
sentences is, so its probability is their noisy-or, 1 - prod(1 - p). Only
document labels are needed to train; the trained model then says which sentences
offend.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .common import WordTable, char_ngrams, keep_rows, labelled_sample, slices, text_parts

#: Words (long ones cut), and the last character of what ends a sentence.
TOKENS = re.compile(r"\w{1,64}|[.!?\n](?![.!?\n])")
ENDERS = frozenset(".!?\n")
BUCKETS = 1 << 18
LOW, HIGH = 4, 7
#: The training sample: labelled documents, and characters of all their texts.
MAX_ROWS, MAX_CHARS = 3000, 10_000_000
#: Longer texts are judged in parts of about so many characters.
PART_CHARS = 1 << 20
#: A feature needs this many documents of the sample; L1 keeps few of the rest.
LEAST_DOCUMENTS = 3
#: The L1 penalty weighs as much as this part of one document.
ROUNDS, RATE, PENALTY, START = 80, 0.15, 0.3, -5.0


@dataclass
class ToxicityModel:
    """Weights of the hashed features and the bias of a sentence."""

    weights: np.ndarray
    bias: float

    def word_scores(self, words: list[str]) -> np.ndarray:
        indptr, index = char_ngrams(words, LOW, HIGH, len(self.weights))
        sums = np.concatenate([[0.0], np.cumsum(self.weights[index].astype(np.float64))])
        score = sums[indptr[1:]] - sums[indptr[:-1]]
        score[[w[0] in ENDERS for w in words]] = 0.0
        return score[:, None]


def bags(texts: list[str]) -> list[list[str]]:
    """Lower-case words and sentence enders of each text."""
    return [TOKENS.findall(t.lower()) for t in texts]


def sentences(tokens: list[str]) -> np.ndarray:
    """Number of the sentence of each token; an ender belongs to what it ends."""
    ends = np.fromiter((t[0] in ENDERS for t in tokens), dtype=np.int64, count=len(tokens))
    return np.cumsum(ends) - ends


def sigmoid(z: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0.0, -z))


class Judge:
    """Sentence logits of texts, with the words seen so far scored once."""

    def __init__(self, model: ToxicityModel):
        self.bias, self.memo = model.bias, WordTable(model.word_scores, 1)

    def logits(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Logits of the sentences of each text, in order; a text without words has one, the bias."""
        short = [t for t in texts if len(t) <= PART_CHARS]
        tokens = bags(short)
        self.memo.learn(tokens)
        known = iter(tokens)
        for text in texts:
            if len(text) <= PART_CHARS:
                words = next(known)
                sums = self._sums(words) if words else np.zeros(1)
            else:
                sums = self._long(text)
                self.memo.learn(tokens)  # the table may have been emptied
            yield self.bias + sums

    def _sums(self, words: list[str]) -> np.ndarray:
        return np.bincount(sentences(words), weights=self.memo.rows[self.memo.of(words), 0])

    def _long(self, text: str) -> np.ndarray:
        """The same part by part; the sentence that a part leaves open goes on in the next."""
        sums, open_end = [], False
        for part in text_parts(text, PART_CHARS):
            (words,) = bags([part])
            if words:
                self.memo.learn([words])
                found = self._sums(words)
                if open_end:
                    found[0] += sums.pop()
                sums += found.tolist()
                open_end = words[-1] not in ENDERS
        return np.array(sums) if sums else np.zeros(1)


def noisy_or(logits: np.ndarray) -> float:
    """1 - prod(1 - p) of sentence logits; 0 for no sentence."""
    return float(-np.expm1(-np.logaddexp(0.0, logits).sum()))


def train(texts: list[str], y: np.ndarray, weight: np.ndarray) -> ToxicityModel:
    """Proximal Adam on the noisy-or likelihood of the document labels, with L1.

    Without both labels in the sample there is nothing to tell apart: all weights
    are zero and every sentence has the bias's small probability.
    """
    theta, bias = np.zeros(BUCKETS, dtype=np.float64), START
    if len(set(y.tolist())) < 2:
        return ToxicityModel(theta.astype(np.float32), bias)
    number: dict[str, int] = {}
    docs = []  # numbers of the words of each text, -1 for an ender
    for text in texts:
        tokens = TOKENS.findall(text.lower())
        docs.append(np.fromiter((-1 if t[0] in ENDERS else number.setdefault(t, len(number)) for t in tokens), dtype=np.int32, count=len(tokens)))
    words = list(number)
    indptr, index = char_ngrams(words, LOW, HIGH, BUCKETS)
    owners = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(indptr))
    spread = np.zeros(BUCKETS, dtype=np.int32)  # documents that hold each feature
    token_word, token_sentence, sentence_doc, at = [], [], [], 0
    for k, numbers in enumerate(docs):
        held = np.unique(numbers[numbers >= 0])
        sizes = indptr[held + 1] - indptr[held]
        spans = np.repeat(indptr[held] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        spread[np.unique(index[spans])] += 1
        ends = (numbers < 0).astype(np.int32)
        which = np.cumsum(ends) - ends
        count = int(which[-1]) + 1 if len(which) else 1
        token_word.append(numbers[numbers >= 0])
        token_sentence.append((which[numbers >= 0] + at).astype(np.int32))
        sentence_doc.append(np.full(count, k, dtype=np.int32))
        at += count
    word, owner, doc = np.concatenate(token_word), np.concatenate(token_sentence), np.concatenate(sentence_doc)
    used = np.flatnonzero(spread >= LEAST_DOCUMENTS)  # only these are trained
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[used] = np.arange(len(used))
    index = place[index]
    owners, index = owners[index >= 0], index[index >= 0]
    theta = np.zeros(len(used))
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    weight, penalty = weight / weight.sum(), PENALTY / len(docs)
    for step in range(1, ROUNDS + 1):
        score = np.bincount(owners, weights=theta[index], minlength=len(words))
        z = bias + np.bincount(owner, weights=score[word], minlength=at)
        p = sigmoid(z)
        log_q = -np.bincount(doc, weights=np.logaddexp(0.0, z), minlength=len(docs))  # log prod(1 - p)
        q = np.exp(log_q)
        pull = np.where(y > 0, -q / np.maximum(-np.expm1(log_q), 1e-9), 1.0) * weight
        dz = p * pull[doc]
        dword = np.bincount(word, weights=dz[owner], minlength=len(words))
        grad = np.append(np.bincount(index, weights=dword[owners], minlength=len(used)), dz.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        rate = RATE / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        moved = np.append(theta, bias) - rate * m / (1 - 0.9**step)
        theta, bias = np.sign(moved[:-1]) * np.maximum(np.abs(moved[:-1]) - rate[:-1] * penalty, 0.0), moved[-1]
    full = np.zeros(BUCKETS, dtype=np.float32)
    full[used] = theta
    return ToxicityModel(full, float(bias))


def fit(docs: DataFrame, labels: DataFrame, condition: Column, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> ToxicityModel:
    """Learn from at most ``max_rows`` labelled documents of ``max_chars`` characters in all that meet ``condition``."""
    return train(*labelled_sample(docs, labels, "toxic", condition, max_rows, max_chars))


def score(docs: DataFrame, model: ToxicityModel, spans: bool = False, offends: float = 0.5) -> DataFrame:
    """Per row: doc_id, score, worst sentence's number and probability, sentences.

    Null and empty texts have one empty sentence and so the bias's small score.
    With ``spans`` also ``offending``: start and end (in characters) of every
    sentence of probability ``offends`` or more. Repeated rows give repeated
    results. Narrow: one pass over whole texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for batch in slices(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for doc_id, text, z in zip(batch.column(0).to_pylist(), texts, judge.logits(texts)):
                worst = int(z.argmax())
                row = (doc_id, noisy_or(z), worst, float(sigmoid(z[worst])), len(z))
                rows.append((*row, locate(text, z, offends)) if spans else row)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names)

    names, types = ["doc_id", "score", "worst_sentence", "worst_score", "n_sentences"], [pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.int64()]
    schema = "doc_id long, score double, worst_sentence long, worst_score double, n_sentences long"
    if spans:
        names, schema = [*names, "offending"], schema + ", offending array<struct<start:long,end:long,score:double>>"
        types = [*types, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))]
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, schema)


def locate(text: str, logits: np.ndarray, offends: float) -> list[dict]:
    """Spans of the sentences whose probability reaches ``offends``."""
    p = sigmoid(logits)
    if p.max(initial=0.0) < offends:
        return []
    first, last, k, out = None, 0, 0, []
    for m in TOKENS.finditer(text):  # lower-casing changes no class that this pattern tells apart
        first = m.start() if first is None else first
        last = m.end()
        if m[0][0] in ENDERS:
            if p[k] >= offends:
                out.append({"start": first, "end": last, "score": float(p[k])})
            first, k = None, k + 1
    if first is not None and k < len(p) and p[k] >= offends:
        out.append({"start": first, "end": last, "score": float(p[k])})
    return out


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """Rows whose score is below ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make_mask():
        judge = Judge(shared.value)
        return lambda texts: [noisy_or(z) < threshold for z in judge.logits(texts)]

    return keep_rows(docs, make_mask)
