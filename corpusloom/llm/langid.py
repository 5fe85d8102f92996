"""Language identification: sparse multinomial logistic regression on TF-IDF.

Features are hashed character n-grams of lower-case words. Document frequencies
are counted over every document that may be learnt from; weights are trained by
follow-the-regularised-leader (proximal, per-coordinate rates) with L1 and L2
penalties on a bounded sample; a temperature that minimises the likelihood loss
on a held-back part of the sample calibrates the probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordTable, bounded_sample, char_ngrams, sampled_texts, slices, text_parts

#: Runs of word characters other than decimal digits, long ones cut; what else is no letter goes in ``spelt``.
LETTERS = re.compile(r"[^\W\d_]{1,32}")
BUCKETS, LOW, HIGH = 1 << 16, 1, 3
#: The training sample: documents, and characters of all their texts; each language has an equal share.
MAX_ROWS, MAX_CHARS = 4000, 10_000_000
#: Longer texts are judged in parts of about so many characters.
PART_CHARS = 1 << 20
#: Languages learned at most: each has 65,536 weights, a few megabytes in training.
MAX_LANGUAGES = 1000
EPOCHS, ALPHA, BETA, L1, L2, SCALE = 2, 0.5, 1.0, 1e-4, 1e-4, 50.0
UNKNOWN = "und"


@dataclass
class LanguageModel:
    """Languages, inverse document frequencies, weights, bias and temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def word_rows(self, words: list[str]) -> np.ndarray:
        """For each word: its n-grams' summed contributions, then their number."""
        indptr, index = word_ngrams(words)
        values = (self.weights * self.idf[:, None]).astype(np.float64)[index]
        sums = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)])
        return np.column_stack([sums[indptr[1:]] - sums[indptr[:-1]], np.diff(indptr)])

    def predict(self, total: np.ndarray) -> tuple[str, float]:
        """Language and calibrated probability from the sum of a document's word rows."""
        if not total[-1] or not self.languages:
            return UNKNOWN, 0.0
        z = (SCALE * total[:-1] / max(total[-1], 1.0) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        best = int(e.argmax())
        return self.languages[best], float(e[best] / e.sum())


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def spelt(word: str) -> str:
    """The letters of a word: ½, ², Ⅷ and the like are numbers."""
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def word_ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the letters of each word as compressed rows; none without a letter."""
    letters = list(map(spelt, words))
    indptr, index = char_ngrams(letters, LOW, HIGH, BUCKETS, whole=False)
    if all(letters):
        return indptr, index
    sizes = np.diff(indptr)
    held = np.array([bool(w) for w in letters])
    return np.concatenate([[0], np.cumsum(np.where(held, sizes, 0))]), index[np.repeat(held, sizes)]


def document_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each hashed n-gram, and documents, over all of ``docs``.

    Every task sums its own documents into one array, so what is shuffled and sent
    to the driver is at most BUCKETS numbers a task and BUCKETS in all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, known = np.zeros(BUCKETS + 1, dtype=np.int64), np.zeros(BUCKETS, dtype=bool), {}
        for batch in slices(batches, 0):
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for group in grouped(texts):  # a long text stands alone and comes in parts
                bags = [set(words_of(part)) for text in group for part in text_parts(text, PART_CHARS)]
                if len(known) > 300_000:
                    known = {}
                new = sorted(set().union(*bags).difference(known))
                indptr, index = word_ngrams(new)
                known.update(zip(new, np.split(index, indptr[1:-1])))
                for bag in [set().union(*bags)] if len(group) == 1 else bags:
                    if bag:
                        seen[np.concatenate([known[w] for w in bag])] = True
                        counts[:-1] += seen
                        seen[:] = False
            counts[-1] += len(texts)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held, type=pa.int32()), pa.array(counts[held], type=pa.int64())], ["bucket", "n"])

    found = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BUCKETS + 1, dtype=np.int64)
    for r in found:
        counts[r["bucket"]] = r["n"]
    return counts[:-1], int(counts[-1])


def grouped(texts: list[str]) -> list[list[str]]:
    """Texts of one part together, each longer one alone."""
    return [[t for t in texts if len(t) <= PART_CHARS]] + [[t] for t in texts if len(t) > PART_CHARS]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF of a text: buckets and SCALE * frequency * idf."""
    words, copies = np.unique(np.array(words_of(text), dtype=object), return_counts=True) if text else ([], [])
    if not len(words):
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    indptr, index = word_ngrams(list(words))
    if not len(index):
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    used, inverse = np.unique(index, return_inverse=True)
    counts = np.bincount(inverse, weights=np.repeat(copies, np.diff(indptr)))
    return used, SCALE * counts / counts.sum() * idf[used]


def train(texts: list[str], langs: list[str], counts: np.ndarray, documents: int) -> LanguageModel:
    """FTRL-proximal on the sample; each fifth document is held back for the temperature."""
    idf = np.log((1.0 + documents) / (1.0 + counts)) + 1.0
    languages = sorted(set(langs))
    n_classes = len(languages)
    weights, bias = np.zeros((BUCKETS, n_classes)), np.zeros(n_classes)
    model = LanguageModel(languages, idf, weights, bias, 1.0)
    if n_classes < 2:
        return model
    examples = [(*vector(t, idf), languages.index(x)) for t, x in zip(texts, langs)]
    examples = [e for e in examples if len(e[0])]
    held, used_for = examples[::5], [e for k, e in enumerate(examples) if k % 5] or examples
    z, n = np.zeros((BUCKETS + 1, n_classes)), np.zeros((BUCKETS + 1, n_classes))
    rng = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(used_for)):
            index, x, y = used_for[k]
            index, x = np.append(index, BUCKETS), np.append(x, 1.0)
            w = proximal(z[index], n[index])
            s = x @ w
            e = np.exp(s - s.max())
            p = e / e.sum()
            p[y] -= 1.0
            g = np.outer(x, p)
            sigma = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / ALPHA
            z[index] += g - sigma * w
            n[index] += g * g
    w = proximal(z, n)
    model.weights, model.bias = w[:-1].astype(np.float32), w[-1]
    model.temperature = temperature([(x @ w[i] + w[-1], y) for i, x, y in held])
    return model


def proximal(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """FTRL weights: zero within the L1 ball, else shrunk by both penalties."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def temperature(held: list[tuple[np.ndarray, int]]) -> float:
    """The temperature in [0.1, 10] of least loss on held-back logits, by golden section."""
    if not held:
        return 1.0
    s, y = np.array([h[0] for h in held]), np.array([h[1] for h in held])

    def loss(log_t: float) -> float:
        z = s / np.exp(log_t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())

    low, high, ratio = np.log(0.1), np.log(10.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, condition: Column, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> LanguageModel:
    """Learn from the documents that meet ``condition``.

    Document frequencies cover all of them. The weights see at most ``max_rows``
    documents and ``max_chars`` characters, an equal share for each language (one
    document at least), in the order of a hash of the id; see ``bounded_sample``.
    Over MAX_LANGUAGES languages are an error.
    """
    learnable = docs.where(condition & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts, documents = document_counts(learnable)
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("class"), F.xxhash64("text").alias("hash"), F.length("text").cast("long").alias("size")]
    _, picked = bounded_sample(learnable.select(*columns), max_rows, max_chars, "language", MAX_LANGUAGES)
    if not picked:
        return train([], [], counts, documents)
    rows = [(r["doc_id"], r["text"], r["class"]) for r in sampled_texts(docs, picked, "string")]
    rows.sort(key=lambda r: (r[0] * 2654435761 % 4294967296 if r[0] is not None else -1, r[1]))
    return train([r[1] for r in rows], [r[2] for r in rows], counts, documents)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of every row.

    Null texts and those without a letter are ``und`` with score 0; so is all if
    no language could be learnt. Repeated rows give repeated results. Narrow.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        memo = WordTable(model.word_rows, len(model.languages) + 1)
        for batch in slices(batches, 1):
            totals = document_rows([t or "" for t in batch.column(1).to_pylist()], memo)
            found = [model.predict(total) for total in totals]
            columns = [batch.column(0), pa.array([f[0] for f in found], type=pa.string()), pa.array([f[1] for f in found], type=pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, "doc_id long, lang_pred string, score double")


def document_rows(texts: list[str], memo: WordTable) -> list[np.ndarray]:
    """The sum of the word rows of each text; long texts are summed part by part."""
    out: list = []
    for text in texts:
        if len(text) <= PART_CHARS:
            out.append(words_of(text))
            continue
        total = np.zeros(memo.width)
        for part in text_parts(text, PART_CHARS):
            words = words_of(part)
            memo.learn([words])
            total += memo.rows[memo.of(words)].sum(axis=0)
        out.append(total)
    memo.learn([x for x in out if isinstance(x, list)])
    return [memo.rows[memo.of(x)].sum(axis=0) if isinstance(x, list) else x for x in out]
