"""Operator 6, quality classifier from weak labels.

Seven overlapping labellers vote good (1), bad (-1) or nothing (0) on each document, from its length, symbols, repeated
words, word length, capitals, distinct words and line ends. Expectation-maximisation over the counts of vote patterns
estimates, for good and for bad documents, how often each labeller gives each vote; the posterior of a pattern is the
weak label of its documents. A linear scorer over hashed words and word shapes is trained on these labels: tasks run
AdaGrad over all their documents and their changes are averaged by the number of documents. A document is kept if the
scorer gives it one half or more.

There are at most 3^7 patterns, so their counts are collected whatever the number of documents. The scorer has 2^15
weights.

Cases: null, empty and wordless texts get the votes of a text of no words, and the scorer's intercept. Rows are judged one
by one, repeated or not. If all documents show one pattern, its majority decides. Extra columns are kept and never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import BYTES, NOT_SPACE, VALUES, batches, bucket, chunks, column, ddl, only, part, per_text, rows, running, scored, sigmoid
from .quality import _rules, _sums
from .updates import averaged

LABELLERS = ("length", "symbols", "repeats", "word_length", "capitals", "distinct", "line_ends")
BITS = 15
STEP, EPOCHS, RIDGE = 0.2, 3, 1e-4
ROUNDS = 100
PATTERNS = pa.schema([("pattern", pa.int64())])
FIELDS = "weak_label DOUBLE, quality_score DOUBLE"
#: shapes: letters by case, digits, longer characters, line and word punctuation, other signs
SHAPE = np.select([(BYTES >= 65) & (BYTES <= 90), (BYTES >= 97) & (BYTES <= 122), (BYTES >= 48) & (BYTES <= 57), BYTES >= 128, np.isin(BYTES, np.frombuffer(b".,;:!?'\"-()", np.uint8))], [1, 2, 3, 4, 5], 6)
UPPER, LOWER_CASE = SHAPE == 1, SHAPE == 2
FULL_STOPS = np.isin(BYTES, np.frombuffer(b".!?\"'", np.uint8))


def _votes(c, words, starts, ends, first) -> np.ndarray:
    """A row of votes for each text of a chunk whose texts are separated by line feeds."""
    counts = _rules(c, words, starts, first)
    n = counts["n_words"]
    per = np.maximum(n, 1)
    owner = np.repeat(np.arange(c.n), n)
    upper, lower = _sums(UPPER[c.data], c.at), _sums(LOWER_CASE[c.data], c.at)
    fresh = np.ones(len(words), bool)
    order = np.lexsort((words, owner))
    if len(words):
        fresh[1:] = (words[order][1:] != words[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][fresh], minlength=c.n)
    line_end = np.flatnonzero(np.append(c.data, np.uint8(10)) == 10)
    line_end = line_end[(line_end > 0) & (c.data[np.maximum(line_end - 1, 0)] != 10)] if len(c.data) else line_end[:0]
    line_owner = c.text_of(line_end - 1)
    stopped = np.bincount(line_owner[FULL_STOPS[c.data[line_end - 1]]], minlength=c.n) / np.maximum(np.bincount(line_owner, minlength=c.n), 1)
    word_length = counts["word_chars"] / per
    share = lambda bad, good: np.where(bad, -1, np.where(good, 1, 0))
    return np.stack([
        share(n < 20, n >= 50), share(counts["n_symbols"] > 0.1 * per, counts["n_symbols"] < 0.02 * per),
        share(counts["n_repeat_words"] > 0.3 * per, (counts["n_repeat_words"] < 0.05 * per) & (n >= 20)),
        share((word_length < 2.5) | (word_length > 12), (word_length >= 3) & (word_length <= 10)),
        share(upper > 0.4 * np.maximum(upper + lower, 1), upper < 0.2 * np.maximum(upper + lower, 1)),
        share((distinct < 0.2 * per) & (n >= 20), (distinct > 0.35 * per) & (n >= 20)), share(stopped < 0.2, stopped > 0.6)], axis=1)


def _features(c, words, starts, ends) -> np.ndarray:
    """Buckets of each word and of its shape, the runs of its kinds of characters."""
    kind = SHAPE[c.data].astype(np.int64)
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[starts] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    shape = part(running(VALUES[kind[keep]]), place[starts], place[ends])
    half = 1 << (BITS - 1)
    return np.stack([bucket(words, BITS - 1), half + bucket(shape, BITS - 1)])


def _chunks(texts: pa.Array):
    for c in chunks(texts, b"\n"):
        starts, ends, first = c.words(NOT_SPACE)
        words = c.word_hashes(starts, ends, VALUES)
        code = (_votes(c, words, starts, ends, first) + 1) @ 3 ** np.arange(len(LABELLERS))
        yield c, code.astype(np.int64), _features(c, words, starts, ends), first


def _patterns(it):
    for batch in batches(it):
        for _, code, _, _ in _chunks(column(batch, "text")):
            yield rows(PATTERNS, pattern=code)


def posteriors(pattern: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The probability of good for every vote pattern code, by expectation-maximisation from the majority vote."""
    every = np.arange(3 ** len(LABELLERS))
    votes = lambda codes: (codes[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
    seen, all_votes = votes(pattern), votes(every)
    good = sigmoid(1.0 * (seen - 1).sum(axis=1))
    at = np.arange(len(LABELLERS))
    rates, prior = np.zeros((2, len(LABELLERS), 3)), 0.5
    for _ in range(ROUNDS):
        for k, weight in enumerate((count * (1 - good), count * good)):
            for vote in range(3):
                rates[k, :, vote] = ((seen == vote) * weight[:, None]).sum(axis=0) + (2.0 if vote == 2 * k else 1.0)
            rates[k] /= rates[k].sum(axis=1, keepdims=True)
        prior = (count * good).sum() / count.sum()
        prior = min(max(prior, 1e-6), 1 - 1e-6)
        odds = np.log(prior / (1 - prior)) + (np.log(rates[1][at, seen]) - np.log(rates[0][at, seen])).sum(axis=1)
        good = sigmoid(odds)
    return sigmoid(np.log(prior / (1 - prior)) + (np.log(rates[1][at, all_votes]) - np.log(rates[0][at, all_votes])).sum(axis=1))


def _linear(weights: np.ndarray, features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Scores before the logistic function: intercept, and the mean weight of words and of shapes."""
    n = np.maximum(np.diff(first), 1)
    return weights[-1] + per_text(weights[features[0]] + weights[features[1]], first, np.add, 0.0) / n


def _train(label: np.ndarray, batches_of_task) -> tuple[np.ndarray, float]:
    weights, squares, seen = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-3), 0
    for batch in batches_of_task:
        for c, code, features, first in _chunks(column(batch, "text")):
            n = np.diff(first)
            owner = np.repeat(np.arange(c.n), n)
            for _ in range(EPOCHS):
                slope = sigmoid(_linear(weights, features, first)) - label[code]
                share = (slope / np.maximum(n, 1))[owner]
                g = np.bincount(features[0], share, len(weights)) + np.bincount(features[1], share, len(weights))
                g[-1] = slope.sum()
                g += RIDGE * c.n * weights
                squares += g * g
                weights -= STEP * 10 * g / np.sqrt(squares)
            seen += c.n
    return weights, seen


class QualityClassifier:
    """Posterior of each vote pattern, and the scorer's weights."""

    def __init__(self, posterior: np.ndarray, weights: np.ndarray):
        self.posterior, self.weights = posterior, weights


def fit(docs: DataFrame, text_col: str = "text") -> QualityClassifier:
    texts = only(docs, text=text_col)
    counted = texts.mapInArrow(_patterns, ddl(PATTERNS)).groupBy("pattern").count().toArrow()  # 3^7 rows at most
    pattern, count = counted["pattern"].to_numpy(), counted["count"].to_numpy().astype(float)
    if not len(pattern):
        return QualityClassifier(np.full(3 ** len(LABELLERS), 0.5), np.zeros((1 << BITS) + 1))
    posterior = posteriors(pattern, count)
    sent = docs.sparkSession.sparkContext.broadcast(posterior)
    weights, _ = averaged(texts, lambda it: _train(sent.value, it), (1 << BITS) + 1)
    return QualityClassifier(posterior, weights)


def score_documents(docs: DataFrame, model: QualityClassifier, text_col: str = "text") -> DataFrame:
    """``docs`` with weak_label (the posterior of its votes), quality_score and kept."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts):
        labels, scores = [np.zeros(0)], [np.zeros(0)]
        for _, code, features, first in _chunks(texts):
            labels.append(sent.value.posterior[code])
            scores.append(sigmoid(_linear(sent.value.weights, features, first)))
        return {"weak_label": np.concatenate(labels), "quality_score": np.concatenate(scores)}

    return scored(docs, text_col, FIELDS, score).withColumn("kept", F.col("quality_score") >= 0.5)
