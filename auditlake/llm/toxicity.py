"""Operator 8, toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary documents, are counted from labelled documents: in how many documents of the class
each word and each word pair occurs. Both models back off to one shared base: discounted counts of both classes,
interpolated with continuation counts (how many different words a word follows). A class moves away from its backoff
only as far as its own counts carry (``KAPPA`` expected occurrences count as much as the backoff), so an expression
seen rarely or never has the same probability in both models.

A document's features are length-normalised differences of the two log-likelihoods: over the whole text, and the
largest over runs of 1, 3 and 8 words, since a few words make a long text toxic; each for the models of single words
(the backoff order) and for the models of pairs. A logistic regression over them, fitted on a fold that the counts have
not seen, gives the score.

The models are fitted on at most ``LABELS`` labelled rows (the documented bound); every document is scored.
Counts are hashed, so the models have a fixed size: 2^18 words and 2^19 pairs of two classes, 12 MB.

Cases: null and empty texts have features 0 and get the score of those. Rows are scored one by one, repeated or not.
Labels without text, null labels and null ids teach nothing; with labels of fewer than two classes every score is the
share of label 1 (0 without labels). Extra columns are kept by ``score_documents`` and never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import durable
from .common import ALNUM, batches, bucket, chunks, column, ddl, logistic, mix, only, per_text, previous, rows, sample_of_labels, scored, sigmoid

#: at most so many labelled rows are used to fit
LABELS = 20_000
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4
WORD_BITS, PAIR_BITS, CONTEXT_BITS = 18, 19, 10
DISCOUNT, KAPPA = 0.75, 1.0
RUNS = (1, 3, 8)
COUNTS = pa.schema([("kind", pa.int32()), ("code", pa.int64()), ("label", pa.int32()), ("n", pa.int64())])
FEATURES = pa.schema([("label", pa.int32()), *((f"f{i}", pa.float64()) for i in range(2 * len(RUNS) + 2))])
FIELDS = "n_tox_words BIGINT, tox_score DOUBLE"


def _pairs(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A code of each word and the word before it: the word's bucket, then bits of the other."""
    return (bucket(words, WORD_BITS) << CONTEXT_BITS) | bucket(mix(previous(words, first)), CONTEXT_BITS)


def _pair_bucket(codes: np.ndarray) -> np.ndarray:
    return bucket(mix(codes.astype(np.uint64) + np.uint64(1)), PAIR_BITS)


def _count(it):
    """Tasks' function: in how many documents of each class each word bucket (kind 0) and pair code (kind 1) occurs."""
    for batch in batches(it):
        labels = column(batch, "label").to_numpy()
        for c in chunks(column(batch, "text"), size=8 << 20):
            starts, ends, first = c.words(ALNUM)
            if not len(starts):
                continue
            words = c.word_hashes(starts, ends)
            owner = np.repeat(np.arange(c.n), np.diff(first))
            for kind, codes in enumerate((bucket(words, WORD_BITS), _pairs(words, first))):
                seen = np.unique((owner.astype(np.int64) << 30) | codes)
                label = labels[c.first + (seen >> 30)]
                code, n = np.unique(((seen & ((1 << 30) - 1)) << 1) | label, return_counts=True)
                yield rows(COUNTS, kind=np.full(len(code), kind, np.int32), code=code >> 1, label=(code & 1).astype(np.int32), n=n)


def _features(texts: pa.Array, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Word counts, and a row of length-normalised log-likelihood differences for each text."""
    counts, out = [], []
    for c in chunks(texts):
        starts, ends, first = c.words(ALNUM)
        words = c.word_hashes(starts, ends)
        n = np.diff(first)
        word, pair = bucket(words, WORD_BITS), _pair_bucket(_pairs(words, first))
        before = bucket(previous(words, first), WORD_BITS)
        at_start = np.arange(len(words)) == np.repeat(first[:-1], n)
        seen = np.where(at_start[None, :], 0, model["words"][:, before])
        base = model["base"][:, word]
        ratio = np.log(model["pairs"][:, pair] + KAPPA) - np.log(seen * base + KAPPA)
        word_llr = np.log(base[1]) - np.log(base[0])
        f = []
        stop = np.repeat(first[1:], n)
        at = np.arange(len(words))
        for llr in (word_llr, word_llr + ratio[1] - ratio[0]):
            total = np.concatenate([[0.0], np.cumsum(llr)])
            f.append(per_text(llr, first, np.add, 0.0) / np.maximum(n, 1))
            for run in RUNS:
                f.append(per_text((total[np.minimum(at + run, stop)] - total[at]) / run, first, np.maximum, 0.0))
        counts.append(n)
        out.append(np.column_stack(f))
    return np.concatenate(counts), np.concatenate(out)


class ToxicityModel:
    """Fitted tables and weights, a few MB, broadcast to the tasks that score."""

    def __init__(self, tables: dict | None, weights: np.ndarray | None, share: float):
        self.tables, self.weights, self.share = tables, weights, share

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(0)
        if self.tables is None:
            return np.concatenate([np.diff(c.words(ALNUM)[2]) for c in chunks(texts)]), np.full(len(texts), self.share)
        n, f = _features(texts, self.tables)
        return n, sigmoid(np.column_stack([f, np.ones(len(f))]) @ self.weights)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = LABELS) -> ToxicityModel:
    """Count the models and fit the regression from at most ``most`` labelled rows outside the held-out fold."""
    picked = durable(sample_of_labels(labels, label_col, most, FOLDS, HELD_OUT))
    stats = {r.label: r.n for r in picked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = stats.get(1, 0) / max(sum(stats.values()), 1)
    # the sample is bounded by ``most`` rows of ids and labels, so it may be broadcast; the texts stay where they are
    known = durable(only(docs, id=id_col, text=text_col).join(F.broadcast(picked), "id").select("id", "text", F.expr("int(label > 0)").alias("label"), "fold"))
    counted = durable(
        known.where(F.col("fold") != CALIBRATION).repartition(8, "id").mapInArrow(_count, ddl(COUNTS))
        .groupBy("kind", "code", "label").agg(F.sum("n").alias("n")))
    words = np.zeros((2, 1 << WORD_BITS))
    for r in counted.where("kind = 0").toArrow().to_batches():
        words[column(r, "label").to_numpy(), column(r, "code").to_numpy()] = column(r, "n").to_numpy()
    if not all(words.sum(axis=1)):
        return ToxicityModel(None, None, share)
    follows = np.zeros(1 << WORD_BITS)
    continuation = counted.where("kind = 1").select("code").distinct().groupBy(F.shiftright("code", CONTEXT_BITS).alias("word")).count()
    for r in continuation.toArrow().to_batches():
        follows[column(r, "word").to_numpy()] = column(r, "count").to_numpy()
    pairs = np.zeros((2, 1 << PAIR_BITS))
    often = counted.where("kind = 1 AND n >= 2")  # once or never: the backoff alone speaks
    for r in often.toArrow().to_batches():
        np.add.at(pairs, (column(r, "label").to_numpy(), _pair_bucket(column(r, "code").to_numpy())), np.maximum(column(r, "n").to_numpy() - DISCOUNT, 0))
    both, totals = words.sum(axis=0), words.sum(axis=1)
    shared = np.maximum(both - DISCOUNT, 0) / both.sum() + DISCOUNT * (both > 0).sum() / both.sum() * (follows + 0.01) / (follows + 0.01).sum()
    base = np.stack([shared * (np.maximum(words[k] - DISCOUNT, 0) + KAPPA) / (totals[k] * shared + KAPPA) for k in (0, 1)])
    tables = {"words": words.astype(np.float32), "base": base, "pairs": pairs.astype(np.float32)}

    sent = docs.sparkSession.sparkContext.broadcast(tables)

    def features(it):
        for batch in batches(it):
            _, f = _features(column(batch, "text"), sent.value)
            yield rows(FEATURES, label=column(batch, "label"), **{f"f{i}": f[:, i] for i in range(f.shape[1])})

    held = known.where(F.col("fold") == CALIBRATION).select("text", "label").mapInArrow(features, ddl(FEATURES)).toPandas()
    y = held.pop("label").to_numpy() if len(held) else np.zeros(0)
    if len(set(y.tolist())) < 2:
        return ToxicityModel(None, None, share)
    return ToxicityModel(tables, logistic(held.to_numpy(), y), share)


def score_documents(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tox_words`` and ``tox_score``, the probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts):
        n, s = sent.value.score(texts)
        return {"n_tox_words": n, "tox_score": s}

    return scored(docs, text_col, FIELDS, score)
