"""Operator 4, quality rules with a hashed n-gram log-likelihood ratio.

Two multinomials over 2^15 hashed words and word pairs are counted: one over all documents, one over all trusted documents
(label 1) but a fifth. A document's score is the mean of log(trusted / raw) over its words and pairs. The verdict is a fixed
threshold for every document alike: the ``SPARED`` quantile of the scores of the trusted documents that were not counted. Plain rules come first: too few words, or too many of them in repeated
eight-word windows.

Cases: null, empty and wordless texts have no words, score 0 and fail the plain rules. Rows are judged one by one,
repeated or not. Without trusted rows nothing but the plain rules speaks. Labels without text, null ids and null labels
teach nothing. Extra columns are kept and never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import durable
from .common import BYTES, NOT_SPACE, VALUES, batches, bucket, chunks, column, ddl, grams, mix, only, part, per_text, previous, rows, running, scored

FOLDS, THRESHOLD_FOLD = 1 << 20, 4
BITS = 15
PRIOR = 0.5
SPARED = 0.002
LEAST_WORDS, MOST_REPEATED, REPEATED = 20, 30, 8
SYMBOLS = np.isin(BYTES, np.frombuffer(b"#*$%&|<>", np.uint8))
CODE_POINT = (BYTES & 0xC0) != 0x80
COUNTS = pa.schema([("bucket", pa.int64()), ("raw", pa.int64()), ("trusted", pa.int64())])
FIELDS = "n_words BIGINT, word_chars BIGINT, n_symbols BIGINT, n_dup_lines BIGINT, n_repeat_words BIGINT, llr DOUBLE"


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set from each place to the next."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[np.minimum(at, len(flags))])


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs twice or more, and whether it is not the first of its kind."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def _features(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Buckets of words and of pairs, two rows."""
    return np.stack([bucket(words, BITS), bucket(mix(previous(words, first) * np.uint64(3) + words), BITS)])


def _rules(c, words, starts, first) -> dict:
    """The plain counts of the texts of a chunk whose texts are separated by line feeds."""
    n, size = np.diff(first), len(c.data)
    owner = np.repeat(np.arange(c.n), n)
    inside = NOT_SPACE[c.data]
    salt = mix(np.arange(c.n, dtype=np.uint64) + np.uint64(1))
    ends = np.append(np.flatnonzero(c.data == 10), size)
    begins = np.append(0, ends[:-1] + 1)
    full = np.searchsorted(starts, begins) < np.searchsorted(starts, ends)
    begins, ends = begins[full], ends[full]
    line_owner = c.text_of(begins)
    _, later = _again(part(running(VALUES[c.data]), begins, ends) ^ salt[line_owner])
    repeated = np.zeros(len(words) + 1, np.int64)
    h, good = grams(words, REPEATED, first)
    at = np.flatnonzero(good)
    if len(at):
        twice, _ = _again(h[at] ^ salt[owner[at]])
        np.add.at(repeated, at[twice], 1)
        np.add.at(repeated, at[twice] + REPEATED, -1)
    return {
        "n_words": n, "word_chars": _sums(inside & CODE_POINT[c.data], c.at), "n_symbols": _sums(SYMBOLS[c.data], c.at),
        "n_dup_lines": np.bincount(line_owner[later], minlength=c.n).astype(np.int64),
        "n_repeat_words": _sums(np.cumsum(repeated[:-1]) > 0, first),
    }


def _count(it):
    """Tasks' function: counts of each bucket in all documents and in the trusted ones."""
    raw, trusted = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for batch in batches(it):
        marked = column(batch, "trusted").to_numpy(zero_copy_only=False).astype(bool)
        for c in chunks(column(batch, "text"), b"\n"):
            starts, ends, first = c.words(NOT_SPACE)
            f = _features(c.word_hashes(starts, ends, VALUES), first)
            own = np.repeat(marked[c.first : c.first + c.n], np.diff(first))
            for row in f:
                raw += np.bincount(row, minlength=1 << BITS)
                trusted += np.bincount(row[own], minlength=1 << BITS)
    at = np.flatnonzero(raw)
    yield rows(COUNTS, bucket=at, raw=raw[at], trusted=trusted[at])


def _scores(texts: pa.Array, ratio: np.ndarray | None) -> dict:
    out: dict = {}
    for c in chunks(texts, b"\n"):
        starts, ends, first = c.words(NOT_SPACE)
        words = c.word_hashes(starts, ends, VALUES)
        new = _rules(c, words, starts, first)
        if ratio is None or not len(words):
            new["llr"] = np.zeros(c.n)
        else:
            f = _features(words, first)
            new["llr"] = per_text(ratio[f[0]] + ratio[f[1]], first, np.add, 0.0) / np.maximum(2 * np.diff(first), 1)
        for k, v in new.items():
            out.setdefault(k, []).append(v)
    return {k: np.concatenate(v) for k, v in out.items()}


class QualityModel:
    """The table of log ratios (256 KB) and the threshold; no table: the plain rules alone."""

    def __init__(self, ratio: np.ndarray | None, threshold: float):
        self.ratio, self.threshold = ratio, threshold


def trusted_ids(labels: DataFrame, label_col: str) -> DataFrame:
    """(id, fold) of label 1, folds 0 to 4. Null ids and labels are passed over; the largest label of an id counts."""
    fold = F.crc32(F.col("id").cast("string")) % FOLDS % 5
    return (
        only(labels, id="doc_id", label=label_col).where("id IS NOT NULL AND label IS NOT NULL")
        .groupBy("id").agg(F.max("label").alias("label")).where("label = 1").select("id", fold.cast("int").alias("fold"))
    )


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    picked = durable(trusted_ids(labels, label_col))
    rest = F.col("fold").isNotNull() & (F.col("fold") != THRESHOLD_FOLD)
    given = only(docs, id=id_col, text=text_col)
    # neither side is bounded, so neither is broadcast
    texts = given.join(picked.hint("merge"), "id", "left")
    counted = (
        texts.select("text", rest.alias("trusted")).mapInArrow(_count, ddl(COUNTS))
        .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toArrow()  # 2^15 rows at most
    )
    raw, trusted = np.zeros(1 << BITS), np.zeros(1 << BITS)
    raw[counted["bucket"].to_numpy()] = counted["raw"].to_numpy()
    trusted[counted["bucket"].to_numpy()] = counted["trusted"].to_numpy()
    if not trusted.sum():
        return QualityModel(None, 0.0)
    base = (raw + PRIOR) / (raw + PRIOR).sum()
    # the raw shares are the prior of the trusted ones: a bucket without trusted counts is unlikely, not impossible
    weight = len(raw) * PRIOR
    ratio = np.log((trusted + weight * base) / (trusted.sum() + weight)) - np.log(base)
    model = QualityModel(ratio, -np.inf)
    # all documents are scored and only their scores are moved: trusted ones are most of them
    scores = score_documents(given, model).where("NOT base_failed").select("id", "llr")
    held = durable(scores.join(picked.where(F.col("fold") == THRESHOLD_FOLD).hint("merge"), "id").select("llr"))
    n = held.count()
    if n:
        model.threshold = float(held.orderBy("llr").limit(int(SPARED * n) + 1).agg(F.max("llr")).first()[0])
    return model


def score_documents(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with the plain counts, llr, base_failed and kept."""
    sent, threshold = docs.sparkSession.sparkContext.broadcast(model.ratio), model.threshold
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    verdict = F.lit(True) if model.ratio is None or not np.isfinite(threshold) else F.col("llr") >= threshold
    return scored(docs, text_col, FIELDS, lambda texts: _scores(texts, sent.value)).withColumn("base_failed", failed).withColumn("kept", ~failed & verdict)
