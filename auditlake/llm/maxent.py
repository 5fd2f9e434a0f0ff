"""Operator 5, language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

Words fall into 256 buckets, 16 classes of 16: the 240 commonest words have a bucket each, in order of frequency, all
others are hashed to the last class. The probability of a word is that of its class given the context, of its bucket
given class and context, and of the word in its bucket by smoothed counts (c + 0.1), where all unknown words of a
bucket share 0.1. Context features are the word before (bigram), the word before that (skip) and a hash of both
(trigram); weights are a table of features by classes and one of features and classes by buckets. Tasks run AdaGrad over
their own training text, all of it, and their changes are averaged by the number of tokens.

Counts are those of all training documents, in a distributed table. Words with 2^-20 or more of all tokens (at most
2^20, 16 MB) are known to every task; all other occurrences meet the table in a join by word.

Cases: null and empty texts hold the end alone. Rows that share an id are one document, their counts and scores added;
a null id is an id of its own and belongs to the training documents. Without training documents every count is 0. Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import durable
from .common import NOT_SPACE, batches, chunks, column, ddl, mix, only, rows
from .updates import averaged, row_sums, softmax_log

FOLDS, HELD_OUT = 10, 0
CLASSES = MEMBERS = 16
OWN = (CLASSES - 1) * MEMBERS
BUCKETS = CLASSES * MEMBERS
START = BUCKETS
SINGLE, PAIRS, PAIR_ROWS = BUCKETS + 1, 2048, 4096
FEATURES = 3
CLASS_ROWS = 2 * SINGLE + PAIRS
MEMBER_ROWS = 2 * SINGLE * CLASSES + PAIR_ROWS
SMOOTH = 0.1
FREQUENT = 1 << 20
FLUSH = 1 << 22
STEP, MINIBATCH = 0.15, 8192
END = np.uint64(0x5EED0E4D)
WORDS = pa.schema([("token", pa.int64()), ("c", pa.int64())])
SCORED = pa.schema([("token", pa.int64()), ("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("s_all", pa.float64()), ("s_model", pa.float64())])


def _tokens(texts: pa.Array, size: int = 1 << 20):
    """(chunk, token hashes, where each text's tokens start): the words of each text and one end."""
    for c in chunks(texts, size=size):
        starts, ends, first = c.words(NOT_SPACE)
        first = first + np.arange(c.n + 1)
        tokens = np.empty(first[-1], np.uint64)
        is_end = np.zeros(len(tokens), bool)
        is_end[first[1:] - 1] = True
        tokens[is_end] = END
        tokens[~is_end] = c.word_hashes(starts, ends)
        yield c, tokens, first


def _count(it):
    """Tasks' function: counts of the task's words."""
    held, total = [], 0
    for batch in batches(it):
        for _, tokens, _ in _tokens(column(batch, "text")):
            held.append(tokens)
            total += len(tokens)
            if total >= FLUSH:
                token, c = np.unique(np.concatenate(held), return_counts=True)
                yield rows(WORDS, token=token.view(np.int64), c=c)
                held, total = [], 0
    if held:
        token, c = np.unique(np.concatenate(held), return_counts=True)
        yield rows(WORDS, token=token.view(np.int64), c=c)


def _hashed(tokens: np.ndarray) -> np.ndarray:
    return OWN + (mix(tokens) % np.uint64(MEMBERS)).astype(np.int64)


class Words:
    """The frequent words, sorted by hash, with counts and buckets."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.counts = tokens[order], counts[order].astype(np.float64)
        self.buckets = _hashed(self.tokens)
        top = np.lexsort((self.tokens, -self.counts))[:OWN]
        self.buckets[top] = np.arange(len(top))
        self.logs = np.log10(self.counts + SMOOTH)

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each token is frequent, its place if so, and its bucket."""
        if not len(self.tokens):
            return np.zeros(len(tokens), bool), np.zeros(len(tokens), np.int64), _hashed(tokens)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        known = self.tokens[at] == tokens
        return known, at, np.where(known, self.buckets[at], _hashed(tokens))


def _contexts(buckets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the class table, and keys of the pair of words, for each token."""
    place = np.arange(len(buckets)) - np.repeat(first[:-1], np.diff(first))
    one, two = np.full(len(buckets), START), np.full(len(buckets), START)
    one[1:] = np.where(place[1:] >= 1, buckets[:-1], START)
    two[2:] = np.where(place[2:] >= 2, buckets[:-2], START)
    pair = mix((one * SINGLE + two).astype(np.uint64))
    return np.stack([one, SINGLE + two, 2 * SINGLE + (pair % np.uint64(PAIRS)).astype(np.int64)], axis=1), pair


def _member_rows(context: np.ndarray, pair: np.ndarray, classes: np.ndarray) -> np.ndarray:
    base = 2 * SINGLE * CLASSES
    hashed = base + (mix(pair ^ (classes.astype(np.uint64) << np.uint64(40))) % np.uint64(PAIR_ROWS)).astype(np.int64)
    return np.stack([context[:, 0] * CLASSES + classes, context[:, 1] * CLASSES + classes, hashed], axis=1)


class Maxent:
    """Bias and weights of the two softmaxes."""

    SIZE = CLASS_ROWS * CLASSES + MEMBER_ROWS * MEMBERS

    def __init__(self, bias: np.ndarray, weights: np.ndarray):
        total = bias.reshape(CLASSES, MEMBERS)
        self.class_bias = np.log(total.sum(axis=1)).astype(np.float32)
        self.member_bias = np.log(total).astype(np.float32)
        self.bias = bias
        cut = CLASS_ROWS * CLASSES
        self.by_class = weights[:cut].reshape(CLASS_ROWS, CLASSES).astype(np.float32)
        self.by_member = weights[cut:].reshape(MEMBER_ROWS, MEMBERS).astype(np.float32)

    def weights(self) -> np.ndarray:
        return np.concatenate([self.by_class.ravel(), self.by_member.ravel()]).astype(np.float64)

    def logs(self, context, pair, buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log probabilities of all classes and of all members of the token's class, and the member rows."""
        classes = buckets // MEMBERS
        at = _member_rows(context, pair, classes)
        by_class = self.by_class[context].sum(axis=1) + self.class_bias
        by_member = self.by_member[at].sum(axis=1) + self.member_bias[classes]
        return softmax_log(by_class), softmax_log(by_member), at

    def score(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 of the probability of each token's bucket."""
        context, pair = _contexts(buckets, first)
        out = np.empty(len(buckets))
        for a in range(0, len(buckets), 1 << 15):
            s = slice(a, a + (1 << 15))
            by_class, by_member, _ = self.logs(context[s], pair[s], buckets[s])
            n = np.arange(len(by_class))
            out[s] = by_class[n, buckets[s] // MEMBERS] + by_member[n, buckets[s] % MEMBERS]
        return out / np.log(10.0)

    def train(self, buckets: np.ndarray, first: np.ndarray, squares: list[np.ndarray]) -> None:
        context, pair = _contexts(buckets, first)
        for a in range(0, len(buckets), MINIBATCH):
            s = slice(a, a + MINIBATCH)
            own = buckets[s]
            by_class, by_member, at = self.logs(context[s], pair[s], own)
            n = np.arange(len(own))
            for table, square, p, right, where in ((self.by_class, squares[0], np.exp(by_class), own // MEMBERS, context[s]), (self.by_member, squares[1], np.exp(by_member), own % MEMBERS, at)):
                p[n, right] -= 1
                place, slope = row_sums(where, p)
                square[place] += slope * slope
                table[place] -= STEP * slope / np.sqrt(square[place])


def vocabulary(training: DataFrame) -> DataFrame:
    """(token, c) of all training texts."""
    return durable(training.select("text").mapInArrow(_count, ddl(WORDS)).groupBy("token").agg(F.sum("c").alias("c")))


def score_documents(docs: DataFrame, held_out, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1) -> DataFrame:
    """Per id: id, n_tokens, n_known, train_tokens, base_score, score. ``held_out``: a condition on the column ``id``."""
    spark = docs.sparkSession
    docs = only(docs, id=id_col, text=text_col)
    training = docs.where(~F.coalesce(held_out, F.lit(False)))
    words = vocabulary(training)
    row = words.agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    distinct, total = row.v, row.n or 0
    often = words.where(F.col("c") * FREQUENT >= total).toArrow()
    frequent = Words(often["token"].to_numpy().view(np.uint64), often["c"].to_numpy())
    # counts of hashed buckets: 16 rows; of own buckets: the word's count
    mass = np.full(BUCKETS, SMOOTH)
    own = frequent.buckets < OWN
    mass[frequent.buckets[own]] += frequent.counts[own]
    sent = spark.sparkContext.broadcast(frequent)

    def rare_mass(it):
        sums = np.zeros(MEMBERS)
        for batch in batches(it):
            token = column(batch, "token").to_numpy().view(np.uint64)
            bucket = sent.value.find(token)[2]
            hashed = bucket >= OWN
            sums += np.bincount(bucket[hashed] - OWN, column(batch, "c").to_numpy()[hashed] + SMOOTH, MEMBERS)
        yield rows(pa.schema([("member", pa.int64()), ("mass", pa.float64())]), member=np.arange(MEMBERS), mass=sums)

    for r in words.mapInArrow(rare_mass, "member BIGINT, mass DOUBLE").groupBy("member").agg(F.sum("mass").alias("mass")).collect():
        mass[OWN + r.member] += r.mass
    model = Maxent(mass, np.zeros(Maxent.SIZE))
    for _ in range(rounds if total else 0):
        now = spark.sparkContext.broadcast(model)

        def train(it, now=now):
            mine = Maxent(now.value.bias, now.value.weights())
            squares = [np.full(x.shape, 1.0, np.float32) for x in (mine.by_class, mine.by_member)]
            seen = 0
            for batch in it:
                for _, tokens, first in _tokens(column(batch, "text")):
                    mine.train(sent.value.find(tokens)[2], first, squares)
                    seen += len(tokens)
            return mine.weights() - now.value.weights(), seen

        change, _ = averaged(training.select("text"), train, Maxent.SIZE)
        model = Maxent(mass, model.weights() + change)
    final = spark.sparkContext.broadcast((frequent, model, np.log10(mass)))

    def score(it):
        frequent, model, log_mass = final.value
        for batch in batches(it):
            ids = column(batch, "id")
            for c, tokens, first in _tokens(column(batch, "text")):
                known, at, bucket = frequent.find(tokens)
                hashed = bucket >= OWN
                logs = np.where(known, frequent.logs[at], 0.0) if len(frequent.logs) else np.zeros(len(tokens))
                part = model.score(bucket, first) + np.where(hashed, logs - log_mass[bucket], 0.0)
                own = ids.slice(c.first, c.n)
                key = mix(np.arange(c.n, dtype=np.uint64) + tokens[first[:-1]])
                yield rows(SCORED, token=key.view(np.int64), id=own, n_tokens=np.diff(first), n_known=np.add.reduceat(known.astype(np.int64), first[:-1]),
                           s_all=np.add.reduceat(logs, first[:-1]), s_model=np.add.reduceat(part, first[:-1]))
                rare = np.flatnonzero(~known)
                if len(rare):
                    owner = pa.array(np.searchsorted(first, rare, "right") - 1)
                    none = pa.nulls(len(rare))
                    yield rows(SCORED, token=tokens[rare].view(np.int64), id=own.take(owner), n_tokens=none, n_known=none, s_all=none, s_model=none)

    rare = F.col("n_tokens").isNull()
    log = F.when(rare, F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).otherwise(0.0)
    sums = (
        docs.mapInArrow(score, ddl(SCORED)).join(words.where(F.col("c") * FREQUENT < total), "token", "left").groupBy("id").agg(
            F.sum("n_tokens").alias("n_tokens"), F.sum(F.coalesce("n_known", (rare & F.col("c").isNotNull()).cast("long"))).alias("n_known"),
            F.sum(F.coalesce("s_all", F.lit(0.0)) + log).alias("s_all"), F.sum(F.coalesce("s_model", F.lit(0.0)) + log).alias("score"))
    )
    scale = float(np.log10(total + SMOOTH * (distinct + 1)))
    return sums.select("id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("s_all") - F.col("n_tokens") * scale).alias("base_score"), "score")
