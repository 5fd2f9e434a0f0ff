"""Operator 7, language identification by prediction by partial matching.

For each language of the training rows, a context tree over byte classes: letters without case, the bytes of longer
UTF-8 characters by their low bits, and one class for all else (runs of it count once). Contexts of up to three classes
predict the next class; contexts of two and fewer are all kept, longer ones if they make up 2^-14 of the language's
text or more (so at most 2^14 of them). The escape from a context to the next shorter one has probability
d / (n + d) for n observations of d different classes, and classes seen in the longer context are excluded below. The
statistics are frozen, so the code length of a text under each language is a sum of table entries; the shortest wins.
The score is the winner's share of 2^-length over all languages.

Cases: null texts and texts without a letter are ``und`` with score 0. Ties go to the first language by name. Rows are
judged one by one, repeated or not. Without training rows everything is ``und``. Extra columns are never read. One table
of about 4 MB per language is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import durable
from .common import BYTES, LOWER, batches, chunks, column, ddl, only, rows, scored

#: byte classes: 0 all else, 1-26 letters, 27-31 first bytes of longer characters, 32-63 their other bytes
CLASSES = np.select(
    [(LOWER >= 97) & (LOWER <= 122), (BYTES >= 0x80) & (BYTES < 0xC0), (BYTES >= 0xC0) & (BYTES < 0xC4), (BYTES >= 0xC4) & (BYTES < 0xD0), (BYTES >= 0xD0) & (BYTES < 0xE0), (BYTES >= 0xE0) & (BYTES < 0xF0), BYTES >= 0xF0],
    [LOWER.astype(int) - 96, 32 + (BYTES & 31), 27, 28, 29, 30, 31], 0).astype(np.int32)
N = 64
PRUNE = 1 << 14
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
COUNTS = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])
FIELDS = "lang_pred STRING, lang_score DOUBLE"


def _symbols(c) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of a chunk's texts with runs of class 0 as one, the code of the three before each, and where texts start."""
    s = CLASSES[c.data]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    heads = c.at[:-1][c.at[:-1] < len(s)]
    keep[heads] = True
    separators = c.at[1:-1] - 1
    keep[separators] = False
    place = np.concatenate([[0], np.cumsum(keep)])
    first = place[np.minimum(c.at, len(s))]
    s = s[keep]
    at = np.arange(len(s)) - np.repeat(first[:-1], np.diff(first))
    context = np.zeros(len(s), np.int32)
    for back in (3, 2, 1):
        before = np.zeros_like(s)
        before[back:] = s[: len(s) - back]
        before[at < back] = 0
        context = context * N + before
    return s, context, first


def _count(it):
    """Tasks' function: how often each class follows each three classes, per language."""
    names: list[str] = []
    held: dict[int, list] = {}
    for batch in batches(it):
        langs = column(batch, "lang").to_pylist()
        for c in chunks(column(batch, "text"), size=4 << 20):
            s, context, first = _symbols(c)
            own = langs[c.first : c.first + c.n]
            for name in sorted({*own}):
                if name not in names:
                    names.append(name)
                take = np.repeat(np.array([x == name for x in own]), np.diff(first))
                codes, n = np.unique(context[take] * N + s[take], return_counts=True)
                mine = held.setdefault(names.index(name), [])
                mine.append((codes, n))
                if len(mine) > 16:
                    held[names.index(name)] = [_merged(mine)]
    for at, mine in held.items():
        codes, n = _merged(mine)
        yield rows(COUNTS, lang=pa.array([names[at]] * len(codes), pa.string()), code=codes.astype(np.int64), n=n.astype(np.int64))


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)


def _predicted(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities of the next class: counts by context, and the distribution one order below for each context."""
    seen = counts > 0
    n, d = counts.sum(axis=1, keepdims=True), seen.sum(axis=1, keepdims=True)
    rest = np.where(seen, 0.0, lower)
    left = rest.sum(axis=1, keepdims=True)
    escape = np.where(left > 0, d / np.maximum(n + d, 1), 0.0)  # nothing to escape to once all classes are seen
    own = np.where(left > 0, counts / np.maximum(n + d, 1), counts / np.maximum(n, 1))
    return np.where(n > 0, own + escape * rest / np.where(left > 0, left, 1.0), lower)


class LanguageModel:
    """Names, the row of each long context (or -1), and code lengths by (row, class, language)."""

    def __init__(self, names: list[str], row: np.ndarray, bits: np.ndarray):
        self.names, self.row, self.bits = names, row, bits

    def score(self, texts: pa.Array) -> dict:
        names, scores = [], []
        for c in chunks(texts):
            best, share = np.zeros(c.n, int), np.zeros(c.n)
            letters = np.zeros(c.n, bool)
            if len(c.data) and self.names:
                s, context, first = _symbols(c)
                full = np.flatnonzero(np.diff(first))
                if len(s):
                    row = self.row[context]
                    row = np.where(row < 0, context % (N * N), row)
                    bits = self.bits[row * N + s]
                    length = np.zeros((c.n, len(self.names)))
                    length[full] = np.add.reduceat(bits, first[full], axis=0, dtype=np.float64)
                    best = length.argmin(axis=1)
                    short = length.min(axis=1)
                    share = 1.0 / np.exp2(np.clip(short[:, None] - length, -1000, 0)).sum(axis=1)
                    letters[full] = np.add.reduceat(((s > 0) & (s < 27)).astype(np.int64), first[full]) > 0
                for at in np.flatnonzero(~letters & (c.lengths > 0)):
                    text = c.data[c.at[at] : c.at[at] + c.lengths[at]].tobytes().decode("utf-8", "replace")
                    letters[at] = any(map(str.isalpha, text))
            names += [self.names[b] if has else UNKNOWN for b, has in zip(best, letters, strict=True)]
            scores.append(np.where(letters, share, 0.0))
        return {"lang_pred": pa.array(names, pa.string()), "lang_score": np.concatenate(scores) if scores else np.zeros(0)}


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", prune: int = PRUNE) -> LanguageModel:
    """Count all of ``docs`` (text and language not null) and freeze the trees."""
    known = only(docs, text=text_col, lang=lang_col).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = durable(known.mapInArrow(_count, ddl(COUNTS)).groupBy("lang", "code").agg(F.sum("n").alias("n")))
    names = sorted(r.lang for r in counts.select("lang").distinct().collect())
    if not names:
        return LanguageModel([], np.full(N ** 3, -1, np.int32), np.zeros((0, 0), np.float32))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    long = counts.withColumn("context", F.shiftright("code", 6))
    kept = long.groupBy("lang", "context").agg(F.sum("n").alias("seen")).join(F.broadcast(total), "lang").where(F.col("seen") * prune >= F.col("total"))
    top = long.join(kept.select("lang", "context"), ["lang", "context"]).select("lang", "code", "n").toArrow()
    low = counts.groupBy("lang", F.expr(f"code % {N ** 3}").alias("code")).agg(F.sum("n").alias("n")).toArrow()  # N^3 rows per language at most
    contexts = np.unique(top["code"].to_numpy() // N)
    row = np.full(N ** 3, -1, np.int32)
    row[contexts] = N * N + np.arange(len(contexts), dtype=np.int32)
    bits = np.zeros(((N * N + len(contexts)) * N, len(names)), np.float32)
    low_lang, top_lang = np.array(low["lang"].to_pylist()), np.array(top["lang"].to_pylist())
    for at, name in enumerate(names):
        two = np.zeros(N ** 3)
        mine = low_lang == name
        two[low["code"].to_numpy()[mine]] = low["n"].to_numpy()[mine]
        two = two.reshape(N, N, N)
        p = _predicted(two.sum(axis=(0, 1))[None, :], np.full((1, N), 1.0 / N))
        p = _predicted(two.sum(axis=0), np.broadcast_to(p, (N, N)))
        p = _predicted(two.reshape(N * N, N), np.tile(p, (N, 1)))
        three = np.zeros((len(contexts), N))
        mine = top_lang == name
        code = top["code"].to_numpy()[mine]
        three[row[code // N] - N * N, code % N] = top["n"].to_numpy()[mine]
        bits[:, at] = -np.log2(np.concatenate([p, _predicted(three, p[contexts % (N * N)])]).reshape(-1))
    return LanguageModel(names, row, bits)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and lang_score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return scored(docs, text_col, FIELDS, lambda texts: sent.value.score(texts))
