"""Operator 1, benchmark decontamination by winnowing.

A window is ``WINDOW`` consecutive words of a benchmark item (a shorter item is one window). Of the k-word hashes of
each window, the smallest is kept as a fingerprint, in items and documents alike, so any shared window shares a
fingerprint at the same place. Fingerprints are joined by hash, and each hit is extended word by word to both sides;
it counts if the common run is at least a window long. Fingerprint and extension compare 64-bit word hashes.

Cost: one pass over the documents. A bit array of fixed size over all item fingerprints keeps unshared fingerprints
from being shuffled; the join itself is a plain equi-join on the fingerprint.

Cases: null or wordless texts have no words and no hits. Rows that share an id are one document: their words are added, and
whether it is contaminated is decided on the words and hits of all its rows; ``n_hit`` counts places, those that are hit in
several rows once. A null id is an id of its own. Repeated items with different ids all count. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import durable
from .common import ALNUM, batches, bit_array, chunks, column, ddl, grams, in_bit_array, mix, only, packed, rows

WINDOW = 13
K = 9
#: bits of the array over item fingerprints: 2 MB on driver and executors, whatever the size of the benchmark
BITS = 1 << 24
SIDE = WINDOW - K
FOUND = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("n_words", pa.int64()), ("pos", pa.int64()), ("span", pa.int32()), ("h", pa.int64()), ("context", pa.binary())])
SPANS = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("h", pa.int64()), ("context", pa.binary())])


def _short(hashes: np.ndarray, first: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``m`` words as windows of short items, and their places."""
    h, inside = grams(hashes, m, first)
    at = np.flatnonzero(inside)
    return mix(h[at] ^ np.uint64(m)), at


def _selected(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed k-gram hashes and their places: the smallest of every window."""
    h, _ = grams(hashes, K, first)
    _, windows = grams(hashes, WINDOW, first)
    n = len(windows)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least = h[:n].copy()
    for j in range(1, SIDE + 1):
        np.minimum(least, h[j : j + n], out=least)
    kept = np.zeros(len(h), bool)
    for j in range(SIDE + 1):
        kept[j : j + n] |= windows & (h[j : j + n] == least)
    at = np.flatnonzero(kept)
    return h[at], at


def _context(hashes: np.ndarray, first: np.ndarray, at: np.ndarray, pad: int) -> np.ndarray:
    """Word hashes from ``SIDE`` words before to ``SIDE`` words after each k-gram; ``pad`` beyond the text's ends."""
    owner = np.searchsorted(first, at, "right") - 1
    place = at[:, None] + np.arange(-SIDE, K + SIDE)[None, :]
    inside = (place >= first[owner][:, None]) & (place < first[owner + 1][:, None])
    return np.where(inside, hashes[np.clip(place, 0, len(hashes) - 1)], np.uint64(pad))


def _fingerprints(shorts: list[int], bitmap=None, per_text: bool = True, whole_short: bool = False):
    """Tasks' function: a row of word counts for each text, and a row for each fingerprint that the bitmap lets pass.

    ``whole_short``: only texts of fewer than ``WINDOW`` words give short windows, each as a whole (the item side).
    """
    pad = 1 if whole_short else 0

    def run(it):
        seen = bitmap.value if bitmap is not None else None
        for batch in batches(it):
            numbers, ids = column(batch, "row"), column(batch, "id")
            for c in chunks(column(batch, "text")):
                starts, ends, first = c.words(ALNUM)
                counts = np.diff(first)
                row, own = numbers.slice(c.first, c.n), ids.slice(c.first, c.n)
                if per_text:
                    none = pa.nulls(c.n)
                    yield rows(FOUND, row=row, id=own, n_words=counts, pos=none, span=none, h=none, context=none)
                if not len(starts):
                    continue
                hashes = c.word_hashes(starts, ends) | np.uint64(2)
                found = [(K, *_selected(hashes, first))]
                for m in shorts if not whole_short else sorted({*counts[(counts > 0) & (counts < WINDOW)].tolist()}):
                    h, at = _short(hashes, first, m)
                    if whole_short:
                        take = counts[np.searchsorted(first, at, "right") - 1] == m
                        h, at = h[take], at[take]
                    found.append((m, h, at))
                for number, (span, h, at) in enumerate(found):
                    if seen is not None:
                        take = in_bit_array(seen, h)
                        h, at = h[take], at[take]
                    if not len(at):
                        continue
                    owner = np.searchsorted(first, at, "right") - 1
                    context = packed(_context(hashes, first, at, pad)) if number == 0 else pa.array([b""] * len(at), pa.binary())
                    yield rows(FOUND, row=row.take(pa.array(owner)), id=own.take(pa.array(owner)), n_words=pa.nulls(len(at)), pos=at - first[owner],
                               span=np.full(len(at), span, np.int32), h=h.view(np.int64), context=context)
    return run


def _extend(it):
    """Tasks' function: extend each hit as far as the contexts agree and keep runs of a window at least."""
    width = K + 2 * SIDE
    for batch in batches(it):
        pos, span = column(batch, "pos").to_numpy(), column(batch, "span").to_numpy()
        theirs = column(batch, "item_context")
        whole = np.array([len(x) == 0 for x in theirs.to_pylist()])
        lo, hi, good = pos.copy(), pos + span, whole.copy()
        at = np.flatnonzero(~whole)
        if len(at):
            take = pa.array(at)
            a = np.frombuffer(b"".join(column(batch, "context").take(take).to_pylist()), np.uint64).reshape(-1, width)
            b = np.frombuffer(b"".join(theirs.take(take).to_pylist()), np.uint64).reshape(-1, width)
            same = a == b
            left = np.cumprod(same[:, SIDE - 1 :: -1][:, :SIDE], axis=1).sum(axis=1)
            right = np.cumprod(same[:, SIDE + K :], axis=1).sum(axis=1)
            lo[at], hi[at] = pos[at] - left, pos[at] + K + right
            good[at] = same[:, SIDE : SIDE + K].all(axis=1) & (left + right + K >= WINDOW)
        keep = pa.array(good)
        yield rows(SPANS, row=column(batch, "row"), id=column(batch, "id"), lo=lo, hi=hi, h=column(batch, "h"), context=theirs).filter(keep)


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``counts`` (id, n_words), ``spans`` (row, id, lo, hi, h, context) in words, and ``items`` (h, context, item_id).

    A span is a run of words that occurs in every item of its (h, context); ``row`` numbers the rows of ``docs``.
    """
    spark = docs.sparkSession
    items = only(benchmark, item_id=item_col, text=item_text_col)
    items = durable(items.withColumn("id", F.monotonically_increasing_id()))
    prints = durable(
        items.select("id", "text", F.col("id").alias("row")).mapInArrow(_fingerprints([], per_text=False, whole_short=True), ddl(FOUND))
        .join(items.select("id", "item_id"), "id").select("h", "span", F.col("context").alias("item_context"), "item_id").distinct())
    shorts = sorted(r.span for r in prints.filter(F.length("item_context") == 0).select("span").distinct().collect())  # 12 at most
    bitmap = spark.sparkContext.broadcast(bit_array(prints, "h", BITS))
    numbered = only(docs, id=id_col, text=text_col).withColumn("row", F.monotonically_increasing_id())
    found = durable(numbered.mapInArrow(_fingerprints(shorts, bitmap), ddl(FOUND)))
    counts = found.filter("h IS NULL").groupBy("id").agg(F.sum("n_words").alias("n_words"))
    classes = prints.select("h", "span", "item_context").distinct()
    spans = (
        found.filter("h IS NOT NULL").drop("n_words").join(classes, ["h", "span"])
        .select("row", "id", "pos", "span", "h", "context", "item_context").mapInArrow(_extend, ddl(SPANS))
    )
    return counts, spans, prints.select("h", F.col("item_context").alias("context"), "item_id")


def covered(spans: DataFrame, key: str = "id") -> DataFrame:
    """Places inside any span, per key: (key, n_hit)."""
    before = Window.partitionBy(key).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    return (
        spans.select(key, "lo", "hi").distinct()
        .withColumn("done", F.coalesce(F.max("hi").over(before), F.lit(0)))
        .groupBy(key).agg(F.sum(F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", "done"))).alias("n_hit"))
    )


def contamination(docs: DataFrame, benchmark: DataFrame, **columns: str) -> DataFrame:
    """Per document: id, n_words, n_hit (words inside shared windows), items (sorted ids as text), contaminated, n_places.

    Words and hits are counted over all rows of the id. Contaminated: some word is hit, and hit words are a twentieth of all words at
    least. n_places: places that are hit in some row of the id.
    """
    counts, spans, items = contaminated_spans(docs, benchmark, **columns)
    spans = durable(spans)
    listed = (
        spans.select("id", "h", "context").distinct().join(items, ["h", "context"])
        .select("id", F.col("item_id").cast("string").alias("item")).distinct()
        .groupBy("id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    # per id once: places, words hit in all rows, items
    of_rows = covered(spans, "row").join(spans.select("row", "id").distinct(), "row").groupBy("id").agg(F.sum("n_hit").alias("n_hit_rows"))
    none = F.lit(None)
    hits = (
        covered(spans).select("id", "n_hit", none.cast("long").alias("n_hit_rows"), none.cast("array<string>").alias("items"))
        .union(of_rows.select("id", none.cast("long"), "n_hit_rows", none.cast("array<string>")))
        .union(listed.select("id", none.cast("long"), none.cast("long"), "items"))
        .groupBy(F.col("id").alias("hit_id")).agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("n_hit", "n_hit_rows", "items")))
    )
    hit_rows = F.coalesce("n_hit_rows", F.lit(0).cast("long"))
    return counts.join(hits, F.col("id").eqNullSafe(F.col("hit_id")), "left").select(
        "id", "n_words", hit_rows.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((hit_rows > 0) & (20 * hit_rows >= F.col("n_words"))).alias("contaminated"), F.coalesce("n_hit", F.lit(0)).alias("n_places"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """The documents that are not contaminated, all columns as they are."""
    bad = contamination(docs, benchmark, id_col=id_col, **columns).filter("contaminated").select(F.col("id").alias("__bad"))
    return docs.join(bad, docs[id_col].eqNullSafe(F.col("__bad")), "left_anti")
