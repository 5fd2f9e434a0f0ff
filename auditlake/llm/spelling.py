"""Operator 11, spelling variants by search schemes over an FM-index of the vocabulary.

Words are counted on Arrow batches and added up by Spark. A word and one at edit distance 1 share one of the two halves of
the first exactly: as a prefix, if the error lies in the other half, or as a suffix. Every word goes to the shards of the
halves that a near word may have (at most two prefixes and two suffixes), and to one of them on either side as a query; a
shard holds many halves. A shard's words, each between delimiters, make one text with an FM-index in the direction of
the side (suffix sides hold words reversed, so the two sides together are the bidirectional index). A query walks its exact
half from the delimiter on, then goes on through the other half; at each letter one error may be spent, and a
suffix-rank interval is all that a partial match carries. All queries of one length move together, so a step is a few
vector operations. Each error is placed canonically (in a run of equal letters at its end), so a word is found once a side,
and the suffix side passes over what the prefix side finds.

A shard gives back one row per query: the number of near words and the best of them, never pairs. Halves of more than
``HOT`` words get shards of their own, cut into blocks of words that each of their queries visits.

Cases: null and empty texts have no words; a null id counts as empty text in front of the colon. Repeated rows count again.
Among near words of equal count the smallest in code-point order is the form. Words need ``least`` code points and
``often`` occurrences; an empty vocabulary gives an empty table. Extra columns are ignored. Any number of words may share
a form: forms are followed by joins in a few rounds, since each step multiplies the count by ``times`` or more.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import durable
from .common import LOWER, LOWER_VALUES, Chunk, batches, chunks, column, ddl, only, part, rows, running

#: words of fewer code points, and words that occur less often, are left out
LEAST, OFTEN = 6, 5
#: a form occurs at least so many times as often as its variant
TIMES = 5
#: of all runs one in so many loses a letter
DAMAGED = 199
#: words in a shard, and words of one half from which on it gets shards of its own
SHARD = HOT = 1 << 16
#: bytes of text counted at a time, and queries that move together
COUNTED, TOGETHER = 1 << 22, 1 << 13
#: longer words get their checksum singly
SHORT_RUN = 64
WORDS = pa.schema([("word", pa.string()), ("n", pa.int64())])
FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

_BITS = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _BITS = np.where(_BITS & 1, (_BITS >> 1) ^ np.uint32(0xEDB88320), _BITS >> 1).astype(np.uint32)
CRC = _BITS
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True


def _runs(c: Chunk, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and code points of the maximal runs of A-Z, a-z and U+00C0 to U+00FF (bytes C3 80 to C3 BF)."""
    lead = c.data == 0xC3
    inside = np.zeros(len(c.data) + 2, bool)
    inside[1:-1] = LETTER[c.data] | lead
    inside[2:-1] |= lead[:-1]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    leads = np.zeros(len(c.data) + 1, np.int64)
    np.cumsum(lead, out=leads[1:])
    points = ends - starts - (leads[ends] - leads[starts])
    long_enough = points >= least
    return starts[long_enough], ends[long_enough], points[long_enough]


def _checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each run that goes on from the checksum ``before``; byte by byte over all runs at once."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order], np.minimum(lengths[order], SHORT_RUN)
    state = ~before[order]
    alive = np.searchsorted(-left, -np.arange(1, SHORT_RUN + 1), "right") if len(left) else []
    for k, m in enumerate(alive):
        if not m:
            break
        state[:m] = (state[:m] >> 8) ^ CRC[(state[:m] ^ data[at[:m] + k]) & 255]
    state = ~state
    for i in range(int(np.searchsorted(-lengths[order], -SHORT_RUN, "left"))):
        run = order[i]
        state[i] = zlib.crc32(data[starts[run] : ends[run]].tobytes(), int(before[run]))
    out = np.empty_like(state)
    out[order] = state
    return out


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as strings."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    places = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[places]))])


def _counted(least: int, damaged: int):
    """Tasks' function: words and their counts in a chunk of texts."""
    def run(it):
        for batch in batches(it):
            heads = [zlib.crc32(f"{x}:".encode()) for x in pc.fill_null(column(batch, "id"), "").to_pylist()]
            heads = np.array(heads, np.uint32)
            for c in chunks(column(batch, "text"), size=COUNTED):
                starts, ends, points = _runs(c, least)
                if not len(starts):
                    continue
                data = LOWER[c.data]
                check = _checksums(data, starts, ends, heads[c.first + c.text_of(starts)])
                hit = check % np.uint32(damaged) == 0
                whole = ~hit
                hashes = part(running(LOWER_VALUES[c.data]), starts, ends)[whole]
                _, first, count = np.unique(hashes, return_index=True, return_counts=True)
                yield rows(WORDS, word=_strings(data, starts[whole][first], ends[whole][first]), n=count)
                cut = []
                for i in np.flatnonzero(hit & (points > least)):
                    word, at = data[starts[i] : ends[i]].tobytes().decode(), int(check[i]) % int(points[i])
                    cut.append(word[:at] + word[at + 1 :])
                yield rows(WORDS, word=pa.array(cut, pa.string()), n=np.ones(len(cut), np.int64))
    return run


def vocabulary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, often: int = OFTEN, damaged: int = DAMAGED) -> DataFrame:
    """(word, n): the words of all documents, one run in ``damaged`` without one of its letters."""
    texts = only(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("string"))
    return texts.mapInArrow(_counted(least, damaged), ddl(WORDS)).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


class Index:
    """FM-index of the text in which every word stands backwards between delimiters (symbol 0).

    A pattern grows to the right by ``step``; suffixes are ordered up to their first delimiter, then by place.
    """

    def __init__(self, words: list[str], letters: str = ""):
        """``letters``: those that patterns may have besides the words' own."""
        raw = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("latin-1")[::-1], np.uint8)
        self.alphabet = np.union1d(raw, np.frombuffer(letters.encode("latin-1"), np.uint8))  # the delimiter is the smallest
        self.code = np.zeros(256, np.int64)
        self.code[self.alphabet] = np.arange(len(self.alphabet))
        text = self.code[raw]
        n = self.n = len(text)
        ends = np.flatnonzero(text == 0)
        self.delimiters, self.words = len(ends), len(words)
        order = self._suffixes(text, int(np.diff(ends).max(initial=1)))
        self.before = text[order - 1]
        self.lf = np.argsort(self.before, kind="stable")
        self.keys = self.before[self.lf] * (n + 1) + self.lf
        self.row_to = np.empty(n, np.int64)
        self.row_to[self.lf] = np.arange(n)
        self.owner = self.words - 1 - (np.searchsorted(ends, order, "right") - 1)

    @staticmethod
    def _suffixes(text: np.ndarray, longest: int) -> np.ndarray:
        covered, n = 8, len(text)
        padded = np.concatenate([text, np.zeros(covered, np.int64)])
        key, alive = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(covered):
            symbol = np.where(alive, padded[i : i + n], 0)
            key = key << 7 | symbol
            alive &= symbol != 0
        while covered <= longest:  # ranks of twice as many symbols, for those that have not ended
            _, rank = np.unique(key, return_inverse=True)
            further = np.zeros(n, np.int64)
            further[: n - covered] = rank[covered:] + 1
            key = rank * (n + 2) + np.where(alive, further, 0)
            ended = np.ones(n, bool)
            ended[: n - covered] = ~alive[covered:]
            alive &= ~ended
            covered *= 2
        return np.argsort(key, kind="stable")

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, symbol * (self.n + 1) + row)

    def children(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(state, symbol, lo, hi) for each letter that may follow."""
        letters = len(self.alphabet) - 1
        wide = hi - lo > letters
        at = np.flatnonzero(wide)
        state = np.repeat(at, letters)
        symbol = np.tile(np.arange(1, letters + 1), len(at))
        a, b = self.step(symbol, lo[state]), self.step(symbol, hi[state])
        some = a < b
        at = np.flatnonzero(~wide)
        size = hi[at] - lo[at]
        narrow = np.repeat(at, size)
        row = np.arange(size.sum()) + np.repeat(lo[at] - np.cumsum(size) + size, size)
        narrow_symbol, to = self.before[row], self.row_to[row]
        letter = narrow_symbol > 0
        narrow, narrow_symbol, to = narrow[letter], narrow_symbol[letter], to[letter]
        order = np.lexsort((to, narrow_symbol, narrow))
        narrow, narrow_symbol, to = narrow[order], narrow_symbol[order], to[order]
        new = np.ones(len(to), bool)
        new[1:] = (narrow[1:] != narrow[:-1]) | (narrow_symbol[1:] != narrow_symbol[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(to)) - 1 if len(first) else first
        return (np.concatenate([state[some], narrow[first]]), np.concatenate([symbol[some], narrow_symbol[first]]),
                np.concatenate([a[some], to[first]]), np.concatenate([b[some], to[last] + 1]))

    def whole(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, word) where the pattern is a word."""
        a = np.searchsorted(self.keys, lo)
        found = np.searchsorted(self.keys, hi) > a
        return np.flatnonzero(found), self.owner[self.lf[a[found]]]

    def near(self, patterns: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, word) of words that start with a pattern's first ``half`` letters and have one error after them.

        ``patterns``: one row of symbols each, all of one length.
        """
        count, length = patterns.shape
        lo, hi = np.zeros(count, np.int64), np.full(count, self.delimiters, np.int64)
        for j in range(half):
            lo, hi = self.step(patterns[:, j], lo), self.step(patterns[:, j], hi)
        exact = np.flatnonzero(lo < hi)
        lo, hi = lo[exact], hi[exact]
        one = [np.zeros(0, np.int64)] * 3  # pattern, lo, hi: the error is spent
        for j in range(half, length + 1):
            state, symbol, a, b = self.children(lo, hi)
            who = exact[state]
            if j == length:
                return self._ended(*(np.concatenate(x) for x in zip(one, (who, a, b), strict=True)))
            here = patterns[who, j]
            other = symbol != here
            added = (who[other], a[other], b[other])
            one = [np.concatenate(x) for x in zip(one, added, strict=True)]
            following = patterns[one[0], j]
            one_lo, one_hi = self.step(following, one[1]), self.step(following, one[2])
            left = one_lo < one_hi
            one = [one[0][left], one_lo[left], one_hi[left]]
            missed = np.ones(len(exact), bool) if j + 1 == length else patterns[exact, j] != patterns[exact, j + 1]
            one = [np.concatenate(x) for x in zip(one, added, (exact[missed], lo[missed], hi[missed]), strict=True)]
            lo, hi = self.step(patterns[exact, j], lo), self.step(patterns[exact, j], hi)
            going = lo < hi
            exact, lo, hi = exact[going], lo[going], hi[going]
        raise AssertionError

    def _ended(self, who: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        state, word = self.whole(lo, hi)
        return who[state], word


def _searched(table: pa.Table) -> pa.Table:
    """Function of one shard: for each of its queries the number of near words and the best of them."""
    side = table["side"][0].as_py()
    texts_here = table.filter(table["text"])
    count_of = dict(zip(texts_here["word"].to_pylist(), texts_here["n"].to_pylist(), strict=True))
    words = sorted(count_of)  # as they stand on this side
    queries = pc.unique(table.filter(table["own"])["word"]).to_pylist()
    if not queries or not words:
        return FOUND.empty_table()
    index = Index(words, "".join(queries))
    turned = (lambda w: w[::-1]) if side else (lambda w: w)
    texts = [turned(w) for w in words]
    counts = np.array([count_of[w] for w in words], np.int64)
    best_first = np.array(sorted(range(len(words)), key=lambda i: (-counts[i], texts[i])), np.int64)
    rank = np.empty(len(words), np.int64)
    rank[best_first] = np.arange(len(words))
    by_length: dict[int, list[str]] = {}
    for w in queries:
        by_length.setdefault(len(w), []).append(w)
    out = []
    for length, group in by_length.items():
        half = (length + side) // 2
        together = max(1, min(TOGETHER, (1 << 22) // length))
        for first in range(0, len(group), together):
            asked = group[first : first + together]
            patterns = index.code[np.frombuffer("".join(asked).encode("latin-1"), np.uint8)].reshape(len(asked), length)
            who, word = index.near(patterns, half)
            if side and len(who):  # the prefix side has found words that start with the first half
                rest = length - length // 2
                new = np.array([not words[y].endswith(asked[x][rest:]) for x, y in zip(who.tolist(), word.tolist(), strict=True)], bool)
                who, word = who[new], word[new]
            best = np.full(len(asked), len(words), np.int64)
            np.minimum.at(best, who, rank[word])
            n_near = np.bincount(who, minlength=len(asked))
            for x in np.flatnonzero(n_near).tolist():
                y = best_first[best[x]]
                out.append((turned(asked[x]), int(n_near[x]), int(counts[y]), texts[y]))
    return pa.table([pa.array([x[i] for x in out], f.type) for i, f in enumerate(FOUND)], schema=FOUND)


def near_words(vocab: DataFrame, *, least: int = LEAST, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(word, n_near, best_n, best) for the words of ``vocab`` (word, n) with a word at edit distance 1 in it."""
    halves = [
        vocab.select(
            F.lit(side).alias("side"), (F.reverse("word") if side else F.col("word")).alias("word"), "n", F.char_length("word").alias("length"),
            F.explode(F.array_distinct(F.transform(F.sequence(F.greatest(F.char_length("word") - 1, F.lit(least)), F.char_length("word") + 1),
                                                   lambda x, side=side: ((x + side) / 2).cast("int")))).alias("half"))
        for side in (0, 1)]
    keyed = halves[0].union(halves[1]).select(
        "side", "word", "n", F.expr("half = (length + side) div 2").alias("own"), F.xxhash64("side", F.substring("word", F.lit(1), F.col("half"))).alias("key"))
    many = durable(keyed.groupBy("side", "key").agg(F.count("*").alias("size")).where(F.col("size") > hot))
    shards = F.lit(max(1, -(-4 * vocab.count() // shard)))
    if many.isEmpty():
        dealt = keyed.select("side", F.pmod("key", shards).alias("shard"), F.lit(-1).cast("long").alias("block"), "word", "n", "own", F.lit(True).alias("text"))
    else:
        sized = keyed.join(many, ["side", "key"], "left").withColumn("blocks", F.ceil(F.col("size") / hot))
        home = F.when(F.col("size").isNull(), -1).otherwise(F.pmod(F.xxhash64("word"), "blocks"))
        every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
        dealt = (  # a word is a text in one block of its half, and a query in all of them
            sized.withColumn("home", home.cast("long"))
            .withColumn("block", F.explode(F.when(F.col("size").isNotNull() & F.col("own"), every).otherwise(F.array("home"))))
            .select("side", F.when(F.col("size").isNull(), F.pmod("key", shards)).otherwise(F.col("key")).alias("shard"), "block", "word", "n", "own",
                    (F.col("block") == F.col("home")).alias("text"))
        )
    found = dealt.groupBy("side", "shard", "block").applyInArrow(_searched, ddl(FOUND))
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def variants(vocab: DataFrame, *, times: int = TIMES, least: int = LEAST, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``vocab`` (word, n)."""
    vocab = durable(vocab)
    near = near_words(vocab, least=least, shard=shard, hot=hot)
    is_form = F.col("best_n") >= times * F.col("n")
    formed = durable(vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    roots = durable(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:  # each round doubles the steps taken
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = durable(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, **columns: str) -> DataFrame:
    """Forms and roots of all words of the documents."""
    return variants(vocabulary(docs, **columns))
