"""Operator 2, exact removal of repeated spans by a logarithmic family of sparse suffix arrays.

Every string of ``LENGTH`` bytes that also starts earlier (smaller id, or same document and smaller place) is repeated,
and each byte it covers goes. Suffixes are sampled: of each string the ``K`` bytes with the smallest hash, leftmost if
several, are its anchor, so equal strings have equal anchors and less than 3 % of all suffixes are kept. A row is the run of
neighbouring strings that share an anchor: g, the hash of the anchor by which suffixes are ordered, and c, the hash of
all bytes the run covers. Suffixes of all bytes would need 16 bytes for each byte of text, sampled ones half a byte.

Documents come in batches by id. The suffix space is dealt out by g, and each task keeps a logarithmic index family for
its part: a batch's sorted suffix array is scanned against the levels, and then becomes a level; levels of equal size
merge, so there are as many levels as the logarithm of the batches. A run whose (g, c) is known is repeated as a whole.
A run whose g is known with another c is repeated in part or not at all. Such runs, and those they met, are cut into runs
of eight strings, aligned at the anchor, whose g is the hash of the bytes all eight have in common; these go through the same index, and
what is still open is cut into single strings, whose g says all. Matching is by 64-bit hashes throughout.

Texts are dealt out by id once; the two rounds of cutting and the final cut read that one exchange.

Skew: tasks that read the documents send one row for each (g, c) they hold, so a passage in a third of all documents
gives as many rows as there are tasks. A g that one task holds with several c is sent by (g, c), with one marker by g
for the others, so a common start with many continuations spreads.

Cases: null texts are empty; texts shorter than ``LENGTH`` bytes stay whole. Rows that share an id are one document: a
place in one is the same place in all, so repeated rows do not remove each other, and what is repeated in one version is
cut from all. Rows with a null id stay whole and match nothing. Extra columns are ignored. Spans are cut by bytes, so
the rest may not be valid UTF-8 and is given as binary.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import durable
from .common import VALUES, batches, binary_texts, chunks, column, ddl, gathered, mix, only, part, rows, running

LENGTH, K = 100, 28
BATCHES = 8
#: strings in the shorter runs that partly repeated runs are cut into
CUTS = (8, 1)
#: runs held by a task before it sends them
FLUSH = 1 << 20
#: bits of a place inside the bytes worked on at a time; longer texts are worked on in overlapping segments
PLACE_BITS, SEGMENT = 24, 1 << 23
KNOWN, SINGLE, SPREAD, MARKER, LEVEL = range(5)
RUNS = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("g", pa.int64()), ("c", pa.int64()), ("id", pa.int64()), ("lo", pa.int64()), ("n", pa.int32())])
FOUND = pa.schema([("known", pa.bool_()), ("id", pa.int64()), ("lo", pa.int64()), ("n", pa.int32())])
DIGEST = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
CUT = pa.schema([("id", pa.int64()), ("kept", pa.binary())])


def _runs(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """(lo, n, anchor, prefix hashes, hashes of K bytes) of the runs in the texts at [begin, end) of ``data``."""
    none = np.zeros(0, np.int64)
    long = end - begin >= LENGTH
    begin, end = begin[long], end[long]
    prefix = running(VALUES[data])
    if not len(begin):
        return none, none, none, prefix, none.view(np.uint64)
    at = np.arange(len(data) - K + 1)
    h = part(prefix, at, at + K)
    least = (h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | at.astype(np.uint64)
    width, span = LENGTH - K + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    sizes = end - begin - LENGTH + 1
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin, sizes)
    anchor = (least[place] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    heads = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1] + 1)]))
    return place[heads], np.diff(np.append(heads, len(place))), anchor[heads], prefix, h


def _content(prefix: np.ndarray, lo: np.ndarray, n: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """c: the hash of all bytes of each run, and where its anchor lies in them."""
    return part(prefix, lo, lo + n - 1 + LENGTH) ^ mix((anchor - lo).astype(np.uint64))


def _segments(texts: pa.Array):
    """(bytes, begin, end, number of text, place of begin in its text) of texts and of pieces of very long ones."""
    for c in chunks(texts, size=1 << 19):
        if c.n > 1 or c.lengths[0] <= SEGMENT:
            yield c.data, c.at[:-1], c.at[:-1] + c.lengths, np.arange(c.first, c.first + c.n), np.zeros(c.n, np.int64)
        else:
            for start in range(0, int(c.lengths[0]), SEGMENT):
                piece = c.data[start : min(start + SEGMENT + LENGTH - 1, int(c.lengths[0]))]
                yield piece, np.array([0]), np.array([len(piece)]), np.array([c.first]), np.array([start])


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Whether each row of the sorted keys is the first of its kind."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _spread(new: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value at the first row of each kind, for all its rows."""
    return values[np.flatnonzero(new)][np.cumsum(new) - 1]


class Sender:
    """Runs held by a task, sent with each (g, c) once; others of its kind are known to be repeated."""

    def __init__(self):
        self.held: list[tuple] = []
        self.size = 0

    def hold(self, g, c, ids, lo, n) -> None:
        if len(lo):
            self.held.append((g, c, ids, lo, n))
            self.size += len(lo)

    def send(self, least: int):
        if self.size < least:
            return
        g, c, ids, lo, n = (np.concatenate([h[i] for h in self.held]) for i in range(5))
        self.held, self.size = [], 0
        order = np.lexsort((lo, ids, c, g))
        g, c, ids, lo, n = (x[order] for x in (g, c, ids, lo, n))
        new = _first_of(g, c)
        again = ~new & ((ids != _spread(new, ids)) | (lo != _spread(new, lo)))
        key = mix(ids[again].astype(np.uint64) + lo[again].astype(np.uint64)).view(np.int64)
        none = pa.nulls(int(again.sum()))
        yield rows(RUNS, kind=np.full(len(key), KNOWN, np.int32), key=key, g=none, c=none, id=ids[again], lo=lo[again], n=n[again].astype(np.int32))
        g, c, ids, lo, n = (x[new] for x in (g, c, ids, lo, n))
        new = _first_of(g)
        several = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1
        key = np.where(several, mix(g ^ c), g)
        own = pa.array(g.view(np.int64), mask=~several)  # of single runs, the key says it
        yield rows(RUNS, kind=np.where(several, SPREAD, SINGLE).astype(np.int32), key=key.view(np.int64), g=own, c=c.view(np.int64), id=ids, lo=lo, n=n.astype(np.int32))
        g = g[new & several]
        none = pa.nulls(len(g))
        yield rows(RUNS, kind=np.full(len(g), MARKER, np.int32), key=g.view(np.int64), g=none, c=none, id=none, lo=none, n=none)


def _sample(it):
    """Tasks' function: the runs of whole documents."""
    sender = Sender()
    for batch in batches(it):
        ids = column(batch, "id").to_numpy()
        for data, begin, end, number, shift in _segments(column(batch, "text")):
            lo, n, anchor, prefix, h = _runs(data, begin, end)
            owner = np.searchsorted(begin, lo, "right") - 1
            sender.hold(h[anchor], _content(prefix, lo, n, anchor), ids[number[owner]], lo - begin[owner] + shift[owner], n)
        yield from sender.send(FLUSH)
    yield from sender.send(1)


def _cut_runs(width: int):
    """Tasks' function: runs of ``width`` strings at most, aligned at the anchor, of the open runs of each document."""
    def run(it):
        sender = Sender()
        for batch in batches(it):
            ids, texts = column(batch, "id").to_numpy(), binary_texts(column(batch, "text"))
            los, ns = column(batch, "lo"), column(batch, "n")
            for at in range(batch.num_rows):
                data = np.frombuffer(texts[at].as_py(), np.uint8)
                lo, n = np.array(los[at].as_py(), np.int64), np.array(ns[at].as_py(), np.int64)
                fits = lo + n - 1 + LENGTH <= len(data)  # rows of one id may differ
                lo, n = lo[fits], n[fits]
                if not len(lo):
                    continue
                # slices of the document's runs whose bytes have places in PLACE_BITS; runs don't need each other
                size = n - 1 + LENGTH
                slices = np.flatnonzero(np.diff((np.cumsum(size) - size) >> (PLACE_BITS - 1))) + 1
                for lo, n, size in zip(*(np.split(x, slices) for x in (lo, n, size)), strict=True):
                    # the runs' bytes one after the other: each is a run again, with its anchor
                    begin = np.cumsum(size) - size
                    bytes_at = np.arange(size.sum()) - np.repeat(begin, size) + np.repeat(lo, size)
                    start, count, anchor, prefix, _ = _runs(data[bytes_at], begin, begin + size)
                    owner = np.searchsorted(begin, start, "right") - 1
                    group = (np.repeat(anchor, count) - (place := np.repeat(start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))) // width
                    heads = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (np.diff(np.repeat(np.arange(len(start)), count)) > 0)]))
                    first, wide = place[heads], np.diff(np.append(heads, len(place)))
                    of = np.searchsorted(start, first, "right") - 1
                    core = anchor[of] - group[heads] * width  # where the last string of a full group starts
                    g = part(prefix, core, core + LENGTH - width + 1) ^ np.uint64(width)
                    sender.hold(g, _content(prefix, first, wide, anchor[of]), np.full(len(first), ids[at]), first - begin[owner[of]] + lo[owner[of]], wide)
            yield from sender.send(FLUSH)
        yield from sender.send(1)
    return run


class Family:
    """The levels of one part of the suffix space: arrays sorted by g, each twice as large as the next or more."""

    def __init__(self, marked: np.ndarray):
        self.levels: list[dict] = []
        self.marked = np.unique(marked)

    def add(self, g, c, ids, lo, n, spread) -> np.ndarray:
        """Scan a batch (sorted by g, c, id, lo) against the levels and take it in; which rows are repeated as a whole."""
        known = ~_first_of(g, c)
        known &= (ids != _spread(~known, ids)) | (lo != _spread(~known, lo)) if len(g) else known
        key = mix(g ^ mix(c))
        for level in self.levels:
            at = np.minimum(np.searchsorted(level["keys"], key), len(level["keys"]) - 1)
            known |= level["keys"][at] == key
        fresh = _first_of(g, c) & ~known
        new = {"g": g[fresh], "key": key[fresh], "id": ids[fresh], "lo": lo[fresh], "n": n[fresh], "c": c[fresh], "part": spread[fresh].copy()}
        if not len(new["g"]):
            return known
        # a g with several c: compare these runs string by string
        head = _first_of(new["g"])
        kind = np.cumsum(head) - 1
        new["part"] |= np.bincount(kind)[kind] > 1
        new["part"] |= np.isin(new["g"], self.marked)
        for level in self.levels:
            at = np.minimum(np.searchsorted(level["g"], new["g"]), len(level["g"]) - 1)
            met = level["g"][at] == new["g"]
            new["part"] |= met
            level["part"] |= np.isin(level["g"], new["g"][met])
        new["keys"] = np.sort(new["key"])
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2]["g"]).bit_length() <= len(self.levels[-1]["g"]).bit_length():
            young, old = self.levels.pop(), self.levels.pop()
            both = {k: np.concatenate([old[k], young[k]]) for k in old}
            order = np.argsort(both["g"], kind="stable")
            self.levels.append({k: np.sort(v) if k == "keys" else v[order] for k, v in both.items()})
        return known


def _scan(bounds: list[int], keep_levels: bool):
    """Tasks' function: one part of the suffix space, batch after batch. Gives repeated runs, and runs to look into."""
    def run(it):
        table = gathered(it, RUNS)
        kind = table["kind"].to_numpy()
        known = table.filter(pa.array(kind == KNOWN))
        if not keep_levels:
            yield from pa.table([pa.array(np.ones(len(known), bool)), known["id"], known["lo"], known["n"]], schema=FOUND).to_batches()
        marked = table.filter(pa.array(kind == MARKER))["key"].to_numpy().view(np.uint64)
        live = table.filter(pa.array((kind == SINGLE) | (kind == SPREAD) | (kind == LEVEL)))
        kind = live["kind"].to_numpy()
        g = np.where(kind == SPREAD, pc.fill_null(live["g"], 0).to_numpy(), live["key"].to_numpy()).view(np.uint64)
        c = live["c"].to_numpy().view(np.uint64)
        ids, lo, n = live["id"].to_numpy(), live["lo"].to_numpy(), live["n"].to_numpy()
        number = np.where(kind == LEVEL, -1, np.searchsorted(np.array(bounds, np.int64), ids, "right"))
        order = np.lexsort((lo, ids, c, g, number))
        number = number[order]
        family = Family(marked)
        edges = np.append(np.flatnonzero(_first_of(number)), len(number)) if len(number) else np.zeros(1, int)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            at = order[a:b]
            again = at[family.add(g[at], c[at], ids[at], lo[at], n[at], kind[at] == SPREAD)]
            if len(again) and not keep_levels:
                yield rows(FOUND, known=np.ones(len(again), bool), id=ids[again], lo=lo[again], n=n[again])
        for level in family.levels:
            if keep_levels:
                yield rows(RUNS, kind=np.full(len(level["g"]), LEVEL, np.int32), key=level["g"].view(np.int64), g=level["g"].view(np.int64),
                           c=level["c"].view(np.int64), id=level["id"], lo=level["lo"], n=level["n"])
            else:
                at = np.flatnonzero(level["part"])
                yield rows(FOUND, known=np.zeros(len(at), bool), id=level["id"][at], lo=level["lo"][at], n=level["n"][at])
    return run


def _input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return only(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))


def _sampled(docs: DataFrame, levels: DataFrame | None) -> DataFrame:
    runs = docs.where("id IS NOT NULL AND text IS NOT NULL").mapInArrow(_sample, ddl(RUNS))
    return (runs if levels is None else runs.union(levels)).repartition("key")


def _bounds(docs: DataFrame, count: int) -> list[int]:
    shares = [i / count for i in range(1, count)]
    found = docs.agg(F.percentile_approx("id", shares).alias("b")).first().b if shares else None
    return sorted(set(found or []))


def index_levels(docs: DataFrame, levels: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", batch_count: int = BATCHES) -> DataFrame:
    """The levels after ``docs``, as a table to be saved and given to the next call; ids must go up from call to call."""
    docs = _input(docs, id_col, text_col)
    return _sampled(docs, levels).mapInArrow(_scan(_bounds(docs, batch_count), True), ddl(RUNS))


def repeated_strings(docs: DataFrame, levels: DataFrame | None = None, earlier: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", batch_count: int = BATCHES) -> DataFrame:
    """(id, lo, n): the strings starting at bytes lo .. lo + n - 1 of the document also start earlier.

    With ``levels`` of ``earlier`` documents (smaller ids), only the new documents are sampled.
    """
    docs = _input(docs, id_col, text_col)
    texts = docs if earlier is None else docs.union(_input(earlier, id_col, text_col))
    return _repeated(docs, levels, texts.repartition("id"), batch_count)


def _repeated(docs: DataFrame, levels: DataFrame | None, texts: DataFrame, batch_count: int) -> DataFrame:
    bounds = _bounds(docs, batch_count)
    found = durable(_sampled(docs, levels).mapInArrow(_scan(bounds, False), ddl(FOUND)))
    every = found.where("known").select("id", "lo", "n")
    for width in CUTS:
        open_runs = _of_document(found.where("NOT known"))
        found = texts.join(open_runs, "id").select("id", "text", "lo", "n").mapInArrow(_cut_runs(width), ddl(RUNS)).repartition("key").mapInArrow(_scan(bounds, False), ddl(FOUND))
        every = every.union(found.where("known").select("id", "lo", "n"))
    return every


def _of_document(runs: DataFrame) -> DataFrame:
    return runs.groupBy("id").agg(F.collect_list("lo").alias("lo"), F.collect_list("n").alias("n"))


def _kept(data: np.ndarray, los: list | None, ns: list | None) -> tuple[np.ndarray, int]:
    """Which bytes stay, and the number of maximal removed runs."""
    if not los:
        return np.ones(len(data), bool), 0
    lo, n = np.array(los, np.int64), np.array(ns, np.int64)
    lo, end = lo[lo < len(data)], np.minimum(lo + n - 1 + LENGTH, len(data))[lo < len(data)]
    depth = np.zeros(len(data) + 1, np.int64)
    np.add.at(depth, lo, 1)
    np.add.at(depth, end, -1)
    gone = np.cumsum(depth[:-1]) > 0
    return ~gone, int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0


def _digest(it):
    for batch in batches(it):
        texts, los, ns = binary_texts(column(batch, "text")), column(batch, "lo"), column(batch, "n")
        size, removed, spans, sha = [], [], [], []
        for at in range(batch.num_rows):
            raw = texts[at].as_py()
            data = np.frombuffer(raw, np.uint8)
            if los[at].is_valid:
                stays, count = _kept(data, los[at].as_py(), ns[at].as_py())
                rest = data[stays].tobytes()
            else:
                count, rest = 0, raw
            size.append(len(raw))
            removed.append(len(raw) - len(rest))
            spans.append(count)
            sha.append(hashlib.sha256(rest).hexdigest())
        yield rows(DIGEST, id=column(batch, "id"), n_bytes=size, n_removed=removed, n_spans=spans, kept_sha256=sha)


def _cut(it):
    for batch in batches(it):
        texts, los, ns = binary_texts(column(batch, "text")), column(batch, "lo"), column(batch, "n")
        kept = []
        for at in range(batch.num_rows):
            data = np.frombuffer(texts[at].as_py(), np.uint8)
            kept.append(data[_kept(data, los[at].as_py(), ns[at].as_py())[0]].tobytes())
        yield rows(CUT, id=column(batch, "id"), kept=kept)


def _marked(docs: DataFrame, batch_count: int) -> DataFrame:
    texts = docs.repartition("id")
    of_document = _of_document(_repeated(docs, None, texts, batch_count)).withColumnRenamed("id", "at_id")
    return texts.join(of_document, F.col("id") == F.col("at_id"), "left").select("id", "text", "lo", "n")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", batch_count: int = BATCHES) -> DataFrame:
    """Per row: id and kept, the bytes that stay."""
    return _marked(_input(docs, id_col, text_col), batch_count).mapInArrow(_cut, ddl(CUT))


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", batch_count: int = BATCHES) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay."""
    return _marked(_input(docs, id_col, text_col), batch_count).mapInArrow(_digest, ddl(DIGEST))
