"""Operator 13, product codes of vectors by k-means over anchors hierarchies.

Vectors become integers and are cut into equal parts; each part position has its own codebook. Tasks pack their vectors
into blocks, and each part of a block gets a metric tree, built middle-out: about sqrt(n) anchors first, each new one
taking over the points nearer to it than to their own; anchors are then merged into a tree upwards and split in the same way
downwards. Every ball caches the count and the sums of its points. Blocks are written once with their trees; no vector is
shuffled.

A round walks each tree from the root with the list of entries that may own points of a ball. Entries whose bisector with
the entry nearest to the centre leaves the whole ball on the other side drop off, and the shortened list is inherited. A ball with
one entry left gives its cached sums; only leaves that several entries still share look at points. Tests on balls use
floating-point numbers with a margin, so they only ever keep an entry too many; points are compared in integers. A task sends one
row for each entry, and the driver gets sums by entry alone, as many as the codebooks have entries.

Cases: rows whose vector is null or holds null or non-finite components are dropped. Shorter vectors count as filled up with
zeros to the longest one, and that up to a multiple of ``parts``; empty vectors are such vectors. Components beyond
the range in which squared distances fit a long are taken as its end. Repeated rows each keep their place: the first codebook
has the ``entries`` first rows by id (nulls last), then vector; with fewer rows there are fewer entries. Ties go to the
lower entry. Ids and labels that are no whole numbers count as null, null labels as one label. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import durable
from .common import batches, column, ddl, packed, rows

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256.0
#: vectors in a block, points in a leaf at most
BLOCK, LEAF = 4096, 32
#: relative margin of the tests on balls
MARGIN = 1e-9
BLOCKS = pa.schema([("n", pa.int64()), *((c, pa.binary()) for c in ("ids", "no_id", "labels", "no_label", "points", "trees", "bounds"))])
SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("dim", pa.int32()), ("total", pa.int64()), ("n", pa.int64())])
CODES = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("code", pa.string()), ("error", pa.int64())])


# --- trees -------------------------------------------------------------------------------------
def _far(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    d = points - centre
    return np.einsum("ij,ij->i", d, d)


def _anchored(points: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner of each point among at most ``wanted`` anchors, and the anchors' points.

    The next anchor is the point farthest from its own anchor. Points nearer to their anchor than half its distance to the
    new one can't move.
    """
    owner = np.zeros(len(points), np.int64)
    square = _far(points, points[0])
    anchors = [0]
    while len(anchors) < wanted:
        new = int(square.argmax())
        if square[new] <= 0:
            break
        gap = _far(points[anchors], points[new])
        open_to = np.flatnonzero(4 * square > gap[owner])
        d = _far(points[open_to], points[new])
        moves = open_to[d < square[open_to]]
        square[moves] = d[d < square[open_to]]
        owner[moves] = len(anchors)
        anchors.append(new)
    return owner, np.array(anchors)


class Tree:
    """Balls as rows: ``first``:``last`` of ``order`` are its points, ``left`` and ``right`` its halves (-1: a leaf)."""

    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.float64)
        self.order = np.zeros(0, np.int64)
        self.first: list[int] = []
        self.last: list[int] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.root = self._middle_out(np.arange(len(points)))
        self.order = np.concatenate(self._leaves(self.root)) if len(points) else self.order
        self._cache(points)

    def _ball(self, left: int, right: int, members: np.ndarray | None = None) -> int:
        self.left.append(left)
        self.right.append(right)
        self.first.append(0)
        self.last.append(0)
        if members is not None:
            self._members[len(self.left) - 1] = members
        return len(self.left) - 1

    def _middle_out(self, members: np.ndarray) -> int:
        if not hasattr(self, "_members"):
            self._members: dict[int, np.ndarray] = {}
        if len(members) <= LEAF:
            return self._ball(-1, -1, members)
        owner, anchors = _anchored(self.points[members], max(2, int(np.sqrt(len(members)))))
        if len(anchors) == 1:  # equal points
            return self._ball(-1, -1, members)
        by_owner = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[by_owner], np.arange(1, len(anchors)))
        groups = [members[g] for g in np.split(by_owner, cuts)]
        balls = [self._middle_out(g) for g in groups]
        return self._merge(balls, groups)

    def _merge(self, balls: list[int], groups: list[np.ndarray]) -> int:
        """Pairs of balls of the smallest common radius become one, until one is left."""
        centre = np.array([self.points[g].mean(axis=0) for g in groups])
        radius = np.array([np.sqrt(_far(self.points[g], c).max()) for g, c in zip(groups, centre, strict=True)])
        size = np.array([len(g) for g in groups], np.float64)
        node = np.array(balls)
        gap = np.sqrt(((centre[:, None, :] - centre[None, :, :]) ** 2).sum(axis=2))
        common = gap + radius[:, None] + radius[None, :]
        np.fill_diagonal(common, np.inf)
        for _ in range(len(balls) - 1):
            a, b = divmod(int(common.argmin()), len(node))
            node[a] = self._ball(int(node[a]), int(node[b]))
            mean = (centre[a] * size[a] + centre[b] * size[b]) / (size[a] + size[b])
            radius[a] = max(np.sqrt(((centre[x] - mean) ** 2).sum()) + radius[x] for x in (a, b))
            centre[a], size[a] = mean, size[a] + size[b]
            common[b, :] = common[:, b] = np.inf
            alive = np.isfinite(common[a])
            reach = np.sqrt(((centre - mean) ** 2).sum(axis=1)) + radius + radius[a]
            common[a, alive] = common[alive, a] = reach[alive]
            root = int(node[a])
        return root

    def _leaves(self, root: int) -> list[np.ndarray]:
        """Members in the order of leaves; gives every ball its range."""
        out, at, stack = [], 0, [(root, False)]
        while stack:
            ball, done = stack.pop()
            if self.left[ball] < 0:
                self.first[ball], at = at, at + len(self._members[ball])
                self.last[ball] = at
                out.append(self._members[ball])
            elif done:
                self.first[ball], self.last[ball] = self.first[self.left[ball]], self.last[self.right[ball]]
            else:
                stack += [(ball, True), (self.right[ball], False), (self.left[ball], False)]
        return out

    def _cache(self, points: np.ndarray) -> None:
        self.span = np.array([self.first, self.last, self.left, self.right], np.int64)
        ordered = points[self.order]
        prefix = np.zeros((len(points) + 1, points.shape[1]), np.int64)
        np.cumsum(ordered, axis=0, out=prefix[1:])
        self.sums = prefix[self.span[1]] - prefix[self.span[0]]
        count = np.maximum(self.span[1] - self.span[0], 1)
        self.centre = self.sums / count[:, None]
        self.radius = np.zeros(len(count))
        near = self.points[self.order]
        for ball in range(len(count)):
            lo, hi = self.span[0, ball], self.span[1, ball]
            if hi > lo:
                self.radius[ball] = np.sqrt(_far(near[lo:hi], self.centre[ball]).max())

    def saved(self) -> np.ndarray:
        """The tree as one array of longs: sizes, order, spans, sums, radii."""
        balls = self.span.shape[1]
        return np.concatenate([[len(self.order), balls, self.root], self.order, self.span.ravel(), self.sums.ravel(), self.radius.view(np.int64)])


class Saved:
    """A tree read back."""

    def __init__(self, raw: np.ndarray, dims: int):
        n, balls, self.root = (int(x) for x in raw[:3])
        at = 3
        self.order = raw[at : at + n]
        at += n
        self.first, self.last, self.left, self.right = raw[at : at + 4 * balls].reshape(4, balls)
        at += 4 * balls
        self.sums = raw[at : at + balls * dims].reshape(balls, dims)
        at += balls * dims
        self.radius = raw[at : at + balls].view(np.float64)
        self.centre = self.sums / np.maximum(self.last - self.first, 1)[:, None]

    def owned(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(balls, their entry) that one entry owns, and (leaves, entries that may own points of them)."""
        entries = book.astype(np.float64)
        apart = np.sqrt(np.maximum(((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2), 0))
        balls, lists = np.array([self.root]), np.ones((1, len(book)), bool)
        done, leaves = [], []
        while len(balls):
            square = ((self.centre[balls][:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
            masked = np.where(lists, square, np.inf)
            best = masked.argmin(axis=1)
            least = masked[np.arange(len(balls)), best]
            # an entry is out if all points of the ball are nearer to the best one: the ball lies beyond the bisector
            reach = 2 * self.radius[balls][:, None] * apart[best]
            out = (square - least[:, None]) > reach + MARGIN * (square + least[:, None] + reach + 1)
            lists = lists & ~out
            alone = lists.sum(axis=1) == 1
            done.append((balls[alone], best[alone]))
            leaf = ~alone & (self.left[balls] < 0)
            leaves.append((balls[leaf], lists[leaf]))
            go = ~alone & ~leaf
            balls, lists = np.concatenate([self.left[balls[go]], self.right[balls[go]]]), np.concatenate([lists[go], lists[go]])
        return (np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done]),
                np.concatenate([x[0] for x in leaves]), np.concatenate([x[1] for x in leaves]))

    def ranges(self, balls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The points of each ball, and which of ``balls`` each belongs to."""
        size = self.last[balls] - self.first[balls]
        ball = np.repeat(np.arange(len(balls)), size)
        place = np.arange(size.sum()) + np.repeat(self.first[balls] - np.cumsum(size) + size, size)
        return self.order[place], ball

    def looked_up(self, points: np.ndarray, book: np.ndarray, leaves: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, entry) in leaves that several entries share, in whole numbers; ties to the lower entry."""
        at, ball = self.ranges(leaves)
        entry = np.zeros(len(at), np.int64)
        for lo in range(0, len(at), 2048):
            some = slice(lo, lo + 2048)
            d = points[at[some]][:, None, :] - book[None, :, :]
            square = np.where(lists[ball[some]], (d * d).sum(axis=2), np.iinfo(np.int64).max)
            entry[some] = square.argmin(axis=1)
        return at, entry


# --- tasks -------------------------------------------------------------------------------------
def largest(width: int) -> int:
    """Components are held within this, so that ``width`` squared differences fit a long."""
    return 1 << ((62 - max(width, 1).bit_length()) // 2 - 1)


def _blocks(width: int, parts: int):
    """Tasks' function: blocks of vectors with the trees of their parts."""
    def block(ids, no_id, labels, no_label, points):
        dims = width // parts
        trees = [Tree(points[:, p * dims : (p + 1) * dims]).saved() for p in range(parts)]
        bounds = np.cumsum([0, *(len(t) for t in trees)])
        one = lambda x: packed(np.ascontiguousarray(x).reshape(1, -1)) if x.size else pa.array([b""], pa.binary())
        return rows(BLOCKS, n=[len(ids)], ids=one(ids), no_id=one(no_id), labels=one(labels), no_label=one(no_label), points=one(points),
                    trees=one(np.concatenate(trees)), bounds=one(bounds))

    def run(it):
        held, count = [], 0
        for batch in batches(it):
            read = []
            for name in ("id", "label"):
                values = column(batch, name)
                read += [values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), values.is_null().to_numpy(zero_copy_only=False)]
            vectors = column(batch, "vec")
            length = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            points = np.zeros((len(vectors), width), np.int64)
            owner = np.repeat(np.arange(len(vectors)), length)
            most = largest(width)
            points[owner, np.arange(len(values)) - np.repeat(np.cumsum(length) - length, length)] = np.clip(np.floor(values * SCALE), -most, most).astype(np.int64)
            held.append((*read, points))
            count += len(points)
            while count >= BLOCK:
                whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                yield block(*(x[:BLOCK] for x in whole))
                held, count = [[x[BLOCK:] for x in whole]], count - BLOCK
        if count:
            yield block(*(np.concatenate(x) for x in zip(*held, strict=True)))
    return run


def _parts_of(batch: pa.RecordBatch, width: int, parts: int):
    """(row of the batch, part, its points, its tree)"""
    dims = width // parts
    for i in range(batch.num_rows):
        raw = {c: column(batch, c)[i].as_py() for c in ("points", "trees", "bounds")}
        points = np.frombuffer(raw["points"], np.int64).reshape(column(batch, "n")[i].as_py(), width)
        trees, bounds = np.frombuffer(raw["trees"], np.int64), np.frombuffer(raw["bounds"], np.int64)
        for p in range(parts):
            yield i, p, points[:, p * dims : (p + 1) * dims], Saved(trees[bounds[p] : bounds[p + 1]], dims)


def _round(width: int, parts: int, books: np.ndarray):
    """Tasks' function: sums and counts of the points of each entry."""
    dims, entries = width // parts, books.shape[1]

    def run(it):
        total, count = np.zeros((parts, entries, dims), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches(it):
            for _, p, points, tree in _parts_of(batch, width, parts):
                balls, owner, leaves, lists = tree.owned(books[p])
                np.add.at(total[p], owner, tree.sums[balls])
                np.add.at(count[p], owner, tree.last[balls] - tree.first[balls])
                at, entry = tree.looked_up(points, books[p], leaves, lists)
                np.add.at(total[p], entry, points[at])
                count[p] += np.bincount(entry, minlength=entries)
        part, entry, dim = np.indices(total.shape)
        used = np.broadcast_to(count[:, :, None] > 0, total.shape)
        yield rows(SUMS, part=part[used], entry=entry[used], dim=dim[used], total=total[used], n=np.broadcast_to(count[:, :, None], total.shape)[used])
    return run


def _coded(width: int, parts: int, books: np.ndarray):
    """Tasks' function: codes and errors of the vectors."""
    digits = np.array([f"{x:02x}" for x in range(256)])

    def run(it):
        for batch in batches(it):
            for first in range(batch.num_rows):
                one = batch.slice(first, 1)
                n = column(one, "n")[0].as_py()
                codes, error = np.zeros((n, parts), np.int64), np.zeros(n, np.int64)
                for _, p, points, tree in _parts_of(one, width, parts):
                    balls, owner, leaves, lists = tree.owned(books[p])
                    at, ball = tree.ranges(balls)
                    codes[at, p] = owner[ball]
                    at, entry = tree.looked_up(points, books[p], leaves, lists)
                    codes[at, p] = entry
                    d = points - books[p][codes[:, p]]
                    error += (d * d).sum(axis=1)
                text = ["".join(row) for row in digits[codes]]
                read = lambda c, kind: np.frombuffer(column(one, c)[0].as_py(), kind)
                yield rows(CODES, vec_id=pa.array(read("ids", np.int64), mask=read("no_id", bool)), label=pa.array(read("labels", np.int64), mask=read("no_label", bool)),
                           code=text, error=error)
    return run


# --- whole tables ------------------------------------------------------------------------------
def kept(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, vec) of the rows whose vectors are whole."""
    whole = "vec IS NOT NULL AND NOT exists(vec, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    return vectors.select(*(F.col(f"`{c}`").alias(new) for c, new in ((id_col, "id"), (label_col, "label"), (vec_col, "vec")))).select(
        F.expr("try_cast(id AS bigint)").alias("id"), F.expr("try_cast(label AS bigint)").alias("label"), F.col("vec").cast("array<double>").alias("vec")).where(whole)


def codes(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, **columns: str) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) per kept row, and the codebooks: part x entry x position in the part.

    ``entries`` is 256 at most.
    """
    vectors = kept(vectors, **columns)
    longest = vectors.agg(F.max(F.size("vec")).alias("w")).first().w or 0
    width = -(-longest // parts) * parts
    blocks = durable(vectors.mapInArrow(_blocks(width, parts), ddl(BLOCKS)))
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).collect()
    most, dims = largest(width), width // parts
    books = np.zeros((len(first), width), np.int64)
    for i, r in enumerate(first):
        books[i, : len(r.vec)] = np.clip(np.floor(np.array(r.vec, np.float64) * SCALE), -most, most).astype(np.int64)
    books = np.ascontiguousarray(books.reshape(len(first), parts, dims).transpose(1, 0, 2))
    for _ in range(rounds if len(first) else 0):
        found = blocks.mapInArrow(_round(width, parts, books), ddl(SUMS)).groupBy("part", "entry", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        found = found.toArrow()  # one row a component of the codebooks
        part, entry, dim, total, n = (found[c].to_numpy() for c in ("part", "entry", "dim", "total", "n"))
        books[part, entry, dim] = total // n
    return blocks.mapInArrow(_coded(width, parts, books), ddl(CODES)), books


def compressed(vectors: DataFrame, **options) -> DataFrame:
    """Per kept row: vec_id, code, error, label_error (errors of its label together), codebooks_sha256."""
    found, books = codes(vectors, **options)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    found = durable(found)
    by_label = found.groupBy("label").agg(F.expr("try_sum(error)").alias("label_error"))
    same = found.label.eqNullSafe(by_label.label)
    return found.join(by_label, same).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
