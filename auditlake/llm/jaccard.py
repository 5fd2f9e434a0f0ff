"""Operator 3, n-gram Jaccard join by adaptive multi-match prefixes.

Each document is the set of its word n-grams. Documents with equal sets are one class; the join works on one
representative per class. Tokens have one global order: the most frequent tokens (about ``FREQUENT`` at most, by
counting) come last by their count, all others come first by hash. For a threshold t, two sets that link share at least
m tokens of their prefixes of |x| - ceil(t |x|) + m tokens, for any m. Posting lists of the longest prefixes
(m = ``LONGEST``) tell each document what its prefixes cost: with more tokens there are more postings to read, but
candidates must share more of them. Each document takes the m of the least estimated cost, and two documents are
compared if they share the smaller m of both.

Dense groups of near copies are not compared pair by pair. First a long posting list is compared with its commonest text
(a star, as many pairs as postings); links found make components, and only documents whose components still differ are
compared further. That keeps every component exact: a pair left out lies in one component already. In lists of more than a
block each component of a block proposes its nearest neighbour, for a few rounds; what is then still apart in any list is
compared in full, by blocks, in tasks that give back links alone. Documents of a list that share an earlier long list have met there.

Texts move late: a set's sketch is the parity of its tokens in at least two bits a token (a power of two). Folded to the
same length, two sketches differ in no more bits than their sets do in tokens, so pairs whose sketches differ in too many
bits can't link and need no text. A bit array of fixed size
over the ids that do need their texts keeps most other texts out of the exchange.

Cases: null, empty and wordless texts have an empty set and link with nothing. Texts of fewer than n words have one
token, the whole sequence. Rows that share an id are one document, the union of their sets; null ids are passed over.
Extra columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import durable
from .common import NOT_SPACE, bit_array, chunks, column, ddl, in_bit_array, mix, only, part, pieces, rows, running

#: prefixes are lengthened to at most so many required matches
LONGEST = 4
#: cost of comparing two sets, in postings read
COMPARE = 50.0
#: about so many tokens at most are sent to the driver and to tasks with their counts (32 MB)
FREQUENT = 1 << 21
#: one token in so many tells which counts are sent
SAMPLED = 64
#: longer posting lists are compared as stars and blocks, shorter ones pair by pair
SHORT, BLOCK = 16, 512
SKETCH = 1024  # bits of a sketch at least
NEIGHBOURS = 2
#: bits of the array over ids: 16 MB
BITS = 1 << 27
#: tokens of a task whose counts are taken at a time (32 MB), and how many of them leave a task at a time
FLUSH, SENT = 1 << 22, 1 << 16
#: columns of a block's matrix that are multiplied at a time (16 MB)
COLUMNS = 1 << 12
#: a durable step has a partition for so many rows (``compact``)
ROWS = 1 << 15
SETS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("s", pa.int64()), ("s2", pa.int64()), ("sketch", pa.binary()), ("token", pa.int64()), ("count", pa.int64())])
MET = pa.schema([("token", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("id", pa.int64()), ("comp", pa.int64())])
POSTINGS = pa.schema([("token", pa.int64()), ("id", pa.int64()), ("s", pa.int64()), ("n", pa.int32()), ("place", pa.int32())])
NEAR = pa.schema([("comp", pa.int64()), ("differ", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def token_sets(texts: pa.Array, n: int):
    """The sorted distinct n-gram hashes of each text, in order."""
    for c in chunks(texts):
        starts, ends, first = c.words(NOT_SPACE)
        if not len(starts):
            for _ in range(c.n):
                yield np.zeros(0, np.uint64)
            continue
        prefix = running(c.word_hashes(starts, ends))
        for at, stop in zip(first[:-1], first[1:], strict=True):
            if stop == at:
                yield np.zeros(0, np.uint64)
            else:
                k = min(n, int(stop - at))
                place = np.arange(at, stop - k + 1)
                yield np.unique(part(prefix, place, place + k) ^ np.uint64(k))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _signature(tokens: np.ndarray) -> tuple[int, int]:
    return _signed(int(mix(tokens).sum(dtype=np.uint64))), _signed(int(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))


def _sketch(tokens: np.ndarray) -> bytes:
    bits = max(SKETCH, 1 << (2 * len(tokens) - 1).bit_length()) if len(tokens) else SKETCH
    return np.packbits(np.bincount((tokens % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """Rows of sketches as rows of fewer 64-bit words; a token's bit is its hash modulo the number of bits."""
    while sketch.shape[1] > words:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


def _differ(a: bytes, b: bytes) -> int:
    words = min(len(a), len(b)) // 8
    x, y = (_folded(np.frombuffer(v, np.uint64)[None, :], words) for v in (a, b))
    return int(np.bitwise_count(x ^ y).sum())


def _summaries(n: int):
    """Tasks' function: id, set size and signature of each text; and counts of the tokens that many sets in the task have."""
    def frequent(held: np.ndarray):
        held.sort()
        again = np.zeros(len(held) + 1, bool)
        again[1:-1] = held[1:] == held[:-1]
        edges = np.flatnonzero(again[1:] != again[:-1])
        starts, ends = edges[0::2], edges[1::2]
        for at in range(0, len(starts), SENT):
            first, last = starts[at : at + SENT], ends[at : at + SENT]
            none = pa.nulls(len(first))
            yield rows(SETS, id=none, n=none, s=none, s2=none, sketch=none, token=held[first].view(np.int64), count=last - first + 1)

    def run(it):
        held, total = np.empty(FLUSH, np.uint64), 0
        for batch in pieces(it):
            sizes, first, second, sketches = [], [], [], []
            for tokens in token_sets(column(batch, "text"), n):
                sizes.append(len(tokens))
                a, b = _signature(tokens)
                first.append(a)
                second.append(b)
                sketches.append(_sketch(tokens))
                if total + len(tokens) > FLUSH:
                    yield from frequent(held[:total])
                    total = 0
                if len(tokens) <= FLUSH:  # a set's tokens are distinct; alone they would all count once
                    held[total : total + len(tokens)] = tokens
                    total += len(tokens)
            none = pa.nulls(len(sizes))
            yield rows(SETS, id=column(batch, "id"), n=sizes, s=first, s2=second, sketch=pa.array(sketches, pa.binary()), token=none, count=none)
        yield from frequent(held[:total])
    return run


def least_count(counts: DataFrame, total: int) -> int:
    """The least count from which on about ``FREQUENT`` tokens of ``counts`` (token, count) remain, by their hashes' sample. ``total``: of all tokens."""
    most = total // FREQUENT + 1  # fewer than FREQUENT tokens make up this share each
    found = (
        counts.where(F.pmod("token", F.lit(SAMPLED)) == 0).groupBy("token").agg(F.sum("count").alias("count"))
        .groupBy(F.least("count", F.lit(most)).alias("count")).agg(F.count("*").alias("tokens")).collect()
    )
    least, tokens = max(2, most), 0
    for row in sorted(found, reverse=True):
        tokens += row.tokens * SAMPLED
        if tokens > FREQUENT:
            return least
        least = min(least, row["count"])
    return 2


def _prefixes(n: int, t: Fraction, frequent):
    """Tasks' function: the longest prefix of each set, as postings."""
    def run(it):
        known, counts, bits = frequent.value
        for batch in pieces(it):
            out = []
            for at, tokens in enumerate(token_sets(column(batch, "text"), n)):
                size = len(tokens)
                if not size:
                    continue
                length = min(size, size - -(-size * t.numerator // t.denominator) + LONGEST)
                count = np.zeros(size, np.int64)
                if len(known):
                    maybe = np.flatnonzero(in_bit_array(bits, tokens))
                    sought = tokens[maybe].view(np.int64)
                    place = np.minimum(np.searchsorted(known, sought), len(known) - 1)
                    often = known[place] == sought
                    count[maybe[often]] = counts[place[often]]
                order = np.argsort(count, kind="stable")[:length]  # tokens are in order themselves
                out.append((at, size, _signature(tokens)[0], tokens[order]))
            if out:
                lengths = np.array([len(x[3]) for x in out])
                spread = lambda values, kind: np.repeat(np.array(values, kind), lengths)
                places = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                yield rows(POSTINGS, token=np.concatenate([x[3] for x in out]).view(np.int64), n=spread([x[1] for x in out], np.int32),
                           id=column(batch, "id").take(pa.array(spread([x[0] for x in out], np.int64))), s=spread([x[2] for x in out], np.int64), place=places.astype(np.int32))
    return run


def _linked(a: np.ndarray, b: np.ndarray, t: Fraction) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common > 0 and t.denominator * common >= t.numerator * (len(a) + len(b) - common)


def _may_link(differ: np.ndarray, both: np.ndarray, t: Fraction) -> np.ndarray:
    """Whether sets of together ``both`` tokens that differ in ``differ`` tokens or more can link."""
    return differ.astype(np.int64) * (t.denominator + t.numerator) <= both * (t.denominator - t.numerator)


def _compare_sketches(t: Fraction):
    """Tasks' function: pairs that can link."""
    def run(it):
        for batch in pieces(it):
            differ = np.array([_differ(x, y) for x, y in zip(column(batch, "sketch_a").to_pylist(), column(batch, "sketch_b").to_pylist(), strict=True)], np.int64)
            good = _may_link(differ, column(batch, "n_a").to_numpy() + column(batch, "n_b").to_numpy(), t)
            yield rows(LINKS, a=column(batch, "a"), b=column(batch, "b")).filter(pa.array(good))
    return run


def _nearby(table: pa.Table, t: Fraction):
    """(place, places, bits that differ): what each document of a block can link with in another component."""
    comps, sizes, raw = table["comp"].to_numpy(), table["n"].to_numpy(), table["sketch"].to_pylist()
    words = np.array([len(x) // 8 for x in raw])
    for length in np.unique(words):  # a pair is compared at the shorter length
        at = np.flatnonzero(words >= length)
        bits = np.concatenate([_folded(np.frombuffer(raw[i], np.uint64)[None, :], length) for i in at])
        for own in np.flatnonzero(words[at] == length):
            me = at[own]
            differ = np.bitwise_count(bits ^ bits[own]).sum(axis=1).astype(np.int64)
            can = np.flatnonzero(_may_link(differ, sizes[at] + sizes[me], t) & (comps[at] != comps[me]))
            if len(can):
                yield me, at[can], differ[can]


def _sketch_neighbours(t: Fraction):
    """Function of one block of a posting list: for each component the pair that is nearest to linking it with another."""
    def run(table: pa.Table) -> pa.Table:
        comps, ids = table["comp"].to_pylist(), table["id"].to_pylist()
        best: dict[int, tuple] = {}
        for at, others, differ in _nearby(table, t):
            near = int(differ.argmin())
            found = (int(differ[near]), *sorted((ids[at], ids[others[near]])))
            for comp in (comps[at], comps[others[near]]):
                best[comp] = min(best.get(comp, found), found)
        return pa.table([pa.array(list(best), pa.int64()), *(pa.array([x[i] for x in best.values()], pa.int64()) for i in range(3))], schema=NEAR)
    return run


def _sketch_block(t: Fraction):
    """Function of one block of a posting list: its documents that can link with one of another component."""
    def run(table: pa.Table) -> pa.Table:
        good = np.zeros(len(table), bool)
        for at, others, _ in _nearby(table, t):
            good[at] = True
            good[others] = True
        return table.select(MET.names).filter(pa.array(good)).cast(MET)
    return run


def _wanted(ids):
    """Tasks' function: the rows whose ids the bit array may hold."""
    def run(it):
        for batch in pieces(it):
            yield batch.filter(pa.array(in_bit_array(ids.value, column(batch, "id").to_numpy())))
    return run


def _compare(n: int, t: Fraction):
    """Tasks' function: pairs whose sets link."""
    def run(it):
        for batch in pieces(it):
            good = [_linked(x, y, t) for x, y in zip(token_sets(column(batch, "text_a"), n), token_sets(column(batch, "text_b"), n), strict=True)]
            yield rows(LINKS, a=column(batch, "a"), b=column(batch, "b")).filter(pa.array(good))
    return run


def _compare_block(n: int, t: Fraction):
    """Function of one block of a posting list: links between components, as few as join them."""
    def run(table: pa.Table) -> pa.Table:
        ids, comps = table["id"].to_numpy(), table["comp"].to_numpy()
        sets = list(token_sets(table["text"].combine_chunks(), n))
        sizes = np.array([len(s) for s in sets])
        tokens, at = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        shared = np.bincount(at, minlength=len(tokens)) > 1
        column_of = np.cumsum(shared) - 1
        take = np.flatnonzero(shared[at])
        take = take[np.argsort(at[take], kind="stable")]
        owner, place = owner[take], column_of[at[take]]
        common = np.zeros((len(sets), len(sets)), np.int64)
        for left in range(0, int(shared.sum()), COLUMNS):
            here = slice(*np.searchsorted(place, (left, left + COLUMNS)))
            incidence = np.zeros((len(sets), COLUMNS), np.float32)
            incidence[owner[here], place[here] - left] = 1
            common += np.rint(incidence @ incidence.T).astype(np.int64)
        union = sizes[:, None] + sizes[None, :] - common
        root = {c: c for c in comps.tolist()}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        out = []
        for x, y in np.argwhere(np.triu((common > 0) & (t.denominator * common >= t.numerator * union) & (comps[:, None] != comps[None, :]))):
            a, b = find(int(comps[x])), find(int(comps[y]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(ids[x]), int(ids[y])))
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], schema=LINKS)
    return run


def compact(df: DataFrame) -> DataFrame:
    """``df`` made durable, in as few partitions as its rows fill.

    Each task of a step leaves files in every exchange; with a task for each shuffle partition, small steps leave more in
    files that are almost empty than the large ones leave in rows.
    """
    df = durable(df)
    count = df.coalesce(df.sparkSession.sparkContext.defaultParallelism).count()
    return df.coalesce(max(1, -(-count // ROWS)))


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable, for every node of ``links`` (a, b). Labels move along links and jump."""
    links = compact(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    few = links.rdd.getNumPartitions()  # no step has more rows than two for each link
    both = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.a", "p.b")
    label = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")).coalesce(few))
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").coalesce(few).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        moved = label.join(near, "node").select("node", "comp", F.least("comp", "near").alias("new")).coalesce(few)
        jump = moved.select(F.col("node").alias("new"), F.col("new").alias("further"))
        moved = durable(moved.join(jump, "new").select("node", "comp", "further").coalesce(few))
        if moved.where("further <> comp").isEmpty():
            return label
        label = moved.select("node", F.col("further").alias("comp"))


def near_duplicates(docs: DataFrame, *, n: int = 5, threshold: str = "0.8", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per id: id, size (of its set) and component (the smallest id reachable by links)."""
    t = Fraction(threshold)
    docs = only(docs, id=id_col, text=text_col).where("id IS NOT NULL")
    spark = docs.sparkSession
    summary = durable(docs.mapInArrow(_summaries(n), ddl(SETS)))
    documents = summary.where("token IS NULL").select("id", "n", "s", "s2", "sketch")
    total = documents.agg(F.sum("n").alias("n")).first().n or 0
    counts = summary.where("token IS NOT NULL").select("token", "count")
    often = counts.groupBy("token").agg(F.sum("count").alias("count")).where(F.col("count") >= least_count(counts, total)).toArrow()
    by_token = np.argsort(often["token"].to_numpy())
    known, counted = (often[c].to_numpy()[by_token] for c in ("token", "count"))
    marks = np.zeros(FREQUENT * 16, bool)
    marks[known % len(marks)] = True
    frequent = spark.sparkContext.broadcast((known, counted, np.packbits(marks, bitorder="little")))
    del often, marks

    # postings: one for each class of equal sets, in one exchange by token
    of_token = Window.partitionBy("token")
    postings = durable(
        docs.mapInArrow(_prefixes(n, t, frequent), ddl(POSTINGS)).repartition("token")
        .groupBy("token", "s").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("place").alias("place"), F.count("*").alias("copies"))
        .withColumn("df", F.count("*").over(of_token)).where("df > 1"))
    overlap = F.expr(f"(n * {t.numerator}L + {t.denominator - 1}L) div {t.denominator}L")  # the least a link can have: no more matches are required
    shortest = F.col("n") - overlap + 1
    cost = [(F.sum(F.when((F.col("place") < shortest + m - 1) & (overlap >= m), F.col("df") - 1)) * (1 + COMPARE / m)) for m in range(1, LONGEST + 1)]
    matches = postings.groupBy("id", "s").agg(F.array(*cost).alias("cost")).select(
        "id", "s", F.array_position("cost", F.array_min(F.filter("cost", lambda c: c.isNotNull()))).cast("int").alias("m"))
    chosen = compact(
        postings.join(matches, ["id", "s"]).where((F.col("m") > 0) & (F.col("place") < shortest + F.col("m") - 1))
        .withColumn("df", F.count("*").over(of_token)).where("df > 1").select("token", "id", "s", "n", "m", "df", "copies"))

    few = chosen.where(F.col("df") <= SHORT)
    left, right = (few.select("token", *(F.col(c).alias(f"{c}_{side}") for c in ("id", "s", "n", "m"))) for side in "ab")
    similar_size = (F.least("n_a", "n_b") * t.denominator >= F.greatest("n_a", "n_b") * t.numerator)
    pairs = (
        left.join(right, "token").where((F.struct("id_a", "s_a") < F.struct("id_b", "s_b")) & similar_size)
        .groupBy("id_a", "s_a", "id_b", "s_b").agg(F.count("*").alias("shared"), F.first(F.least("m_a", "m_b")).alias("m"))
        .where("shared >= m").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    )
    many = chosen.where(F.col("df") > SHORT)
    pivot = F.max(F.struct("copies", "id", "n")).over(of_token)
    stars = many.select("id", "n", pivot.alias("p")).where(
        (F.col("id") != F.col("p.id")) & (F.least("n", "p.n") * t.denominator >= F.greatest("n", "p.n") * t.numerator)).select(F.col("p.id").alias("a"), F.col("id").alias("b"))
    sketches = documents.where("n > 0").select("id", "n", "sketch")
    sketch_of = lambda side: sketches.select(*(F.col(c).alias(new) for c, new in (("id", side), ("n", f"n_{side}"), ("sketch", f"sketch_{side}"))))
    pairs = pairs.union(stars).where("a <> b").distinct().join(sketch_of("a"), "a").join(sketch_of("b"), "b")
    pairs = compact(pairs.mapInArrow(_compare_sketches(t), ddl(LINKS)).distinct())

    def texts_of(ids: DataFrame) -> DataFrame:
        bitmap = spark.sparkContext.broadcast(bit_array(ids, "id", BITS))
        return durable(docs.mapInArrow(_wanted(bitmap), "id BIGINT, text STRING"))  # repeated rows do no harm

    def checked(pairs: DataFrame) -> DataFrame:
        texts = texts_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")))
        one, other = (texts.select(F.col("id").alias(side), F.col("text").alias(f"text_{side}")) for side in "ab")
        return pairs.join(one, "a").join(other, "b").select("a", "b", "text_a", "text_b").mapInArrow(_compare(n, t), ddl(LINKS))

    links = compact(checked(pairs))
    lists = compact(
        many.groupBy("token", "id").agg(F.count("*").alias("rows")).withColumn("first", F.min("token").over(Window.partitionBy("id")))
        .withColumn("all", F.count("*").over(of_token)).drop("rows"))
    sketches = durable(sketches.join(lists.select("id").distinct(), "id", "left_semi"))  # they move once, not in each round
    wide = lists.where(F.col("all") > BLOCK)
    for _ in range(0 if wide.isEmpty() else NEIGHBOURS):
        near = _blocks(wide, components(links), sketches).groupBy("token", "i", "j").applyInArrow(_sketch_neighbours(t), ddl(NEAR))
        near = compact(near.groupBy("comp").agg(F.min(F.struct("differ", "a", "b")).alias("p")).select("p.a", "p.b").distinct())
        links = compact(links.union(checked(near)))
    left_over = compact(_blocks(lists, components(links), sketches).groupBy("token", "i", "j").applyInArrow(_sketch_block(t), ddl(MET)))
    more = left_over.join(texts_of(left_over), "id").groupBy("token", "i", "j").applyInArrow(_compare_block(n, t), ddl(LINKS))
    label = components(links.union(more))

    classes = compact(documents.where("n > 0").groupBy("s", "s2", "n").agg(F.min("id").alias("class")))
    member = (
        documents.where("n > 0").join(classes, ["s", "s2", "n"]).join(label.withColumnRenamed("node", "class"), "class", "left")
        .select("id", "n", F.coalesce("comp", "class").alias("comp"))
    )
    return (
        member.union(documents.where("n = 0").select("id", "n", F.col("id").alias("comp")))
        .groupBy("id").agg(F.max("n").alias("size"), F.min("comp").alias("component"))
    )


def _blocks(lists: DataFrame, label: DataFrame, sketches: DataFrame) -> DataFrame:
    """(token, i, j, id, comp, n, sketch): what is still apart, pairs of blocks of long lists (token, id, first, all).

    Documents outside a list's largest group meet all others of the list. A group is a component, or the documents
    whose first long list is another, earlier one, where they have met.
    """
    apart = compact(lists.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id")))
    group = lambda kind, name: apart.groupBy("token", F.lit(kind).alias("kind"), F.col(name).alias("group")).agg(F.count("*").alias("size"), F.first("all").alias("of"))
    largest = (
        group(0, "comp").union(group(1, "first").where(F.col("group") < F.col("token")))
        .groupBy("token").agg(F.max(F.struct("size", "kind", "group")).alias("top"), F.first("of").alias("of")).where("of > top.size").drop("of")
    )
    inside = F.when(F.col("top.kind") == 0, F.col("comp") == F.col("top.group")).otherwise((F.col("first") == F.col("top.group")) & (F.col("first") < F.col("token")))
    listed = apart.join(largest, "token")
    few = listed.where(F.col("all") <= BLOCK).select("token", "id", "comp", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
    at = F.row_number().over(Window.partitionBy("token").orderBy(inside.cast("int"), "id")) - 1
    met = (
        listed.where(F.col("all") > BLOCK).withColumn("block", F.floor(at / BLOCK)).withColumn("blocks", F.ceil(F.col("all") / BLOCK))
        .withColumn("outside", F.ceil((F.col("all") - F.col("top.size")) / BLOCK)).withColumn("pair", F.explode(F.concat(
            F.transform(F.sequence(F.lit(0), F.least("block", F.col("outside") - 1)), lambda i: F.struct(i.alias("i"), F.col("block").alias("j"))),
            F.when((F.col("block") < F.col("outside")) & (F.col("block") + 1 < F.col("blocks")), F.transform(F.sequence(F.col("block") + 1, F.col("blocks") - 1), lambda j: F.struct(F.col("block").alias("i"), j.alias("j"))))
            .otherwise(F.array().cast("array<struct<i:bigint,j:bigint>>")))))
        .select("token", "id", "comp", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"))
    )
    return few.union(met).repartition("id").join(sketches, "id")  # one row of a list may have become many


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", **options: str) -> DataFrame:
    """The documents with the smallest id of their component; rows with a null id stay. All columns as they are."""
    gone = near_duplicates(docs, id_col=id_col, **options).where("component <> id").select(F.col("id").alias("__gone"))
    return docs.join(gone, docs[id_col] == F.col("__gone"), "left_anti")
