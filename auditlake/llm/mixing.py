"""Operator 9, mixing sources to target weights, in DataFrame functions alone.

The words of each source are packed, document after document, into blocks of ``BLOCK`` words. Output shards have
``SHARD`` slots. A shard's slots are divided among sources by a multinomial draw: each source gets the whole part of
its expected number, and the rest of the slots is drawn with the sources' fractional parts as probabilities (residual
multinomial draw, so small shards stay near their expectation). All shards' draws are taken together: the sources' fractional
parts are laid end to end, and a keyed permutation deals one point of each unit of that line to a draw. So every source gets its
expected number over all shards, rounded up or down, however many sources there are. The slots of a source are numbered through all shards;
a keyed pseudorandom permutation of its block numbers, another one for the second round, says which block fills which
slot, and slots and pieces of documents meet in a join on (source, block).

Targets: sources by code point, null last, have weights 3, 1, 2 and so on; together they get ``SHARE`` times all words.
No target exceeds ``LIMIT`` times its source's words; what is above goes to the others by weight.

Scale: documents are placed by running sums within (source, hash of id), and those 1,024 groups per source by a second
running sum, so a hot source is no hot group. A permutation is arithmetic on the slot's number: no table, no sort. One row
per source must fit a task; (shard, source) has a row only if the source has slots in the shard.

Cases: null and wordless texts have size 0 and are never taken. A null source is a source of its own. Rows with equal
ids are placed and counted each for itself. An empty table gives an empty mix. Extra columns are ignored. Draws depend
on ids, sources and sizes alone, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import durable
from .common import only

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, LIMIT = 1.5, 2
BLOCK, SHARD = 256, 4096
GROUPS, WALK = 1024, 32
SEED = 20240607
#: where in its unit each drawn point lies
OFFSET = 0.6180339887498949


def sized(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size): words of each text."""
    return only(docs, id=id_col, source=source_col, text=text_col).select(
        "id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)).cast("long"), F.lit(0)).alias("size"))


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source: source, pos (its rank), weight, source_size, target."""
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("pos"), F.lit(len(WEIGHTS))) + 1).cast("int"))
    sources = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("pos", F.row_number().over(ranked) - 1).withColumn("weight", weight.cast("double"))
        .withColumn("most", F.col("source_size") * float(LIMIT))
    )
    # the common rate: targets are least(most, rate * weight); sources by most / weight, the first that stays below sets it
    everyone = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = Window.orderBy(F.col("most") / F.col("weight"), "pos").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everyone) * SHARE - F.coalesce(F.sum("most").over(earlier), F.lit(0.0))
    free = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    rated = sources.withColumn("rate", left / free)
    fits = F.when(F.col("rate") <= F.col("most") / F.col("weight"), F.struct(F.col("most") / F.col("weight"), "pos", "rate"))
    return rated.withColumn("rate", F.min(fits).over(everyone)["rate"]).select(
        "source", "pos", "weight", "source_size", F.least(F.col("most"), F.col("rate") * F.col("weight")).alias("target"))


def placed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """``sizes`` with pos, and start: the number of the document's first word among the words of its source (null without words)."""
    with_pos = sizes.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))).join(
        sources.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")).alias("key"), "pos", "source_size", "target"), "key").drop("key")
    grouped = with_pos.withColumn("part", F.pmod(F.xxhash64(F.col("id"), F.lit(SEED)), F.lit(GROUPS)))
    before = Window.partitionBy("pos").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = grouped.groupBy("pos", "part").agg(F.sum("size").alias("words")).select(
        "pos", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("pos", "part").orderBy("id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return grouped.join(offsets, ["pos", "part"]).withColumn("start", F.when(F.col("size") > 0, start)).drop("part", "offset")


def _keyed(value: Column, key: int, below: Column) -> Column:
    return F.pmod(F.xxhash64(value, F.col("pos"), F.col("round"), F.lit(SEED + key)), below)


def _shuffled(x: Column) -> Column:
    """A keyed permutation of 0 .. a * b - 1: four additive rounds on the two digits of ``x``."""
    low, high = F.pmod(x, F.col("a")), F.floor(x / F.col("a"))
    digits = F.array(F.struct(low.alias("l"), high.alias("h")))

    def turn_low(key: int):
        return lambda d: F.struct(F.pmod(d["l"] + _keyed(d["h"], key, F.col("a")), F.col("a")).alias("l"), d["h"].alias("h"))

    def turn_high(key: int):
        return lambda d: F.struct(d["l"].alias("l"), F.pmod(d["h"] + _keyed(d["l"], key, F.col("b")), F.col("b")).alias("h"))

    for turn in (turn_low(1), turn_high(2), turn_low(3), turn_high(4)):
        digits = F.transform(digits, turn)
    return F.element_at(F.transform(digits, lambda d: d["l"] + d["h"] * F.col("a")), 1)


def _permuted(x: Column) -> Column:
    """A keyed permutation of 0 .. blocks - 1, where a * b is blocks or a little more.

    A value outside is permuted again: a cycle through a known number always comes back, in fewer than a steps; beyond
    1,024 blocks the odds against 32 steps are below 2^-160.
    """
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), _shuffled(x), lambda y, _: F.when(y < F.col("blocks"), y).otherwise(_shuffled(y)))


def slots(sources: DataFrame, *, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(shard, slot, pos, block): which block of which source fills each slot of each output shard."""
    spark = sources.sparkSession
    full = sources.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long")).withColumn(
        "draws", F.least(F.col("target") * F.col("blocks") / F.col("source_size"), F.col("blocks") * float(LIMIT)))
    row = full.agg(F.sum("draws").alias("draws")).first()
    shards = max(1, -(-int(row.draws or 0) // shard))
    # fractional parts end to end, in hashed order so that no order of sizes meets the even spacing of the points
    upto = Window.orderBy(F.xxhash64("pos", F.lit(SEED)), "pos")
    share = F.col("draws") / shards
    each = durable(
        full.withColumn("even", F.floor(share)).withColumn("edge", F.sum(share - F.floor(share)).over(upto))
        .withColumn("stop", F.ceil(F.col("edge") * shards - OFFSET)).withColumn("start", F.coalesce(F.lag("stop").over(upto), F.lit(0)))
    )
    last = each.agg(F.max("edge").alias("rest"), F.max("stop").alias("points")).first()
    rest, points = max(last.rest or 0.0, 1e-12), last.points or 0
    a = max(1, math.isqrt(max(points - 1, 0)) + 1)
    dealt = (
        spark.range(points).select(F.col("id").alias("draw"), F.lit(-1).alias("pos"), F.lit(0).cast("long").alias("round"), F.lit(points).cast("long").alias("blocks"),
                                   F.lit(a).cast("long").alias("a"), F.lit(max(1, -(-points // a))).cast("long").alias("b"))
        .select(F.least(F.ceil((F.col("draw") + 1) / rest) - 1, F.lit(shards - 1)).alias("shard"), _permuted(F.col("draw")).alias("point"))
    )
    owned = each.where("stop > start").select("pos", F.explode(F.sequence("start", F.col("stop") - 1)).alias("point"))
    # Spark sees the points as the few rows they are exploded from and would broadcast them
    drawn = owned.hint("merge").join(dealt, "point").select("shard", "pos", F.lit(1).cast("long").alias("n"))
    whole = spark.range(shards).withColumnRenamed("id", "shard").crossJoin(F.broadcast(each.where("even > 0").select("pos", F.col("even").alias("n"))))
    earlier = Window.partitionBy("pos").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("shard").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        whole.unionByName(drawn).groupBy("shard", "pos").agg(F.sum("n").alias("n")).join(each.select("pos", "blocks"), "pos")
        .withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .withColumn("first_slot", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    )
    numbered = (
        counts.select("shard", "pos", "blocks", "first", "first_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"))
        .withColumn("k", F.col("first") + F.col("j")).where(F.col("k") < F.col("blocks") * LIMIT)
        .withColumn("round", F.floor(F.col("k") / F.col("blocks")))
        .withColumn("a", F.ceil(F.sqrt("blocks"))).withColumn("b", F.ceil(F.col("blocks") / F.col("a")))
    )
    return numbered.select("shard", (F.col("first_slot") + F.col("j")).alias("slot"), "pos", _permuted(F.pmod(F.col("k"), F.col("blocks"))).alias("block"))


def mix(places: DataFrame, filled: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """The mix as pieces of documents: (shard, slot, pos, start, id, from_word, to_word), words counted in the document."""
    pieces = (
        places.where("size > 0").select("id", "pos", "start", "size", F.explode(F.sequence(
            F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
        .withColumn("from_word", F.greatest(F.lit(0), F.col("block") * block - F.col("start")))
        .withColumn("to_word", F.least("size", (F.col("block") + 1) * block - F.col("start")))
    )
    # Spark sees the slots as the few rows they are exploded from and would broadcast them
    return filled.hint("merge").join(pieces, ["pos", "block"]).select("shard", "slot", "pos", "start", "id", "from_word", "to_word")


def mixed_documents(docs: DataFrame, *, block: int = BLOCK, shard: int = SHARD, **columns: str) -> DataFrame:
    """Per document: id, size, source_size, target and taken (words the mix takes from it, repeats counted)."""
    sizes = durable(sized(docs, **columns))
    sources = durable(targets(sizes))
    places = durable(placed(sizes, sources))
    taken = mix(places, slots(sources, block=block, shard=shard), block=block).groupBy("pos", "start").agg(
        F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    return places.join(taken, ["pos", "start"], "left").select(
        "id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def block_texts(docs: DataFrame, *, block: int = BLOCK, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: (shard, slot, doc_ids, text), the words of each filled slot. Ids must be unique and not null."""
    sizes = durable(sized(docs, id_col=id_col, text_col=text_col, source_col=source_col))
    sources = durable(targets(sizes))
    places = durable(placed(sizes, sources))
    pieces = mix(places, slots(sources, block=block, shard=shard), block=block)
    words = F.regexp_extract_all("text", F.lit(f"({WORDS})"), F.lit(1))
    cut = F.transform("spans", lambda s: F.struct(
        s["shard"].alias("shard"), s["slot"].alias("slot"), s["start"].alias("start"),
        F.array_join(F.slice("words", (s["from_word"] + 1).cast("int"), (s["to_word"] - s["from_word"]).cast("int")), " ").alias("text")))
    of_document = pieces.groupBy("id").agg(F.collect_list(F.struct("shard", "slot", "start", "from_word", "to_word")).alias("spans"))
    return (
        only(docs, id=id_col, text=text_col).join(of_document, "id").withColumn("words", words).select("id", F.inline(cut))
        .groupBy("shard", "slot").agg(F.sort_array(F.collect_list(F.struct("start", "id", "text"))).alias("parts"))  # one block
        .select("shard", "slot", F.col("parts")["id"].alias("doc_ids"), F.array_join(F.col("parts")["text"], " ").alias("text"))
    )
