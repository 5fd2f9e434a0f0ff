"""Roots of workspaces that only grow: stored peaks instead of a fold over all leaves.

A state row (workspace, n, peaks) holds the whole subtrees that ``n`` leaves fall into: one per binary digit of ``n``
that is set, lowest level first, so at most 63. New leaves are folded with the peaks to their left; nothing earlier is
read or hashed again, and the root is the one that a fold over all leaves would give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .finalize import EMPTY_ROOT, FAN

PEAKS = "array<struct<level:int,node:binary>>"
STATE = f"workspace string, n bigint, peaks {PEAKS}"
SALTS = 64


def no_roots(spark: SparkSession) -> DataFrame:
    """The state before the first batch."""
    return spark.createDataFrame([], STATE)


def _hash(left: str, right: str) -> str:
    return f"unhex(sha2(concat({left}, {right}), 256))"


def _folded(base: int, fan: int) -> str:
    """Nodes of one chunk (``nodes``, ordered) behind its peaks (``old``): its pairs level by level, and what stays alone."""
    row = f"concat(transform(filter(old, p -> p.level = {base} + l), p -> p.node), acc.nodes)"
    alone = f"IF(size(row) % 2 = 1, array(named_struct('level', {base} + l, 'node', element_at(row, -1))), cast(array() AS {PEAKS}))"
    pairs = f"transform(sequence(0, cast(size(row) div 2 AS int) - 1), i -> {_hash('row[2 * i]', 'row[2 * i + 1]')})"
    step = f"named_struct('nodes', IF(size(row) < 2, cast(array() AS array<binary>), {pairs}), 'peaks', concat(acc.peaks, {alone}))"
    start = f"named_struct('nodes', nodes, 'peaks', cast(array() AS {PEAKS}))"
    return f"aggregate(sequence(0, {fan - 1}), {start}, (acc, l) -> transform(array({row}), row -> {step})[0])"


def append_leaves(state: DataFrame, leaves: DataFrame, leaf: str = "evidence_hash", fan: int = FAN) -> DataFrame:
    """The state after a batch of leaves (workspace, position, ``leaf``), positions from one in the order of the batch.

    Each round folds the new nodes of one span of ``fan`` levels, keyed by (workspace, chunk): a task or array holds one
    chunk and the ``fan`` peaks before it. A chunk without new nodes gives its peaks back as they are. Workspaces
    without new leaves keep their rows, new ones get one. Write the result down before the next batch.
    """
    before = state.select("workspace", F.col("n").alias("n_before"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # salted: a workspace with a third of all leaves is looked up under many keys
    cells = (
        leaves.select("workspace", "position", F.unhex(leaf).alias("node"), F.expr(f"cast(pmod(position, {SALTS}) AS int)").alias("salt"))
        .join(before, ["workspace", "salt"], "left")
        .select("workspace", F.expr("coalesce(n_before, 0L) + position - 1").alias("at"), "node")
    )
    counts = state.select("workspace", "n").unionByName(leaves.groupBy("workspace").agg(F.count(F.lit(1)).alias("n"))).groupBy("workspace").agg(F.sum("n").alias("n"))
    last = counts.agg(F.max("n")).first()[0] or 0
    peaks, base = [], 0
    while last >> base:
        span = f"filter(peaks, p -> p.level >= {base} AND p.level < {base + fan})"
        old = state.select("workspace", F.expr(f"shiftright(n, {base + fan})").alias("chunk"), F.lit(None).cast("struct<at:bigint,node:binary>").alias("cell"),
                           F.expr(span).alias("old")).where("size(old) > 0")
        new = cells.select("workspace", F.expr(f"shiftright(at, {fan})").alias("chunk"), F.struct("at", "node").alias("cell"), F.lit(None).cast(PEAKS).alias("old"))
        folded = (
            new.unionByName(old).groupBy("workspace", "chunk")
            .agg(F.array_sort(F.collect_list("cell")).alias("cells"), F.max("old").alias("old"))
            .selectExpr("workspace", "chunk", "transform(cells, c -> c.node) AS nodes", f"coalesce(old, cast(array() AS {PEAKS})) AS old")
            .select("workspace", "chunk", F.expr(_folded(base, fan)).alias("done"))
        )
        peaks.append(folded.select("workspace", F.explode("done.peaks").alias("peak")))
        cells = folded.where("size(done.nodes) > 0").selectExpr("workspace", "chunk AS at", "done.nodes[0] AS node")
        base += fan
    if not peaks:
        return state.select("workspace", "n", "peaks")
    every = peaks[0]
    for more in peaks[1:]:
        every = every.unionByName(more)
    # at most 63 peaks a workspace
    return counts.join(every.groupBy("workspace").agg(F.array_sort(F.collect_list("peak")).cast(PEAKS).alias("peaks")), "workspace").select("workspace", "n", "peaks")


def state_roots(state: DataFrame) -> DataFrame:
    """Root per workspace from its peaks; a lone last node is paired with itself, as in a fold over all leaves."""
    low, high = "peaks[0].level", "element_at(peaks, -1).level"
    left = f"IF(l > {low}, coalesce(get(filter(peaks, p -> p.level = l), 0).node, c), c)"
    root = f"IF({low} = {high}, peaks[0].node, aggregate(sequence({low}, {high}), peaks[0].node, (c, l) -> {_hash(left, 'c')}))"
    return state.select("workspace", F.when(F.size("peaks") == 0, EMPTY_ROOT).otherwise(F.lower(F.hex(F.expr(root)))).alias("merkle_root"))
