"""Distributed gradient updates: tasks train on their own rows and their changes are averaged by weight."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, column, ddl, rows

BLOCKS = 128
PARTS = pa.schema([("block", pa.int64()), ("weight", pa.float64()), ("change", pa.binary())])


def averaged(df: DataFrame, train: Callable, size: int) -> tuple[np.ndarray, float]:
    """The average change of ``size`` parameters, and the weight of all tasks.

    ``train(batches)`` gives (changes, weight) of one task. Changes travel in blocks of a fixed number, and are added
    up as they come, so no task holds more than one block of each kind, however many tasks there are.
    """
    edges = np.linspace(0, size, BLOCKS + 1).astype(int)

    def run(it):
        change, weight = train(batches(it))
        if weight > 0:
            parts = [(change[a:b] * weight).astype(np.float32).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield rows(PARTS, block=np.arange(BLOCKS), weight=np.full(BLOCKS, float(weight)), change=pa.array(parts, pa.binary()))

    def add(it):
        sums: dict[int, np.ndarray] = {}
        weights: dict[int, float] = {}
        for batch in batches(it):
            for block, weight, change in zip(column(batch, "block").to_pylist(), column(batch, "weight").to_pylist(), column(batch, "change").to_pylist(), strict=True):
                new = np.frombuffer(change, np.float32)
                sums[block] = sums[block] + new if block in sums else new.astype(np.float64)
                weights[block] = weights.get(block, 0.0) + weight
        at = sorted(sums)
        yield rows(PARTS, block=at, weight=[weights[b] for b in at], change=pa.array([sums[b].tobytes() for b in at], pa.binary()))

    out, total = np.zeros(size), 0.0
    for r in df.mapInArrow(run, ddl(PARTS)).repartition("block").mapInArrow(add, ddl(PARTS)).collect():  # BLOCKS rows
        out[edges[r.block] : edges[r.block + 1]] = np.frombuffer(r.change, np.float64) / r.weight
        total = r.weight
    return out, total


def softmax_log(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def row_sums(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of ``at`` (n x features), and for each the sum of ``values`` (n x width) over its occurrences."""
    flat = at.ravel()
    order = np.argsort(flat, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], flat[order][1:] != flat[order][:-1]]))
    return flat[order][heads], np.add.reduceat(values[order // at.shape[1]], heads, axis=0)
