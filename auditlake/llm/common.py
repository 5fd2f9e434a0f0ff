"""Columnar text helpers shared by the operators: words, word hashes and n-gram hashes of Arrow batches.

A batch of texts becomes one byte array in which a separator follows each text, so no word, line or n-gram crosses
texts. Hashes are 64-bit polynomials over random byte values, read off a running sum: the cost is a few vector
operations per byte, whatever the number of words.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: bytes of text worked on at a time; one longer text is worked on alone
CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

BYTES = np.arange(256)
LOWER = np.where((BYTES >= 65) & (BYTES <= 90), BYTES + 32, BYTES).astype(np.uint8)
#: words [^\x20\x09-\x0D]+
NOT_SPACE = ~((BYTES == 32) | ((BYTES >= 9) & (BYTES <= 13)))
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower-cased
ALNUM = ((BYTES >= 48) & (BYTES <= 57)) | ((LOWER >= 97) & (LOWER <= 122)) | (BYTES >= 128)
VALUES = np.random.Generator(np.random.PCG64(20240601)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_VALUES = VALUES[LOWER]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on all bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK + (1 << 16))
        for at, base in enumerate((_BASE, _BASE_INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[at] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def running(values: np.ndarray) -> np.ndarray:
    """Prefix hashes: entry i is the polynomial of the first i values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def part(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the value ranges [start, end), independent of their place."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start])


def binary_texts(column: pa.Array) -> pa.Array:
    """Texts as bytes with 64-bit offsets; null becomes empty."""
    return pc.fill_null(column.cast(pa.large_binary()), b"")


class Chunk:
    """Consecutive texts as one byte array; ``at``: where each text starts, one more entry for the end."""

    def __init__(self, texts: pa.Array, first: int, separator: bytes = b" "):
        self.first, self.n = first, len(texts)
        lists = pa.LargeListArray.from_arrays(pa.array([0, self.n], pa.int64()), texts)
        joined = pc.binary_join(lists, pa.scalar(separator, pa.large_binary()))
        raw = joined.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        self.data = self.data[: int(lengths.sum()) + max(self.n - 1, 0)]
        self.at = np.zeros(self.n + 1, np.int64)
        np.cumsum(lengths + 1, out=self.at[1:])
        self.lengths = lengths

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, positions, "right") - 1

    def words(self, letters: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words, and for each text the number of the first word (one more entry for the end)."""
        inside = np.zeros(len(self.data) + 2, bool)
        inside[1:-1] = letters[self.data]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[0::2], edges[1::2]
        return starts, ends, np.searchsorted(starts, self.at)

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = LOWER_VALUES) -> np.ndarray:
        return part(running(values[self.data]), starts, ends)


def grams(hashes: np.ndarray, n: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``n`` consecutive items from each place on, and which of them stay inside their text."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    at = np.arange(m)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return part(running(hashes), at, at + n), owner[:m] == owner[n - 1 :]


def chunks(texts: pa.Array, separator: bytes = b" ", size: int = CHUNK) -> Iterator[Chunk]:
    """Cut a column of texts into chunks of about ``size`` bytes."""
    texts = binary_texts(texts)
    if not len(texts):
        return
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    first = 0
    while first < len(texts):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + size, "right")))
        yield Chunk(texts.slice(first, last - first), first, separator)
        first = last


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch from arrays in the order of ``schema``."""
    arrays = []
    for field in schema:
        x = columns[field.name]
        arrays.append(x.cast(field.type) if isinstance(x, pa.Array) else pa.array(x, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def packed(matrix: np.ndarray) -> pa.Array:
    """One binary value per row of a 2-d array."""
    m = np.ascontiguousarray(matrix)
    width = m.shape[1] * m.itemsize
    offsets = pa.py_buffer(np.arange(m.shape[0] + 1, dtype=np.int32) * np.int32(width))
    return pa.Array.from_buffers(pa.binary(), m.shape[0], [None, offsets, pa.py_buffer(m.reshape(-1).view(np.uint8))])


def ragged(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary value per range of a 1-d array; ``bounds`` has one entry more than there are ranges."""
    v = np.ascontiguousarray(values[bounds[0] : bounds[-1]])
    offsets = ((bounds - bounds[0]) * v.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(v.view(np.uint8))])


def ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "BIGINT", pa.int32(): "INT", pa.float64(): "DOUBLE", pa.binary(): "BINARY", pa.bool_(): "BOOLEAN", pa.string(): "STRING"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns alone, under fixed names; other columns of the input can't clash with them."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bit_array(df: DataFrame, hash_column: str, bits: int) -> np.ndarray:
    """Bytes of a bit array with a bit for each hash (modulo ``bits``). The driver gets bits / 64 numbers at most."""
    found = (
        df.select(F.pmod(F.col(hash_column), F.lit(bits)).alias("p"))
        .select(F.expr("shiftright(p, 6)").alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
        .groupBy("w").agg(F.bit_or("b").alias("b"))
    )
    words = np.zeros(bits // 64, np.int64)
    rows_found = found.toArrow()
    words[rows_found["w"].to_numpy()] = rows_found["b"].to_numpy()
    return words.view(np.uint8)


def in_bit_array(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash (as in ``bit_array``) may be in the set."""
    place = (hashes.view(np.int64) % (len(bitmap) * 8)).astype(np.int64)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def batches(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in it if b.num_rows)


def give_back() -> None:
    """Return free memory to the system. A Python worker goes on to other tasks and would keep the most that any of them took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def pieces(it: Iterable[pa.RecordBatch], size: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``size`` rows; what is made of a piece is small, though the batch it is cut from may not be."""
    give_back()
    batch = None
    for batch in it:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)
    del batch
    give_back()


def bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The top ``bits`` bits of each hash."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def previous(hashes: np.ndarray, first: np.ndarray, back: int = 1) -> np.ndarray:
    """The hash ``back`` places before each item, 0 where the text has none."""
    out = np.zeros_like(hashes)
    out[back:] = hashes[: len(hashes) - back]
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out[np.arange(len(hashes)) - first[owner] < back] = 0
    return out


def per_text(values: np.ndarray, first: np.ndarray, how: np.ufunc, empty: float) -> np.ndarray:
    """Reduce the items of each text; ``empty`` for texts without items."""
    out = np.full(len(first) - 1, empty)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = how.reduceat(values, first[full])
    return out


def scored(df: DataFrame, text_col: str, fields: str, score) -> DataFrame:
    """All rows and columns of ``df`` plus the columns of ``fields``; ``score(texts)`` gives arrays for a column of texts.

    The names in ``fields`` must not be among the columns of ``df``.
    """
    at = df.columns.index(text_col)

    def run(it):
        for batch in batches(it):
            new = score(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x) for x in new.values())], names=[*batch.schema.names, *new])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{kept}, {fields}")


def sample_of_labels(labels: DataFrame, label_col: str, most: int, folds: int, held_out: int) -> DataFrame:
    """At most ``most`` labelled ids (id, label, fold) outside the held-out fold, those of the smallest hashes.

    Null ids and labels are passed over; the largest label of an id counts.
    """
    fold = F.crc32(F.col("id").cast("string")) % folds
    return (
        only(labels, id="doc_id", label=label_col).where("id IS NOT NULL AND label IS NOT NULL")
        .groupBy("id").agg(F.max("label").cast("int").alias("label")).withColumn("fold", fold.cast("int"))
        .where(F.col("fold") != held_out).orderBy(F.xxhash64("id"), "id").limit(most)
    )


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0) -> np.ndarray:
    """Weights of a small logistic regression by Newton's method; the last weight is the intercept.

    ``ridge`` holds the weights of the standardised features down where rows are few.
    """
    mean, deviation = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / deviation, np.ones(len(x))])
    weight = np.ones(len(x)) if weight is None else weight
    w, penalty = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-9
    for _ in range(40):
        p = sigmoid(z @ w)
        slope = z.T @ (weight * (p - y)) + penalty @ w
        step = np.linalg.solve((z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, slope)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
    plain = w[:-1] / deviation
    return np.append(plain, w[-1] - plain @ mean)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def gathered(it: Iterable[pa.RecordBatch], schema: pa.Schema) -> pa.Table:
    """All rows of a task; Spark may call columns not null that the schema does not."""
    return pa.Table.from_batches([pa.RecordBatch.from_arrays(b.columns, schema=schema) for b in it], schema)
