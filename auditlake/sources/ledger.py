"""The stored ledger: appended blocks of Parquet files by the first digits of the root, and look-ups that read few of them.

Layout below the ledger's folder: ``block=<name>/bucket=x<digits>/`` holds rows sorted by (root, key) with a Bloom filter
on the root; ``_ids/`` holds one small file per reserved range of ids; ``_log/`` one per block that counts. Only blocks in
``_log`` are ever read, so a writer that fails leaves nothing visible.
"""

from __future__ import annotations

import json
import os
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ledger import auditor_verify, numbered
from ..session import durable

DIGITS = 2
#: requests up to this number of distinct keys meet the ledger by a broadcast (128 bytes each, 13 MB); more shuffle it
FEW_KEYS = 100_000
#: roots up to this number are also pushed down to the files, ten a predicate, so that Bloom filters apply
POINTS = 200
ROWS_A_FILE = 1_000_000


def _paths(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, folder: str) -> list[str]:
    where, store = _paths(spark, folder)
    return sorted(n for n in (s.getPath().getName() for s in store.listStatus(where)) if not n.startswith(".")) if store.exists(where) else []


def _text(spark: SparkSession, path: str) -> dict:
    where, store = _paths(spark, path)
    stream = store.open(where)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, content: dict) -> bool:
    """Write a small file whole, or return false if it is there already.

    The content is written aside and then linked (local folders) or renamed without overwriting (others), both of which
    one writer alone can win. The store has to have such a rename, as HDFS does.
    """
    target, store = _paths(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    out = store.create(aside, False)
    out.write(json.dumps(content).encode())
    out.close()
    try:
        if store.getUri().getScheme() == "file":
            try:
                os.link(aside.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                return False
            return True
        context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration())
        keep = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(aside, target, keep)
        except Exception:
            if store.exists(target):
                return False
            raise
        return True
    finally:
        store.delete(aside, False)


def reserve_ids(spark: SparkSession, path: str, count: int) -> int:
    """The first of ``count`` consecutive ids that no other writer has or will get."""
    while True:
        taken = _names(spark, f"{path}/_ids")
        last = _text(spark, f"{path}/_ids/{taken[-1]}")["last"] if taken else 0
        if create_once(spark, f"{path}/_ids/{len(taken):012d}", {"last": last + count}):
            return last + 1


def bucket(root: str, digits: int = DIGITS) -> Column:
    """Folder of a root: its first hex digits, or one folder for all that do not start with such."""
    return F.expr(f"IF({root} RLIKE '^[0-9a-f]{{{digits}}}', concat('x', left({root}, {digits})), 'other')")


def _write(rows: DataFrame, path: str, block: str, digits: int) -> None:
    # by range with the id as the last key: a root with a third of all rows is split over many files
    keys = ["bucket", "merkle_root", "public_key_hex", "id"]
    (
        rows.withColumn("bucket", bucket("merkle_root", digits)).repartitionByRange(*keys).sortWithinPartitions(*keys)
        .write.partitionBy("bucket").option("parquet.bloom.filter.enabled#merkle_root", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true").option("maxRecordsPerFile", ROWS_A_FILE)
        .parquet(f"{path}/block={block}")
    )


def _publish(spark: SparkSession, path: str, block: str, digits: int, replaces: list[str]) -> None:
    if not create_once(spark, f"{path}/_log/{block}", {"digits": digits, "replaces": replaces}):
        raise RuntimeError(f"block {block} is there already")


def append_ledger(spark: SparkSession, rows: DataFrame, path: str, digits: int = DIGITS) -> tuple[int, int]:
    """Append attestations, duplicates allowed; returns the first and last id given.

    Writers may work side by side: each reserves its own consecutive ids, after those reserved before, and its rows
    become visible all at once. Ids of a writer that fails stay unused. Roots and keys are stored in lower case. Without
    rows nothing is written, and the range is empty. All blocks of a ledger share one number of digits.
    """
    # their order is written down by ``numbered``; all after it is a projection
    fixed = numbered(rows.withColumns({c: F.lower(c) for c in ("merkle_root", "public_key_hex")}))
    count = fixed.count()
    if not count:
        return 1, 0
    first = reserve_ids(spark, path, count)
    block = "b" + uuid.uuid4().hex
    _write(fixed.withColumn("id", F.col("id") + (first - 1)), path, block, digits)
    _publish(spark, path, block, digits, [])
    return first, first + count - 1


def live_blocks(spark: SparkSession, path: str) -> dict[str, int]:
    """Names of the blocks that count, with their digits; one entry per append since the last compaction."""
    log = {name: _text(spark, f"{path}/_log/{name}") for name in _names(spark, f"{path}/_log")}
    gone = {old for entry in log.values() for old in entry["replaces"]}
    return {name: entry["digits"] for name, entry in log.items() if name not in gone}


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All visible rows, with their ``block`` and ``bucket``."""
    blocks = live_blocks(spark, path)
    if not blocks:
        raise ValueError(f"no block of a ledger in {path}")
    return spark.read.option("basePath", path).parquet(*(f"{path}/block={b}" for b in sorted(blocks)))


def compact_ledger(spark: SparkSession, path: str) -> str | None:
    """Rewrite the visible blocks as one; rows and ids stay. Blocks appended meanwhile stay beside it.

    One compaction at a time. The files of replaced blocks are left for readers that started before.
    """
    blocks = live_blocks(spark, path)
    if len(blocks) < 2:
        return None
    old, digits = sorted(blocks), min(blocks.values())
    rows = spark.read.option("basePath", path).parquet(*(f"{path}/block={b}" for b in old)).drop("block", "bucket")
    block = "b" + uuid.uuid4().hex
    _write(rows, path, block, digits)
    _publish(spark, path, block, digits, old)
    return block


def asked_rows(requests: DataFrame, spark: SparkSession, path: str, few_keys: int = FEW_KEYS) -> DataFrame:
    """The ledger's rows that requests may meet: folders of their roots alone are read.

    Up to ``few_keys`` distinct keys are broadcast, and the ledger is filtered where it lies; more keys leave the cut by
    folders. The folders asked for are at most 16^digits + 1.
    """
    digits = set(live_blocks(spark, path).values())
    if len(digits) > 1:
        raise ValueError("blocks of this ledger differ in their digits")
    keys = durable(requests.select(F.lower("merkle_root").alias("root_key"), F.lower("public_key_hex").alias("public_key")).distinct())
    ledger = read_ledger(spark, path)
    folders = sorted(r[0] for r in keys.where("root_key IS NOT NULL").select(bucket("root_key", *digits)).distinct().collect())
    ledger = ledger.where(F.col("bucket").isin(folders))
    if keys.limit(few_keys + 1).count() > few_keys:
        return ledger.drop("block", "bucket")
    roots = sorted(r[0] for r in keys.select("root_key").where("root_key IS NOT NULL").distinct().limit(POINTS + 1).collect())
    if 0 < len(roots) <= POINTS:
        tens = (F.col("merkle_root").isin(roots[i:i + 10]) for i in range(0, len(roots), 10))
        ledger = ledger.where(reduce(Column.__or__, tens))
    same = (F.col("merkle_root") == F.col("root_key")) & (F.col("public_key_hex") == F.col("public_key"))
    return ledger.join(F.broadcast(keys), same, "left_semi").drop("block", "bucket")


def verify_stored(requests: DataFrame, spark: SparkSession, path: str, few_keys: int = FEW_KEYS) -> DataFrame:
    """``auditor_verify`` against a stored ledger; only rows that requests meet are aggregated."""
    return auditor_verify(requests, asked_rows(requests, spark, path, few_keys))
