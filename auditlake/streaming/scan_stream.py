"""Incremental scan of newly landed files. Hits and a state per workspace are kept, never contents.

Beside the checkpoint of a stream lie two tables:

* ``-hits/batch=N``: what the pass over micro-batch N found in its files, as it was found;
* ``-state/slot=N % 2``: for every workspace that has sent a file so far the bits of its file flags and of its Python symbols, its
  ignore patterns, manifests and lock files. A batch merges the state of the batch before it with its own into the
  other slot. The cost of a batch depends on its files and on the number of workspaces, not on the number of batches.

A batch that fails and runs again reads the slot of the batch before it, which is still there, and overwrites its own
folders, so nothing counts twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import lit
from ..operators.detect import rows_of
from ..operators.detectors import with_tools
from ..operators.finalize import finalize
from ..operators.ignore import apply_ignore
from ..operators.practice import LOCK_OF, SYMBOL_FLAGS, flag, gaps_of, lock_findings, needed_flags
from ..operators.symbols import symbol_flags
from ..plans.scan import file_facts, tools_of
from ..rules import needles as N
from ..session import durable

STATE = "workspace STRING, flags BIGINT, symbols BIGINT, patterns ARRAY<STRING>, manifests ARRAY<STRING>, locks ARRAY<STRING>, batch BIGINT"


def _named(files: list[str]) -> str:
    return f"collect_set(CASE WHEN path IN ({', '.join(map(lit, files))}) THEN path END)"


def state_of(facts: DataFrame, files: DataFrame) -> DataFrame:
    """The state of the workspaces of one batch. Sets are bounded: there is one ignore file, and few manifests have names that count."""
    bits = " | ".join(f"CASE WHEN {f} THEN {1 << k}L ELSE 0L END" for k, f in enumerate(SYMBOL_FLAGS))
    symbols = symbol_flags(files).select("workspace", F.expr(bits).alias("symbols"))
    own = facts.groupBy("workspace").agg(
        F.bit_or("flags").alias("flags"), F.expr("array_distinct(flatten(collect_list(patterns)))").alias("patterns"),
        F.expr(_named(list(N.LOCK_FILES))).alias("manifests"), F.expr(_named(list(N.LOCK_FILES.values()))).alias("locks"))
    return own.join(symbols, "workspace", "left").withColumn("symbols", F.coalesce("symbols", F.lit(0).cast("long")))


def merged(before: DataFrame, new: DataFrame) -> DataFrame:
    """Two states as one; a workspace has at most two rows."""
    both = before.select(*new.columns).unionByName(new)
    sets = (F.expr(f"array_distinct(flatten(collect_list({c})))").alias(c) for c in ("patterns", "manifests", "locks"))
    return both.groupBy("workspace").agg(F.bit_or("flags").alias("flags"), F.bit_or("symbols").alias("symbols"), *sets)


def patterns_of(state: DataFrame) -> DataFrame:
    return state.select("workspace", F.explode("patterns").alias("pattern"))


def scan_stream(files: DataFrame, sink: str, checkpoint: str, ids: list[str] | None = None) -> StreamingQuery:
    """Scan every file that has landed and stop.

    Each micro-batch reads its files once (and its Python sources once more) and writes its numbered findings to
    ``sink``, with the ignore patterns and workspace flags of all files that have landed so far. A README or ignore file that
    lands later than a file does not change what was written for that file; ``settled_findings`` gives what a batch scan of
    all files would find. Ids, hashes and positions are made per micro-batch and carry its number, because numbering the whole stream would
    renumber findings already written.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        slot = lambda n: f"{checkpoint}-state/slot={n % 2}"
        facts = durable(file_facts(batch, ids=ids))
        state = state_of(facts, batch)
        if number:
            state = merged(spark.read.schema(STATE).parquet(slot(number - 1)), state)
        state.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(slot(number))
        state = spark.read.schema(STATE).parquet(slot(number))
        hits = facts.where("size(hits) > 0").select("workspace", "path", "name", "hits")
        hits.write.mode("overwrite").parquet(f"{checkpoint}-hits/batch={number}")
        found = with_tools(rows_of(apply_ignore(hits, patterns_of(state))), tools_of(state))
        finalize(found).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return (
        files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def workspace_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The newest whole state of a stream."""
    states = spark.read.schema(STATE).parquet(f"{checkpoint}-state")
    newest = states.agg(F.max("batch")).first()[0]
    return states.where(F.col("batch") == newest).drop("slot")


def settled_findings(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Raw findings of all files that the stream has seen, missing lock files and practice gaps included, as a batch scan of
    the same files gives them: ignore patterns and workspace flags count for files that came before them too.
    """
    state = durable(workspace_state(spark, checkpoint))
    newest = state.agg(F.max("batch")).first()[0]
    hits = spark.read.parquet(f"{checkpoint}-hits").where(F.col("batch") <= newest).drop("batch")
    found = with_tools(rows_of(apply_ignore(hits, patterns_of(state))), tools_of(state))
    manifests = state.select("workspace", F.explode("manifests").alias("path"), "locks").withColumn("lock_file", F.expr(f"{LOCK_OF}[path]"))
    names = [f for f in needed_flags() if f not in SYMBOL_FLAGS]
    flags = state.select("workspace", *(F.expr(flag(f)).alias(f) for f in names),
                         *(F.expr(f"(symbols & {1 << k}L) != 0L").alias(f) for k, f in enumerate(SYMBOL_FLAGS)))
    return found.unionByName(lock_findings(manifests.where("NOT array_contains(locks, lock_file)"))).unionByName(gaps_of(flags))
