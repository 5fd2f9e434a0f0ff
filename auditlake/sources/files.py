"""Files tables: from a tree, from a table, and their path attributes and lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import lit, split_lines
from ..session import durable

# everything from the last dot, if that dot is neither first nor last in the name
SUFFIX = r"^.+(\.[^.]+)$"


def path_attributes(files: DataFrame) -> DataFrame:
    """Add ``name`` and ``ext`` the way path objects define them: no suffix for dot files."""
    name = "element_at(split(path, '/'), -1)"
    return files.selectExpr(
        "workspace", "path", f"{name} AS name", f"regexp_extract({name}, {lit(SUFFIX)}, 1) AS ext", "content")


def utf8_text(raw: str) -> Column:
    """Bytes as text with undecodable bytes dropped."""
    text = f"cast({raw} AS string)"
    return F.expr(
        f"CASE WHEN is_valid_utf8({text}) THEN {text} ELSE replace(make_valid_utf8({text}), '\\ufffd', '') END")


def _open(root: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a root; ``s3a`` is Hadoop's name for ``s3``."""
    return arrow_fs.FileSystem.from_uri(root.replace("s3a://", "s3://", 1)) if "://" in root else (arrow_fs.LocalFileSystem(), root)


ENTRY = "path STRING, folder BOOLEAN, size BIGINT"
READ_BYTES = 128 << 20


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of all files below ``root``, dot and underscore files included, paths relative to it.

    The driver lists the root alone. Each round lists the folders of one depth in tasks, one folder level a row, and
    spreads the folders found over tasks again, so a workspace with a third of all folders is no task of its own.
    """
    store, base = _open(root)
    base = base.rstrip("/")

    def entries(where: arrow_fs.FileSystem, folder: str) -> list[tuple[str, bool, int]]:
        found = where.get_file_info(arrow_fs.FileSelector(folder))
        return [(i.path[len(base) + 1:], i.type == arrow_fs.FileType.Directory, i.size or 0) for i in found]

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, _ = _open(root)
        for batch in batches:
            for folder in batch["path"]:
                yield pd.DataFrame(entries(where, f"{base}/{folder}"), columns=["path", "folder", "size"]).astype({"folder": bool, "size": "int64"})

    level = spark.createDataFrame(entries(store, base), ENTRY)
    files = level.where("NOT folder")
    while True:
        folders = level.where("folder")
        count = folders.count()
        if not count:
            return files.select("path", "size")
        tasks = min(count, 4 * spark.sparkContext.defaultParallelism)
        level = durable(folders.repartition(tasks).mapInPandas(listed, ENTRY))
        files = files.unionByName(level.where("NOT folder"))


def tree_contents(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all files below ``root``; paths are spread before any content is read, one file at a time."""
    base = _open(root)[1].rstrip("/")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, _ = _open(root)
        for batch in batches:
            for path in batch["path"]:
                with where.open_input_stream(f"{base}/{path}") as stream:
                    yield pd.DataFrame({"path": [path], "content": [stream.read()]})

    paths = durable(list_tree(spark, root))
    total = paths.agg(F.sum("size")).first()[0] or 0
    # a number of its own: adaptive execution would judge the partitions by the size of the paths
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // READ_BYTES))
    return paths.select("path").repartition(tasks, "path").mapInPandas(read, "path STRING, content BINARY")


def read_files(spark: SparkSession, root: str, workspace: str | None = None) -> DataFrame:
    """Read a tree. One workspace per top folder unless a name for the whole tree is given."""
    files = tree_contents(spark, root).select("path", utf8_text("content").alias("content"))
    if workspace is not None:
        return path_attributes(files.withColumn("workspace", F.lit(workspace)))
    return path_attributes(files.selectExpr(
        "substring_index(path, '/', 1) AS workspace",
        "substring(path, locate('/', path) + 1) AS path",
        "content"))


def files_from_table(df: DataFrame, workspace: str, path: str, text: str) -> DataFrame:
    """Same shape from any table; arguments are SQL expressions over its columns."""
    return path_attributes(df.selectExpr(f"{workspace} AS workspace", f"{path} AS path", f"{text} AS content"))


def explode_lines(files: DataFrame) -> DataFrame:
    """One row per line, numbered from one."""
    return (
        files.select("workspace", "path", F.posexplode(F.expr(split_lines("content"))).alias("pos", "line"))
        .selectExpr("workspace", "path", "pos + 1 AS line_no", "line")
    )
