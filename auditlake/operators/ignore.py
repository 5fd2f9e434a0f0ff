"""Ignore patterns of a workspace: an anti join with the paths that match one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import lit, split_lines, strip

IGNORE_FILE = ".scanignore"


#: the patterns in the text of an ignore file
PATTERNS = f"array_distinct(filter(transform({split_lines('content')}, l -> {strip('l')}), p -> p != '' AND NOT startswith(p, '#')))"


def ignore_patterns(files: DataFrame, ignore_file: str = IGNORE_FILE) -> DataFrame:
    """(workspace, pattern) from the ignore file at the root of each workspace."""
    return files.filter(F.col("path") == ignore_file).select("workspace", F.explode(F.expr(PATTERNS)).alias("pattern")).distinct()


def _prepared(patterns: DataFrame) -> DataFrame:
    cut = patterns.withColumn("p", F.expr("IF(startswith(pattern, '**/'), substring(pattern, 4), pattern)"))
    cut = cut.withColumn("p", F.expr("IF(startswith(p, '/'), substring(p, 2), p)"))
    escaped = f"regexp_replace(p, {lit(r'([\\.^$|+(){}])')}, {lit(r'\\$1')})"
    glob = f"replace(replace(replace({escaped}, '[!', '[^'), '*', '.*'), '?', '.')"
    return cut.selectExpr(
        "workspace AS pattern_workspace", "p",
        f"CASE WHEN contains(p, '*') THEN concat('(?s)\\\\A(?:', {glob}, ')\\\\z') END AS glob").distinct()


MATCH = "(contains(path, p) OR name = p OR (glob IS NOT NULL AND (path RLIKE glob OR name RLIKE glob)))"


def apply_ignore(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """Files that no pattern of their workspace matches.

    Paths alone meet the patterns of their workspace. The paths found then leave the files by an anti join on
    (workspace, path), a key that no workspace dominates.
    """
    ignored = (
        files.select("workspace", "path", "name")
        .join(_prepared(patterns), F.col("workspace") == F.col("pattern_workspace")).filter(MATCH)
        .select("workspace", "path").distinct()
    )
    return files.join(ignored, ["workspace", "path"], "left_anti").select(*files.columns)
