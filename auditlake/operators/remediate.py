"""Suggested fixes as table-to-table rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.gates import unquote
from ..functions.text import java, lit, split_lines, strip
from ..rules import needles as N, secrets as S
from .dims import finding_type_controls
from .finalize import json_string

# fixed value: hint put below a corrected line
ENCRYPTION_HINT = [
    "  # Enforce server-side encryption",
    "  # server_side_encryption_configuration {",
    "  #   rule {",
    "  #     apply_server_side_encryption_by_default {",
    "  #       sse_algorithm = \"AES256\"",
    "  #     }",
    "  #   }",
    "  # }",
]
DOCSTRING = "^('''|\"\"\")"
INDENT = r"(?U)^\s*"


def import_index(lines: str = "lines") -> str:
    """0-based place for an import: after a shebang and a module docstring."""
    start = f"IF(startswith({lines}[0], '#!'), 1, 0)"
    opening = f"get({lines}, s)"
    quote = f"left({opening}, 3)"
    closing = f"get(filter(sequence(s + 1, size({lines}) - 1), k -> contains({lines}[k], {quote})), 0)"
    after = f"CASE WHEN s + 1 > size({lines}) - 1 THEN size({lines}) ELSE coalesce({closing} + 1, size({lines})) END"
    return (
        f"CASE WHEN size({lines}) = 0 THEN 0 ELSE transform(array({start}), s -> "
        f"CASE WHEN {opening} RLIKE {lit(DOCSTRING)} THEN {after} ELSE s END)[0] END"
    )


def import_insertion(files: DataFrame) -> DataFrame:
    """Where ``import os`` goes in each Python file; null where it is already there."""
    staged = files.filter("ext = '.py'").withColumn("lines", F.expr(split_lines("content")))
    has = f"exists(lines, l -> {strip('l')} = 'import os')"
    return staged.selectExpr(
        "workspace", "path", f"CASE WHEN NOT {has} THEN cast({import_index()} AS int) END AS insert_at")


def fix_secret_lines(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Secret assignments of Python files as environment look-ups, indentation kept.

    Assignment lines are cut out of the files in a narrow pass and only they are joined with the
    findings, so contents do not move.
    """
    pattern = lit(java(S.ASSIGNMENT))
    lines = f"transform({split_lines('content')}, (l, i) -> named_struct('line', i + 1, 'before', l))"
    assignments = (
        files.filter("ext = '.py'")
        .selectExpr("workspace", "path AS file", f"inline_outer(filter({lines}, x -> x.before RLIKE {pattern}))")
        .filter("line IS NOT NULL")
    )
    secrets = findings.filter("type = 'hardcoded_secret' AND endswith(file, '.py') AND line IS NOT NULL")
    return (
        secrets.join(assignments, ["workspace", "file", "line"])
        .withColumns({
            "var_name": F.expr(f"regexp_extract(before, {pattern}, 1)"),
            "literal": F.expr(unquote(f"regexp_extract(before, {pattern}, 2)")),
            "indent": F.expr(f"regexp_extract(before, {lit(INDENT)}, 0)"),
        })
        .withColumn("env_var", F.expr("regexp_replace(upper(var_name), '[^A-Z0-9_]', '_')"))
        .withColumn("after", F.expr(
            f"concat(indent, var_name, ' = os.getenv(\\'', env_var, '\\', ', {json_string('literal')}, ')')"))
    )


def fix_public_acl(files: DataFrame) -> DataFrame:
    """First public line of each ``.tf`` file made private, with the encryption hint below it."""
    mark = lit(N.PUBLIC_ACL_MARKER)
    hint = "array(" + ", ".join(lit(h) for h in ENCRYPTION_HINT) + ")"
    staged = files.filter(f"ext = '.tf' AND contains(content, {mark})").withColumn("lines", F.expr(split_lines("content")))
    at = f"array_position(transform(lines, l -> contains(l, {mark})), true)"
    return (
        staged.withColumn("line", F.expr(f"cast({at} AS int)"))
        .withColumns({"before": F.expr("lines[line - 1]")})
        .withColumns({"after": F.expr(f"replace(before, {mark}, 'private')")})
        .withColumn("new_content", F.expr(
            f"array_join(concat(slice(lines, 1, line - 1), array(after), {hint}, "
            f"slice(lines, line + 1, greatest(size(lines) - line, 0))), '\\n')"))
        .select("workspace", F.col("path").alias("file"), "line", "before", "after", "new_content")
    )


def fix_catalogue(findings: DataFrame, files: DataFrame) -> DataFrame:
    """One row per fixable finding: old and new line beside the control it answers."""
    secret = fix_secret_lines(findings, files).select(
        "workspace", "file", "line", "before", "after", F.col("id").alias("finding_id"), "type")
    acl = findings.filter("type = 'insecure_acl' AND endswith(file, '.tf')").select(
        "workspace", "file", F.col("id").alias("finding_id"), "type")
    public = fix_public_acl(files).drop("new_content").join(acl, ["workspace", "file"])
    dim = finding_type_controls(findings.sparkSession).select(
        "type", "control_id", "control_category", "frameworks", "description")
    return secret.unionByName(public).join(F.broadcast(dim), "type", "left")


def env_template_entries(fixes: DataFrame, files: DataFrame, template: str = ".env.template") -> DataFrame:
    """``NAME=value`` lines of the fixes that the workspace's template does not hold yet."""
    entries = fixes.select("workspace", F.expr("concat(env_var, '=', literal)").alias("entry"))
    present = files.filter(F.col("path") == template).select(
        "workspace", F.explode(F.expr(split_lines("content"))).alias("entry")).distinct()
    return entries.join(present, ["workspace", "entry"], "left_anti")
