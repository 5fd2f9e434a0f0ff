"""Validation inside detectors: a rejected match lets the next one of its rule in.

Detectors with validation normally give the first accepted line of a rule. Here they give all of them, in order, as candidate
rows with their surroundings; similarity to labelled patterns judges every candidate, and the first valid one of each group
becomes the finding. A group is a rule in a file, or a rule in a line where the rule captures values (D2). Candidates
of a group meet by an aggregation that keeps one row, so a file with many candidates costs no more than their count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from .. import schemas
from ..functions import gates as G
from ..functions.text import lit, near
from .detect import LineRules, LineValues, rows_of, scanned
from .detectors import pieces_for
from .validate import blend_confidence, decide, topk_ensemble, with_heuristic

VALIDATED = ("D2", "D19", "D21", "D22")
#: characters of the surroundings in the text to embed
SHOWN = 200
CANDIDATES = f"array<struct<piece:int,rule:int,ordinal:int,no:int,context:string,hit:{schemas.HITS[len('array<'):-1]}>>"
Embed = Callable[[DataFrame], DataFrame]


def _validated(piece) -> bool:
    """Rules without a judgement of their own: keys in whole files, empty passwords."""
    return isinstance(piece, LineValues) or isinstance(piece, LineRules) and piece.per == "rule"


def candidates(files: DataFrame, ids: tuple[str, ...] = VALIDATED, excluded_names: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(candidates, hits of rules that are not validated), both from one pass over the files' contents.

    A candidate: finding_id, its group (workspace, file, piece, rule, group_line), ordinal, finding_type and text for the
    similarity, context, and the columns of a hit.
    """
    pieces = pieces_for(list(ids), "off")
    every = ", ".join(
        f"coalesce(cast(transform({p.every(f'cand_{k}')}, c -> named_struct('piece', {k}, 'rule', c.rule, 'ordinal', c.ordinal, 'no', c.no, "
        f"'context', {near('c.no', 2, 3)}, 'hit', c.hit)) AS {CANDIDATES}), array())"
        for k, p in enumerate(pieces) if _validated(p))
    whole = "array(" + ", ".join(str(k) for k, p in enumerate(pieces) if isinstance(p, LineValues)) + ")"
    skip = G.excluded_path("split(path, '/')", extra_names=excluded_names)
    scan = scanned(files, pieces, skip, {"candidates": f"CASE WHEN NOT skipped THEN concat({every}) END"},
                   hits=[k for k, p in enumerate(pieces) if not _validated(p)])
    rows = scan.selectExpr("workspace", "path AS file", "inline_outer(candidates)").where("piece IS NOT NULL")
    rows = rows.select("workspace", "file", "piece", "rule", "ordinal", "context", "hit.*",
                       F.expr(f"CASE WHEN array_contains({whole}, piece) THEN no ELSE 0 END").alias("group_line"))
    kind = "CASE WHEN metadata['vulnerability'] = 'xss' THEN 'xss' ELSE type END"
    text = f"concat(finding_type, ': ', snippet, CASE WHEN context != '' THEN concat(' Context: ', substring(context, 1, {SHOWN})) ELSE '' END, ' File: ', file)"
    rows = rows.withColumn("finding_type", F.expr(kind)).withColumn("text", F.expr(text))
    found_id = f"concat_ws({lit(chr(31))}, workspace, file, piece, rule, line, ordinal)"
    return rows.withColumn("finding_id", F.expr(found_id)), rows_of(scan)


def judged(rows: DataFrame, patterns: DataFrame, embed: Embed) -> DataFrame:
    """Candidates with is_valid, ai_confidence and reason. ``embed`` adds ``embedding`` to rows with ``text``."""
    return decide(topk_ensemble(embed(with_heuristic(rows)), patterns))


def first_valid(rows: DataFrame) -> DataFrame:
    """Of each group the first candidate that is not rejected, its confidence blended with that of the judgement."""
    group = ["workspace", "file", "piece", "rule", "group_line"]
    kept = blend_confidence(rows)
    columns = [c for c in kept.columns if c not in group]
    best = kept.groupBy(*group).agg(F.min_by(F.struct(*columns), F.struct("line", "ordinal")).alias("best")).select(*group, "best.*")
    # the severity of captured values follows the blended confidence
    scored = F.expr("metadata['pattern'] = 'code_file_scan'")
    return best.withColumn("severity", F.when(F.coalesce(scored, F.lit(False)), F.when(F.col("confidence") >= 0.8, "high").otherwise("medium")).otherwise(F.col("severity")))


def scan_validated(files: DataFrame, patterns: DataFrame, embed: Embed, ids: tuple[str, ...] = VALIDATED, excluded_names: tuple[str, ...] = ()) -> DataFrame:
    """Raw findings of the validated detectors, as ``scan_files`` gives them, plus the reason of the judgement.

    ``patterns``: (pattern_id, finding_type, is_false_positive, embedding); types are those of findings, and 'xss'.
    """
    rows, plain = candidates(files, ids, excluded_names)
    columns = ["workspace", "detector", "type", "file", "line", "snippet", "severity", "confidence", "metadata"]
    accepted = first_valid(judged(rows, patterns, embed)).select(*columns, "reason")
    return accepted.unionByName(plain.select(*columns, F.lit(None).cast("string").alias("reason")))
