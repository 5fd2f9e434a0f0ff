"""False-positive scoring: heuristics, similarity to labelled patterns, decision, blending."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import gates as G
from ..functions.text import lit
from ..session import durable

TOP = 3
WEIGHTS = [0.6, 0.3, 0.1]  # fixed value
BLOCK_BYTES = 64 << 20
#: rows of either side whose products are held at a time, 8 MB
TILE = 1 << 10
PIVOTS = 64
PIVOT_BYTES = 64 << 20
#: angles are computed to about 1e-8
SLACK = 1e-6


def with_heuristic(findings: DataFrame, context: str = "context", path: str = "file") -> DataFrame:
    return findings.withColumn("heuristic", F.expr(G.heuristic_score("snippet", context, path)))


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero, so their similarity is zero."""
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _best(mine: np.ndarray, theirs: np.ndarray) -> list[np.ndarray]:
    """The TOP highest products of each row of ``mine`` with rows of ``theirs``, best first, not-a-number last.

    Products are made tile by tile; blocks with many short rows have far more products than components.
    """
    out = []
    for at in range(0, len(mine), TILE):
        rows = mine[at:at + TILE]
        best, here = np.zeros((len(rows), 0)), np.arange(len(rows))
        for start in range(0, len(theirs), TILE):
            scores = np.concatenate([best, rows @ theirs[start:start + TILE].T], axis=1)
            scores[np.isnan(scores)] = -np.inf
            best = np.empty((len(rows), min(TOP, scores.shape[1])))
            for k in range(best.shape[1]):
                top = scores.argmax(axis=1)
                best[:, k], scores[here, top] = scores[here, top], -np.inf
        best[np.isneginf(best)] = np.nan
        out.extend(best)
    return out


def _compare(findings: pd.DataFrame, patterns: pd.DataFrame) -> pd.DataFrame:
    """Best similarities per label class of one block of findings in one block of patterns of their type."""
    out = pd.DataFrame({"finding_id": findings["finding_id"]})
    mine = _unit(np.stack(findings["embedding"].to_list()).astype("float64")) if len(findings) else None
    for column, label in (("fp_top", True), ("real_top", False)):
        rows = patterns[patterns["is_false_positive"].astype(bool) == label]
        if mine is None or not len(rows):
            out[column] = [np.zeros(0)] * len(out)
        else:
            out[column] = _best(mine, _unit(np.stack(rows["embedding"].to_list()).astype("float64")))
    return out


def _angles(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Angles of unit rows to unit centres; a zero row is at a right angle to all, as its similarity of zero says."""
    return np.arccos(np.clip(rows @ centres.T, -1.0, 1.0))


def pivots(patterns: DataFrame, count: int) -> dict[str, np.ndarray]:
    """Up to ``count`` patterns of each type, those with the smallest hashes of their ids, as unit rows."""
    order = Window.partitionBy("finding_type").orderBy(F.xxhash64("pattern_id"), "pattern_id")
    first = (
        patterns.select("finding_type", "pattern_id").withColumn("r", F.row_number().over(order)).where(F.col("r") <= count)
        .join(patterns.select("finding_type", "pattern_id", "embedding"), ["finding_type", "pattern_id"]).select("finding_type", "r", "embedding")
    )
    by_type: dict[str, list] = {}
    for kind, _, embedding in sorted(map(tuple, first.collect()), key=lambda r: r[:2]):
        by_type.setdefault(kind, []).append(embedding)
    return {kind: _unit(np.array(rows, "float64")) for kind, rows in by_type.items()}


def _placed(rows: DataFrame, centres: dict[str, np.ndarray]) -> DataFrame:
    """Rows with the number of their type's nearest pivot and the angle to it."""
    def place(batches):
        for batch in batches:
            batch = batch[batch["finding_type"].isin(list(centres))].reset_index(drop=True)
            batch["pivot"], batch["angle"] = 0, 0.0
            for kind, at in batch.groupby("finding_type").groups.items():
                angles = _angles(_unit(np.stack(batch.loc[at, "embedding"].to_list()).astype("float64")), centres[kind])
                batch.loc[at, "pivot"], batch.loc[at, "angle"] = angles.argmin(axis=1), angles.min(axis=1)
            yield batch.astype({"pivot": "int32"})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(place, f"{fields}, pivot int, angle double")


def pivot_pairs(findings: DataFrame, patterns: DataFrame, centres: dict[str, np.ndarray], block_bytes: int) -> DataFrame:
    """All pairs of blocks of placed findings and patterns per label class, and whether one has to be compared (``kept``).

    By the triangle inequality the angle of a finding and a pattern lies within the two radii of the angle of their
    pivots. Three patterns of some blocks are certain to reach a similarity; a block whose best cannot reach it is left out.
    """
    def blocks(df: DataFrame, *more: str) -> DataFrame:
        size = F.sum(F.size("embedding").cast("long")) * 8
        return df.groupBy("finding_type", F.col("pivot"), *more).agg(
            F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n"), F.greatest(F.lit(1), F.ceil(size / block_bytes)).alias("subs"))

    apart = pd.DataFrame([(kind, i, j, float(a)) for kind, rows in centres.items() for i, line in enumerate(_angles(rows, rows)) for j, a in enumerate(line)],
                         columns=["finding_type", "f_pivot", "p_pivot", "apart"])
    between = findings.sparkSession.createDataFrame(apart, "finding_type STRING, f_pivot INT, p_pivot INT, apart DOUBLE")
    mine = blocks(findings).selectExpr("finding_type", "pivot AS f_pivot", "radius AS f_radius", "subs AS f_subs")
    theirs = blocks(patterns, "is_fp").selectExpr("finding_type", "pivot AS p_pivot", "is_fp", "radius AS p_radius", "n", "subs AS p_subs")
    seen = Window.partitionBy("finding_type", "f_pivot", "is_fp")
    return (
        between.join(mine, ["finding_type", "f_pivot"]).join(theirs, ["finding_type", "p_pivot"])
        .withColumn("same", F.expr("IF(f_pivot = p_pivot, 0D, apart)"))
        .withColumn("certain", F.expr(f"cos(least(pi(), same + f_radius + p_radius + {SLACK}D))"))
        .withColumn("best", F.expr(f"cos(greatest(0D, same - f_radius - p_radius - {SLACK}D))"))
        .withColumn("reached", F.sum("n").over(seen.orderBy(F.desc("certain"), "p_pivot")))
        .withColumn("third", F.max(F.expr(f"CASE WHEN reached >= {TOP} THEN certain END")).over(seen))
        .select("finding_type", "f_pivot", "f_subs", "p_pivot", "p_subs", "is_fp", F.expr("coalesce(best >= third, true)").alias("kept"))
    )


def _compare_class(findings: pd.DataFrame, patterns: pd.DataFrame) -> pd.DataFrame:
    """Best similarities of one block of findings in one block of patterns of one label class."""
    if not len(findings) or not len(patterns):
        return pd.DataFrame({"finding_id": [], "is_fp": [], "top": []})
    mine, theirs = (_unit(np.stack(t["embedding"].to_list()).astype("float64")) for t in (findings, patterns))
    return pd.DataFrame({"finding_id": findings["finding_id"], "is_fp": bool(patterns["is_fp"].iloc[0]), "top": _best(mine, theirs)})


def _topk_pruned(findings: DataFrame, patterns: DataFrame, count: int, block_bytes: int) -> DataFrame:
    """(finding_id, fp_top, real_top) by way of pivots."""
    centres = pivots(patterns.where("embedding IS NOT NULL"), count)
    left = durable(_placed(findings.select("finding_id", "finding_type", "embedding").where("embedding IS NOT NULL"), centres))
    right = durable(_placed(patterns.selectExpr("pattern_id", "finding_type", "coalesce(is_false_positive, false) AS is_fp", "embedding").where("embedding IS NOT NULL"), centres))
    pairs = durable(pivot_pairs(left, right, centres, block_bytes).where("kept"))
    keys = ["finding_type", "f_pivot", "p_pivot", "is_fp", "f_sub", "p_sub"]
    f_rows = (
        left.withColumnRenamed("pivot", "f_pivot").join(pairs, ["finding_type", "f_pivot"])
        .withColumn("f_sub", F.expr("pmod(xxhash64(finding_id), f_subs)")).withColumn("p_sub", F.explode(F.expr("sequence(0L, p_subs - 1)")))
        .select(*keys, "finding_id", "embedding")
    )
    p_rows = (
        right.withColumnRenamed("pivot", "p_pivot").join(pairs, ["finding_type", "p_pivot", "is_fp"])
        .withColumn("p_sub", F.expr("pmod(xxhash64(pattern_id), p_subs)")).withColumn("f_sub", F.explode(F.expr("sequence(0L, f_subs - 1)")))
        .select(*keys, "embedding")
    )
    kind = findings.schema["finding_id"].dataType.simpleString()
    best = lambda flag: F.expr(
        f"slice(sort_array(flatten(collect_list(CASE WHEN {flag} THEN top END)), false), 1, {TOP})")
    return (
        f_rows.toDF(*f_rows.columns).groupBy(*keys).cogroup(p_rows.toDF(*p_rows.columns).groupBy(*keys)).applyInPandas(_compare_class, f"finding_id {kind}, is_fp boolean, top array<double>")
        .groupBy("finding_id").agg(best("is_fp").alias("fp_top"), best("NOT is_fp").alias("real_top"))
    )


def pivot_count(patterns: DataFrame, block_bytes: int) -> int:
    """Four pivots for each block of the largest type, ``PIVOTS`` at most; one where a type is one block, or where the
    pivots of all types would not fit ``PIVOT_BYTES``."""
    size = F.size("embedding").cast("long") * 8
    by_type = patterns.where("embedding IS NOT NULL").groupBy("finding_type").agg(F.sum(size).alias("bytes"), F.max(size).alias("row"))
    most, row, types = by_type.agg(F.max("bytes"), F.max("row"), F.count(F.lit(1))).first()
    if not most or most <= block_bytes:
        return 1
    return max(1, min(PIVOTS, 4 * -(-most // block_bytes), PIVOT_BYTES // (row * types)))


def topk(findings: DataFrame, patterns: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Three best similarities per label class among patterns of the finding's type.

    findings: (finding_id, finding_type, embedding), ids unique; patterns: (pattern_id, finding_type,
    is_false_positive, embedding). Both sides of a type are cut into blocks of a bounded size, and pairs of blocks
    are compared in tasks: a type with a third of all rows is many tasks, and any library size gives the exact
    result. Where the patterns of a type are several blocks, blocks are the neighbourhoods of pivots, and pairs that
    cannot hold one of the three best are left out (``pivot_pairs``). The best three of each block are merged per finding.
    """
    count = pivot_count(patterns, block_bytes)
    top = _topk_pruned(findings, patterns, count, block_bytes) if count > 1 else _topk_all(findings, patterns, block_bytes)
    none = F.array().cast("array<double>")
    kept = findings.drop("fp_top", "real_top")
    return kept.join(top, "finding_id", "left").withColumns({c: F.coalesce(c, none) for c in ("fp_top", "real_top")}).select(*kept.columns, "fp_top", "real_top")


def _topk_all(findings: DataFrame, patterns: DataFrame, block_bytes: int) -> DataFrame:
    """(finding_id, fp_top, real_top) from all pairs of blocks."""
    def blocks(df: DataFrame, name: str) -> DataFrame:
        size = F.coalesce(F.sum(F.size("embedding").cast("long")), F.lit(0)) * 8
        return df.groupBy("finding_type").agg(F.greatest(F.lit(1), F.ceil(size / block_bytes)).alias(name))

    def sizes() -> DataFrame:  # new columns for each side, or their join would be ambiguous
        both = blocks(findings, "mine").join(blocks(patterns, "theirs"), "finding_type")
        return both.toDF(*both.columns)

    keys = ["finding_type", "f_block", "p_block"]
    left = (
        findings.select("finding_id", "finding_type", "embedding").join(sizes(), "finding_type")
        .withColumn("f_block", F.expr("pmod(xxhash64(finding_id), mine)")).withColumn("p_block", F.explode(F.expr("sequence(0L, theirs - 1)")))
        .select(*keys, "finding_id", "embedding")
    )
    right = (
        patterns.select("pattern_id", "finding_type", "is_false_positive", "embedding").join(sizes(), "finding_type")
        .withColumn("p_block", F.expr("pmod(xxhash64(pattern_id), theirs)")).withColumn("f_block", F.explode(F.expr("sequence(0L, mine - 1)")))
        .select(*keys, "is_false_positive", "embedding")
    )
    kind = findings.schema["finding_id"].dataType.simpleString()
    return (
        left.toDF(*left.columns).groupBy(*keys).cogroup(right.toDF(*right.columns).groupBy(*keys))
        .applyInPandas(_compare, f"finding_id {kind}, fp_top array<double>, real_top array<double>")
        .groupBy("finding_id").agg(*(F.expr(f"slice(sort_array(flatten(collect_list({c})), false), 1, {TOP})").alias(c) for c in ("fp_top", "real_top")))
    )


def topk_ensemble(findings: DataFrame, patterns: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Weighted ensemble and best similarity per class; fewer than three are not re-weighted."""
    top = topk(findings, patterns, block_bytes)
    weights = "array(" + ", ".join(f"{w}D" for w in WEIGHTS) + ")"

    def total(c: str) -> str:
        return f"aggregate(zip_with({c}, slice({weights}, 1, size({c})), (s, w) -> s * w), 0D, (a, x) -> a + x)"

    return top.withColumns({
        "fp_ensemble": F.expr(total("fp_top")),
        "real_ensemble": F.expr(total("real_top")),
        "fp_best": F.expr("coalesce(get(fp_top, 0), 0D)"),
        "real_best": F.expr("coalesce(get(real_top, 0), 0D)"),
        "fp_weight": F.expr("CASE WHEN size(fp_top) >= 2 THEN (fp_top[0] + fp_top[1]) / 2 ELSE coalesce(get(fp_top, 0), 0D) END"),
        "real_weight": F.expr(
            "CASE WHEN size(real_top) >= 2 THEN (real_top[0] + real_top[1]) / 2 ELSE coalesce(get(real_top, 0), 0D) END"),
        "both_classes": F.expr("size(fp_top) > 0 AND size(real_top) > 0"),
    }).drop("fp_top", "real_top", "embedding")


# (condition, valid, confidence, reason, its scores), first match wins; texts of reasons are fixed values
LADDER = [
    ("fp_ensemble > 0.85D OR fp_best > 0.88D", "false", "greatest(0.05D, 1D - greatest(fp_ensemble, fp_best))",
     "Very similar to known false positive (ensemble: %.2f, best: %.2f)", ("fp_ensemble", "fp_best")),
    ("real_ensemble > 0.75D OR real_best > 0.80D", "true",
     "least(0.98D, greatest(real_ensemble, real_best) * 0.65D + heuristic * 0.35D)",
     "Very similar to known real issue (ensemble: %.2f, best: %.2f)", ("real_ensemble", "real_best")),
    ("(fp_ensemble > 0.70D OR fp_best > 0.75D) AND fp_ensemble > 0.78D", "false", "0.3D",
     "Ensemble indicates false positive (ensemble: %.2f)", ("fp_ensemble",)),
    ("fp_ensemble > 0.70D OR fp_best > 0.75D", "true", "0.5D",
     "Moderately similar to false positive (ensemble: %.2f), lower confidence", ("fp_ensemble",)),
    ("real_ensemble > 0.65D OR real_best > 0.70D", "true",
     "least(0.90D, greatest(real_ensemble, real_best) * 0.55D + heuristic * 0.45D)",
     "Moderately similar to known real issue (ensemble: %.2f, best: %.2f)", ("real_ensemble", "real_best")),
    ("both_classes AND real_weight > fp_weight + 0.15D", "true", "least(0.85D, real_weight * 0.6D + heuristic * 0.4D)",
     "Ensemble favors real issue (real: %.2f vs FP: %.2f)", ("real_weight", "fp_weight")),
    ("both_classes AND fp_weight > real_weight + 0.15D", "false", "0.4D",
     "Ensemble favors false positive (FP: %.2f vs real: %.2f)", ("fp_weight", "real_weight")),
    ("heuristic > 0.75D", "true", "least(0.90D, heuristic + 0.1D)", "Strong heuristic analysis indicates real issue", ()),
    ("heuristic < 0.25D", "false", "greatest(0.1D, 1D - heuristic)", "Strong heuristic analysis indicates false positive", ()),
    ("heuristic > 0.6D", "true", "heuristic", "Heuristic analysis indicates real issue", ()),
    ("heuristic < 0.4D", "false", "1D - heuristic", "Heuristic analysis indicates false positive", ()),
    ("true", "true", "CASE WHEN real_ensemble > fp_ensemble THEN 0.70D WHEN fp_ensemble > real_ensemble THEN 0.60D ELSE 0.65D END",
     "No strong match (FP ensemble: %.2f, Real ensemble: %.2f)", ("fp_ensemble", "real_ensemble")),
]


def decide(scores: DataFrame) -> DataFrame:
    """Decision columns (is_valid, ai_confidence, reason) from the scores and the heuristic; the reason shows its scores."""
    def ladder(show) -> str:
        return "CASE " + " ".join(f"WHEN {s[0]} THEN {show(s)}" for s in LADDER) + " END"

    reason = ladder(lambda s: f"format_string({', '.join([lit(s[3]), *s[4]])})" if s[4] else lit(s[3]))
    return scores.withColumns({
        "is_valid": F.expr(ladder(lambda s: s[1])), "ai_confidence": F.expr(f"cast({ladder(lambda s: s[2])} AS double)"), "reason": F.expr(reason)})


def blend_confidence(findings: DataFrame, xss: str = "metadata['vulnerability'] = 'xss'") -> DataFrame:
    """Drop findings judged invalid and average the two confidences; script injection is judged more mildly."""
    return (
        findings.withColumn("mild", F.expr(f"coalesce({xss}, false)"))
        .filter("CASE WHEN mild THEN is_valid OR ai_confidence >= 0.3D ELSE is_valid END")
        .withColumn("confidence", F.expr(
            "CASE WHEN NOT mild THEN (confidence + ai_confidence) / 2D "
            "WHEN is_valid AND ai_confidence > 0.7D THEN least(0.95D, (confidence + ai_confidence) / 2D) "
            "ELSE confidence END"))
        .drop("mild")
    )
