"""Control dimensions as DataFrames and literals. Both are fixed, tens of rows: safe to broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas
from ..functions.text import lit
from ..rules.dimensions import CONTROLS, FINDING_TYPE_CONTROLS


def controls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONTROLS, schemas.CONTROLS)


def finding_type_controls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FINDING_TYPE_CONTROLS, schemas.FINDING_TYPE_CONTROLS)


def select_controls(spark: SparkSession, framework: str | None = None, category: str | None = None,
                    control_type: str | None = None) -> DataFrame:
    """Catalogue rows by any of the three dimension filters."""
    out = controls(spark)
    for column, value in (("framework", framework), ("control_category", category), ("control_type", control_type)):
        if value is not None:
            out = out.filter(out[column] == value)
    return out


def control_pairs(category: str, word: str | None = None) -> list[tuple[str, str]]:
    """(framework, control) of the system controls in a category, optionally mentioning a word."""
    return [
        (c[0], c[1]) for c in CONTROLS
        if c[3] == "system" and c[2] == category and (word is None or word in c[8].lower() or word in c[1].lower())
    ]


def method_case(framework: str, control_id: str) -> str:
    """Verification method of a control as SQL text; null outside the catalogue."""
    whens = " ".join(
        f"WHEN {framework} = {lit(c[0])} AND {control_id} = {lit(c[1])} THEN {lit(c[4])}" for c in CONTROLS)
    return f"CASE {whens} END"
