"""Validation inside detectors: rejected matches let the next one in."""

import math

import pytest
from pyspark.sql import functions as F

from auditlake.operators import detectors as D, ensemble as EN

FP, REAL, MILD, FAR = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.6, 0.0, 0.8, 0.0], [0.0, 0.0, 0.0, 1.0]
TYPES = ["hardcoded_secret", "weak_authentication", "command_injection", "xss"]


@pytest.fixture(scope="module")
def patterns(spark):
    rows = [(f"{t}{fp}{i}", t, fp, FP if fp else REAL) for t in TYPES for fp in (True, False) for i in range(3)]
    return spark.createDataFrame(rows, "pattern_id STRING, finding_type STRING, is_false_positive BOOLEAN, embedding ARRAY<DOUBLE>")


def embed(rows):
    """False positives say so in their line, real ones too; all others resemble nothing."""
    array = lambda v: F.array(*map(F.lit, v))
    return rows.withColumn("embedding", F.when(F.col("snippet").contains("harmless"), array(FP)).when(F.col("snippet").contains("unclear"), array(MILD))
                           .when(F.col("snippet").contains("serious"), array(REAL)).otherwise(array(FAR)))


def scan(files, patterns, *ids):
    return sorted({(r.file, r.detector, r.line) for r in EN.scan_validated(files, patterns, embed, ids).collect()})


def test_second_line_of_a_rule_gets_in(files_of, patterns):
    files = files_of(("a.py", "os.system(harmless)\nx = 1\nos.system(serious)\nos.system(serious2)"), ("b.py", "os.system(harmless)\nos.system(harmless2)"),
                     ("c.py", "os.system(serious)\nos.system(harmless)"))
    assert scan(files, patterns, "D21") == [("a.py", "D21", 3), ("c.py", "D21", 1)]
    assert {("a.py", 1), ("b.py", 1), ("c.py", 1)} == {(r.file, r.line) for r in D.scan_files(files, ["D21"]).collect()}


def test_rules_of_a_file_are_judged_apart(files_of, patterns):
    files = files_of(("a.py", "os.system(harmless)\nsubprocess.run(serious, shell=True)\nos.system(serious)"))
    assert scan(files, patterns, "D21") == [("a.py", "D21", 2), ("a.py", "D21", 3)]


def test_confidence_and_reason(files_of, patterns):
    files = files_of(("a.py", "os.system(serious)"), ("test_b.py", "os.system(serious)"), ("c.py", "os.system(unclear)"))
    got = {r.file: (r.confidence, r.reason) for r in EN.scan_validated(files, patterns, embed, ("D21",)).collect()}
    rows, _ = EN.candidates(files, ("D21",))
    judged = {r.file: r for r in EN.judged(rows, patterns, embed).collect()}
    assert got["a.py"][0] == (0.9 + judged["a.py"].ai_confidence) / 2 and got["test_b.py"][0] == (0.6 + judged["test_b.py"].ai_confidence) / 2
    assert judged["a.py"].ai_confidence == min(0.98, 0.65 + judged["a.py"].heuristic * 0.35)
    assert got["a.py"][1] == "Very similar to known real issue (ensemble: 1.00, best: 1.00)"
    assert math.isclose(judged["c.py"].fp_ensemble, 0.6)


def test_script_injection_is_judged_more_mildly(files_of, patterns):
    files = files_of(("a.js", "box.innerHTML = harmless"), ("b.js", "box.innerHTML = serious"), ("c.js", "box.innerHTML = payload"))
    got = {r.file: r.confidence for r in EN.scan_validated(files, patterns, embed, ("D22",)).collect()}
    assert set(got) == {"b.js", "c.js"} and got["c.js"] == 0.85 and got["b.js"] != 0.85


def test_values_and_rules_without_judgement(files_of, patterns):
    files = files_of(("a.js", "var password = 'harmlessvalue1'; var token = 'tok1tok1tok1'\nvar secret = 'seriousvalue22'\nlet pwd = \"\"\n"),
                     ("node_modules/b.js", "var secret = 'seriousvalue22'"))
    plain = {(r.line, r.severity) for r in D.scan_files(files, ["D2"]).collect()}
    got = [(r.line, r.severity, r.reason) for r in EN.scan_validated(files, patterns, embed, ("D2",)).collect()]
    assert {1, 2, 3} <= {line for line, _ in plain}
    assert {line for line, _, _ in got} == {2, 3}
    assert all((reason is None) == (line == 3) for line, _, reason in got)


def test_candidates_are_numbered_in_order(files_of):
    files = files_of(("a.js", "var password = 'firstvalue1', password = 'secondvalue2'"), ("e.js", None), ("f.js", ""))
    rows, plain = EN.candidates(files, ("D2",))
    seen = [(r.rule, r.line, r.ordinal, r.severity) for r in rows.orderBy("rule", "line", "ordinal").collect()]
    assert len(seen) == len({x[:3] for x in seen}) and {x[2] for x in seen} >= {0, 1}
    assert rows.select("finding_id").distinct().count() == len(seen) and plain.count() == 0
