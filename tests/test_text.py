"""Text helpers against Python's own functions."""

import json
import re

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from auditlake.functions import text as T
from auditlake.operators.finalize import json_string
from auditlake.plans.corpus import SEEDS
from auditlake.rules import code as C, practice as P, secrets as S

TEXTS = [
    "", "\n", "a", "a\n", "a\n\n", "\na", "a\r\nb\rc", "x\x0by\x0cz", "a\x1cb\x1dc\x1ed", "a\x85b c ",
    "tail\r\n", "  pad \t　", "﻿q", "é é \U0001f600 \"q\" \\ \x01\x7f", "$5 ${x} 'it'", " \x1f s \x1f",
]


def test_split_lines_is_splitlines(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t STRING")
    for row in df.selectExpr("t", f"{T.split_lines('t')} AS lines").collect():
        assert row.lines == row.t.splitlines()


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n\r\x0b\x0c\x1c\x85 ", max_size=12), min_size=1, max_size=30))
def test_split_lines_property(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    for row in df.selectExpr("t", f"{T.split_lines('t')} AS lines").collect():
        assert row.lines == row.t.splitlines()


def test_strip_and_literals(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t STRING")
    for row in df.selectExpr("t", f"{T.strip('t')} AS s").collect():
        assert row.s == row.t.strip()
    for t in TEXTS:
        assert spark.range(1).selectExpr(f"{T.lit(t)} AS v").first().v == t


def test_json_string_is_ascii_json(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t STRING")
    for row in df.selectExpr("t", f"{json_string('t')} AS j").collect():
        assert row.j == json.dumps(row.t)


def test_near_matches_slices(spark):
    lines = [str(i) for i in range(1, 31)]
    df = spark.createDataFrame([(lines, n) for n in range(1, 31)], "lines ARRAY<STRING>, no INT")
    for before, after in ((9, 10), (4, 5), (2, 3)):
        for row in df.selectExpr("no", f"{T.near('no', before, after)} AS t").collect():
            width = after
            assert row.t == "\n".join(lines[max(0, row.no - width):min(len(lines), row.no + width)])


def test_match_lines_matches_finditer(spark):
    texts = ["a1\nb2 b3\n\nc\n4", "x", "1\n2\n3", "\x01 9\n8\x01"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    for row in df.selectExpr("t", f"{T.match_lines('t', r'[a-z]?' + chr(92) + 's*' + chr(92) + 'd')} AS m").collect():
        text = row.t.replace("\x01", "\x02")
        want = [(m.group(0), text[:m.start()].count("\n") + 1) for m in re.finditer(r"[a-z]?\s*\d", text, re.I)]
        assert [(m.match, m.line_no) for m in row.m] == want


def all_rules():
    for module in (C, S, P):
        for name, value in vars(module).items():
            if not name.isupper():
                continue
            groups = value.values() if isinstance(value, dict) else [value]
            for group in groups:
                for item in ([group] if isinstance(group, str) else group):
                    pattern = item if isinstance(item, str) else item[0]
                    if re.search(r"[\\\[(]", pattern):
                        yield pattern


def test_every_rule_agrees_with_python(spark):
    """Each rule on every seed line: the JVM dialect finds what ``re`` finds, and the literals are implied."""
    patterns = sorted(set(all_rules()))
    assert len(patterns) > 300
    lines = sorted({line for seed in SEEDS for line in seed.head.splitlines()})
    lines += [line.swapcase() for line in lines] + [f"é {line} éé" for line in lines]
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "i INT, line STRING").repartition(4).cache()
    hits = 0
    for start in range(0, len(patterns), 60):
        part = patterns[start:start + 60]
        rows = df.select("i", F.expr("array(" + ", ".join(T.rlike("line", p) for p in part) + ")").alias("hit")).collect()
        for row in rows:
            for pattern, found in zip(part, row.hit):
                assert found == bool(re.search(pattern, lines[row.i], re.I)), (pattern, lines[row.i])
                if found:
                    hits += 1
                    needed = T.required_literals(pattern)
                    assert needed is None or any(n in lines[row.i].lower() for n in needed), (pattern, lines[row.i])
    assert hits > 500


def test_a_match_holds_the_punctuation_its_pattern_needs():
    import re
    from auditlake.functions.text import ODD_CASE, required_marks
    from auditlake.operators.detect import FILE_COLUMNS, LineRules, LineValues, line_match
    from auditlake.operators.detectors import BUILDERS, pieces_for
    from auditlake.plans.corpus import SEEDS

    assert required_marks(r"pass\s*[:=]\s*['\"]([^'\"]{3,})['\"]") == [[":", "="], ['"', "'"]]
    assert required_marks(r"(?:a\(|b)x?(c\.)+[^=]=*") == [["."]]
    lines = [line for seed in SEEDS for line in seed.head.split("\n")]
    pieces = [p for p in pieces_for(list(BUILDERS), "disabled") if isinstance(p, (LineRules, LineValues))]
    patterns = {r for p in pieces for r in ([r for r, _ in p.rules] if isinstance(p, LineRules) else p.patterns)}
    seen = 0
    for pattern in patterns:
        for line in lines:
            if re.search(pattern, line, re.IGNORECASE):
                seen += 1
                assert all(any(mark in line for mark in marks) for marks in required_marks(pattern)), (pattern, line)
    assert seen > 100
    assert line_match([r"pass\s*="]).startswith("((((contains(lines[no - 1], '='))) AND ")
    # no pattern over whole contents goes before the literals
    assert "RLIKE" not in FILE_COLUMNS["odd_case"] and len(ODD_CASE) == 4


def test_the_condition_of_a_file_rule_is_nested():
    """Spark computes beforehand what conditions joined by AND have in common; a pattern over whole contents must not be among it."""
    from auditlake.operators.detect import FileRule

    assert FileRule("f", "t", "r").hits("") == "CASE WHEN f THEN CASE WHEN t THEN array(r) END END"
