"""Assignments to secret-like names: literals first, patterns once."""

import os

import pytest

from auditlake.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("key", ["b11_is_placeholder_value", "b12_adjust_confidence", "v1_heuristic_score"])
def test_conditions_do_not_evaluate_patterns_again(spark, key):
    plan = Q.QUERIES[key](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("|passwd|pwd|") <= 3  # the line's test, name and value
    # literals of the file, then of the line, go first; the score of v1 has two tests of its own
    assert plan.count(", credential)") == (4 if key.startswith("v1_") else 2)


def test_odd_case_and_every_literal(spark, monkeypatch):
    kinds = ["password", "PASSWD", "pwd", "api-key", "apikey", "Token", "secret", "auth_token", "credential", "toKen", "paſſword"]
    lines = [f"x{k} = 'v{i}'" for i, k in enumerate(kinds)] + ["plain = 'v'"]
    files = spark.createDataFrame([("w", f"f{i}.py", f"f{i}.py", ".py", f"a\n{line}") for i, line in enumerate(lines)], "workspace STRING, path STRING, name STRING, ext STRING, content STRING")
    monkeypatch.setattr(Q, "corpus", lambda *_: files)
    got = Q.assignments(spark, "", ("near3",)).select("path", "line_no", "clean", "near3").collect()
    assert sorted(map(tuple, got)) == sorted((f"f{i}.py", 2, f"v{i}", f"a\n{lines[i]}") for i in range(len(kinds)))
