"""The literal prefilter and the one-pass scan."""

import random

import pytest
from pyspark.sql import functions as F

from auditlake.functions import prefilter as PF
from auditlake.operators import detect as DE, detectors as D, ignore as IG, practice as PR
from auditlake.plans import scan as SC
from auditlake.plans.corpus import HEX40, corpus

SF = "/root/testdata/sf0.001"


def test_automaton_finds_what_contains_finds():
    rng = random.Random(1)
    for _ in range(30):
        groups = tuple(tuple(sorted({"".join(rng.choice("abé{") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 6))})) for _ in range(rng.choice([3, 62, 63, 64, 130])))
        for _ in range(10):
            text = "".join(rng.choice("abé{x") for _ in range(rng.randrange(0, 60)))
            words = PF.words_of(groups, text)
            assert all(0 <= w < 1 << PF.WORD for w in words)
            for at, group in enumerate(groups):
                assert words[at // PF.WORD] >> at % PF.WORD & 1 == int(any(x in text for x in group))
    assert PF.words_of((("a",),), None) == [0] and PF.words_of((("a",),), "") == [0]


def test_tokens_resolve_alike(spark):
    asked = [[f"w{i}x", f"v{i}"] for i in range(70)]
    sql = [f"({PF.mark(g)} AND NOT {PF.mark(asked[0])})" for g in asked]
    texts = spark.createDataFrame([("w3x v9",), ("",), (None,), ("w0x w5x",), ("v69 w69",)], "lc STRING")
    plain, automatic = PF.Answers(sql, many=10_000), PF.Answers(sql, many=1)
    assert not plain.automatic and automatic.automatic
    found = texts.withColumn("literals_found", automatic.column(F.col("lc")))
    for s in sql:
        assert [bool(r[0]) for r in texts.select(F.expr(plain.sql(s))).collect()] == [r[0] for r in found.select(F.expr(automatic.sql(s))).collect()]
    some = {int(PF.TOKEN.search(s)[1]) for s in sql[3:10]}
    assert [bool(r[0]) for r in texts.select(F.expr(plain.any_of(some))).collect()] == [r[0] for r in found.select(F.expr(automatic.any_of(some))).collect()]


def test_hits_do_not_depend_on_the_prefilter(spark):
    files = D.not_excluded(corpus(spark, SF)).where("ext IN ('.py', '.js', '.tf', '.yaml', '.html', '.java', '.md')")
    odd = files.limit(40).withColumn("content", F.concat(F.lit("ſK\n"), "content"))
    pieces = D.pieces_for(["D1", "D2", "D8", "D9", "D11", "D13", "D16", "D18", "D20", "D22", "D25", "D26", "D36"])
    more = {"flags": PR.file_bits()}
    shown = [sorted(str(r) for r in DE.scanned(files.union(odd), pieces, "name LIKE '%test%'", more, many=many).collect()) for many in (1, 100_000)]
    assert shown[0] == shown[1] and any("hardcoded_secret" in r for r in shown[0])


def test_lines_are_cut_only_where_a_rule_can_match(files_of):
    files = files_of(("a.py", "x = 1\ny = 2"), ("b.py", "os.system(cmd)"), ("c.txt", "os.system(cmd)"), ("ſ.py", "x = 'ſ'"))
    pieces = D.pieces_for(["D21", "D37"])
    needed = lambda p, many: DE.lines_needed(p, PF.Answers([x.candidates() for x in p], many))
    staged = files.withColumns({n: F.expr(s) for n, s in DE.FILE_COLUMNS.items()})
    assert {r.path for r in staged.where(needed(pieces, 10_000)).collect()} == {"b.py", "ſ.py"}


def reads(df):
    """Files relations in the plan."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum("HadoopFsRelation" in leaves.apply(i).toString() or "Relation [" in leaves.apply(i).toString() for i in range(leaves.size()))


@pytest.fixture
def tree(spark, files_of, tmp_path):
    rows = [("a", "README.md", "A security scanner"), ("a", ".scanignore", "gone/\n# c\n*.skip\n"), ("a", "src/x.py", f"api_token = '{HEX40}'\nos.system(c)"),
            ("a", "gone/y.py", "os.system(c)"), ("b", "main.py", "import os\nos.system(c)"), ("b", "package.json", "{}"), ("b", "z.skip", "x"), ("b", "empty.py", None),
            ("c", "main.py", "import consent_lib\nx = hashlib.md5(y)"), ("c", "node_modules/q.js", "eval(x)")]
    files_of(*rows).write.parquet(str(tmp_path / "files"))
    return spark.read.parquet(str(tmp_path / "files"))


def test_contents_are_read_twice_at_most(tree, monkeypatch):
    counted = []
    keep = SC.durable

    def counting(df):
        counted.append(reads(df))
        return keep(df)

    monkeypatch.setattr(SC, "durable", counting)
    found = SC.scan_workspaces(tree, True)
    assert reads(tree) == 1  # the counter sees files
    assert sum(counted) + reads(found) <= 2
    assert found.count() > 0


def test_one_pass_equals_single_scans(tree):
    key = ["workspace", "detector", "type", "file", "line", "snippet", "severity", "confidence"]
    for ignore in (False, True):
        kept = IG.apply_ignore(tree, IG.ignore_patterns(tree)) if ignore else tree
        single = D.scan_files(kept, tools=D.security_tools(tree)).unionByName(PR.missing_locks(tree)).unionByName(PR.practice_gaps(tree))
        assert sorted(map(str, SC.scan_workspaces(tree, ignore).select(key).collect())) == sorted(map(str, single.select(key).collect()))
    given = IG.ignore_patterns(tree)
    assert sorted(map(str, SC.scan_workspaces(tree, given).select(key).collect())) == sorted(map(str, SC.scan_workspaces(tree, True).select(key).collect()))
