"""Order, ids, hashes, roots, metrics."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from auditlake import schemas
from auditlake.operators import finalize as FN
from auditlake.operators.detectors import scan_files
from auditlake.rules.dimensions import CONTROLS, FINDING_TYPE_CONTROLS


def root(leaves):
    nodes = [bytes.fromhex(x) for x in leaves]
    if not nodes:
        return hashlib.sha256(b"").hexdigest()
    while len(nodes) > 1:
        nodes += nodes[-1:] * (len(nodes) % 2)
        nodes = [hashlib.sha256(a + b).digest() for a, b in zip(nodes[::2], nodes[1::2])]
    return nodes[0].hex()


def leaf(i):
    return hashlib.sha256(str(i).encode()).hexdigest()


def raw(spark, rows):
    return spark.createDataFrame(rows, schemas.RAW_FINDINGS)


def finding(ws, file, line, kind="hardcoded_secret", snippet="s", severity="high", confidence=0.9):
    return (ws, "D0", kind, file, line, snippet, severity, confidence, {})


@pytest.mark.parametrize("fan", [1, 2, 3, 10])
def test_merkle_in_chunks_equals_the_plain_tree(spark, fan):
    sizes = [1, 2, 3, 5, 7, 8, 9, 16, 17, 31, 33, 64, 65, 100]
    rows = [(str(n), i + 1, leaf(i)) for n in sizes for i in range(n)]
    df = spark.createDataFrame(rows, "g STRING, position BIGINT, evidence_hash STRING").repartition(5)
    got = {r.g: r.merkle_root for r in FN.merkle_root(df, ["g"], fan=fan).collect()}
    assert got == {str(n): root([leaf(i) for i in range(n)]) for n in sizes}


def test_workspace_without_findings_has_the_empty_root(spark):
    found = FN.evidence_hash(FN.assign_ids(raw(spark, [finding("a", "f", 1)])))
    got = {r.workspace: r.merkle_root for r in FN.merkle_roots(found, spark.createDataFrame([("a",), ("b",)], "workspace STRING")).collect()}
    assert got["b"] == hashlib.sha256(b"").hexdigest() and got["a"] == found.first().evidence_hash


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_ids_over_one_hot_workspace(spark, partitions):
    random.seed(7)
    rows = [finding("hot", f"f{i % 300:04d}", random.choice([None, 0, 5, 12]), snippet=f"s{i}") for i in range(1001)]
    rows += [finding("cold", "f", None), finding("cold", "f", 0), finding("cold", "a", 9)]
    random.shuffle(rows)
    got = FN.assign_ids(raw(spark, rows).repartition(partitions)).collect()
    for ws in ("hot", "cold"):
        want = sorted((r for r in rows if r[0] == ws), key=lambda r: (r[3], -1 if r[4] is None else r[4], r[2], r[5]))
        have = sorted((r for r in got if r.workspace == ws), key=lambda r: r.position)
        assert [(r.file, r.line, r.snippet) for r in have] == [(w[3], w[4], w[5]) for w in want]
        assert [r.id for r in have] == [f"F{i:03d}" for i in range(1, len(want) + 1)]


def test_evidence_hash_is_the_canonical_json(spark):
    rows = [finding("w", "a.py", 3, snippet='x = "é\\\t"', confidence=0.85 * 0.8 - 0.2), finding("w", "b.py", None, confidence=0.675)]
    for r in FN.evidence_hash(raw(spark, rows)).collect():
        payload = {k: r[k] for k in ("type", "file", "line", "snippet", "severity", "confidence")}
        text = json.dumps(payload, sort_keys=True, separators=(",", ":"))
        assert r.evidence_hash == hashlib.sha256(text.encode()).hexdigest()


def test_unmapped_types(spark):
    row = FN.enrich_controls(raw(spark, [finding("w", "a", 1, "command_injection")])).first()
    assert (row.control_id, row.compliance_frameworks_affected, row.control_state) == ("UNKNOWN", [], None)
    assert row.control_pass_fail_status == "FAIL" and row.required_evidence_missing == "Unknown evidence requirement"


def test_dimensions_are_complete():
    assert len(CONTROLS) == 21 and len(FINDING_TYPE_CONTROLS) == 24
    assert len({c[:2] for c in CONTROLS}) == 21 and len({f[0] for f in FINDING_TYPE_CONTROLS}) == 24


def test_risk_is_capped(spark):
    rows = [finding("w", "a", i, severity="critical") for i in range(4)] + [finding("v", "a", 1, severity="low")]
    got = {r.workspace: r for r in FN.severity_metrics(raw(spark, rows)).collect()}
    assert got["w"].risk_score == 100 and got["w"].critical == 4 and got["v"].risk_score == 5


def reports(spark, hashes, declared):
    finding = F.expr(f"cast(transform(h, (x, i) -> named_struct('id', concat('F', i), 'type', 't', 'file', 'f', 'line', i, 'snippet', '', 'severity', 'low', 'confidence', 0.5D, 'evidence_hash', x, 'compliance_frameworks_affected', array(), 'control_id', '', 'control_category', '', 'control_pass_fail_status', '', 'required_evidence_missing', '', 'auditor_explanation', '', 'control_state', '')) AS array<{schemas.REPORT_FINDING}>)")
    return spark.createDataFrame([(hashes, declared)], "h ARRAY<STRING>, merkle_root STRING").withColumn("findings", finding)


def test_verify_merkle(spark):
    for n in range(0, 10):
        leaves = [leaf(i) for i in range(n)]
        row = FN.verify_merkle(reports(spark, [x.upper() for x in leaves], root(leaves).upper())).first()
        assert row.valid and row.message == "Compliance evidence report verified", n
    row = FN.verify_merkle(reports(spark, [leaf(1)], "0" * 64)).first()
    assert not row.valid and row.message == "Merkle root mismatch"
    row = FN.verify_merkle(reports(spark, ["xyz"], "0" * 64)).first()
    assert not row.valid and row.message == "Invalid evidence hash: xyz"


def test_row_order_does_not_change_the_report(spark, files_of):
    rows = [(f"src/f{i}.py", "digest = md5(x)\nos.system(cmd)\n" * (i % 3 + 1)) for i in range(12)]
    want = None
    for seed in range(2):
        random.seed(seed)
        random.shuffle(rows)
        done = FN.finalize(scan_files(files_of(*rows).repartition(3 + seed), ["D17", "D21"]))
        got = (sorted((r.id, r.file, r.evidence_hash) for r in done.collect()), FN.merkle_roots(done).first().merkle_root)
        want = want or got
        assert got == want


def test_parts_are_verified_together(spark):
    leaves = [leaf(i) for i in range(10)]
    whole = reports(spark, leaves, root(leaves)).withColumn("workspace", F.lit("w"))
    parts = whole.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("parts", F.lit(4)).withColumn(
        "findings", F.expr("slice(findings, 1 + 3 * part, 3)"))
    check = lambda df: [(r.valid, r.message) for r in FN.verify_merkle(df).collect()]
    assert check(parts) == [(True, FN.VERIFIED)]
    assert check(parts.where("part <> 2")) == [(False, "Report is incomplete")] == check(parts.union(parts.where("part = 1")))
    changed = parts.withColumn("findings", F.expr(f"IF(part = 1, transform(findings, (f, i) -> IF(i = 0, named_struct('id', f.id, 'type', f.type, 'file', f.file, 'line', f.line, 'snippet', f.snippet, 'severity', f.severity, 'confidence', f.confidence, 'evidence_hash', '{leaf(99)}', 'compliance_frameworks_affected', f.compliance_frameworks_affected, 'control_id', f.control_id, 'control_category', f.control_category, 'control_pass_fail_status', f.control_pass_fail_status, 'required_evidence_missing', f.required_evidence_missing, 'auditor_explanation', f.auditor_explanation, 'control_state', f.control_state), f)), findings)"))
    assert check(changed) == [(False, "Merkle root mismatch")]


@pytest.mark.parametrize("confidence", [0.0, 1.0, 0.5, 0.001, 0.00099, 0.0005, 0.0001234, 0.0001, 0.00001, 1.5e-05, 3e-11, 2.25e-300])
def test_small_confidences_are_written_as_json_does(spark, confidence):
    assert spark.createDataFrame([(confidence,)], "c DOUBLE").selectExpr(FN.json_number("c")).first()[0] == json.dumps(confidence)
