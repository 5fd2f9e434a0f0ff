"""States, ledger queries and roll-ups on small tables."""

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from auditlake import schemas
from auditlake.operators import ledger as LG, rollups as RU, states as ST

ENRICHED = (
    "workspace STRING, type STRING, file STRING, line INT, snippet STRING, severity STRING, control_id STRING, "
    "control_pass_fail_status STRING, compliance_frameworks_affected ARRAY<STRING>"
)
ORDERED = schemas.EVIDENCE + ", collector INT, rule_no INT, match_no INT, control_no INT"


def enriched(spark, *rows):
    full = [(ws, "t", "f", i, "s", "high", control, status, frameworks) for i, (ws, control, status, frameworks) in enumerate(rows)]
    return spark.createDataFrame(full, ENRICHED)


def evidence(spark, *rows):
    full = [(ws, control, framework, "config_proof", present, f"s{i}", {}, expired, 0, 0, i, 0)
            for i, (ws, control, framework, present, expired) in enumerate(rows)]
    return spark.createDataFrame(full, ORDERED)


def test_report_states_keep_their_mixed_keys(spark):
    findings = enriched(spark, ("w", "SOC2-CC7.2", "FAIL", ["SOC2"]), ("w", "UNKNOWN", "FAIL", []),
                        ("w", "SOC2-CC6.1", "PASS", ["SOC2"]), ("w", "X-1", "PASS", ["X"]), ("w", "CC6.2", "FAIL", ["SOC2"]),
                        ("w", "CC9", "FAIL", []))
    proof = evidence(spark, ("w", "CC7.2", "SOC2", True, False), ("w", "Article-30", "GDPR", True, False),
                     ("w", "CC6.2", "SOC2", False, False), ("w", "CC7.3", "SOC2", False, True), ("w", "CC7.3", "SOC2", True, False),
                     ("w", "164.312", "HIPAA", False, True))
    got = {r.control_id: r.state for r in ST.report_states(findings, proof).collect()}
    assert got == {
        "SOC2-CC7.2": "MISSING_EVIDENCE", "SOC2-CC6.1": "VERIFIED_MACHINE", "X-1": "MISSING_EVIDENCE", "CC6.2": "MISSING_EVIDENCE",
        "CC7.2": "VERIFIED_SYSTEM", "CC7.3": "ATTESTED_HUMAN", "164.312": "EXPIRED_EVIDENCE"}


def test_every_control_has_exactly_one_state(spark):
    findings = enriched(spark, ("w", "SOC2-CC6.1", "FAIL", ["SOC2"]))
    proof = evidence(spark, ("w", "CC7.2", "SOC2", True, False), ("w", "164.312", "HIPAA", True, True))
    people = spark.createDataFrame([
        ("SOC2", "CC7.3", dt.datetime(2024, 1, 2)), ("SOC2", "CC8.1", dt.datetime(2023, 1, 1)), ("NONE", "X", dt.datetime(2030, 1, 1))],
        "framework STRING, control_id STRING, expires_at TIMESTAMP_NTZ")
    rows = ST.resolve_states(spark.createDataFrame([("w",), ("v",)], "workspace STRING"), findings, proof, people, "2024-01-02 00:00:00").collect()
    assert len(rows) == 42
    got = {(r.workspace, r.control_id): r.state for r in rows}
    assert got["w", "CC7.2"] == "VERIFIED_SYSTEM" and got["w", "164.312"] == "EXPIRED_EVIDENCE"
    assert got["w", "CC7.3"] == "ATTESTED_HUMAN"  # the moment of expiry still counts
    assert got["v", "CC8.1"] == "EXPIRED_EVIDENCE" and got["v", "CC7.2"] == "MISSING_EVIDENCE"
    assert {r.open_findings for r in rows if (r.workspace, r.control_id) == ("w", "CC6.1")} == {1}


def test_roll_up_keys_and_empty_cases(spark):
    standards = spark.createDataFrame([("w", ["DPDP", "PCI-DSS", "SOC2"]), ("e", ["SOC2"])], "workspace STRING, standards ARRAY<STRING>")
    states = spark.createDataFrame([
        ("w", "SOC2-CC6.1", "MISSING_EVIDENCE"), ("w", "PCI-DSS-3.4", "VERIFIED_MACHINE"), ("w", "CC7.2", "VERIFIED_SYSTEM"),
        ("w", "Section-9", "VERIFIED_SYSTEM")], "workspace STRING, control_id STRING, state STRING")
    none = evidence(spark, ("x", "CC7.2", "SOC2", True, False))
    findings = enriched(spark, ("e", "SOC2-CC6.1", "FAIL", ["SOC2"]))
    plain = {(r.workspace, r.standard): (r.total, r.satisfied, r.coverage) for r in RU.framework_coverage(standards, states, none, findings).collect()}
    assert plain == {("w", "DPDP"): (1, 1, 100), ("w", "PCI-DSS"): (0, 0, 100), ("w", "SOC2"): (1, 0, 0), ("e", "SOC2"): (1, 0, 0)}
    whole = {(r.workspace, r.standard): r.total for r in RU.framework_coverage(standards, states, none, findings, normalised=True).collect()}
    assert whole["w", "PCI-DSS"] == 1 and whole["w", "DPDP"] == 0
    ready = {r.workspace: r.readiness_percent for r in RU.readiness(
        spark.createDataFrame([("w",), ("none",)], "workspace STRING"), states, none, findings).collect()}
    assert ready == {"w": 75, "none": 0}


def test_rounding_is_half_up(spark):
    got = spark.range(1).selectExpr(f"{RU.percent('1', '8', 0)} AS a", f"{RU.percent('1', '200', 0)} AS b", f"{RU.percent('0', '0', 100)} AS c").first()
    assert (got.a, got.b, got.c) == (13, 1, 100)


def ledger(spark):
    rows = [(1, "aa", "k1", ["SOC2"], 75.5, dt.datetime(2024, 1, 1)), (2, "bb", "k1", [], None, dt.datetime(2024, 1, 3)),
            (3, "aa", "k1", ["GDPR"], 1.0, dt.datetime(2024, 1, 2))]
    return spark.createDataFrame(rows, "id BIGINT, merkle_root STRING, public_key_hex STRING, frameworks_covered ARRAY<STRING>, control_coverage_percent DOUBLE, created_at TIMESTAMP_NTZ")


def test_attestation_recorded(spark):
    row = spark.createDataFrame([("AB", "CD", '{"frameworks": ["SOC2", "ISO27001"], "control_coverage_percent": 75.5}', ["a", "b"], ["h1", "h2"],
                                  {"SOC2-CC6.2": "MISSING_EVIDENCE", "SOC2-CC7.2": "VERIFIED_MACHINE"})],
                                "merkle_root STRING, public_key_hex STRING, metadata STRING, evidence_hashes ARRAY<STRING>, human_signer_identities ARRAY<STRING>, control_states MAP<STRING,STRING>")
    got = LG.record_attestation(row).first()
    assert (got.merkle_root, got.public_key_hex, got.frameworks_covered, got.control_coverage_percent) == ("ab", "cd", ["SOC2", "ISO27001"], 75.5)
    assert (got.evidence_count, got.human_signer_count, got.control_count) == (2, 2, 2)
    bare = LG.record_attestation(row.selectExpr("merkle_root", "public_key_hex", "cast(NULL AS string) AS metadata", "cast(NULL AS array<string>) AS evidence_hashes",
                                                "human_signer_identities", "control_states")).first()
    assert bare.frameworks_covered == [] and bare.control_coverage_percent is None and bare.evidence_count == 0


def test_listing_and_verification(spark):
    page = LG.list_attestations(ledger(spark), limit=1, offset=1).collect()
    assert [(r.id, r.total) for r in page] == [(3, 3)]
    asked = spark.createDataFrame([("AA", "K1"), ("zz", "k1")], "merkle_root STRING, public_key_hex STRING")
    got = {r.merkle_root: (r.verified, r.attest_id, r.frameworks_covered) for r in LG.auditor_verify(asked, ledger(spark)).collect()}
    assert got == {"AA": (True, 1, ["SOC2"]), "zz": (False, None, [])}
    assert [r.id for r in RU.newest(ledger(spark), 2).collect()] == [2, 3]


def test_human_attestation(spark):
    ts = dt.datetime(2024, 2, 28, 12, 0, 0, 5000)
    asked = spark.createDataFrame([
        (1, "CC7.3", "SOC2", "founder", "sig", ts, 2, ["u2", "u1", "u2"]), (2, "CC8.1", "SOC2", "auditor", "sig", ts.replace(microsecond=0), 1, []),
        (3, "CC8.1", "SOC2", "auditor", "sig", ts, 1, ["u9", "u1"])],
        "request_id INT, control_id STRING, framework STRING, role STRING, signature STRING, ts TIMESTAMP_NTZ, expiry_days INT, evidence_upload_ids ARRAY<STRING>")
    known = spark.createDataFrame([("u1", "h1"), ("u2", "h2")], "upload_id STRING, content_hash STRING")
    got = {r.request_id: r for r in LG.human_attest(asked, known).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].evidence_hash == sha("h2h1h2") and got[2].evidence_hash == sha("")
    assert got[1].expires_at == dt.datetime(2024, 3, 1, 12, 0, 0, 5000)
    assert got[1].attestation_id == sha("CC7.3:SOC2:2024-02-28T12:00:00.005000+00:00:sig")[:16]
    assert got[2].attestation_id == sha("CC8.1:SOC2:2024-02-28T12:00:00+00:00:sig")[:16]
    assert [got[i].accepted for i in (1, 2, 3)] == [True, True, False] and got[3].missing_uploads == ["u9"]
    due = LG.attestation_expired(LG.human_attest(asked, known), "2024-03-01 12:00:00.005").select("request_id", "expired").collect()
    assert {r.request_id: r.expired for r in due} == {1: False, 2: True, 3: True}


def test_signer_identity(spark):
    got = spark.createDataFrame([("abc", "auditor")], "public_key_hex STRING, role STRING").select(F.expr(LG.signer_identity()).alias("h")).first().h
    assert got == hashlib.sha256(b"abc:auditor").hexdigest()
