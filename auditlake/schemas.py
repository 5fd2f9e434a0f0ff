"""Explicit schemas; nothing is inferred."""

FILES = "workspace STRING, path STRING, name STRING, ext STRING, content STRING"
LINES = "workspace STRING, path STRING, line_no INT, line STRING"
HIT = (
    "detector STRING, type STRING, line INT, snippet STRING, severity STRING, "
    "confidence DOUBLE, tool_confidence DOUBLE, metadata MAP<STRING,STRING>"
)
HITS = (
    "array<struct<detector:string,type:string,line:int,snippet:string,severity:string,"
    "confidence:double,tool_confidence:double,metadata:map<string,string>>>"
)
RAW_FINDINGS = (
    "workspace STRING, detector STRING, type STRING, file STRING, line INT, snippet STRING, "
    "severity STRING, confidence DOUBLE, metadata MAP<STRING,STRING>"
)
EVIDENCE = (
    "workspace STRING, control_id STRING, framework STRING, evidence_type STRING, evidence_present BOOLEAN, "
    "evidence_source STRING, evidence_data MAP<STRING,STRING>, expiry_detected BOOLEAN"
)
CONTROLS = (
    "framework STRING, control_id STRING, control_category STRING, control_type STRING, "
    "verification_method STRING, required_evidence_types ARRAY<STRING>, review_days INT, expiry_days INT, "
    "description STRING, auditor_explanation STRING"
)
FINDING_TYPE_CONTROLS = (
    "type STRING, control_id STRING, control_category STRING, evidence_type STRING, "
    "frameworks ARRAY<STRING>, description STRING, auditor_explanation STRING"
)
REPORT_FINDING = (
    "struct<id:string,type:string,file:string,line:int,snippet:string,severity:string,confidence:double,"
    "evidence_hash:string,compliance_frameworks_affected:array<string>,control_id:string,control_category:string,"
    "control_pass_fail_status:string,required_evidence_missing:string,auditor_explanation:string,"
    "control_state:string>"
)
REPORT_EVIDENCE = (
    "struct<control_id:string,framework:string,evidence_type:string,evidence_present:boolean,"
    "evidence_source:string,expiry_detected:boolean>"
)
REPORTS = (
    "report_version STRING, project STRUCT<name:string,path:string,commit:string,scan_time:string>, "
    f"standards ARRAY<STRING>, findings ARRAY<{REPORT_FINDING}>, system_evidence ARRAY<{REPORT_EVIDENCE}>, "
    "control_states MAP<STRING,STRING>, evidence_hashes ARRAY<STRING>, "
    "metrics STRUCT<critical:int,high:int,medium:int,low:int,risk_score:int>, merkle_root STRING, "
    "agent_signature STRING, agent_version STRING, _corrupt_record STRING"
)
SYMBOLS = "workspace STRING, path STRING, kind STRING, symbol STRING, lineno INT, nearby STRING"
