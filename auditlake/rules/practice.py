"""Practice and configuration evidence rules.

Fixed values: patterns in Python ``re`` notation, package names and word lists.
"""

CONSENT_NPM = [
    "supabase", "auth0", "@supabase/supabase-js", "privacy-policy", "consent-manager",
    "cookie-consent", "@segment/consent-manager", "react-cookie-consent",
]
CONSENT_PY = ["supabase", "auth0", "privacy", "consent", "gdpr"]
CONSENT_PY_FILES = ["requirements.txt", "requirements-dev.txt", "pyproject.toml", "Pipfile"]
CONSENT_ROUTES = [
    r"@(?:app|router|api)\.(?:route|get|post|put|delete|patch)\([\"']([^\"']*consent[^\"']*)[\"']",
    r"@(?:app|router|api)\.(?:route|get|post|put|delete|patch)\([\"']([^\"']*\/consent[^\"']*)[\"']",
    r"router\.(?:get|post|put|delete|patch)\([\"']([^\"']*consent[^\"']*)[\"']",
    r"express\.(?:get|post|put|delete)\([\"']([^\"']*consent[^\"']*)[\"']",
]
CONSENT_SCHEMA = [
    "create table consent", "create table user_consent", "alter table.*consent",
    "consent boolean", "consent timestamp",
]
CONSENT_MIGRATION_WORDS = ["table", "column", "model"]

PORTABILITY_ROUTES = [
    r"@(?:app|router|api)\.(?:route|get|post)\([\"']([^\"']*(?:export|download.*data|data.*export)[^\"']*)[\"']",
    r"router\.(?:get|post)\([\"']([^\"']*(?:export|download.*data)[^\"']*)[\"']",
    r"express\.(?:get|post)\([\"']([^\"']*(?:export|download.*data)[^\"']*)[\"']",
]
PORTABILITY_ROUTE_WORDS = ["export", "download", "portability"]
PORTABILITY_CALLS = ["export", "download_data", "get_user_data", "data_portability"]

ACCESS_LOG_CALLS = ["log", "audit", "log_access", "audit_log"]
ACCESS_LOG_CONTEXT = ["access", "user", "request", "api"]
ACCESS_LOG_DECORATORS = ["log", "audit", "track"]
ACCESS_LOG_CLASSES = ["middleware", "logger", "audit"]
ACCESS_LOG_CONFIG = [
    r"logging\.(?:enabled|enable)\s*[:=]\s*(?:true|True|1|yes|enabled)",
    r"access.*log.*(?:enabled|enable)\s*[:=]\s*(?:true|True|1|yes|enabled)",
    r"audit.*log.*(?:enabled|enable)\s*[:=]\s*(?:true|True|1|yes|enabled)",
    r"ENABLE.*LOG.*=.*true",
    r"ACCESS_LOG.*=.*true",
]
CONFIG_EXTS = [".yaml", ".yml", ".json", ".toml", ".env", ".conf", ".config"]

RETENTION_CONFIG = [
    r"retention.*(?:days|period)\s*[:=]\s*(\d+)",
    r"data.*retention.*(?:days|period)\s*[:=]\s*(\d+)",
    r"retention.*policy",
    r"DATA_RETENTION.*=.*\d+",
]

ERASURE_ROUTES = [
    r"@(?:app|router|api)\.(?:route|delete|post)\([\"']([^\"']*(?:delete|erase|remove.*user|forget)[^\"']*)[\"']",
    r"router\.(?:delete|post)\([\"']([^\"']*(?:delete|erase|remove)[^\"']*)[\"']",
    r"express\.(?:delete|post)\([\"']([^\"']*(?:delete|erase)[^\"']*)[\"']",
]
ERASURE_WORDS = ["delete", "erase", "remove", "forget"]
ERASURE_ROUTE_SUBJECTS = ["user", "account", "data", "profile"]
ERASURE_CALL_SUBJECTS = ["user", "data", "personal"]

ENCRYPTION_PY = ["cryptography", "pycryptodome", "bcrypt", "crypto", "encrypt"]
ENCRYPTION_PY_FILES = ["requirements.txt", "pyproject.toml", "Pipfile"]
ENCRYPTION_NPM = ["crypto", "crypto-js", "bcrypt", "bcryptjs", "encrypt", "tls"]
ENCRYPTION_CONFIG = [
    r"encryption.*(?:enabled|enable)\s*[:=]\s*(?:true|True|1|yes|enabled)",
    r"(?:ssl|tls|https).*(?:enabled|enable)\s*[:=]\s*(?:true|True|1|yes|enabled)",
    r"ENCRYPTION.*=.*true",
    r"SSL.*=.*true",
    r"TLS.*=.*true",
]

# collectors of configuration evidence: (pattern, key)
LOGGING_EVIDENCE = [
    (r"logging\.(enabled|enable)\s*[:=]\s*(true|True|1|yes)", "logging_enabled"),
    (r"access.*log.*enabled\s*[:=]\s*(true|True|1|yes)", "access_logging_enabled"),
    (r"audit.*log.*enabled\s*[:=]\s*(true|True|1|yes)", "audit_logging_enabled"),
    (r"log.*retention\s*[:=]\s*(\d+)", "log_retention_days"),
]
RETENTION_EVIDENCE = [
    (r"retention.*period\s*[:=]\s*(\d+)", "retention_period"),
    (r"data.*retention\s*[:=]\s*(\d+)", "data_retention_days"),
    (r"retention.*days\s*[:=]\s*(\d+)", "retention_days"),
    (r"retention.*policy", "retention_policy_mentioned"),
]
ENCRYPTION_EVIDENCE = [
    (r"encryption.*at.*rest\s*[:=]\s*(true|True|1|yes|enabled)", "encryption_at_rest"),
    (r"encryption.*in.*transit\s*[:=]\s*(true|True|1|yes|enabled)", "encryption_in_transit"),
    (r"tls.*enabled\s*[:=]\s*(true|True|1|yes)", "tls_enabled"),
    (r"ssl.*enabled\s*[:=]\s*(true|True|1|yes)", "ssl_enabled"),
    (r"https.*enabled\s*[:=]\s*(true|True|1|yes)", "https_enabled"),
]
MFA_EVIDENCE = [
    (r"mfa.*enabled\s*[:=]\s*(true|True|1|yes|enabled|required)", "mfa_enabled"),
    (r"2fa.*enabled\s*[:=]\s*(true|True|1|yes|enabled|required)", "2fa_enabled"),
    (r"multi.*factor.*enabled\s*[:=]\s*(true|True|1|yes|enabled|required)", "mfa_enabled"),
    (r"mfa.*required\s*[:=]\s*(true|True|1|yes)", "mfa_required"),
]
BACKUP_SIGNALS = [
    (r"backup.*enabled\s*[:=]\s*(true|True|1|yes|enabled)", "backup_enabled"),
    (r"backup.*frequency\s*[:=]\s*(\d+)", "backup_frequency"),
    (r"backup.*retention\s*[:=]\s*(\d+)", "backup_retention"),
]

AWS_CLOUDTRAIL = [
    r"aws_cloudtrail.*logging.*enabled\s*=\s*true",
    r"enable_logging\s*=\s*true.*cloudtrail",
]
AWS_S3_ENCRYPTION = [
    r"server_side_encryption_configuration",
    r"sse_algorithm\s*=\s*[\"']AES256[\"']",
]
AWS_IAM_MFA = [
    r"mfa_enabled\s*=\s*true",
    r"enforce_mfa\s*=\s*true",
]
# (framework, control) pairs credited by each cloud setting
AWS_CLOUDTRAIL_CONTROLS = [
    ("SOC2", "CC7.2"), ("ISO27001", "A.10.1.1"), ("GDPR", "Article-30"), ("DPDP", "Section-9"),
    ("HIPAA", "164.312"), ("PCI-DSS", "10.2"), ("NIST-CSF", "PR.DS-1"),
]
AWS_S3_CONTROLS = [
    ("SOC2", "CC6.1"), ("ISO27001", "A.10.1.1"), ("GDPR", "Article-32"), ("DPDP", "Section-8"),
    ("HIPAA", "164.312"), ("PCI-DSS", "3.4"), ("NIST-CSF", "PR.DS-1"),
]
AWS_MFA_CONTROLS = [
    ("SOC2", "CC6.1"), ("ISO27001", "A.9.2.1"), ("HIPAA", "164.308"), ("PCI-DSS", "8.2"), ("NIST-CSF", "PR.AC-1"),
]
