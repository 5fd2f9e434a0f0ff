"""Attestation ledger: recording, listing, look-ups, human attestations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import lit
from .dims import controls
from .finalize import with_position


def lookup_controls(df: DataFrame) -> DataFrame:
    """Catalogue columns for (framework, control_id); unknown pairs keep nulls. The catalogue is 21 rows."""
    return df.join(F.broadcast(controls(df.sparkSession)), ["framework", "control_id"], "left")


def record_attestation(requests: DataFrame) -> DataFrame:
    """Ledger rows: lower-cased root and key, frameworks and coverage from the metadata, counts."""
    return requests.withColumns({
        "merkle_root": F.lower("merkle_root"),
        "public_key_hex": F.lower("public_key_hex"),
        "frameworks_covered": F.expr(
            "coalesce(from_json(get_json_object(metadata, '$.frameworks'), 'array<string>'), cast(array() AS array<string>))"),
        "control_coverage_percent": F.expr("cast(get_json_object(metadata, '$.control_coverage_percent') AS double)"),
        "evidence_count": F.expr("coalesce(size(evidence_hashes), 0)"),
        "human_signer_count": F.expr("coalesce(size(human_signer_identities), 0)"),
        "control_count": F.expr("coalesce(size(control_states), 0)"),
    })


def numbered(rows: DataFrame, start: int = 0) -> DataFrame:
    """Consecutive ledger ids after ``start``, in order of creation."""
    keyed = rows.withColumn("_all", F.lit(0))
    order = [F.col("created_at"), F.col("merkle_root"), F.col("public_key_hex")]
    return with_position(keyed, ["_all"], order, "id", cut=False, few=True).withColumn("id", F.col("id") + start).drop("_all")


def list_attestations(ledger: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page, newest first, with the total beside every row."""
    total = ledger.select(F.count(F.lit(1))).scalar()
    page = ledger.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)
    return page.select(
        "id", "merkle_root", "public_key_hex", "created_at", "frameworks_covered", "control_coverage_percent",
        total.alias("total"))


def auditor_verify(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """First ledger row per requested (root, key), or a not-found row.

    The ledger is cut down to one row per key by a combinable aggregate before the join.
    """
    first = ledger.groupBy(
        F.lower("merkle_root").alias("root_key"), F.lower("public_key_hex").alias("public_key")).agg(
        F.min("id").alias("attest_id"),
        F.min_by(F.struct("frameworks_covered", "control_coverage_percent", "created_at"), "id").alias("hit"))
    asked = requests.withColumns({"root_key": F.lower("merkle_root"), "public_key": F.lower("public_key_hex")})
    return asked.join(first, ["root_key", "public_key"], "left").selectExpr(
        *requests.columns,
        "attest_id IS NOT NULL AS verified", "attest_id",
        "coalesce(hit.frameworks_covered, cast(array() AS array<string>)) AS frameworks_covered",
        "hit.control_coverage_percent AS control_coverage_percent", "hit.created_at AS attested_at",
        "CASE WHEN attest_id IS NULL THEN 'Attestation not found in compliance ledger' "
        "ELSE 'Attestation verified in compliance ledger' END AS message")


def ingest_evidence(uploads: DataFrame) -> DataFrame:
    """Decoded size and hash of base64 uploads under a fresh id."""
    return uploads.withColumn("content", F.unbase64("content_base64")).selectExpr(
        "uuid() AS upload_id", "file_name", "file_type", "sha2(content, 256) AS content_hash",
        "cast(octet_length(content) AS bigint) AS file_size")


def human_attest(requests: DataFrame, uploads: DataFrame) -> DataFrame:
    """Attestation rows from requests (request_id, control_id, framework, role, ..., ts, expiry_days,
    evidence_upload_ids). Requests naming an unknown upload are returned with the missing ids instead.
    """
    refs = requests.select("request_id", F.posexplode("evidence_upload_ids").alias("place", "upload_id"))
    known = uploads.groupBy("upload_id").agg(F.min("content_hash").alias("content_hash"))
    # the list of one request is an array of that request's own row, so collecting it back is bounded by the input
    resolved = refs.join(known, "upload_id", "left").groupBy("request_id").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(place, content_hash))), x -> x.content_hash), '')").alias("hashes"),
        F.expr("array_sort(collect_list(CASE WHEN content_hash IS NULL THEN upload_id END))").alias("missing_uploads"))
    joined = requests.join(resolved, "request_id", "left")
    stamp = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"
    iso = f"concat(IF(endswith({stamp}, '.000000'), left({stamp}, 19), {stamp}), '+00:00')"
    return joined.selectExpr(
        *requests.columns,
        "coalesce(missing_uploads, cast(array() AS array<string>)) AS missing_uploads",
        "size(coalesce(missing_uploads, array())) = 0 AS accepted",
        "sha2(coalesce(hashes, ''), 256) AS evidence_hash",
        f"substring(sha2(concat_ws(':', control_id, framework, {iso}, signature), 256), 1, 16) AS attestation_id",
        "ts + make_dt_interval(expiry_days) AS expires_at")


def list_human_attestations(rows: DataFrame, control_id: str | None = None, framework: str | None = None,
                            limit: int = 50, offset: int = 0) -> DataFrame:
    """Filtered page, newest first, with the total before paging."""
    kept = rows
    if control_id:
        kept = kept.filter(F.col("control_id") == control_id)
    if framework:
        kept = kept.filter(F.col("framework") == framework)
    total = kept.select(F.count(F.lit(1))).scalar()
    page = kept.orderBy(F.desc("ts"), F.desc("attestation_id")).offset(offset).limit(limit)
    return page.select("attestation_id", "control_id", "framework", "role", "ts", "expires_at", total.alias("total"))


def attestation_expired(rows: DataFrame, as_of: str) -> DataFrame:
    """Expired means strictly later than ``expires_at``."""
    return rows.withColumn("expired", F.expr(f"timestamp'{as_of}' > expires_at"))


def evidence_freshness(evidence: DataFrame, as_of: str) -> DataFrame:
    """Age in days against the review cadence and expiry of the control."""
    return lookup_controls(evidence).selectExpr(
        *evidence.columns, "review_days", "expiry_days",
        f"datediff(date'{as_of}', cast(collected_at AS date)) AS age_days").withColumns({
            "review_due": F.expr("age_days > review_days"), "expired": F.expr("age_days > expiry_days")})


def signer_identity(public_key: str = "public_key_hex", role: str = "role") -> str:
    return f"sha2(concat_ws(':', {public_key}, {role}), 256)"
