"""Published lists, reader filters and the sensitive-text scan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import identity, moments

# ---- fixed values -------------------------------------------------------------------------
PUBLISHABLE_VERSION = 5
BASE_FIELDS = [
    "arxiv_id", "title", "authors", "categories", "published_on", "summary", "reason",
    "quota_source", "abstract_url", "pdf_url",
]
JUDGED_FIELDS = ["quality", "uncertainty", "preference_signals", "limitation"]
EVIDENCE_FIELDS = [
    "quality_evidence_fields", "reproducibility", "reproducibility_evidence",
    "evidence_provenance",
]
HEADER_FIELDS = [
    "schema_version", "generation_started_at", "generation_completed_at", "artifact_built_at",
    "profile_library_version", "profile_snapshot_at", "profile_schema_version", "workflow_run",
    "output_language",
]
SENSITIVE_PATTERNS = {
    "private key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "GitHub token": r"\b(?:ghp|gho|ghu|ghs|github_pat)_[A-Za-z0-9_]{20,}\b",
    "DeepSeek key": r"\bsk-[A-Za-z0-9]{20,}\b",
    "library export": r'"itemType"\s*:\s*"(?:attachment|annotation|note)"',
    "local absolute path": r"(?:/home/|/Users/|[A-Za-z]:\\\\Users\\\\)",
    "raw model prompt": r'"(?:prompt|response_body|raw_profile)"\s*:',
}
# -------------------------------------------------------------------------------------------


def published_rows(records: DataFrame) -> DataFrame:
    """The only projection of a recommendation that may leave."""
    empty = F.array().cast("array<string>")
    optional = {
        "identity_matches": empty, "limitation": F.lit(None).cast("string"),
        "uncertainty": F.lit(None).cast("double"), "quality_evidence_fields": empty,
        "reproducibility": F.lit(None).cast("double"),
        "reproducibility_evidence": F.lit("unknown"), "evidence_provenance": empty,
    }
    for name, default in optional.items():
        if name not in records.columns:
            records = records.withColumn(name, default)
    keys = [c for c in ("run_id", "profile_id", "rank") if c in records.columns]
    return records.select(
        *keys,
        F.col("paper_id").alias("arxiv_id"),
        "title",
        "authors",
        "categories",
        moments.product_date(F.col("published")).alias("published_on"),
        "summary",
        "reason",
        "quality",
        F.col("source").alias("quota_source"),
        identity.abstract_url(F.col("paper_id")).alias("abstract_url"),
        identity.pdf_url(F.col("paper_id")).alias("pdf_url"),
        F.col("identity_matches").alias("preference_signals"),
        *[c for c in optional if c != "identity_matches"],
    )


def payload_fields(version: int) -> list[str]:
    """Field names of one published record under a schema version."""
    if version <= 3:
        extra = ["confidence"] + (["preference_signals"] if version >= 2 else [])
    else:
        extra = JUDGED_FIELDS + (EVIDENCE_FIELDS if version >= 5 else [])
    return [*BASE_FIELDS, *extra]


def published_payload(rows: DataFrame, version: int = PUBLISHABLE_VERSION) -> DataFrame:
    """Rows shaped for one schema version (K1)."""
    named = rows.withColumn("confidence", F.col("quality"))
    keys = [c for c in ("run_id", "profile_id", "rank") if c in rows.columns]
    return named.select(*keys, F.lit(version).alias("schema_version"), *payload_fields(version))


def matches(
    *,
    date: str | None = None,
    topic: str | None = None,
    category: str | None = None,
    source: str | None = None,
    feedback: str | None = None,
) -> Column:
    """What a reader's filters keep (P14); ``action`` holds the reader's own feedback."""
    keep = F.lit(True)
    if date:
        keep = keep & (F.col("published_on") == date)
    if topic:
        whole = F.lower(F.concat_ws(" ", "title", "summary", "reason"))
        keep = keep & F.contains(whole, F.lit(topic.lower()))
    if category:
        keep = keep & F.array_contains("categories", category)
    if source:
        keep = keep & (F.col("quota_source") == source)
    if feedback:
        keep = keep & (F.coalesce("action", F.lit("")) == feedback)
    return keep


def reader_view(rows: DataFrame, actions: DataFrame | None = None, **filters) -> DataFrame:
    """Published rows under a reader's filters, with the reader's feedback when given."""
    if actions is not None:
        rows = rows.join(actions.select("arxiv_id", "action"), "arxiv_id", "left")
    return rows.filter(matches(**filters))


def scan_sensitive(
    texts: DataFrame,
    column: str = "text",
    patterns: Mapping[str, str] = SENSITIVE_PATTERNS,
    by: str | None = None,
) -> DataFrame:
    """Rows and hits per credential or private-data pattern, texts themselves left out."""
    hit = lambda p: F.regexp_count(F.col(column), F.lit(p)).cast("long")
    flags = F.array(
        *[F.struct(F.lit(n).alias("label"), hit(p).alias("hits")) for n, p in patterns.items()]
    )
    keys = [] if by is None else [by]
    found = texts.select(*keys, F.explode(flags).alias("f")).filter("f.hits > 0")
    return found.groupBy(*keys, F.col("f.label").alias("label")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("f.hits").alias("hits")
    )
