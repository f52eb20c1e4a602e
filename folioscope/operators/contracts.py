"""Row contracts: every rule set splits a table into valid rows and rejects with a reason."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import moments, text, urls
from folioscope.operators.evidence import GRADE_SCORES, SECTION_SOURCE
from folioscope.operators.weights import GROUPS

# ---- fixed values -------------------------------------------------------------------------
FACET_KINDS = ["domain", "method", "task"]
WATCHED_IDENTITIES, IDENTITY_ALIASES, IDENTITY_BYTES = 32, 8, 160
AVAILABILITY = ["available", "unknown", "inapplicable"]
REPOSITORY_HOSTS = ["github.com", "gitlab.com"]
PROVENANCE = ["arxiv-metadata", "ar5iv-sections-v1", "github-contents-v1"]
TIERS = ["core", "adjacent", "exploration"]
PUBLISHED_SIGNALS = ["watched_author", "watched_institution"]
PUBLISHED_EVIDENCE = [
    "title", "authors", "categories", "published", "summary", "method_evidence",
    "evaluation_evidence", "limitations_evidence", "quality_reference",
]
MANIFEST_COUNTS = ["candidate_count", "recommendation_count", "model_requests", "cache_hits"]
MANIFEST_MEASURES = ["estimated_tokens", "estimated_cost_usd", "duration_seconds"]
MANIFEST_OPTIONAL = [
    "actual_input_tokens", "actual_output_tokens", "actual_cost_usd", "provider_latency_seconds",
]
QUALITY_ROLES = ["descriptive", "positive_reference", "evaluation_reference", "limitation_context"]
# -------------------------------------------------------------------------------------------

Rules = Mapping[str, Column]


def marked(df: DataFrame, rules: Rules, reason: str = "reason") -> DataFrame:
    """Rows with the first rule they break, NULL where they keep all. NULL counts as broken."""
    broken = F.coalesce(
        *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(why)) for why, ok in rules.items()]
    )
    return df.withColumn(reason, broken)


def check(
    df: DataFrame, rules: Rules, *, reason: str = "reason", fail_fast: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Rows that keep every rule, and the rest with the first rule they break.

    A rule is a condition that must be true; NULL counts as broken. ``fail_fast`` raises on the
    first reject instead.
    """
    rows = marked(df, rules, reason)
    rejects = rows.filter(F.col(reason).isNotNull())
    if fail_fast:
        first = rejects.select(reason).take(1)
        if first:
            raise ValueError(first[0][0])
    return rows.filter(F.col(reason).isNull()).drop(reason), rejects


def reject_counts(rejects: DataFrame, reason: str = "reason") -> DataFrame:
    return rejects.groupBy(reason).agg(F.count(F.lit(1)).alias("rows"))


def filled(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit(""))) != ""


def unit(name: str) -> Column:
    return F.col(name).between(0, 1)


def optional(name: str, ok: Column) -> Column:
    return F.col(name).isNull() | ok


def subset(name: str, allowed: Sequence[str]) -> Column:
    return F.size(F.array_except(name, F.array(*map(F.lit, allowed)))) == 0


def https(name: str) -> Column:
    return F.col(name).rlike(r"^https://[^/?#]+")


def aware(name: str) -> Column:
    return F.col(name).rlike(moments.AWARE)


# V1, V2 ------------------------------------------------------------------------------------


def recommendation_reference() -> Rules:
    return {
        "identifier is empty": filled("arxiv_id") & filled("title"),
        "link is not an HTTPS URL": https("abstract_url") & https("pdf_url"),
    }


def feedback_record() -> Rules:
    return {
        "recommendation is empty": filled("recommendation_id"),
        "action is unknown": F.col("action").isin(
            "interested", "not_interested", "save_for_later", "read"
        ),
        "time carries no zone": aware("created_at"),
        "schema version is unsupported": F.col("schema_version") == 1,
    }


def minimal_manifest() -> Rules:
    return {
        "time carries no zone": aware("started_at"),
        "schema version is unsupported": F.col("schema_version") == 1,
    }


# V3, V4, V5 ----------------------------------------------------------------------------------


def feature() -> Rules:
    return {
        "feature identity is invalid": filled("name") & filled("provenance"),
        "feature group is unknown": F.col("grp").isin(GROUPS),
        "feature is not normalized": unit("value") & unit("confidence"),
        "unavailable feature carries a score": F.col("applicable")
        | ((F.col("value") == 0) & (F.col("confidence") == 0)),
    }


def weight_set() -> Rules:
    values = [*GROUPS, "negative_feedback_cap"]
    normal = filled("version")
    for v in values:
        normal = normal & unit(v)
    total = F.lit(0.0)
    for g in GROUPS:
        total = total + F.col(g)
    return {
        "weights are not normalized": normal,
        "weights exceed one": total <= 1,
        "interest is not the largest group": F.col("ablation")
        | (F.col("interest") >= F.greatest(*[F.col(g) for g in GROUPS[1:]])),
    }


def changed_versions(stored: DataFrame, incoming: DataFrame, key: str = "version") -> DataFrame:
    """Versions offered again with other content; any row is an error (V4)."""
    from folioscope.operators.ledger import append_status

    return append_status(stored, incoming, key).filter("conflict").select(key)


def selection_policy() -> Rules:
    bounds = [
        "minimum_score", "minimum_judged_quality", "minimum_solution_advance",
        "minimum_technical_depth", "minimum_value_confidence",
    ]
    normal = F.lit(True)
    for b in bounds:
        normal = normal & unit(b)
    return {
        "thresholds are not normalized": normal,
        "counts are invalid": (F.col("target") >= 1)
        & (F.least("core_cap", "adjacent_cap", "exploration_cap") >= 0),
        "no exploration slot": F.col("exploration_cap") >= 1,
    }


# V6, V7 ----------------------------------------------------------------------------------------


def feedback_event() -> Rules:
    from folioscope.operators.ledger import EVENT_TYPES, OUTCOMES, REASON_CODES

    kind = F.col("event_type")
    return {
        "identifier is empty": filled("event_id") & filled("paper_id"),
        "time is missing": F.col("occurred_at").isNotNull(),
        "event type is unknown": kind.isin(EVENT_TYPES),
        "outcome is unknown": optional("outcome", F.col("outcome").isin(OUTCOMES)),
        "impression shape is invalid": (kind != "impression")
        | (filled("batch_id") & F.col("displayed_rank").isNotNull() & F.col("outcome").isNull()),
        "outcome shape is invalid": (kind != "outcome")
        | (F.col("outcome").isNotNull() & F.col("displayed_rank").isNull()),
        "correction shape is invalid": (kind != "correction")
        | (F.col("outcome").isNotNull() & filled("supersedes_event_id")),
        "reason codes are invalid": (F.size("reason_codes") <= 3)
        & subset("reason_codes", REASON_CODES),
    }


def _codes(name: str) -> Column:
    return (F.size(name) <= 16) & F.forall(
        name, lambda c: (F.trim(c) != "") & (F.length(c) <= 80)
    )


def corpus_event() -> Rules:
    from folioscope.operators.corpus import KINDS, LABELS

    kind = F.col("kind")
    return {
        "identifier is empty": filled("event_id") & filled("paper_id") & filled("source"),
        "time is missing": F.col("occurred_at").isNotNull(),
        "kind is unknown": kind.isin(KINDS),
        "label is unknown": optional("label", F.col("label").isin(LABELS)),
        "codes are invalid": _codes("reason_codes") & _codes("applicable_dimensions"),
        "rationale is too long": optional("private_rationale", F.length("private_rationale") <= 4000),
        "label is missing": (kind != "label") | F.col("label").isNotNull(),
        "compared paper is missing": (kind != "pairwise") | filled("compared_paper_id"),
        "unlabel carries a judgment": (kind != "unlabel")
        | (F.col("label").isNull() & F.col("compared_paper_id").isNull()),
    }


# V11, V12, V13 ---------------------------------------------------------------------------------


def facet() -> Rules:
    return {
        "facet kind is unsupported": F.col("kind").isin(FACET_KINDS),
        "facet value is invalid": filled("value") & (F.length("value") <= 80),
        "facet is not normalized": unit("score") & unit("confidence"),
        "facet provenance is invalid": F.size("provenance").between(1, 6),
    }


def watched_identity() -> Rules:
    names = F.concat(F.array("name"), "aliases")
    normal = text.normalized_identities(names)
    return {
        "alias count is invalid": filled("name") & (F.size("aliases") <= IDENTITY_ALIASES),
        "value is empty or too long": F.forall(
            names, lambda n: (F.trim(n) != "") & (F.octet_length(n) <= IDENTITY_BYTES)
        ),
        "aliases repeat": F.size(F.array_distinct(normal)) == F.size(normal),
    }


def remote_profile() -> Rules:
    return {
        "schema version is unsupported": F.col("schema_version").isin(1, 2, 3, 4),
        "snapshot time is not UTC": optional(
            "source_library_synced_at", F.col("source_library_synced_at").rlike(r"(Z|\+00:00)$")
        ),
        "too many watched authors": F.size("watched_authors") <= WATCHED_IDENTITIES,
        "too many watched institutions": F.size("watched_institutions") <= WATCHED_IDENTITIES,
    }


def quality_example() -> Rules:
    from folioscope.operators.quality import TRAITS

    rules = {
        "paper is invalid": filled("paper_id") & (F.length("paper_id") <= 80),
    }
    for name, allowed in TRAITS.items():
        rules[f"{name} is invalid"] = (
            (F.size(name) <= 12)
            & (F.size(F.array_distinct(name)) == F.size(name))
            & subset(name, allowed)
        )
    return rules


def quality_criterion() -> Rules:
    from folioscope.operators.quality import TRAITS

    known = F.lit(False)
    for name, allowed in TRAITS.items():
        known = known | ((F.col("field") == name) & F.col("name").isin(allowed))
    return {"criterion is unknown": known, "support is not normalized": unit("support")}


def policy_violations(policies: DataFrame) -> DataFrame:
    """Policies whose field roles are incomplete or whose switches contradict."""
    per = policies.groupBy("policy_version").agg(
        F.count_distinct("field").alias("_fields"),
        F.count(F.lit(1)).alias("_rows"),
        F.collect_set("role").alias("_roles"),
        F.bool_and(F.col("role").isin(QUALITY_ROLES)).alias("_known"),
        F.bool_and(F.col("judge_contract").startswith("judge-")).alias("_judge"),
        F.any_value("generation_enabled").alias("_on"),
        F.any_value("reference_evidence_allowed").alias("_evidence"),
        F.any_value("descriptive_fields_sent").alias("_sent"),
    )
    has = lambda r: F.array_contains("_roles", r)
    _, bad = check(
        per,
        {
            "fields are incomplete": (F.col("_fields") == 5) & (F.col("_rows") == 5)
            & F.col("_known") & F.col("_judge"),
            "required roles are missing": has("descriptive") & has("limitation_context")
            & (has("positive_reference") | has("evaluation_reference")),
            "reference replaces evidence": ~(F.col("_on") & F.col("_evidence")),
            "descriptive fields are sent": ~(F.col("_on") & F.col("_sent")),
        },
    )
    return bad.select("policy_version", "reason")


# V14 -------------------------------------------------------------------------------------------


def evidence_value(name: str) -> Column:
    v = F.col(name)
    return (
        v["availability"].isin(AVAILABILITY)
        & v["confidence"].between(0, 1)
        & (v["provider"] != "")
        & (v["claim"].isNull() | (v["availability"] == "available"))
    )


def evidence() -> Rules:
    return {
        "paper is empty": filled("paper_id"),
        "provenance is empty": filled("provider") & filled("adapter_version"),
        "expiry does not follow observation": F.col("expires_at") > F.col("observed_at"),
    }


def repository_evidence() -> Rules:
    return {
        "repository host is not allowed": optional(
            "repository_url",
            F.regexp_extract("repository_url", urls.URL_PARTS, 2).isin(REPOSITORY_HOSTS)
            & F.col("repository_url").startswith("https://"),
        ),
        "unverified repository exposes a link": F.col("repository_url").isNull()
        | (F.col("association.availability") == "available"),
    }


# V15, V16, V17 ---------------------------------------------------------------------------------


def run_manifest() -> Rules:
    counts = F.lit(True)
    for c in MANIFEST_COUNTS:
        counts = counts & (F.col(c) >= 0)
    measures = F.lit(True)
    for c in MANIFEST_MEASURES:
        measures = measures & (F.col(c) >= 0)
    extra = F.lit(True)
    for c in MANIFEST_OPTIONAL:
        extra = extra & optional(c, F.col(c) >= 0)
    return {
        "model is empty": filled("model"),
        "counts are invalid": counts,
        "measurements are invalid": measures,
        "measured values are invalid": extra,
    }


def snapshot_violations(splits: DataFrame, labels: DataFrame) -> DataFrame:
    """Papers listed twice in one split, or labelled twice."""
    twice = splits.groupBy("split", "paper_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    labelled = labels.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return twice.select("split", "paper_id").unionByName(
        labelled.select(F.lit("labels").alias("split"), "paper_id")
    )


def ranked_paper() -> Rules:
    names = F.concat(F.array("paper_id"), "identifiers")
    return {
        "identifier is empty": F.forall(names, lambda n: F.trim(n) != ""),
        "identifiers repeat": F.size(F.array_distinct(names)) == F.size(names),
    }


# V18, V19, V21 ---------------------------------------------------------------------------------


def published() -> Rules:
    link = lambda n: F.col(n).rlike(r"^https://arxiv\.org(/|$|\?|#)")
    limitation = F.length("limitation").between(8, 800) & filled("limitation")
    return {
        "identity is empty": filled("arxiv_id") & filled("title") & (F.size("authors") > 0),
        "quality is not normalized": unit("quality"),
        "uncertainty is not normalized": optional("uncertainty", unit("uncertainty")),
        "reproducibility is not normalized": optional("reproducibility", unit("reproducibility")),
        "reproducibility evidence is unknown": F.col("reproducibility_evidence").isin(list(GRADE_SCORES)),
        "evidence fields are unknown": subset("quality_evidence_fields", PUBLISHED_EVIDENCE),
        "provenance is unknown": subset("evidence_provenance", PROVENANCE),
        "quota source is unknown": F.col("quota_source").isin(TIERS),
        "signals are unknown": subset("preference_signals", PUBLISHED_SIGNALS),
        "limitation is invalid": optional("limitation", limitation),
        "link leaves the archive": link("abstract_url") & link("pdf_url"),
    }


def cached_sections() -> Rules:
    size = lambda n: F.coalesce(F.length(n), F.lit(0))
    parts = ["method", "evaluation", "limitations"]
    each = F.lit(True)
    for p in parts:
        each = each & (size(p) <= text.SECTION_CHARACTERS)
    return {
        "source is not allowed": F.col("source_url").startswith(SECTION_SOURCE),
        "section is too long": each,
        "sections are too long": size("method") + size("evaluation") + size("limitations")
        <= text.TOTAL_CHARACTERS,
    }


def cached_page() -> Rules:
    return {
        "link is not approved": optional("url", urls.approved_url(F.col("url")) == F.col("url"))
    }


def model_usage() -> Rules:
    return {
        "content is empty": filled("content"),
        "token usage is negative": optional("input_tokens", F.col("input_tokens") >= 0)
        & optional("output_tokens", F.col("output_tokens") >= 0),
        "latency is negative": optional("latency_seconds", F.col("latency_seconds") >= 0),
    }


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
