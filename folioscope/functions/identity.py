"""Exact paper identities: preprint numbers, DOIs and their aliases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------
MODERN_ID = r"^(\d{4}\.\d{4,5})(?:v(\d+))?$"
LEGACY_ID = r"(?i)^([a-z-]+(?:\.[A-Z]{2})?/\d{7})(?:v(\d+))?$"
ANY_ID = r"(?i)^((?:\d{4}\.\d{4,5}|[a-z-]+(?:\.[a-z]{2})?/\d{7}))(?:v\d+)?$"
DOI = r"(?iU)^10\.\d{4,9}/\S+$"
STRICT_DOI = r"(?i)^10\.\d{4,9}/[-._;()/:a-z0-9]+$"
ALIAS_DOI = r"(?i)^10\.48550/arxiv\.(\d{4}\.\d{4,5}(?:v\d+)?)$"
TEXT_URL = r"(?i)https?://(?:www\.)?arxiv\.org/(?:abs|pdf)/([^?#\s]+)"
TEXT_MARKER = r"(?i)\barxiv\s*:\s*([^\s,;\)\]}]+)"
TEXT_DOI = r"(?i)\b10\.48550/arxiv\.(\d{4}\.\d{4,5}(?:v\d+)?)\b"
ABSTRACT_URL = "https://arxiv.org/abs/"
PDF_URL = "https://arxiv.org/pdf/"
# -------------------------------------------------------------------------------------------


def _nonempty(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def strip(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def _bare_id(value: Column) -> Column:
    no_scheme = F.regexp_replace(strip(value), r"^arXiv:", "")
    return F.regexp_replace(no_scheme, r"^https://arxiv\.org/abs/", "")


def paper_id(value: Column) -> Column:
    """Canonical key of a preprint number, NULL when malformed."""
    bare = _bare_id(value)
    return F.lower(
        F.coalesce(
            _nonempty(F.regexp_extract(bare, MODERN_ID, 1)),
            _nonempty(F.regexp_extract(bare, LEGACY_ID, 1)),
        )
    )


def revision(value: Column) -> Column:
    """Revision number carried by a preprint number, if any."""
    bare = _bare_id(value)
    digits = F.coalesce(
        _nonempty(F.regexp_extract(bare, MODERN_ID, 2)),
        _nonempty(F.regexp_extract(bare, LEGACY_ID, 2)),
    )
    return digits.cast("int")


def abstract_url(key: Column) -> Column:
    return F.concat(F.lit(ABSTRACT_URL), key)


def pdf_url(key: Column) -> Column:
    return F.concat(F.lit(PDF_URL), key)


def doi(value: Column) -> Column:
    """Normalized DOI, NULL when malformed."""
    bare = F.lower(strip(value))
    for prefix in (r"^doi:", r"^https://doi\.org/", r"^http://doi\.org/"):
        bare = F.regexp_replace(bare, prefix, "")
    return F.when(bare.rlike(DOI), bare)


def _without_revision(value: Column) -> Column:
    return F.regexp_replace(value, r"v\d+$", "")


def _alias_of(doi_text: Column) -> Column:
    return _nonempty(F.regexp_extract(doi_text, ALIAS_DOI, 1))


def canonical_identity(value: Column) -> Column:
    """Alias-aware identity; text that is neither form stays as it is (I4)."""
    low = F.lower(strip(value))
    number = paper_id(F.substring(low, 7, 1 << 30))
    alias = _alias_of(F.regexp_replace(low, r"^doi:", ""))
    return (
        F.when(low.startswith("arxiv:"), F.coalesce(F.concat(F.lit("arxiv:"), number), low))
        .when(alias.isNotNull(), F.concat(F.lit("arxiv:"), _without_revision(alias)))
        .otherwise(low)
    )


def corpus_identity(value: Column) -> Column:
    """Identity of a label-import identifier, NULL when it is neither form (I4)."""
    low = F.lower(strip(value))
    alias = _alias_of(F.regexp_replace(low, r"^doi:", ""))
    return (
        F.when(
            low.startswith("arxiv:") & (F.length(low) > 6),
            F.concat(F.lit("arxiv:"), _without_revision(F.substring(low, 7, 1 << 30))),
        )
        .when(alias.isNotNull(), F.concat(F.lit("arxiv:"), _without_revision(alias)))
        .when(low.startswith("doi:") & (F.length(low) > 4), low)
        .when(low.rlike(STRICT_DOI), F.concat(F.lit("doi:"), low))
    )


def preprint_identity(value: Column) -> Column:
    """Preprint number behind an identifier or its alias DOI, else NULL (I4, third form)."""
    low = F.lower(strip(value))
    return F.when(low.startswith("arxiv:"), paper_id(F.substring(low, 7, 1 << 30))).otherwise(
        F.nullif(_without_revision(_alias_of(F.regexp_replace(low, r"^doi:", ""))), F.lit(""))
    )


def preprints_in_text(text: Column) -> Column:
    """Distinct ``arxiv:`` identifiers named by URLs, markers or alias DOIs in free text."""
    raw = F.concat(
        *[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (TEXT_URL, TEXT_MARKER, TEXT_DOI)]
    )
    trimmed = F.transform(
        raw,
        lambda v: F.regexp_replace(
            F.lower(F.regexp_replace(strip(v), r"[.,;:)\]}]+$", "")), r"\.pdf$", ""
        ),
    )
    numbers = F.transform(trimmed, lambda v: F.regexp_extract(v, ANY_ID, 1))
    kept = F.filter(numbers, lambda v: v != "")
    return F.array_distinct(F.transform(kept, lambda v: F.concat(F.lit("arxiv:"), v)))


def identity_from_tags(tags: Column, identifiers: Column, prefix: str = "ranking-paper-id:"):
    """First tag override that resolves, else the first identifier that does."""
    tagged = F.filter(tags, lambda t: F.lower(t).startswith(prefix))
    from_tags = F.transform(tagged, lambda t: corpus_identity(F.substring(t, len(prefix) + 1, 1 << 30)))
    from_ids = F.transform(identifiers, corpus_identity)
    candidates = F.filter(F.concat(from_tags, from_ids), lambda v: v.isNotNull())
    return F.try_element_at(candidates, F.lit(1))
