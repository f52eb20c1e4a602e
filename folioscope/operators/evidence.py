"""Public evidence about papers: sections, project pages, repositories, citations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text, urls
from folioscope.functions.moments import instant
from folioscope.operators import scale

# ---- fixed values -------------------------------------------------------------------------
SECTION_SOURCE = "https://ar5iv.labs.arxiv.org/html/"
CODE_SUFFIXES = [".py", ".ipynb", ".cpp", ".c", ".rs", ".go", ".java", ".jl", ".m"]
CODE_FOLDERS = ["src", "source", "code", "implementation", "models"]
EVALUATION_WORDS = ["test", "eval", "experiment", "benchmark"]
DATA_WORDS = ["data", "dataset", "results", "metrics"]
FILE_NAME = r"^[A-Za-z0-9_. -]{1,160}$"
LISTING_LIMIT = 200
GRADE_SCORES = {
    "unknown": 0.0, "documentation_only": 0.2, "implementation": 0.6,
    "implementation_and_evaluation": 0.8, "implementation_data_and_evaluation": 1.0,
}
CONTENTS_PROVENANCE = "github-contents-v1"
PAGE_PROVENANCE = "abstract-project-page-v1"
FACT_CONFIDENCE, MAINTENANCE_CONFIDENCE = 0.8, 0.7
KNOWN_DAYS, UNKNOWN_DAYS, MAINTAINED_DAYS = 7, 1, 180
# -------------------------------------------------------------------------------------------


def sections(pages: DataFrame) -> DataFrame:
    """Section text of paper HTML; absent sections stay NULL."""
    return pages.select("paper_id", text.paper_sections("html").alias("_s")).select(
        "paper_id", F.concat(F.lit(SECTION_SOURCE), "paper_id").alias("source_url"), "_s.*"
    )


def available_sections() -> Column:
    """Names of the evidence fields a section row offers."""
    names = ("method", "evaluation", "limitations")
    return F.array_compact(
        F.array(*[F.when(F.col(n).isNotNull(), f"{n}_evidence") for n in names])
    )


def project_pages(
    candidates: DataFrame,
    probes: DataFrame,
    hosts: Sequence[str] = urls.EXACT_HOSTS,
    suffixes: Sequence[str] = urls.HOST_SUFFIXES,
) -> DataFrame:
    """Project page of every candidate from a table of probed links.

    The first reachable link wins; else the first link, false when all answered and NULL when one
    is unknown. No link leaves both columns NULL.
    """
    links = candidates.select(
        "paper_id",
        F.posexplode_outer(urls.project_urls(F.col("summary"), hosts, suffixes)).alias("_at", "url"),
    )
    probed = scale.left_join_spread(links, probes.select("url", "reachable"), "url")
    hit = F.when(F.col("reachable"), F.struct("_at", "url"))
    return (
        probed.groupBy("paper_id")
        .agg(
            F.min(hit).alias("_hit"),
            F.min(F.when(F.col("url").isNotNull(), F.struct("_at", "url"))).alias("_first"),
            F.count_if(F.col("reachable").isNull()).alias("_unknown"),
        )
        .select(
            "paper_id",
            F.coalesce("_hit.url", "_first.url").alias("url"),
            F.when(F.col("_hit").isNotNull(), True)
            .when(F.col("_first").isNull() | (F.col("_unknown") > 0), None)
            .otherwise(False)
            .alias("reachable"),
        )
    )


def grade_listings(listings: DataFrame, key: str = "repo") -> DataFrame:
    """Material grade of each repository from its top-level file names.

    Listings that are too long or hold an odd name are unknown.
    """
    name = F.lower("file_name")
    any_of = lambda words: F.bool_or(name.rlike("|".join(words)))
    endings = "(" + "|".join(s.replace(".", r"\.") for s in CODE_SUFFIXES) + ")$"
    flags = listings.groupBy(key).agg(
        F.bool_or(name.isin(CODE_FOLDERS) | name.rlike(endings)).alias("_code"),
        any_of(EVALUATION_WORDS).alias("_eval"),
        any_of(DATA_WORDS).alias("_data"),
        F.bool_and(F.col("file_name").rlike(FILE_NAME)).alias("_clean"),
        F.count(F.lit(1)).alias("_files"),
    )
    grade = (
        F.when(~F.col("_clean") | (F.col("_files") > LISTING_LIMIT), "unknown")
        .when(F.col("_code") & F.col("_eval") & F.col("_data"), "implementation_data_and_evaluation")
        .when(F.col("_code") & F.col("_eval"), "implementation_and_evaluation")
        .when(F.col("_code"), "implementation")
        .otherwise("documentation_only")
    )
    return flags.select(key, grade.alias("grade")).withColumn("material_score", grade_score())


def grade_score() -> Column:
    pairs = [F.lit(v) for pair in GRADE_SCORES.items() for v in pair]
    return F.create_map(*pairs)[F.col("grade")]


def repository_materials(pages: DataFrame, listings: DataFrame) -> DataFrame:
    """Material grade per paper through its reachable project page."""
    graded = grade_listings(listings).select(F.lower("repo").alias("_repo"), "grade")
    repo = F.when(F.col("reachable"), urls.repository_of(F.col("url")))
    joined = scale.left_join_spread(
        pages.withColumn("repository", repo).withColumn("_repo", F.lower("repository")), graded, "_repo"
    )
    return joined.select(
        "paper_id",
        F.coalesce(F.concat(F.lit("https://github.com/"), "repository"), "url").alias(
            "repository_url"
        ),
        F.coalesce("grade", F.lit("unknown")).alias("grade"),
        F.when(F.col("repository").isNull(), "linked-project-page")
        .otherwise(CONTENTS_PROVENANCE)
        .alias("provenance"),
    ).withColumn("material_score", grade_score())


def valid_evidence(cache: DataFrame, now, provider: str, adapter_version: str) -> DataFrame:
    """Cached evidence of one provider and adapter that has not expired."""
    return cache.filter(
        (F.col("provider") == provider)
        & (F.col("adapter_version") == adapter_version)
        & (F.col("expires_at") > instant(now))
    )


def single_valid_evidence(cache: DataFrame, now) -> DataFrame:
    """Unexpired evidence of papers that have exactly one such row, whatever its provider."""
    alive = cache.filter(F.col("expires_at") > instant(now))
    counted = alive.groupBy("paper_id").agg(
        F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*alive.columns)).alias("_row")
    )
    return counted.filter("_n = 1").select("_row.*")


def _fact(claim: Column, provider: str, at: Column, confidence: float = FACT_CONFIDENCE) -> Column:
    known = claim.isNotNull()
    return F.struct(
        F.when(known, "available").otherwise("unknown").alias("availability"),
        F.when(known, confidence).otherwise(0.0).alias("confidence"),
        at.alias("observed_at"),
        F.lit(provider).alias("provider"),
        claim.alias("claim"),
    )


def citation_context(candidates: DataFrame, works: DataFrame, now, provider: str = "openalex"):
    """Citation counts, open access and retraction by exact DOI; no match is unknown.

    ``works`` has ``doi``, ``cited_by_count``, ``referenced_works_count``, ``is_oa``,
    ``is_retracted``. Of works that repeat a DOI the greatest row counts, column by column.
    """
    at = instant(now)
    known = works.filter(F.col("doi").isNotNull())
    one_each = scale.latest_by(known, ["doi"], [F.col(c) for c in known.columns if c != "doi"])
    joined = scale.left_join_spread(
        candidates.select("paper_id", "doi"), one_each.withColumn("_found", F.lit(True)), "doi"
    )
    found = F.coalesce("_found", F.lit(False))
    return joined.select(
        F.concat(F.lit("arxiv:"), "paper_id").alias("paper_id"),
        F.lit(provider).alias("provider"),
        F.lit("v1").alias("adapter_version"),
        at.alias("observed_at"),
        F.when(found, at + F.expr(f"INTERVAL {KNOWN_DAYS} DAYS"))
        .otherwise(at + F.expr(f"INTERVAL {UNKNOWN_DAYS} DAYS"))
        .alias("expires_at"),
        F.struct(
            F.col("cited_by_count").alias("citation_count"),
            F.col("referenced_works_count").alias("reference_count"),
            _fact(F.col("is_oa"), provider, at).alias("open_access"),
            _fact(F.col("is_retracted"), provider, at).alias("retracted"),
        ).alias("context"),
    )


def repository_facts(pages: DataFrame, repositories: DataFrame, now, provider: str = "github"):
    """License, archive, wiki and maintenance facts by ``owner/name``; no match is unknown.

    ``repositories`` has ``full_name``, ``has_license``, ``archived``, ``has_wiki``, ``pushed_at``.
    """
    at = instant(now)
    named = repositories.withColumn("_repo", F.lower("full_name")).filter(F.col("_repo").isNotNull())
    facts = scale.latest_by(
        named, ["_repo"], [F.col(c) for c in ("pushed_at", "full_name", "has_license", "archived", "has_wiki")])
    joined = scale.left_join_spread(
        pages.withColumn("_repo", F.lower(urls.repository_of(F.col("url")))),
        facts.withColumn("_found", F.lit(True)), "_repo",
    )
    found = F.coalesce("_found", F.lit(False))
    window = F.expr(f"INTERVAL {MAINTAINED_DAYS} DAYS")
    maintained = F.col("pushed_at") >= at - window
    none = F.lit(None).cast("boolean")
    return joined.select(
        "paper_id",
        F.when(found, F.col("url")).alias("repository_url"),
        _fact(F.when(found, F.col("has_license")), provider, at).alias("license_present"),
        _fact(F.when(found, F.col("archived")), provider, at).alias("archived"),
        _fact(none, provider, at).alias("releases"),
        _fact(F.when(found, F.col("has_wiki")), provider, at).alias("documentation"),
        _fact(F.when(found, maintained), provider, at, MAINTENANCE_CONFIDENCE).alias("maintained"),
        at.alias("observed_at"),
        F.when(found, at + F.expr(f"INTERVAL {KNOWN_DAYS} DAYS"))
        .otherwise(at + F.expr(f"INTERVAL {UNKNOWN_DAYS} DAYS"))
        .alias("expires_at"),
    )


def page_features(pages: DataFrame) -> DataFrame:
    """Reachability as a ranking feature; unknown is not applicable (P20)."""
    known = F.col("url").isNotNull() & F.col("reachable").isNotNull()
    return pages.select(
        "paper_id",
        F.lit("accessible_project_page").alias("name"),
        F.when(F.coalesce("reachable", F.lit(False)), 1.0).otherwise(0.0).alias("value"),
        known.alias("applicable"),
        F.when(known, 1.0).otherwise(0.0).alias("confidence"),
        F.lit(PAGE_PROVENANCE).alias("provenance"),
        F.lit("reproducibility").alias("grp"),
    )


def material_features(materials: DataFrame) -> DataFrame:
    """Implementation material as a ranking feature."""
    known = F.col("grade") != "unknown"
    return materials.select(
        "paper_id",
        F.lit("implementation_material").alias("name"),
        F.col("material_score").alias("value"),
        known.alias("applicable"),
        F.when(known, 1.0).otherwise(0.0).alias("confidence"),
        "provenance",
        F.lit("reproducibility").alias("grp"),
    )
