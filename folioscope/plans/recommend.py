"""Whole recommendation runs as one lazy graph over tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators import evidence, exchange, pool, ranking, selection
from folioscope.operators.weights import QUALITY_FIRST
from folioscope.session import materialized

# ---- fixed values -------------------------------------------------------------------------
PROPOSAL_QUALITY = 0.5
# -------------------------------------------------------------------------------------------


def identity_matches():
    """Which watched identities a candidate met."""
    names = ("watched_author", "watched_institution")
    return F.array_compact(F.array(*[F.when(F.col(n) > 0, n) for n in names]))


def proposal_records(selected: DataFrame, proposals: DataFrame) -> DataFrame:
    """Selected papers with a good enough proposal, in reading order."""
    keys = [k for k in ("profile_id", "paper_id") if k in proposals.columns]
    good = proposals.filter(F.col("quality") >= PROPOSAL_QUALITY)
    joined = selected.join(good, keys).withColumn("identity_matches", identity_matches())
    return ranking.reading_order(joined.drop("rank"))


def recommend(
    pairs: DataFrame,
    profiles: DataFrame,
    proposals: DataFrame,
    now,
    *,
    history: DataFrame | None = None,
    weights: Mapping = QUALITY_FIRST,
    pre_rank_limit: int = 60,
    baseline: bool = False,
    **bonuses: float,
) -> DataFrame:
    """Suppress, score, shortlist, select and join validated proposals.

    ``pairs`` without a ``profile_id`` are the pool, one row per candidate: only pairs that can enter a
    shortlist are built then.
    """
    eligible = pairs if history is None else pool.suppress(pairs, history, now)
    score = ranking.score_baseline if baseline else ranking.score_candidates
    options = bonuses if baseline else {"weights": weights, **bonuses}
    scored = _scored(eligible, profiles, now, pre_rank_limit, score, options)
    choose = selection.select_baseline if baseline else selection.select_diverse
    return proposal_records(choose(scored, pre_rank_limit=pre_rank_limit), proposals)


def _scored(eligible: DataFrame, profiles: DataFrame, now, limit: int, score, options) -> DataFrame:
    """All given pairs scored, or the ranked shortlists of a pool."""
    if "profile_id" in eligible.columns:
        return score(eligible, profiles, now, **options)
    return ranking.pool_shortlist(eligible, profiles, now, limit, score=score, **options)


def refined_shortlist(
    pairs: DataFrame, profiles: DataFrame, now, *, history=None, pre_rank_limit: int = 60, **bonuses
) -> DataFrame:
    """Feature rows of each reader's shortlist: the only candidates a judge looks at."""
    eligible = pairs if history is None else pool.suppress(pairs, history, now)
    scored = _scored(eligible, profiles, now, pre_rank_limit, ranking.score_candidates, bonuses)
    short = scored if "rank" in scored.columns else ranking.shortlist(scored, pre_rank_limit)
    return ranking.unscored(short)


def recommend_refined(
    pairs: DataFrame,
    profiles: DataFrame,
    now,
    *,
    judgments: DataFrame,
    explanations: DataFrame,
    sections: DataFrame,
    pages: DataFrame,
    materials: DataFrame,
    history: DataFrame | None = None,
    weights: Mapping = QUALITY_FIRST,
    pre_rank_limit: int = 60,
    limits: dict | None = None,
    **bonuses: float,
) -> dict[str, DataFrame]:
    """The judged path: shortlist on local features, then score again with evidence.

    The shortlist is cut before any evidence joins, so those joins meet at most ``pre_rank_limit``
    rows per reader; evidence tables are read as they are, whoever fills them.
    """
    short = materialized(
        refined_shortlist(
            pairs, profiles, now, history=history, pre_rank_limit=pre_rank_limit, **bonuses
        ),
        "shortlist",
    )
    extras = (
        exchange.judgment_features(judgments)
        .unionByName(evidence.page_features(pages))
        .unionByName(evidence.material_features(materials))
    )
    judged_ids = judgments.select("paper_id").distinct()
    sums = ranking.extra_feature_sums(extras.join(judged_ids, "paper_id", "left_semi"), ["paper_id"])
    judged = ranking.score_features(short.join(sums, "paper_id", "left"), weights)
    valued = judged.join(exchange.value_assessments(judgments), "paper_id", "left")
    limits = limits or selection.policy()
    filtered = valued.filter(selection.value_rejected(limits))
    chosen = selection.select_diverse(valued, limits=limits, pre_rank_limit=pre_rank_limit)
    facts = (
        judgments.select(
            "paper_id", exchange.judged_quality().alias("quality"), "uncertainty",
            F.col("evidence_fields").alias("quality_evidence_fields"),
        )
        .join(
            explanations.select("paper_id", "summary", "reason", "limitation"), "paper_id"
        )
        .join(
            sections.select("paper_id", (F.size(evidence.available_sections()) > 0).alias("_sections")),
            "paper_id",
        )
        .join(materials.select("paper_id", "grade", "provenance", "material_score"), "paper_id")
    )
    known = F.col("grade") != "unknown"
    records = (
        chosen.drop("rank", "summary")
        .join(facts, "paper_id")
        .withColumn("identity_matches", identity_matches())
        .withColumn("reproducibility", F.when(known, F.col("material_score")))
        .withColumn("reproducibility_evidence", F.col("grade"))
        .withColumn(
            "evidence_provenance",
            F.array_compact(
                F.array(
                    F.lit("arxiv-metadata"),
                    F.when(F.col("_sections"), "ar5iv-sections-v1"),
                    F.when(known, F.col("provenance")),
                )
            ),
        )
        .drop("_sections", "grade", "provenance", "material_score")
    )
    return {
        "shortlist": short,
        "records": ranking.reading_order(records),
        "value_filtered": filtered,
    }


def run_manifest(
    records: DataFrame,
    candidates: DataFrame,
    usage: DataFrame,
    *,
    model: str,
    weight_set_version: str,
    started_at,
    completed_at,
    price_per_token: float | None = None,
) -> DataFrame:
    """Counts, tokens and cost of each run in one row (A30). All inputs carry ``run_id``."""
    from folioscope.functions.moments import instant

    counted = lambda df, name: df.groupBy("run_id").agg(F.count(F.lit(1)).alias(name))
    totals = exchange.usage_totals(usage)
    row = (
        totals.join(counted(candidates, "candidate_count"), "run_id", "left")
        .join(counted(records, "recommendation_count"), "run_id", "left")
        .fillna(0, ["candidate_count", "recommendation_count"])
    )
    start, end = instant(started_at), instant(completed_at)
    actual = F.col("actual_input") + F.col("actual_output")
    price = F.lit(price_per_token).cast("double")
    estimated = F.col("estimated_input") + F.col("estimated_output")
    return row.select(
        "run_id",
        F.lit(1).alias("schema_version"),
        F.lit(model).alias("model"),
        "candidate_count",
        "recommendation_count",
        F.col("requests").alias("model_requests"),
        "cache_hits",
        estimated.alias("estimated_tokens"),
        F.coalesce(estimated * price, F.lit(0.0)).alias("estimated_cost_usd"),
        ((F.unix_micros(end) - F.unix_micros(start)) / 1e6).alias("duration_seconds"),
        start.alias("generation_started_at"),
        end.alias("generation_completed_at"),
        F.col("estimated_input").alias("estimated_input_tokens"),
        F.col("estimated_output").alias("estimated_output_tokens"),
        F.col("actual_input").alias("actual_input_tokens"),
        F.col("actual_output").alias("actual_output_tokens"),
        (actual * price).alias("actual_cost_usd"),
        F.col("latency").alias("provider_latency_seconds"),
        "retry_count",
        F.lit(weight_set_version).alias("weight_set_version"),
    )
