"""Run-manifest history and efficiency comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import hashing
from folioscope.operators import scale

# ---- fixed values -------------------------------------------------------------------------
HISTORY_LIMIT = 90
OUTPUT_REDUCTION_TARGET = 0.25
# -------------------------------------------------------------------------------------------


def record_manifest(history: DataFrame, manifest: DataFrame, limit: int = HISTORY_LIMIT):
    """History with the new manifests appended once, newest ``limit`` kept.

    ``recorded_at`` orders the history; a manifest equal in content to a kept one is dropped.
    """
    if limit < 1:
        raise ValueError("the history limit must be positive")
    body = hashing.content_hash([c for c in sorted(history.columns) if c != "recorded_at"])
    old = history.withColumn("_h", body)
    new = manifest.select(*history.columns).withColumn("_h", body)
    unseen = new.join(old.select("_h").distinct(), "_h", "left_anti").dropDuplicates(["_h"])
    both = old.unionByName(unseen.select(*old.columns))
    return scale.top_rows(both, [F.col("recorded_at").desc(), F.col("_h")], limit).drop("_h")


def aggregate_manifests(manifests: DataFrame, by: Sequence[str] = ("side",)) -> DataFrame:
    """Exact medians and counts per side, measured runs only where usage matters.

    Several models on one side are an error.
    """
    n = F.col("recommendation_count")
    measured = (
        F.col("actual_input_tokens").isNotNull()
        & F.col("actual_output_tokens").isNotNull()
        & (n > 0)
    )
    per = lambda c: F.when(measured, c / n)
    tokens_in, tokens_out = F.col("actual_input_tokens"), F.col("actual_output_tokens")
    measures = {
        "median_output_tokens_per_recommendation": per(tokens_out),
        "median_input_tokens_per_recommendation": per(tokens_in),
        "median_total_tokens_per_recommendation": per(tokens_in + tokens_out),
        "median_duration_seconds": F.when(measured, F.col("duration_seconds")),
        "median_provider_latency_seconds": F.when(measured, F.col("provider_latency_seconds")),
        "median_cost_usd_per_recommendation": per(F.col("actual_cost_usd")),
        "median_model_requests": F.col("model_requests"),
        "median_cache_hits": F.col("cache_hits"),
    }
    counts = manifests.groupBy(*by).agg(
        F.when(F.min("model").eqNullSafe(F.max("model")), F.min("model")).otherwise(
            F.raise_error(F.lit("one side has runs of several models"))).alias("model"),
        F.count(F.lit(1)).alias("run_count"),
        F.count_if(measured).alias("measured_run_count"),
        F.sum(n).cast("long").alias("recommendation_count_total"),
        (F.min("model") == F.max("model")).alias("one_model"),
    )
    return counts.join(scale.exact_medians(manifests, by, measures), list(by), "left")


def relative_change(base: Column, other: Column) -> Column:
    """``(base - other) / base``, NULL when unknown or undefined."""
    return F.when(base != 0, (base - other) / base)


def compare_efficiency(sides: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """Relative changes and the output-token gate between two sides."""
    columns = [c for c in sides.columns if c != "side"]
    pick = lambda name, p: sides.filter(F.col("side") == name).select(
        F.lit(1).alias("_one"), *[F.col(c).alias(p + c) for c in columns]
    )
    row = pick(baseline, "b_").join(pick(candidate, "c_"), "_one")
    change = lambda c: relative_change(F.col(f"b_median_{c}"), F.col(f"c_median_{c}"))
    reduction = change("output_tokens_per_recommendation")
    meets = F.coalesce(reduction >= OUTPUT_REDUCTION_TARGET, F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("b_model") != F.col("c_model"), "baseline and candidate models differ"),
            F.when(
                (F.col("b_measured_run_count") == 0) | (F.col("c_measured_run_count") == 0),
                "one side has no measured token usage",
            ),
            F.when(reduction.isNull(), "output-token reduction is unavailable").when(
                ~meets, "median output-token reduction is below the 25% target"
            ),
        )
    )
    return row.select(
        reduction.alias("output_token_reduction"),
        change("input_tokens_per_recommendation").alias("input_token_change"),
        change("duration_seconds").alias("duration_change"),
        change("cost_usd_per_recommendation").alias("cost_change"),
        meets.alias("meets_output_token_target"),
        (F.size(reasons) == 0).alias("comparable"),
        reasons.alias("reasons"),
    )
