"""Feature groups, weight sets and their ablations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------
GROUPS = [
    "interest", "recency", "feedback", "identity", "scientific_quality", "reproducibility",
    "context",
]
GENERIC_WEIGHTS = {
    "interest": 0.5, "recency": 0.1, "feedback": 0.15, "identity": 0.1,
    "scientific_quality": 0.07, "reproducibility": 0.03, "context": 0.05,
    "negative_feedback_cap": 0.2,
}
QUALITY_FIRST = {
    "version": "quality-first-v1", "interest": 0.40, "recency": 0.05, "feedback": 0.0,
    "identity": 0.10, "scientific_quality": 0.35, "reproducibility": 0.10, "context": 0.0,
    "negative_feedback_cap": 0.2, "ablation": False,
}
INTEREST_IMPORTANCE = {"lexical": 0.55, "category": 0.3, "facet": 0.15}
BASELINE_VERSION = "v0.1.2"
# -------------------------------------------------------------------------------------------

WEIGHT_SCHEMA = (
    "version string, " + ", ".join(f"{g} double" for g in GROUPS)
    + ", negative_feedback_cap double, ablation boolean"
)


def weight_set(version: str, **groups: float) -> dict:
    """A complete weight set; groups left out take the generic weights."""
    return {"version": version, **GENERIC_WEIGHTS, "ablation": False, **groups}


def without(weights: Mapping, group: str) -> dict:
    """The same set with one group left out of normalization (M4)."""
    if group not in GROUPS:
        raise ValueError(f"unknown feature group {group}")
    return {
        **weights, "version": f"{weights['version']}-without-{group}", group: 0.0,
        "ablation": True,
    }


def ablations(weights: Mapping) -> list[dict]:
    """One derived set per group that carries weight."""
    return [without(weights, g) for g in GROUPS if weights[g] > 0]


def weight_table(spark: SparkSession, sets: Sequence[Mapping]) -> DataFrame:
    """Weight sets as a table."""
    names = [part.split()[0] for part in WEIGHT_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(s[n] for n in names) for s in sets], WEIGHT_SCHEMA)


def weight_literals(sets: Sequence[Mapping]) -> Column:
    """The few weight sets of one evaluation as an array literal, so no join is needed."""
    return F.array(
        *[
            F.struct(
                F.lit(s["version"]).alias("version"),
                *[F.lit(float(s[g])).alias(g) for g in GROUPS],
            )
            for s in sets
        ]
    )
