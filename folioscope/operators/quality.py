"""Quality reference profiles from approved examples and explicit outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import hashing
from folioscope.operators import ledger
from folioscope.session import materialized

# ---- fixed values -------------------------------------------------------------------------
TRAITS = {
    "research_problems": [
        "agents", "evaluation", "generative_modeling", "optimization", "representation_learning",
        "retrieval", "systems",
    ],
    "methodological_expectations": [
        "ablations", "baselines", "resource_accounting", "robustness", "statistical_validation",
        "theoretical_justification",
    ],
    "evidence_standards": [
        "error_analysis", "held_out_evaluation", "public_data", "reproducible_implementation",
        "uncertainty_reporting",
    ],
    "motivations": ["efficiency", "explanatory_insight", "practical_utility", "scientific_novelty"],
    "tolerated_limitations": [
        "limited_scale", "missing_code", "narrow_domain", "preliminary_theory", "synthetic_data",
    ],
}
# version, judge contract, roles in trait order, generation, reference evidence, descriptive sent
POLICIES = [
    ("quality-reference-policy-legacy-v1", "judge-v3",
     ["descriptive", "positive_reference", "positive_reference", "descriptive", "limitation_context"],
     False, True, True),
    ("quality-reference-policy-v1", "judge-v4",
     ["descriptive", "positive_reference", "positive_reference", "descriptive", "limitation_context"],
     True, False, False),
    ("quality-reference-policy-v2", "judge-v5",
     ["descriptive", "evaluation_reference", "evaluation_reference", "descriptive",
      "limitation_context"],
     True, False, False),
]
DEFAULT_POLICY = "quality-reference-policy-v2"
GAIN_OUTCOMES = ["interested", "read", "worthwhile"]
LOSS_OUTCOMES = ["not_interested", "not_worthwhile"]
START_WEIGHT, GAIN, LOSS, FLOOR = 1.0, 1.0, -0.5, 0.25
# -------------------------------------------------------------------------------------------


def policy_table(spark) -> DataFrame:
    """Role of every trait field under every registered policy."""
    rows = [
        (version, contract, field, role, generation, evidence, sent)
        for version, contract, roles, generation, evidence, sent in POLICIES
        for field, role in zip(TRAITS, roles, strict=True)
    ]
    return spark.createDataFrame(
        rows,
        "policy_version string, judge_contract string, field string, role string, "
        "generation_enabled boolean, reference_evidence_allowed boolean, "
        "descriptive_fields_sent boolean",
    )


def _tagged(field: str):
    return lambda trait: F.struct(F.lit(field).alias("field"), trait.alias("trait"))


def long_traits(examples: DataFrame) -> DataFrame:
    """Examples in long form: one row per paper, field and trait."""
    return examples.select(
        "paper_id",
        "approved",
        F.explode(
            F.flatten(
                F.array(
                    *[
                        F.transform(
                            F.coalesce(F.col(f), F.array().cast("array<string>")), _tagged(f)
                        )
                        for f in TRAITS
                    ]
                )
            )
        ).alias("_t"),
    ).select("paper_id", "approved", "_t.field", "_t.trait")


def outcome_step() -> Column:
    """Weight change of an outcome; neutral outcomes change nothing."""
    return (
        F.when(F.col("outcome").isin(GAIN_OUTCOMES), GAIN)
        .when(F.col("outcome").isin(LOSS_OUTCOMES), LOSS)
        .otherwise(0.0)
    )


def explicit_feedback(papers: DataFrame, feedback: DataFrame) -> DataFrame:
    """Unsuperseded outcomes and corrections on approved papers."""
    spoken = ledger.effective(feedback).filter(
        F.col("event_type").isin("outcome", "correction") & F.col("outcome").isNotNull()
    )
    return spoken.join(papers.select("paper_id"), "paper_id", "left_semi")


def trait_support(traits: DataFrame, papers: DataFrame, explicit: DataFrame) -> DataFrame:
    """Support of every trait: summed paper weights over the field's largest sum.

    ``papers`` holds the approved paper ids, one row each; ``explicit`` their counted feedback.
    """
    steps = explicit.withColumn("delta", outcome_step())
    folded = ledger.clamped_weights(steps, "paper_id", start=START_WEIGHT, floor=FLOOR)
    weights = papers.select("paper_id").join(folded, "paper_id", "left").select(
        "paper_id", F.coalesce("weight", F.lit(START_WEIGHT)).alias("weight")
    )
    summed = (
        traits.filter("approved")
        .join(weights, "paper_id")
        .groupBy("field", "trait")
        .agg(F.sum("weight").alias("_sum"))
    )
    most = summed.groupBy("field").agg(F.max("_sum").alias("_most"))
    return summed.join(most, "field").select(
        "field", F.col("trait").alias("name"),
        F.bround(F.col("_sum") / F.col("_most"), 6).alias("support"),
    )


def duplicate_approvals(examples: DataFrame) -> DataFrame:
    """Approved papers listed more than once; any row is an error."""
    return (
        examples.filter("approved")
        .groupBy("paper_id")
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
    )


def quality_reference(
    examples: DataFrame, feedback: DataFrame, policy_version: str = DEFAULT_POLICY
) -> DataFrame:
    """Criteria of a content-named profile version."""
    enabled = {p[0] for p in POLICIES if p[3]}
    if policy_version not in enabled:
        raise ValueError("policy version is unavailable for generation")
    if duplicate_approvals(examples).limit(1).count():
        raise ValueError("an approved paper is listed twice")
    papers = examples.filter("approved").select("paper_id")
    explicit = materialized(explicit_feedback(papers, feedback), "explicit-feedback")
    support = materialized(
        trait_support(long_traits(examples), papers, explicit), "trait-support"
    )
    one = F.lit(1).alias("_one")
    digest = hashing.set_digest(support, hashing.content_hash(["field", "name", "support"]))
    approved_count = papers.agg(F.count(F.lit(1)).alias("approved_example_count"))
    event_count = explicit.agg(F.count(F.lit(1)).alias("explicit_feedback_event_count"))
    header = (
        digest.select("digest", one)
        .join(approved_count.select("*", one), "_one")
        .join(event_count.select("*", one), "_one")
    )
    seed = F.concat_ws(
        "|", F.lit(policy_version), "digest", F.col("approved_example_count").cast("string"),
        F.col("explicit_feedback_event_count").cast("string"),
    )
    named = header.select(
        F.concat(F.lit("quality-profile-"), F.left(F.sha2(seed, 256), F.lit(16))).alias(
            "profile_version"
        ),
        F.lit(policy_version).alias("policy_version"),
        "approved_example_count",
        "explicit_feedback_event_count",
        "_one",
    )
    return support.withColumn("_one", F.lit(1)).join(named, "_one").drop("_one")


def model_criteria(criteria: DataFrame) -> DataFrame:
    """Criteria a judge may see: descriptive fields stay behind unless the policy sends them."""
    roles = policy_table(criteria.sparkSession).select(
        "policy_version", "field", "role", "descriptive_fields_sent"
    )
    return (
        criteria.join(F.broadcast(roles), ["policy_version", "field"])
        .filter(F.col("descriptive_fields_sent") | (F.col("role") != "descriptive"))
        .drop("role", "descriptive_fields_sent")
    )
