"""Frozen splits, ranking metrics, comparisons and ablation reports."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import hashing, identity, text
from folioscope.functions.moments import days_before, instant
from folioscope.operators import scale
from folioscope.operators.weights import BASELINE_VERSION
from folioscope.session import materialized

# ---- fixed values -------------------------------------------------------------------------
SPLITS = ["stable-anchor", "rolling", "temporal-holdout", "temporal-train", "pairwise"]
NDCG_TARGET = 0.05
RECALL_TARGET = 0.95
FEW_LABELS = 5
FACET_TOKENS = 12
# -------------------------------------------------------------------------------------------


def missing_anchors(labels: DataFrame, anchors: DataFrame) -> DataFrame:
    """Anchor papers without a label (E7); any row here is an error."""
    return anchors.select("paper_id").join(labels, "paper_id", "left_anti")


def make_splits(
    labels: DataFrame,
    pairwise: DataFrame,
    cutoff,
    *,
    anchors: DataFrame | None = None,
    rolling_days: int = 90,
    holdout_ratio: float = 0.2,
) -> DataFrame:
    """The five frozen splits with positions (C14).

    The holdout is the latest ``ceil(n * ratio)`` labels by time and paper (W6); the rolling
    split reaches back from the cutoff (W7).
    """
    if rolling_days < 1 or not 0 < holdout_ratio < 1:
        raise ValueError("rolling days and holdout ratio are outside their bounds")
    if anchors is not None and missing_anchors(labels, anchors).limit(1).count():
        raise ValueError("an anchor paper has no label")
    count = labels.count()
    held = math.ceil(count * holdout_ratio)
    timed = scale.position_within(
        labels.select("paper_id", "resolved_at"), [], ["resolved_at", "paper_id"]
    )
    is_held = F.col("position") > count - held
    temporal = timed.select(
        F.when(is_held, "temporal-holdout").otherwise("temporal-train").alias("split"),
        F.when(is_held, F.col("position") - (count - held))
        .otherwise(F.col("position"))
        .alias("position"),
        "paper_id",
    )
    start = days_before(instant(cutoff), rolling_days)
    named = labels.filter(F.col("resolved_at") >= start).select(
        F.lit("rolling").alias("split"), "paper_id"
    )
    sides = pairwise.select(F.explode(F.array("paper_id", "compared_paper_id")).alias("paper_id"))
    named = named.unionByName(
        sides.filter(F.col("paper_id").isNotNull())
        .distinct()
        .select(F.lit("pairwise").alias("split"), "paper_id")
    )
    if anchors is not None:
        named = named.unionByName(anchors.select(F.lit("stable-anchor").alias("split"), "paper_id"))
    placed = scale.position_within(named, ["split"], ["paper_id"]).select(
        "split", "position", "paper_id"
    )
    return temporal.unionByName(placed)


def snapshot_id(splits: DataFrame, header: DataFrame) -> DataFrame:
    """Content-derived snapshot id over the corpus digest and the frozen splits."""
    rows = hashing.set_digest(
        splits, hashing.content_hash(["split", "position", "paper_id"]), (), "_splits"
    )
    one = F.lit(1).alias("_one")
    seed = F.concat_ws(
        "|", F.col("revision").cast("string"), "digest", F.col("cutoff_at").cast("string"),
        "_splits",
    )
    return (
        header.select("*", one)
        .join(rows.select("*", one), "_one")
        .select(hashing.short_id("eval-", seed).alias("snapshot_id"), *header.columns)
    )


def title_facets() -> Column:
    """The first ranking tokens of a title."""
    return F.slice(text.ranking_words(F.col("title")), 1, FACET_TOKENS)


def ranked_papers(scored: DataFrame, ranking: Column) -> DataFrame:
    """Scored candidates as rows of an offline ranking (O12), with one ``score`` or the ``scores`` of
    several versions.

    ``facets`` are those of the title, unless the candidates carry them: a paper ranked for many readers
    is then tokenized once, before it is paired.
    """
    return scored.select(
        ranking.alias("ranking_id"),
        F.concat(F.lit("arxiv:"), "paper_id").alias("paper_id"),
        "scores" if "scores" in scored.columns else "score",
        "source",
        F.try_element_at("categories", F.lit(1)).alias("category"),
        F.col("facets") if "facets" in scored.columns else title_facets().alias("facets"),
        F.when(F.col("doi").isNotNull(), F.array(F.concat(F.lit("doi:"), "doi")))
        .otherwise(F.array().cast("array<string>"))
        .alias("identifiers"),
    )


def _aliases(ranked: DataFrame) -> DataFrame:
    names = F.concat(F.array("paper_id"), F.coalesce("identifiers", F.array().cast("array<string>")))
    canonical = F.array_distinct(F.transform(names, identity.canonical_identity))
    return ranked.select("ranking_id", "paper_id", "scores", F.explode(canonical).alias("id"))


def split_labels(labels: DataFrame, splits: DataFrame) -> DataFrame:
    """Canonical label rows of every split."""
    named = labels.filter(F.col("label").isNotNull()).select(
        identity.canonical_identity(F.col("paper_id")).alias("id"), "label", "paper_id"
    )
    one_each = named.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("_other"))
    one_each = _agreed(one_each, F.col("label") == F.col("_other"), "labels disagree on ", "id").drop("_other")
    members = splits.select(
        "split", identity.canonical_identity(F.col("paper_id")).alias("id")
    ).distinct()
    return members.join(one_each, "id")


def _agreed(rows: DataFrame, agreed: Column, message: str, name: str) -> DataFrame:
    """Rows, or an error at the first that does not agree. A filter, so that no plan leaves it out."""
    return rows.filter(F.when(agreed, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit(message), F.col(name))).cast("boolean")))


def _labels_of_items(labelled_aliases: DataFrame) -> DataFrame:
    score = "scores" if "scores" in labelled_aliases.columns else "score"
    return (
        labelled_aliases.groupBy("split", "ranking_id", "paper_id", score)
        .agg(F.min("label").alias("label"), (F.min("label") != F.max("label")).alias("conflict"))
    )


def item_labels(labelled_aliases: DataFrame) -> DataFrame:
    """Label of each ranked paper through any of its aliases (J16); aliases with different labels
    are an error."""
    return _agreed(
        _labels_of_items(labelled_aliases), ~F.col("conflict"), "labels disagree on aliases of ", "paper_id")


def _jaccard(left: Column, right: Column) -> Column:
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(left, right)) / union)


def list_diversity(top: DataFrame, ks: Sequence[int], keys: Sequence[str] = ("ranking_id",)) -> DataFrame:
    """One minus mean facet overlap of a list's pairs (A16, J25); lists hold at most max(k)."""
    lists = top.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rank", F.array_distinct("facets").alias("f")))).alias("l")
    )
    sized = lists.select(*keys, F.explode(F.array(*map(F.lit, ks))).alias("k"), "l").select(
        *keys, "k", F.expr("slice(l, 1, k)").alias("l")
    )
    overlaps = F.flatten(
        F.transform(
            "l",
            lambda x: F.transform(
                F.filter("l", lambda y: y["rank"] > x["rank"]), lambda y: _jaccard(x["f"], y["f"])
            ),
        )
    )
    mean = F.aggregate("o", F.lit(0.0), lambda a, v: a + v) / F.size("o")
    return sized.withColumn("o", overlaps).select(
        *keys, "k",
        F.when(F.size("l") >= 2, 1.0 - mean).alias("intra_list_diversity_at_k"),
    )


def _per_version(rows: DataFrame, keys: Sequence[str], values: Sequence[Column], name: str) -> DataFrame:
    """One aggregate per version over whole rows, then a row per version ``_v``."""
    return rows.groupBy(*keys).agg(F.array(*values).alias("_a")).select(*keys, F.posexplode("_a").alias("_v", name))


def pairwise_accuracy(aliases: DataFrame, pairwise: DataFrame, splits: DataFrame, versions: int) -> DataFrame:
    """Share of preferences the scores agree with, both sides ranked and in the split."""
    pair = pairwise.select(
        "event_id",
        identity.canonical_identity(F.col("paper_id")).alias("winner"),
        identity.canonical_identity(F.col("compared_paper_id")).alias("other"),
    )
    members = splits.select(
        "split", identity.canonical_identity(F.col("paper_id")).alias("id")
    ).distinct()
    inside = pair.join(members.withColumnRenamed("id", "winner"), "winner").join(
        members.withColumnRenamed("id", "other"), ["split", "other"]
    )
    asked = inside.select(F.explode(F.array("winner", "other")).alias("id")).distinct()
    scores = (
        aliases.join(asked, "id", "left_semi")
        .groupBy("ranking_id", "id")
        .agg(F.array(*[F.max(F.col("scores")[i]) for i in range(versions)]).alias("scores"))
    )
    left = scores.select("ranking_id", F.col("id").alias("winner"), F.col("scores").alias("_w"))
    right = scores.select("ranking_id", F.col("id").alias("other"), F.col("scores").alias("_o"))
    met = inside.join(left, "winner").join(right, ["ranking_id", "other"])
    agree = [F.avg((F.col("_w")[i] > F.col("_o")[i]).cast("double")) for i in range(versions)]
    return _per_version(met, ["split", "ranking_id"], agree, "pairwise_accuracy")


def brier(labelled: DataFrame, ranked: DataFrame, versions: int) -> DataFrame:
    """Brier score of min-max scaled scores over labelled papers."""
    score = lambda i: F.col("scores")[i]
    bounds = ranked.groupBy("ranking_id").agg(
        F.array(*[F.min(score(i)) for i in range(versions)]).alias("_min"),
        F.array(*[F.max(score(i)) for i in range(versions)]).alias("_max"),
    )
    outcome = (F.col("label") == "positive").cast("double")

    def missed(i: int) -> Column:
        low, high = F.col("_min")[i], F.col("_max")[i]
        chance = F.when(high == low, 0.5).otherwise((score(i) - low) / (high - low))
        return F.avg((chance - outcome) * (chance - outcome))

    return _per_version(
        labelled.join(bounds, "ranking_id"), ["split", "ranking_id"], [missed(i) for i in range(versions)], "brier_score")


def _ideal(n: Column) -> Column:
    gains = F.transform(F.sequence(F.lit(1), n), lambda i: 1.0 / F.log2(i + 1.0))
    return F.aggregate(gains, F.lit(0.0), lambda a, g: a + g)


def evaluate_rankings(
    ranked: DataFrame,
    labels: DataFrame,
    splits: DataFrame,
    pairwise: DataFrame,
    *,
    ks: Sequence[int] = (20,),
    split_names: Sequence[str] = ("temporal-holdout",),
    versions: Sequence[str] | None = None,
) -> DataFrame:
    """Metrics of every ranking on every split and k in one pass.

    A ranking holds a paper once. With ``versions``, ``ranked`` carries ``scores``, an array with one score per
    version, and each ranking is measured under each of them (column ``version``); rows stay one per
    paper. Only the first places of a version, as ids and scores, and the metrics are a row per version.
    The rankings are written once to the shared folder, since several metrics read them.
    Precision divides by the labelled papers among the top k only, and the ideal gain counts all
    positives of the split; unavailable values stay NULL.
    """
    ks = sorted(ks)
    names = [""] if versions is None else list(versions)
    if versions is None:
        ranked = ranked.withColumn("scores", F.array("score")).drop("score")
    ranked = materialized(ranked, "ranked")
    listed = ["ranking_id", "_v"]
    cut = scale.top_per_group(
        ranked.select("ranking_id", "paper_id", F.posexplode("scores").alias("_v", "score")), listed,
        [F.col("score").desc(), F.col("paper_id")], ks[-1],
    )
    # A paper's other columns are joined once, whatever number of versions lists it.
    places = cut.groupBy("ranking_id", "paper_id").agg(F.collect_list(F.struct("_v", "rank")).alias("_places"))
    details = ranked.select("ranking_id", "paper_id", "source", "category", "facets")
    top = materialized(
        places.join(details, ["ranking_id", "paper_id"])
        .select("ranking_id", "paper_id", "source", "category", "facets", F.inline("_places")), "top")
    chosen = splits.filter(F.col("split").isin(list(split_names)))
    aliases = _aliases(ranked)
    in_split = split_labels(labels, chosen)
    # Most ranked papers carry no label: only the labelled aliases go on to the metrics.
    matched = materialized(aliases.join(in_split, "id"), "labelled")
    labelled = item_labels(matched)
    keys = ["split", "ranking_id"]
    positive, negative = F.col("label") == "positive", F.col("label") == "negative"

    sizes = in_split.groupBy("split").agg(
        F.count(F.lit(1)).alias("evaluated_labels"),
        F.count_if(positive).alias("positive_labels"),
        F.count_if(negative).alias("negative_labels"),
    )
    overlap = (
        matched.select(*keys, "id", "label")
        .distinct()
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("candidate_overlap"),
            F.count_if(positive).alias("candidate_positive_labels"),
            F.count_if(negative).alias("candidate_negative_labels"),
        )
    )
    at_k = F.explode(F.filter(F.array(*map(F.lit, ks)), lambda k: k >= F.col("rank"))).alias("k")
    hits = (
        top.select(*listed, "paper_id", "rank")
        .join(labelled.select("split", "ranking_id", "paper_id", "label"), ["ranking_id", "paper_id"])
        .select("split", *listed, "rank", "label", at_k)
        .groupBy("split", *listed, "k")
        .agg(
            F.count(F.lit(1)).alias("_labelled"),
            F.count_if(positive).alias("_pos"),
            F.count_if(negative).alias("_neg"),
            F.sum(F.when(positive, 1.0 / F.log2(F.col("rank") + 1.0))).alias("_dcg"),
        )
    )
    coverage = (
        top.select(*listed, "source", "category", at_k)
        .groupBy(*listed, "k")
        .agg(
            F.count_distinct(F.nullif("source", F.lit(""))).alias("source_coverage_at_k"),
            F.count_distinct(F.nullif("category", F.lit(""))).alias("category_coverage_at_k"),
        )
    )
    pairs_total = pairwise.count()
    frame = (
        coverage.withColumn("split", F.explode(F.array(*map(F.lit, split_names))))
        .join(sizes, "split", "left")
        .join(overlap, keys, "left")
        .join(hits, ["split", *listed, "k"], "left")
        .join(list_diversity(top, ks, listed), [*listed, "k"], "left")
        .join(brier(labelled, ranked, len(names)), ["split", *listed], "left")
        .join(pairwise_accuracy(aliases, pairwise, chosen, len(names)), ["split", *listed], "left")
    )
    version = [] if versions is None else [
        F.element_at(F.array(*map(F.lit, names)), F.col("_v") + 1).alias("version")]
    counts = [
        "evaluated_labels", "positive_labels", "negative_labels", "candidate_overlap",
        "candidate_positive_labels", "candidate_negative_labels", "_labelled", "_pos", "_neg",
    ]
    frame = frame.fillna(0, counts).fillna(0.0, ["_dcg"])
    reason = F.when(
        (F.col("evaluated_labels") == 0) & F.lit(pairs_total == 0),
        "no eligible labels or pairwise judgments",
    ).when(F.col("positive_labels") == 0, "no positive labels available for recall or NDCG")
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    ideal = _ideal(F.least(F.col("positive_labels"), F.col("k")).cast("int"))
    return frame.select(
        *keys,
        *version,
        "k",
        "evaluated_labels",
        "positive_labels",
        "negative_labels",
        ratio("_pos", "positive_labels").alias("recall_at_k"),
        ratio("_pos", "_labelled").alias("precision_at_k"),
        F.when(F.col("positive_labels") > 0, F.col("_dcg") / ideal).alias("ndcg_at_k"),
        ratio("_neg", "_labelled").alias("negative_rate_at_k"),
        "source_coverage_at_k",
        "category_coverage_at_k",
        "intra_list_diversity_at_k",
        "brier_score",
        "pairwise_accuracy",
        (
            reason.isNotNull()
            | (F.col("evaluated_labels") < FEW_LABELS)
            | (F.col("candidate_overlap") < FEW_LABELS)
        ).alias("provisional"),
        reason.alias("insufficiency_reason"),
        "candidate_overlap",
        "candidate_positive_labels",
        "candidate_negative_labels",
        ratio("_pos", "candidate_positive_labels").alias("candidate_recall_at_k"),
    )


def replay_snapshot(
    ranked: DataFrame, snapshot: dict[str, DataFrame], split: str, ks: Sequence[int] = (20,)
) -> DataFrame:
    """Metrics of rankings against the labels frozen in one stored snapshot.

    ``snapshot`` is what ``readers.read_snapshot`` gives, cut to one snapshot id.
    """
    if not snapshot["splits"].filter(F.col("split") == split).limit(1).count():
        raise ValueError("the snapshot does not hold the requested split")
    return evaluate_rankings(
        ranked, snapshot["labels"], snapshot["splits"], snapshot["pairwise"], ks=ks,
        split_names=(split,),
    )


def label_alias_conflicts(ranked: DataFrame, labels: DataFrame, splits: DataFrame) -> DataFrame:
    """Ranked papers whose aliases carry different labels; any row is an error."""
    if "scores" not in ranked.columns:
        ranked = ranked.withColumn("scores", F.array("score"))
    matched = _aliases(ranked).join(split_labels(labels, splits), "id")
    return _labels_of_items(matched).filter("conflict")


def _texts(*conditions: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in conditions]))


def compare_rankings(
    metrics: DataFrame,
    baseline: str,
    candidates: Sequence[str] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Deltas, reasons, warnings and eligibility of rankings against a baseline.

    ``by`` names columns, such as the reader, that tell apart several evaluations at once.
    """
    keys = [*by, "split", "k"]
    carried = [
        "ndcg_at_k", "candidate_recall_at_k", "negative_rate_at_k", "candidate_overlap",
        "candidate_positive_labels", "recall_at_k",
    ]
    base = metrics.filter(F.col("ranking_id") == baseline).select(
        *keys, *[F.col(c).alias(f"_b_{c}") for c in carried]
    )
    other = metrics.filter(F.col("ranking_id") != baseline)
    if candidates is not None:
        other = other.filter(F.col("ranking_id").isin(list(candidates)))
    delta = lambda c: F.col(c) - F.col(f"_b_{c}")
    overlap = F.least("candidate_overlap", "_b_candidate_overlap")
    ndcg, negative = delta("ndcg_at_k"), delta("negative_rate_at_k")
    yes = lambda c: F.coalesce(c, F.lit(False))
    warnings = F.array_compact(
        F.concat(
            F.array(F.col("insufficiency_reason")),
            F.array(
                F.when(overlap == 0, "candidate-label overlap is zero for at least one ranking")
                .when(overlap < FEW_LABELS, "few overlapping labels; metric uncertainty is high"),
                F.when(
                    overlap < FEW_LABELS,
                    "sparse independent-label sample; metric uncertainty is high",
                ),
                F.when(
                    (F.col("_b_candidate_positive_labels") == 0)
                    | (F.col("candidate_positive_labels") == 0),
                    "no positive labels overlap the candidate pool; Recall@K is not interpretable",
                ),
                F.when(ndcg.isNull(), "NDCG is unavailable"),
            ),
        )
    )
    reasons = _texts(
        (yes(ndcg < NDCG_TARGET), "NDCG improvement is below the 0.05 release target"),
        (yes(negative > 0), "negative-label rate increased"),
    )
    return other.join(base, keys).select(
        F.lit(baseline).alias("baseline_name"),
        F.col("ranking_id").alias("candidate_name"),
        *keys,
        ndcg.alias("ndcg_delta"),
        delta("candidate_recall_at_k").alias("recall_delta"),
        negative.alias("negative_rate_delta"),
        delta("recall_at_k").alias("plain_recall_delta"),
        ((F.size(reasons) == 0) & (F.size(warnings) == 0)).alias("eligible_for_tuning"),
        reasons.alias("reasons"),
        warnings.alias("warnings"),
    )


def shadow_report(
    metrics: DataFrame, candidate: str, baseline: str = BASELINE_VERSION, by: Sequence[str] = ()
) -> DataFrame:
    """One row per split: comparison at 20 with the observations at 20 and 60."""
    keys = [*by, "split"]
    comparison = compare_rankings(metrics.filter("k = 20"), baseline, [candidate], by)
    values = [c for c in metrics.columns if c not in (*keys, "k", "ranking_id")]
    side = lambda name, k, p: metrics.filter(
        (F.col("ranking_id") == name) & (F.col("k") == k)
    ).select(*keys, *[F.col(c).alias(p + c) for c in values])
    row = comparison
    for name, k, prefix in (
        (baseline, 20, "b20_"), (candidate, 20, "c20_"), (baseline, 60, "b60_"), (candidate, 60, "c60_"),
    ):
        row = row.join(side(name, k, prefix), keys)
    c60, b60 = F.col("c60_candidate_recall_at_k"), F.col("b60_candidate_recall_at_k")
    unknown = c60.isNull() | b60.isNull()
    c_div, b_div = F.col("c20_intra_list_diversity_at_k"), F.col("b20_intra_list_diversity_at_k")
    yes = lambda c: F.coalesce(c, F.lit(False))
    observed = _texts(
        (F.col("c20_provisional"), "sparse evaluation result is provisional"),
        (unknown, "coarse candidate-conditional Recall@60 is unavailable"),
        (~unknown & (c60 < b60), "coarse Recall@60 regressed from the frozen baseline"),
        (
            ~unknown & (c60 < RECALL_TARGET),
            "coarse Recall@60 is below the 95% labeled-relevant target",
        ),
        (yes(c_div < b_div), "intra-list diversity regressed"),
        (
            F.col("c20_source_coverage_at_k") < F.col("b20_source_coverage_at_k"),
            "source coverage regressed",
        ),
    )
    return row.withColumn(
        "warnings", F.concat("warnings", "reasons", observed)
    ).withColumn("eligible_for_activation", F.lit(True))


def ablation_deltas(metrics: DataFrame, candidate: str, by: Sequence[str] = ()) -> DataFrame:
    """Metric change at 20 from leaving out each feature group."""
    compared = compare_rankings(metrics.filter("k = 20"), candidate, by=by)
    prefix = f"{candidate}-without-"
    return compared.filter(F.col("candidate_name").startswith(prefix)).select(
        *by,
        "split",
        F.substring("candidate_name", len(prefix) + 1, 80).alias("group"),
        F.col("ndcg_delta").alias("ndcg_delta_from_candidate"),
        F.col("plain_recall_delta").alias("recall_delta_from_candidate"),
    )
