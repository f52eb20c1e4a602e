"""Candidate scoring against interest profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import moments, text
from folioscope.operators import scale
from folioscope.operators.weights import (
    BASELINE_VERSION, GROUPS, INTEREST_IMPORTANCE, QUALITY_FIRST, weight_literals,
)
from folioscope.session import materialized

# ---- fixed values -------------------------------------------------------------------------
TIER_VALUE = {"core": 1.0, "adjacent": 0.6, "exploration": 0.2}
BASELINE_TIER_VALUE = {"core": 2.0, "adjacent": 1.0, "exploration": 0.25}
LOCAL_GROUP = {
    "lexical": "interest", "category": "interest", "facet": "interest", "recency": "recency",
    "identity": "identity",
}
AUTHOR_BONUS = 0.75
INSTITUTION_BONUS = 0.5
IDENTITY_CAP = 1.0
# -------------------------------------------------------------------------------------------

PROFILE_COLUMNS = [
    "topics", "core_categories", "adjacent_categories", "watched_authors",
    "watched_institutions", "preference_facets",
]


def ranking_profile(profiles: DataFrame) -> DataFrame:
    """Profile rows with everything a score needs, prepared once per profile.

    Watched names arrive as ``array<struct<name, aliases>>`` and leave as normalized names (J8).
    """
    names = lambda c: F.flatten(
        F.transform(c, lambda i: F.concat(F.array(i["name"]), F.coalesce(i["aliases"], F.array())))
    )
    facets = F.transform(
        F.coalesce(F.col("preference_facets"), F.array()),
        lambda f: F.struct(
            text.facet_tokens(f["value"]).alias("tokens"),
            (f["score"] * f["confidence"]).alias("weight"),
        ),
    )
    extra = [c for c in ("retrieval_categories",) if c in profiles.columns]
    return profiles.select(
        "profile_id",
        *extra,
        F.array_distinct("topics").alias("_topics"),
        F.col("core_categories").alias("_core"),
        F.col("adjacent_categories").alias("_adjacent"),
        text.normalized_identities(names(F.col("watched_authors"))).alias("_author_names"),
        text.normalized_identities(names(F.col("watched_institutions"))).alias("_place_names"),
        facets.alias("_facets"),
    ).withColumn(
        "_facet_words", F.array_distinct(F.flatten(F.transform("_facets", lambda f: f["tokens"])))
    )


#: Marks in front of keys that are not whole words: a part behind a hyphen, an author, a place.
PART, AUTHOR, PLACE = "-", "\1", "\2"
_ENTRIES = "array<struct<key:string,topic:int,part:string>>"


def _postings(profiles: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """An inverted index of all readers, ``(key, profile_id, topic, part)``, from arrays of entries; and
    ``_wanted``, where readers have retrieval categories."""
    prepared = ranking_profile(profiles)
    entries = F.concat(*[F.coalesce(k, F.array().cast(_ENTRIES)) for k in kinds.values()])
    wanted = [F.col("retrieval_categories").alias("_wanted")] if "retrieval_categories" in prepared.columns else []
    rows = prepared.select("profile_id", *wanted, F.explode(entries).alias("_e"))
    return rows.select(*[c for c in rows.columns if c != "_e"], "_e.*")


def _entry(key: Column, topic: int, part: Column | None = None) -> Column:
    part = F.lit(None).cast("string") if part is None else part
    return F.struct(key.alias("key"), F.lit(topic).alias("topic"), part.alias("part"))


def term_postings(profiles: DataFrame) -> DataFrame:
    """Postings of each topic, and of each facet token as a whole word and as a hyphen part."""
    return _postings(profiles, {
        "topic": F.transform("_topics", lambda w: _entry(w, 1)),
        "whole": F.transform("_facet_words", lambda w: _entry(w, 0, w)),
        "split": F.transform("_facet_words", lambda w: _entry(F.concat(F.lit(PART), w), 0, w))})


def name_postings(profiles: DataFrame) -> DataFrame:
    """Postings of each watched author and institution."""
    return _postings(profiles, {
        "author": F.transform("_author_names", lambda n: _entry(F.concat(F.lit(AUTHOR), n), 0)),
        "place": F.transform("_place_names", lambda n: _entry(F.concat(F.lit(PLACE), n), 0))})


def _term_keys(candidates: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Distinct tokens of each candidate and parts of those with hyphens."""
    joined = F.filter("words", lambda w: F.contains(w, F.lit("-")))
    parts = F.filter(F.flatten(F.transform(joined, lambda w: F.split(w, "-"))), lambda p: F.length(p) >= 3)
    marked = F.transform(F.array_distinct(parts), lambda p: F.concat(F.lit(PART), p))
    # The outer form keeps Spark from adding a filter that would tokenize each text again.
    return candidates.select(*ids, F.explode_outer(F.concat("words", marked)).alias("key"))


def _name_keys(candidates: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Names of each candidate; texts are not read for them."""
    known = lambda c, mark: F.transform(
        F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda n: n != ""),
        lambda n: F.concat(F.lit(mark), n))
    names = F.concat(known(F.col("_authors_norm"), AUTHOR), known(F.col("_places_norm"), PLACE))
    return candidates.select(*ids, F.explode_outer(F.array_distinct(names)).alias("key"))


def _summed(found: DataFrame, ids: Sequence[str]) -> DataFrame:
    return found.groupBy(*ids).agg(
        F.sum("topic").cast("double").alias("term_overlap"), F.collect_set("part").alias("_met"))


def term_hits(candidates: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per reader and candidate that share anything: ``term_overlap``, the number of topics among the
    candidate's tokens (J9), and ``_met``, the facet tokens among them and their hyphen parts (J11).

    Distinct tokens meet the postings of all readers by equality and are added up, so a pair without
    a hit costs nothing. ``candidates`` are ``prepare_candidates`` rows, one per ``paper_id``, or one per
    ``profile_id`` and ``paper_id``.
    """
    ids = [c for c in ("profile_id", "paper_id") if c in candidates.columns]
    postings = term_postings(profiles)
    on = ["key", *[c for c in ids if c == "profile_id"]]
    carried = [] if "_wanted" not in postings.columns or "profile_id" in ids else ["categories"]
    found = scale.hot_key_join(_term_keys(candidates, [*ids, *carried]), postings, on, sized_by=postings.select("key"))
    if carried:
        found = found.filter(F.arrays_overlap("categories", "_wanted"))
    return _summed(found, ["profile_id", "paper_id"])


def _retrieved(candidates: DataFrame, profiles: DataFrame) -> DataFrame:
    """Candidates with every profile that retrieves one of their categories, once each."""
    wanted = profiles.select(
        "profile_id",
        F.explode(F.array_distinct("retrieval_categories")).alias("_category"),
        F.col("retrieval_categories").alias("_wanted"),
    )
    offered = candidates.withColumn("_category", F.explode(F.array_distinct("categories")))
    paired = scale.hot_key_join(
        offered, wanted, ["_category"], sized_by=wanted.select("_category")
    )
    # A pair that matches through several categories is kept at the first of them.
    first = F.get(F.array_intersect("categories", "_wanted"), F.lit(0))
    return paired.filter(F.col("_category") == first).drop("_category", "_wanted")


def assign_pool(candidates: DataFrame, profiles: DataFrame) -> DataFrame:
    """Pair every candidate with the profiles that retrieve one of its categories (P21), with the
    hits of the pair.

    Tokens stay below the pairing: the pairs join the sparse sums of ``term_hits``. ``candidates`` hold
    one row per ``paper_id`` (C10).
    """
    if "words" not in candidates.columns:
        candidates = prepare_candidates(candidates)
    pairs = _retrieved(candidates.drop("words"), profiles)
    return _with_hits(pairs, term_hits(candidates, profiles))


def _with_hits(pairs: DataFrame, hits: DataFrame) -> DataFrame:
    return pairs.join(hits, ["profile_id", "paper_id"], "left").withColumns({
        "term_overlap": F.coalesce("term_overlap", F.lit(0.0)),
        "_met": F.coalesce("_met", F.array().cast("array<string>"))})


def contenders(candidates: DataFrame, profiles: DataFrame, now, limit: int) -> DataFrame:
    """Pairs ``(profile_id, paper_id, term_overlap, _met)`` among which the first ``limit`` of every
    reader are, for any score that grows with hits, identity and freshness and depends on nothing else
    but the tier.

    Without a hit and a watched name, candidates of the same categories differ in freshness and id
    alone for all readers. So only the first ``limit`` of each set of categories can enter a list; all
    others come from the inverted index. Pairs that are neither are never built. Candidates without a
    date are a set of their own.
    """
    found = [
        scale.hot_key_join(keys(candidates, ["paper_id", "categories"]), postings, ["key"], sized_by=postings.select("key"))
        .filter(F.arrays_overlap("categories", "_wanted"))
        for keys, postings in ((_term_keys, term_postings(profiles)), (_name_keys, name_postings(profiles)))]
    fresh = moments.freshness(moments.instant(now), F.col("published"))
    newest = scale.top_per_group(
        candidates.select("paper_id", "categories", fresh.alias("_fresh")).withColumns({
            "_set": F.array_sort(F.array_distinct("categories")), "_dated": F.col("_fresh").isNotNull()}),
        ["_set", "_dated"], [F.col("_fresh").desc(), F.col("paper_id")], limit, "_place",
    )
    none = {"topic": F.lit(0), "part": F.lit(None).cast("string")}
    columns = ["profile_id", "paper_id", "topic", "part"]
    unmet = _retrieved(newest.select("paper_id", "categories"), profiles).withColumns(none)
    return _summed(reduce(DataFrame.unionByName, [x.select(*columns) for x in (*found, unmet)]), columns[:2])


def pool_shortlist(
    candidates: DataFrame, profiles: DataFrame, now, limit: int = 60, *, score=None, **options
) -> DataFrame:
    """The first ``limit`` scored candidates of every reader, ranked, without building all pairs.

    ``candidates`` hold one row per ``paper_id`` and no ``profile_id``. Contenders are scored on the few
    columns a score needs; the others join the ranked rows. ``score`` is ``score_candidates`` (default) or
    ``score_baseline`` without feedback, with its ``options``.
    """
    if "words" not in candidates.columns:
        candidates = prepare_candidates(candidates)
    needed = ["paper_id", "categories", "published", "_authors_norm", "_places_norm"]
    pairs = contenders(candidates, profiles, now, limit).join(candidates.select(*needed), "paper_id")
    scored = (score or score_candidates)(pairs, profiles, now, **options)
    best = materialized(shortlist(scored, limit), "ranked")
    rest = candidates.select("paper_id", *[c for c in candidates.columns if c not in best.columns and c not in (
        "words", "_authors_norm", "_places_norm")])
    return scale.hot_key_join(rest, best, ["paper_id"])


def _with_profile(candidates: DataFrame, profiles: DataFrame) -> DataFrame:
    prepared = ranking_profile(profiles)
    if "profile_id" not in candidates.columns:
        raise ValueError("give candidates a profile_id, for example with assign_pool")
    return scale.hot_key_join(
        candidates, prepared.drop("retrieval_categories"), ["profile_id"], rows=2_000,
        sized_by=profiles.select("profile_id"),
    )


def prepare_candidates(candidates: DataFrame) -> DataFrame:
    """Everything a score needs from a candidate alone.

    The summary gives way to the distinct tokens of the whole text (I8), which only the inverted index
    reads; names are normalized (I7).
    """
    return (
        candidates.withColumn("words", text.ranking_terms(F.concat_ws(" ", "title", "summary")))
        .drop("summary")
        .withColumns(
            {
                "_authors_norm": text.normalized_identities(F.col("authors")),
                "_places_norm": text.normalized_identities(F.col("affiliations")),
            }
        )
    )


def _tier(core: Column, adjacent: Column) -> Column:
    return (
        F.when(F.arrays_overlap("categories", core), "core")
        .when(F.arrays_overlap("categories", adjacent), "adjacent")
        .otherwise("exploration")
    )


def _tier_value(values: Mapping[str, float]) -> Column:
    tier = F.col("source")
    return F.when(tier == "core", values["core"]).when(
        tier == "adjacent", values["adjacent"]
    ).otherwise(values["exploration"])


def _local_features(
    candidates: DataFrame, profiles: DataFrame, now, bonuses: tuple[float, float, float]
) -> DataFrame:
    """Tier, overlap, freshness and watched-identity columns of every pair."""
    author, place, cap = bonuses
    if "term_overlap" not in candidates.columns:
        if "profile_id" not in candidates.columns:
            raise ValueError("give candidates a profile_id, for example with assign_pool")
        if "words" not in candidates.columns:
            candidates = prepare_candidates(candidates)
        candidates = _with_hits(candidates.drop("words"), term_hits(candidates, profiles))
    joined = _with_profile(candidates, profiles)
    known = lambda c: F.filter(c, lambda n: n != "")
    author_hit = F.arrays_overlap(known(F.col("_authors_norm")), F.col("_author_names"))
    place_hit = F.arrays_overlap(known(F.col("_places_norm")), F.col("_place_names"))
    return joined.withColumns(
        {
            "source": _tier(F.col("_core"), F.col("_adjacent")),
            "topic_count": F.size("_topics"),
            "recency": moments.freshness(moments.instant(now), F.col("published")),
            "watched_author": F.least(F.when(author_hit, author).otherwise(0.0), F.lit(cap)),
            "_place_bonus": F.when(place_hit, place).otherwise(0.0),
            "has_watchlist": (F.size("_author_names") > 0) | (F.size("_place_names") > 0),
            "has_facets": F.size("_facets") > 0,
        }
    ).withColumn(
        "watched_institution",
        F.least("_place_bonus", F.greatest(F.lit(0.0), F.lit(cap) - F.col("watched_author"))),
    )


def _facet_value() -> Column:
    """Weight of the facets whose every token occurs in the paper, out of three (J11); the tokens
    are those that the inverted index met."""
    summed = F.aggregate(
        F.col("_facets"),
        F.lit(0.0),
        lambda acc, f: acc
        + F.when(
            (F.size(f["tokens"]) > 0)
            & (F.size(F.array_except(f["tokens"], F.col("_met"))) == 0),
            f["weight"],
        ).otherwise(0.0),
    )
    return F.least(summed / 3, F.lit(1.0))


def feature_table(
    candidates: DataFrame,
    profiles: DataFrame,
    now,
    *,
    author_bonus: float = AUTHOR_BONUS,
    institution_bonus: float = INSTITUTION_BONUS,
    identity_bonus_cap: float = IDENTITY_CAP,
) -> DataFrame:
    """One wide row of normalized local features per (profile, candidate) pair."""
    local = _local_features(
        candidates, profiles, now, (author_bonus, institution_bonus, identity_bonus_cap)
    )
    return local.withColumns(
        {
            "lexical": F.least(
                F.col("term_overlap") / F.greatest(F.col("topic_count"), F.lit(1)), F.lit(1.0)
            ),
            "category": _tier_value(TIER_VALUE),
            "facet": F.when(F.col("has_facets"), _facet_value()).otherwise(0.0),
            "identity": F.col("watched_author") + F.col("watched_institution"),
        }
    ).drop(
        "_topics", "_core", "_adjacent", "_author_names", "_place_names", "_facets",
        "_facet_words", "_met", "_place_bonus", "_authors_norm", "_places_norm", "topic_count",
    )


def extra_feature_sums(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum and count of applicable extra features per key and group (P20), one row per key.

    A name that comes twice for one key, or that a local feature has, is an error (J3).
    """
    applicable = F.col("applicable")
    doubtful = F.when(F.col("name").isin(list(LOCAL_GROUP)), F.lit(None)).otherwise(F.col("name"))
    single = features.groupBy(*keys, "name").agg(
        F.count(F.lit(1)).alias("_copies"), F.max(F.struct(
            "grp", "value", "confidence", "applicable")).alias("_f"), F.min(doubtful).alias("_own"))
    checked = single.filter(F.when(
        (F.col("_copies") > 1) | F.col("_own").isNull(),
        F.raise_error(F.concat(F.lit("feature is given twice: "), F.col("name"))).cast("boolean"),
    ).otherwise(F.lit(True)))
    return checked.select(*keys, "_f.*").groupBy(*keys).agg(
        *[
            column
            for g in GROUPS
            for column in (
                F.sum(
                    F.when(applicable & (F.col("grp") == g), F.col("value") * F.col("confidence"))
                ).alias(f"_x_{g}"),
                F.count(F.when(applicable & (F.col("grp") == g), F.lit(1))).alias(f"_n_{g}"),
            )
        ],
    )


def duplicate_features(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Feature names that occur twice for one candidate, or shadow a local feature."""
    return (
        features.groupBy(*keys, "name")
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter((F.col("copies") > 1) | F.col("name").isin(list(LOCAL_GROUP)))
    )


def _group_values() -> dict[str, Column]:
    """Mean of value x confidence per group, NULL where nothing is known."""
    n = {g: F.coalesce(F.col(f"_n_{g}"), F.lit(0)).cast("double") for g in GROUPS}
    x = {g: F.coalesce(F.col(f"_x_{g}"), F.lit(0.0)) for g in GROUPS}
    w = INTEREST_IMPORTANCE
    has = F.col("has_facets")
    local_interest = F.col("lexical") * w["lexical"] + F.col("category") * w["category"]
    values = {
        "interest": F.when(
            has,
            (local_interest + F.col("facet") * w["facet"] + x["interest"])
            / (F.lit(w["lexical"]) + w["category"] + w["facet"] + n["interest"]),
        ).otherwise(
            (local_interest + x["interest"])
            / (F.lit(w["lexical"]) + w["category"] + n["interest"])
        ),
        "recency": (F.col("recency") + x["recency"]) / (1.0 + n["recency"]),
        "identity": F.when(
            F.col("has_watchlist"), (F.col("identity") + x["identity"]) / (1.0 + n["identity"])
        ).otherwise(F.when(n["identity"] > 0, x["identity"] / n["identity"])),
    }
    for g in GROUPS:
        values.setdefault(g, F.when(n[g] > 0, x[g] / n[g]))
    return values


def score_features(
    features: DataFrame, weights: Mapping | Sequence[Mapping] = QUALITY_FIRST
) -> DataFrame:
    """Normalized score over the groups that have a value, and each group's share.

    Several weight sets give several rankings of the same features in one pass, told apart by
    ``weight_set_version``.
    """
    sets = [weights] if isinstance(weights, Mapping) else list(weights)
    present = set(features.columns)
    absent = [p + g for g in GROUPS for p in ("_x_", "_n_") if p + g not in present]
    features = features.withColumns({c: F.lit(None).cast("double") for c in absent})
    df = features.withColumns({f"{g}_value": v for g, v in _group_values().items()}).drop(
        *[p + g for g in GROUPS for p in ("_x_", "_n_")]
    )
    df = df.withColumn("_w", F.explode(weight_literals(sets)))
    known = F.lit(0.0)
    for g in GROUPS:
        known = known + F.when(F.col(f"{g}_value").isNotNull(), F.col(f"_w.{g}")).otherwise(0.0)
    df = df.withColumn("_known", known)
    df = df.withColumns(
        {
            f"{g}_contribution": F.when(
                F.col("_known") > 0, F.col(f"_w.{g}") * F.col(f"{g}_value") / F.col("_known")
            )
            for g in GROUPS
        }
    )
    total = F.lit(0.0)
    for g in GROUPS:
        total = total + F.coalesce(F.col(f"{g}_contribution"), F.lit(0.0))
    return df.withColumns({"score": total, "weight_set_version": F.col("_w.version")}).drop(
        "_w", "_known"
    )


def score_candidates(
    candidates: DataFrame,
    profiles: DataFrame,
    now,
    *,
    weights: Mapping | Sequence[Mapping] = QUALITY_FIRST,
    extra_features: DataFrame | None = None,
    **bonuses: float,
) -> DataFrame:
    """Score every (profile, candidate) pair with transparent components."""
    features = feature_table(candidates, profiles, now, **bonuses)
    if extra_features is not None:
        keys = [k for k in ("profile_id", "paper_id") if k in extra_features.columns]
        features = features.join(extra_feature_sums(extra_features, keys), keys, "left")
    return score_features(features, weights)


def unscored(scored: DataFrame) -> DataFrame:
    """Scored rows as feature rows again, for a second score with more features."""
    return scored.drop(
        "score", "rank", "weight_set_version", *[f"{g}_{kind}" for g in GROUPS for kind in ("value", "contribution")])


def components(scored: DataFrame) -> DataFrame:
    """Scores with their named components in one map."""
    names = [
        *LOCAL_GROUP, "watched_author", "watched_institution",
        *[f"{g}_value" for g in GROUPS], *[f"{g}_contribution" for g in GROUPS],
    ]
    entries = F.map_from_arrays(
        F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n) for n in names])
    )
    return scored.withColumn("components", F.map_filter(entries, lambda _, v: v.isNotNull()))


def _baseline_parts() -> list[Column]:
    return [
        F.col("term_overlap"), _tier_value(BASELINE_TIER_VALUE), F.col("recency"),
        F.col("feedback"), F.col("watched_author"), F.col("watched_institution"),
    ]


def baseline_features(features: DataFrame, feedback_adjustments: DataFrame | None = None):
    """Feature rows scored by the frozen unnormalized formula."""
    if feedback_adjustments is None:
        features = features.withColumn("feedback", F.lit(0.0))
    else:
        known = feedback_adjustments.select("paper_id", F.col("adjustment").alias("feedback"))
        features = features.join(known, "paper_id", "left").fillna(0.0, ["feedback"])
    total = F.lit(0.0)
    for part in _baseline_parts():
        total = total + part
    return features.withColumns(
        {
            "score": total,
            "lexical": F.col("term_overlap"),
            "category": _tier_value(BASELINE_TIER_VALUE),
            "weight_set_version": F.lit(BASELINE_VERSION),
        }
    )


def score_baseline(
    candidates: DataFrame,
    profiles: DataFrame,
    now,
    feedback_adjustments: DataFrame | None = None,
    **bonuses: float,
) -> DataFrame:
    """The frozen formula kept for comparison and rollback."""
    return baseline_features(feature_table(candidates, profiles, now, **bonuses), feedback_adjustments)


def version_scores(features: DataFrame, sets: Sequence[Mapping]) -> DataFrame:
    """Feature rows with ``scores``: the baseline's score and that of each weight set, in this order, so
    that several rankings of the same pairs stay one row a pair."""
    scored = score_features(features.withColumn("feedback", F.lit(0.0)), sets[:1])
    known = {g: F.col(f"{g}_value") for g in GROUPS}

    def total(weights: Mapping) -> Column:
        share, weight = F.lit(0.0), F.lit(0.0)
        for g, value in known.items():
            if not weights[g]:
                continue
            share = share + F.coalesce(value * float(weights[g]), F.lit(0.0))
            weight = weight + F.when(value.isNotNull(), float(weights[g])).otherwise(0.0)
        return F.when(weight > 0, share / weight).otherwise(0.0)

    base = F.lit(0.0)
    for part in _baseline_parts():
        base = base + part
    return scored.withColumn("scores", F.array(base, *map(total, sets))).drop("score", "weight_set_version")


def version_names(sets: Sequence[Mapping]) -> list[str]:
    """Names of the entries of ``scores``."""
    return [BASELINE_VERSION, *[s["version"] for s in sets]]


#: Most candidates a shortlist may hold.
SHORTLIST_MOST = 80


def shortlist(scored: DataFrame, limit: int = 60, keys: Sequence[str] = ("profile_id",)):
    """Best ``limit`` candidates per profile, ranked."""
    if not 1 <= limit <= SHORTLIST_MOST:
        raise ValueError("the shortlist holds between 1 and 80 candidates")
    return scale.top_per_group(
        scored, keys, [F.col("score").desc(), F.col("paper_id")], limit, "rank"
    )


def reading_order(records: DataFrame, keys: Sequence[str] = ("profile_id",)) -> DataFrame:
    """Presentation order of the few selected records of each profile."""
    from pyspark.sql import Window

    window = Window.partitionBy(*keys).orderBy(
        F.col("score").desc(), F.col("quality").desc(), F.col("updated").desc(), F.col("paper_id")
    )
    return records.withColumn("rank", F.row_number().over(window))
