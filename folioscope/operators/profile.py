"""Weighted interest profiles from a reference library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import hashing, moments, text
from folioscope.operators import scale
from folioscope.session import materialized

# ---- fixed values -------------------------------------------------------------------------
SIGNAL_WEIGHTS = {
    "library": 0.25, "manual_tag": 2.0, "collection": 1.0, "note": 1.5, "annotation": 2.0,
    "comment": 2.5, "curated": 4.0,
}
CATEGORY_HINTS = {
    "machine": "cs.LG", "learning": "cs.LG", "language": "cs.CL", "vision": "cs.CV",
    "quantum": "quant-ph", "statistical": "stat.ML", "neural": "cs.NE", "algorithm": "cs.DS",
}
FACET_HINTS = {
    "domain": {
        "learning": "machine-learning", "neural": "machine-learning", "language": "language",
        "vision": "computer-vision", "quantum": "quantum-computing", "algorithm": "algorithms",
    },
    "method": {
        "transformer": "transformers", "diffusion": "diffusion",
        "reinforcement": "reinforcement-learning", "optimization": "optimization",
        "statistical": "statistical-modeling",
    },
    "task": {
        "classification": "classification", "generation": "generation",
        "retrieval": "retrieval", "reasoning": "reasoning", "translation": "translation",
    },
}
CATEGORY_NEIGHBOURS = {
    "cs.LG": ["stat.ML", "cs.AI", "cs.NE"],
    "cs.CL": ["cs.AI"],
    "cs.CV": ["cs.LG"],
    "quant-ph": ["cond-mat.str-el"],
}
RESERVED_TAG_PREFIXES = ["ranking-reason:", "internal:"]
CURATED_TAG_PREFIX = "ranking-curated:"
LABEL_COLLECTIONS = ["positive", "negative", "hard negative"]
CHILD_TYPES = ["attachment", "note", "annotation"]
LONG_TERMS, RECENT_TERMS, TOPICS, REPRESENTATIVE_TERMS = 80, 30, 30, 12
CATEGORIES, FACETS_PER_KIND, LONG_FACETS, RECENT_FACETS = 6, 4, 12, 8
DIGEST_TERMS, REPRESENTATIVES, REPRESENTATIVE_ITEM_TERMS = 40, 8, 5
PAYLOAD_BUDGET = 30 * 1024
PROFILE_SCHEMA_VERSION = 4
EXTRACTOR_VERSION = "deterministic-digest-v3"
# -------------------------------------------------------------------------------------------

ITEM_TEXT = ["title", "abstract", "date"]


def is_seed() -> Column:
    """Items that may seed a profile: live and not a child kind."""
    return ~F.coalesce(F.col("trashed"), F.lit(False)) & ~F.col("item_type").isin(CHILD_TYPES)


def hint_rows(spark, hints=None) -> DataFrame:
    """Facet hints as ``(kind, term, value)`` rows."""
    hints = FACET_HINTS if hints is None else hints
    rows = [(kind, term, value) for kind, m in hints.items() for term, value in m.items()]
    return spark.createDataFrame(rows, "kind string, term string, value string")


def _root_text() -> Column:
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ITEM_TEXT])


def roots_with_decay(items: DataFrame, observed_at=None, curated: DataFrame | None = None):
    """Seed items with their recency weight and curated flag."""
    observed = None if observed_at is None else moments.instant(observed_at)
    roots = items.filter(is_seed()).withColumn("_decay", moments.date_decay(F.col("date"), observed))
    if curated is None:
        return roots.withColumn("_curated", F.lit(False))
    flags = curated.select("profile_id", "key").distinct().withColumn("_curated", F.lit(True))
    return roots.join(flags, ["profile_id", "key"], "left").withColumn(
        "_curated", F.coalesce("_curated", F.lit(False))
    )


def _tag_weight(tag: Column) -> Column:
    w = SIGNAL_WEIGHTS
    return (
        F.when(F.lower(tag["tag"]).startswith(CURATED_TAG_PREFIX), w["curated"])
        .when(tag["manual"], w["manual_tag"])
        .otherwise(w["library"])
    )


def _kept_tags() -> Column:
    reserved = lambda t: F.lower(t["tag"]).startswith(RESERVED_TAG_PREFIXES[0]) | F.lower(
        t["tag"]
    ).startswith(RESERVED_TAG_PREFIXES[1])
    return F.filter(F.coalesce(F.col("tags"), F.array()), lambda t: ~reserved(t))


def _tag_text(tag: Column) -> Column:
    curated = F.lower(tag["tag"]).startswith(CURATED_TAG_PREFIX)
    return F.when(curated, F.regexp_replace(tag["tag"], "^[^:]*:", "")).otherwise(tag["tag"])


def _weighted(tokens: Column, weight: Column) -> Column:
    return F.transform(tokens, lambda t: F.struct(t.alias("term"), weight.alias("w")))


def own_signals() -> Column:
    """Weighted terms of a seed row's own metadata and tags."""
    base = F.lit(SIGNAL_WEIGHTS["library"]) + F.when(
        F.col("_curated"), SIGNAL_WEIGHTS["curated"]
    ).otherwise(0.0)
    from_tags = F.flatten(
        F.transform(
            _kept_tags(), lambda t: _weighted(text.profile_tokens(_tag_text(t)), _tag_weight(t))
        )
    )
    return F.concat(_weighted(text.profile_tokens(_root_text()), base), from_tags)


def child_signals() -> Column:
    """Weighted terms of a note or annotation row."""
    return F.concat(
        *[
            _weighted(
                text.profile_tokens(F.coalesce(F.col(field), F.lit(""))),
                F.lit(SIGNAL_WEIGHTS[signal]),
            )
            for field, signal in (
                ("note_text", "note"),
                ("annotation_text", "annotation"),
                ("annotation_comment", "comment"),
            )
        ]
    )


def live_children(items: DataFrame) -> DataFrame:
    """Rows that hang below another row and are not trashed."""
    return items.filter(
        F.col("parent_key").isNotNull() & ~F.coalesce(F.col("trashed"), F.lit(False))
    )


def _own_terms(roots: DataFrame) -> DataFrame:
    """Terms of an item's own metadata and tags, summed per profile."""
    exploded = roots.select("profile_id", "_decay", F.explode(own_signals()).alias("s"))
    return exploded.groupBy("profile_id", F.col("s.term").alias("term")).agg(
        F.sum("s.w").alias("weight"), F.sum(F.col("s.w") * F.col("_decay")).alias("recent")
    )


def child_terms(items: DataFrame, roots: DataFrame) -> DataFrame:
    """Terms of notes and annotations under seed items.

    Children are summed per parent and term first, so the join meets one row per distinct term of
    a parent, however many children hang below it.
    """
    per_parent = (
        live_children(items)
        .select("profile_id", F.col("parent_key").alias("key"), F.explode(child_signals()).alias("s"))
        .groupBy("profile_id", "key", F.col("s.term").alias("term"))
        .agg(F.sum("s.w").alias("w"))
    )
    joined = per_parent.join(roots.select("profile_id", "key", "_decay"), ["profile_id", "key"])
    return joined.groupBy("profile_id", "term").agg(
        F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("_decay")).alias("recent")
    )


def collection_terms(roots: DataFrame, collections: DataFrame) -> DataFrame:
    """Terms of the collections that hold seed items, label collections aside."""
    membership = (
        roots.select("profile_id", "_decay", F.explode("collections").alias("collection"))
        .groupBy("profile_id", "collection")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("_decay").alias("d"))
    )
    labelled = F.lower(F.trim("name")).isin(LABEL_COLLECTIONS)
    names = collections.filter(~labelled).select(
        "profile_id",
        F.col("key").alias("collection"),
        F.explode(text.profile_tokens(F.col("name"))).alias("term"),
    )
    w = SIGNAL_WEIGHTS["collection"]
    return (
        membership.join(names, ["profile_id", "collection"])
        .groupBy("profile_id", "term")
        .agg(F.sum(F.col("n") * w).alias("weight"), F.sum(F.col("d") * w).alias("recent"))
    )


def term_weights(
    items: DataFrame,
    collections: DataFrame | None = None,
    *,
    observed_at=None,
    curated: DataFrame | None = None,
) -> DataFrame:
    """Long-term and recency-weighted weight of every term of every profile (A1, A2)."""
    roots = roots_with_decay(items, observed_at, curated)
    parts = _own_terms(roots).unionByName(child_terms(items, roots))
    if collections is not None:
        parts = parts.unionByName(collection_terms(roots, collections))
    return parts.groupBy("profile_id", "term").agg(
        F.sum("weight").alias("weight"), F.round(F.sum("recent"), 9).alias("recent_weight")
    )


def ranked_terms(weights: DataFrame) -> DataFrame:
    """Best long-term and recent terms per profile in long form (O3)."""
    long = scale.top_per_group(
        weights.select("profile_id", "term", "weight"),
        ["profile_id"], [F.col("weight").desc(), F.col("term")], LONG_TERMS,
    ).withColumn("horizon", F.lit("long"))
    recent = scale.top_per_group(
        weights.select("profile_id", "term", F.col("recent_weight").alias("weight")),
        ["profile_id"], [F.col("weight").desc(), F.col("term")], RECENT_TERMS,
    ).withColumn("horizon", F.lit("recent"))
    return long.unionByName(recent).select("profile_id", "horizon", "rank", "term", "weight")


def profile_table(weights: DataFrame) -> DataFrame:
    """Ranked terms, written once; ``weights`` is written too unless it is a table already."""
    return materialized(ranked_terms(materialized(weights, "term-weights")), "profile-terms")


def _hinted_category(term: Column) -> Column:
    pairs = [F.lit(v) for pair in CATEGORY_HINTS.items() for v in pair]
    return F.try_element_at(F.create_map(*pairs), term)


def profile_categories(terms: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """Best categories per profile from hinted long-term terms."""
    long = terms.filter(F.col("horizon") == "long")
    if hints is None:
        hinted = long.withColumn("category", _hinted_category(F.col("term")))
    else:
        hinted = scale.hot_key_join(long, hints.select("term", "category"), ["term"])
    summed = (
        hinted.filter(F.col("category").isNotNull())
        .groupBy("profile_id", "category")
        .agg(F.sum("weight").alias("score"))
    )
    return scale.top_per_group(
        summed, ["profile_id"], [F.col("score").desc(), F.col("category")], CATEGORIES
    ).withColumn("reason", F.lit("deterministic term hint"))


def profile_facets(terms: DataFrame, hints: DataFrame) -> DataFrame:
    """Facet evidence per horizon: best four per kind, then twelve overall."""
    keys = ["profile_id", "horizon"]
    top = terms.filter(F.col("rank") == 1).select(*keys, F.col("weight").alias("_top"))
    summed = (
        scale.hot_key_join(terms, hints.select("kind", "term", "value"), ["term"])
        .groupBy(*keys, "kind", "value")
        .agg(F.sum("weight").alias("_sum"))
    )
    per_kind = scale.top_per_group(
        summed, [*keys, "kind"], [F.col("_sum").desc(), F.col("value")], FACETS_PER_KIND, "_k"
    )
    scored = per_kind.join(top, keys).withColumn(
        "score", F.least(F.col("_sum") / F.col("_top"), F.lit(1.0))
    )
    best = scale.top_per_group(
        scored, keys, [F.col("score").desc(), F.col("kind"), F.col("value")], LONG_FACETS
    )
    return best.select(
        *keys, "rank", "kind", "value", "score",
        F.col("score").alias("confidence"),
        F.array(F.lit("local-derived")).alias("provenance"),
    )


def build_profile(
    items: DataFrame,
    collections: DataFrame | None = None,
    *,
    observed_at=None,
    curated: DataFrame | None = None,
    facet_hints: DataFrame | None = None,
    category_hints: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The long-form profile tables: terms, categories, facets.

    Every text is read once: the summed weights and then the short ranked lists are written to the
    shared folder, and all that follows reads those.
    """
    weights = term_weights(items, collections, observed_at=observed_at, curated=curated)
    terms = profile_table(weights)
    hints = hint_rows(items.sparkSession) if facet_hints is None else facet_hints
    return {
        "terms": terms,
        "categories": profile_categories(terms, category_hints),
        "facets": profile_facets(terms, hints),
    }


def neighbour_categories(core: Column, most: int = CATEGORIES, graph=None) -> Column:
    """One-hop neighbours of the core categories, sorted, core left out."""
    graph = CATEGORY_NEIGHBOURS if graph is None else graph
    pairs = [c for k, vs in graph.items() for c in (F.lit(k), F.array(*map(F.lit, vs)))]
    near = F.flatten(
        F.transform(core, lambda c: F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.array()))
    )
    return F.slice(F.array_sort(F.array_except(F.array_distinct(near), core)), 1, most)


def _ordered(column: Column) -> Column:
    """Values of a bounded list of ``struct(rank, value)`` in rank order."""
    return F.transform(F.array_sort(F.collect_list(column)), lambda s: s["v"])


def project_remote(tables: dict[str, DataFrame], budget: int = PAYLOAD_BUDGET) -> DataFrame:
    """One allowlisted row per profile (P6); ``within_budget`` tells whether it may leave."""
    terms, categories, facets = tables["terms"], tables["categories"], tables["facets"]
    topics = (
        terms.filter((F.col("horizon") == "long") & (F.col("rank") <= TOPICS))
        .filter(text.is_safe_term(F.col("term")))
        .groupBy("profile_id")
        .agg(_ordered(F.struct("rank", F.col("term").alias("v"))).alias("topics"))
    )
    core = categories.groupBy("profile_id").agg(
        _ordered(F.struct("rank", F.col("category").alias("v"))).alias("core_categories")
    )
    keep = F.when(F.col("horizon") == "long", LONG_FACETS).otherwise(RECENT_FACETS)
    value = F.struct("kind", "value", "score", "confidence", "provenance")
    chosen = (
        facets.filter(F.col("rank") <= keep)
        .groupBy("profile_id")
        .agg(_ordered(F.struct("horizon", "rank", value.alias("v"))).alias("preference_facets"))
    )
    empty_facets = F.array().cast(chosen.schema["preference_facets"].dataType)
    row = (
        topics.join(core, "profile_id", "left")
        .join(chosen, "profile_id", "left")
        .withColumn("core_categories", F.coalesce("core_categories", F.array().cast("array<string>")))
        .withColumn("preference_facets", F.coalesce("preference_facets", empty_facets))
        .withColumn("adjacent_categories", neighbour_categories(F.col("core_categories")))
        .withColumn("representative_terms", F.slice("topics", 1, REPRESENTATIVE_TERMS))
        .withColumn("schema_version", F.lit(PROFILE_SCHEMA_VERSION))
    )
    return with_budget(row, budget)


def with_budget(profiles: DataFrame, budget: int = PAYLOAD_BUDGET) -> DataFrame:
    """Payload size of every profile against the byte budget."""
    body = [c for c in profiles.columns if c not in ("payload_bytes", "within_budget")]
    size = F.octet_length(F.to_json(F.struct(*body)))
    return profiles.withColumn("payload_bytes", size).withColumn(
        "within_budget", F.col("payload_bytes") <= budget
    )


#: Lists of a payload in the order in which they are given room.
PAYLOAD_LISTS = [
    "core_categories", "topics", "representative_terms", "preference_facets", "watched_authors",
    "watched_institutions", "adjacent_categories", "representative_papers",
]


def reproject(profiles: DataFrame) -> DataFrame:
    """Exported profiles of any version held to the allowlist of today's version.

    Unsafe topics leave, lists are cut to their lengths, neighbours and representative terms are
    derived anew. Null lists of strings become empty; other columns stay.
    """
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    safe = F.filter(listed("topics"), lambda t: F.coalesce(text.is_safe_term(t), F.lit(False)))
    return (
        profiles.withColumn("topics", F.slice(safe, 1, TOPICS))
        .withColumn("core_categories", F.slice(listed("core_categories"), 1, CATEGORIES))
        .withColumn("adjacent_categories", neighbour_categories(F.col("core_categories")))
        .withColumn("representative_terms", F.slice("topics", 1, REPRESENTATIVE_TERMS))
        .withColumn("preference_facets", F.slice("preference_facets", 1, LONG_FACETS + RECENT_FACETS))
        .withColumn("schema_version", F.lit(PROFILE_SCHEMA_VERSION))
    )


def _room(lists: Sequence[str], left: Column) -> Column:
    """One fold over the entries of all lists: how many of each fit, and the bytes that are left.

    A list is closed by its first entry that does not fit; the next list goes on with what is left.
    """
    def sized(i: int) -> Column:
        # An entry alone in brackets is one byte longer than it is behind a comma.
        entry = lambda e: F.struct(
            F.lit(i).alias("at"), (F.octet_length(F.to_json(F.array(e))) - 1).alias("size")
        )
        return F.coalesce(
            F.transform(F.col(lists[i]), entry), F.array().cast("array<struct<at:int,size:int>>")
        )

    entries = F.flatten(F.array(*map(sized, range(len(lists)))))
    counts = [f"n{i}" for i in range(len(lists))]
    start = F.struct(
        left.cast("int").alias("left"), F.lit(-1).alias("closed"), *[F.lit(0).alias(n) for n in counts]
    )

    def step(held, entry):
        first = F.coalesce(*[F.when((entry["at"] == i) & (held[n] == 0), 1) for i, n in enumerate(counts)], F.lit(0))
        rest = held["left"] - entry["size"] + first
        fits = (held["closed"] != entry["at"]) & (rest >= 0)
        return F.struct(
            F.when(fits, rest).otherwise(held["left"]).alias("left"),
            F.when(fits, held["closed"]).otherwise(entry["at"]).alias("closed"),
            *[(held[n] + F.when(fits & (entry["at"] == i), 1).otherwise(0)).alias(n) for i, n in enumerate(counts)],
        )

    return F.aggregate(entries, start, step)


def fit_budget(
    profiles: DataFrame, budget: int | Column = PAYLOAD_BUDGET, beside: Sequence[str] = ()
) -> DataFrame:
    """Profiles cut to the byte budget: of each list, in the order of ``PAYLOAD_LISTS``, the longest
    prefix that still fits. Columns ``beside`` the payload are not counted. A profile whose other
    fields alone are too large keeps no entry and is marked by ``within_budget``. Null lists stay null.
    """
    apart = [*beside, "payload_bytes", "within_budget"]
    body = [c for c in profiles.columns if c not in apart]
    lists = [c for c in PAYLOAD_LISTS if c in body]
    size = lambda *cs: F.octet_length(F.to_json(F.struct(*cs)))
    bare = [F.slice(c, 1, 0).alias(c) if c in lists else F.col(c) for c in body]
    left = budget - size(*bare)
    folded = profiles.select(*beside, *body, _room(lists, left).alias("_room"))
    cut = [F.slice(c, 1, F.col(f"_room.n{lists.index(c)}")).alias(c) if c in lists else F.col(c) for c in body]
    return folded.select(*beside, *cut, (F.col("_room.left") >= 0).alias("within_budget")).select(
        *beside, *body, size(*body).alias("payload_bytes"), "within_budget"
    )


# ---- item digests and their cache -----------------------------------------------------------

_CHILD_BODY = [
    "abstract", "annotation_comment", "annotation_text", "collections", "creators", "date",
    "identifiers", "item_type", "key", "note_text", "parent_key", "title", "trashed", "version",
]


def _child_body() -> Column:
    tags = F.concat_ws(" ", F.transform(F.coalesce(F.col("tags"), F.array()), lambda t: t["tag"]))
    return F.concat_ws(
        " ", F.to_json(F.struct(*_CHILD_BODY), {"ignoreNullFields": "false"}), tags
    )


def digest_keys(items: DataFrame) -> DataFrame:
    """Content key of every seed item: its own payload plus a set digest of its children."""
    live = ~F.coalesce(F.col("trashed"), F.lit(False))
    children = items.filter(F.col("parent_key").isNotNull() & live).select(
        "profile_id", F.col("parent_key").alias("key"), F.sha2(_child_body(), 256).alias("_h")
    )
    digests = hashing.set_digest(children, F.col("_h"), ["profile_id", "key"], "_children")
    own = [c for c in items.columns if c not in ("profile_id",)]
    roots = items.filter(is_seed()).select(
        "profile_id", "key", "date", hashing.content_hash(own).alias("_own")
    )
    return roots.join(digests, ["profile_id", "key"], "left").select(
        "profile_id",
        F.col("key").alias("item_key"),
        "date",
        hashing.joined_key(
            F.col("_own"), F.coalesce(F.col("_children"), F.lit("none"))
        ).alias("content_hash"),
    )


def item_digests(items: DataFrame) -> DataFrame:
    """First forty distinct terms, hinted categories and year of each seed item."""
    first = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, DIGEST_TERMS)
    live = ~F.coalesce(F.col("trashed"), F.lit(False))
    from_children = items.filter(F.col("parent_key").isNotNull() & live).select(
        "profile_id",
        F.col("parent_key").alias("item_key"),
        F.explode(first(text.profile_tokens(_child_body()))).alias("term"),
    )
    from_roots = items.filter(is_seed()).select(
        "profile_id",
        F.col("key").alias("item_key"),
        F.explode_outer(first(text.profile_tokens(_root_text()))).alias("term"),
    )
    # Both sides are cut to forty terms in place, so a parent gathers few distinct terms.
    distinct = from_roots.unionByName(from_children).distinct()
    best = scale.top_per_group(
        distinct, ["profile_id", "item_key"], [F.col("term").asc_nulls_last()], DIGEST_TERMS + 1
    )
    listed = best.groupBy("profile_id", "item_key").agg(
        F.slice(F.array_sort(F.collect_list("term")), 1, DIGEST_TERMS).alias("terms")
    )
    keys = digest_keys(items)
    hinted = F.transform(F.col("terms"), _hinted_category)
    counts = F.array_sort(F.array_distinct(F.filter(hinted, lambda c: c.isNotNull())))
    ranked = F.transform(
        F.array_sort(
            F.transform(
                counts,
                lambda c: F.struct(
                    (-F.size(F.filter(hinted, lambda h: h == c))).alias("n"), c.alias("v")
                ),
            )
        ),
        lambda s: s["v"],
    )
    return keys.join(listed, ["profile_id", "item_key"]).select(
        "profile_id",
        "item_key",
        "content_hash",
        "terms",
        moments.first_year(F.col("date")).alias("year"),
        F.slice(ranked, 1, CATEGORIES).alias("categories"),
        F.lit(2).alias("schema_version"),
        F.lit(EXTRACTOR_VERSION).alias("extractor_version"),
    )


def stale_items(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Seed keys whose digest is not in the cache, by content and extractor (K7)."""
    keys = digest_keys(items).withColumn("extractor_version", F.lit(EXTRACTOR_VERSION))
    return keys.join(
        cache.select("content_hash", "extractor_version"),
        ["content_hash", "extractor_version"],
        "left_anti",
    )


def refresh_digests(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Digest of every seed item, reusing cached rows and computing only the misses.

    ``reused`` tells which rows came from the cache.
    """
    keys = digest_keys(items).select("profile_id", "item_key", "content_hash")
    hits = keys.join(
        cache.filter(F.col("extractor_version") == EXTRACTOR_VERSION)
        .drop("profile_id", "item_key")
        .dropDuplicates(["content_hash"]),
        "content_hash",
    ).withColumn("reused", F.lit(True))
    misses = stale_items(items, cache).select("profile_id", "item_key")
    wanted = items.join(
        misses.withColumnRenamed("item_key", "key"), ["profile_id", "key"], "left_semi"
    ).unionByName(
        items.join(
            misses.withColumnRenamed("item_key", "parent_key"),
            ["profile_id", "parent_key"],
            "left_semi",
        )
    )
    fresh = (
        item_digests(wanted)
        .join(misses, ["profile_id", "item_key"], "left_semi")
        .withColumn("reused", F.lit(False))
    )
    return hits.unionByName(fresh)


def representative_items(digests: DataFrame) -> DataFrame:
    """Eight items per profile, undated first, then newest."""
    order = [F.col("year").isNull().desc(), F.col("year").desc(), F.col("item_key").desc()]
    return scale.top_per_group(digests, ["profile_id"], order, REPRESENTATIVES).select(
        "profile_id", "rank", "item_key", "year",
        F.slice("terms", 1, REPRESENTATIVE_ITEM_TERMS).alias("terms"), "categories",
    )


def with_representatives(remote: DataFrame, digests: DataFrame, budget: int = PAYLOAD_BUDGET):
    """Remote profiles with representative items attached and the budget checked again."""
    value = F.struct("year", "terms", "categories")
    listed = representative_items(digests).groupBy("profile_id").agg(
        _ordered(F.struct("rank", value.alias("v"))).alias("representative_papers")
    )
    return with_budget(remote.join(listed, "profile_id", "left"), budget)
