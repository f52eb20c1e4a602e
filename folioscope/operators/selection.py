"""Quota-bounded, diverse reading lists."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.operators import ranking
from folioscope.session import materialized

# ---- fixed values -------------------------------------------------------------------------
POLICY = {
    "minimum_score": 0.2, "target": 20, "core_cap": 14, "adjacent_cap": 4, "exploration_cap": 2,
    "minimum_judged_quality": 0.25, "minimum_solution_advance": 0.5,
    "minimum_technical_depth": 0.5, "minimum_value_confidence": 0.5,
}
BASELINE_MINIMUM_SCORE = 1.0
AUTHOR_LIMIT = 2
TITLE_SIMILARITY = 0.8
# -------------------------------------------------------------------------------------------


def policy(**changes: float) -> dict:
    """Selection limits, checked (V5)."""
    limits = {**POLICY, **changes}
    if any(not 0 <= v <= 1 for k, v in limits.items() if k.startswith("minimum")):
        raise ValueError("selection thresholds must be normalized")
    if limits["target"] < 1 or min(limits["core_cap"], limits["adjacent_cap"]) < 0:
        raise ValueError("selection counts are invalid")
    if limits["exploration_cap"] < 1:
        raise ValueError("a policy must reserve an exploration slot")
    return limits


def value_rejected(limits: dict):
    """True only for a confident, known shortfall; unknown passes."""
    short = lambda c, least: F.coalesce(F.col(c) < least, F.lit(False))
    return F.coalesce(F.col("value_confidence") >= limits["minimum_value_confidence"], F.lit(False)) & (
        short("solution_advance", limits["minimum_solution_advance"])
        | short("technical_depth", limits["minimum_technical_depth"])
    )


def qualified(scored: DataFrame, limits: dict) -> DataFrame:
    """Score, judged-quality and value gates (P2-P4); missing evidence never fails a gate."""
    kept = scored.filter(F.col("score") >= limits["minimum_score"])
    if "scientific_quality_value" in scored.columns:
        least = limits["minimum_judged_quality"]
        kept = kept.filter(F.coalesce("scientific_quality_value", F.lit(least)) >= least)
    if "value_confidence" in scored.columns:
        kept = kept.filter(~value_rejected(limits))
    return kept


def _greedy(rows: pd.DataFrame, passes: Sequence[tuple[str | None, int]], stop: int, strict: bool):
    """Walk the passes in rank order, taking what stays within the caps and the diversity rule."""
    rows = rows.sort_values("rank", kind="stable")
    entries = [
        (index, source, [a.casefold() for a in authors], frozenset(title))
        for index, source, authors, title in zip(
            rows.index, rows["source"], rows["authors"], rows["title_terms"], strict=True
        )
    ]
    taken: dict[int, int] = {}
    by_source: dict[str, int] = {}
    by_author: dict[str, int] = {}
    titles: list[frozenset] = []
    for wanted, cap in passes:
        for index, source, authors, title in entries:
            full = len(taken) >= stop if (strict or wanted is None) else False
            if full or index in taken or (wanted is not None and source != wanted):
                continue
            if wanted is not None and by_source.get(source, 0) >= cap:
                continue
            if any(by_author.get(a, 0) >= AUTHOR_LIMIT for a in authors):
                continue
            if title and any(
                len(title & other) / len(title | other) > TITLE_SIMILARITY for other in titles
            ):
                continue
            taken[index] = len(taken) + 1
            by_source[source] = by_source.get(source, 0) + 1
            for a in authors:
                by_author[a] = by_author.get(a, 0) + 1
            titles.append(title)
    picked = rows.loc[list(taken)[:stop], ["_key", "paper_id"]]
    return picked.assign(selected_order=range(1, len(picked) + 1))


def _select(short: DataFrame, keys: Sequence[str], passes, stop: int, strict: bool) -> DataFrame:
    """Sequential choice per profile over its shortlist (U4); at most 80 rows reach one call.

    The shortlist is written once: it is read for the choice and again for the chosen rows, and
    scoring must not run twice.
    """
    short = materialized(short, "shortlist")
    lean = short.select(
        F.to_json(F.struct(*keys)).alias("_key"),
        "paper_id",
        "rank",
        "source",
        "authors",
        text.ranking_terms(F.col("title")).alias("title_terms"),
    )
    chosen = lean.groupBy("_key").applyInPandas(
        lambda rows: _greedy(rows, passes, stop, strict),
        "_key string, paper_id string, selected_order int",
    )
    return (
        short.withColumn("_key", F.to_json(F.struct(*keys)))
        .join(chosen, ["_key", "paper_id"])
        .drop("_key")
    )


def _cut(scored: DataFrame, limit: int, keys: Sequence[str]) -> DataFrame:
    if "rank" in scored.columns:
        if not 1 <= limit <= ranking.SHORTLIST_MOST:
            raise ValueError("the shortlist holds between 1 and 80 candidates")
        return scored.filter(F.col("rank") <= limit)
    return ranking.shortlist(scored, limit, keys)


def select_diverse(
    scored: DataFrame,
    *,
    limits: dict | None = None,
    pre_rank_limit: int = 60,
    keys: Sequence[str] = ("profile_id",),
) -> DataFrame:
    """Shortlist, gate, then fill exploration, core, adjacent and open places in turn."""
    limits = limits or policy()
    short = _cut(scored, pre_rank_limit, keys)
    passes = [
        ("exploration", limits["exploration_cap"]),
        ("core", limits["core_cap"]),
        ("adjacent", limits["adjacent_cap"]),
        (None, limits["target"]),
    ]
    return _select(qualified(short, limits), keys, passes, limits["target"], strict=True)


def select_baseline(
    scored: DataFrame,
    *,
    minimum_score: float = BASELINE_MINIMUM_SCORE,
    target: int = 20,
    pre_rank_limit: int = 40,
    keys: Sequence[str] = ("profile_id",),
) -> DataFrame:
    """The frozen order core, adjacent, exploration, open places (C4)."""
    short = _cut(scored, pre_rank_limit, keys)
    passes = [("core", 14), ("adjacent", 4), ("exploration", 2), (None, target)]
    return _select(
        short.filter(F.col("score") >= minimum_score), keys, passes, target, strict=False
    )


# Functions travel to the workers by value, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
