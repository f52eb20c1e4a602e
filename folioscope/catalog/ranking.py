"""Profile, scoring and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.catalog.base import (
    NOW, PAPERS_SQL, PROFILE_SQL, RANK_TOKENS_SQL, SCORED_SQL, pairs, papers, pool, query,
)
from folioscope.functions import text
from folioscope.operators import ranking, selection


@query(
    "token_stats",
    f"""WITH t AS (SELECT lang, {RANK_TOKENS_SQL.format('text')} AS words FROM documents)
    SELECT lang, count(*) AS papers, CAST(sum(len(words)) AS BIGINT) AS distinct_tokens,
      CAST(max(len(words)) AS BIGINT) AS most_tokens
    FROM t GROUP BY lang""",
)
def token_stats(spark, sf_dir):
    words = papers(spark, sf_dir).select(
        "lang", F.size(text.ranking_terms(F.col("summary"))).cast("long").alias("n")
    )
    return words.groupBy("lang").agg(
        F.count(F.lit(1)).alias("papers"),
        F.sum("n").alias("distinct_tokens"),
        F.max("n").alias("most_tokens"),
    )


def scored_pairs(spark, sf_dir):
    candidates, people = pairs(spark, sf_dir)
    return ranking.score_candidates(candidates, people, NOW)


_PARTS = ["lexical", "category", "facet", "recency", "watched_author", "watched_institution", "score"]


def shortlisted(spark, sf_dir, limit, **options):
    """The first candidates of each reader, straight from the pool."""
    candidates, people = pool(spark, sf_dir)
    return ranking.pool_shortlist(candidates, people, NOW, limit, **options)


@query(
    "paper_score",
    f"""WITH {SCORED_SQL}
    SELECT profile_id, paper_id, source, {', '.join(f'round({c}, 6) AS {c}' for c in _PARTS)}
    FROM scored""",
)
def paper_score(spark, sf_dir):
    return scored_pairs(spark, sf_dir).select(
        "profile_id", "paper_id", "source", *[F.round(c, 6).alias(c) for c in _PARTS]
    )


@query(
    "paper_topk",
    f"""WITH {SCORED_SQL}
    SELECT profile_id, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, paper_id) AS BIGINT) AS rank,
      paper_id, source, round(score, 6) AS score
    FROM scored QUALIFY rank <= 20""",
)
def paper_topk(spark, sf_dir):
    best = shortlisted(spark, sf_dir, 20)
    return best.select(
        "profile_id", F.col("rank").cast("long").alias("rank"), "paper_id", "source",
        F.round("score", 6).alias("score"),
    )


_BASELINE_SQL = """baseline AS (
  SELECT *, hits + CASE source WHEN 'core' THEN 2.0 WHEN 'adjacent' THEN 1.0 ELSE 0.25 END
    + recency + watched_author + watched_institution AS base_score FROM features)"""


def baseline_pairs(spark, sf_dir):
    candidates, people = pairs(spark, sf_dir)
    return ranking.score_baseline(candidates, people, NOW)


@query(
    "baseline_score",
    f"""WITH {SCORED_SQL}, {_BASELINE_SQL}
    SELECT profile_id, paper_id, source, CAST(hits AS DOUBLE) AS lexical, round(base_score, 6) AS score
    FROM baseline""",
)
def baseline_score(spark, sf_dir):
    return baseline_pairs(spark, sf_dir).select(
        "profile_id", "paper_id", "source", "lexical", F.round("score", 6).alias("score")
    )


def walk_sql(source: str, score: str, minimum: float, limit: int, passes: str, strict: bool) -> str:
    """Greedy choice as a recursive walk over passes and ranks, one state row per reader."""
    stop = "len(w.picked) < 20" if strict else "(s.wanted <> 'any' OR len(w.picked) < 20)"
    return f"""ranked AS (
      SELECT profile_id, paper_id, source, {score} AS score, authors, {RANK_TOKENS_SQL.format('title')} AS title_words,
        row_number() OVER (PARTITION BY profile_id ORDER BY {score} DESC, paper_id) AS rank
      FROM {source} QUALIFY rank <= {limit}),
    kept AS (SELECT * FROM ranked WHERE score >= {minimum}),
    passes(pass, wanted, cap) AS (VALUES {passes}),
    steps AS (
      SELECT k.*, wanted, cap, row_number() OVER (PARTITION BY profile_id ORDER BY pass, rank) AS step
      FROM kept k JOIN passes p ON p.wanted = 'any' OR p.wanted = k.source),
    walk AS (
      SELECT profile_id, CAST(0 AS BIGINT) AS step, CAST([] AS VARCHAR[]) AS picked,
        CAST([] AS VARCHAR[]) AS sources, CAST([] AS VARCHAR[]) AS names, CAST([] AS VARCHAR[][]) AS titles
      FROM (SELECT DISTINCT profile_id FROM kept)
      UNION ALL
      SELECT w.profile_id, s.step,
        CASE WHEN ok THEN list_append(w.picked, s.paper_id) ELSE w.picked END,
        CASE WHEN ok THEN list_append(w.sources, s.source) ELSE w.sources END,
        CASE WHEN ok THEN list_concat(w.names, list_transform(s.authors, lambda a: lower(a))) ELSE w.names END,
        CASE WHEN ok THEN list_append(w.titles, s.title_words) ELSE w.titles END
      FROM walk w JOIN steps s ON s.profile_id = w.profile_id AND s.step = w.step + 1,
      LATERAL (SELECT {stop} AND NOT list_contains(w.picked, s.paper_id)
        AND (s.wanted = 'any' OR len(list_filter(w.sources, lambda x: x = s.source)) < s.cap)
        AND len(list_filter(s.authors, lambda a: len(list_filter(w.names, lambda n: n = lower(a))) >= 2)) = 0
        AND (len(s.title_words) = 0 OR len(list_filter(w.titles, lambda t:
          len(list_intersect(s.title_words, t)) / len(list_distinct(list_concat(s.title_words, t))) > 0.8)) = 0) AS ok)),
    final AS (SELECT profile_id, picked FROM walk QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY step DESC) = 1),
    chosen AS (SELECT profile_id, unnest(picked) AS paper_id, generate_subscripts(picked, 1) AS selected_order FROM final),
    chosen_rows AS (
      SELECT c.profile_id, c.paper_id, CAST(c.selected_order AS BIGINT) AS selected_order, r.source, r.score
      FROM chosen c JOIN ranked r ON r.profile_id = c.profile_id AND r.paper_id = c.paper_id
      WHERE c.selected_order <= 20)
    """


_CHOSEN_SQL = """SELECT profile_id, paper_id, selected_order, source, round(score, 6) AS score FROM chosen_rows"""


DIVERSE_PASSES = "(1, 'exploration', 2), (2, 'core', 14), (3, 'adjacent', 4), (4, 'any', 20)"
_BASELINE_PASSES = "(1, 'core', 14), (2, 'adjacent', 4), (3, 'exploration', 2), (4, 'any', 20)"


def _chosen(df):
    return df.select(
        "profile_id", "paper_id", F.col("selected_order").cast("long").alias("selected_order"),
        "source", F.round("score", 6).alias("score"),
    )


@query(
    "diverse_select",
    f"WITH RECURSIVE {SCORED_SQL}, "
    + walk_sql("scored", "score", 0.2, 60, DIVERSE_PASSES, True) + _CHOSEN_SQL,
)
def diverse_select(spark, sf_dir):
    return _chosen(selection.select_diverse(shortlisted(spark, sf_dir, 60), pre_rank_limit=60))


@query(
    "baseline_select",
    f"WITH RECURSIVE {SCORED_SQL}, {_BASELINE_SQL}, "
    + walk_sql("baseline", "base_score", 1.0, 40, _BASELINE_PASSES, False) + _CHOSEN_SQL,
)
def baseline_select(spark, sf_dir):
    return _chosen(selection.select_baseline(
        shortlisted(spark, sf_dir, 40, score=ranking.score_baseline), pre_rank_limit=40))
