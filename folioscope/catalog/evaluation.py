"""Label ledger, split, metric and efficiency queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.catalog.base import (
    FEEDBACK_SQL, NOW, PAPER_KEY_SQL, SCORED_SQL, feedback_events, paper_key,
    papers, pool, query, table,
)
from folioscope.operators import corpus, efficiency, evaluation, quality, ranking
from folioscope.operators.weights import QUALITY_FIRST, BASELINE_VERSION, ablations
from folioscope.session import materialized

CUTOFF = "2024-01-26T00:00:00+00:00"


def corpus_events(spark, sf_dir):
    """Labels as a ledger: a first judgment, toxic papers judged again, neighbours compared."""
    labels = table(spark, sf_dir, "labels")
    paper = F.concat(F.lit("arxiv:"), paper_key("doc_id"))
    doc = F.col("doc_id")
    day = lambda n: F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=n.cast("int"))
    none = F.lit(None).cast("string")

    def rows(df, prefix, kind, label, at, other=none):
        return df.select(
            F.concat(F.lit(prefix), doc.cast("string")).alias("event_id"), kind.alias("kind"),
            paper.alias("paper_id"), at.alias("occurred_at"), F.lit("review").alias("source"),
            label.alias("label"), other.alias("compared_paper_id"),
            F.array().cast("array<string>").alias("reason_codes"),
            F.array().cast("array<string>").alias("applicable_dimensions"),
            none.alias("private_rationale"), none.alias("supersedes_event_id"),
            none.alias("source_item_key"),
        )

    good = F.col("quality") == 1
    first = rows(
        labels, "a", F.lit("label"), F.when(good, "positive").otherwise("negative"), day(doc % 20)
    )
    again = rows(
        labels.filter("toxic = 1"), "b",
        F.when(good, "label").otherwise("unlabel"), F.when(good, "negative"),
        day(doc % 20 + doc % 3),
    )
    following = labels.select((doc - 1).alias("doc_id"), F.col("quality").alias("_next"))
    compared = labels.join(following, "doc_id").filter(F.col("quality") > F.col("_next"))
    other = F.concat(
        F.lit("arxiv:"),
        F.format_string("%04d.%05d", F.floor((doc + 1) / 100000), (doc + 1) % 100000),
    )
    preferred = rows(compared, "c", F.lit("pairwise"), F.lit("positive"), day(doc % 20), other)
    return first.unionByName(again).unionByName(preferred)


_DAY = "TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST({0} AS INTEGER))"
CORPUS_SQL = f"""corpus AS (
  SELECT 'a' || CAST(doc_id AS VARCHAR) AS event_id, 'label' AS kind, 'arxiv:' || {PAPER_KEY_SQL} AS paper_id,
    {_DAY.format('doc_id % 20')} AS occurred_at, CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS label,
    CAST(NULL AS VARCHAR) AS other FROM labels
  UNION ALL
  SELECT 'b' || CAST(doc_id AS VARCHAR), CASE WHEN quality = 1 THEN 'label' ELSE 'unlabel' END, 'arxiv:' || {PAPER_KEY_SQL},
    {_DAY.format('doc_id % 20 + doc_id % 3')}, CASE WHEN quality = 1 THEN 'negative' END, NULL FROM labels WHERE toxic = 1
  UNION ALL
  SELECT 'c' || CAST(l.doc_id AS VARCHAR), 'pairwise', 'arxiv:' || {PAPER_KEY_SQL.replace('doc_id', 'l.doc_id')},
    {_DAY.format('l.doc_id % 20')}, 'positive', 'arxiv:' || {PAPER_KEY_SQL.replace('doc_id', 'm.doc_id')}
  FROM labels l JOIN labels m ON m.doc_id = l.doc_id + 1 WHERE l.quality > m.quality),
seen AS (SELECT * FROM corpus WHERE occurred_at <= TIMESTAMP '2024-01-26 00:00:00'),
judged AS (SELECT * FROM seen WHERE kind <> 'pairwise'),
resolved AS (
  SELECT paper_id, label, occurred_at AS resolved_at, event_id FROM (
    SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY occurred_at DESC, event_id DESC) = 1)
  WHERE kind = 'label'),
pairwise AS (SELECT paper_id, other, event_id FROM seen WHERE kind = 'pairwise')"""


@query(
    "latest_label",
    f"""WITH {CORPUS_SQL} SELECT paper_id, label, event_id,
    strftime(resolved_at, '%Y-%m-%d') AS resolved_on FROM resolved""",
)
def latest_label(spark, sf_dir):
    labels = corpus.resolved_labels(corpus_events(spark, sf_dir), CUTOFF)
    return labels.select(
        "paper_id", "label", "event_id",
        F.date_format("resolved_at", "yyyy-MM-dd").alias("resolved_on"),
    )


@query(
    "label_conflicts",
    f"""WITH {CORPUS_SQL},
    latest AS (SELECT paper_id, max(occurred_at) AS at FROM judged GROUP BY ALL)
    SELECT j.paper_id, count(DISTINCT CASE WHEN kind = 'label' THEN label END) AS labels
    FROM judged j JOIN latest l ON l.paper_id = j.paper_id AND l.at = j.occurred_at
    GROUP BY ALL HAVING labels > 1""",
)
def label_conflicts(spark, sf_dir):
    found = corpus.label_conflicts(corpus_events(spark, sf_dir), CUTOFF)
    return found.select("paper_id", "labels")


@query(
    "snapshot_header",
    f"""WITH {CORPUS_SQL},
    hashed AS (SELECT sha256(concat_ws('|', event_id, kind, paper_id, strftime(occurred_at, '%Y-%m-%d'),
      coalesce(label, '-'), coalesce(other, '-'))) AS h FROM seen),
    sums AS (SELECT count(*) AS n, {', '.join(
        f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS UBIGINT)) AS VARCHAR) AS w{i}" for i in range(8))} FROM hashed),
    latest AS (SELECT paper_id, max(occurred_at) AS at FROM judged GROUP BY ALL),
    conflicts AS (SELECT j.paper_id FROM judged j JOIN latest l ON l.paper_id = j.paper_id AND l.at = j.occurred_at
      GROUP BY ALL HAVING count(DISTINCT CASE WHEN kind = 'label' THEN label END) > 1)
    SELECT n AS revision, sha256(concat_ws('|', CAST(n AS VARCHAR), {', '.join(f'w{i}' for i in range(8))})) AS digest,
      (SELECT count(*) FROM conflicts) AS conflict_count FROM sums""",
)
def snapshot_header(spark, sf_dir):
    row = F.sha2(
        F.concat_ws(
            "|", "event_id", "kind", "paper_id", F.date_format("occurred_at", "yyyy-MM-dd"),
            F.coalesce("label", F.lit("-")), F.coalesce("compared_paper_id", F.lit("-")),
        ),
        256,
    )
    header = corpus.snapshot_header(corpus_events(spark, sf_dir), CUTOFF, row)
    return header.select("revision", "digest", "conflict_count")


def label_items(spark, sf_dir):
    """Labelled documents as library items in label collections, with override and reason tags."""
    doc = F.col("doc_id")
    number = paper_key("doc_id")
    return table(spark, sf_dir, "labels").select(
        F.concat(F.lit("K"), doc.cast("string")).alias("item_key"),
        F.when(doc % 4 == 0, F.array(F.lit("isbn 7"), F.concat(F.lit("10.48550/arXiv."), number, F.lit("v2"))))
        .when(doc % 4 == 1, F.array(F.concat(F.lit("DOI:10.5555/doc."), doc.cast("string"))))
        .when(doc % 4 == 2, F.array(F.concat(F.lit("arXiv:"), number, F.lit("v3"))))
        .otherwise(F.array(F.lit("isbn 9")))
        .alias("identifiers"),
        F.when(F.col("toxic") == 1, F.array(F.lit("other")))
        .otherwise(F.array(F.when(F.col("quality") == 1, "good").otherwise("bad")))
        .alias("collections"),
        F.when(doc % 8 == 3, F.array(F.concat(F.lit("Ranking-Paper-ID: arxiv:"), number), F.lit("ranking-reason: clear")))
        .otherwise(F.array(F.lit("x")))
        .alias("tags"),
    )


def imported_ledger(spark, sf_dir):
    """What an earlier import of the same items had recorded, part of it out of date by now."""
    doc = F.col("doc_id")
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "labels").filter((doc % 4 == 0) | (doc % 4 == 2)).select(
        F.concat(F.lit("z"), doc.cast("string")).alias("event_id"),
        F.when((doc % 10 == 0), "unlabel").otherwise("label").alias("kind"),
        F.concat(F.lit("arxiv:"), paper_key("doc_id")).alias("paper_id"),
        F.lit("2024-01-01").cast("timestamp").alias("occurred_at"),
        F.lit("library").alias("source"),
        F.when(doc % 10 != 0, F.when(F.col("quality") == 1, "positive").otherwise("negative")).alias("label"),
        none.alias("compared_paper_id"),
        F.array().cast("array<string>").alias("reason_codes"),
        F.array().cast("array<string>").alias("applicable_dimensions"),
        none.alias("private_rationale"), none.alias("supersedes_event_id"),
        F.concat(F.lit("K"), doc.cast("string")).alias("source_item_key"),
    )


@query(
    "label_diff",
    f"""WITH item AS (
      SELECT 'K' || CAST(doc_id AS VARCHAR) AS item_key, doc_id, quality, toxic,
        CASE WHEN toxic = 0 THEN CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END END AS new_label,
        CASE WHEN doc_id % 8 = 3 OR doc_id % 4 IN (0, 2) THEN 'arxiv:' || {PAPER_KEY_SQL}
             WHEN doc_id % 4 = 1 THEN 'doi:10.5555/doc.' || CAST(doc_id AS VARCHAR) END AS new_paper,
        CASE WHEN doc_id % 8 = 3 THEN '|clear' ELSE '' END AS reasons FROM labels),
    old AS (SELECT 'z' || CAST(doc_id AS VARCHAR) AS event_id, 'K' || CAST(doc_id AS VARCHAR) AS item_key, 'arxiv:' || {PAPER_KEY_SQL} AS old_paper,
      CASE WHEN doc_id % 10 = 0 THEN 'unlabel' ELSE 'label' END AS kind,
      CASE WHEN doc_id % 10 <> 0 THEN CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END END AS old_label
      FROM labels WHERE doc_id % 4 IN (0, 2)),
    joined AS (SELECT i.*, o.event_id, o.kind, o.old_paper, o.old_label,
      CASE WHEN new_label IS NOT NULL AND new_paper IS NOT NULL AND coalesce(kind = 'label' AND old_paper = new_paper AND old_label = new_label AND reasons = '', false) THEN 'same'
           WHEN new_label IS NOT NULL AND new_paper IS NOT NULL THEN 'label'
           WHEN o.event_id IS NOT NULL AND kind <> 'unlabel' THEN 'unlabel'
           WHEN new_label IS NOT NULL THEN 'skipped' ELSE 'same' END AS action
      FROM item i LEFT JOIN old o USING (item_key) WHERE new_label IS NOT NULL OR o.event_id IS NOT NULL)
    SELECT item_key, action,
      CASE action WHEN 'label' THEN 'library-' || substr(sha256(item_key || '|' || new_paper || '|' || new_label || reasons || '|' || coalesce(event_id, '')), 1, 24)
        WHEN 'unlabel' THEN 'library-' || substr(sha256(item_key || '|' || event_id || '|unlabel'), 1, 24) END AS new_event_id,
      CASE WHEN action = 'label' THEN new_paper ELSE old_paper END AS paper_id,
      CASE WHEN action = 'label' THEN new_label END AS label FROM joined""",
)
def label_diff(spark, sf_dir):
    changes = corpus.label_changes(
        label_items(spark, sf_dir), imported_ledger(spark, sf_dir), ["good"], ["bad"], CUTOFF
    )
    return changes.select("item_key", "action", "new_event_id", "paper_id", "label")


@query(
    "resolved_candidates",
    f"""WITH {CORPUS_SQL} SELECT count(*) AS labelled,
      count(*) FILTER (d.doc_id IS NOT NULL) AS found, count(*) FILTER (d.doc_id IS NULL) AS missing
    FROM resolved r LEFT JOIN documents d ON r.paper_id = 'arxiv:' || {PAPER_KEY_SQL}""",
)
def resolved_candidates(spark, sf_dir):
    labels = corpus.resolved_labels(corpus_events(spark, sf_dir), CUTOFF)
    found, missing = corpus.resolve_candidates(
        labels, papers(spark, sf_dir).select("paper_id", "updated")
    )
    both = found.select(F.lit(1).alias("f")).unionByName(missing.select(F.lit(0).alias("f")))
    return both.agg(
        F.count(F.lit(1)).alias("labelled"),
        F.count_if(F.col("f") == 1).alias("found"),
        F.count_if(F.col("f") == 0).alias("missing"),
    )


def split_inputs(spark, sf_dir):
    events = corpus_events(spark, sf_dir)
    labels = materialized(corpus.resolved_labels(events, CUTOFF), "labels")
    preferences = materialized(corpus.pairwise_judgments(events, CUTOFF), "preferences")
    anchors = labels.filter(F.col("label") == "negative").select("paper_id")
    splits = evaluation.make_splits(
        labels, preferences, CUTOFF, anchors=anchors, rolling_days=10, holdout_ratio=0.2
    )
    return labels, preferences, materialized(splits, "splits")


SPLITS_SQL = f"""{CORPUS_SQL},
timed AS (SELECT paper_id, row_number() OVER (ORDER BY resolved_at, paper_id) AS r,
  count(*) OVER () - CAST(ceil(count(*) OVER () * 0.2::DOUBLE) AS BIGINT) AS train FROM resolved),
named AS (
  SELECT 'rolling' AS split, paper_id FROM resolved WHERE resolved_at >= TIMESTAMP '2024-01-16 00:00:00'
  UNION ALL SELECT 'stable-anchor', paper_id FROM resolved WHERE label = 'negative'
  UNION SELECT 'pairwise', paper_id FROM pairwise UNION SELECT 'pairwise', other FROM pairwise),
splits AS (
  SELECT CASE WHEN r > train THEN 'temporal-holdout' ELSE 'temporal-train' END AS split,
    CASE WHEN r > train THEN r - train ELSE r END AS position, paper_id FROM timed
  UNION ALL SELECT split, row_number() OVER (PARTITION BY split ORDER BY paper_id), paper_id FROM named)"""


@query("eval_splits", f"WITH {SPLITS_SQL} SELECT split, position, paper_id FROM splits")
def eval_splits(spark, sf_dir):
    return split_inputs(spark, sf_dir)[2]


def metrics_sql(ranked: str) -> str:
    """Metrics over a CTE ``ranked`` with ranking_id, paper_id, doi, score, source, category, facets."""
    return f"""{ranked},
alias AS (SELECT ranking_id, paper_id, score, paper_id AS id FROM ranked
  UNION SELECT ranking_id, paper_id, score, CASE WHEN doi LIKE '10.48550/arxiv.%' THEN 'arxiv:' || substr(doi, 16) ELSE 'doi:' || doi END
  FROM ranked WHERE doi IS NOT NULL),
lab AS (SELECT s.split, s.paper_id AS id, r.label FROM splits s JOIN resolved r USING (paper_id)
  WHERE s.split IN ('temporal-holdout', 'rolling')),
item AS (SELECT split, ranking_id, paper_id, score, min(label) AS label FROM alias JOIN lab USING (id)
  GROUP BY split, ranking_id, alias.paper_id, score),
sizes AS (SELECT split, count(*) AS n, count(*) FILTER (label = 'positive') AS pos, count(*) FILTER (label = 'negative') AS neg FROM lab GROUP BY ALL),
overlap AS (SELECT split, ranking_id, count(*) AS co, count(*) FILTER (label = 'positive') AS cp, count(*) FILTER (label = 'negative') AS cn
  FROM (SELECT DISTINCT ranking_id, id FROM alias) JOIN lab USING (id) GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY ranking_id ORDER BY score DESC, paper_id) AS rank FROM ranked QUALIFY rank <= 60),
ks(k) AS (VALUES (20), (60)),
hits AS (SELECT split, t.ranking_id, k, count(*) AS labelled, count(*) FILTER (label = 'positive') AS hp, count(*) FILTER (label = 'negative') AS hn,
    coalesce(sum(1 / log2(rank + 1)) FILTER (label = 'positive'), 0.0) AS dcg
  FROM top t JOIN ks ON rank <= k JOIN item i ON i.ranking_id = t.ranking_id AND i.paper_id = t.paper_id GROUP BY ALL),
cover AS (SELECT ranking_id, k, count(DISTINCT source) AS sc, count(DISTINCT category) AS cc FROM top JOIN ks ON rank <= k GROUP BY ALL),
div AS (SELECT a.ranking_id, k, 1 - avg(CASE WHEN len(list_distinct(list_concat(a.facets, b.facets))) = 0 THEN 0.0
    ELSE len(list_intersect(list_distinct(a.facets), list_distinct(b.facets))) / len(list_distinct(list_concat(a.facets, b.facets))) END) AS d
  FROM top a JOIN ks ON a.rank <= k JOIN top b ON b.ranking_id = a.ranking_id AND b.rank > a.rank AND b.rank <= k GROUP BY ALL),
bounds AS (SELECT ranking_id, min(score) AS lo, max(score) AS hi FROM ranked GROUP BY ALL),
brier AS (SELECT split, ranking_id, avg(pow(CASE WHEN hi = lo THEN 0.5 ELSE (score - lo) / (hi - lo) END
    - CASE WHEN label = 'positive' THEN 1 ELSE 0 END, 2)) AS b FROM item JOIN bounds USING (ranking_id) GROUP BY ALL),
pw AS (SELECT s1.split, a.ranking_id, avg(CASE WHEN a.score > b.score THEN 1.0 ELSE 0.0 END) AS acc
  FROM pairwise p JOIN splits s1 ON s1.paper_id = p.paper_id JOIN splits s2 ON s2.paper_id = p.other AND s2.split = s1.split
  JOIN ranked a ON a.paper_id = p.paper_id JOIN ranked b ON b.paper_id = p.other AND b.ranking_id = a.ranking_id GROUP BY ALL),
metrics AS (
  SELECT s.split, c.ranking_id, c.k, n AS evaluated_labels, pos AS positive_labels, neg AS negative_labels,
    coalesce(hp, 0) / nullif(pos, 0) AS recall_at_k, hp / nullif(labelled, 0) AS precision_at_k,
    CASE WHEN pos > 0 THEN coalesce(dcg, 0) / list_sum(list_transform(range(1, least(pos, c.k) + 1), lambda i: 1 / log2(i + 1))) END AS ndcg_at_k,
    hn / nullif(labelled, 0) AS negative_rate_at_k, sc AS source_coverage_at_k, cc AS category_coverage_at_k,
    d AS intra_list_diversity_at_k, b AS brier_score, acc AS pairwise_accuracy,
    n < 5 OR coalesce(co, 0) < 5 OR pos = 0 AS provisional, coalesce(co, 0) AS candidate_overlap,
    coalesce(cp, 0) AS candidate_positive_labels, coalesce(cn, 0) AS candidate_negative_labels,
    coalesce(hp, 0) / nullif(cp, 0) AS candidate_recall_at_k
  FROM cover c CROSS JOIN sizes s
  LEFT JOIN overlap o ON o.split = s.split AND o.ranking_id = c.ranking_id
  LEFT JOIN hits h ON h.split = s.split AND h.ranking_id = c.ranking_id AND h.k = c.k
  LEFT JOIN div ON div.ranking_id = c.ranking_id AND div.k = c.k
  LEFT JOIN brier ON brier.split = s.split AND brier.ranking_id = c.ranking_id
  LEFT JOIN pw ON pw.split = s.split AND pw.ranking_id = c.ranking_id)"""


def _facets_sql(title: str) -> str:
    return f"regexp_extract_all(replace(lower({title}), 'ß', 'ss'), '[a-z][a-z0-9-]{{2,}}')[1:12]"


_READER_RANKED_SQL = f"""ranked AS (
  SELECT profile_id AS ranking_id, 'arxiv:' || paper_id AS paper_id, doi, score, source, categories[1] AS category,
    {_facets_sql('title')} AS facets FROM scored)"""
_WHOLE = [
    "evaluated_labels", "positive_labels", "negative_labels", "source_coverage_at_k",
    "category_coverage_at_k", "candidate_overlap", "candidate_positive_labels",
    "candidate_negative_labels",
]
_REAL = [
    "recall_at_k", "precision_at_k", "ndcg_at_k", "negative_rate_at_k",
    "intra_list_diversity_at_k", "brier_score", "pairwise_accuracy", "candidate_recall_at_k",
]


def _faceted_pairs(spark, sf_dir):
    """Candidates paired with their readers; facets are cut from a title before it is paired."""
    candidates, people = pool(spark, sf_dir)
    faceted = ranking.prepare_candidates(candidates.withColumn("facets", evaluation.title_facets()))
    return ranking.assign_pool(faceted.drop("title"), people), people


def reader_rankings(spark, sf_dir):
    candidates, people = _faceted_pairs(spark, sf_dir)
    scored = ranking.score_candidates(candidates, people, NOW)
    return evaluation.ranked_papers(scored, F.col("profile_id"))


@query(
    "rank_metrics",
    f"""WITH {SCORED_SQL}, {SPLITS_SQL}, {metrics_sql(_READER_RANKED_SQL)}
    SELECT split, ranking_id, CAST(k AS BIGINT) AS k, provisional, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _WHOLE)},
      {', '.join(f'round({c}, 6)::DOUBLE AS {c}' for c in _REAL)} FROM metrics""",
)
def rank_metrics(spark, sf_dir):
    labels, preferences, splits = split_inputs(spark, sf_dir)
    metrics = evaluation.evaluate_rankings(
        reader_rankings(spark, sf_dir), labels, splits, preferences, ks=(20, 60),
        split_names=("temporal-holdout", "rolling"),
    )
    return metrics.select(
        "split", "ranking_id", F.col("k").cast("long").alias("k"), "provisional",
        *[F.col(c).cast("long").alias(c) for c in _WHOLE],
        *[F.round(c, 6).alias(c) for c in _REAL],
    )


_SETS = [QUALITY_FIRST, *ablations(QUALITY_FIRST)]


def version_rankings(spark, sf_dir):
    """Every reader's candidates with their scores under the baseline, the candidate weights and each
    ablation."""
    candidates, people = _faceted_pairs(spark, sf_dir)
    features = ranking.feature_table(candidates, people, NOW)
    return evaluation.ranked_papers(ranking.version_scores(features, _SETS), F.col("profile_id"))


def version_metrics(spark, sf_dir):
    labels, preferences, splits = split_inputs(spark, sf_dir)
    metrics = evaluation.evaluate_rankings(
        version_rankings(spark, sf_dir), labels, splits, preferences, ks=(20, 60),
        split_names=("temporal-holdout",), versions=ranking.version_names(_SETS),
    )
    named = metrics.withColumnsRenamed({"ranking_id": "profile_id", "version": "ranking_id"})
    return materialized(named, "metrics")


def _versions_sql() -> str:
    values = []
    for s in _SETS:
        values.append(f"('{s['version']}', {s['interest']}::DOUBLE, {s['recency']}::DOUBLE, {s['identity']}::DOUBLE)")
    return f"""sets(version, wi, wr, wd) AS (VALUES {', '.join(values)}),
ranked AS (
  SELECT profile_id || '|' || version AS ranking_id, 'arxiv:' || paper_id AS paper_id, doi,
    (wi * interest_value + wr * recency_value + wd * identity_value) / (wi + wr + wd) AS score,
    source, categories[1] AS category, {_facets_sql('title')} AS facets FROM valued CROSS JOIN sets
  UNION ALL
  SELECT profile_id || '|{BASELINE_VERSION}', 'arxiv:' || paper_id, doi,
    hits + CASE source WHEN 'core' THEN 2.0 WHEN 'adjacent' THEN 1.0 ELSE 0.25 END + recency + watched_author + watched_institution,
    source, categories[1], {_facets_sql('title')} FROM features)"""


_VERSION_METRICS_SQL = f"""WITH {SCORED_SQL}, {SPLITS_SQL}, {metrics_sql(_versions_sql())},
v AS (SELECT *, split_part(ranking_id, '|', 1) AS profile_id, split_part(ranking_id, '|', 2) AS version FROM metrics
  WHERE split = 'temporal-holdout')"""


@query(
    "ranking_compare",
    f"""{_VERSION_METRICS_SQL},
    j AS (SELECT c.profile_id, c.version AS candidate_name, CAST(c.k AS BIGINT) AS k, c.ndcg_at_k - b.ndcg_at_k AS nd,
      c.candidate_recall_at_k - b.candidate_recall_at_k AS rd, c.negative_rate_at_k - b.negative_rate_at_k AS ng,
      least(c.candidate_overlap, b.candidate_overlap) AS ov,
      b.candidate_positive_labels = 0 OR c.candidate_positive_labels = 0 AS nopos, c.positive_labels = 0 AS noidcg
      FROM v c JOIN v b ON b.profile_id = c.profile_id AND b.k = c.k AND b.version = '{BASELINE_VERSION}' WHERE c.version <> '{BASELINE_VERSION}')
    SELECT profile_id, candidate_name, k, round(nd, 6) AS ndcg_delta, round(rd, 6) AS recall_delta, round(ng, 6) AS negative_rate_delta,
      concat_ws('; ', CASE WHEN nd < 0.05 THEN 'NDCG improvement is below the 0.05 release target' END,
        CASE WHEN ng > 0 THEN 'negative-label rate increased' END) AS reasons,
      concat_ws('; ', CASE WHEN noidcg THEN 'no positive labels available for recall or NDCG' END,
        CASE WHEN ov = 0 THEN 'candidate-label overlap is zero for at least one ranking' WHEN ov < 5 THEN 'few overlapping labels; metric uncertainty is high' END,
        CASE WHEN ov < 5 THEN 'sparse independent-label sample; metric uncertainty is high' END,
        CASE WHEN nopos THEN 'no positive labels overlap the candidate pool; Recall@K is not interpretable' END,
        CASE WHEN nd IS NULL THEN 'NDCG is unavailable' END) AS warnings,
      reasons = '' AND warnings = '' AS eligible_for_tuning FROM j""",
)
def ranking_compare(spark, sf_dir):
    compared = evaluation.compare_rankings(
        version_metrics(spark, sf_dir), BASELINE_VERSION, by=["profile_id"]
    )
    return compared.select(
        "profile_id", "candidate_name", F.col("k").cast("long").alias("k"),
        F.round("ndcg_delta", 6).alias("ndcg_delta"),
        F.round("recall_delta", 6).alias("recall_delta"),
        F.round("negative_rate_delta", 6).alias("negative_rate_delta"),
        F.concat_ws("; ", "reasons").alias("reasons"),
        F.concat_ws("; ", "warnings").alias("warnings"),
        "eligible_for_tuning",
    )


@query(
    "ablation_report",
    f"""{_VERSION_METRICS_SQL}
    SELECT a.profile_id, substr(a.version, 26) AS "group", round(a.ndcg_at_k - c.ndcg_at_k, 6) AS ndcg_delta_from_candidate,
      round(a.recall_at_k - c.recall_at_k, 6) AS recall_delta_from_candidate
    FROM v a JOIN v c ON c.profile_id = a.profile_id AND c.k = a.k AND c.version = 'quality-first-v1'
    WHERE a.k = 20 AND a.version LIKE 'quality-first-v1-without-%'""",
)
def ablation_report(spark, sf_dir):
    deltas = evaluation.ablation_deltas(
        version_metrics(spark, sf_dir), QUALITY_FIRST["version"], by=["profile_id"]
    )
    return deltas.select(
        "profile_id", "group",
        F.round("ndcg_delta_from_candidate", 6).alias("ndcg_delta_from_candidate"),
        F.round("recall_delta_from_candidate", 6).alias("recall_delta_from_candidate"),
    )


@query(
    "shadow_report",
    f"""{_VERSION_METRICS_SQL},
    side AS (SELECT b.profile_id,
      c.ndcg_at_k - b.ndcg_at_k AS nd, c.negative_rate_at_k - b.negative_rate_at_k AS ng, least(c.candidate_overlap, b.candidate_overlap) AS ov,
      b.candidate_positive_labels = 0 OR c.candidate_positive_labels = 0 AS nopos, c.provisional AS pv,
      c6.candidate_recall_at_k AS c6, b6.candidate_recall_at_k AS b6, c.intra_list_diversity_at_k < b.intra_list_diversity_at_k AS dv,
      c.source_coverage_at_k < b.source_coverage_at_k AS sc
      FROM v b JOIN v c ON c.profile_id = b.profile_id AND c.k = 20 AND c.version = 'quality-first-v1'
      JOIN v b6 ON b6.profile_id = b.profile_id AND b6.k = 60 AND b6.version = b.version
      JOIN v c6 ON c6.profile_id = b.profile_id AND c6.k = 60 AND c6.version = c.version
      WHERE b.k = 20 AND b.version = '{BASELINE_VERSION}')
    SELECT profile_id, round(nd, 6) AS ndcg_delta, concat_ws('; ',
        CASE WHEN ov = 0 THEN 'candidate-label overlap is zero for at least one ranking' WHEN ov < 5 THEN 'few overlapping labels; metric uncertainty is high' END,
        CASE WHEN ov < 5 THEN 'sparse independent-label sample; metric uncertainty is high' END,
        CASE WHEN nopos THEN 'no positive labels overlap the candidate pool; Recall@K is not interpretable' END,
        CASE WHEN nd IS NULL THEN 'NDCG is unavailable' END,
        CASE WHEN nd < 0.05 THEN 'NDCG improvement is below the 0.05 release target' END,
        CASE WHEN ng > 0 THEN 'negative-label rate increased' END,
        CASE WHEN pv THEN 'sparse evaluation result is provisional' END,
        CASE WHEN c6 IS NULL OR b6 IS NULL THEN 'coarse candidate-conditional Recall@60 is unavailable' END,
        CASE WHEN c6 < b6 THEN 'coarse Recall@60 regressed from the frozen baseline' END,
        CASE WHEN c6 < 0.95 AND b6 IS NOT NULL THEN 'coarse Recall@60 is below the 95% labeled-relevant target' END,
        CASE WHEN dv THEN 'intra-list diversity regressed' END, CASE WHEN sc THEN 'source coverage regressed' END) AS warnings,
      true AS eligible_for_activation FROM side""",
)
def shadow_report(spark, sf_dir):
    report = evaluation.shadow_report(
        version_metrics(spark, sf_dir), QUALITY_FIRST["version"], by=["profile_id"]
    )
    return report.select(
        "profile_id", F.round("ndcg_delta", 6).alias("ndcg_delta"),
        F.concat_ws("; ", "warnings").alias("warnings"), "eligible_for_activation",
    )


def manifests(spark, sf_dir):
    """Orders as run manifests: status is the side, prices are token counts."""
    price = F.col("o_totalprice")
    priority = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.col("o_orderstatus").alias("side"),
        F.concat(F.lit("model-"), "o_orderstatus").alias("model"),
        (F.col("o_custkey") % 1000).alias("candidate_count"),
        (F.col("o_custkey") % 21).alias("recommendation_count"),
        (F.col("o_custkey") % 9).alias("model_requests"),
        (F.col("o_orderkey") % 61).alias("cache_hits"),
        F.when(priority != "4-NOT SPECIFIED", F.floor(price)).alias("actual_input_tokens"),
        F.floor(price / 10).alias("actual_output_tokens"),
        (price / 1000).alias("duration_seconds"),
        F.when(priority != "5-LOW", price / 3000).alias("provider_latency_seconds"),
        F.when(priority != "2-HIGH", price / 1000000).alias("actual_cost_usd"),
        F.col("o_orderdate").alias("recorded_at"),
    )


MANIFEST_SQL = """manifests AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderstatus AS side, 'model-' || o_orderstatus AS model,
    o_custkey % 21 AS n, o_custkey % 9 AS model_requests, o_orderkey % 61 AS cache_hits,
    CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN floor(o_totalprice) END AS tin, floor(o_totalprice / 10) AS tout,
    o_totalprice / 1000 AS duration, CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice / 3000 END AS latency,
    CASE WHEN o_orderpriority <> '2-HIGH' THEN o_totalprice / 1000000 END AS cost, o_orderdate AS recorded_at,
    o_orderpriority <> '4-NOT SPECIFIED' AND n > 0 AS measured
  FROM orders),
sides AS (
  SELECT side, min(model) AS model, count(*) AS run_count, count(*) FILTER (measured) AS measured_run_count,
    CAST(sum(n) AS BIGINT) AS recommendation_count_total,
    median(tout / n) FILTER (measured) AS m_out, median(tin / n) FILTER (measured) AS m_in,
    median((tin + tout) / n) FILTER (measured) AS m_all, median(duration) FILTER (measured) AS m_dur,
    median(latency) FILTER (measured) AS m_lat, median(cost / n) FILTER (measured) AS m_cost,
    median(model_requests) AS m_req, median(cache_hits) AS m_hit
  FROM manifests GROUP BY side)"""


@query(
    "efficiency_medians",
    f"""WITH {MANIFEST_SQL}
    SELECT side, model, run_count, measured_run_count, recommendation_count_total,
      round(m_out, 6) AS output_tokens, round(m_in, 6) AS input_tokens, round(m_all, 6) AS total_tokens,
      round(m_dur, 6) AS duration, round(m_lat, 6) AS latency, round(m_cost, 6) AS cost,
      m_req::DOUBLE AS requests, m_hit::DOUBLE AS cache_hits FROM sides""",
)
def efficiency_medians(spark, sf_dir):
    sides = efficiency.aggregate_manifests(manifests(spark, sf_dir))
    r = lambda c, a: F.round(f"median_{c}", 6).alias(a)
    return sides.select(
        "side", "model", "run_count", "measured_run_count", "recommendation_count_total",
        r("output_tokens_per_recommendation", "output_tokens"),
        r("input_tokens_per_recommendation", "input_tokens"),
        r("total_tokens_per_recommendation", "total_tokens"),
        r("duration_seconds", "duration"), r("provider_latency_seconds", "latency"),
        r("cost_usd_per_recommendation", "cost"), r("model_requests", "requests"),
        r("cache_hits", "cache_hits"),
    )


@query(
    "efficiency_compare",
    f"""WITH {MANIFEST_SQL},
    j AS (SELECT (b.m_out - c.m_out) / b.m_out AS red, (b.m_in - c.m_in) / b.m_in AS inp,
      (b.m_dur - c.m_dur) / b.m_dur AS dur, (b.m_cost - c.m_cost) / b.m_cost AS cst, b.model <> c.model AS differ
      FROM sides b JOIN sides c ON b.side = 'F' AND c.side = 'O')
    SELECT round(red, 6) AS output_token_reduction, round(inp, 6) AS input_token_change, round(dur, 6) AS duration_change,
      round(cst, 6) AS cost_change, red >= 0.25 AS meets_output_token_target,
      concat_ws('; ', CASE WHEN differ THEN 'baseline and candidate models differ' END,
        CASE WHEN red < 0.25 THEN 'median output-token reduction is below the 25% target' END) AS reasons,
      reasons = '' AS comparable FROM j""",
)
def efficiency_compare(spark, sf_dir):
    sides = efficiency.aggregate_manifests(manifests(spark, sf_dir))
    row = efficiency.compare_efficiency(sides, "F", "O")
    names = ["output_token_reduction", "input_token_change", "duration_change", "cost_change"]
    return row.select(
        *[F.round(n, 6).alias(n) for n in names], "meets_output_token_target",
        F.concat_ws("; ", "reasons").alias("reasons"), "comparable",
    )


@query(
    "manifest_history",
    """SELECT CAST(o_orderkey AS VARCHAR) AS run_id, strftime(o_orderdate, '%Y-%m-%d') AS recorded_on
    FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 90""",
)
def manifest_history(spark, sf_dir):
    from folioscope.operators import scale

    newest = scale.top_rows(
        manifests(spark, sf_dir), [F.col("recorded_at").desc(), F.col("run_id").cast("long").desc()],
        efficiency.HISTORY_LIMIT,
    )
    return newest.select("run_id", F.date_format("recorded_at", "yyyy-MM-dd").alias("recorded_on"))


def quality_examples(spark, sf_dir):
    """Labelled documents as reviewed examples; traits picked from each allowlist by number."""
    doc = F.col("doc_id")
    pick = lambda names, step: F.array_distinct(
        F.array(
            F.element_at(F.array(*map(F.lit, names)), (doc % len(names) + 1).cast("int")),
            F.element_at(F.array(*map(F.lit, names)), ((doc + step) % len(names) + 1).cast("int")),
        )
    )
    return table(spark, sf_dir, "labels").select(
        F.concat(F.lit("u"), doc.cast("string")).alias("paper_id"),
        (F.col("quality") == 1).alias("approved"),
        *[pick(names, i + 1).alias(f) for i, (f, names) in enumerate(quality.TRAITS.items())],
    )


def _quality_sql() -> str:
    unions = " UNION ALL ".join(
        f"SELECT 'u' || CAST(doc_id AS VARCHAR) AS paper_id, '{f}' AS field, unnest(list_distinct([t[doc_id % {len(n)} + 1], t[(doc_id + {i + 1}) % {len(n)} + 1]])) AS name "
        f"FROM labels, (SELECT {n!r} AS t) WHERE quality = 1"
        for i, (f, n) in enumerate(quality.TRAITS.items())
    )
    return f"""{FEEDBACK_SQL},
steps AS (SELECT paper_id, list(CASE WHEN outcome IN ('interested', 'read', 'worthwhile') THEN 1.0::DOUBLE
    WHEN outcome IN ('not_interested', 'not_worthwhile') THEN -0.5::DOUBLE ELSE 0.0::DOUBLE END ORDER BY occurred_at, event_id) AS d
  FROM feedback WHERE outcome IS NOT NULL GROUP BY paper_id),
weights AS (SELECT paper_id, list_reduce(list_prepend(1.0::DOUBLE, d), lambda a, x: CASE WHEN x < 0 THEN greatest(0.25, a + x) ELSE a + x END) AS w FROM steps),
traits AS ({unions}),
sums AS (SELECT field, name, sum(coalesce(w, 1.0)) AS s FROM traits LEFT JOIN weights USING (paper_id) GROUP BY ALL)"""


@query(
    "quality_support",
    f"WITH {_quality_sql()} SELECT field, name, round(s / max(s) OVER (PARTITION BY field), 6) AS support FROM sums",
)
def quality_support(spark, sf_dir):
    criteria = quality.quality_reference(
        quality_examples(spark, sf_dir), feedback_events(spark, sf_dir)
    )
    return criteria.select("field", "name", F.round("support", 6).alias("support"))


@query(
    "judge_criteria",
    f"""WITH {_quality_sql()} SELECT field, count(*) AS criteria FROM sums
    WHERE field NOT IN ('research_problems', 'motivations') GROUP BY ALL""",
)
def judge_criteria(spark, sf_dir):
    criteria = quality.quality_reference(
        quality_examples(spark, sf_dir), feedback_events(spark, sf_dir)
    )
    return quality.model_criteria(criteria).groupBy("field").agg(
        F.count(F.lit(1)).alias("criteria")
    )
