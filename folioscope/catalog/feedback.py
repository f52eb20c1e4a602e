"""Feedback ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.catalog.base import FEEDBACK_SQL, feedback_events, query, table
from folioscope.operators import ledger
from folioscope.session import work_dir
from folioscope.sources import ledgers

_ATTRIBUTED_SQL = f"""{FEEDBACK_SQL},
hit AS (
  SELECT o.event_id, o.outcome, i.event_id AS impression_id, i.displayed_rank
  FROM (SELECT * FROM feedback WHERE outcome IS NOT NULL) o
  LEFT JOIN (SELECT * FROM feedback WHERE event_type = 'impression') i
    ON i.paper_id = o.paper_id AND i.occurred_at <= o.occurred_at
  QUALIFY row_number() OVER (PARTITION BY o.event_id
    ORDER BY (i.batch_id = o.batch_id) DESC NULLS LAST, i.occurred_at DESC NULLS LAST, i.event_id DESC) = 1)"""


@query(
    "outcome_attribution",
    f"""WITH {_ATTRIBUTED_SQL}
    SELECT event_id, outcome, impression_id, displayed_rank FROM hit""",
)
def outcome_attribution(spark, sf_dir):
    return ledger.attribute_outcomes(feedback_events(spark, sf_dir)).select(
        "event_id", "outcome", "impression_id", "displayed_rank"
    )


@query(
    "position_outcomes",
    f"""WITH {_ATTRIBUTED_SQL},
    shown AS (SELECT displayed_rank, count(*) AS impression_count FROM feedback
      WHERE event_type = 'impression' GROUP BY ALL),
    spoken AS (SELECT displayed_rank, count(*) AS n,
      count(*) FILTER (outcome IN ('interested', 'worthwhile')) AS p FROM hit GROUP BY ALL)
    SELECT s.displayed_rank, impression_count, coalesce(n, 0) AS explicit_outcome_count,
      coalesce(p, 0) AS positive_outcome_count
    FROM shown s LEFT JOIN spoken USING (displayed_rank)""",
)
def position_outcomes(spark, sf_dir):
    return ledger.position_outcomes(feedback_events(spark, sf_dir))


def corrected_events(spark, sf_dir):
    """Events where a low value takes back the event before it, a high one the event after."""
    events = feedback_events(spark, sf_dir)
    raw = table(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"),
        F.when(F.col("value") < 2, F.col("event_id") - 1)
        .when(F.col("value") > 100, F.col("event_id") + 1)
        .alias("_target"),
    )
    return (
        events.drop("supersedes_event_id")
        .join(raw, "event_id")
        .withColumn(
            "supersedes_event_id", F.concat(F.lit("e"), F.col("_target").cast("string"))
        )
        .drop("_target")
    )


_CORRECTED_SQL = f"""{FEEDBACK_SQL},
corrected AS (
  SELECT f.*, 'e' || CAST(CASE WHEN v.value < 2 THEN v.event_id - 1 WHEN v.value > 100 THEN v.event_id + 1 END AS VARCHAR) AS target
  FROM feedback f JOIN events v ON f.event_id = 'e' || CAST(v.event_id AS VARCHAR))"""


@query(
    "effective_events",
    f"""WITH {_CORRECTED_SQL}
    SELECT event_type, count(*) AS events, count(outcome) AS outcomes FROM corrected c
    WHERE NOT EXISTS (SELECT 1 FROM corrected d WHERE d.target = c.event_id) GROUP BY ALL""",
)
def effective_events(spark, sf_dir):
    kept = ledger.effective(corrected_events(spark, sf_dir))
    return kept.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.count("outcome").alias("outcomes")
    )


@query(
    "lineage_check",
    f"""WITH {_CORRECTED_SQL}
    SELECT c.event_id, c.paper_id, c.target AS supersedes_event_id,
      CASE WHEN t.event_id IS NULL THEN 'unknown event' WHEN t.paper_id <> c.paper_id THEN 'different paper'
        WHEN c.occurred_at < t.occurred_at THEN 'precedes its target' END AS reason
    FROM corrected c LEFT JOIN corrected t ON t.event_id = c.target
    WHERE c.target IS NOT NULL AND reason IS NOT NULL""",
)
def lineage_check(spark, sf_dir):
    return ledger.lineage_violations(corrected_events(spark, sf_dir))


_APPEND_SQL = f"""WITH {FEEDBACK_SQL},
    ledger AS (SELECT * FROM feedback WHERE event_type = 'outcome'),
    batch AS (
      SELECT event_id, CASE WHEN displayed_rank = 7 OR outcome = 'interested' AND batch_id = '2024-01-05'
        THEN paper_id || 'x' ELSE paper_id END AS paper_id, outcome FROM feedback
      UNION ALL SELECT event_id, paper_id, outcome FROM feedback WHERE displayed_rank BETWEEN 5 AND 9),
    per_key AS (
      SELECT b.event_id, count(*) AS copies, count(DISTINCT paper_id) AS variants, min(paper_id) AS paper FROM batch b GROUP BY ALL)
    SELECT p.event_id, variants > 1 OR coalesce(l.paper_id <> p.paper, false) AS conflict,
      CASE WHEN conflict OR l.event_id IS NOT NULL THEN 0 ELSE 1 END::BIGINT AS added,
      CASE WHEN conflict THEN 0 WHEN l.event_id IS NULL THEN copies - 1 ELSE copies END::BIGINT AS duplicates
    FROM per_key p LEFT JOIN ledger l USING (event_id)"""


def _append_sides(spark, sf_dir):
    """The stored outcomes, and a batch of new, repeated and changed events."""
    columns = ["event_id", "paper_id", "outcome", "event_type", "batch_id", "occurred_at"]
    events = feedback_events(spark, sf_dir)
    changed = (F.col("displayed_rank") == 7) | (
        (F.col("outcome") == "interested") & (F.col("batch_id") == "2024-01-05")
    )
    paper = F.when(changed, F.concat("paper_id", F.lit("x"))).otherwise(F.col("paper_id"))
    batch = events.withColumn("paper_id", paper).select(*columns).unionByName(
        events.filter(F.col("displayed_rank").between(5, 9)).select(*columns)
    )
    stored = events.filter(F.col("event_type") == "outcome").select(*columns)
    return stored, batch


@query("ledger_append", _APPEND_SQL)
def ledger_append(spark, sf_dir):
    return ledger.append_status(*_append_sides(spark, sf_dir)).select("event_id", "conflict", "added", "duplicates")


@query("ledger_versions", _APPEND_SQL)
def ledger_versions(spark, sf_dir):
    """The same append against a ledger on storage that grew in three versions and was made one after the second."""
    stored, batch = _append_sides(spark, sf_dir)
    root = work_dir(spark, "ledger")
    for turn in range(3):
        ledgers.append(stored.filter(F.pmod(F.crc32(F.col("event_id").cast("binary")), F.lit(3)) == turn), root, f"{turn:020d}")
        if turn == 1:
            ledgers.compact(spark, root, stored.schema)
    return ledgers.append_status(batch, root).select("event_id", "conflict", "added", "duplicates")


@query(
    "recorded_impressions",
    f"""WITH {FEEDBACK_SQL},
    placed AS (SELECT batch_id, event_id AS paper_id,
      row_number() OVER (PARTITION BY batch_id ORDER BY occurred_at, event_id) AS r FROM feedback)
    SELECT 'impression-' || substr(sha256(batch_id || '|' || CAST(r AS VARCHAR) || '|' || paper_id), 1, 24) AS event_id,
      paper_id, batch_id, CAST(r AS INTEGER) AS displayed_rank FROM placed""",
)
def recorded_impressions(spark, sf_dir):
    shown = feedback_events(spark, sf_dir).select(
        "batch_id", F.col("event_id").alias("paper_id"), "occurred_at"
    )
    events = ledger.impressions(shown, F.col("occurred_at"), ["occurred_at", "paper_id"])
    return events.select("event_id", "paper_id", "batch_id", "displayed_rank")
