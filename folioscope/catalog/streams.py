"""Streaming twins of batch queries, run over what is available now."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.catalog.base import (
    ORACLE, PAPERS_SQL, PAPER_KEY_SQL, feedback_of, paper_key, papers_of, query, text_time,
)
from folioscope.session import work_dir
from folioscope.streaming import jobs

DONE = "2024-02-10T00:00:00+00:00"
CUTOFF = "2024-01-26T00:00:00+00:00"


def stream_of(spark, sf_dir, name):
    """A given table as a stream of files; zone-less times become UTC instants."""
    stream = jobs.table_stream(spark, sf_dir, f"{name}.parquet")
    naive = [f.name for f in stream.schema if f.dataType.simpleString() == "timestamp_ntz"]
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in naive})


@query(
    "stream_candidates",
    f"""WITH {PAPERS_SQL} SELECT paper_id, strftime(updated, '%Y-%m-%d') AS updated_on FROM papers
    WHERE updated >= TIMESTAMP '2024-01-11 00:00:00' ORDER BY updated DESC, paper_id DESC LIMIT 1000""",
)
def stream_candidates(spark, sf_dir):
    rows = papers_of(stream_of(spark, sf_dir, "documents")).select("paper_id", "updated", "title")
    merged = jobs.ingest_candidates(rows, work_dir(spark, "pool"), DONE)
    return merged.select("paper_id", F.date_format("updated", "yyyy-MM-dd").alias("updated_on"))


@query(
    "stream_events",
    """SELECT 'e' || CAST(event_id AS VARCHAR) AS event_id, 'u' || CAST(user_id AS VARCHAR) AS paper_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS occurred_at FROM events""",
)
def stream_events(spark, sf_dir):
    rows = feedback_of(stream_of(spark, sf_dir, "events"))
    kept = jobs.ingest_events(rows, work_dir(spark, "events"))
    return kept.select("event_id", "paper_id", text_time("occurred_at").alias("occurred_at"))


@query(
    "stream_history",
    f"""SELECT {PAPER_KEY_SQL.replace('doc_id', 'user_id')} AS paper_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS published_at
    FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-11 00:00:00' GROUP BY user_id""",
)
def stream_history(spark, sf_dir):
    rows = stream_of(spark, sf_dir, "events").filter(F.col("event_type") == "view").select(
        paper_key("user_id").alias("paper_id"), F.lit(1).alias("revision"),
        F.col("ts").alias("published_at"),
    )
    kept = jobs.track_history(rows, work_dir(spark, "history"), DONE)
    return kept.select("paper_id", text_time("published_at").alias("published_at"))


@query("stream_attribution", ORACLE["outcome_attribution"])
def stream_attribution(spark, sf_dir):
    rows = feedback_of(stream_of(spark, sf_dir, "events"))
    hits = jobs.attribute_stream(rows, work_dir(spark, "attribution"))
    return hits.select("event_id", "outcome", "impression_id", "displayed_rank")


@query(
    "stream_labels",
    f"""SELECT 'arxiv:' || {PAPER_KEY_SQL} AS paper_id, CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS label
    FROM labels WHERE toxic = 0 OR quality = 1""",
)
def stream_labels(spark, sf_dir):
    doc = F.col("doc_id")
    good = F.col("quality") == 1
    day = F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=(doc % 20).cast("int"))
    rows = stream_of(spark, sf_dir, "labels").select(
        F.concat(F.lit("arxiv:"), paper_key("doc_id")).alias("paper_id"),
        F.concat(F.lit("a"), doc.cast("string")).alias("event_id"),
        F.when((F.col("toxic") == 1) & ~good, "unlabel").otherwise("label").alias("kind"),
        day.alias("occurred_at"),
        F.when(good, "positive").otherwise("negative").alias("label"),
    )
    latest = jobs.latest_labels(rows, work_dir(spark, "labels"), CUTOFF)
    return latest.select("paper_id", "label")
