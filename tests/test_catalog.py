"""Registered queries against DuckDB, plan shapes, whole runs and bounded stream attribution."""

from datetime import datetime, timedelta, timezone
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from folioscope.catalog import ORACLE, QUERIES
from folioscope.operators import evaluation
from folioscope.plans import recommend as plans
from folioscope.streaming import jobs

DATA = Path("/root/testdata/sf0.001")
NOW = datetime(2026, 8, 1, tzinfo=timezone.utc)
TABLES = ["documents", "events", "labels", "orders", "customer", "benchmark", "conversations", "pages", "part", "region"]


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted(repr([shown(row[i]) for i in order]) for row in values)


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize(
    "name",
    ["diverse_select", "position_outcomes", "label_diff", "snapshot_header", "cdc_merge", "pool_merge",
     "quality_support", "efficiency_medians", "judged_quality", "submission_ingest", "stream_history"],
)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, str(DATA))
    cur = con.execute(ORACLE[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", ["paper_topk", "outcome_attribution", "latest_label", "suppressed_pool"])
def test_plans_hold_no_cross_join(spark, name):
    plan = QUERIES[name](spark, str(DATA))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) >= 70


def test_run_manifest(spark):
    usage = spark.createDataFrame(
        [("r", 2, 1, 100, 50, 0, 90, 40, 1.5), ("r", 1, 0, 10, 5, 1, 9, 4, 0.5)],
        "run_id string, requests long, cache_hits long, estimated_input long, estimated_output long, "
        "retry_count long, actual_input long, actual_output long, latency double",
    )
    some = spark.createDataFrame([("r", "p")], "run_id string, paper_id string")
    row = plans.run_manifest(
        some, some.union(some), usage, model="m", weight_set_version="w", started_at=NOW,
        completed_at=NOW + timedelta(seconds=42), price_per_token=0.5,
    ).first()
    assert (row.candidate_count, row.recommendation_count, row.model_requests) == (2, 1, 3)
    assert (row.estimated_tokens, row.duration_seconds, row.actual_cost_usd) == (165, 42.0, 71.5)


def test_snapshot_replay(spark):
    ranked = spark.createDataFrame(
        [("r", "1", 0.9, "core", "c", [], []), ("r", "2", 0.5, "core", "c", [], [])],
        "ranking_id string, paper_id string, score double, source string, category string, "
        "facets array<string>, identifiers array<string>",
    )
    snapshot = {
        "splits": spark.createDataFrame([("s", 1, "1"), ("s", 2, "2")], "split string, position long, paper_id string"),
        "labels": spark.createDataFrame([("1", "positive"), ("2", "negative")], "paper_id string, label string"),
        "pairwise": spark.createDataFrame([("e", "2", "1")], "event_id string, paper_id string, compared_paper_id string"),
    }
    row = evaluation.replay_snapshot(ranked, snapshot, "s", ks=(1,)).first()
    assert (row.recall_at_k, row.precision_at_k, row.pairwise_accuracy) == (1.0, 1.0, 0.0)
    with pytest.raises(ValueError):
        evaluation.replay_snapshot(ranked, snapshot, "other")


def test_bounded_stream_attribution(spark, tmp_path):
    shown = spark.createDataFrame([("i1", "p", NOW), ("i0", "p", NOW - timedelta(hours=9))], "impression_id string, paper_id string, shown_at timestamp")
    spoken = spark.createDataFrame([("o", "p", NOW + timedelta(hours=1))], "event_id string, paper_id string, occurred_at timestamp")
    for name, df in (("i", shown), ("o", spoken)):
        df.write.parquet(str(tmp_path / name))
    read = lambda name, df: spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    pairs = jobs.attribute_in_window(read("i", shown), read("o", spoken), "1 hour", "5 HOURS")
    query = (
        pairs.select("event_id", "impression_id").writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    got = spark.read.schema("event_id string, impression_id string").parquet(str(tmp_path / "out"))
    assert [tuple(r) for r in got.select(F.col("event_id"), F.col("impression_id")).collect()] == [("o", "i1")]


def test_papers_keep_splits_that_are_even_enough(spark, tmp_path):
    """Texts that are only tokenized are not dealt anew for each read; sections still get small tasks."""
    from folioscope.catalog import base, evidence

    rows = spark.range(0, 96_000, 1, 8).selectExpr("id AS doc_id", "'a. b' AS text", "'en' AS lang", "'s' AS source", "4L AS n_chars")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan(base.papers(spark, str(tmp_path)))
    assert "Repartition" in plan(evidence._section_pages(spark, str(tmp_path)))
