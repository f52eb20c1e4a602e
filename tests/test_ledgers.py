"""Feedback and label ledgers, splits and metrics."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from folioscope.operators import contracts, corpus, efficiency, evaluation, ledger, quality

NOW = datetime(2026, 8, 1, tzinfo=timezone.utc)
FEEDBACK = """event_id string, event_type string, paper_id string, occurred_at timestamp,
  outcome string, batch_id string, displayed_rank int, reason_codes array<string>,
  supersedes_event_id string"""
CORPUS = """event_id string, kind string, paper_id string, occurred_at timestamp, source string,
  label string, compared_paper_id string, reason_codes array<string>,
  applicable_dimensions array<string>, private_rationale string, supersedes_event_id string,
  source_item_key string"""


def day(n, hour=0):
    return NOW + timedelta(days=n, hours=hour)


def shown(key, paper, at, batch, rank):
    return (key, "impression", paper, at, None, batch, rank, [], None)


def spoken(key, paper, at, outcome, batch=None, old=None):
    kind = "correction" if old else "outcome"
    return (key, kind, paper, at, outcome, batch, None, [], old)


def judged(key, paper, at, label="positive", kind="label", other=None, source="review", item=None, old=None):
    return (key, kind, paper, at, source, label, other, [], [], None, old, item)


def rates(spark, events):
    rows = ledger.position_outcomes(spark.createDataFrame(events, FEEDBACK)).collect()
    return {r.displayed_rank: tuple(r)[1:] for r in rows}


def test_outcomes_follow_the_latest_earlier_impression(spark):
    events = [shown("i", "p", day(0), "b", 2), spoken("o", "p", day(1), "interested"),
              spoken("early", "p", day(-1), "interested"), spoken("x", "unseen", day(1), "worthwhile")]
    assert rates(spark, events) == {2: (1, 1, 1)}


def test_the_batch_wins_and_falls_back(spark):
    events = [shown("i1", "p", day(0), "b1", 1), shown("i2", "p", day(1), "b2", 3),
              spoken("o1", "p", day(2), "not_interested", "b1"), spoken("o2", "p", day(2), "read", "b9"),
              spoken("o3", "p", day(0), "worthwhile", "b2")]
    assert rates(spark, events) == {1: (1, 2, 1), 3: (1, 1, 0)}


def test_equal_instants_take_the_greatest_event_id(spark):
    events = [shown("a", "p", day(0), "b", 5), shown("b", "p", day(0), "c", 6),
              spoken("o", "p", day(0), "interested")]
    assert rates(spark, events)[6] == (1, 1, 1)


def test_corrections_replace_outcomes(spark):
    events = [shown("i", "p", day(0), "b", 1), spoken("o", "p", day(1), "interested"),
              spoken("c", "p", day(2), "not_interested", old="o")]
    assert rates(spark, events) == {1: (1, 1, 0)}


def test_attribution_of_a_hot_paper_equals_brute_force(spark):
    events = [shown(f"i{n:03d}", "hot", day(0, n * 3 % 100), f"b{n % 4}", n % 7) for n in range(80)]
    events += [spoken(f"o{n:03d}", "hot", day(0, n * 5 % 110), "interested", f"b{n % 6}" if n % 3 else None) for n in range(90)]
    got = {r.event_id: r.displayed_rank for r in ledger.attribute_outcomes(spark.createDataFrame(events, FEEDBACK)).collect()}
    for o in (e for e in events if e[1] == "outcome"):
        before = [i for i in events if i[1] == "impression" and i[3] <= o[3]]
        same = [i for i in before if i[5] == o[5]] if o[5] else []
        pool = same or before
        want = max(pool, key=lambda i: (i[3], i[0]))[6] if pool else None
        assert got[o[0]] == want


def test_attribution_scans_events_twice_at_most(spark, monkeypatch):
    from folioscope.session import work_dir

    events = [shown(f"i{n:03d}", f"p{n % 3}", day(0, n), "b", 1) for n in range(30)]
    events += [spoken(f"o{n:03d}", f"p{n % 4}", day(1, n), "interested", None) for n in range(30)]
    events += [spoken("c", "p1", day(2), "not_interested", old="o001"), (*shown("z", None, day(0), None, 4),),
               (*spoken("y", None, day(1), "interested", None),)]
    path = work_dir(spark, "test-events")
    spark.createDataFrame(events, FEEDBACK).write.parquet(path)
    plans = []

    def kept(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return original(df, name)

    original = ledger.materialized
    monkeypatch.setattr(ledger, "materialized", kept)
    scanned = spark.read.parquet(path)
    found = ledger.attribute_outcomes(scanned)
    plans.append(found._jdf.queryExecution().optimizedPlan().toString())
    reading = [plan for plan in plans if "supersedes_event_id" in plan]  # only the narrow table reads events
    assert len(reading) == 1 and reading[0].count("Relation [event_id#") == 2
    rows = {r.event_id: r.impression_id for r in found.collect()}
    assert "o001" not in rows and rows["c"] == "i028" and rows["o003"] is None and rows["y"] == "z"


def test_append_is_idempotent_and_guards_content(spark):
    first = [shown("a", "p", day(0), "b", 1), shown("b", "q", day(0), "b", 2)]
    stored = spark.createDataFrame(first, FEEDBACK)
    batch = spark.createDataFrame([*first, shown("c", "r", day(0), "b", 3), shown("c", "r", day(0), "b", 3)], FEEDBACK)
    counts = ledger.append_counts(ledger.append_status(stored, batch)).first()
    assert tuple(counts) == (1, 3, 0)
    assert ledger.append(stored, batch).count() == 3
    changed = spark.createDataFrame([shown("a", "p", day(0), "b", 9)], FEEDBACK)
    with pytest.raises(ValueError):
        ledger.append(stored, changed)


def test_lineage(spark):
    events = [judged("a", "p", day(0)), judged("b", "p", day(1), old="a"), judged("c", "q", day(1), old="a"),
              judged("d", "p", day(-1), old="a"), judged("e", "p", day(1), old="zz")]
    bad = ledger.lineage_violations(spark.createDataFrame(events, CORPUS)).collect()
    assert {r.event_id: r.reason for r in bad} == {
        "c": "different paper", "d": "precedes its target", "e": "unknown event"}


def test_impressions_number_each_batch(spark):
    rows = spark.createDataFrame([("b", "p2", 2), ("b", "p1", 1), ("c", "p1", 1)], "batch_id string, paper_id string, n int")
    got = ledger.impressions(rows, F.lit(NOW), ["n", "paper_id"])
    assert {(r.batch_id, r.paper_id, r.displayed_rank) for r in got.collect()} == {("b", "p1", 1), ("b", "p2", 2), ("c", "p1", 1)}
    valid, rejects = contracts.check(got, contracts.feedback_event())
    assert valid.count() == 3 and rejects.count() == 0


def test_labels_resolve_per_cutoff(spark):
    events = spark.createDataFrame(
        [judged("a", "p", day(0)), judged("b", "p", day(1), "negative", old="a"), judged("c", "p", day(2), None, "unlabel", old="b")], CORPUS)
    at = lambda n: [r.label for r in corpus.resolved_labels(events, day(n)).collect()]
    assert at(0) == ["positive"] and at(1) == ["negative"] and at(2) == []


def test_conflicts_and_digest(spark):
    rows = [judged("a", "p", day(0)), judged("b", "p", day(0), "negative"), judged("c", "q", day(0))]
    events = spark.createDataFrame(rows, CORPUS)
    header = corpus.snapshot_header(events, day(1)).first()
    assert header.revision == 3 and header.conflict_count == 1
    again = corpus.snapshot_header(events.orderBy(F.desc("event_id")).repartition(3), day(1)).first()
    assert again.digest == header.digest
    other = spark.createDataFrame(rows[:2] + [judged("c", "q", day(0), "negative")], CORPUS)
    assert corpus.snapshot_header(other, day(1)).first().digest != header.digest


ITEM = "item_key string, identifiers array<string>, collections array<string>, tags array<string>"


def test_label_import_moves_and_removes(spark):
    empty = spark.createDataFrame([], CORPUS)
    items = [("K1", ["arXiv:2601.00001v2"], ["good"], ["ranking-reason: clear"]), ("K2", ["10.48550/arXiv.2601.00002"], ["bad"], []),
             ("K3", ["isbn"], ["good"], []), ("K4", ["x"], ["other"], [])]
    first, counts = corpus.import_labels(spark.createDataFrame(items, ITEM), empty, ["good"], ["bad"], day(0))
    assert {(r.paper_id, r.label) for r in first.collect()} == {("arxiv:2601.00001", "positive"), ("arxiv:2601.00002", "negative")}
    assert counts.first().skipped_items == 1
    same, _ = corpus.import_labels(spark.createDataFrame(items, ITEM), first, ["good"], ["bad"], day(1))
    assert same.count() == 2
    moved = [("K1", ["arXiv:2601.00001v2"], ["bad"], ["ranking-reason: clear"])]
    after, counts = corpus.import_labels(spark.createDataFrame(moved, ITEM), first, ["good"], ["bad"], day(2))
    assert after.count() == 4 and counts.first().unlabeled_events == 1
    assert {r.paper_id: r.label for r in corpus.resolved_labels(after, day(3)).collect()} == {"arxiv:2601.00001": "negative"}
    both = [("K1", ["arXiv:2601.00001"], ["good", "bad"], [])]
    with pytest.raises(ValueError):
        corpus.import_labels(spark.createDataFrame(both, ITEM), first, ["good"], ["bad"], day(2))
    assert [r.key for r in corpus.positive_items(first, "library").collect()] == ["K1"]


def snapshot(spark, pairs=True):
    rows = [judged("1", "1", day(-20)), judged("2", "2", day(-10), "negative"), judged("3", "3", day(-2))]
    if pairs:
        rows.append(judged("4", "2", day(-1), "positive", "pairwise", "3"))
    events = spark.createDataFrame(rows, CORPUS)
    return corpus.resolved_labels(events, NOW), corpus.pairwise_judgments(events, NOW)


def test_five_splits(spark):
    labels, pairwise = snapshot(spark)
    anchors = spark.createDataFrame([("1",)], "paper_id string")
    rows = evaluation.make_splits(labels, pairwise, NOW, anchors=anchors, rolling_days=7).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.position):
        got.setdefault(r.split, []).append(r.paper_id)
    assert got == {"stable-anchor": ["1"], "rolling": ["3"], "temporal-holdout": ["3"], "temporal-train": ["1", "2"], "pairwise": ["2", "3"]}
    with pytest.raises(ValueError):
        evaluation.make_splits(labels, pairwise, NOW, anchors=spark.createDataFrame([("9",)], "paper_id string"))


RANKED = """ranking_id string, paper_id string, score double, source string, category string,
  facets array<string>, identifiers array<string>"""


def test_facets_are_cut_before_pairing(spark):
    """Candidates that carry facets are not tokenized again for each of their readers."""
    row = ("p", "r", "Sparse models of long texts", ["en"], None, "core", 0.5)
    scored = spark.createDataFrame([row], "paper_id string, profile_id string, title string, categories array<string>, doi string, source string, score double")
    plain = evaluation.ranked_papers(scored, F.col("profile_id"))
    carried = evaluation.ranked_papers(
        scored.withColumn("facets", evaluation.title_facets()).drop("title"), F.col("profile_id"))
    assert plain.first().facets == carried.first().facets == ["sparse", "models", "long", "texts"]


def metrics(spark, ranked, labels, pairwise, papers, k):
    splits = spark.createDataFrame([("s", i + 1, p) for i, p in enumerate(papers)], "split string, position long, paper_id string")
    return evaluation.evaluate_rankings(
        spark.createDataFrame(ranked, RANKED), labels, splits, pairwise, ks=(k,), split_names=("s",)).first()


def test_ranking_metrics(spark):
    labels = spark.createDataFrame([("1", "positive"), ("2", "negative"), ("3", "positive")], "paper_id string, label string")
    pairwise = spark.createDataFrame([("e", "1", "2")], "event_id string, paper_id string, compared_paper_id string")
    ranked = [("r", "1", 0.9, "core", "cs.LG", ["a"], []), ("r", "2", 0.8, "core", "cs.LG", ["b"], []), ("r", "3", 0.1, "core", "cs.LG", ["c"], [])]
    m = metrics(spark, ranked, labels, pairwise, ["1", "2", "3"], 2)
    assert (m.recall_at_k, m.precision_at_k, m.negative_rate_at_k, m.pairwise_accuracy) == (0.5, 0.5, 0.5, 1.0)
    assert (m.candidate_overlap, m.candidate_positive_labels, m.candidate_negative_labels) == (3, 2, 1)
    assert (m.source_coverage_at_k, m.category_coverage_at_k, m.provisional) == (1, 1, True)
    assert m.ndcg_at_k == pytest.approx(1 / (1 + 1 / 1.584962500721156)) and m.intra_list_diversity_at_k == 1.0
    assert m.brier_score == pytest.approx((0 + (0.7 / 0.8) ** 2 + 1) / 3)


def test_aliases_join_and_missing_labels_stay_null(spark):
    labels = spark.createDataFrame([("doi:10.48550/arXiv.2601.00001v2", "positive")], "paper_id string, label string")
    none = spark.createDataFrame([], "event_id string, paper_id string, compared_paper_id string")
    ranked = [("r", "ARXIV:2601.00001", 0.9, "", None, [], []), ("r", "x", 0.8, None, None, [], ["doi:10.5555/x"])]
    m = metrics(spark, ranked, labels, none, ["arxiv:2601.00001"], 2)
    assert (m.recall_at_k, m.candidate_overlap, m.source_coverage_at_k) == (1.0, 1, 0)
    empty = spark.createDataFrame([], "paper_id string, label string")
    m = metrics(spark, ranked, empty, none, ["q"], 2)
    assert m.recall_at_k is None and m.insufficiency_reason == "no eligible labels or pairwise judgments"


def test_holdout_size_uses_binary_floating_point(spark):
    labels = spark.createDataFrame([(f"{i:03d}", day(0)) for i in range(100)], "paper_id string, resolved_at timestamp")
    none = spark.createDataFrame([], "paper_id string, compared_paper_id string")
    rows = evaluation.make_splits(labels, none, NOW, holdout_ratio=0.07)
    assert rows.filter("split = 'temporal-holdout'").count() == 8


MANIFEST = """side string, model string, recommendation_count long, actual_input_tokens long, actual_output_tokens long,
  duration_seconds double, provider_latency_seconds double, actual_cost_usd double, model_requests long, cache_hits long"""


def test_efficiency(spark):
    rows = [("base", "m", 20, 500, 1000, 10.0, None, None, 2, 1), ("next", "m", 20, 500, 700, 8.0, 1.0, 0.5, 3, 0)]
    sides = efficiency.aggregate_manifests(spark.createDataFrame(rows, MANIFEST))
    row = efficiency.compare_efficiency(sides, "base", "next").first()
    assert row.output_token_reduction == pytest.approx(0.3) and row.meets_output_token_target and row.comparable
    rows[1] = ("next", "m", 20, None, None, 8.0, 1.0, 0.5, 3, 0)
    sides = efficiency.aggregate_manifests(spark.createDataFrame(rows, MANIFEST))
    row = efficiency.compare_efficiency(sides, "base", "next").first()
    assert not row.comparable and "one side has no measured token usage" in row.reasons


def test_manifest_history_keeps_the_newest_once(spark):
    schema = "model string, recorded_at timestamp"
    old = spark.createDataFrame([(f"m{i}", day(i)) for i in range(3)], schema)
    new = spark.createDataFrame([("m2", day(9)), ("m9", day(9))], schema)
    got = efficiency.record_manifest(old, new, limit=3)
    assert {r.model for r in got.collect()} == {"m1", "m2", "m9"}


EXAMPLE = "paper_id string, approved boolean, " + ", ".join(f"{f} array<string>" for f in quality.TRAITS)


def test_quality_profile_counts_explicit_outcomes_only(spark):
    examples = spark.createDataFrame(
        [("p", True, ["agents"], ["baselines"], [], [], []), ("q", True, ["systems"], ["baselines", "ablations"], [], [], []),
         ("r", False, ["retrieval"], [], [], [], [])], EXAMPLE)
    feedback = spark.createDataFrame(
        [spoken("a", "p", day(0), "interested"), spoken("b", "q", day(0), "not_interested"), spoken("c", "q", day(1), "not_worthwhile"),
         spoken("d", "r", day(0), "interested"), shown("e", "p", day(0), "b", 1), spoken("f", "p", day(1), "interested", old="a")], FEEDBACK)
    rows = {(r.field, r.name): r for r in quality.quality_reference(examples, feedback).collect()}
    assert rows["research_problems", "agents"].support == 1.0
    assert rows["research_problems", "systems"].support == 0.125
    assert rows["methodological_expectations", "ablations"].support == pytest.approx(0.111111)
    assert rows["research_problems", "agents"].explicit_feedback_event_count == 3
    visible = quality.model_criteria(quality.quality_reference(examples, feedback))
    assert {r.field for r in visible.collect()} == {"methodological_expectations"}
    assert contracts.policy_violations(quality.policy_table(spark)).count() == 0
    with pytest.raises(ValueError):
        quality.quality_reference(examples, feedback, "quality-reference-policy-legacy-v1")


EVENT = "event_id string, paper_id string, occurred_at timestamp"


def event_file(spark, folder, *rows):
    from datetime import datetime

    data = [(e, p, datetime.fromisoformat(at)) for e, p, at in rows]
    spark.createDataFrame(data, EVENT).coalesce(1).write.mode("append").parquet(folder)


def test_streams_keep_late_rows_over_many_batches(spark):
    from folioscope.session import work_dir
    from folioscope.streaming import jobs

    base = work_dir(spark, "test-stream")
    event_file(spark, f"{base}/events.parquet", ("e9", "p", "2026-08-09"), ("e8", "p", "2026-08-08"))
    event_file(spark, f"{base}/events.parquet", ("e9", "p", "2026-08-09"), ("e0", "p", "2020-01-01"))
    event_file(spark, f"{base}/events.parquet", ("e0", "p", "2020-01-01"), ("e1", "q", "2020-01-02"))
    stream = jobs.table_stream(spark, base, "events.parquet", per_trigger=1)
    root = work_dir(spark, "test-ledger")
    kept = jobs.ingest_events(stream, root)
    assert sorted(r.event_id for r in kept.collect()) == ["e0", "e1", "e8", "e9"]
    assert kept.columns == ["event_id", "paper_id", "occurred_at"]
    event_file(spark, f"{base}/events.parquet", ("e9", "other", "2026-08-09"))
    with pytest.raises(Exception, match="conflicts"):
        jobs.ingest_events(jobs.table_stream(spark, base, "events.parquet"), root)


def test_a_stream_without_rows_is_an_empty_table(spark):
    from folioscope.session import work_dir
    from folioscope.streaming import jobs

    empty = work_dir(spark, "test-empty")
    spark.createDataFrame([], EVENT).limit(0).write.parquet(f"{empty}/events.parquet")
    for file in spark.read.parquet(f"{empty}/events.parquet").inputFiles():
        assert file
    stream = jobs.file_stream(spark, f"{empty}/events.parquet", spark.createDataFrame([], EVENT).schema, "no-such-file")
    assert jobs.ingest_events(stream, work_dir(spark, "test-none")).count() == 0


def test_versions_in_one_pass_equal_versions_alone(spark):
    import random

    rng = random.Random(3)
    names = ["base", "one", "two"]
    rows = [(f"r{n % 2}", f"2601.{n:05d}", [rng.choice([0.1, 0.5, rng.random()]) for _ in names], rng.choice(["core", ""]),
             rng.choice(["a", "b"]), rng.sample(["x", "y", "z"], 2), [f"doi:10.1/{n}"] if n % 3 else None) for n in range(60)]
    ranked = spark.createDataFrame(
        rows, "ranking_id string, paper_id string, scores array<double>, source string, category string, "
        "facets array<string>, identifiers array<string>")
    labels = spark.createDataFrame(
        [(f"doi:10.1/{n}" if n % 2 else f"2601.{n:05d}", rng.choice(["positive", "negative"])) for n in range(0, 60, 4)]
        + [(f"doi:10.1/{n}", "positive") for n in (1, 7, 13)], "paper_id string, label string")
    splits = labels.select(F.when(F.rand(5) > 0.4, "a").otherwise("b").alias("split"), "paper_id")
    splits = spark.createDataFrame(splits.collect(), splits.schema)
    pairwise = spark.createDataFrame(
        [(str(n), f"2601.{n:05d}", f"2601.{n + 8:05d}") for n in range(0, 40, 4)],
        "event_id string, paper_id string, compared_paper_id string")
    run = lambda df, **kw: evaluation.evaluate_rankings(
        df, labels, splits, pairwise, ks=(3, 10), split_names=("a", "b"), **kw)
    whole = run(ranked, versions=names)
    assert whole.filter("pairwise_accuracy is not null and brier_score is not null").count()
    for i, name in enumerate(names):
        alone = run(ranked.withColumn("score", F.col("scores")[i]).drop("scores"))
        mine = whole.filter(F.col("version") == name).select(*alone.columns)
        # Sums may come in another order.
        rows = [sorted([[round(v, 9) if isinstance(v, float) else v for v in r] for r in df.collect()], key=str)
                for df in (mine, alone)]
        assert rows[0] == rows[1]


def test_silent_choices_are_errors(spark):
    from folioscope.operators import efficiency, evaluation, ranking, selection

    labels = spark.createDataFrame(
        [("arxiv:2601.00001", "positive"), ("ARXIV:2601.00001", "negative")], "paper_id string, label string")
    splits = spark.createDataFrame([("train", "arxiv:2601.00001")], "split string, paper_id string")
    with pytest.raises(Exception, match="labels disagree"):
        evaluation.split_labels(labels, splits).collect()
    shared = spark.createDataFrame(
        [("train", "r", "p", 1.0, "a", "positive"), ("train", "r", "p", 1.0, "b", "negative")],
        "split string, ranking_id string, paper_id string, score double, id string, label string")
    with pytest.raises(Exception, match="aliases of p"):
        evaluation.item_labels(shared).collect()
    columns = (
        "side string, model string, candidate_count long, recommendation_count long, model_requests long, "
        "cache_hits long, duration_seconds double, actual_input_tokens long, actual_output_tokens long, "
        "actual_cost_usd double, provider_latency_seconds double")
    runs = spark.createDataFrame(
        [("a", m, 9, 3, 1, 0, 1.0, 10, 10, 0.1, 0.1) for m in ("m1", "m2")], columns)
    with pytest.raises(Exception, match="several models"):
        efficiency.aggregate_manifests(runs).collect()
    feature = "paper_id string, name string, value double, applicable boolean, confidence double, grp string"
    twice = spark.createDataFrame([("p", "x", 1.0, True, 1.0, "recency")] * 2, feature)
    with pytest.raises(Exception, match="given twice"):
        ranking.extra_feature_sums(twice, ["paper_id"]).collect()
    ranked = spark.createDataFrame([("p", 1)], "profile_id string, rank int")
    with pytest.raises(ValueError, match="between 1 and 80"):
        selection.select_diverse(ranked, pre_rank_limit=81)


def test_null_keys_spread_and_keep_their_rows(spark):
    from folioscope.operators import scale

    left = spark.range(3000).selectExpr("id", "if(id % 3 = 0, cast(id as string), null) as k")
    right = spark.createDataFrame([("0", "zero"), ("3", "three")], "k string, name string")
    joined = scale.left_join_spread(left.repartition(4), right, "k")
    assert joined.count() == 3000
    assert sorted(r.name for r in joined.filter("name is not null").collect()) == ["three", "zero"]
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 3000


def test_history_expires_by_state_and_is_never_rewritten(spark):
    from folioscope.session import work_dir
    from folioscope.streaming import jobs

    schema = "paper_id string, revision int, published_at timestamp"
    base, root = work_dir(spark, "test-history"), work_dir(spark, "test-history-out")
    put = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{base}/h.parquet")
    put(("old", 1, day(-40)), ("kept", 1, day(-20)), ("twice", 1, day(-10)))
    put(("twice", 2, day(-5)), ("late", 1, day(-29)), ("kept", 0, day(-25)))
    put(("ahead", 1, day(2)), ("gone", 1, day(-35)), ("kept", 1, day(-20)))
    stream = jobs.table_stream(spark, base, "h.parquet", per_trigger=1)
    got = {(r.paper_id, r.revision, r.published_at.day) for r in jobs.track_history(stream, root, NOW).collect()}
    want = {("kept", 1, day(-20).day), ("twice", 2, day(-5).day), ("late", 1, day(-29).day), ("ahead", 1, day(2).day)}
    assert got == want
    written = jobs.read_appended(spark, root)
    assert written.select("version").distinct().count() == 3 and written.count() <= 9
    # Ten days on, two more are too old, and a new batch adds its own rows only.
    put(("new", 1, day(9)))
    again = jobs.track_history(jobs.table_stream(spark, base, "h.parquet", per_trigger=1), root, day(11))
    assert {r.paper_id for r in again.collect()} == {"twice", "ahead", "new"}
    assert jobs.read_appended(spark, root).count() == written.count() + 1


def test_streamed_attribution_equals_the_batch_result(spark):
    from folioscope.session import work_dir
    from folioscope.streaming import jobs

    events = [shown(f"i{n:03d}", "hot" if n % 3 else f"p{n % 7}", day(n % 5, n * 7 % 24), f"b{n % 4}" if n % 5 else None, n % 7)
              for n in range(60)]
    events += [spoken(f"o{n:03d}", "hot" if n % 2 else f"p{n % 9}", day(n % 6, n * 5 % 24), "interested", f"b{n % 6}" if n % 3 else None)
               for n in range(70)]
    events += [spoken("c1", "hot", day(8), "read", None, old="o001"), spoken("c2", "hot", day(9), "worthwhile", "b1", old="c1"),
               spoken("alone", "unseen", day(1), "read"), spoken("none", None, day(1), "read"), shown("i0", None, day(0), None, 9)]
    base, root = work_dir(spark, "test-attribution"), work_dir(spark, "test-attribution-out")
    late_first = [events[60:100], events[:30], events[100:] + events[10:20], events[30:60]]  # late impressions, repeats
    for part in late_first:
        spark.createDataFrame(part, FEEDBACK).coalesce(1).write.mode("append").parquet(f"{base}/e.parquet")
    stream = jobs.table_stream(spark, base, "e.parquet", per_trigger=1)
    columns = ["event_id", "paper_id", "batch_id", "outcome", "occurred_at", "impression_id", "displayed_rank"]
    order = lambda df: sorted(map(str, df.select(*columns).collect()))
    want = order(ledger.attribute_outcomes(spark.createDataFrame(events, FEEDBACK)))
    assert order(jobs.attribute_stream(stream, root)) == want
    # A later batch changes what it touches and nothing else is computed again.
    more = [shown("new", "p1", day(0), "b0", 3), spoken("cx", "hot", day(10), "read", None, old="c2")]
    spark.createDataFrame(more, FEEDBACK).coalesce(1).write.mode("append").parquet(f"{base}/e.parquet")
    again = jobs.attribute_stream(jobs.table_stream(spark, base, "e.parquet", per_trigger=1), root)
    assert order(again) == order(ledger.attribute_outcomes(spark.createDataFrame(events + more, FEEDBACK)))
    newest = jobs.read_appended(spark, root)
    last = newest.agg(F.max("version")).first()[0]
    assert {r.paper_id for r in newest.filter(F.col("version") == last).collect()} == {"p1", "hot"}


def test_streamed_attribution_keeps_its_state_without_python(spark, monkeypatch):
    from folioscope.session import work_dir
    from folioscope.streaming import jobs

    plans, run = [], jobs.run_appending
    monkeypatch.setattr(jobs, "run_appending", lambda stream, *a, **b: (
        plans.append(stream._jdf.queryExecution().analyzed().toString()), run(stream, *a, **b))[1])
    # Equal times, a batch of its own beside a later one, an outcome without a time, an impression sent again.
    events = [shown("i1", "p", day(0), "b1", 1), shown("i2", "p", day(0), "b2", 2), shown("i3", "p", day(0, 3), "b2", 3),
              spoken("o1", "p", day(0), "read", "b1"), spoken("o2", "p", day(0), "read"), spoken("o3", "p", day(0, 5), "read", "b1"),
              spoken("o4", "p", None, "read", "b1"), spoken("o5", "p", day(1), "read", "b1"), spoken("o6", "p", day(-1), "read", "b1")]
    base, root = work_dir(spark, "test-plain"), work_dir(spark, "test-plain-out")
    spark.createDataFrame([*events, events[0]], FEEDBACK).write.parquet(f"{base}/e.parquet")
    got = jobs.attribute_stream(jobs.table_stream(spark, base, "e.parquet"), root)
    assert {r.event_id: r.impression_id for r in got.collect()} == {
        "o1": "i1", "o2": "i2", "o3": "i1", "o4": None, "o5": "i1", "o6": None}
    assert got.count() == 6 and not any("Pandas" in p or "Python" in p for p in plans)


def stored_ledger(spark, batches, part_rows=50):
    from folioscope.session import work_dir
    from folioscope.sources import ledgers

    root = work_dir(spark, "test-versions")
    schema = "event_id string, paper_id string, part int"
    for n, rows in enumerate(batches):
        ledgers.append(spark.createDataFrame(rows, schema), root, f"{n:020d}", part_rows=part_rows)
    return root, spark.createDataFrame([], schema).schema


def test_files_an_append_opens_follow_the_batch_not_the_ledger(spark):
    from folioscope.sources import ledgers

    batches = [[(f"e{n}-{i}", "p", i) for i in range(200)] for n in range(6)]
    short, schema = stored_ledger(spark, batches[:2])
    long, _ = stored_ledger(spark, batches)
    retried = spark.createDataFrame([("e0-7", "p", 7), ("e1-9", "p", 9), ("new", "p", 1)], schema)
    fresh = spark.createDataFrame([(f"f{i}", "p", i) for i in range(20)], schema)
    for root in (short, long):
        assert 2 <= len(ledgers.may_hold(retried, root)) <= 3
        assert len(ledgers.may_hold(fresh, root)) <= 2
    whole = ledgers.may_hold(spark.createDataFrame([r for b in batches for r in b], schema), long)
    assert len(whole) == 6 * 4
    assert ledgers.read(spark, long, schema).count() == 1200
    status = {r.event_id: (r.added, r.duplicates, r.conflict) for r in ledgers.append_status(retried, long).collect()}
    assert status == {"e0-7": (0, 1, False), "e1-9": (0, 1, False), "new": (1, 0, False)}


def test_no_stored_key_is_missed_at_any_size_of_filter(spark):
    from folioscope.sources import ledgers

    rows = [(f"k{i}", "p", i) for i in range(5000)]
    root, schema = stored_ledger(spark, [rows, [("last", "p", 0)]], part_rows=1000)
    assert [(v.power, v.parts, v.rows) for v in ledgers.manifest(spark, root)] == [(2, 8, 5000), (0, 1, 1)]
    again = ledgers.append_status(spark.createDataFrame(rows[::3], schema), root)
    assert again.filter("added = 0 and duplicates = 1").count() == len(rows[::3])
    unknown = spark.createDataFrame([(f"u{i}",) for i in range(3000)], "event_id string")
    assert len(ledgers.may_hold(unknown.limit(40), root)) <= 4


def test_a_stored_ledger_is_idempotent_refuses_changes_and_compacts(spark):
    from folioscope.sources import ledgers

    root, schema = stored_ledger(spark, [[("a", "p", 1), ("a", "p", 1)], [], [("b", None, None), (None, "p", 3)]])
    frame = lambda *rows: spark.createDataFrame(rows, schema)
    want = {("a", "p", 1), ("b", None, None), (None, "p", 3)}
    for changed in ([("a", "q", 1)], [("b", "p", None)], [("c", "p", 1), ("c", "q", 1)]):
        with pytest.raises(ValueError, match="conflicts"):
            ledgers.append(frame(*changed), root, f"{3:020d}")
    assert ledgers.append(frame(("z", "p", 1)), root, f"{2:020d}") is None
    assert {tuple(r) for r in ledgers.read(spark, root, schema).collect()} == want
    ledgers.compact(spark, root, schema)
    assert len(ledgers.manifest(spark, root)) == 1 and ledgers.done(spark, root, f"{2:020d}")
    ledgers.append(frame(("a", "p", 1), ("d", "p", 4)), root, f"{3:020d}")
    assert {tuple(r) for r in ledgers.read(spark, root, schema).collect()} == want | {("d", "p", 4)}
    with pytest.raises(ValueError, match="names of the"):
        ledgers.append(frame(("e", "p", 1)).withColumnRenamed("part", "ledger_part"), root, f"{4:020d}")
