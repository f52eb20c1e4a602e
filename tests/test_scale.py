"""Skew-safe building blocks against brute force, with one key holding a third of the rows."""

import random
from datetime import datetime, timedelta, timezone
from statistics import median

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.operators import ledger, scale

NOW = datetime(2026, 8, 1, tzinfo=timezone.utc)


def skewed(n, seed=7):
    rng = random.Random(seed)
    return [("hot" if i % 3 == 0 else f"k{rng.randrange(20)}", rng.randrange(50), i) for i in range(n)]


def test_position_within_numbers_every_group(spark):
    rows = skewed(600)
    df = spark.createDataFrame(rows, "g string, a int, id int").repartition(5)
    got = {r.id: r.position for r in scale.position_within(df, ["g"], ["a", "id"]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for i, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])), 1):
            want[r[2]] = i
    assert got == want


def test_position_within_without_groups(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "v int")
    got = scale.position_within(df, [], ["v"]).collect()
    assert all(r.position == r.v + 1 for r in got)


def test_hot_group_is_spread_over_buckets(spark):
    df = spark.createDataFrame([("hot", i) for i in range(400)], "g string, id int")
    assert scale.range_buckets(df, ["g", "id"]).select("_bucket").distinct().count() >= 4


def test_buckets_grow_with_the_rows(spark):
    buckets = lambda n: scale.range_buckets(
        spark.range(n).withColumn("g", F.lit("hot")), ["g", "id"], rows_per_bucket=500)
    rows = {}
    for n in (10_000, 100_000):
        sizes = [r["count"] for r in buckets(n).groupBy("_bucket").count().collect()]
        rows[n] = (len(sizes), max(sizes))
    assert 18 <= rows[10_000][0] <= 22 and 180 <= rows[100_000][0] <= 220
    assert max(most for _, most in rows.values()) <= 2_000


def test_positions_over_many_buckets_with_nulls(spark):
    rows = [(g, None if i % 7 == 0 else a, i) for g, a, i in skewed(500)]
    df = spark.createDataFrame(rows, "g string, a int, id int")
    got = {r.id: r.position for r in scale.position_within(df, ["g"], ["a", "id"], rows_per_bucket=20).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2])
    want = {}
    for g in {r[0] for r in rows}:
        for i, r in enumerate(sorted((r for r in rows if r[0] == g), key=key), 1):
            want[r[2]] = i
    assert got == want
    assert scale.position_within(df.limit(0), ["g"], ["a", "id"]).count() == 0


def test_hot_keys_get_salts_by_their_count(spark):
    rows = [*skewed(300), (None, 1, 900)]
    wide = spark.createDataFrame(rows, "g string, a int, id int")
    narrow = wide.select("g").distinct().withColumn("w", F.length("g"))
    twice = narrow.unionByName(narrow.withColumn("w", -F.col("w")))
    plain = sorted(tuple(r) for r in wide.join(twice, "g").select("g", "id", "w").collect())
    salted = scale.hot_key_join(wide, twice, ["g"], rows=2, rows_per_task=30)
    assert sorted(tuple(r) for r in salted.select("g", "id", "w").collect()) == plain
    plan = salted._jdf.queryExecution().toString()
    assert "_salt" in plan and "Cartesian" not in plan


def test_exact_medians(spark):
    rows = [(g, float(a) if i % 5 else None, float(i)) for g, a, i in skewed(500)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = scale.exact_medians(df, ["g"], {"mx": F.col("x"), "my": F.col("y")}).collect()
    for r in got:
        xs = [x for g, x, _ in rows if g == r.g and x is not None]
        ys = [y for g, _, y in rows if g == r.g]
        assert r.my == median(ys)
        assert r.mx == (median(xs) if xs else None)
    assert len(got) == len({g for g, _, _ in rows})


def test_latest_by_and_top_per_group(spark):
    rows = skewed(300)
    df = spark.createDataFrame(rows, "g string, a int, id int")
    latest = {r.g: (r.a, r.id) for r in scale.latest_by(df, ["g"], [F.col("a"), F.col("id")]).collect()}
    assert latest == {g: max((a, i) for h, a, i in rows if h == g) for g in latest}
    top = scale.top_per_group(df, ["g"], [F.col("a").desc(), F.col("id")], 3).collect()
    for g in latest:
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))[:3]
        assert [(r.a, r.id) for r in sorted(top, key=lambda r: r["rank"]) if r.g == g] == [
            (a, i) for _, a, i in want
        ]


def test_salted_join_equals_plain_join(spark):
    wide = spark.createDataFrame(skewed(300), "g string, a int, id int")
    narrow = wide.select("g").distinct().withColumn("w", F.length("g"))
    plain = {tuple(r) for r in wide.join(narrow, "g").select("g", "id", "w").collect()}
    salted = scale.hot_key_join(wide, narrow, ["g"], rows=2)
    assert {tuple(r) for r in salted.select("g", "id", "w").collect()} == plain
    assert "Cartesian" not in salted._jdf.queryExecution().toString()


def test_ranked_top_trims_before_the_shuffle(spark):
    df = spark.createDataFrame(skewed(100), "g string, a int, id int")
    plan = scale.top_per_group(df, ["g"], [F.col("a").desc()], 3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def brute_fold(steps):
    weight = 1.0
    for _, _, d in sorted(steps):
        weight = weight + d if d >= 0 else max(0.25, weight + d)
    return weight


def test_clamped_weights_equal_the_sequential_fold(spark):
    rng = random.Random(3)
    rows = [
        ("hot" if i % 3 == 0 else f"p{rng.randrange(6)}", NOW + timedelta(minutes=rng.randrange(40)),
         f"e{i:04d}", rng.choice([1.0, -0.5, -0.5, -0.5, 0.0]))
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, "paper string, occurred_at timestamp, event_id string, delta double")
    got = {r.paper: r.weight for r in ledger.clamped_weights(df, "paper").collect()}
    for paper in got:
        assert got[paper] == brute_fold([(at, e, d) for p, at, e, d in rows if p == paper])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([1.0, -0.5, 0.0]), max_size=30))
def test_the_closed_form_of_the_fold(deltas):
    tails = [sum(deltas[i + 1 :]) for i in range(len(deltas))]
    closed = max([1.0 + sum(deltas)] + [0.25 + t for d, t in zip(deltas, tails) if d < 0])
    assert closed == brute_fold([(i, "", d) for i, d in enumerate(deltas)])


def test_documents_grow_with_their_table(spark):
    import glob

    from folioscope.catalog import documents
    from folioscope.sources import writers

    files = {}
    for rows in (900, 40_000):
        path = documents._written(spark, spark.range(rows), f"documents-{rows}", "entries", 1)
        files[rows] = len(glob.glob(f"{path}/part-*.json"))
        listed = spark.read.schema("entries array<struct<id:long>>").option("multiLine", True).json(path)
        assert listed.selectExpr("inline(entries)").distinct().count() == rows
    assert files[900] == 3 and files[40_000] <= writers.SEVERAL


def test_one_row_group_of_texts_becomes_tasks_by_rows(spark, tmp_path):
    from folioscope.catalog import base

    path = str(tmp_path / "documents.parquet")
    spark.range(30_000).selectExpr("id as doc_id", "repeat('x', 20) as text").coalesce(1).write.parquet(path)
    texts = base.spread(spark.read.parquet(path), "documents")
    sizes = [r["count"] for r in texts.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 30_000 and len(sizes) >= 6 and max(sizes) <= 10_000


def test_html_stages_are_computed_few_times(spark):
    from folioscope.functions import text

    page = spark.createDataFrame([("<p>a&eacute;b</p>",)], "html string").select(text.html_to_text(F.col("html")).alias("t"))
    assert page.first().t == "aéb"
    # Comments are removed once for each of three stages, not once for each use of each of them.
    assert page._jdf.queryExecution().optimizedPlan().toString().count("</?(?:div|p|li)") <= 6
