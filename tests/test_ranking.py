"""Scores, gates, selection and order on small hand-made readers."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from folioscope.operators import contracts, ranking, selection
from folioscope.operators.weights import GROUPS, QUALITY_FIRST, ablations, weight_set, weight_table, without
from folioscope.plans import recommend as plans

NOW = datetime(2026, 8, 1, tzinfo=timezone.utc)
CANDIDATE = """profile_id string, paper_id string, revision int, title string, summary string,
  authors array<string>, affiliations array<string>, categories array<string>,
  published timestamp, updated timestamp, doi string"""
NAMES = "array<struct<name string, aliases array<string>>>"
FACETS = "array<struct<kind string, value string, score double, confidence double, provenance array<string>>>"
PROFILE = f"""profile_id string, topics array<string>, core_categories array<string>,
  adjacent_categories array<string>, watched_authors {NAMES}, watched_institutions {NAMES},
  preference_facets {FACETS}"""


def paper(number, title="Learning methods", summary="learning methods", authors=("Ada",),
          categories=("cs.LG",), age=1.0, places=(), updated=None):
    at = NOW - timedelta(days=age)
    return ("me", f"2601.{number:05d}", 1, title, summary, list(authors), list(places),
            list(categories), at, updated or at, None)


def reader(topics=("learning", "methods"), core=("cs.LG",), adjacent=("stat.ML",), authors=(),
           places=(), facets=()):
    return ("me", list(topics), list(core), list(adjacent), list(authors), list(places), list(facets))


def score(spark, papers, profile, **options):
    return ranking.score_candidates(
        spark.createDataFrame(papers, CANDIDATE), spark.createDataFrame([profile], PROFILE), NOW, **options
    )


def test_score_is_the_weighted_mean_of_known_groups(spark):
    row = score(spark, [paper(1)], reader()).first()
    assert row.lexical == 1 and row.category == 1 and row.source == "core"
    assert row.recency == pytest.approx(13 / 14)
    assert row.interest_value == pytest.approx(1.0)
    assert row.identity_value is None and row.scientific_quality_value is None
    assert row.score == pytest.approx((0.4 * 1 + 0.05 * 13 / 14) / 0.45)


def test_evidence_contribution_is_its_weight_over_known_weights(spark):
    extra = spark.createDataFrame(
        [("2601.00001", "judge_quality", 0.8, True, 1.0, "judge-v5", "scientific_quality"),
         ("2601.00001", "page", 1.0, True, 1.0, "p", "reproducibility"),
         ("2601.00001", "unknown", 0.0, False, 0.0, "p", "context")],
        "paper_id string, name string, value double, applicable boolean, confidence double, provenance string, grp string",
    )
    row = score(spark, [paper(1)], reader(), extra_features=extra).first()
    known = 0.40 + 0.05 + 0.35 + 0.10
    assert row.scientific_quality_contribution == pytest.approx(0.35 * 0.8 / known)
    assert row.reproducibility_contribution == pytest.approx(0.10 / known)
    assert row.context_value is None


def test_tiers_and_future_papers(spark):
    rows = score(
        spark,
        [paper(1, age=-2), paper(2, categories=("stat.ML",), age=20), paper(3, categories=("math.AG",))],
        reader(),
    ).collect()
    got = {r.paper_id[-1]: (r.source, r.category, r.recency) for r in rows}
    assert got["1"] == ("core", 1.0, 1.0)
    assert got["2"] == ("adjacent", 0.6, 0.0)
    assert got["3"][:2] == ("exploration", 0.2)


def test_facets_treat_hyphens_and_spaces_alike(spark):
    facet = ("method", "reinforcement-learning", 0.9, 1.0, ["x"])
    rows = score(
        spark,
        [paper(1, summary="reinforcement learning"), paper(2, title="On", summary="reinforcement-learning"),
         paper(3, title="On", summary="reinforcement only")],
        reader(facets=[facet]),
    ).collect()
    assert {r.paper_id[-1]: round(r.facet, 6) for r in rows} == {"1": 0.3, "2": 0.3, "3": 0.0}


def test_watched_names_match_through_aliases_and_any_script(spark):
    watch = [("Ａda  Lovelace", ["A. Lovelace"]), ("Łukasz Ø", [])]
    rows = score(
        spark,
        [paper(1, authors=("a lovelace",)), paper(2, authors=("ŁUKASZ-Ø",)), paper(3, authors=("Ada",)),
         paper(4, authors=("ada lovelace",), places=("Lab!",))],
        reader(authors=watch, places=[("lab", [])]),
    ).collect()
    got = {r.paper_id[-1]: (r.watched_author, r.watched_institution) for r in rows}
    assert got == {"1": (0.75, 0.0), "2": (0.75, 0.0), "3": (0.0, 0.0), "4": (0.75, 0.25)}


def test_baseline_components_and_total(spark):
    candidates = spark.createDataFrame(
        [paper(1, places=("Lab",))], CANDIDATE
    )
    profile = spark.createDataFrame(
        [reader(authors=[("Ada", [])], places=[("Lab", [])])], PROFILE
    )
    adjust = spark.createDataFrame([("2601.00001", 0.25)], "paper_id string, adjustment double")
    row = ranking.score_baseline(candidates, profile, NOW, adjust).first()
    assert (row.lexical, row.category, row.feedback) == (2.0, 2.0, 0.25)
    assert (row.watched_author, row.watched_institution) == (0.75, 0.25)
    assert row.score == pytest.approx(2 + 2 + 13 / 14 + 0.25 + 0.75 + 0.25)


SCORED = """profile_id string, paper_id string, rank int, score double, source string, title string,
  authors array<string>, solution_advance double, technical_depth double, value_confidence double,
  scientific_quality_value double, quality double, updated timestamp"""


def scored(number, source="core", value=0.9, title=None, authors=None, gate=(None, None, None), sq=None):
    return ("me", f"p{number:03d}", number, value - number / 1000, source,
            title or f"unique{chr(97 + number // 26)}{chr(97 + number % 26)}x words{number}",
            authors or [f"Author {number}"], *gate, sq, 0.5, NOW)


def picked(spark, rows, fn=selection.select_diverse, **options):
    df = spark.createDataFrame(rows, SCORED)
    return [r.paper_id for r in fn(df, **options).orderBy("selected_order").collect()]


def test_quotas_fill_exploration_first(spark):
    rows = [scored(i) for i in range(1, 17)] + [scored(i, "adjacent") for i in range(17, 22)]
    rows += [scored(i, "exploration") for i in range(22, 25)]
    got = picked(spark, rows)
    assert len(got) == 20
    kinds = {r[1]: r[4] for r in rows}
    assert [kinds[p] for p in got[:2]] == ["exploration"] * 2
    assert sum(kinds[p] == "core" for p in got) == 14
    assert sum(kinds[p] == "adjacent" for p in got) == 4


def test_open_places_go_to_the_best_left(spark):
    assert len(picked(spark, [scored(i) for i in range(1, 30)])) == 20


def test_author_cap_and_title_similarity(spark):
    same_author = [scored(i, authors=["Ann", f"b{i}"]) for i in range(1, 6)]
    assert picked(spark, same_author) == ["p001", "p002"]
    twins = [scored(i, title="Exactly the same title") for i in range(1, 4)]
    assert picked(spark, twins) == ["p001"]
    untitled = [scored(i, title="é 12") for i in range(1, 4)]
    assert len(picked(spark, untitled)) == 3


def test_baseline_order_and_threshold(spark):
    rows = [scored(i, value=3.0) for i in range(1, 17)] + [scored(i, "adjacent", 3.0) for i in range(17, 22)]
    rows += [scored(i, "exploration", 3.0) for i in range(22, 25)] + [scored(40, value=0.5)]
    got = picked(spark, rows, selection.select_baseline)
    kinds = {r[1]: r[4] for r in rows}
    assert [kinds[p] for p in got] == ["core"] * 14 + ["adjacent"] * 4 + ["exploration"] * 2


def test_value_gate_needs_confidence_and_a_known_shortfall(spark):
    gates = {1: (0.25, 0.8, 0.8), 2: (0.8, 0.25, 0.8), 3: (None, None, 0.8), 4: (0.25, 0.25, 0.4)}
    assert picked(spark, [scored(i, gate=g) for i, g in gates.items()]) == ["p003", "p004"]


def test_judged_quality_gate_passes_the_unjudged(spark):
    rows = [scored(1, sq=0.2), scored(2, sq=0.25), scored(3)]
    assert picked(spark, rows) == ["p002", "p003"]


def test_policy_bounds():
    with pytest.raises(ValueError):
        selection.policy(minimum_score=1.1)
    with pytest.raises(ValueError):
        selection.policy(exploration_cap=0)


def test_reading_order_breaks_ties_by_quality_time_and_id(spark):
    early, late = NOW, NOW + timedelta(hours=1)
    rows = [("me", "1", 0.5, 0.5, early), ("me", "2", 0.5, 0.5, late), ("me", "3", 0.9, 0.1, early),
            ("me", "4", 0.5, 0.9, early), ("me", "5", 0.4, 0.9, late)]
    df = spark.createDataFrame(rows, "profile_id string, paper_id string, score double, quality double, updated timestamp")
    got = [r.paper_id for r in ranking.reading_order(df).orderBy("rank").collect()]
    assert got == ["3", "4", "2", "1", "5"]


def test_recommend_keeps_good_proposals_only(spark):
    pairs = spark.createDataFrame([paper(1, title="alpha beta"), paper(2, title="gamma delta", authors=("Bo",))], CANDIDATE)
    proposals = spark.createDataFrame(
        [("2601.00001", 0.4, "s", "r"), ("2601.00002", 0.5, "s", "r")],
        "paper_id string, quality double, summary string, reason string",
    )
    got = plans.recommend(pairs, spark.createDataFrame([reader()], PROFILE), proposals, NOW).collect()
    assert [r.paper_id for r in got] == ["2601.00002"]


def test_weight_sets(spark):
    assert len(ablations(QUALITY_FIRST)) == 5
    assert without(QUALITY_FIRST, "interest")["interest"] == 0 and without(QUALITY_FIRST, "recency")["ablation"]
    table = weight_table(
        spark,
        [weight_set("a"), weight_set("b", interest=0.1), weight_set("c", interest=0.9), QUALITY_FIRST,
         without(QUALITY_FIRST, "interest")],
    )
    valid, rejects = contracts.check(table, contracts.weight_set())
    assert {r.version for r in valid.collect()} == {"a", "quality-first-v1", "quality-first-v1-without-interest"}
    assert {r.version: r.reason for r in rejects.collect()} == {
        "b": "interest is not the largest group", "c": "weights exceed one"}
    assert len(GROUPS) == 7


def test_components_list_only_known_values(spark):
    row = ranking.components(score(spark, [paper(1)], reader())).first()
    assert row.components["lexical"] == 1.0 and "identity_value" not in row.components


def many_papers(spark, seed, count, readers):
    """Random candidates and readers over few words, categories, names and days."""
    import random

    rng = random.Random(seed)
    words = ["deep", "deep-learning", "graph", "graph-net", "learning", "sparse", "vision", "net", "rare"]
    names = ["Ada", "Émile", "Bo"]
    cats = ["a", "b", "c", "d"]
    some = lambda pool, most: tuple(rng.sample(pool, rng.randint(0, most)))
    papers = []
    for i in range(count):
        title = " ".join(some(words, 3) if rng.random() < 0.3 else ())
        row = list(paper(i, title, "", some(names, 2) if rng.random() < 0.1 else ("Nobody",),
                         some(cats, 2) or ("a",), rng.choice([0, 1, 3, 20, 20, 30, -2])))
        papers.append(tuple(row[1:]))
    people = []
    for i in range(readers):
        watch = [(n, []) for n in some(names, 1)]
        facets = [("domain", v, 0.9, 1.0, []) for v in some(["graph net", "deep", "net learning"], 2)]
        people.append((f"p{i}", list(some(words, 4)), list(some(cats, 1)), list(some(cats, 1)),
                       watch, [], facets, list(some(cats, 3)) or ["a"]))
    candidates = spark.createDataFrame(papers, CANDIDATE.replace("profile_id string, ", ""))
    return candidates, spark.createDataFrame(people, PROFILE + ", retrieval_categories array<string>")


def test_hits_of_the_index_equal_token_sets(spark):
    import re

    candidates, profiles = many_papers(spark, 1, 80, 6)
    pairs = ranking.assign_pool(candidates, profiles).collect()
    texts = {r.paper_id: r for r in candidates.collect()}
    readers = {r.profile_id: r for r in profiles.collect()}
    assert {(r.profile_id, r.paper_id) for r in pairs} == {
        (p, c) for p, reader in readers.items() for c, row in texts.items()
        if set(reader.retrieval_categories) & set(row.categories)}
    for r in pairs:
        words = set(re.findall("[a-z][a-z0-9-]{2,}", texts[r.paper_id].title.lower()))
        parts = {p for w in words for p in (w.split("-") if "-" in w else [w]) if len(p) >= 3}
        reader = readers[r.profile_id]
        wanted = {w for f in reader.preference_facets for w in f.value.split()}
        assert r.term_overlap == len(words & set(reader.topics))
        assert set(r._met) == wanted & parts | wanted & {w for w in words if "-" not in w}
    assert "words" not in ranking.assign_pool(candidates, profiles).columns


@pytest.mark.parametrize("seed, limit", [(2, 5), (3, 20)])
def test_shortlists_of_a_pool_need_few_pairs(spark, seed, limit):
    candidates, profiles = many_papers(spark, seed, 400, 7)
    prepared = ranking.prepare_candidates(candidates)
    pairs = ranking.assign_pool(candidates, profiles)
    assert ranking.contenders(prepared, profiles, NOW, limit).count() < 0.7 * pairs.count()
    for score in (ranking.score_candidates, ranking.score_baseline):
        whole = ranking.shortlist(score(pairs, profiles, NOW), limit)
        short = ranking.pool_shortlist(candidates, profiles, NOW, limit, score=score)
        assert set(short.columns) == set(whole.columns) - {"_authors_norm", "_places_norm"}
        columns = sorted(short.columns)
        rows = [sorted(df.select(*columns).collect(), key=lambda r: (r.profile_id, r.rank)) for df in (short, whole)]
        assert rows[0] == rows[1] and rows[0]


def test_runs_from_a_pool_equal_runs_from_pairs(spark):
    candidates, profiles = many_papers(spark, 4, 200, 5)
    proposals = candidates.select(
        "paper_id", *[F.lit("x").alias(c) for c in ("summary_text", "reason")], F.lit(0.9).alias("quality"))
    history = candidates.filter("paper_id < '2601.00040'").select(
        "paper_id", "revision", F.lit(NOW - timedelta(days=3)).alias("published_at"))
    for baseline in (False, True):
        runs = [
            plans.recommend(x, profiles, proposals, NOW, history=history, baseline=baseline).select(
                "profile_id", "rank", "paper_id", "score", "selected_order").collect()
            for x in (candidates, ranking.assign_pool(candidates, profiles))]
        assert sorted(runs[0]) == sorted(runs[1]) and runs[0]
    short = [
        plans.refined_shortlist(x, profiles, NOW, history=history, pre_rank_limit=10)
        for x in (candidates, ranking.assign_pool(candidates, profiles))]
    columns = sorted(short[0].columns)
    rows = [sorted(map(str, df.select(*columns).collect())) for df in short]
    assert rows[0] == rows[1]
