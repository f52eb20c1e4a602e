"""Readers, sinks, library sync, profiles, evidence, exchange and streams."""

import json
import unicodedata
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions import hashing, identity, moments, text, urls
from folioscope.operators import contracts, evidence, exchange, library, pool, profile, publishing
from folioscope.sources import readers, writers
from folioscope.streaming import jobs

NOW = datetime(2026, 8, 1, tzinfo=timezone.utc)


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("v")).first().v


# ---- scalars ----------------------------------------------------------------------------------


@pytest.mark.parametrize("raw, key, rev", [
    (" arXiv:2601.00001v3 ", "2601.00001", 3), ("https://arxiv.org/abs/2601.0001", "2601.0001", None),
    ("math.GT/0309136v1", "math.gt/0309136", 1), ("2601.001", None, None), ("x2601.00001", None, None)])
def test_paper_ids(spark, raw, key, rev):
    assert one(spark, identity.paper_id(F.col("a")), a=raw) == key
    assert one(spark, identity.revision(F.col("a")), a=raw) == rev


def test_identities(spark):
    c = F.col("a")
    assert one(spark, identity.doi(c), a=" DOI:10.5555/AbC ") == "10.5555/abc"
    assert one(spark, identity.doi(c), a="10.5/x") is None
    assert one(spark, identity.canonical_identity(c), a="doi:10.48550/arXiv.2601.00001v2") == "arxiv:2601.00001"
    assert one(spark, identity.canonical_identity(c), a="arXiv:nonsense") == "arxiv:nonsense"
    assert one(spark, identity.corpus_identity(c), a="10.5555/x") == "doi:10.5555/x"
    assert one(spark, identity.corpus_identity(c), a="isbn 5") is None
    assert one(spark, identity.preprint_identity(c), a="doi:10.5555/x") is None
    found = one(spark, identity.preprints_in_text(c),
                a="see https://arxiv.org/pdf/2601.00001v2.pdf, arXiv: 2601.00002v1; 10.48550/arXiv.2601.00001 x")
    assert found == ["arxiv:2601.00001", "arxiv:2601.00002"]


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet=st.sampled_from("aZß ẞſﬁﬃİKéŁ-9ŉǰẖ́Σ"), max_size=20))
def test_ranking_words_equal_python_case_folding(value):
    import re

    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    want = re.findall(text.RANKING_WORD, value.casefold())
    assert one(spark, text.ranking_words(F.col("a")), a=value) == want


def test_rare_characters_are_looked_for_behind_one_range(spark):
    """The class of all of them costs a comparison a member and character, so most texts never meet it."""
    rare = [c for c in text.FOLD_EXTRAS if c != "ß"]
    tests = spark.range(1).select(text.ascii_fold(F.lit("a"))).columns[0].split(" THEN ")[0]
    near, wide = f"[{min(rare)}-{max(rare)}]", "[" + "".join(rare) + "]"
    assert near in tests and tests.index(near) < tests.index(wide)


def test_profile_tokens(spark):
    raw = "The Learning www.site.org/x github.com/a/b sk-abcdefghijkl1234 Password42 top-k"
    assert one(spark, text.profile_tokens(F.col("a")), a=raw) == ["learning", "top-k"]


def test_generic_reasons(spark):
    g = text.is_generic_reason(F.col("a"))
    assert one(spark, g, a="This paper is relevant.") and one(spark, g, a="good good good good paper")
    assert not one(spark, g, a="It proves a tight bound for sparse attention")
    assert not one(spark, g, a="论文很好")


def test_names_of_any_script(spark):
    df = spark.createDataFrame([(["J. O'Neil", "Ｆｕｌｌ"],), (["a_b  C"],)], "n array<string>")
    got = [r.v for r in df.select(text.normalized_identities(F.col("n")).alias("v")).collect()]
    want = " ".join(unicodedata.normalize("NFKC", "Ｆｕｌｌ").casefold().split())
    assert got == [["j o neil", want], ["a_b c"]]


def test_html(spark):
    raw = "<style>x</style><p>A&amp;B<br>C</p><script>no</script>D<li>E"
    assert one(spark, text.html_to_text(F.col("a")), a=raw) == "A&B C D E"
    assert one(spark, text.html_to_text(F.col("a")), a="x&#8217;s &lt;b&gt; ﬁ&eacute;&amp;lt; <!-- <p> -->1<") == "x\u2019s <b> fi\u00e9&lt; 1<"
    assert one(spark, text.html_to_text(F.col("a")), a=None) == ""
    page = "<nav>n</nav><h2>Our <b>Method</b></h2>m1<p>m2</p><h3>Results</h3>" + "r" * 5000 + "<h2>Intro</h2>zz<h2>Future work</h2>" + "l" * 4500
    got = one(spark, text.paper_sections(F.col("a")), a=page)
    assert got["method"] == "m1 m2" and len(got["evaluation"]) == 4000 and len(got["limitations"]) == 4000
    free = one(spark, text.paper_sections(F.col("a"), None, None), a=page)
    assert len(free["evaluation"]) == 5000 and len(free["limitations"]) == 4500
    less = one(spark, text.paper_sections(F.col("a"), 4000, 6000), a=page)
    assert len(less["evaluation"]) == 4000 and len(less["limitations"]) == 1996
    df = spark.createDataFrame([("p", page)], "paper_id string, html string")
    assert evidence.sections(df).first().method == "m1 m2"


@pytest.mark.parametrize("page, shown", [
    ('<p>A</p><script>document.write("<!--");</script><p>B</p>', "A B"),
    ('<style>/* <!-- */</style>A<!-- <script> -->B', "AB"),
    ('<img alt="a > b">C', "C"), ("<img alt='<p>'>C<b>D</b>", "CD"),
    ('<p title="1 < 2">A &amp; B</p>', "A & B"), ("<p-x>A</p-x>B", "AB"),
    ("A<script>x</script >B<style-guide>C</style-guide>", "ABC"),
    ("<img " + 'a="b" ' * 5000 + 'alt="x > y">C', "C"),
    ('<a title=">">&amp;lt;</a> &lt;b&gt; &eacute;', "&lt; <b> é")])
def test_pages_that_only_a_parser_can_read(spark, page, shown):
    assert one(spark, text.html_to_text(F.col("a")), a=page) == shown


@pytest.mark.parametrize("page, method", [
    ('<h2>Method</h2>A<script>"<!--"</script><p>B</p>', "A B"),
    ('<h2>Our <img alt="a > b">Method</h2>A<img alt="x > y">B', "A B"),
    ("<nav>a<nav>b</nav><h2>Result</h2>c</nav><h2>Method</h2>A", "A"),
    ("<h2>Method</h2><nav-bar>A</nav-bar>&lt;h3&gt;", "A <h3>"),
    ("<nav><script>'</nav>'</script><p>n</p></nav><h2>Method</h2>A<!-- x -->B", "A B")])
def test_sections_that_only_a_parser_can_read(spark, page, method):
    assert one(spark, text.paper_sections(F.col("a")), a=page)["method"] == method


def test_moments(spark):
    c = F.col("a").cast("timestamp")
    assert one(spark, moments.product_date(c), a="2026-08-01T17:00:00Z") == "2026-08-02"
    window = moments.generation_window_open(c)
    assert one(spark, window, a="2026-08-01T00:30:00Z") and not one(spark, window, a="2026-08-01T00:30:01Z")
    assert one(spark, window, a="2026-08-01T10:30:00Z")
    decay = moments.date_decay(F.col("a"), F.lit(NOW))
    assert one(spark, decay, a="no date") == 0.35 and one(spark, decay, a="2026-13-01") == 0.35
    assert one(spark, decay, a="1980") == 0.1 and one(spark, decay, a="2026-08-01") == 1.0
    assert one(spark, moments.parse_instant(F.col("a")), a="2026-08-01T00:00:00") is None
    with pytest.raises(ValueError):
        moments.instant("2026-08-01T00:00:00")


def test_project_links(spark):
    raw = ("https://github.com/a/b#x, (https://GitHub.com/a/b). https://github.com/a https://u@github.com/a/c "
           "https://x.github.io/p https://gitlab.com:444/a/b https://gitlab.com:443/a/b/ https://huggingface.co/m/n")
    assert one(spark, urls.project_urls(F.col("a")), a=raw) == [
        "https://github.com/a/b", "https://x.github.io/p", "https://gitlab.com:443/a/b/"]
    assert one(spark, urls.repository_of(F.col("a")), a="https://github.com/a/b.git") == "a/b"
    assert one(spark, urls.repository_of(F.col("a")), a="https://github.com/a/b/c") is None


def test_cache_keys_match_sha256(spark):
    import hashlib

    key = hashing.joined_key(F.col("a"), "7", "m")
    assert one(spark, key, a="p") == hashlib.sha256(b"p\x007\x00m").hexdigest()
    assert one(spark, key, a=" ") is None


# ---- readers and sinks --------------------------------------------------------------------------

FEED = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">
<entry><id>http://arxiv.org/abs/2601.00001v2</id><updated>2026-07-02T00:00:00Z</updated>
<published>2026-07-01T00:00:00Z</published><title>A
  title</title><summary> s </summary><author><name>Ada</name><arxiv:affiliation>Lab</arxiv:affiliation></author>
<author><name>Bo</name><arxiv:affiliation>Lab</arxiv:affiliation></author>
<category term="cs.LG"/><category term="cs.AI"/><category term="cs.LG"/><arxiv:doi>10.5555/ABC</arxiv:doi></entry>
<entry><id>http://arxiv.org/abs/bad</id><updated>2026-07-02T00:00:00Z</updated>
<published>2026-07-01T00:00:00Z</published><title>t</title><summary>s</summary><author><name>Ada</name></author>
<category term="cs.LG"/></entry></feed>"""


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text(FEED)
    valid, rejects = readers.read_feed(spark, str(tmp_path / "f.xml"))
    row = valid.first()
    assert (row.paper_id, row.revision, row.title, row.doi) == ("2601.00001", 2, "A title", "10.5555/abc")
    assert row.authors == ["Ada", "Bo"] and row.categories == ["cs.AI", "cs.LG"] and row.affiliations == ["Lab"]
    assert rejects.first().reason == "identifier is malformed"
    with pytest.raises(ValueError):
        readers.read_feed(spark, str(tmp_path / "f.xml"), fail_fast=True)
    (tmp_path / "e.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"></feed>')
    assert readers.read_feed(spark, str(tmp_path / "e.xml"))[0].count() == 0


def test_library_items(spark, tmp_path):
    item = {"key": "K", "version": 3, "data": {"itemType": "journalArticle", "title": "<b>T</b>", "DOI": "10.5/x",
            "url": "https://arxiv.org/abs/2601.00001v2", "tags": [{"tag": "a"}, {"tag": "b", "type": 1}, {"tag": ""}],
            "creators": [{"firstName": "Ada", "lastName": "L"}, {"name": "Lab"}], "collections": ["C"], "note": "<p>n</p>"}}
    (tmp_path / "i.json").write_text(json.dumps(item))
    row = readers.read_library_items(spark, str(tmp_path / "i.json")).first()
    assert row.title == "T" and row.creators == ["Ada L", "Lab"] and row.note_text == "n"
    assert row.identifiers == ["10.5/x", "arxiv:2601.00001"]
    assert [tuple(t) for t in row.tags] == [("a", True), ("b", False)]


def test_pool_versions(spark, tmp_path):
    old = {"candidates": [{"arxiv_id": "2601.00001v2", "title": "t", "authors": ["a"], "categories": ["c"], "summary": "s",
            "published": "2026-07-01T00:00:00+00:00", "updated": "2026-07-01T00:00:00+00:00"}]}
    (tmp_path / "p.json").write_text(json.dumps(old, indent=1))
    row = readers.read_pool(spark, str(tmp_path / "p.json")).first()
    assert (row.paper_id, row.revision, row.affiliations, row.doi) == ("2601.00001", 2, [], None)
    assert row.abstract_url == "https://arxiv.org/abs/2601.00001"
    (tmp_path / "q.json").write_text(json.dumps({"schema_version": 9, **old}))
    with pytest.raises(Exception, match="unsupported pool schema"):
        readers.read_pool(spark, str(tmp_path / "q.json")).collect()


def test_profile_round_trip(spark, tmp_path):
    row = {"schema_version": 1, "source_library_version": 7, "topics": ["a"], "core_categories": ["cs.LG"],
           "adjacent_categories": [], "representative_terms": [], "representative_papers": []}
    (tmp_path / "me.json").write_text(json.dumps(row))
    got = readers.read_profiles(spark, str(tmp_path / "me.json"))
    assert got.first().profile_id == "me" and got.first().preference_facets == []
    assert contracts.check(got, contracts.remote_profile())[1].count() == 0
    assert "preference_facets" not in writers.exported_profile(got, 3).columns


def test_submissions(spark, tmp_path):
    action = {"arxiv_id": "2601.00001", "action": "read", "updated_at": "2026-08-01T00:00:00Z"}
    body = lambda *a, **extra: json.dumps({"schema_version": 1, "feedback": list(a), **extra})
    issues = [{"number": 4, "body": body(action)}, {"number": 5, "body": body(action, action)}, {"number": 6, "body": "no"},
              {"number": 7, "body": body(action, more=1)}, {"number": 8, "body": body({**action, "action": "worthwhile"})}]
    (tmp_path / "i.json").write_text(json.dumps(issues))
    events, rejects = readers.read_submissions(spark, str(tmp_path / "i.json"))
    assert [(r.event_id, r.outcome) for r in events.collect()] == [("issue-4-0", "read")]
    assert {r.number: r.reason for r in rejects.collect()} == {
        5: "papers repeat", 6: "fields are unsupported", 7: "fields are unsupported", 8: "action is invalid"}


def test_other_documents(spark, tmp_path):
    def doc(name, value):
        (tmp_path / name).write_text(json.dumps(value, indent=1))
        return str(tmp_path / name)

    assert readers.read_feedback(spark, doc("l1", {"schema_version": 1, "adjustments": {"p": 0.5}})).count() == 0
    assert readers.read_feedback_adjustments(spark, str(tmp_path / "l1")).first().adjustment == 0.5
    manifest = {"schema_version": 1, "model": "m", "candidate_count": 1, "recommendation_count": 1, "model_requests": 0,
                "cache_hits": 0, "estimated_tokens": 0, "estimated_cost_usd": 0.0, "duration_seconds": -1.0}
    got = readers.read_manifests(spark, doc("m1", {"manifests": [manifest, {**manifest, "duration_seconds": 1.0}]}))
    valid, rejects = contracts.check(got, contracts.run_manifest())
    assert (valid.count(), rejects.first().reason) == (1, "measurements are invalid")
    assert readers.read_manifests(spark, doc("m2", manifest)).count() == 1
    snap = {"schema_version": 1, "snapshot_id": "eval-1", "splits": [{"name": "s", "paper_ids": ["a", "b"]}],
            "labels": [["a", "positive"]], "pairwise_preferences": [["a", "b"]]}
    got = readers.read_snapshot(spark, doc("s1", snap))
    assert [(r.position, r.paper_id) for r in got["splits"].orderBy("position").collect()] == [(1, "a"), (2, "b")]
    assert got["labels"].first().label == "positive" and got["pairwise"].first().compared_paper_id == "b"
    hist = {"schema_version": 1, "entries": [{"arxiv_id": "2601.00001", "revision": None, "published_at": "2026-07-30T00:00:00+00:00"}]}
    assert readers.read_history(spark, doc("h1", hist)).first().paper_id == "2601.00001"
    fact = {"availability": "available", "confidence": 0.8, "observed_at": "x", "provider": "o", "claim": True}
    cache = {"o:v1:arxiv:1": {"canonical_paper_id": "arxiv:1", "observed_at": "2026-08-01T00:00:00+00:00", "provider": "o", "adapter_version": "v1",
             "expires_at": "2026-08-02T00:00:00+00:00", "context": {"citation_count": 3, "open_access": fact, "retracted": fact}}}
    got = readers.read_evidence(spark, doc("e1", cache))
    assert evidence.valid_evidence(got, NOW, "o", "v1").first().context.citation_count == 3
    assert evidence.valid_evidence(got, NOW + timedelta(days=1), "o", "v1").count() == 0
    assert readers.read_cache(spark, doc("c1", {"k": "{}"})).first().cache_key == "k"
    watch = {"watched_authors": [{"name": "Ada", "aliases": ["ada"]}, {"name": "Bo"}]}
    valid, rejects = readers.read_watchlist(spark, doc("w1", watch))
    assert (valid.first().name, rejects.first().reason) == ("Bo", "aliases repeat")
    old = {"schema_version": 1, "generated_at": "2026-01-01T00:00:00+00:00", "recommendations": [
        {"arxiv_id": "1", "title": "t", "authors": ["a"], "categories": [], "published_on": "d", "summary": "s", "reason": "r",
         "confidence": 0.7, "quota_source": "core", "abstract_url": "https://arxiv.org/abs/1", "pdf_url": "https://arxiv.org/pdf/1"}]}
    got = readers.read_published(spark, doc("p1", old))
    assert (got.first().quality, got.first().reproducibility_evidence) == (0.7, "unknown")
    assert contracts.check(got, contracts.published())[1].count() == 0


def test_versioned_sinks(spark, tmp_path):
    schema = "paper_id string, updated timestamp"
    first = spark.createDataFrame([("a", NOW), ("b", NOW - timedelta(days=40))], schema)
    root = str(tmp_path / "pool")
    assert [r.paper_id for r in writers.commit_pool(root, first, NOW, "v1").collect()] == ["a"]
    second = spark.createDataFrame([("a", NOW), ("c", NOW)], schema)
    writers.commit_pool(root, second, NOW, "v2")
    assert {r.paper_id for r in writers.read_current(spark, root).collect()} == {"a", "c"}
    splits = spark.createDataFrame([("s", 1, "a")], "split string, position long, paper_id string")
    assert writers.write_snapshot_once(splits, root, "eval-1") and not writers.write_snapshot_once(splits, root, "eval-1")
    with pytest.raises(ValueError):
        writers.write_snapshot_once(splits.withColumn("paper_id", F.lit("z")), root, "eval-1")


# ---- pool, library, profile -----------------------------------------------------------------------


def test_pool_merge_rules(spark):
    schema = "paper_id string, updated timestamp, title string"
    old = spark.createDataFrame([("a", NOW, "old"), ("b", NOW - timedelta(days=30), "edge"), ("c", NOW - timedelta(days=31), "gone")], schema)
    new = spark.createDataFrame([("a", NOW, "tie"), ("b", NOW - timedelta(days=1), "newer")], schema)
    merged = pool.merge_pool(old, new, NOW)
    assert {r.paper_id: r.title for r in merged.collect()} == {"a": "old", "b": "newer"}
    again = pool.merge_pool(merged, merged, NOW)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in merged.collect()}
    many = spark.createDataFrame([(f"{i:05d}", NOW, "x") for i in range(1100)], schema)
    kept = [r.paper_id for r in pool.merge_pool(old, many, NOW).collect()]
    assert len(kept) == 1000 and "00099" not in kept


def test_suppression(spark):
    history = spark.createDataFrame([("a", 1, NOW - timedelta(days=14)), ("b", 1, NOW - timedelta(days=15)), ("c", 1, NOW - timedelta(days=31))],
                                    "paper_id string, revision int, published_at timestamp")
    papers = spark.createDataFrame([("a", 1), ("b", 2)], "paper_id string, revision int")
    assert [r.paper_id for r in pool.suppress(papers, history, NOW).collect()] == ["b"]
    after = {r.paper_id: (r.revision, r.published_at) for r in pool.next_history(history, papers.filter("paper_id = 'b'"), NOW).collect()}
    assert set(after) == {"a", "b"} and after["b"][0] == 2


ITEM = """profile_id string, key string, version long, item_type string, parent_key string, title string, creators array<string>,
  tags array<struct<tag string, manual boolean>>, collections array<string>, identifiers array<string>, abstract string, date string,
  trashed boolean, note_text string, annotation_text string, annotation_comment string"""


def item(key, title="", kind="journalArticle", parent=None, tags=(), collections=(), date=None, trashed=False, note=None, mark=None, comment=None, version=1):
    return ("me", key, version, kind, parent, title, [], list(tags), list(collections), [], "", date, trashed, note, mark, comment)


def test_library_sync(spark):
    first = spark.createDataFrame([item("a", "x"), item("b", "y")], ITEM)
    none = first.limit(0)
    changes = library.merge_changes(none, first)
    assert tuple(library.change_counts(changes).first()) == (2, 0, 0)
    assert tuple(library.change_counts(library.merge_changes(first, first)).first()) == (0, 2, 0)
    gone = spark.createDataFrame([("a",), ("zz",)], "key string")
    left = library.surviving(library.merge_changes(first, none, deleted=gone))
    assert [r.key for r in left.collect()] == ["b"]
    moved = spark.createDataFrame([item("a", "x", collections=["new"])], ITEM)
    after = library.merge_changes(first, moved, complete=True)
    assert [(r.key, r.collections) for r in library.surviving(after).collect()] == [("a", ["new"])]
    assert tuple(library.change_counts(after).first()) == (1, 0, 1)


def test_profile_weights(spark):
    items = spark.createDataFrame(
        [item("r", "machine learning", tags=[("Quantum", True), ("ranking-curated:vision", False), ("internal:hidden", True)], collections=["C", "D"], date="2026-08-01"),
         item("n", kind="note", parent="r", note="language language sk-abcdefghijkl9999"), item("m", kind="annotation", parent="r", mark="neural", comment="algorithm"),
         item("t", "trashed words", trashed=True), item("o", "statistical", date="1980")], ITEM)
    collections = spark.createDataFrame([("me", "C", "Positive"), ("me", "D", "Retrieval")], "profile_id string, key string, name string")
    got = {r.term: (r.weight, r.recent_weight) for r in profile.term_weights(items, collections, observed_at=NOW).collect()}
    assert got["machine"] == (0.25, 0.25) and got["quantum"][0] == 2.0 and got["vision"][0] == 4.0
    assert got["language"][0] == 3.0 and got["neural"][0] == 2.0 and got["algorithm"][0] == 2.5 and got["retrieval"][0] == 1.0
    assert got["statistical"] == (0.25, 0.025) and "hidden" not in got and "trashed" not in got and "positive" not in got
    curated = spark.createDataFrame([("me", "r")], "profile_id string, key string")
    boosted = {r.term: r.weight for r in profile.term_weights(items, collections, curated=curated).collect()}
    assert boosted["machine"] == 4.25
    tables = profile.build_profile(items, collections, observed_at=NOW)
    remote = profile.project_remote(tables).first()
    assert remote.topics[:2] == ["vision", "language"] and remote.within_budget
    assert remote.core_categories == ["cs.CV", "cs.CL", "cs.DS", "cs.NE", "quant-ph", "cs.LG"]
    assert remote.adjacent_categories == ["cond-mat.str-el", "cs.AI", "stat.ML"]
    assert not profile.project_remote(tables, budget=10).first().within_budget
    assert {f.kind for f in remote.preference_facets} <= {"domain", "method", "task"}


def test_digest_cache(spark):
    items = spark.createDataFrame([item("a", "alpha", date="May 1999"), item("b", "beta")], ITEM)
    digests = profile.item_digests(items)
    assert {r.item_key: r.year for r in digests.collect()} == {"a": 1999, "b": None}
    changed = spark.createDataFrame([item("a", "alpha", date="May 1999"), item("b", "beta"), item("c", kind="note", parent="b", note="gamma")], ITEM)
    got = {r.item_key: (r.reused, "gamma" in r.terms) for r in profile.refresh_digests(changed, digests).collect()}
    assert got == {"a": (True, False), "b": (False, True)}
    best = profile.representative_items(digests).orderBy("rank").collect()
    assert [r.item_key for r in best] == ["b", "a"]


# ---- evidence and exchange --------------------------------------------------------------------------


def test_repository_grades(spark):
    rows = [("a", "src"), ("a", "tests"), ("a", "data"), ("b", "run.PY"), ("c", "README.md"), ("d", "x.py"), ("d", "bad/name"), ("e", "m.jl"), ("e", "benchmark.txt")]
    got = {r.repo: r.grade for r in evidence.grade_listings(spark.createDataFrame(rows, "repo string, file_name string")).collect()}
    assert got == {"a": "implementation_data_and_evaluation", "b": "implementation", "c": "documentation_only", "d": "unknown", "e": "implementation_and_evaluation"}


def test_packing_keeps_records_whole(spark):
    rows = [("r", str(i), i, "x" * 400) for i in range(5)] + [("big", "1", 1, "y" * 900)] + [("many", str(i), i, "z") for i in range(9)]
    df = spark.createDataFrame(rows, "run_id string, paper_id string, record_order int, record string")
    packed, refused = exchange.pack_records(df, batch_size=4, max_requests=2, max_tokens=200, max_bytes=850)
    assert {r.run_id: r.reason for r in refused.collect()} == {
        "r": "run exceeds the request budget", "big": "record exceeds the request budget", "many": "run exceeds the request budget"}
    packed, refused = exchange.pack_records(df.filter("run_id = 'r'"), batch_size=4, max_requests=3, max_tokens=200, max_bytes=850)
    assert [r.batch_no for r in packed.orderBy("paper_id").collect()] == [1, 1, 2, 2, 3] and refused.count() == 0


JUDGMENT = {"arxiv_id": "2601.00001", "dimensions": {d: 0.5 for d in exchange.DIMENSIONS}, "uncertainty": 0.2, "evidence_fields": ["title", "summary"]}


@pytest.mark.parametrize("change, reason", [
    ({}, None), ({"uncertainty": 2}, "uncertainty is invalid"), ({"uncertainty": "0.2"}, "uncertainty is invalid"), ({"more": 1}, "unsupported fields"),
    ({"evidence_fields": ["title"]}, "evidence references are invalid"), ({"evidence_fields": ["title", "title"]}, "evidence references are invalid"),
    ({"dimensions": {"novelty": 0.5}}, "dimensions are invalid"), ({"arxiv_id": "nope"}, "identifier is malformed")])
def test_judgment_contract(spark, change, reason):
    value = {**JUDGMENT, **change}
    answers = spark.createDataFrame([(1, json.dumps({"judgments": [value]}))], "batch_id long, content string")
    asked = spark.createDataFrame([(1, "2601.00001")], "batch_id long, paper_id string")
    valid, rejects = exchange.parse_judgments(answers, asked)
    assert valid.count() == (reason is None)
    assert reason is None or reason in {r.reason for r in rejects.collect()}


def test_answers_are_parsed_once(spark, monkeypatch):
    """One write of the entries, and no parse per use of a field in its plan."""
    plans = []

    def written(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df

    monkeypatch.setattr(exchange, "materialized", written)
    answers = spark.createDataFrame([(1, json.dumps({"judgments": [JUDGMENT]}))], "batch_id long, content string")
    asked = spark.createDataFrame([(1, "2601.00001")], "batch_id long, paper_id string")
    exchange.parse_judgments(answers, asked)
    # The response; fields, uncertainty and dimensions of an entry.
    assert len(plans) == 1 and plans[0].count("from_json(") == 4


def test_unknown_dimensions_stay_unknown(spark):
    dims = {**JUDGMENT["dimensions"], "novelty": None, "solution_advance": None}
    answers = spark.createDataFrame([(1, json.dumps({"judgments": [{**JUDGMENT, "dimensions": dims}]}))], "batch_id long, content string")
    asked = spark.createDataFrame([(1, "2601.00001")], "batch_id long, paper_id string")
    valid, _ = exchange.parse_judgments(answers, asked)
    assert valid.select(exchange.judged_quality().alias("q")).first().q == pytest.approx(0.4)
    row = exchange.value_assessments(valid).first()
    assert row.solution_advance is None and row.technical_depth == 0.5


def test_batches_are_all_or_nothing(spark):
    entry = lambda n: {"arxiv_id": f"2601.0000{n}", "quality": 0.9, "summary": "s" * 30, "reason": "it proves a tight bound for sparse models"}
    body = lambda *n: json.dumps({"proposals": [entry(i) for i in n]})
    answers = spark.createDataFrame([(1, body(1, 2)), (2, body(1)), (3, body(1, 1)), (4, body(3)), (5, "{}")], "batch_id long, content string")
    asked = spark.createDataFrame([(b, f"2601.0000{n}") for b, ns in ((1, (1, 2)), (2, (1, 2)), (3, (1,)), (4, (1,)), (5, (1,))) for n in ns], "batch_id long, paper_id string")
    valid, rejects = exchange.parse_proposals(answers, asked)
    assert {r.batch_id for r in valid.collect()} == {1} and valid.count() == 2
    why = {(r.batch_id, r.reason) for r in rejects.collect()}
    assert {(2, "requested paper is missing"), (3, "paper is answered twice"), (4, "paper was not requested")} <= why


def test_explanations(spark):
    entry = {"arxiv_id": "2601.00001", "summary": "s" * 20, "reason": "it proves a tight bound for sparse models", "limitation": "l" * 19, "evidence_fields": ["title", "summary"]}
    answers = spark.createDataFrame([(1, json.dumps({"explanations": [entry]}))], "batch_id long, content string")
    asked = spark.createDataFrame([(1, "2601.00001")], "batch_id long, paper_id string")
    valid, rejects = exchange.parse_explanations(answers, asked)
    assert valid.count() == 0 and rejects.filter("reason = 'text is invalid'").count() == 1


def test_usage_is_all_or_null(spark):
    rows = [("r", 1, 0, 5, 5, 0, 10, None, 1.0), ("r", 1, 0, 5, 5, 0, 20, 7, None)]
    df = spark.createDataFrame(rows, "run_id string, requests long, cache_hits long, estimated_input long, estimated_output long, retry_count long, actual_input long, actual_output long, latency double")
    row = exchange.usage_totals(df).first()
    assert (row.actual_input, row.actual_output, row.latency) == (30, None, 1.0)


def test_sensitive_scan(spark):
    rows = [("a", "key ghp_" + "a" * 24), ("b", "-----BEGIN RSA PRIVATE KEY-----"), ("c", "nothing")]
    got = {r.label: (r.rows, r.hits) for r in publishing.scan_sensitive(spark.createDataFrame(rows, "id string, text string")).collect()}
    assert got == {"GitHub token": (1, 1), "private key": (1, 1)}


# ---- streams ------------------------------------------------------------------------------------------


def test_streams_add_up_over_batches(spark, tmp_path):
    schema = "event_id string, paper_id string, occurred_at timestamp"
    folder, root = tmp_path / "in", str(tmp_path / "out")
    write = lambda rows, n: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / n))
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(folder))
    write([("a", "p", NOW), ("a", "p", NOW), ("b", "q", NOW)], "1")
    write([("b", "q", NOW), ("c", "r", NOW - timedelta(days=400))], "2")
    assert {r.event_id for r in jobs.ingest_events(stream(), root).collect()} == {"a", "b", "c"}
    write([("d", "s", NOW)], "3")
    got = [r.event_id for r in jobs.ingest_events(stream(), root).collect()]
    assert sorted(got) == ["a", "b", "c", "d"]
    write([("a", "changed", NOW)], "4")
    with pytest.raises(Exception, match="conflicts"):
        jobs.ingest_events(stream(), root)


def test_streamed_pool_equals_the_batch_merge(spark, tmp_path):
    schema = "paper_id string, updated timestamp, title string"
    rows = [(f"{i % 7}", NOW - timedelta(days=i % 40), f"t{i}") for i in range(60)]
    df = spark.createDataFrame(rows, schema)
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = jobs.ingest_candidates(stream, str(tmp_path / "out"), NOW)
    want = pool.merge_pool(df.limit(0), df, NOW)
    key = lambda d: {(r.paper_id, r.updated) for r in d.collect()}
    assert key(got) == key(want)


def test_streamed_labels_and_bounded_attribution(spark, tmp_path):
    schema = "paper_id string, event_id string, kind string, occurred_at timestamp, label string"
    rows = [("p", "a", "label", NOW, "positive"), ("p", "b", "label", NOW + timedelta(1), "negative"), ("q", "c", "label", NOW, "positive"), ("q", "d", "unlabel", NOW + timedelta(1), None)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = jobs.latest_labels(stream, str(tmp_path / "out"), NOW + timedelta(5))
    assert [(r.paper_id, r.label) for r in got.collect()] == [("p", "negative")]
