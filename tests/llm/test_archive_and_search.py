import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm import archive, search
from folioscope.session import work_dir

from llm_samples import AWKWARD, documents, prose

RECORD = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: {}\r\n\r\n{}\r\n\r\n"
INNER = "HTTP/1.1 200 OK\r\n\r\nfake payload"
FAKE = RECORD.format(len(INNER), INNER)
LONG = "long payload " * 20
HTML = [None, "", "<p>ü 🙂</p>", LONG, LONG, LONG, "short", "short", f"a {FAKE}{FAKE} b", FAKE, FAKE + "x",
        "WARC/1.0\r\n", "WARC/1.0\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\n", "x" * 300_000, "\r\n\r\n", "end WARC/1.0\r",
        "WARC/1.0\r\nContent-Length: 99999999999999999999\r\n\r\n"]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns(
        {"digest": F.lit("x"), "refers_to": F.lit(1), "file": F.lit("y")})


@pytest.mark.parametrize("split", ["128m", "4k", "300b"])
def test_archives_give_back_all_payloads(spark, split):
    rows = [(i, None if i == 2 else f"http://h/{i}\r\nX: y", h) for i, h in enumerate(HTML)]
    folder = work_dir(spark, "test-warc")
    archive.write_archive(pages(spark, rows).repartition(2), folder)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = archive.read_archive(spark, folder).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    by_id = {int(re.search(r"page:(\d+)", r.record_id)[1]): r for r in got}
    assert len(got) == len(HTML) == len(by_id)
    for i, html in enumerate(HTML):
        again = i in (4, 5)
        assert by_id[i].type == ("revisit" if again else "response")
        assert by_id[i].payload == (b"" if again else (html or "").encode())
        assert by_id[i].digest == "sha256:" + hashlib.sha256((html or "").encode()).hexdigest()
        assert by_id[i].refers_to == ("<urn:page:3>" if again else None)


def test_query_on_repeated_missing_and_no_pages(spark, tmp_path):
    rows = [(5, "u", LONG), (3, "u", LONG), (3, "u", LONG), (None, "u", LONG), (9, "u", "s"), (8, None, "s"), (7, "u", FAKE)]
    pages(spark, rows).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((tuple(r) for r in archive.run_query(spark, str(tmp_path)).collect()), key=str)
    size = lambda t: (len(t), hashlib.sha256(t.encode()).hexdigest())
    want = [(5, *size(LONG), "revisit", 3), *[(3, *size(LONG), "response", None)] * 2,
            (None, *size(LONG), "response", None), (9, *size("s"), "response", None),
            (8, *size("s"), "response", None), (7, *size(FAKE), "response", None)]
    assert got == sorted(want, key=str)
    empty = tmp_path / "none"
    pages(spark, rows).limit(0).write.parquet(str(empty / "pages.parquet"))
    assert archive.run_query(spark, str(empty)).count() == 0


def test_a_broken_chain_is_an_error(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(FAKE.replace("Content-Length: ", "Content-Length: 9").encode() * 2)
    with pytest.raises(ValueError, match="1 archives"):
        archive.read_archive(spark, str(tmp_path))


def brute_search(texts, k):
    docs = [Counter(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")))
            for t in texts]
    df = Counter(w for d in docs for w in d)
    mean = sum(sum(d.values()) for d in docs) / len(docs)
    out = {}
    for q in range(0, len(texts), 20):
        hits = []
        for i, d in enumerate(docs):
            same = docs[q].keys() & d.keys()
            if same:
                norm = 1.2 * (0.25 + 0.75 * sum(d.values()) / mean)
                score = sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * d[w] * 2.2 / (d[w] + norm) for w in same)
                hits.append((-round(score, 6), i))
        out[q] = [i for _, i in sorted(hits)[:k]]
    return {q: hits for q, hits in out.items() if hits}


@pytest.mark.parametrize("shard, block, terms", [(10_000, 64, 1_000_000), (40, 4, 60)])
def test_search_equals_brute_force(spark, monkeypatch, shard, block, terms):
    monkeypatch.setattr(search, "QUERY_BLOCK_TERMS", terms)
    texts = prose(5, 240, 80, 400)
    texts[20:20 + len(AWKWARD)] = AWKWARD
    texts += [texts[0]] * 3
    docs = documents(spark, texts, score=1.0, rank=2, query_id=3).repartition(3)
    if shard == 40:
        docs = docs.repartition(6)
        monkeypatch.setattr(search, "BLOCK_DOCUMENTS", block)
    queries = docs.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    got = {}
    for r in search.search(docs, queries, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == brute_search(texts, 5)


def test_search_of_nothing(spark):
    docs = documents(spark, ["a b", None])
    queries = docs.select(F.col("doc_id").alias("query_id"), "text")
    assert search.search(docs.limit(0), queries).count() == 0
    assert search.search(docs, queries.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in search.search(docs, queries.unionAll(queries)).collect()] == [(0, 1, 0)]


@pytest.mark.parametrize("few", [0, 4])
def test_frequent_terms_are_added_up_for_many_queries_at_once(monkeypatch, few):
    monkeypatch.setattr(search, "FEW_POSTINGS", few)
    texts = [f"{t} own{i} pair{i // 2} few{i // 9}" for i, t in enumerate(prose(9, 300, 40, 120))]
    lists = list(search.term_lists(pa.array(texts)))
    (row,) = built(texts)
    shard = search.Shard(row, 50.0)
    queries = [(i, t, np.linspace(0.5, 2.0, len(t))) for i, (t, _, _) in enumerate(lists) if len(t)]
    found = list(shard.search_all(queries, 7))
    assert 0 < len(shard.frequent) < len(shard.terms)
    assert shard.rows.shape == (len(shard.frequent), len(texts))
    assert [q for q, _, _ in found] == [q for q, _, _ in queries]
    for (_, terms, weights), (_, places, scores) in zip(queries, found):
        whole = np.zeros(len(texts))
        for term, weight in zip(terms, weights):
            at = shard.postings(int(np.searchsorted(shard.terms, term)))
            whole[shard.places[at]] += shard.parts[at] * weight
        order = sorted((-round(x, 6), i) for i, x in enumerate(whole) if x > 0)[:7]
        assert [i for _, i in order] == places.tolist()
        assert [-x for x, _ in order] == pytest.approx(scores.tolist(), abs=1e-6)


def two_tongues(count):
    """Texts of two vocabularies in turn, with a few words of both."""
    return [" ".join(f"{'xy'[i % 2]}{w}" for w in t.split()) + f" both{i % 7} own{i // 4}"
            for i, t in enumerate(prose(11, count, 120, 60))]


def test_alike_documents_stand_together(monkeypatch):
    monkeypatch.setattr(search, "GROUP_DOCUMENTS", 20)
    texts = two_tongues(120)
    row = arrays(texts)
    assert np.frombuffer(row["groups"], "<i8").tolist() == [60, 60]
    ids = np.frombuffer(row["ids"], "<i8")
    assert len(set(ids[:60] % 2)) == 1 and sorted(ids) == list(range(120))
    shard = search.Shard(row, 50.0)
    # Rows of frequent terms span the documents of their own group alone.
    assert [rows.shape[1] for _, _, rows in shard.groups] == [60, 60]
    ours, theirs = (set(frequent.tolist()) for frequent, _, _ in shard.groups)
    assert len(ours & theirs) <= 7 < min(len(ours), len(theirs))


@pytest.mark.parametrize("pay", [0, 1e9])
def test_documents_below_the_least_score_leave(monkeypatch, pay):
    monkeypatch.setattr(search, "GROUP_DOCUMENTS", 20)
    monkeypatch.setattr(search, "BOUNDS_PAY", pay)
    monkeypatch.setattr(search, "FEW_POSTINGS", 0)
    texts = two_tongues(120) + ["x own3", "foreign words alone", ""]
    row = arrays(texts)
    shard = search.Shard(row, 50.0)
    lists = [(i, t, np.full(len(t), 1.5)) for i, (t, _, _) in enumerate(search.term_lists(pa.array(texts))) if len(t)]
    whole = {q: list(zip(shard.ids[places].tolist(), scores.tolist())) for q, places, scores in shard.search_all(lists, 8)}
    asked = search.Queries([q for q, _, _ in lists], [len(t) for _, t, _ in lists],
                           np.concatenate([t for _, t, _ in lists]), np.concatenate([w for _, _, w in lists]))
    least = np.array([whole[q][min(2, len(whole[q]) - 1)][1] + (q % 3 == 0) for q in asked.ids.tolist()])
    found = {int(asked.ids[i]): list(zip(shard.ids[places].tolist(), scores.tolist()))
             for i, places, scores in shard.search(asked, 8, least)}
    for q, low in zip(asked.ids.tolist(), least):
        assert [hit for hit in found.get(q, []) if hit[1] >= low] == [hit for hit in whole[q] if hit[1] >= low]
        assert all(score >= low - 1e-3 for _, score in found.get(q, []))


def arrays(texts):
    """A shard of texts, numbered in order, as it is built for the search."""
    lists = list(search.term_lists(pa.array(texts)))
    return search.shard_arrays(
        list(range(len(texts))), [n for _, _, n in lists], [t for t, _, _ in lists], [c for _, c, _ in lists])


def built(texts):
    """A shard of texts, numbered in order, without Spark."""
    lists = list(search.term_lists(pa.array(texts)))
    terms = np.concatenate([t for t, _, _ in lists])
    places = np.repeat(np.arange(len(lists), dtype=np.int32), [len(t) for t, _, _ in lists])
    counts = np.concatenate([c for _, c, _ in lists])
    order = np.argsort(terms, kind="stable")
    names, first = np.unique(terms[order], return_index=True)
    yield {k: v.tobytes() for k, v in {
        "ids": np.arange(len(texts)), "lengths": np.array([n for _, _, n in lists], "<i8"), "terms": names,
        "starts": np.append(first, len(terms)).astype("<i8"), "places": places[order],
        "counts": counts[order].astype("<i4")}.items()}
