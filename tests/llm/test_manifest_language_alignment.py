"""Merkle manifest, language identification and cross-tokenizer alignment against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import alignment, language, merkle
from folioscope.llm.tokens import vocabulary_path
from llm_samples import AWKWARD, documents, prose

DATA = "/root/testdata/sf0.001"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(digests):
    """Root, and for each leaf its siblings (left, right) per level."""
    steps = [[] for _ in digests]
    nodes = [(d, [i]) for i, d in enumerate(digests)]
    while len(nodes) > 1:
        parents = []
        for at in range(0, len(nodes), merkle.FAN):
            run = nodes[at : at + merkle.FAN]
            for k, (_, members) in enumerate(run):
                for m in members:
                    steps[m].append(("".join(d for d, _ in run[:k]), "".join(d for d, _ in run[k + 1 :])))
            parents.append((sha(*[d for d, _ in run]), [m for _, ms in run for m in ms]))
        nodes = parents
    return nodes[0][0], steps


def brute_manifest(rows):
    """``{(group, id, leaf): (subroot, root, steps)}`` of rows ``(id, group, leaf)``."""
    groups = {}
    for i, g, d in rows:
        groups.setdefault(g, []).append((i is not None, i or 0, d, i))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([d for _, _, d, _ in sorted(groups[g])]) for g in names}
    root, above = brute_tree([trees[g][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for (_, _, d, i), steps in zip(sorted(groups[g]), trees[g][1]):
            out.append((i, g, d, trees[g][0], root, steps + above[k]))
    return out


def same_rows(got, want):
    key = lambda r: repr(r)
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("levels", [2, 7])
def test_trees_of_groups_of_any_size(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rng = random.Random(levels)
    rows = [(i, "hot", sha(str(i))) for i in rng.sample(range(1000), 121)]
    rows += [(i, g, sha(g, str(i))) for g, n in [("a", 1), ("b", 2), ("é", 3), ("Z", 4), ("", 9), ("c", 10)] for i in range(n)]
    rows += [(None, "b", sha("x")), (None, "b", sha("x")), (7, None, sha("n")), (0, "c", sha("c0"))]
    table = spark.createDataFrame(rows, "id bigint, group string, leaf string").repartition(3)
    got = merkle.manifest(table).collect()
    same_rows([(r.id, r.group, r.leaf, r.subroot, r.root, [tuple(s) for s in r.steps]) for r in got], brute_manifest(rows))


def test_one_group_one_row_and_none(spark):
    schema = "id bigint, group string, leaf string"
    one = merkle.manifest(spark.createDataFrame([(1, None, "ab")], schema)).collect()
    assert [(r.subroot, r.root, r.steps) for r in one] == [("ab", "ab", [])]
    assert merkle.manifest(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(spark.createDataFrame([(1, "a", "ab")], "id bigint, root string, leaf string"), "root")


def test_manifest_query_finds_tampering(spark, tmp_path):
    texts = AWKWARD + ["one\ntwo"] * 8 + ["plain"]
    docs = documents(spark, texts, first=10, position=3, root="x")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 > 0, "src1")).withColumn(
        "lang", F.when(F.col("doc_id") % 5 > 0, F.col("lang")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows, leaves, changed = docs.collect(), [], {}
    mark = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    for r in rows:
        head = [mark(v) for v in (r.doc_id, r.source, r.lang, r.n_chars)]
        leaves.append((r.doc_id, r.source, sha(*head, mark(r.text))))
        odd = r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
        changed[r.doc_id] = sha(*head, mark(r.text.replace("\n", "") if odd else r.text))
    got = {r.doc_id: r for r in merkle.run_query(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, _, leaf, subroot, root, steps in brute_manifest(leaves):
        folded = changed[i]
        for left, right in steps:
            folded = sha(left, folded, right)
        r = got[i]
        assert (r.leaf, r.subroot, r.root, r.folded_root) == (leaf, subroot, root, folded)
        assert r.proof_sha256 == sha(*[x for s in steps for x in s])
        assert r.verified == (changed[i] == leaf)
    assert {r.verified for r in got.values()} == {True, False}


def brute_alignment(texts):
    """Contract rows without ids, by whole texts and plain loops."""
    coder = alignment.encoder(*map(vocabulary_path, (alignment.VOCABULARY_A, alignment.VOCABULARY_B)))
    aligned, counts = [], Counter()
    for text in texts:
        links, groups, a, b = [], [], [], []
        if text:
            a, b = coder.a.encode(" " + text, add_special_tokens=False).ids, coder.b.encode(text)
            raw = (" " + text).encode()
            if not b"".join(coder.bytes_a[i] for i in a) == raw == b"".join(coder.bytes_b[i] for i in b):
                a, b = [], []
            ends = [np.cumsum([len(t[i]) for i in x]).tolist() for x, t in ((a, coder.bytes_a), (b, coder.bytes_b))]
            links = [(i, j) for i, e in zip(a, ends[0]) for j, f in ((b[ends[1].index(e)], e),) if f == e] \
                if set(ends[0]) <= set(ends[1]) else [
                    (a[ends[0].index(e)], b[ends[1].index(e)]) for e in sorted(set(ends[0]) & set(ends[1]))]
            start = (0, 0)
            for e in sorted(set(ends[0]) & set(ends[1])):
                stop = ends[0].index(e) + 1, ends[1].index(e) + 1
                groups.append(",".join(map(str, a[start[0]:stop[0]])) + "|" + ",".join(map(str, b[start[1]:stop[1]])))
                start = stop
        counts.update(links)
        aligned.append((len(a), len(b), links, ";".join(groups)))
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [(na, nb, len(links), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links),
             sha(shown) if links else "", shown) for na, nb, links, shown in aligned]


STRANGE = AWKWARD + [
    " lead", "trail ", "a\n\nb", "a\n b", "a \nb", "\nfirst", "last\n", "tab\tin it", "nul\0in", "▁mark", "a▁b", "<s> </s> <unk>x",
    "<0x41>", "it's they'll 'tis", "x…y “z” – ok", "naïve Ærø ÷×", "1234567 12 345", "a\r\nb", "no\xa0break", "é é ﬁ",
    "日本語 text と", "word\n" * 40, "the the the of the", "the the the of the", "<|endoftext|>", "a  b   c", "﻿bom", "​zero",
]


def test_alignment_equals_whole_texts(spark):
    texts = STRANGE + prose(3, 60) + [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(40).collect()]
    docs = documents(spark, texts, ids=1, n_a="x", pairs=2).repartition(5)
    paths = [*map(vocabulary_path, (alignment.VOCABULARY_A, alignment.VOCABULARY_B))]
    runs = alignment.write_runs(docs, *paths)
    got = {r.id: tuple(r)[1:] for r in alignment.contributions(runs, alignment.pair_counts(runs)).collect()}
    shown = {r.id: r.groups for r in alignment.token_groups(docs, *paths).collect()}
    want = brute_alignment(texts)
    assert len(got) == len(texts)
    for i, (*row, groups) in enumerate(want):
        assert got[i] == tuple(row), texts[i]
        assert shown[i] == groups


def test_alignment_counts_over_many_runs_and_chunks(spark, monkeypatch):
    texts = prose(5, 200, vocabulary=40) + ["the same row"] * 50
    docs = documents(spark, texts).repartition(3)
    paths = [*map(vocabulary_path, (alignment.VOCABULARY_A, alignment.VOCABULARY_B))]
    whole = alignment.write_runs(docs, *paths)
    monkeypatch.setattr(alignment, "RUN_LINKS", 300)
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 500)
    monkeypatch.setattr(alignment, "CACHE_UNITS", 30)
    cut = alignment.write_runs(docs, *paths)
    assert cut.count() > 10 * whole.count() / 3
    rows = [sorted(map(tuple, alignment.contributions(r, alignment.pair_counts(r)).collect())) for r in (whole, cut)]
    assert rows[0] == rows[1]
    for i, (*row, _) in enumerate(brute_alignment(texts)):
        assert rows[1][i] == (i, *row)


def test_alignment_of_nothing(spark):
    paths = [*map(vocabulary_path, (alignment.VOCABULARY_A, alignment.VOCABULARY_B))]
    for texts, want in (([], 0), ([None, ""], 2)):
        runs = alignment.write_runs(documents(spark, texts), *paths)
        got = alignment.contributions(runs, alignment.pair_counts(runs)).collect()
        assert [tuple(r)[1:] for r in got] == [(0, 0, 0, 0, 0, 0, "")] * want


def test_languages_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.run_query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and len(held) > 200
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(r.lang_pred in ("en", "de", "fr", "es", "und") and 0 <= r.score <= 1 for r in rows)


def test_vectors_equal_plain_counts():
    text = language.letters(language.pa.array(["Äb  c9Äb"]))[0].as_py()
    assert text == " äb c äb "
    counts = language.frequencies(text)
    grams = Counter(text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1))
    del grams[" "]
    assert counts.sum() == sum(grams.values())
    assert sorted(counts[counts > 0]) == sorted(grams.values())
    long = " " + " ".join(prose(1, 300)) + " "
    whole = language.frequencies(long)
    small, language.BLOCK = language.BLOCK, 100
    assert (language.frequencies(long) == whole).all()
    language.BLOCK = small


def test_language_of_awkward_rows(spark):
    learnt = spark.createDataFrame(
        [(i, t, lang) for i, (t, lang) in enumerate(
            [(x, "aa") for x in ["kato miro", "kato kato miro", "miro"] * 9]
            + [(x, "bb") for x in ["xyz wuv", "wuv wuv", "xyz"] * 9] + [("kato", None), ("123", "cc"), (None, "dd")])],
        "doc_id bigint, text string, lang string")
    model = language.fit(language.learnable(learnt))
    assert set(model.names) == {"aa", "bb"}
    texts = [None, "", "12 34 !", "Kato MIRO", "wuv", "日本", "x" * 100_000 + " xyz wuv" * 30_000]
    odd = documents(spark, texts, nearest=1, id=2, language="q", score=0.5)
    got = {r.id: r for r in language.identify(odd, model).collect()}
    assert [got[i].nearest for i in range(5)] == ["und", "und", "und", "aa", "bb"]
    assert got[5].nearest in ("aa", "bb") and got[5].rejected and got[5].language == "und"
    assert got[6].nearest == "bb" and [got[i].score for i in range(3)] == [0, 0, 0]
    none = language.fit(language.learnable(learnt.filter("doc_id < 0")))
    assert {(r.nearest, r.score) for r in language.identify(odd, none).collect()} == {("und", 0.0)}
