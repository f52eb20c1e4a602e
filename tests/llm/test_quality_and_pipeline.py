import math
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioscope.llm import jaccard, packing, personal, quality
from folioscope.llm.quality import Bound, paths

from llm_samples import AWKWARD, documents, prose
from test_pairs import brute_hits

DATA = "/root/testdata/sf0.01"


def test_paths_of_a_forest():
    description = """RandomForestClassificationModel: uid=x, numTrees=2
  Tree 0 (weight 1.0):
    If (feature 0 <= 2.5)
     If (feature 1 <= -1.0E-3)
      Predict: 0.0
     Else (feature 1 > -1.0E-3)
      Predict: 1.0
    Else (feature 0 > 2.5)
     If (feature 0 <= 7.0)
      Predict: 0.0
     Else (feature 0 > 7.0)
      Predict: 1.0
  Tree 1 (weight 1.0):
    Predict: 1.0"""
    low, high = Bound("a", True, 2.5), Bound("a", False, 2.5)
    assert paths(description, ("a", "b")) == {
        (low,), (low, Bound("b", True, -0.001)), (low, Bound("b", False, -0.001)), (high,),
        (high, Bound("a", True, 7.0)), (Bound("a", False, 7.0),)}


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    return quality.fit(quality.labelled(docs, labels))


def test_held_out_documents_are_told_apart(spark, model):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, model).join(labels, "doc_id").filter(
        quality.held_out(F.col("doc_id"))).select("predicted", "quality").collect()
    assert len(rows) > 50
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert 0 < len(model.rules) < 300


def test_the_sample_leaves_out_the_fold_and_doubtful_labels(spark):
    docs = documents(spark, ["t"] * 40)
    labels = spark.createDataFrame(
        [(i, 1) for i in range(40)] + [(0, 1), (1, 0), (None, 1), (2, None)], "doc_id bigint, quality int")
    fold = {r.doc_id for r in docs.filter(quality.held_out(F.col("doc_id"))).collect()}
    assert quality.labelled(docs, labels).count() == 40 - len(fold | {1})
    assert quality.labelled(docs, labels, rows=5).count() == 5


def test_awkward_texts_have_scores(spark, model):
    docs = documents(spark, AWKWARD, probability=1, features="x")
    rows = quality.classify(docs, model).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= 0.7) for r in rows)
    assert rows[0].score == rows[1].score
    assert quality.classify(docs.limit(0), model).count() == 0
    with pytest.raises(ValueError, match="upper"):
        quality.classify(documents(spark, ["x"], upper=1), model)


def test_scores_stand_beside_columns_of_any_name(spark, model):
    docs = documents(spark, ["x y", None], score="mine", predicted="yours", **{"odd name": 1})
    docs = docs.withColumn("nested", F.struct(F.lit(1).alias("a b")))
    found = quality.classify(docs, model)
    assert found.columns == [*docs.columns, "_score", "_predicted"]
    assert all((r.score, r.predicted) == ("mine", "yours") and 0 <= r["_score"] <= 1 for r in found.collect())
    assert {r["_score"] for r in found.collect()} == {r.score for r in quality.classify(docs.drop("score"), model).collect()}
    with pytest.raises(ValueError, match="digits"):
        quality.classify(documents(spark, ["x"], Digits=1), model)


def test_the_compiled_score_equals_its_rules_row_by_row(spark, model):
    texts = [*AWKWARD, *prose(31, 30), "THE CAT; 12 34.\n" * 9]
    rows = quality.classify(quality.with_statistics(documents(spark, texts)).select(
        "doc_id", "text", F.struct(*quality.NAMES).alias("seen")), model).collect()
    assert model.rules and len(rows) == len(texts)
    for r in rows:
        total = model.intercept + sum(w * r.seen[n] for n, w in model.linear)
        for rule, weight in model.rules:
            if all(r.seen[b.name] <= b.value if b.at_most else r.seen[b.name] > b.value for b in rule):
                total += weight
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)


@pytest.mark.parametrize("text", ["", "a", "One two two.\nA1;  b?\n", "ÄÖ 12 ,x", "\n\n"])
def test_statistics_equal_plain_python(spark, text):
    seen = quality.with_statistics(documents(spark, [text])).first()
    words, lines = text.split(), text.split("\n")
    chars, count = max(1, len(text)), max(1, len(words))
    assert seen.log_chars == pytest.approx(math.log1p(len(text)))
    assert seen.log_words == pytest.approx(math.log1p(len(words)))
    assert seen.word_length == pytest.approx(sum(map(len, words)) / count)
    assert seen.words_per_line == pytest.approx(len(words) / len(lines))
    assert seen.distinct_words == pytest.approx(len(set(words)) / count)
    assert seen.distinct_lines == pytest.approx(len(set(lines)) / len(lines))
    assert seen.short_words == pytest.approx(sum(len(w) <= 3 for w in words) / count)
    assert seen.upper == pytest.approx(sum("A" <= c <= "Z" for c in text) / chars)
    assert seen.digits == pytest.approx(sum("0" <= c <= "9" for c in text) / chars)
    assert seen.stops == pytest.approx(sum(c in ".,;:?" for c in text) / chars)


@pytest.mark.parametrize("labels, share", [([], 0.5), ([(0, 1), (1, 1), (3, 1)], 0.99)])
def test_no_labels_to_tell_apart_give_a_constant(spark, labels, share):
    docs = documents(spark, ["a b", "c", "d", "e"])
    table = spark.createDataFrame(labels, "doc_id bigint, quality int")
    fitted = quality.fit(quality.labelled(docs, table))
    assert {round(r.score, 6) for r in quality.classify(docs, fitted).collect()} == {share}


def check_packing(rows, capacity=4096):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def best_fit_decreasing(lengths, capacity):
    from bisect import bisect_left, insort

    gaps, bins = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect_left(gaps, length)
        left = gaps.pop(at) - length if at < len(gaps) else capacity - length
        bins += at == len(gaps) + 1 or False
        insort(gaps, left)
    return len(gaps)


@pytest.mark.parametrize("seed, capacity", [(1, 64), (2, 4096), (3, 1)])
def test_packing_is_as_tight_as_best_fit_decreasing(spark, seed, capacity):
    rng = random.Random(seed)
    lengths = [min(capacity, max(1, int(rng.paretovariate(0.9)))) for _ in range(800)] + [max(1, capacity // 3)] * 400
    rows = [(i, 0, 0, n, 0) for i, n in enumerate(lengths)]
    pieces = spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    packed = packing.pack(pieces, capacity).collect()
    assert sorted(r.doc_id for r in packed) == list(range(len(lengths)))
    assert check_packing(packed, capacity) <= best_fit_decreasing(lengths, capacity) * 1.01 + 1


def test_pieces_and_sequences_hold_all_tokens(spark):
    texts = [*AWKWARD, *prose(3, 20), *prose(4, 2, 3000), "same", "same"]
    path = packing.vocabulary_path(packing.VOCABULARY)
    docs = documents(spark, texts, length=1, ids="x").repartition(2)
    pieces = packing.materialized(packing.token_pieces(docs, path, capacity=128, with_ids=True), "test-pieces")
    packed = packing.pack(pieces, 128)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    rows = packed.collect()
    check_packing(rows, 128)
    for i, text in enumerate(texts):
        mine = sorted((r.piece, r.start, list(r.ids)) for r in rows if r.doc_id == i)
        assert [x for _, _, ids in mine for x in ids] == tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert all(len(ids) == 128 for _, _, ids in mine[:-1])
    whole = {r.sequence_id: list(r.ids) for r in packing.sequences(packed).collect()}
    for r in rows:
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == list(r.ids)
    assert packing.pack(packing.materialized(packing.token_pieces(docs.limit(0), path), "none")).count() == 0


def brute_kept(rows, n=5, part=80, whole=100):
    """Ids that are the smallest of their group, by comparing all pairs of (id, text). Words as the
    operator takes them: A-Z in lower case, cut at ASCII white space."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append({tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and whole * same >= part * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min(doc for (doc, _), h in zip(rows, group) if h == g) for g in set(group)}
    return set(least.values())


def test_near_copies_of_the_pipeline(spark):
    rng = random.Random(7)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    base, other = words(1000), words(1000)
    edited = list(base)
    for i in range(20, 1000, 47):  # 21 words
        edited[i] = "edit"
    more, less = [*base, *words(200)], [*other, *words(270)]
    texts = [" ".join(t) for t in (base, more, edited, other, less)]
    docs = documents(spark, [*texts, *prose(5, 20)])
    kept = {r.doc_id for r in corpus_pipeline.duplicate_stage(spark, docs, DATA).collect()}
    assert kept == brute_kept([(r.doc_id, r.text) for r in docs.collect()])
    assert {0, 3, 4} <= kept and not {1, 2} & kept


def test_one_row_of_each_group_stays(spark):
    one, two, three, four = [" ".join(prose(seed, 20, 60, 3000)) for seed in range(11, 15)]
    rows = [
        (5, one), (5, one), (9, one), (None, one), (None, one + " more"),  # repeats of the least id, none
        (None, two), (None, two), (None, two + " more"),  # no row has an id
        (7, three), (7, four), (8, four),  # an id with unlike texts
        (None, None), (3, None), (3, ""), (4, "\n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.duplicate_stage(spark, docs, DATA).collect()]
    words = sorted([(d, t.removesuffix(" more")) for d, t in kept if (t or "").strip()], key=str)
    assert words == sorted([(5, one), (None, two), (7, three), (7, four)], key=str)
    assert sorted([x for x in kept if not (x[1] or "").strip()], key=str) == sorted(rows[-4:], key=str)


def test_names_of_the_duplicate_stage_are_free(spark):
    docs = documents(spark, ["one two three four five six", "one two three four five six", "other"], _row=7, row=8,
                     component_id="x", **{"odd name": 1})
    kept = corpus_pipeline.duplicate_stage(spark, docs, DATA)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r["_row"], r["row"], r["component_id"]) for r in kept.collect()) == [(0, 7, 8, "x"), (2, 7, 8, "x")]


def test_stages_filter_by_their_own_columns(spark, monkeypatch):
    monkeypatch.setattr(quality, "labelled", lambda docs, labels: None)
    docs = documents(spark, ["mail a.b@example.org", "two"], predicted=0, score=5, _spans="s", **{"odd.name": 1})
    for value, count in ((3.0, 2), (-3.0, 0)):
        monkeypatch.setattr(quality, "fit", lambda sample: quality.Ensemble(value))
        kept = corpus_pipeline.quality_stage(spark, docs, "/root/testdata/sf0.001")
        assert kept.columns == docs.columns and kept.count() == count
    for stage in (corpus_pipeline.decontamination_stage, corpus_pipeline.personal_stage):
        after = stage(spark, docs, "/root/testdata/sf0.001")
        assert after.columns == docs.columns
        assert {(r.doc_id, r.predicted, r["_spans"], r["odd.name"]) for r in after.collect()} == {(0, 0, "s", 1), (1, 0, "s", 1)}


def test_stages_of_the_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    state = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = state
        state = packing.materialized(stage(spark, before, DATA), name)
        kept[name] = (before, state)
        if name != "best_fit_packing":
            assert state.schema == docs.schema
    before, after = (df.collect() for df in kept["ngram_jaccard_join"])
    assert {r.doc_id for r in after} == brute_kept([(r.doc_id, r.text) for r in before])
    before, after = (df.collect() for df in kept["benchmark_decontamination"])
    hits = brute_hits([r.text for r in before], bench)
    assert {r.doc_id for r in after} == {r.doc_id for r, (_, n, _) in zip(before, hits) if not n}
    before, after = (df.collect() for df in kept["personal_data"])
    assert {r.doc_id for r in before} == {r.doc_id for r in after}
    assert not any(personal.base_spans(r.text) for r in after if r.text)
    before, after = (df.collect() for df in kept["best_fit_packing"])
    assert {r.doc_id for r in before} == {r.doc_id for r in after}
    check_packing(after)
    assert jaccard.NAME and corpus_pipeline.ORACLE_SQL is None


def test_stages_bound_batches_in_any_session(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = documents(spark, ["a few words of a text", None])
    before = spark.conf.get(name)
    try:
        for stage, work in corpus_pipeline.STAGES[2:]:
            spark.conf.set(name, "64m")
            work(spark, docs, DATA)
            assert spark.conf.get(name) == corpus_pipeline.STAGE_BATCH, stage
    finally:
        spark.conf.set(name, before)
