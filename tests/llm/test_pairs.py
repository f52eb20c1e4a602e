import itertools
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm import common, decontamination, jaccard
from folioscope.llm.components import components

from llm_samples import AWKWARD, documents, prose


def brute_components(rows):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = []
    for _, text in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        size = min(4, len(words))
        sets.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        same = len(sets[i] & sets[j])
        if rows[i][0] == rows[j][0] and sets[i] and sets[j] or (
            same and 100 * same >= 85 * len(sets[i] | sets[j])):
            root[max(find(i), find(j), key=lambda k: rows[k][0])] = find(j) if rows[find(i)][0] > rows[find(j)][0] else find(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted((doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows))


def near(text, rng, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def sample(seed):
    rng = random.Random(seed)
    base = [t for t in prose(seed, 60, 120) if len(t.split()) > 30]
    shared = " ".join(f"licence{i}" for i in range(40))
    texts = [*base, *[f"{t} {shared}" for t in base[:12]]]
    texts += [near(t, rng, rng.choice((1, 1, 2, 3))) for t in base for _ in range(2)]
    # A chain: each is near the one before it only.
    step = base[0]
    for _ in range(8):
        step = near(step, rng, 1)
        texts.append(step)
    texts += [base[1]] * 15 + [near(base[2], rng, 1) for _ in range(25)] + AWKWARD
    texts += [shared, shared + " more", "one two three", "One TWO three", "one two", "a a a a a a"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(spark, seed):
    texts = sample(seed)
    docs = documents(spark, texts, size=1, digest="x", component="y").repartition(3)
    got = sorted(tuple(r) for r in jaccard.link_documents(docs).collect())
    assert got == brute_components(list(enumerate(texts)))


def test_any_order_of_columns_gives_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "RECURS", 1)
    monkeypatch.setattr(jaccard, "STAR_COLUMNS", 1)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    texts = sample(3)
    got = sorted(tuple(r) for r in jaccard.link_documents(documents(spark, texts)).collect())
    assert got == brute_components(list(enumerate(texts)))


def rows_of_pair_joins(spark, since):
    """Rows that joins on components made, in all executions from number ``since`` on."""
    store = spark._jsparkSession.sharedState().statusStore()
    made, done = 0, store.executionsList()
    for at in range(since, done.size()):
        number = done.apply(at).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if "Join" not in node.name() or "component_a" not in node.desc():
                continue
            for metric in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    made += int(values.apply(metric.accumulatorId()).split()[-1].replace(",", ""))
    return made


def far_copies(seed, rows):
    """Copies of one text with so many edits that hardly any two of them link, a few that share
    edits and do, and near ones."""
    rng = random.Random(seed)
    base = " ".join(f"word{rng.randrange(10**6)}" for _ in range(150))
    texts = [base] + [near(base, rng, rng.choice((3, 4, 4, 5))) for _ in range(rows)]
    texts += [near(t, rng, 1) for t in texts[1:9]] + [near(base, rng, 1) for _ in range(10)]
    rng.shuffle(texts)
    return texts


def test_far_copies_are_not_paired_with_each_other(spark):
    texts = far_copies(5, 160)
    since = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    got = sorted(tuple(r) for r in jaccard.link_documents(documents(spark, texts).repartition(2)).collect())
    assert got == brute_components(list(enumerate(texts)))
    assert len({r[2] for r in got}) > 100
    assert 0 < rows_of_pair_joins(spark, since) < 10 * len(texts)


@pytest.mark.parametrize("n,threshold", [(4, (85, 100)), (2, (60, 100)), (3, (1, 2)), (1, (95, 100))])
def test_links_at_any_threshold(spark, n, threshold):
    part, whole = threshold
    rng = random.Random(n)
    texts = far_copies(n, 25)
    texts = [" ".join(t.split()[: rng.choice((150, 150, 60, 3))]) for t in texts] + sample(4)[:60]
    want = [{tuple(w[i : i + min(n, len(w))]) for i in range(len(w) - min(n, len(w)) + 1)} if w else set()
            for w in (re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) for t in texts)]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if want[i] & want[j] and whole * len(want[i] & want[j]) >= part * len(want[i] | want[j]):
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    found = jaccard.link_documents(documents(spark, texts), n=n, threshold=threshold)
    assert {r[0]: r[2] for r in found.collect()} == dict(enumerate(root))


def test_words_hash_alike_in_slices_of_any_size(monkeypatch):
    column = pa.array(["one two three four five", None, "", "a" * 300 + " b", "ÄÖ x", *prose(6, 5, 30)])
    whole = [x.tolist() for x in jaccard.shingle_sets(column, 2)]
    for size in (1, 7, 50):
        monkeypatch.setattr(common, "HASH_BYTES", size)
        assert [x.tolist() for x in jaccard.shingle_sets(column, 2)] == whole


def test_repeated_and_missing_ids(spark):
    a, b = prose(8, 2, 90)
    rows = [(5, a), (5, a), (6, b), (6, a), (7, b), (None, a), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [tuple(r) for r in jaccard.link_documents(docs).collect()]
    assert len(got) == len(rows)
    assert {r[2] for r in got if r[0] is not None} == {5}
    assert (None, 0, None) in got
    assert jaccard.link_documents(docs.limit(0)).count() == 0


def test_an_id_with_several_texts_among_far_copies(spark):
    texts = far_copies(7, 40)
    rows = [(i if i % 7 else i // 2, t) for i, t in enumerate(texts)] + [(3, texts[20]), (4, None), (5, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(tuple(r) for r in jaccard.link_documents(docs).collect())
    assert got == brute_components(rows)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = dict(tuple(r) for r in components(edges).collect())
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(texts, items, n=10):
    out = []
    for text in texts:
        words, hit, found = words_of(text), set(), set()
        for item, item_text in items:
            other = words_of(item_text)
            size = min(n, len(other))
            windows = {tuple(other[i : i + size]) for i in range(len(other) - size + 1)} if size else set()
            for i in range(len(words) - size + 1 if size else 0):
                if tuple(words[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    found.add(str(item))
        out.append((len(words), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block_bytes", [2_000_000, 300])
def test_contamination_equals_brute_force(spark, block_bytes):
    rng = random.Random(4)
    items = list(enumerate(prose(11, 12, 40))) + [(90, "Short One"), (91, None), (92, ""), (90, "Short One")]
    texts = prose(12, 40) + AWKWARD
    for i in range(0, 40, 3):
        other = items[rng.randrange(12)][1].split()
        start = rng.randrange(max(1, len(other) - 8))
        texts[i] += " ÄÖ, " + "; ".join(other[start : start + 14]).upper() + "! short-one " + texts[i]
    docs = documents(spark, texts, item_id=5, _other="x").repartition(2)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontamination.contamination(docs, bench, block_bytes=block_bytes)
    rows = {r.doc_id: r for r in found.collect()}
    want = brute_hits(texts, items)
    for i, (n, hits, names) in enumerate(want):
        assert (rows[i]._words, sum(s["last"] - s["first"] for s in rows[i]._spans), rows[i]._items) == (n, hits, names)
        for s in rows[i]._spans:
            assert words_of(texts[i][s["from"] : s["to"]]) == words_of(texts[i])[s["first"] : s["last"]]
    cleaned = {r.doc_id: r for r in decontamination.remove_spans(found).collect()}
    for i, text in enumerate(texts):
        assert cleaned[i].n_chars == (None if text is None else len(cleaned[i].text))
        if not want[i][1]:
            assert cleaned[i].text == text
        assert sum(map(len, words_of(cleaned[i].text))) <= sum(map(len, words_of(text)))
    kept = {r.doc_id for r in decontamination.drop_documents(found).collect()}
    assert kept == {i for i, (_, hits, _) in enumerate(want) if not hits}


def test_no_benchmark_no_hits(spark):
    docs = documents(spark, prose(13, 5))
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.drop_documents(decontamination.contamination(docs, bench)).count() == 5
    assert decontamination.contamination(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("block_bytes", [2_000_000, 10])
def test_contamination_stands_beside_columns_of_any_name(spark, block_bytes):
    docs = documents(spark, ["one two three", None, "other words"], _words="w", _spans="s", _ITEMS="i", _0="zero", **{"odd name": 1})
    docs = docs.withColumn("nested", F.struct(F.lit(1).alias("a b")))
    bench = spark.createDataFrame([(1, "two three"), (2, "one two"), (3, "nowhere")], "item_id bigint, text string")
    found = decontamination.contamination(docs, bench, block_bytes=block_bytes)
    assert found.columns == [*docs.columns, "__words", "__spans", "__items"]
    rows = {r.doc_id: r for r in found.collect()}
    assert (rows[0]["__words"], rows[0]["__items"], rows[0]["_words"], rows[0]["_0"]) == (3, ["1", "2"], "w", "zero")
    assert [(s["first"], s["last"]) for s in rows[0]["__spans"]] == [(0, 3)]
    kept = decontamination.drop_documents(found)
    assert kept.columns == docs.columns and {r.doc_id: r["_spans"] for r in kept.collect()} == {1: "s", 2: "s"}
    cut = decontamination.remove_spans(found)
    assert cut.columns == docs.columns and {r.doc_id: r.text for r in cut.collect()} == {0: "", 1: None, 2: "other words"}
