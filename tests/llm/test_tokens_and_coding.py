import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import coding, counting
from folioscope.llm.tokens import encoder, vocabulary_path
from folioscope.session import materialized, work_dir

from llm_samples import AWKWARD, documents, prose

BYTE, WORD = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("word_bpe_49k.json")
PARTS = ["a", "B", " ", "  ", "\n", "\n\n", "the", "Ġ", "é", "naïve", "'s", "12", "\t", "\x1c", "\x85", "!!", "İ",
         "Σ", "_", "²", "\r\n", "don't", "x,", "~"]


@pytest.mark.parametrize("path, drops", [(BYTE, False), (WORD, True)])
def test_pieces_give_the_ids_of_whole_texts(path, drops):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + AWKWARD
    coder = encoder(path, drops)
    for _ in range(2):  # the second time from the cache
        ids, offsets = coder.encode(pa.array(texts))
        want = coder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [e.ids for e in want]


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=70))
@settings(max_examples=100, deadline=None)
def test_control_bytes_round_trip(values):
    ranks = np.array(values, np.uint32)
    control, data = coding.encode_ranks(ranks)
    assert len(control) == -(-len(values) // 4)
    back = coding.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(values))
    assert back.tolist() == values


def expected(rows, end):
    """(doc_id, start, n_tokens, crc) of documents in order of id, then text."""
    coder, at, out = encoder(BYTE, False).tokenizer, 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "")):
        ids = coder.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def written(spark, docs, **options):
    folder = work_dir(spark, "test-shards")
    coding.write_tokens(docs, folder, BYTE, **options)
    read = materialized(coding.read_tokens(spark, folder), "test-read")
    rows = coding.with_starts(read).select("doc_id", "start", "n_tokens", "ids_crc32", "ids").collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    return sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows)


@pytest.mark.parametrize("shard_ids", [50, 1_000_000])
def test_shards_give_back_all_documents(spark, shard_ids):
    texts = [*prose(1, 40), *AWKWARD, "same", "same"]
    random.Random(5).shuffle(texts)
    docs = documents(spark, texts, shard="x", ids=1).repartition(3)
    assert written(spark, docs, shard_ids=shard_ids) == sorted(expected(list(enumerate(texts)), 0))


def test_repeated_ids_and_empty_tables(spark):
    rows = [(7, "b"), (7, "a"), (7, "a"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert written(spark, docs, shard_ids=2) == sorted(expected(rows, 0))
    assert written(spark, docs.limit(0)) == []
    with pytest.raises(Exception, match="no id"):
        written(spark, spark.createDataFrame([(None, "x")], "doc_id bigint, text string"))


@pytest.mark.parametrize("file_ids", [7, 1_000_000])
def test_separators_stitch_documents_across_files(spark, file_ids):
    texts = [*prose(2, 50), *AWKWARD]
    path = work_dir(spark, "test-docs")
    documents(spark, texts, part="x").repartition(3).write.parquet(path)
    docs, folder = counting.scanned(spark, path), work_dir(spark, "test-flat")
    counting.write_flat(docs, folder, BYTE, file_ids=file_ids)
    files = materialized(counting.scan_files(spark, folder), "test-files")
    sizes = counting.document_sizes(files).collect()
    coder = encoder(BYTE, False).tokenizer
    want = sorted(len(coder.encode(t or "", add_special_tokens=False).ids) for t in texts)
    assert sorted(r.n_tokens for r in sizes) == want
    if file_ids == 7:
        assert files.count() > len(texts)


def test_token_counts_find_their_documents(spark, tmp_path):
    texts = [*prose(4, 30), *AWKWARD]
    documents(spark, texts).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.n_tokens for r in counting.run_query(spark, str(tmp_path)).collect()}
    coder = encoder(BYTE, False).tokenizer
    assert got == {i: len(coder.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_no_rows_no_files(spark, tmp_path):
    documents(spark, ["x"]).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert counting.run_query(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("drops", [True, False])
def test_bounded_caches_give_the_same_ids(drops):
    path = vocabulary_path("word_bpe_49k.json") if drops else BYTE
    texts = pa.array([*prose(3, 30, 20, 60), *AWKWARD])
    wide, tight = encoder(path, drops), encoder(path, drops, 8)
    for _ in range(2):
        for a, b in zip(wide.encode(texts), tight.encode(texts)):
            assert a.tolist() == b.tolist()
        for cache in (tight.cache, tight.old_cache, tight.runs, tight.old_runs):
            assert 0 < len(cache) <= 4
        tight.forget()
        assert not (tight.cache or tight.old_cache or tight.runs or tight.old_runs)
