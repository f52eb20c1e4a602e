"""Cross-tokenizer alignment by external spill counting.

Two tokenizers cut the same bytes. A link is a token of each that end at the same byte; a group
lies between two neighbouring such ends. How often two ids are linked is counted over the whole
corpus outside memory:

* tasks encode texts and spill records (pair, document, times) as zstd runs, sorted with ids of
  tokenizer B as the major key and cut by ``DIGITS`` low bits of that id (``write_runs``);
* the key sections of a digit's runs meet in chunks of bounded size, where a k-way heap merge adds
  up each pair; sums of chunks are added and, B id by B id, give the highest count
  (``pair_counts``);
* runs are streamed once more against the totals, and each document receives what its own links
  are worth (``contributions``). A document's records lie in one run, so nothing is shuffled.

The table of totals is the only thing sent to all tasks. Two linked tokens end together, so the
bytes of one are a suffix of the other's: there are at most as many different pairs as both
vocabularies have bytes, about 600,000 for the default files, whatever the corpus is.

Null and empty texts, and texts that a tokenizer does not give back byte by byte, have no tokens.
Rows that repeat an id or a text each give a row, and each counts. An empty table gives no rows.
Only the id and the text are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
from array import array
from collections.abc import Iterator
from heapq import merge
from itertools import accumulate, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import chunks, table
from folioscope.llm.tokens import _SHOWN, vocabulary_path
from folioscope.session import materialized

NAME = "op13_cross_tokenizer_alignment"
VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Low bits of the B id by which runs are cut.
DIGITS = 3
#: Links after which a task spills a run; a longer document is a run alone.
RUN_LINKS = 2_000_000
#: Compressed bytes of key sections that one merge takes.
CHUNK_BYTES = 64_000_000
#: Units and their ids that a worker keeps; both are emptied beyond it.
CACHE_UNITS, CACHE_IDS = 600_000, 8_000_000
#: Texts whose new units are learnt together come to about so many characters.
BATCH_CHARS = 1_000_000

#: No token of either vocabulary reaches over the front of one space or line end between these.
_SURE = "[!-~À-ɏ]"
_CUT = re.compile(f"(?<={_SURE})(?=[ \n]{_SURE})")
_ODD = re.compile(r"[ \n][ \n]|[^ -~\nÀ-ɏ]|\A[ \n]|[ \n]\Z")


def _units(text: str) -> list[str]:
    """A space and the text, cut where neither tokenizer can join; each starts with a space or line end."""
    if _ODD.search(text):
        return _CUT.split(" " + text)
    return [u if u[0] == "\n" else " " + u for u in text.replace("\n", " \n").split(" ")]


class PairEncoder:
    """Encodes units of text with both tokenizers and keeps how their tokens line up."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        plain = {shown: byte for byte, shown in enumerate(_SHOWN)}
        names = sorted(self.a.get_vocab().items(), key=itemgetter(1))
        self.bytes_a = {i: bytes(map(plain.__getitem__, name)) for name, i in names if plain.keys() >= set(name)}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)]
        if max(len(names), names[-1][1] + 1, len(pieces)) > 1 << 16:
            raise ValueError("ids of both vocabularies must fit 16 bits")
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError("pieces that reach over a space or line end are not supported")
        self.space = self.b.piece_to_id("▁")
        self.size_a = {i: len(raw) for i, raw in self.bytes_a.items()}
        self.size_b = [len(raw) for raw in self.bytes_b]
        # A sign is a token of its own behind letters that it shares no piece with.
        vocabulary = dict(names)
        self.signs = {
            sign: (vocabulary[sign], self.b.piece_to_id(sign)) for sign in ".,;:?!"
            if sign in vocabulary and sign in pieces}
        self.joined = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.shown: list[str] = []  # groups as text
        self.n_a: list[int] = []
        self.n_b: list[int] = []
        self.keys: list[bytes] = []  # of links, four bytes each
        self.changed: set[int] = set()  # units that do not come back byte by byte
        self.held = 0

    def learn(self, units: set[str]) -> None:
        """Encode units that are not kept yet."""
        signs, joined, at = self.signs, self.joined, self.at
        ended = [u for u in units if u[-1] in signs and u[-2:-1].isalpha() and u[-2:] not in joined]
        plain = units.difference(ended)
        plain.update(v for v in {u[:-1] for u in ended} if v not in at)
        if plain:
            names = sorted(plain)
            coded = self.a.encode_batch_fast(names, add_special_tokens=False)
            # The library puts a space in front of what it gets: a unit's own, or one to take off again.
            pieces = self.b.encode([u[1:] if u[0] == " " else u for u in names], num_threads=1)
            for unit, a, b in zip(names, coded, pieces):
                if unit[0] != " ":
                    if b[:1] != [self.space]:
                        raise ValueError(f"no separate space before {unit[:20]!r}")
                    b = b[1:]
                self._add(unit, a.ids, b)
        for unit in ended:
            word, (a, b) = at[unit[:-1]], signs[unit[-1]]
            if word in self.changed:
                self.changed.add(len(self.shown))
            at[unit] = len(self.shown)
            self.shown.append(f"{self.shown[word]};{a}|{b}")
            self.n_a.append(self.n_a[word] + 1)
            self.n_b.append(self.n_b[word] + 1)
            self.keys.append(self.keys[word] + pair_key(a, b).to_bytes(4, sys.byteorder))
            self.held += self.n_a[-1]

    def _add(self, unit: str, a: list[int], b: list[int]) -> None:
        raw, groups, links, first_a, first_b = unit.encode(), [], array("I"), 0, 0
        if b"".join([self.bytes_a[i] for i in a]) == raw == b"".join([self.bytes_b[i] for i in b]):
            ends_b = {end: j for j, end in enumerate(accumulate([self.size_b[i] for i in b]), 1)}
            for i, end in enumerate(accumulate([self.size_a[i] for i in a]), 1):
                j = ends_b.get(end)
                if j is not None:
                    groups.append(f"{','.join(map(str, a[first_a:i]))}|{','.join(map(str, b[first_b:j]))}")
                    links.append(pair_key(a[i - 1], b[j - 1]))
                    first_a, first_b = i, j
        else:
            self.changed.add(len(self.shown))
        self.at[unit] = len(self.shown)
        self.shown.append(";".join(groups))
        self.n_a.append(len(a))
        self.n_b.append(len(b))
        self.keys.append(links.tobytes())
        self.held += len(a)

    def texts(self, column: pa.Array) -> Iterator[list[int] | None]:
        """For each text the places of its units, or None where it has no tokens. Places hold until
        the next text is asked for."""
        texts = column.to_pylist()
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and size < BATCH_CHARS:
                size += len(texts[stop] or "")
                stop += 1
            units = [_units(t) if t else None for t in texts[start:stop]]
            new = {u for own in units if own for u in own}
            if len(self.at) + len(new) > CACHE_UNITS or self.held > CACHE_IDS:
                self.clear()
            new.difference_update(self.at)
            if new:
                self.learn(new)
            for own in units:
                places = list(map(self.at.__getitem__, own)) if own else None
                yield None if places is None or not self.changed.isdisjoint(places) else places
            start = stop


_ENCODERS: dict[tuple[str, str], PairEncoder] = {}


def encoder(path_a: str, path_b: str) -> PairEncoder:
    """This worker's encoder of two tokenizer files."""
    if (path_a, path_b) not in _ENCODERS:
        _ENCODERS[path_a, path_b] = PairEncoder(path_a, path_b)
    return _ENCODERS[path_a, path_b]


def pair_key(a: int, b: int) -> int:
    """32 bits: low digits of the B id, the rest of it, then the A id."""
    return ((b & ((1 << DIGITS) - 1)) << (32 - DIGITS)) | ((b >> DIGITS) << 16) | a


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values).tobytes())


def _unpacked(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _run_schema(id_type: T.DataType) -> T.StructType:
    longs, binaries = T.ArrayType(T.LongType()), T.ArrayType(T.BinaryType())
    return T.StructType([
        T.StructField("ids", T.ArrayType(id_type)), T.StructField("n_a", longs), T.StructField("n_b", longs),
        T.StructField("n_links", longs), T.StructField("digests", T.ArrayType(T.StringType())),
        T.StructField("pairs", binaries), T.StructField("links", binaries),
        T.StructField("records", binaries)])


def write_runs(
    docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode all texts and spill sorted runs; returns the written table, a row per run.

    A run holds its documents (ids, token counts, digests of their groups), the key sections
    ``pairs`` and ``links`` of each digit, and the records behind them: documents per pair, their
    places in the run, and times linked.
    """
    read = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = _run_schema(read.schema["id"].dataType)
    arrow = pa.schema([
        ("ids", pa.list_(_arrow_type(read))), *[(n, pa.list_(pa.int64())) for n in ("n_a", "n_b", "n_links")],
        ("digests", pa.list_(pa.string())),
        *[(n, pa.list_(pa.binary())) for n in ("pairs", "links", "records")]])

    def run(batches):
        coder = encoder(path_a, path_b)
        held: list[tuple] = []
        keys: list[np.ndarray] = []
        size = 0
        for part in chunks(batches, "text"):
            ids = part.column(0).to_pylist()
            for doc, units in zip(ids, coder.texts(part.column(1))):
                if units is None:
                    held.append((doc, 0, 0, 0, ""))
                    continue
                pick = itemgetter(*units, units[0])  # one more, so that it is always a tuple
                digest = hashlib.sha256(";".join(pick(coder.shown)[:-1]).encode()).hexdigest()
                linked = np.frombuffer(b"".join(pick(coder.keys)[:-1]), np.uint32)
                keys.append(linked.astype(np.uint64) << np.uint64(32) | np.uint64(len(held)))
                held.append((doc, sum(pick(coder.n_a)[:-1]), sum(pick(coder.n_b)[:-1]), len(linked), digest))
                size += len(linked)
                if size >= RUN_LINKS:
                    yield _spilled(held, keys, arrow)
                    held, keys, size = [], [], 0
            if len(held) >= RUN_LINKS:
                yield _spilled(held, keys, arrow)
                held, keys, size = [], [], 0
        if held:
            yield _spilled(held, keys, arrow)

    return materialized(read.mapInArrow(run, schema), "alignment-runs")


def _arrow_type(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["id"].dataType)


def _spilled(held: list[tuple], keys: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    """One run: records sorted by pair and document, key sections cut by digit."""
    records, times = np.unique(np.concatenate(keys) if keys else np.empty(0, np.uint64), return_counts=True)
    pair = (records >> np.uint64(32)).astype(np.uint32)
    starts = np.flatnonzero(np.diff(pair, prepend=~pair[:1]))
    pairs, docs = pair[starts], np.diff(np.append(starts, len(pair)))
    links = np.add.reduceat(times, starts) if len(starts) else np.empty(0, np.int64)
    cuts = np.searchsorted(pairs, np.arange(1, 1 << DIGITS, dtype=np.uint64) << np.uint64(32 - DIGITS))
    sections = [
        [_packed(part) for part in np.split(pairs, cuts)],
        [_packed(part.astype(np.int64)) for part in np.split(links, cuts)],
        [_packed(docs.astype(np.uint32)), _packed(records.astype(np.uint32)), _packed(times.astype(np.uint32))]]
    columns = [*map(list, zip(*held)), *sections]
    return pa.RecordBatch.from_arrays(
        [pa.array([c], f.type) for c, f in zip(columns, schema)], schema=schema)


def pair_counts(runs: DataFrame) -> DataFrame:
    """``(pair, a_id, b_id, links, best)``: how often two ids are linked in all texts, and whether
    no other A id is linked to that B id more often. Ties are all best."""
    sections = runs.select(
        F.xxhash64("pairs").alias("run"), F.posexplode(F.arrays_zip("pairs", "links")).alias("digit", "s"))
    size = F.octet_length("s.pairs") + F.octet_length("s.links")
    total = sections.groupBy("digit").agg(F.sum(size).alias("size")).agg(F.max("size")).first()[0] or 0
    spread = sections.select(
        "digit", F.pmod("run", F.lit(total // CHUNK_BYTES + 1)).alias("chunk"), "s.pairs", "s.links")

    def counted(section: pa.Table) -> pa.Table:
        streams = [
            zip(_unpacked(p.as_py(), np.uint32).tolist(), _unpacked(n.as_py(), np.int64).tolist())
            for p, n in zip(section.column("pairs"), section.column("links"))]
        summed = [(key, sum(n for _, n in same)) for key, same in groupby(merge(*streams), itemgetter(0))]
        return pa.table({
            "pair": pa.array([k for k, _ in summed], pa.int64()), "links": pa.array([n for _, n in summed], pa.int64())})

    merged = spread.groupBy("digit", "chunk").applyInArrow(counted, "pair bigint, links bigint")
    whole = merged.groupBy("pair").agg(F.sum("links").alias("links"))
    low = F.shiftright("pair", 32 - DIGITS)
    b_id = F.shiftleft(F.shiftright("pair", 16).bitwiseAND((1 << (16 - DIGITS)) - 1), DIGITS) + low
    named = whole.select("pair", F.col("pair").bitwiseAND(0xFFFF).alias("a_id"), b_id.alias("b_id"), "links")
    # In the order of B ids; one has no more partners than the vocabulary has ids.
    highest = F.max("links").over(Window.partitionBy("b_id"))
    return named.withColumn("best", F.col("links") == highest)


def contributions(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """Per document its token, group and link counts, the digest of its groups, the number of its
    links whose pair is best for the B id, and the sum of its links' counts."""
    spark = runs.sparkSession
    # At most one row per byte of the vocabularies (module docstring).
    totals = counts.select("pair", "links", "best").toArrow().sort_by("pair")
    shared = spark.sparkContext.broadcast((
        totals.column("pair").to_numpy(), totals.column("links").to_numpy(), totals.column("best").to_numpy()))
    id_type = runs.schema["ids"].dataType.elementType
    longs = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    schema = T.StructType([
        T.StructField("id", id_type), *[T.StructField(n, T.LongType()) for n in longs],
        T.StructField("groups_sha256", T.StringType())])

    def run(batches):
        pairs, links, best = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                cell = lambda name: batch.column(name)[row].values  # noqa: E731, B023
                ids, digests = cell("ids"), cell("digests")
                own = np.concatenate([_unpacked(x.as_py(), np.uint32) for x in cell("pairs")]).astype(np.int64)
                docs, places, times = (_unpacked(x.as_py(), np.uint32) for x in cell("records"))
                at = np.repeat(np.searchsorted(pairs, own), docs)
                n_best, count_sum = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
                np.add.at(n_best, places, best[at] * times.astype(np.int64))
                np.add.at(count_sum, places, links[at] * times.astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [ids, cell("n_a"), cell("n_b"), cell("n_links"), cell("n_links"), pa.array(n_best),
                     pa.array(count_sum), digests], names=schema.fieldNames())

    return runs.mapInArrow(run, schema)


def token_groups(
    docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(id, groups)``: the groups themselves as ``a1,a2|b1;a3|b2,b3``, empty without tokens."""
    read = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([read.schema["id"], T.StructField("groups", T.StringType())])

    def run(batches):
        coder = encoder(path_a, path_b)
        for part in chunks(batches, "text"):
            shown = [";".join(coder.shown[i] for i in units or ()) for units in coder.texts(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shown, pa.string())], names=["id", "groups"])

    return read.mapInArrow(run, schema)


def run_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document how its tokens of both vocabularies line up."""
    docs = table(spark, sf_dir, "documents")
    runs = write_runs(docs, vocabulary_path(VOCABULARY_A), vocabulary_path(VOCABULARY_B))
    return contributions(runs, pair_counts(runs)).withColumnRenamed("id", "doc_id")
