"""Exact top-k search by BM25: an inverted index per shard with block-max dynamic pruning.

A shard indexes some thousand documents: terms in order, their postings (document and frequency part
of BM25), each term's greatest part in the shard and in every group of documents. What
depends on the whole corpus, inverse document frequencies and the mean length, travels with the
queries, so shards agree on scores and their lists merge exactly.

Documents of a shard that share frequent terms, as those of one language do, stand together as a group. Terms
that many documents of a group hold carry most of the postings that queries meet, and bounds prune few of
them. Their parts are kept as whole rows and added up for some queries at once as a matrix product. Other
postings are added up in lines of about one length.

A few shards are searched first. The kth best score found there is the least that the documents of the
other shards must reach: queries that cannot with all their terms leave a shard, and so do those whose
sums so far and block maxima of the terms left stay below it. Sums are in single precision; documents that
reach the least score, its error taken off, are scored again in double precision. Queries come in blocks of
bounded size, each broadcast to all shards.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import (
    chunks,
    lower_table,
    member_table,
    table,
    text_bytes,
    word_hashes,
    words_of,
)
from folioscope.llm.decontamination import WORD_BYTES
from folioscope.session import materialized

NAME = "op4_exact_topk_search"
TOP = 10
K1, B = 1.2, 0.75
#: Query rows of the registered search: ids divisible by this.
QUERY_EVERY = 20
SHARD_DOCUMENTS = 10_000
SHARD_WORDS = 4_000_000
BLOCK_DOCUMENTS = 64
#: Documents of a shard are alike: groups have so many at least, and are found by so many frequent terms, from so
#: many starts in so many rounds; groups with centres of this cosine are one.
GROUP_DOCUMENTS = 400
GROUP_TERMS = 256
GROUP_STARTS = 32
GROUP_ROUNDS = 3
GROUP_NEAR = 0.5
#: Terms that at least this share of a shard's documents hold are whole rows, and so many queries are
#: multiplied with these at once, from slices of so many.
DENSE_SHARE = 0.06
QUERY_BATCH = 256
QUERY_SLICE = 2048
#: Other postings are added up for so many queries at once, so many of them at once, and the lengths of the rows that hold them.
LINE_BATCH = 64
POSTINGS = 100_000
LENGTHS = np.unique(np.ceil(1.4 ** np.arange(50)).astype(np.int64))
#: Terms left are added up whole, without bounds, when they have at most so many postings a document.
FEW_POSTINGS = 0.05
#: Bounds are tried for queries whose terms come to less than so many times the least score.
BOUNDS_PAY = 2.5
#: Terms of the queries in a block (20 bytes each at most when broadcast).
QUERY_BLOCK_TERMS = 2_000_000
#: One of so many shards is searched first; what it finds is the least that the others' documents must reach.
FIRST_OF = 8
#: Scores are rounded to so many decimals before they are ordered; equal ones go by id.
DECIMALS = 6
SLACK = 2 * 10.0**-DECIMALS

_LOW = lower_table()
_MEMBER = member_table(WORD_BYTES)


def term_lists(column: pa.Array):
    """For each text its distinct term hashes in order, their counts, and its number of words."""
    raw, offsets = text_bytes(column)
    low = _LOW[raw]
    starts, ends, first = words_of(low, offsets, _MEMBER)
    hashes = word_hashes(low, starts, ends)
    for a, b in zip(first.tolist(), first[1:].tolist()):
        terms, counts = np.unique(hashes[a:b], return_counts=True)
        yield terms, counts, b - a


def run_starts(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    if not len(ordered):
        return np.zeros(1, np.int64)
    return np.append(np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))), len(ordered)).astype("<i8")


def alike(places: np.ndarray, starts: np.ndarray, documents: int) -> np.ndarray:
    """A group number for each document, from the places of each term: documents of a group share frequent
    terms, as those of one language do.

    Some rounds of k-means over the frequent terms, from documents at even distances; groups with a centre
    near a larger one's join that, small ones the nearest. Groups bear on speed alone.
    """
    none = np.zeros(documents, np.int64)
    if documents < 2 * GROUP_DOCUMENTS or len(starts) < 2:
        return none
    held = np.diff(starts)
    frequent = np.argsort(-held, kind="stable")[:GROUP_TERMS]
    has = np.zeros((documents, len(frequent)), np.float32)
    for column, term in enumerate(frequent.tolist()):
        has[places[starts[term] : starts[term + 1]], column] = math.sqrt(math.log(1 + documents / held[term]))

    def unit(rows):
        return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), np.float32(1e-9))

    def middles(of, groups):
        return unit((of == groups[:, None]).astype(np.float32) @ has)

    has = unit(has)
    groups = np.arange(GROUP_STARTS)
    centres = has[np.linspace(0, documents - 1, GROUP_STARTS).astype(np.int64)]
    for _ in range(GROUP_ROUNDS):
        of = np.argmax(has @ centres.T, axis=1)
        centres = middles(of, groups)
    near = centres @ centres.T
    leaders: list[int] = []
    join = groups.copy()
    for group in np.argsort(-np.bincount(of, minlength=len(groups)), kind="stable").tolist():
        if leaders and near[group, leaders].max() >= GROUP_NEAR:
            join[group] = leaders[int(near[group, leaders].argmax())]
        else:
            leaders.append(group)
    of = join[of]
    groups = np.flatnonzero(np.bincount(of) >= GROUP_DOCUMENTS)
    if len(groups) < 2:
        return none
    small = ~np.isin(of, groups)
    of[small] = groups[np.argmax(has[small] @ middles(of, groups).T, axis=1)]
    return of


def narrow(numbers: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in two bytes each where they fit, else in four; ``wide`` reads them."""
    return numbers.astype("<u2" if not len(numbers) or numbers.max() < 1 << 16 else "<i4")


def wide(raw, count: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) < 4 * count else "<i4")


def shard_arrays(ids: list, lengths: list, terms: list, counts: list) -> dict[str, bytes]:
    """A shard of documents with their ids, numbers of words, terms and counts of these; see ``build_shards``."""
    places = np.repeat(np.arange(len(terms), dtype=np.int32), [len(t) for t in terms])
    all_terms, tf = np.concatenate(terms), np.concatenate(counts)
    order = np.argsort(all_terms, kind="stable")
    all_terms, places = all_terms[order], places[order]
    starts = run_starts(all_terms)
    group = alike(places, starts, len(ids))
    together = np.argsort(group, kind="stable")
    number = np.empty(len(ids), np.int32)
    number[together] = np.arange(len(ids), dtype=np.int32)
    arrays = {
        "ids": np.array(ids, "<i8")[together], "lengths": np.array(lengths, "<i8")[together],
        "groups": np.unique(group, return_counts=True)[1].astype("<i8"), "terms": all_terms[starts[:-1]],
        "starts": starts, "places": narrow(number[places]), "counts": narrow(tf[order])}
    return {name: values.tobytes() for name, values in arrays.items()}


def build_shards(docs: DataFrame) -> DataFrame:
    """Shards of consecutive rows as arrays in bytes: ``ids``, ``lengths``, the sizes of ``groups`` of documents
    that are alike and stand together, ``terms`` in order, ``starts`` of their postings, ``places`` (document
    numbers) and ``counts``."""

    def batch(arrays):
        return pa.RecordBatch.from_pydict({k: pa.array([v], pa.binary()) for k, v in arrays.items()})

    def run(batches):
        ids, lengths, terms, counts = [], [], [], []
        words = 0
        for part in chunks(batches, "text"):
            for doc, (t, c, n) in zip(part.column(0).to_pylist(), term_lists(part.column(1))):
                ids.append(doc)
                lengths.append(n)
                terms.append(t)
                counts.append(c.astype("<i4"))
                words += len(t)
                if len(ids) >= SHARD_DOCUMENTS or words >= SHARD_WORDS:
                    yield batch(shard_arrays(ids, lengths, terms, counts))
                    ids, lengths, terms, counts, words = [], [], [], [], 0
        if ids:
            yield batch(shard_arrays(ids, lengths, terms, counts))

    schema = ", ".join(f"{c} binary" for c in ("ids", "lengths", "groups", "terms", "starts", "places", "counts"))
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def document_frequencies(shards: DataFrame) -> DataFrame:
    """``(term, df)`` over all shards."""

    def run(batches):
        for batch in batches:
            for terms, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_pydict({
                    "term": np.frombuffer(terms, np.int64), "df": np.diff(np.frombuffer(starts, "<i8"))})

    counted = shards.select("terms", "starts").mapInArrow(run, "term bigint, df bigint")
    return counted.groupBy("term").agg(F.sum("df").alias("df"))


def corpus_size(shards: DataFrame) -> tuple[int, float]:
    """Documents and their mean number of words."""

    def run(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                lengths = np.frombuffer(raw, "<i8")
                yield pa.RecordBatch.from_pydict({"n": [len(lengths)], "words": [int(lengths.sum())]})

    row = shards.select("lengths").mapInArrow(run, "n bigint, words bigint").agg(
        F.sum("n"), F.sum("words")).first()
    return row[0] or 0, (row[1] or 0) / max(row[0] or 0, 1)


def weighted_queries(queries: DataFrame, frequencies: DataFrame, documents: int) -> DataFrame:
    """``(query_id, terms, weights)``: each query's distinct terms that occur in the corpus, with
    their inverse document frequencies. Queries without such terms leave."""

    def run(batches):
        for part in chunks(batches, "text"):
            lists = [t for t, _, _ in term_lists(part.column(1))]
            sizes = np.array([len(t) for t in lists])
            yield pa.RecordBatch.from_pydict({
                "query_id": part.column(0).take(pa.array(np.repeat(np.arange(len(lists)), sizes))),
                "term": np.concatenate(lists).view(np.int64) if lists else np.empty(0, np.int64)})

    terms = queries.select("query_id", "text").mapInArrow(run, "query_id bigint, term bigint")
    df = F.col("df")
    weight = F.log(1 + (F.lit(documents) - df + 0.5) / (df + 0.5))
    listed = terms.join(frequencies, "term").groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("term", weight.alias("weight")))).alias("_t"))
    return listed.select(
        "query_id", F.col("_t.term").alias("terms"), F.col("_t.weight").alias("weights"))


class Queries:
    """Queries as arrays: ``ids``, ``starts`` of each one's entries, and for each entry the number (``codes``) of its
    term and weight among ``terms``, in order, and ``weights``."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        self.ids = np.asarray(ids, np.int64)
        self.starts = np.append(0, np.cumsum(sizes)).astype(np.int64)
        order = np.lexsort((weights, terms))
        terms, weights = terms[order], weights[order]
        new = np.append(True, (terms[1:] != terms[:-1]) | (weights[1:] != weights[:-1]))[: len(terms)]
        self.terms, self.weights = terms[new], weights[new]
        self.codes = np.empty(len(terms), np.int32)
        self.codes[order] = np.cumsum(new) - 1


class Shard:
    """A shard's arrays and bounds, ready for queries."""

    def __init__(self, row: dict, mean_length: float):
        self.ids = np.frombuffer(row["ids"], "<i8")
        lengths = np.frombuffer(row["lengths"], "<i8")
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.starts = np.frombuffer(row["starts"], "<i8")
        self.places = wide(row["places"], int(self.starts[-1]))
        self.norm = K1 * (1 - B + B * lengths / max(mean_length, 1e-9))
        held = wide(row["counts"], int(self.starts[-1]))
        counts = held.astype(float)
        self.parts = self.norm[self.places]
        self.parts += counts
        counts *= K1 + 1
        np.divide(counts, self.parts, out=self.parts)
        del counts
        self.most = np.maximum.reduceat(self.parts, self.starts[:-1]) if len(self.terms) else self.parts
        # The postings once more, by document: a document's terms and counts.
        term_of = np.repeat(np.arange(len(self.terms), dtype=np.int32), np.diff(self.starts))
        order = np.argsort(self.places, kind="stable")
        self.document_terms = term_of[order]
        self.document_counts = held[order]
        del order
        self.first = np.append(0, np.cumsum(np.bincount(self.places, minlength=len(self.ids))))
        self._groups(np.frombuffer(row["groups"], "<i8") if "groups" in row else np.array([len(self.ids)]), term_of)
        self.weight = np.zeros(len(self.terms))
        self.place_buffer, self.key_buffer, self.part_buffer = (
            np.empty(POSTINGS, t) for t in (np.int32, np.int64, np.float32))

    def _groups(self, sizes: np.ndarray, term_of: np.ndarray) -> None:
        """Rows of the terms that are frequent in a group, lines of the other postings, bounds."""
        self.edges = np.append(0, np.cumsum(sizes))
        group = np.repeat(np.arange(len(sizes), dtype=np.uint8), sizes)[self.places]
        both = term_of * np.int32(len(sizes))
        both += group
        dense = np.bincount(both, minlength=len(self.terms) * len(sizes)).reshape(-1, len(sizes)) >= np.maximum(
            1, DENSE_SHARE * sizes)
        whole = dense.reshape(-1)[both]
        #: For each group its frequent terms, the row of each term or -1, and the rows.
        self.groups = []
        for each, (start, size) in enumerate(zip(self.edges.tolist(), sizes.tolist())):
            frequent = np.flatnonzero(dense[:, each])
            row_of = np.full(len(self.terms), -1, np.int32)
            row_of[frequent] = np.arange(len(frequent))
            rows = np.zeros((len(frequent), size), np.float32)
            at = np.flatnonzero(whole & (group == each))
            rows[row_of[term_of[at]], self.places[at] - start] = self.parts[at]
            self.groups.append((frequent, row_of, rows))
        self.frequent, _, self.rows = self.groups[0]
        # Blocks of documents, none across groups; the greatest part of a term's other postings by group.
        starts = [np.arange(a, b, BLOCK_DOCUMENTS) for a, b in zip(self.edges[:-1], self.edges[1:])]
        self.block_starts = np.concatenate(starts)
        self.block_edges = np.append(0, np.cumsum([len(x) for x in starts]))
        rest = np.flatnonzero(~whole)
        most = np.zeros(len(self.terms) * len(sizes), np.float32)
        np.maximum.at(most, both[rest], self.parts[rest].astype(np.float32))
        self.rest_most = np.ascontiguousarray(most.reshape(-1, len(sizes)).T)
        self._lines(rest, term_of[rest])

    def _lines(self, postings: np.ndarray, terms: np.ndarray) -> None:
        """Postings that are in no row, terms with about as many together, filled up to lines of one length."""
        self.rest_held = held = np.bincount(terms, minlength=len(self.terms))
        starts = np.cumsum(held) - held
        self.kind = np.where(held > 0, np.searchsorted(LENGTHS, held, side="left"), -1).astype(np.int8)
        self.line = np.zeros(len(self.terms), np.int32)
        #: By kind, places and parts of the lines.
        self.lines = {}
        for kind in np.unique(self.kind[held > 0]).tolist():
            some = np.flatnonzero(self.kind == kind)
            self.line[some] = np.arange(len(some))
            inside = np.arange(int(held[some].max())) < held[some][:, None]
            at = postings[np.where(inside, starts[some][:, None] + np.arange(inside.shape[1]), starts[some][:, None])]
            self.lines[kind] = self.places[at].astype(np.int32), (self.parts[at] * inside).astype(np.float32)

    def postings(self, term: int) -> slice:
        return slice(self.starts[term], self.starts[term + 1])

    def search_all(self, queries: list, k: int):
        """For each ``(query, terms, weights)`` the query and its best ``k`` documents as numbers and scores."""
        if not len(self.terms) or not queries:
            return
        asked = Queries(
            [q for q, _, _ in queries], [len(t) for _, t, _ in queries],
            np.concatenate([t for _, t, _ in queries]), np.concatenate([w for _, _, w in queries]))
        found = {i: (places, scores) for i, places, scores in self.search(asked, k, np.zeros(len(asked.ids)))}
        none = np.empty(0, np.int64), np.empty(0)
        for i, (query, _, _) in enumerate(queries):
            yield query, *found.get(i, none)

    def search(self, asked: Queries, k: int, least: np.ndarray):
        """For queries that have such, their number, and of the shard's best ``k`` documents with a score of
        ``least`` or more their numbers and scores."""
        if not len(self.terms) or not len(asked.codes):
            return
        at = np.minimum(np.searchsorted(self.terms, asked.terms), len(self.terms) - 1)
        number = np.where(self.terms[at] == asked.terms, at, -1).astype(np.int32)
        for start in range(0, len(asked.ids), QUERY_SLICE):
            yield from self._search(asked, start, min(start + QUERY_SLICE, len(asked.ids)), number, k, least)

    def _search(self, asked: Queries, start: int, stop: int, number: np.ndarray, k: int, least: np.ndarray):
        """``search`` for the queries from ``start`` to ``stop``, with the ``number`` here of each term."""
        codes = asked.codes[asked.starts[start] : asked.starts[stop]]
        terms = number[codes]
        here = np.flatnonzero(terms >= 0)
        terms, weights = terms[here], asked.weights[codes[here]]
        starts = np.searchsorted(here, asked.starts[start : stop + 1] - asked.starts[start])
        least = least[start:stop]
        sizes = np.diff(starts)
        query = np.repeat(np.arange(len(sizes)), sizes)
        # Queries that could not reach the least score with all their terms leave.
        bounds = np.bincount(query, weights * self.most[terms], len(sizes))
        alive = np.flatnonzero((sizes > 0) & (bounds >= least - SLACK))
        # Queries with frequent terms of the same group meet, so that a product has few rows without use.
        many = np.stack([np.bincount(query[row_of[terms] >= 0], minlength=len(sizes)) for _, row_of, _ in self.groups])
        alive = alive[np.lexsort((-many.max(axis=0)[alive], many.argmax(axis=0)[alive]))]
        for at in range(0, len(alive), QUERY_BATCH):
            batch = alive[at : at + QUERY_BATCH]
            # Single precision errs by less than this share.
            share = (sizes[batch] + 8) * 2.0**-23
            floor = np.maximum((least[batch] - SLACK) * (1 - share), 1e-30).astype(np.float32)
            near = bounds[batch] < BOUNDS_PAY * least[batch]
            scores = self.scores(batch, starts, terms, weights, floor, near)
            reached = scores >= floor[:, None]
            for i in np.flatnonzero(reached.any(axis=1)).tolist():
                seen = np.flatnonzero(reached[i])
                if len(seen) > k:
                    rough = scores[i, seen]
                    kth = float(np.partition(rough, len(seen) - k)[len(seen) - k])
                    seen = seen[rough >= (kth - SLACK) * (1 - 2 * share[i])]
                own = slice(starts[batch[i]], starts[batch[i] + 1])
                rounded = np.round(self.exact(terms[own], weights[own], seen), DECIMALS)
                best = np.lexsort((self.ids[seen], -rounded))[:k]
                yield start + int(batch[i]), seen[best], rounded[best]

    def scores(self, batch, starts, terms, weights, floor, near) -> np.ndarray:
        """Scores of all documents for a batch of queries, in single precision; where ``near`` and a query cannot
        reach its ``floor`` here, the scores by frequent terms."""
        sizes = starts[batch + 1] - starts[batch]
        ends = np.cumsum(sizes)
        entries = np.arange(int(ends[-1])) + np.repeat(starts[batch] - (ends - sizes), sizes)
        query = np.repeat(np.arange(len(batch)), sizes)
        terms, weights = terms[entries], weights[entries].astype(np.float32)
        out = np.empty((len(batch), len(self.ids)), np.float32)
        for (_, row_of, rows), start, end in zip(self.groups, self.edges[:-1], self.edges[1:]):
            row = row_of[terms]
            dense = row >= 0
            used = np.bincount(row[dense], minlength=len(rows)) > 0
            used |= used.mean() > 0.75 if len(used) else False
            factors = np.zeros((len(batch), int(used.sum())), np.float32)
            factors[query[dense], (np.cumsum(used) - 1)[row[dense]]] = weights[dense]
            out[:, start:end] = factors @ (rows if used.all() else rows[used])
        kinds = self.kind[terms]
        some = np.flatnonzero(near)
        if len(some):
            # The greatest score so far in a block, and the block maxima of the terms left.
            bounds = np.maximum.reduceat(out[some], self.block_starts, axis=1)
            entries = np.flatnonzero(near[query])
            asked, left = (np.cumsum(near) - 1)[query[entries]], terms[entries]
            for each, (start, end) in enumerate(zip(self.block_edges[:-1], self.block_edges[1:])):
                rest = np.bincount(asked, weights[entries] * self.rest_most[each][left], len(some))
                bounds[:, start:end] += rest[:, None].astype(np.float32)
            few = np.bincount(asked, self.rest_held[left], len(some)) <= FEW_POSTINGS * len(self.ids)
            done = ~few & (bounds.max(axis=1) * np.float32(1 + 2.0**-12) < floor[some])
            kinds[entries[done[asked]]] = -1
        flat, offset = out.reshape(-1), query * len(self.ids)
        for start in range(0, len(batch), LINE_BATCH):
            a, b = ends[start] - sizes[start], ends[min(start + LINE_BATCH, len(batch)) - 1]
            order = a + np.argsort(kinds[a:b], kind="stable")
            bounds = np.searchsorted(kinds[order], np.arange(len(LENGTHS) + 1)).tolist()
            for kind, (places, parts) in self.lines.items():
                length = places.shape[1]
                step = max(1, POSTINGS // length)
                for at in range(bounds[kind], bounds[kind + 1], step):
                    some = order[at : min(at + step, bounds[kind + 1])]
                    line = self.line[terms[some]]
                    n = len(some) * length
                    if n > len(self.part_buffer):
                        self.place_buffer, self.key_buffer, self.part_buffer = (
                            np.empty(n, t) for t in (np.int32, np.int64, np.float32))
                    place, key, part = (
                        x[:n].reshape(-1, length) for x in (self.place_buffer, self.key_buffer, self.part_buffer))
                    places.take(line, axis=0, out=place, mode="clip")
                    np.add(place, offset[some][:, None], out=key)
                    parts.take(line, axis=0, out=part, mode="clip")
                    part *= weights[some][:, None]
                    np.add.at(flat, key.reshape(-1), part.reshape(-1))
        return out

    def exact(self, terms: np.ndarray, weights: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Scores of the documents ``places``, in double precision."""
        self.weight[terms] = weights
        sizes = self.first[places + 1] - self.first[places]
        ends = np.cumsum(sizes)
        own = np.arange(int(ends[-1])) + np.repeat(self.first[places] - (ends - sizes), sizes)
        weight = self.weight[self.document_terms[own]]
        self.weight[terms] = 0
        hits = np.flatnonzero(weight)
        document = np.repeat(np.arange(len(places)), sizes)[hits]
        counts = self.document_counts[own[hits]].astype(float)
        parts = counts * (K1 + 1) / (counts + self.norm[places][document])
        return np.bincount(document, parts * weight[hits], len(places))


def matches(shards: DataFrame, asked: Broadcast, least: np.ndarray, mean: float, k: int) -> DataFrame:
    """``(query_id, doc_id, score)``: of each shard the best ``k`` documents of every query, without those that
    miss the query's ``least`` score."""
    lows = shards.sparkSession.sparkContext.broadcast(least)

    def found(row):
        shard, queries = Shard(row, mean), asked.value
        ids, docs, scores = [], [], []
        for query, places, found in shard.search(queries, k, lows.value):
            ids.append(np.full(len(places), queries.ids[query]))
            docs.append(shard.ids[places])
            scores.append(found)
        return pa.RecordBatch.from_pydict(
            {name: np.concatenate(v) if v else [] for name, v in (
                ("query_id", ids), ("doc_id", docs), ("score", scores))},
            schema=pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield found({name: batch.column(name)[i].as_buffer() for name in batch.schema.names})
        pa.default_memory_pool().release_unused()

    out = materialized(shards.mapInArrow(run, "query_id bigint, doc_id bigint, score double"), "search-lists")
    lows.unpersist()
    return out


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(query_id, rank, doc_id, score)``: the best ``k`` documents of every query.

    ``queries(query_id, text)``; of rows that repeat a query id the smallest text is the query.
    Documents are all rows of ``docs`` that have an id; rows that repeat one are hits of their own.
    Only documents that share a term with the query are hits; null and empty texts never are, and
    queries without terms have no rows. Equal scores go by id.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    shards = materialized(build_shards(rows.filter("doc_id is not null")), "search-shards")
    documents, mean = corpus_size(shards)
    asked = queries.filter("query_id is not null").groupBy("query_id").agg(F.min("text").alias("text"))
    weighted = materialized(
        weighted_queries(asked, document_frequencies(shards), documents), "search-queries")
    size = weighted.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-size // QUERY_BLOCK_TERMS))
    early = F.pmod(F.xxhash64("ids"), F.lit(FIRST_OF)) == 0
    first, others = materialized(shards.filter(early), "search-first"), shards.filter(~early)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    lists = None
    for block in range(blocks):
        part = weighted.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow().combine_chunks()
        asked = Queries(
            part["query_id"].to_numpy(), pc.list_value_length(part["terms"]).to_numpy(),
            pc.list_flatten(part["terms"]).to_numpy().view(np.uint64), pc.list_flatten(part["weights"]).to_numpy())
        shared = spark.sparkContext.broadcast(asked)
        found = matches(first, shared, np.zeros(len(asked.ids)), mean, k)
        kth = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).toArrow()
        least = dict(zip(kth["query_id"].to_pylist(), kth["score"].to_pylist()))
        least = np.array([least.get(q, 0.0) for q in asked.ids.tolist()])
        found = found.unionByName(matches(others, shared, least, mean, k))
        shared.unpersist()
        lists = found if lists is None else lists.unionByName(found)
    return lists.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "doc_id", "score")


def run_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for every document whose id is divisible by ``QUERY_EVERY``."""
    docs = table(spark, sf_dir, "documents")
    queries = docs.filter(F.col("doc_id") % QUERY_EVERY == 0).select(
        F.col("doc_id").alias("query_id"), "text")
    return search(docs, queries)


SQL = """
WITH word AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM word GROUP BY ALL),
len AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, (SELECT count(*) FROM word) / count(*) AS mean FROM documents),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
hit AS (
  SELECT q.doc_id AS query_id, d.doc_id,
    round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * d.tf * 2.2
      / (d.tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score
  FROM tf q JOIN tf d USING (term) JOIN df USING (term) JOIN len ON len.doc_id = d.doc_id, corpus
  WHERE q.doc_id % 20 = 0 GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
  doc_id, score
FROM hit QUALIFY rank <= 10
"""
