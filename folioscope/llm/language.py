"""Language identification by nearest centroid.

A text is the vector of its character n-grams (lower case, letters only, one to three long), hashed
into ``DIMENSIONS`` places, weighed by logarithmic frequency and inverse document frequency and
scaled to length one. Document frequencies are counted over all texts that may be learnt from.
Every language has up to ``CENTROIDS`` centroids, found by spherical k-means over at most
``SAMPLE_ROWS`` of its texts, those with the smallest hashes of their ids. A text belongs to the
language of the centroid it has the largest cosine with. It is rejected where that cosine is below
the centroid's own radius, the smallest one that its members have but for a share ``OUTLIERS``.

Null texts and texts without a letter are ``und`` with score 0. A text with letters always has a
nearest language; ``rejected`` says that it is far from it, and ``language`` is ``und`` then. Equal
cosines go to the language that comes first by name. Without anything to learn from, all texts
are ``und``. Rows that repeat an id or a text each give a row. Only id, text and language are read;
other columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import chunks, table
from folioscope.operators.scale import top_per_group
from folioscope.session import materialized

NAME = "op12_language_id"
#: Places n-grams are hashed into (a power of two), and letters of the longest n-gram.
DIMENSIONS = 1 << 14
LONGEST = 3
#: Texts of a language whose vectors are clustered, at most, and clusters of a language.
SAMPLE_ROWS = 2_000
CENTROIDS = 4
ROUNDS = 25
#: Share of a cluster's sampled members that its radius leaves out.
OUTLIERS = 0.005
#: Rows of the held-out fold: crc32 of the id as text, modulo 4.
FOLD = 2
#: Code points of a text that are hashed at a time.
BLOCK = 1 << 20
UNKNOWN = "und"

_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the fold that languages are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == FOLD, F.lit(False))


def letters(texts: pa.Array) -> pa.Array:
    """Lower case, all but letters one space, a space at both ends; without letters two spaces."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    kept = pc.replace_substring_regex(low, r"[^\p{L}]+", " ")
    return pc.binary_join_element_wise("", pc.utf8_trim(kept, " "), "", " ")


def frequencies(text: str) -> np.ndarray:
    """How often each place is hit by the n-grams of a text, read in blocks."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    total = np.zeros(DIMENSIONS, np.int64)
    for at in range(0, len(points), BLOCK):
        part = points[at : at + BLOCK + LONGEST - 1]
        hashed = np.zeros(len(part), np.uint32)
        for n in range(LONGEST):
            # n-grams that start in this block; those of single spaces are left out below.
            hashed = hashed[: len(part) - n] + (part[n:] + np.uint32(1)) * _FACTORS[n]
            own = hashed[:BLOCK]
            mixed = (own ^ (own >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(n)
            place = (mixed >> np.uint32(32 - DIMENSIONS.bit_length() + 1)).astype(np.int64)
            if n == 0:
                place = place[part[:BLOCK] != 32]
            total += np.bincount(place, minlength=DIMENSIONS)
    return total


def vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of a text's vector of length one; empty without n-grams."""
    places = np.flatnonzero(counts)
    weights = (1 + np.log(counts[places])) * idf[places]
    length = np.sqrt((weights ** 2).sum())
    return places, (weights / length if length else weights).astype(np.float32)


@dataclass(frozen=True)
class Centroids:
    """``matrix`` has a row of length one per centroid, ``names`` its language, ``radius`` the
    least cosine of its members."""

    idf: np.ndarray
    names: list[str]
    matrix: np.ndarray
    radius: np.ndarray


def _passed(docs: DataFrame, column: str, schema, work) -> DataFrame:
    def run(batches):
        for part in chunks(batches, column):
            yield from work(part)

    return docs.mapInArrow(run, schema)


def learnable(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``(id, text, lang)`` of the rows outside the held-out fold that have a language and letters."""
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    return rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("id")))


def document_frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts and, for each place, of the texts that hit it: sums of tasks, added up."""

    def run(batches):
        total, texts = np.zeros(DIMENSIONS, np.int64), 0
        for part in chunks(batches, "text"):
            for text in letters(part.column(0)):
                total += frequencies(text.as_py()) > 0
                texts += 1
        if texts:
            places = np.append(np.flatnonzero(total), -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(places), pa.array(np.append(total[places[:-1]], texts))], names=["place", "texts"])

    summed = rows.select("text").mapInArrow(run, "place bigint, texts bigint").groupBy("place").agg(
        F.sum("texts").alias("texts")).toArrow()  # a row per place at most
    place, texts = summed.column("place").to_numpy(), summed.column("texts").to_numpy()
    out = np.zeros(DIMENSIONS + 1, np.int64)
    out[place] = texts
    return int(out[-1]), out[:-1]


def sampled_vectors(rows: DataFrame, idf: np.ndarray) -> DataFrame:
    """``(lang, key, places, weights)`` of at most ``SAMPLE_ROWS`` texts of each language. Sent to all
    tasks: a number per language, less than the model itself."""
    key = F.shiftrightunsigned(F.xxhash64("id", "text"), 1)
    # Thinned by the size of the language before texts meet, to about four times the sample.
    share = F.least(F.lit(1.0), 4.0 * SAMPLE_ROWS / F.count("*"))
    shares = rows.groupBy("lang").agg((share * float(1 << 63)).alias("below"))
    hashed = rows.join(F.broadcast(shares), "lang").select("lang", key.alias("key"), "text", "below")
    few = top_per_group(hashed.filter("key <= below"), ["lang"], [F.col("key")], SAMPLE_ROWS)

    def work(part):
        vectors = [vector(frequencies(t.as_py()), idf) for t in letters(part.column(2))]
        yield pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), pa.array([v[0].astype(np.int32) for v in vectors], pa.list_(pa.int32())),
             pa.array([v[1] for v in vectors], pa.list_(pa.float32()))], names=["lang", "key", "places", "weights"])

    return materialized(
        _passed(few.select("lang", "key", "text"), "text",
                "lang string, key bigint, places array<int>, weights array<float>", work), "language-vectors")


def _dense(rows: pa.Table) -> np.ndarray:
    places, weights = rows.column("places").combine_chunks(), rows.column("weights").combine_chunks()
    out = np.zeros((rows.num_rows, DIMENSIONS), np.float32)
    lengths = pc.list_value_length(places).to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(rows.num_rows), lengths), places.flatten().to_numpy()] = weights.flatten().to_numpy()
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    lengths = np.sqrt((rows ** 2).sum(axis=1, keepdims=True))
    return rows / np.where(lengths > 0, lengths, 1)


def clustered(vectors: np.ndarray, most: int = CENTROIDS) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of length one and their radii. The first is the mean; each next one starts at
    the vector that is least like all before it."""
    centres = _unit(vectors.mean(axis=0, keepdims=True))
    while len(centres) < most:
        nearest = (vectors @ centres.T).max(axis=1)
        if nearest.min() > 1 - 1e-6:
            break
        centres = np.vstack([centres, vectors[nearest.argmin()]])
    before = None
    for _ in range(ROUNDS):
        own = (vectors @ centres.T).argmax(axis=1)
        if before is not None and (own == before).all():
            break
        before = own
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        used = np.bincount(own, minlength=len(centres)) > 0
        centres = np.where(used[:, None], _unit(sums), centres)
    cosines = vectors @ centres.T
    own = cosines.argmax(axis=1)
    used = np.unique(own)
    radius = np.array([np.quantile(cosines[own == c, c], OUTLIERS) for c in used], np.float32)
    return centres[used], radius


def fit(rows: DataFrame) -> Centroids:
    """Centroids for a table of ``learnable`` rows. The model is a few rows of ``DIMENSIONS`` numbers
    per language; languages are few, their texts may be any number."""
    texts, seen = document_frequencies(rows)
    idf = np.log((1 + texts) / (1 + seen)) + 1
    if not texts:
        return Centroids(idf, [], np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, np.float32))

    def cluster(sample: pa.Table) -> pa.Table:
        sample = sample.sort_by("key")
        centres, radius = clustered(_dense(sample))
        return pa.table({
            "lang": pa.array([sample.column("lang")[0].as_py()] * len(centres)),
            "centre": pa.array(list(centres), pa.list_(pa.float32())), "radius": pa.array(radius)})

    found = sampled_vectors(rows, idf).groupBy("lang").applyInArrow(
        cluster, "lang string, centre array<float>, radius float").toArrow().sort_by("lang")
    return Centroids(
        idf, found.column("lang").to_pylist(), np.array(found.column("centre").to_pylist(), np.float32),
        found.column("radius").to_numpy())


def identify(docs: DataFrame, model: Centroids, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, nearest, language, rejected, score)`` for every row; the score is the cosine with the
    nearest centroid."""
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([
        rows.schema["id"], T.StructField("nearest", T.StringType()), T.StructField("language", T.StringType()),
        T.StructField("rejected", T.BooleanType()), T.StructField("score", T.DoubleType())])
    # The model is one row per centroid, some 64 KB each.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(part):
        model = shared.value
        cosines, known = np.zeros((part.num_rows, len(model.names))), np.zeros(part.num_rows, bool)
        matrix = np.ascontiguousarray(model.matrix.T)
        for i, value in enumerate(letters(part.column(1))):
            text = value.as_py()
            if len(text) > 2 and model.names:
                places, weights = vector(frequencies(text), model.idf)
                cosines[i], known[i] = weights @ matrix[places], True
        best = cosines.argmax(axis=1) if model.names else np.zeros(part.num_rows, int)
        score = np.clip(cosines[np.arange(part.num_rows), best], 0, 1) if model.names else np.zeros(part.num_rows)
        rejected = known & (score < model.radius[best]) if model.names else known
        nearest = [model.names[b] if k else UNKNOWN for b, k in zip(best, known)]
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(nearest, pa.string()),
             pa.array([UNKNOWN if r else n for n, r in zip(nearest, rejected)], pa.string()), pa.array(rejected),
             pa.array(np.where(known, score, 0.0))], names=schema.fieldNames())

    return _passed(rows, "text", schema, work)


def run_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its fold, the language of the nearest centroid, its score, and whether it is too
    far from it."""
    docs = table(spark, sf_dir, "documents")
    model = fit(learnable(docs))
    return identify(docs, model).select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), F.col("nearest").alias("lang_pred"),
        "score", "rejected")
