"""Quality classifier: a sparse ensemble of rules over statistics of a text.

A shallow random forest is grown on labelled documents; every path from a root to a node is a
conjunction of bounds on statistics. A logistic regression with an L1 penalty weighs these rules
beside the statistics themselves and leaves few of them. What remains is compiled into one Spark
column expression, so that scoring all documents is a scan without Python and without a shuffle.

Only statistics of the text are inputs. The rows the model is fitted on are at most
``SAMPLE_ROWS`` labelled documents, those with the smallest hashes of their ids.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import free_name, table
from folioscope.session import materialized

NAME = "op1_quality_classifier"
#: Most labelled rows the model is fitted on. So few narrow rows are broadcast.
SAMPLE_ROWS = 20_000
TREES, DEPTH, SEED = 24, 3, 7
PENALTY = 2e-3
#: Score from which a document counts as good.
GOOD = 0.7
#: Rows of the held-out fold: crc32 of the id as text, modulo 4.
FOLD = 2


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the fold that labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == FOLD, F.lit(False))


def statistics(text: Column) -> dict[str, Column]:
    """Numbers about a text, all defined for empty and null ones."""
    t = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.char_length(t), F.lit(1))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    count = F.greatest(F.size(words), F.lit(1))
    lines = F.split(t, "\n")
    share = lambda kept: F.char_length(F.regexp_replace(t, f"[^{kept}]+", "")) / chars
    lengths = F.aggregate(words, F.lit(0), lambda n, w: n + F.char_length(w))
    return {
        "log_chars": F.log1p(F.char_length(t)),
        "log_words": F.log1p(F.size(words)),
        "word_length": lengths / count,
        "words_per_line": F.size(words) / F.greatest(F.size(lines), F.lit(1)),
        "distinct_words": F.size(F.array_distinct(words)) / count,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        "short_words": F.size(F.filter(words, lambda w: F.char_length(w) <= 3)) / count,
        "upper": share("A-Z"),
        "digits": share("0-9"),
        "stops": share(".,;:?"),
        "symbols": share(r"#$%&*|!<>{}=+^~\\\\@_/"),
        "marked_words": F.size(F.filter(words, lambda w: w.rlike(r"[^\p{L}\p{N}.,;:?'\"()-]"))) / count,
        "ended_lines": F.size(F.filter(lines, lambda x: F.rtrim(x).rlike(r"[.?!:;]$"))) / F.greatest(
            F.size(lines), F.lit(1)),
    }


#: The statistics in their order as features.
NAMES = (
    "log_chars", "log_words", "word_length", "words_per_line", "distinct_words", "distinct_lines",
    "short_words", "upper", "digits", "stops", "symbols", "marked_words", "ended_lines",
)


@dataclass(frozen=True)
class Bound:
    """A statistic at most, or more than, a value."""

    name: str
    at_most: bool
    value: float

    def column(self) -> Column:
        stat = F.col(self.name)
        return stat <= self.value if self.at_most else stat > self.value


@dataclass(frozen=True)
class Ensemble:
    """Weighted rules and statistics; ``score`` is its compiled form."""

    intercept: float
    rules: tuple[tuple[tuple[Bound, ...], float], ...] = ()
    linear: tuple[tuple[str, float], ...] = ()

    def score(self) -> Column:
        """The probability of a good label, over the columns of ``with_statistics``."""
        parts = [F.when(reduce(and_, (b.column() for b in rule)), weight).otherwise(0.0)
                 for rule, weight in self.rules]
        parts += [F.col(name) * weight for name, weight in self.linear]
        total = reduce(lambda a, b: a + b, parts, F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))


_TEST = re.compile(r"(?:If|Else) \(feature (\d+) (<=|>) ([-+0-9.eE]+|Infinity|-Infinity)\)")


def paths(description: str, names: tuple[str, ...] = NAMES) -> set[tuple[Bound, ...]]:
    """All paths of the trees in a forest's description, each statistic with its tightest bounds."""
    found: set[tuple[Bound, ...]] = set()
    open_tests: list[tuple[int, Bound]] = []
    for line in description.splitlines():
        match = _TEST.search(line)
        if match is None:
            if "Tree" in line:
                open_tests = []
            continue
        depth = len(line) - len(line.lstrip())
        open_tests = [(d, b) for d, b in open_tests if d < depth]
        feature, sign, value = match.groups()
        open_tests.append((depth, Bound(names[int(feature)], sign == "<=", float(value))))
        tight: dict[tuple[str, bool], float] = {}
        for _, b in open_tests:
            held = tight.get((b.name, b.at_most), b.value)
            tight[b.name, b.at_most] = min(held, b.value) if b.at_most else max(held, b.value)
        found.add(tuple(Bound(n, m, v) for (n, m), v in sorted(tight.items())))
    return found


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns with the statistics, under names no column of ``docs`` may have."""
    taken = {c.lower() for c in docs.columns}
    clash = [name for name in NAMES if name in taken]
    if clash:
        raise ValueError(f"columns {clash} are names of statistics")
    return docs.withColumns(statistics(F.col(text)))


def labelled(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Statistics and ``label`` of at most ``rows`` labelled documents outside the held-out fold.
    Ids without a label, or with different ones, are left out; equal ones count once."""
    one = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.min("quality").alias("label"), F.max("quality").alias("_most")).filter("label = _most")
    sample = one.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    named = docs.select(F.col("doc_id"), F.col("text")).join(
        F.broadcast(sample.select("doc_id", F.col("label").cast("double"))), "doc_id")
    return materialized(
        named.select("label", *[c.alias(n) for n, c in statistics(F.col("text")).items()]),
        "quality-sample")


def fit(sample: DataFrame) -> Ensemble:
    """The rule ensemble for a written table of statistics and ``label``. A sample without rows
    or with one label only gives that share of good labels as a constant score."""
    seen = sample.agg(F.count("*"), F.coalesce(F.avg("label"), F.lit(0.5))).first()
    if seen[0] == 0 or seen[1] in (0.0, 1.0):
        share = min(max(float(seen[1]), 0.01), 0.99)
        from math import log

        return Ensemble(log(share / (1 - share)))
    # At most SAMPLE_ROWS narrow rows: a few partitions, whatever files they came in.
    sample = sample.repartition(4).sortWithinPartitions(*NAMES).cache()
    try:
        assembled = VectorAssembler(inputCols=list(NAMES), outputCol="features").transform(sample)
        forest = RandomForestClassifier(
            numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxBins=64, subsamplingRate=0.7,
            featureSubsetStrategy="0.5").fit(assembled)
        rules = sorted(paths(forest.toDebugString), key=str)
        held = sample.select("label", *NAMES, *[
            F.when(reduce(and_, (b.column() for b in rule)), 1.0).otherwise(0.0).alias(f"_r{i}")
            for i, rule in enumerate(rules)])
        inputs = [*NAMES, *[f"_r{i}" for i in range(len(rules))]]
        wide = VectorAssembler(inputCols=inputs, outputCol="features").transform(held).select(
            "label", "features").cache()
        model = LogisticRegression(
            regParam=PENALTY, elasticNetParam=1.0, maxIter=60, standardization=True).fit(wide)
        wide.unpersist()
    finally:
        sample.unpersist()
    weights = model.coefficients.toArray().tolist()
    linear = tuple((n, w) for n, w in zip(NAMES, weights) if w)
    kept = tuple((rule, w) for rule, w in zip(rules, weights[len(NAMES):]) if w)
    return Ensemble(float(model.intercept), kept, linear)


def classify(docs: DataFrame, model: Ensemble, text: str = "text") -> DataFrame:
    """All rows and columns and, last, ``score`` (0 to 1) and ``predicted`` (1 from ``GOOD`` on). Null
    and empty texts are scored by the statistics of the empty text. Where the table has columns of
    these names, underscores go in front of the new ones; names of statistics are refused."""
    score, predicted = free_name(docs, "score"), free_name(docs, "predicted")
    keep = [F.col(f"`{c}`") for c in docs.columns]
    scored = with_statistics(docs, text).select(*keep, model.score().alias(score))
    return scored.withColumn(predicted, (F.col(score) >= GOOD).cast("int"))


def run_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its fold, score and class."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(labelled(docs, table(spark, sf_dir, "labels")))
    return classify(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
