"""The corpus pipeline: five stages over ``documents``, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import decontamination, jaccard, packing, personal, quality
from folioscope.llm.common import free_name, table
from folioscope.llm.tokens import vocabulary_path
from folioscope.session import materialized, prepared

#: Near duplicates of the pipeline: words of a shingle, and least similarity as a fraction. The values
#: of the op8 contract bind that query alone.
DUPLICATE_SHINGLE = 5
DUPLICATE_THRESHOLD = (80, 100)
#: Five stages share executors whose heap the first ones fill and workers that stay, so batches of
#: texts are smaller here and a worker keeps so many token pieces, up to the end of its task.
STAGE_BATCH = "2m"
KEPT_PIECES = 50_000


def own_columns(docs: DataFrame) -> list:
    """The columns of a table, whatever signs their names hold."""
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble predicts to be good."""
    model = quality.fit(quality.labelled(docs, table(spark, sf_dir, "labels")))
    scored = quality.classify(docs, model)
    return scored.filter(F.col(scored.columns[-1]) == 1).select(*own_columns(docs))


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, and all others.

    Rows are compared whatever their ids are: the row with the smallest id stays, one of those that
    repeat it, and one without an id only where no row of the group has one. Rows that repeat an id
    with unlike texts all stay, and so do texts without words.
    """
    # Names that no column of the documents has.
    row = free_name(docs, "_row")
    numbered = materialized(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows")
    linked = jaccard.link_documents(
        numbered, n=DUPLICATE_SHINGLE, threshold=DUPLICATE_THRESHOLD, id_column=row)
    linked = linked.select(F.col(row).alias("row"), "component_id")
    others = materialized(linked.filter(F.col("component_id") != F.col("row")), "pipeline-copies")
    members = materialized(others.unionByName(
        others.select(F.col("component_id").alias("row"), "component_id").distinct()), "pipeline-groups")
    ids = numbered.select(F.col(row).alias("row"), "doc_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    kept = materialized(
        ids.join(jaccard.few(members), "row")
        .groupBy("component_id").agg(first.alias("first")).select("first.row"), "pipeline-kept")
    gone = members.select("row").join(jaccard.few(kept), "row", "left_anti")
    gone = materialized(gone.select(F.col("row").alias(row)), "pipeline-gone")
    return numbered.join(jaccard.few(gone), row, "left_anti").select(*own_columns(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    return decontamination.drop_documents(found).select(*own_columns(docs))


def personal_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced in their texts."""
    return personal.redact_documents(docs).select(*own_columns(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of all documents with their places in token sequences."""
    pieces = packing.token_pieces(docs, vocabulary_path(packing.VOCABULARY), kept=KEPT_PIECES)
    return packing.pack(materialized(pieces, "pipeline-pieces"))


def in_session(stage):
    """The stage with the library's session settings, also where a caller runs it by itself."""
    return lambda spark, docs, sf_dir: stage(prepared(spark, STAGE_BATCH), docs, sf_dir)


STAGES = [
    ("quality_classifier", in_session(quality_stage)),
    ("ngram_jaccard_join", in_session(duplicate_stage)),
    ("benchmark_decontamination", in_session(decontamination_stage)),
    ("personal_data", in_session(personal_stage)),
    ("best_fit_packing", in_session(packing_stage)),
]

#: Trained models and tokenizers are beyond SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again for the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
