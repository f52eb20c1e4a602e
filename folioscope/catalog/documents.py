"""Documents written from the given tables and read back, and row contracts that count rejects."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.catalog.base import FEEDBACK_SQL, feedback_of, query, table, text_time
from folioscope.operators import contracts
from folioscope.session import work_dir
from folioscope.sources import readers, writers

#: Least rows in a document, so that every table here becomes several files; documents of larger tables
#: list more, as each file costs its own write, listing and read.
PER_DOCUMENT = 300


def _written(spark, rows, name, field, version):
    path = work_dir(spark, name)
    writers.write_documents(rows, path, field, version, least=PER_DOCUMENT)
    return path


# ---- round trips ----------------------------------------------------------------------------


@query(
    "ledger_documents",
    f"""WITH {FEEDBACK_SQL} SELECT event_id, event_type, paper_id, outcome, batch_id,
    displayed_rank, strftime(occurred_at, '%Y-%m-%d %H:%M:%S.%f') AS occurred_at FROM feedback""",
)
def ledger_documents(spark, sf_dir):
    events = feedback_of(table(spark, sf_dir, "events"))
    path = _written(spark, events, "ledger-documents", "events", 2)
    return readers.read_feedback(spark, path).select(
        "event_id", "event_type", "paper_id", "outcome", "batch_id", "displayed_rank",
        text_time("occurred_at").alias("occurred_at"))


def _label_events(spark, sf_dir):
    doc = F.col("doc_id")
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "labels").select(
        F.concat(F.lit("l"), doc.cast("string")).alias("event_id"),
        F.when(F.col("toxic") == 1, "unlabel").otherwise("label").alias("kind"),
        F.concat(F.lit("arxiv:"), doc.cast("string")).alias("paper_id"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=(doc % 20).cast("int"))).alias("occurred_at"),
        F.when(doc % 11 != 0, "library").alias("source"),
        F.when((F.col("quality") == 1) | (doc % 5 == 0), "positive").alias("label"),
        none.alias("compared_paper_id"),
        F.when(doc % 7 == 0, F.array(F.lit(" "))).otherwise(F.array(F.lit("method"))).alias("reason_codes"),
        F.array().cast("array<string>").alias("applicable_dimensions"),
        F.when(doc % 13 == 0, F.repeat(F.lit("x"), F.lit(4001))).alias("private_rationale"),
        none.alias("supersedes_event_id"), none.alias("source_item_key"))


LABEL_EVENTS_SQL = """label_events AS (
  SELECT 'l' || doc_id AS event_id, CASE WHEN toxic = 1 THEN 'unlabel' ELSE 'label' END AS kind,
    'arxiv:' || doc_id AS paper_id, CASE WHEN doc_id % 11 <> 0 THEN 'library' END AS source,
    CASE WHEN quality = 1 OR doc_id % 5 = 0 THEN 'positive' END AS label,
    doc_id % 7 = 0 AS blank_code, doc_id % 13 = 0 AS long_rationale,
    strftime(TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 20 AS INTEGER)), '%Y-%m-%d') AS day
  FROM labels)"""


@query(
    "corpus_documents",
    f"WITH {LABEL_EVENTS_SQL} SELECT event_id, kind, paper_id, source, label, day FROM label_events",
)
def corpus_documents(spark, sf_dir):
    path = _written(spark, _label_events(spark, sf_dir), "corpus-documents", "events", 1)
    return readers.read_corpus(spark, path).select(
        "event_id", "kind", "paper_id", "source", "label",
        F.date_format("occurred_at", "yyyy-MM-dd").alias("day"))


@query(
    "history_documents",
    """SELECT printf('%04d.%05d', o_orderkey // 100000, o_orderkey % 100000) AS paper_id,
    CAST(o_orderkey % 3 + 1 AS INTEGER) AS revision, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""",
)
def history_documents(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.format_string("%04d.%05d", F.floor(key / 100000), key % 100000).alias("arxiv_id"),
        (key % 3 + 1).cast("int").alias("revision"), F.col("o_orderdate").alias("published_at"))
    path = _written(spark, rows, "history-documents", "entries", 1)
    return readers.read_history(spark, path).select(
        "paper_id", "revision", F.date_format("published_at", "yyyy-MM-dd").alias("day"))


@query(
    "manifest_documents",
    """SELECT l_partkey AS candidate_count, CAST(l_linenumber AS BIGINT) AS recommendation_count,
    'm' || (l_suppkey % 3) AS model, l_extendedprice AS duration_seconds, l_orderkey AS actual_output_tokens
    FROM lineitem""",
)
def manifest_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.lit(2).alias("schema_version"),
        F.concat(F.lit("m"), (F.col("l_suppkey") % 3).cast("string")).alias("model"),
        F.col("l_partkey").alias("candidate_count"),
        F.col("l_linenumber").cast("long").alias("recommendation_count"),
        F.col("l_extendedprice").alias("duration_seconds"), F.col("l_orderkey").alias("actual_output_tokens"))
    path = _written(spark, rows, "manifest-documents", "manifests", None)
    return readers.read_manifests(spark, path).select(
        "candidate_count", "recommendation_count", "model", "duration_seconds", "actual_output_tokens")


def _weights(spark, sf_dir):
    share = lambda c: F.col(c)
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_orderkey") % 17 != 0, F.concat_ws(
            "-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))).alias("version"),
        (share("l_discount") * 6).alias("interest"), share("l_tax").alias("recency"),
        share("l_discount").alias("feedback"), share("l_tax").alias("identity"),
        F.lit(0.25).alias("scientific_quality"), F.lit(0.0).alias("reproducibility"), F.lit(0.0).alias("context"),
        (F.col("l_quantity") / 40).alias("negative_feedback_cap"), (F.col("l_partkey") % 9 == 0).alias("ablation"))


WEIGHTS_SQL = """weights AS (
  SELECT CASE WHEN l_orderkey % 17 <> 0 THEN l_orderkey || '-' || l_linenumber END AS version,
    l_discount * 6 AS interest, l_tax AS recency, l_discount AS feedback, l_quantity / 40 AS cap,
    l_partkey % 9 = 0 AS ablation FROM lineitem)"""


@query("weight_documents", f"WITH {WEIGHTS_SQL} SELECT version, interest, recency, cap, ablation FROM weights")
def weight_documents(spark, sf_dir):
    path = _written(spark, _weights(spark, sf_dir), "weight-documents", "weight_sets", 1)
    return readers.read_weight_sets(spark, path).select(
        "version", "interest", "recency", F.col("negative_feedback_cap").alias("cap"), "ablation")


@query(
    "example_documents",
    "SELECT CAST(doc_id AS VARCHAR) AS paper_id, quality = 1 AS approved, 'trait ' || (doc_id % 4) AS problem FROM labels",
)
def example_documents(spark, sf_dir):
    doc, none = F.col("doc_id"), F.array().cast("array<string>")
    rows = table(spark, sf_dir, "labels").select(
        doc.cast("string").alias("paper_id"), (F.col("quality") == 1).alias("approved"),
        F.array(F.concat(F.lit("trait "), (doc % 4).cast("string"))).alias("research_problems"),
        *[none.alias(c) for c in ("methodological_expectations", "evidence_standards", "motivations",
                                  "tolerated_limitations")])
    path = _written(spark, rows, "example-documents", "examples", 1)
    return readers.read_quality_examples(spark, path).select(
        "paper_id", "approved", F.col("research_problems")[0].alias("problem"))


@query(
    "snapshot_once",
    "SELECT CAST(doc_id AS VARCHAR) AS paper_id, CASE quality WHEN 1 THEN 'positive' ELSE 'negative' END AS label FROM labels",
)
def snapshot_once(spark, sf_dir):
    """A frozen snapshot written twice is written once, and reads back as it was (K4)."""
    rows = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("paper_id"),
        F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("label"))
    root = work_dir(spark, "snapshots")
    first = writers.write_snapshot_once(rows, root, "s1")
    if not first or writers.write_snapshot_once(rows.repartition(3), root, "s1"):
        raise ValueError("a snapshot must be written exactly once")
    return spark.read.parquet(f"{root}/snapshot_id=s1").select("paper_id", "label")


# ---- row contracts --------------------------------------------------------------------------


def _counted(rows, rules):
    """Rows by the first rule they break; kept rows count under ``kept``."""
    kept, rejects = contracts.check(rows, rules)
    counts = contracts.reject_counts(rejects).withColumnRenamed("rows", "n")
    whole = kept.agg(F.count("*").alias("n")).select(F.lit("kept").alias("reason"), "n")
    return counts.unionByName(whole)


def _counted_sql(cases, source):
    whens = " ".join(f"WHEN NOT coalesce({ok}, false) THEN '{why}'" for why, ok in cases)
    return f"SELECT CASE {whens} ELSE 'kept' END AS reason, count(*) AS n FROM {source} GROUP BY ALL"


@query(
    "contract_references",
    "WITH page AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN replace(url, 'https:', 'http:') ELSE url END AS url,"
    " CASE WHEN page_id % 7 <> 0 THEN 'T' END AS title FROM pages) " + _counted_sql([
        ("identifier is empty", "title IS NOT NULL"),
        ("link is not an HTTPS URL", "regexp_matches(url, '^https://[^/?#]+')")], "page"),
)
def contract_references(spark, sf_dir):
    page = F.col("page_id")
    url = F.when(page % 5 == 0, F.replace("url", F.lit("https:"), F.lit("http:"))).otherwise(F.col("url"))
    rows = table(spark, sf_dir, "pages").select(
        page.cast("string").alias("arxiv_id"), F.when(page % 7 != 0, "T").alias("title"),
        url.alias("abstract_url"), F.col("url").alias("pdf_url"))
    rows = rows.withColumn("pdf_url", F.col("abstract_url"))
    return _counted(rows, contracts.recommendation_reference())


@query(
    "contract_minimal_manifests",
    "WITH run AS (SELECT o_orderkey % 4 AS z, CASE WHEN o_custkey % 6 = 0 THEN 2 ELSE 1 END AS v FROM orders) "
    + _counted_sql([("time carries no zone", "z <> 0"), ("schema version is unsupported", "v = 1")], "run"),
)
def contract_minimal_manifests(spark, sf_dir):
    zone = F.element_at(F.array(*map(F.lit, ["", "Z", "+02:00", "-05:30"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), zone).alias("started_at"),
        F.when(F.col("o_custkey") % 6 == 0, 2).otherwise(1).alias("schema_version"))
    return _counted(rows, contracts.minimal_manifest())


@query(
    "contract_weight_sets",
    f"WITH {WEIGHTS_SQL} " + _counted_sql([
        ("weights are not normalized", "version IS NOT NULL AND interest <= 1 AND cap <= 1"),
        ("weights exceed one", "0.0 + interest + recency + feedback + recency + 0.25 <= 1"),
        ("interest is not the largest group", "ablation OR interest >= greatest(recency, feedback, 0.25)")], "weights"),
)
def contract_weight_sets(spark, sf_dir):
    return _counted(_weights(spark, sf_dir), contracts.weight_set())


@query(
    "contract_feedback_events",
    """WITH event AS (
      SELECT event_id, event_type AS kind, event_id % 9 AS r, event_id % 4 AS c FROM events), shaped AS (
      SELECT CASE kind WHEN 'view' THEN 'impression' WHEN 'click' THEN 'outcome' WHEN 'purchase' THEN 'correction'
          WHEN 'error' THEN 'outcome' ELSE 'other' END AS type,
        CASE WHEN kind IN ('click', 'purchase') OR r = 1 THEN CASE WHEN r = 2 THEN 'loved' ELSE 'interested' END END AS outcome,
        CASE WHEN r <> 3 THEN 'b' END AS batch, CASE WHEN kind = 'view' OR r = 4 THEN 1 END AS rank,
        CASE WHEN r > 4 THEN 'e1' END AS old, c, r FROM event) """ + _counted_sql([
        ("identifier is empty", "r <> 0"),
        ("event type is unknown", "type <> 'other'"),
        ("outcome is unknown", "outcome IS NULL OR outcome = 'interested'"),
        ("impression shape is invalid", "type <> 'impression' OR (batch IS NOT NULL AND rank IS NOT NULL AND outcome IS NULL)"),
        ("outcome shape is invalid", "type <> 'outcome' OR (outcome IS NOT NULL AND rank IS NULL)"),
        ("correction shape is invalid", "type <> 'correction' OR (outcome IS NOT NULL AND old IS NOT NULL)"),
        ("reason codes are invalid", "c <> 0")], "shaped"),
)
def contract_feedback_events(spark, sf_dir):
    kind, r, c = F.col("event_type"), F.col("event_id") % 9, F.col("event_id") % 4
    code = F.when(c == 0, "no-such-code").otherwise("incremental")
    rows = table(spark, sf_dir, "events").select(
        F.when(r != 0, F.col("event_id").cast("string")).alias("event_id"), F.lit("p").alias("paper_id"),
        F.when(kind == "view", "impression").when(kind.isin("click", "error"), "outcome")
        .when(kind == "purchase", "correction").otherwise("other").alias("event_type"),
        F.col("ts").alias("occurred_at"),
        F.when(kind.isin("click", "purchase") | (r == 1), F.when(r == 2, "loved").otherwise("interested")).alias("outcome"),
        F.when(r != 3, "b").alias("batch_id"), F.when((kind == "view") | (r == 4), 1).alias("displayed_rank"),
        F.array(code).alias("reason_codes"), F.when(r > 4, "e1").alias("supersedes_event_id"))
    return _counted(rows, contracts.feedback_event())


@query(
    "contract_corpus_events",
    f"WITH {LABEL_EVENTS_SQL} " + _counted_sql([
        ("identifier is empty", "source IS NOT NULL"), ("codes are invalid", "NOT blank_code"),
        ("rationale is too long", "NOT long_rationale"), ("label is missing", "kind <> 'label' OR label IS NOT NULL"),
        ("unlabel carries a judgment", "kind <> 'unlabel' OR label IS NULL")], "label_events"),
)
def contract_corpus_events(spark, sf_dir):
    return _counted(_label_events(spark, sf_dir), contracts.corpus_event())


@query(
    "contract_model_usage",
    "WITH turn AS (SELECT conv_id, turn, trim(text) <> '' AS filled, CASE WHEN conv_id % 10 = 0 THEN -1 ELSE turn END AS i,"
    " CASE WHEN conv_id % 7 = 0 THEN -0.5 WHEN conv_id % 3 = 0 THEN 1.5 END AS s FROM conversations) " + _counted_sql([
        ("content is empty", "filled"), ("token usage is negative", "i >= 0"),
        ("latency is negative", "s IS NULL OR s >= 0")], "turn"),
)
def contract_model_usage(spark, sf_dir):
    conv = F.col("conv_id")
    rows = table(spark, sf_dir, "conversations").select(
        F.col("text").alias("content"), F.when(conv % 10 == 0, -1).otherwise(F.col("turn")).alias("input_tokens"),
        F.lit(None).cast("long").alias("output_tokens"),
        F.when(conv % 7 == 0, -0.5).when(conv % 3 == 0, 1.5).alias("latency_seconds"))
    return _counted(rows, contracts.model_usage())
