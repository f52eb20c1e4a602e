"""Structured Streaming jobs over the same operators.

The bounded pool is a versioned table that every micro-batch merges into. Ledgers only grow, so a batch
appends its new rows and nothing is rewritten. Running labels, the suppression history and the attribution
of outcomes live in Spark's own state store; what changed in a batch is appended. A batch's folder carries its id, so a replay overwrites its
own rows and writes nothing twice; the pointer that makes it visible moves last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.moments import days_before, instant
from folioscope.operators import corpus, ledger, pool, scale
from folioscope.session import materialized
from folioscope.sources import ledgers, writers


def file_stream(
    spark: SparkSession, folder: str, schema, name: str | None = None, per_trigger: int = 100
):
    """A growing folder of Parquet files as a stream; ``name`` keeps files of that name only."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    if name is not None:
        reader = reader.option("pathGlobFilter", name)
    return reader.parquet(folder)


def table_stream(spark: SparkSession, folder: str, table: str, per_trigger: int = 100):
    """A Parquet table as a stream of its files, be it one file in ``folder`` or a folder there."""
    path = f"{folder}/{table}"
    stored = spark.read.parquet(path)
    single = any(file.endswith(f"/{table}") for file in stored.inputFiles()[:1])
    if single:
        return file_stream(spark, folder, stored.schema, table, per_trigger)
    return file_stream(spark, path, stored.schema, None, per_trigger)


def _or_empty(rows: DataFrame | None, spark: SparkSession, schema) -> DataFrame:
    """A table nothing has arrived in yet has its columns and no rows."""
    return spark.createDataFrame([], schema) if rows is None else rows


def _write_batch(rows: DataFrame, root: str, batch_id: int, parts: Sequence[str] = ()) -> None:
    version = f"{batch_id:020d}"
    rows.write.mode("overwrite").partitionBy(*parts).parquet(f"{root}/data/version={version}")
    pointer = rows.sparkSession.range(1).select(
        F.lit(version).alias("version"), F.current_timestamp().alias("committed_at")
    )
    pointer.write.mode("append").parquet(f"{root}/pointer")


def _is_done(spark: SparkSession, root: str, batch_id: int) -> bool:
    return (writers.current_version(spark, root) or "") >= f"{batch_id:020d}"


def _run(stream: DataFrame, root: str, body, mode: str = "append") -> None:
    query = (
        stream.writeStream.foreachBatch(body)
        .outputMode(mode)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_merging(stream: DataFrame, root: str, merge) -> DataFrame:
    """Merge every available batch into a small versioned table and return it."""

    def body(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not _is_done(spark, root, batch_id):
            _write_batch(merge(writers.read_current(spark, root), batch), root, batch_id)

    _run(stream, root, body)
    spark = stream.sparkSession
    return _or_empty(writers.read_current(spark, root), spark, stream.schema)


def read_appended(spark: SparkSession, root: str) -> DataFrame | None:
    """Rows of every visible batch, with their ``version``."""
    newest = writers.current_version(spark, root)
    if newest is None:
        return None
    return (
        spark.read.option("basePath", f"{root}/data")
        .parquet(f"{root}/data")
        .withColumn("version", F.lpad(F.col("version").cast("string"), 20, "0"))
        .filter(F.col("version") <= newest)
    )


def run_appending(
    stream: DataFrame, root: str, new_rows, mode: str = "append", columns=None, parts: Sequence[str] = ()
) -> DataFrame:
    """Append what ``new_rows(table so far, batch)`` finds in every available batch.

    ``columns`` is the schema of the new rows where it is not the stream's; ``parts`` are the columns whose
    values get a folder each.
    """

    def body(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not _is_done(spark, root, batch_id):
            _write_batch(new_rows(read_appended(spark, root), batch), root, batch_id, parts)

    _run(stream, root, body, mode)
    spark = stream.sparkSession
    schema = (stream.schema if columns is None else columns).add("version", "string")
    return _or_empty(read_appended(spark, root), spark, schema)


def ingest_candidates(
    stream: DataFrame, root: str, completed_at, *, retention_days=pool.RETENTION_DAYS,
    limit: int | None = pool.POOL_LIMIT,
) -> DataFrame:
    """Newest revision per paper within retention, newest ``limit`` kept (G1).

    The stream's own checkpoint replaces a re-read overlap window.
    """

    def merge(existing, batch):
        if existing is None:
            existing = batch.limit(0)
        return pool.merge_pool(
            existing, batch, completed_at, retention_days=retention_days, limit=limit
        )

    return run_merging(stream, root, merge)


def ingest_events(stream: DataFrame, root: str) -> DataFrame:
    """Exactly-once ledger by event id; a changed event under a known id fails the batch.

    However late an event arrives, it is kept: the ledger itself knows which ids it has, and a batch opens only
    the parts of the ledger that its ids may be in (``sources.ledgers``).
    """

    def body(batch: DataFrame, batch_id: int) -> None:
        ledgers.append(batch, root, f"{batch_id:020d}")

    _run(stream, root, body)
    return ledgers.read(stream.sparkSession, root, stream.schema)


def track_history(stream: DataFrame, root: str, now) -> DataFrame:
    """Latest publication per paper, expired after thirty days.

    The state store keeps the latest publication of a paper and day, and drops days that the watermark
    leaves thirty days behind. A trigger appends the papers that changed, in a folder per day, so
    expired days are not even read. Days count up to ``now``, so a date in the future expires nothing.
    """
    rest = [c for c in stream.columns if c != "paper_id"]
    seen = stream.withColumn("_seen", F.least("published_at", instant(now)))
    running = (
        seen.withWatermark("_seen", f"{pool.HISTORY_DAYS} days")
        .groupBy("paper_id", F.window("_seen", "1 day").alias("_window"))
        .agg(F.max_by(F.struct(*rest), F.struct("published_at", *[c for c in rest if c != "published_at"])).alias("_row"))
    )
    day = F.to_date("_window.start").alias("day")
    changed = run_appending(
        running, root, lambda so_far, batch: batch.select("paper_id", "_row.*", day), mode="update",
        columns=T.StructType([*stream.select("paper_id", *rest).schema, T.StructField("day", T.DateType())]), parts=["day"],
    )
    oldest = days_before(instant(now), pool.HISTORY_DAYS)
    alive = changed.filter((F.col("day") >= F.to_date(oldest)) & (F.col("published_at") >= oldest))
    return scale.latest_by(alive, ["paper_id"], [F.col("published_at"), F.col("version")]).select(*stream.columns)


_NO_PAPER = "\0"
#: A store that keeps its rows outside the heap.
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_MARK = "struct<impression_at:timestamp,impression_id:string,displayed_rank:int>"
_CHANGES = f"""paper_id string, slice date, event_id string, batch_id string, outcome string, at timestamp,
  same {_MARK}, any {_MARK}, last {_MARK}"""


def _slices(touched: DataFrame) -> DataFrame:
    """Events of each touched paper and day, once by their ids, with what the slice knows.

    An outcome has the latest impression of the same batch, and of any, within the slice; the last
    impression of a batch is ``last``, which later slices need. Other impressions are left out.
    """
    key = ["paper_id", "slice"]
    sent = touched.repartition(*key).select(*key, F.inline("events"))
    once = sent.groupBy(*key, "event_id", "shown").agg(
        F.max(F.struct("at", "batch_id", "outcome", "displayed_rank")).alias("_e")).select(
        *key, "event_id", "shown", "_e.*")
    mark = F.when(F.col("shown") & F.col("at").isNotNull(), F.struct(
        F.col("at").alias("impression_at"), F.col("event_id").alias("impression_id"), "displayed_rank"))
    batch = Window.partitionBy(*key, "batch_id")
    # Without one of its own batch here, an earlier slice may still have it: both are returned.
    seen = once.withColumn("_mark", mark).withColumns({
        "any": F.max("_mark").over(Window.partitionBy(*key).orderBy("at")),
        "same": F.when(F.col("batch_id").isNotNull(), F.max("_mark").over(batch.orderBy("at"))),
        "_last": F.max("_mark").over(batch)})
    names = [f.name for f in T._parse_datatype_string(_CHANGES)]
    last = F.when(F.col("_mark") == F.col("_last"), F.col("_mark"))
    return seen.withColumn("last", last).filter(
        F.col("outcome").isNotNull() | F.col("last").isNotNull()).select(*names)


def attribute_stream(stream: DataFrame, root: str) -> DataFrame:
    """Effective outcomes with the latest earlier impression, kept up to date in state.

    State is keyed by paper and day, so a batch works on the slices it touches and a paper of any
    size is spread over its days. A slice's last impressions are carried to later slices when the result
    is read, and corrections take their targets back there: neither touches an old slice. However late an
    event arrives, it counts; an event sent again is kept once. Where ids may come back with other
    values, let ``ingest_events`` refuse them first.
    """
    spark = stream.sparkSession
    corrections = f"{root}/corrections"
    shown = F.coalesce(F.col("event_type") == "impression", F.lit(False))
    rows = stream.filter(shown | F.col("outcome").isNotNull()).select(
        F.coalesce("paper_id", F.lit(_NO_PAPER)).alias("paper_id"), F.to_date("occurred_at").alias("slice"),
        F.struct(
            "event_id", shown.alias("shown"), F.col("occurred_at").alias("at"), "batch_id", "outcome",
            F.when(shown, F.col("displayed_rank").cast("int")).alias("displayed_rank")).alias("event"),
    )
    touched = rows.groupBy("paper_id", "slice").agg(F.collect_set("event").alias("events"))
    schema = T._parse_datatype_string(_CHANGES)
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        changes = run_appending(touched, root, lambda so_far, batch: _slices(batch), mode="update", columns=schema)
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
    taken = stream.filter(F.col("supersedes_event_id").isNotNull()).select(F.col("supersedes_event_id").alias("event_id"))
    gone = run_appending(taken, corrections, lambda so_far, batch: batch.distinct())
    return _resolved(changes, gone.select("event_id").distinct())


def _resolved(changes: DataFrame, gone: DataFrame) -> DataFrame:
    """Outcomes of the newest state of each slice, with what earlier slices carry."""
    newest = changes.groupBy(F.col("paper_id").alias("_p"), F.col("slice").alias("_s")).agg(F.max("version").alias("_v"))
    current = materialized(changes.join(newest, (F.col("paper_id") == F.col("_p")) & F.col("slice").eqNullSafe(F.col("_s")) & (
        F.col("version") == F.col("_v"))).drop("_p", "_s", "_v", "version"), "slices")
    # One row per paper, batch and day, so the windows grow with the days, not with the events.
    per_batch = current.groupBy("paper_id", "batch_id", "slice").agg(F.max("last").alias("_mark"))
    per_paper = per_batch.groupBy("paper_id", "slice").agg(F.max("_mark").alias("_mark"))
    before = lambda *keys: F.max("_mark").over(
        Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    same = per_batch.filter(F.col("batch_id").isNotNull()).withColumn("_same0", before("paper_id", "batch_id")).drop("_mark")
    latest = per_paper.withColumn("_any0", before("paper_id")).drop("_mark")
    said = current.filter(F.col("outcome").isNotNull()).select("paper_id", "slice", "event_id", "batch_id", "outcome", "at", "same", "any")
    joined = said.join(latest, ["paper_id", "slice"], "left").join(same, ["paper_id", "batch_id", "slice"], "left")
    hit = F.coalesce("same", "_same0", "any", "_any0")
    return joined.join(gone, "event_id", "left_anti").withColumn("_hit", hit).select(
        "event_id", F.nullif("paper_id", F.lit(_NO_PAPER)).alias("paper_id"), "batch_id", "outcome",
        F.col("at").alias("occurred_at"), "_hit.impression_id", "_hit.displayed_rank")


def attribute_in_window(impressions: DataFrame, outcomes: DataFrame, delay: str, horizon: str):
    """Stream-stream form of G4 with a time bound: every earlier impression within ``horizon``.

    State is bounded by the watermark and the horizon; take the latest pair per outcome downstream.
    """
    shown = impressions.withWatermark("shown_at", delay)
    spoken = outcomes.withWatermark("occurred_at", delay)
    return spoken.join(
        shown.withColumnRenamed("paper_id", "shown_paper"),
        F.expr(
            "paper_id = shown_paper AND shown_at <= occurred_at AND "
            f"shown_at >= occurred_at - INTERVAL {horizon}"
        ),
    )


def latest_labels(stream: DataFrame, root: str, cutoff) -> DataFrame:
    """Latest label event per paper as of a cutoff.

    A streaming aggregate keeps one row per paper in the state store; each trigger appends only
    the papers that changed.
    """
    judged = corpus.at_cutoff(stream, cutoff).filter(F.col("kind") != "pairwise")
    rest = [c for c in stream.columns if c != "paper_id"]
    running = judged.groupBy("paper_id").agg(
        F.max_by(F.struct(*rest), F.struct("occurred_at", "event_id")).alias("_row")
    )
    flat = judged.select("paper_id", *rest).schema
    changed = run_appending(
        running, root, lambda so_far, batch: batch.select("paper_id", "_row.*"), mode="update",
        columns=flat,
    )
    newest = scale.latest_by(changed, ["paper_id"], [F.col("version")])
    return newest.filter(F.col("kind") == "label").select(*stream.columns)
