"""WARC archives: pages written as records, equal payloads as revisits, and read back in splits.

Written by Spark's text writer with the record separator as line end, so archives are plain WARC
files in any store. Read by its text source with the version line as line end, which cuts archives
at every place where a record may begin, in splits of any size.

Such a place may also lie inside a payload. Each split's tasks emit candidates, ``offset ->
successor`` by the declared length. Neighbours whose successor is the next candidate form a run;
runs point to the run their last record leads to. Pointer jumping from the start of each file
doubles the reach per round and keeps the runs on the chain from the first byte; a record stays if
its run is reached and it does not stand before the run's point of entry. Version lines inside
payloads are never reached. Only lengths and header fields are shuffled; a record that was cut
inside is put together again by a second read of its parts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import table
from folioscope.session import materialized, work_dir

NAME = "op6_warc"
#: Shorter payloads are always written in full.
LEAST_REVISIT_BYTES = 100
#: Page ids are broadcast up to so many rows; beyond it they are shuffled.
BROADCAST_ROWS = 1_000_000

#: Fixed values of the WARC 1.0 format and of the records written here.
MAGIC = "WARC/1.0\r\n"
RECORD_END = "\r\n\r\n"
RECORD_DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8"


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcast only where a count says it is small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def revisits(pages: DataFrame, least: int) -> DataFrame:
    """``(page_id, digest, refers_to)`` for pages whose payload a smaller page_id already has."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    seen = materialized(pages.select(
        "page_id", F.sha2(payload.cast("binary"), 256).alias("digest"),
        F.octet_length(payload).alias("bytes")), "warc-digests")
    heads = seen.filter(F.col("bytes") >= least).groupBy("digest").agg(
        F.min("page_id").alias("refers_to"), F.count("*").alias("rows")).filter("rows > 1")
    return materialized(
        seen.join(heads, "digest").filter("page_id <> refers_to")
        .select("page_id", "digest", "refers_to").distinct(), "warc-revisits")


def write_archive(
    pages: DataFrame, folder: str, least: int = LEAST_REVISIT_BYTES, id_column: str = "page_id",
    url: str = "url", html: str = "html",
) -> None:
    """One record per row: a response with the payload, or a revisit without it.

    Null payloads are empty, a null url has no target field, line ends in urls are escaped. Rows
    that repeat the smallest id of a payload are all responses; so is a row without an id. An empty
    table leaves an empty folder. Other columns are not read.
    """
    rows = pages.select(
        F.col(id_column).cast("long").alias("page_id"), F.col(url).alias("url"),
        F.coalesce(F.col(html), F.lit("")).alias("html"))
    digest = F.sha2(F.col("html").cast("binary"), 256)
    known = few(revisits(rows, least))
    decided = rows.withColumn("digest", digest).join(known, ["page_id", "digest"], "left")
    again = F.col("refers_to").isNotNull()
    http = F.lit(HTTP_HEAD + "\r\n\r\n")
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    safe = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit(MAGIC), _field("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _field("WARC-Record-ID", F.coalesce(name(F.col("page_id")), F.lit("<urn:page:none>"))),
        F.coalesce(_field("WARC-Target-URI", safe), F.lit("")),
        _field("WARC-Date", F.lit(RECORD_DATE)),
        F.coalesce(_field("WARC-Refers-To", name(F.col("refers_to"))), F.lit("")),
        F.when(again, F.lit(f"WARC-Profile: {REVISIT_PROFILE}\r\n")).otherwise(""),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        _field("Content-Type", F.lit("application/http;msgtype=response")),
        _field("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"))
    decided.select(F.concat(head, block)).write.option("lineSep", RECORD_END).text(folder)


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    """What lies between version lines: its file, split, number there (not yet from 0) and text."""
    return spark.read.option("lineSep", MAGIC).text(folder).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"), F.col("value"))


def _record_fields(value: Column) -> dict[str, Column]:
    """Header fields of a segment as a record, null where it can't be one."""
    head = F.substring_index(value, "\r\n\r\n", 1)
    whole = F.octet_length(head) < F.octet_length(value)
    field = lambda name: F.nullif(
        F.regexp_extract(head, rf"(?mi)^{name}: *([^\r\n]*)", 1), F.lit(""))
    length = F.expr("try_cast(_length as bigint)")
    return {
        "_head": F.when(whole, F.octet_length(head)), "_length": F.when(whole, field("Content-Length")),
        "content": length, "type": field("WARC-Type"), "record_id": field("WARC-Record-ID"),
        "target_uri": field("WARC-Target-URI"), "refers_to": field("WARC-Refers-To"),
        "digest": field("WARC-Payload-Digest"),
    }


def _payload(raw: Column, head: Column, content: Column) -> Column:
    """A record's payload: its block without the HTTP head. ``raw`` starts behind the version line."""
    block = F.substring(raw, head.cast("int") + 5, content.cast("int"))
    http = F.octet_length(F.substring_index(block.cast("string"), "\r\n\r\n", 1))
    return F.substring(block, http + 5, content.cast("int"))


def scan_candidates(spark: SparkSession, folder: str, derive: dict) -> DataFrame:
    """A row per segment: where it stands, how long it is, its fields as a record, and what
    ``derive`` makes of its payload if the record ends where the segment does."""
    marked = _segments(spark, folder)
    for name, column in _record_fields(F.col("value")).items():
        marked = marked.withColumn(name, column)
    size = F.octet_length("value")
    whole = F.coalesce(F.col("_head") + 4 + F.col("content") + len(RECORD_END) == size, F.lit(False))
    payload = _payload(F.col("value").cast("binary"), F.col("_head"), F.col("content"))
    return marked.select(
        "file", "split", "at", size.cast("long").alias("size"),
        (len(MAGIC) + F.col("_head") + 4 + F.col("content") + len(RECORD_END)).cast("long").alias("reach"),
        F.col("_head").alias("head"), "content", "type", "record_id", "target_uri", "refers_to", "digest",
        whole.alias("whole"),
        *[F.when(whole, make(payload)).alias(name) for name, make in derive.items()],
    )


def with_offsets(segments: DataFrame) -> DataFrame:
    """Adds ``offset``, the place of the version line in front of each segment, by a prefix sum
    inside splits and over the splits of a file; the empty start of a file leaves."""
    taken = F.col("size") + len(MAGIC)
    inside = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    sums = segments.groupBy("file", "split").agg(F.sum(taken).alias("_sum"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select("file", "split", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_begin"))
    placed = segments.withColumn("_inside", F.coalesce(F.sum(taken).over(inside), F.lit(0)))
    return placed.join(begins, ["file", "split"]).withColumn(
        "offset", F.col("_begin") + F.col("_inside") - len(MAGIC)).drop("_begin", "_inside")


def reachable(candidates: DataFrame) -> DataFrame:
    """The candidates on the chain from the start of their file (``file, offset, size, reach``)."""
    by_file = Window.partitionBy("file").orderBy("offset")
    follows = F.lag(F.col("offset") + F.col("reach")).over(by_file) == F.col("offset")
    marked = candidates.select("file", "offset", "size", "reach").withColumn(
        "_new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1))
    running = by_file.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = materialized(marked.withColumn("run", F.sum("_new").over(running)), "warc-runs")
    ends = marked.groupBy("file", "run").agg(
        F.max_by(F.col("offset") + F.col("reach"), "offset").alias("exit"))
    pointer = ends.join(
        marked.select("file", F.col("offset").alias("exit"), F.col("run").alias("next")), ["file", "exit"]
    ).select("file", "run", "next", F.col("exit").alias("entry"))
    jump = materialized(pointer, "warc-pointers")
    reached = marked.filter("offset = 0").select("file", "run", F.col("offset").alias("entry"))
    most = marked.agg(F.max("run")).first()[0] or 1
    for _ in range(math.ceil(math.log2(most))):
        more = reached.select("file", "run").join(jump, ["file", "run"]).select(
            "file", F.col("next").alias("run"), "entry")
        reached = materialized(reached.unionByName(more), "warc-reached")
        onward = jump.select("file", F.col("run").alias("next"), F.col("next").alias("n2"),
                             F.col("entry").alias("e2"))
        jump = materialized(jump.join(onward, ["file", "next"]).select(
            "file", "run", F.col("n2").alias("next"), F.col("e2").alias("entry")), "warc-pointers")
    kept = marked.join(reached, ["file", "run"]).filter("offset >= entry")
    kept = materialized(kept.select("file", "offset", "reach"), "warc-kept")
    size = candidates.groupBy("file").agg(F.max(F.col("offset") + F.col("size") + len(MAGIC)).alias("_size"))
    last = kept.groupBy("file").agg(F.max(F.col("offset") + F.col("reach")).alias("_end"))
    broken = size.join(last, "file", "left").filter(~F.col("_end").eqNullSafe(F.col("_size"))).count()
    if broken:
        raise ValueError(f"{broken} archives have no chain of records from first to last byte")
    return kept


def read_archive(spark: SparkSession, folder: str, derive: dict | None = None) -> DataFrame:
    """``(file, offset, type, record_id, target_uri, refers_to, digest, ...)`` for all records.

    ``derive`` names columns made from the payload (bytes); without it the payload itself comes. It
    is applied where the payload is read, so that payloads need not travel. An archive whose chain
    breaks off is an error; a folder without records gives none.
    """
    derive = derive or {"payload": lambda payload: payload}
    segments = materialized(scan_candidates(spark, folder, derive), "warc-segments")
    placed = materialized(with_offsets(segments), "warc-candidates")
    candidates = placed.filter("offset >= 0")
    kept = reachable(candidates)
    records = candidates.join(kept.select("file", "offset"), ["file", "offset"])
    names = ["file", "offset", "type", "record_id", "target_uri", "refers_to", "digest"]
    plain = records.filter("whole").select(*names, *derive)
    cut = materialized(records.filter("not whole").select(*names, "head", "content", "reach"), "warc-cut")
    if not cut.limit(1).count():
        return plain
    # Parts of a record that holds version lines: read again, put together in order.
    spans = cut.select("file", F.col("offset").alias("record"), (F.col("offset") + F.col("reach")).alias("_end"))
    parts = placed.join(spans, "file").filter(
        (F.col("offset") >= F.col("record")) & (F.col("offset") < F.col("_end")))
    first = segments.groupBy("file", "split").agg(F.min("at").alias("_first"))
    wanted = materialized(parts.join(first, ["file", "split"]).select(
        "file", "split", (F.col("at") - F.col("_first")).alias("nth"), "record", "offset"), "warc-parts")
    again = _segments(spark, folder)
    begins = again.groupBy("file", "split").agg(F.min("at").alias("_first"))
    texts = again.join(begins, ["file", "split"]).withColumn("nth", F.col("at") - F.col("_first"))
    found = texts.join(few(wanted), ["file", "split", "nth"])
    joined = found.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("_parts"))
    raw = F.array_join(F.transform("_parts", lambda p: p["value"]), MAGIC).cast("binary")
    whole = cut.join(joined.select("file", F.col("record").alias("offset"), raw.alias("_raw")), ["file", "offset"])
    payload = _payload(F.col("_raw"), F.col("head"), F.col("content"))
    return plain.unionByName(whole.select(*names, *[make(payload).alias(n) for n, make in derive.items()]))


def run_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages, read the archives, and say per page what its record holds or refers to."""
    folder = work_dir(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), folder)
    found = materialized(read_archive(spark, folder, {
        "payload_bytes": lambda p: F.length(p).cast("long"),
        "payload_digest": lambda p: F.sha2(p, 256),
    }), "warc-records")
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, 'urn:page:(-?[0-9]+)', 1) as bigint)")
    rows = found.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest",
        F.col("type").alias("record_type"), page("refers_to").alias("refers_to"))
    plain = rows.filter("record_type = 'response'")
    whole = plain.filter("page_id is not null").groupBy(F.col("page_id").alias("refers_to"), F.concat(
        F.lit("sha256:"), F.col("payload_digest")).alias("digest")).agg(
        F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest"))
    again = found.filter("type = 'revisit'").select(
        page("record_id").alias("page_id"), "digest", page("refers_to").alias("refers_to"))
    revisited = again.join(whole, ["refers_to", "digest"]).select(
        "page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    return plain.unionByName(revisited)


SQL = """
WITH page AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
    sha256(coalesce(html, '')) AS payload_digest FROM pages),
head AS (SELECT payload_digest, min(page_id) AS head FROM page WHERE payload_bytes >= 100 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN head <> page_id THEN head END AS refers_to
FROM page LEFT JOIN head USING (payload_digest)
"""
