"""Scans of the documents a reader of papers already has, one file per document.

Every document kind has a declared schema and one reader for all its versions; older versions get
their defaults by name. Files are read in parallel and exploded at once, so a folder of many
documents is one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import schemas
from folioscope.functions import identity, moments, text
from folioscope.operators import contracts, library, profile
from folioscope.operators.quality import POLICIES

# ---- fixed values -------------------------------------------------------------------------
AFFILIATIONS, AFFILIATION_BYTES = 32, 256
POOL_VERSIONS = [1, 2, 3, 4]
PROFILE_VERSIONS = [1, 2, 3, 4]
LEDGER_VERSIONS = [1, 2]
PUBLISHED_VERSIONS = [1, 2, 3, 4, 5]
# -------------------------------------------------------------------------------------------


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _supported(df: DataFrame, versions: list[int], what: str) -> DataFrame:
    version = F.coalesce("schema_version", F.lit(1))
    message = F.concat(F.lit(f"unsupported {what} schema "), version.cast("string"))
    known = F.when(version.isin(versions), True).otherwise(F.raise_error(message).cast("boolean"))
    return df.withColumn("schema_version", version).filter(known)


def _strings() -> Column:
    return F.array().cast("array<string>")


def read_feed(spark: SparkSession, path: str, fail_fast: bool = False):
    """Atom entries as candidates, and the entries that break the contract."""
    raw = (
        spark.read.format("xml")
        .option("rowTag", "entry")
        .option("ignoreNamespace", True)
        .schema(schemas.ATOM_ENTRY)
        .load(path)
    )
    tail = F.element_at(F.split("id", "/"), -1)
    places = F.filter(
        F.flatten(
            F.transform("author", lambda a: F.coalesce(a["affiliation"], _strings()))
        ),
        lambda v: F.trim(v) != "",
    )
    rows = raw.select(
        identity.paper_id(tail).alias("paper_id"),
        identity.revision(tail).alias("revision"),
        text.collapse_space(F.col("title")).alias("title"),
        F.transform("author", lambda a: text.collapse_space(a["name"])).alias("authors"),
        F.array_sort(
            F.array_distinct(
                F.filter(F.transform("category", lambda c: c["_term"]), lambda c: c.isNotNull())
            )
        ).alias("categories"),
        moments.parse_instant(F.trim("published")).alias("published"),
        moments.parse_instant(F.trim("updated")).alias("updated"),
        text.collapse_space(F.col("summary")).alias("summary"),
        F.array_distinct(F.transform(F.coalesce(places, _strings()), text.collapse_space)).alias(
            "affiliations"
        ),
        F.nullif(F.trim("doi"), F.lit("")).alias("_doi"),
    )
    valid, rejects = contracts.check(
        rows.withColumn("doi", identity.doi(F.col("_doi"))),
        {
            "identifier is malformed": F.col("paper_id").isNotNull(),
            "categories are missing": F.size("categories") > 0,
            "required text is missing": contracts.filled("title") & contracts.filled("summary")
            & F.forall("authors", lambda a: a.isNotNull() & (a != "")),
            "time is invalid": F.col("published").isNotNull() & F.col("updated").isNotNull(),
            "affiliation is invalid": F.forall(
                "affiliations", lambda a: F.octet_length(a) <= AFFILIATION_BYTES
            ),
            "too many affiliations": F.size("affiliations") <= AFFILIATIONS,
            "DOI is invalid": F.col("_doi").isNull() | F.col("doi").isNotNull(),
        },
        fail_fast=fail_fast,
    )
    return _with_urls(valid.drop("_doi")), rejects


def _with_urls(df: DataFrame) -> DataFrame:
    return df.withColumn("abstract_url", identity.abstract_url(F.col("paper_id"))).withColumn(
        "pdf_url", identity.pdf_url(F.col("paper_id"))
    )


def read_library_items(spark: SparkSession, path: str) -> DataFrame:
    """Raw item records, one JSON object per line, as normalized items."""
    raw = spark.read.schema(schemas.RAW_ITEM).json(path)
    return library.normalized_items(raw, text.html_to_texts)


def read_library_collections(spark: SparkSession, path: str) -> DataFrame:
    """Raw collection records, one JSON object per line (S3)."""
    raw = spark.read.schema(schemas.RAW_COLLECTION).json(path)
    return raw.select(
        F.coalesce("key", "data.key").alias("key"),
        F.coalesce("version", "data.version", F.lit(0)).cast("long").alias("version"),
        text.html_to_text(F.col("data.name")).alias("name"),
        F.nullif("data.parentCollection", F.lit("")).alias("parent_key"),
    )


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """Candidate pools of any version; identifiers and links are rebuilt."""
    docs = _supported(_documents(spark, path, schemas.POOL), POOL_VERSIONS, "pool")
    rows = docs.select(F.explode("candidates").alias("c")).select("c.*")
    key = identity.paper_id(F.col("arxiv_id"))
    return _with_urls(
        rows.select(
            F.coalesce(key, F.raise_error(F.lit("pool holds a malformed identifier"))).alias("paper_id"),
            F.coalesce("revision", identity.revision(F.col("arxiv_id"))).alias("revision"),
            "title", "authors", "categories",
            moments.parse_instant(F.col("published")).alias("published"),
            moments.parse_instant(F.col("updated")).alias("updated"),
            "summary",
            F.coalesce("affiliations", _strings()).alias("affiliations"),
            identity.doi(F.col("doi")).alias("doi"),
        )
    )


def read_pool_state(spark: SparkSession, path: str) -> DataFrame:
    """Checkpoint and degraded flags of each pool document."""
    docs = _documents(spark, path, schemas.POOL)
    at = lambda c: moments.parse_instant(F.col(c)).alias(c)
    return docs.select(
        at("checkpoint"), at("in_progress"), F.coalesce("degraded", F.lit(False)).alias("degraded"),
        "degraded_reason", at("degraded_source_checkpoint"),
    )


def read_seen_ids(spark: SparkSession, path: str) -> DataFrame:
    docs = _documents(spark, path, schemas.POOL)
    return docs.select(F.explode("seen_ids").alias("paper_id")).distinct()


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Exported profiles of any version; the file name is the profile."""
    docs = _supported(
        _documents(spark, path, schemas.PROFILE).withColumn("_file", F.input_file_name()),
        PROFILE_VERSIONS, "profile",
    )
    none = F.array()
    paper = F.from_json(F.lit("[]"), "array<string>")
    return docs.select(
        F.regexp_extract("_file", r"([^/]+?)(?:\.json)?$", 1).alias("profile_id"),
        "schema_version", "source_library_version", "topics", "core_categories",
        "adjacent_categories", "representative_terms",
        F.coalesce("representative_papers", paper).alias("representative_papers"),
        F.coalesce("watched_authors", none.cast(f"array<{_ddl(schemas.IDENTITY)}>")).alias("watched_authors"),
        F.coalesce("watched_institutions", none.cast(f"array<{_ddl(schemas.IDENTITY)}>")).alias("watched_institutions"),
        "source_library_synced_at",
        F.coalesce("preference_facets", none.cast(f"array<{_ddl(schemas.FACET)}>")).alias("preference_facets"),
    )


def read_remote_profiles(
    spark: SparkSession, path: str, budget: int = profile.PAYLOAD_BUDGET, fit: bool = False
) -> DataFrame:
    """Exported profiles of any version as payloads of today's version.

    A profile over the byte budget stops the read, or is cut to the longest prefixes of its lists
    that fit. The profile's name is beside the payload, not part of it.
    """
    projected = profile.reproject(read_profiles(spark, path))
    if fit:
        return profile.fit_budget(projected, budget, beside=["profile_id"])
    body = [c for c in projected.columns if c != "profile_id"]
    small = F.when(F.octet_length(F.to_json(F.struct(*body))) <= budget, F.lit(True)).otherwise(
        F.raise_error(F.concat_ws(" ", F.lit("profile over its byte budget:"), "profile_id")).cast("boolean")
    )
    return profile.fit_budget(projected.filter(small), budget, beside=["profile_id"])


def _ddl(struct: str) -> str:
    """A struct schema in the colon form that casts take."""
    inside = struct.removeprefix("struct<").removesuffix(">")
    return "struct<" + ",".join(":".join(f.split()) for f in inside.split(", ")) + ">"


def parse_submissions(submissions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reader submissions as outcome events, all or nothing per submission.

    ``submissions``: ``number``, ``body``. A body has exactly a version and at most a hundred
    actions of exact keys, one per paper.
    """
    from folioscope.operators.ledger import ACTIONS_PER_SUBMISSION, SUBMITTED_ACTIONS

    body = F.col("body")
    entries = F.from_json(F.get_json_object(body, "$.feedback"), "array<string>")
    actions = F.transform("_e", lambda e: F.from_json(e, schemas.ACTION))
    rows = submissions.withColumn("_e", entries).withColumn("_a", actions)
    keys = F.array(*map(F.lit, ("action", "arxiv_id", "updated_at")))
    papers = F.transform("_a", lambda a: a["arxiv_id"])
    valid, rejects = contracts.check(
        rows,
        {
            "number is invalid": F.col("number") >= 1,
            "fields are unsupported": F.array_sort(F.json_object_keys(body))
            == F.array(F.lit("feedback"), F.lit("schema_version")),
            "version is unsupported": F.get_json_object(body, "$.schema_version") == "1",
            "too many actions": F.size("_e") <= ACTIONS_PER_SUBMISSION,
            "action fields are unsupported": F.forall(
                "_e", lambda e: F.array_sort(F.json_object_keys(e)) == keys
            ),
            "papers repeat": F.size(F.array_distinct(papers)) == F.size(papers),
            "action is invalid": F.forall(
                "_a",
                lambda a: (F.trim(a["arxiv_id"]) != "") & a["action"].isin(SUBMITTED_ACTIONS),
            ),
            "time is invalid": F.forall(
                "_a", lambda a: moments.parse_instant(a["updated_at"]).isNotNull()
            ),
        },
    )
    events = valid.select("number", F.posexplode("_a").alias("_i", "_x")).select(
        F.col("number").alias("submission"),
        F.concat_ws("-", F.lit("issue"), F.col("number").cast("string"), F.col("_i").cast("string")).alias("event_id"),
        F.lit("outcome").alias("event_type"),
        F.col("_x.arxiv_id").alias("paper_id"),
        moments.parse_instant(F.col("_x.updated_at")).alias("occurred_at"),
        F.col("_x.action").alias("outcome"),
        F.lit(None).cast("string").alias("batch_id"),
        F.lit(None).cast("int").alias("displayed_rank"),
        _strings().alias("reason_codes"),
        F.lit(None).cast("string").alias("supersedes_event_id"),
    )
    return events, rejects.select("number", "reason")


def read_submissions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Submission lists from files."""
    return parse_submissions(_documents(spark, path, schemas.SUBMISSION))


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Feedback events; a version 1 ledger holds none."""
    docs = _supported(_documents(spark, path, schemas.FEEDBACK_LEDGER), LEDGER_VERSIONS, "ledger")
    rows = docs.filter("schema_version = 2").select(F.explode("events").alias("e")).select("e.*")
    return rows.withColumn("occurred_at", moments.parse_instant(F.col("occurred_at")))


def read_feedback_adjustments(spark: SparkSession, path: str) -> DataFrame:
    """Adjustments carried over from version 1 ledgers."""
    docs = _documents(spark, path, schemas.FEEDBACK_LEDGER)
    kept = F.coalesce("adjustments", "legacy_adjustments")
    return docs.select(F.explode(kept).alias("paper_id", "adjustment"))


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    docs = _documents(spark, path, schemas.FEEDBACK_LEDGER)
    return docs.select(F.explode("processed_issue_numbers").alias("submission")).distinct()


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Label ledger events (S8); see ``contracts.duplicate_keys`` for its id check."""
    docs = _supported(_documents(spark, path, schemas.CORPUS_LEDGER), [1], "corpus")
    rows = docs.select(F.explode("events").alias("e")).select("e.*")
    return rows.withColumn("occurred_at", moments.parse_instant(F.col("occurred_at")))


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Frozen snapshots: header, splits, labels and preferences."""
    docs = _documents(spark, path, schemas.SNAPSHOT)
    split = docs.select("snapshot_id", F.explode("splits").alias("s"))
    return {
        "header": docs.drop("splits", "labels", "pairwise_preferences"),
        "splits": split.select(
            "snapshot_id", F.col("s.name").alias("split"),
            F.posexplode("s.paper_ids").alias("position", "paper_id"),
        ).withColumn("position", F.col("position").cast("long") + 1),
        "labels": docs.select("snapshot_id", F.explode("labels").alias("l")).select(
            "snapshot_id", F.col("l")[0].alias("paper_id"), F.col("l")[1].alias("label")
        ),
        "pairwise": docs.select(
            "snapshot_id", F.posexplode("pairwise_preferences").alias("_i", "p")
        ).select(
            "snapshot_id", F.concat(F.lit("pair-"), F.col("_i").cast("string")).alias("event_id"),
            F.col("p")[0].alias("paper_id"), F.col("p")[1].alias("compared_paper_id"),
        ),
    }


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Run manifests from single objects or ``manifests`` lists."""
    listed = f"array<struct<{schemas.MANIFEST}>>"
    docs = _documents(spark, path, f"{schemas.MANIFEST}, manifests {listed}")
    own = F.array(F.struct(*[c for c in docs.columns if c != "manifests"]))
    return docs.select(F.explode(F.coalesce("manifests", own)).alias("m")).select("m.*")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Published papers and when."""
    docs = _supported(_documents(spark, path, schemas.HISTORY), [1], "history")
    rows = docs.select(F.explode("entries").alias("e")).select("e.*")
    return rows.select(
        identity.paper_id(F.col("arxiv_id")).alias("paper_id"), "revision",
        moments.parse_instant(F.col("published_at")).alias("published_at"),
    )


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Evidence cache documents, key to entry."""
    lines = spark.read.text(path, wholetext=True)
    entry = f"map<string, struct<{schemas.EVIDENCE}>>"
    rows = lines.select(F.explode(F.from_json("value", entry)).alias("cache_key", "v"))
    return rows.select(
        "cache_key", F.col("v.canonical_paper_id").alias("paper_id"),
        F.coalesce("v.provider", F.lit("unspecified")).alias("provider"),
        F.coalesce("v.adapter_version", F.lit("v1")).alias("adapter_version"),
        moments.parse_instant(F.col("v.observed_at")).alias("observed_at"),
        moments.parse_instant(F.col("v.expires_at")).alias("expires_at"),
        "v.repository", "v.context",
    )


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Proposal and judgment cache documents, key to payload."""
    lines = spark.read.text(path, wholetext=True)
    return lines.select(
        F.explode(F.from_json("value", "map<string,string>")).alias("cache_key", "payload")
    )


def read_quality_examples(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed examples, one row each."""
    docs = _supported(_documents(spark, path, schemas.QUALITY_EXAMPLES), [1], "examples")
    return docs.select(F.explode("examples").alias("e")).select("e.*")


def read_quality_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Registered quality profiles; version 1 belongs to the legacy policy."""
    docs = _supported(_documents(spark, path, schemas.QUALITY_REGISTRY), [1, 2], "registry")
    rows = docs.select("approved_version", F.explode("profiles").alias("p")).select(
        "approved_version", "p.*"
    )
    return rows.withColumn(
        "policy_version", F.coalesce("policy_version", F.lit(POLICIES[0][0]))
    ).withColumn("approved", F.coalesce(F.col("version") == F.col("approved_version"), F.lit(False))).drop("approved_version")


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """Published rows of any version under the newest shape."""
    docs = _supported(_documents(spark, path, schemas.PUBLISHED), PUBLISHED_VERSIONS, "published")
    header = [
        F.coalesce("generation_started_at", "generated_at").alias("generation_started_at"),
        "generation_completed_at", "profile_library_version", "profile_snapshot_at",
        F.coalesce("output_language", F.lit("en")).alias("output_language"),
    ]
    rows = docs.select("schema_version", *header, F.explode("recommendations").alias("r"))
    keep = lambda name, since: F.when(
        (F.col("schema_version") >= since), F.col(f"r.{name}")
    )
    base = [
        "arxiv_id", "title", "authors", "categories", "published_on", "summary", "reason",
        "quota_source", "abstract_url", "pdf_url",
    ]
    current = F.col("r.quality").isNotNull()
    return rows.select(
        "schema_version", "generation_started_at", "generation_completed_at",
        "profile_library_version", "profile_snapshot_at", "output_language",
        *[F.col(f"r.{b}").alias(b) for b in base],
        F.coalesce("r.quality", "r.confidence").alias("quality"),
        F.when(current, F.col("r.uncertainty")).alias("uncertainty"),
        F.coalesce(keep("preference_signals", 2), _strings()).alias("preference_signals"),
        keep("limitation", 4).alias("limitation"),
        F.coalesce(keep("quality_evidence_fields", 5), _strings()).alias("quality_evidence_fields"),
        keep("reproducibility", 5).alias("reproducibility"),
        F.coalesce(keep("reproducibility_evidence", 5), F.lit("unknown")).alias("reproducibility_evidence"),
        F.coalesce(keep("evidence_provenance", 5), _strings()).alias("evidence_provenance"),
    )


def read_weight_sets(spark: SparkSession, path: str) -> DataFrame:
    """Registered weight sets and which one is active."""
    docs = _supported(_documents(spark, path, schemas.WEIGHT_REGISTRY), [1], "weights")
    rows = docs.select("active_version", F.explode("weight_sets").alias("w")).select(
        "active_version", "w.*"
    )
    return rows.withColumn(
        "active", F.coalesce(F.col("version") == F.col("active_version"), F.lit(False))
    ).drop("active_version")


def read_watchlist(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Watched identities in long form, and those that break their bounds."""
    docs = _documents(spark, path, schemas.WATCHLIST)
    kinds = (("author", "watched_authors"), ("institution", "watched_institutions"))
    rows = None
    for kind, column in kinds:
        part = docs.select(F.lit(kind).alias("kind"), F.explode(column).alias("i")).select(
            "kind", "i.name", F.coalesce("i.aliases", _strings()).alias("aliases")
        )
        rows = part if rows is None else rows.unionByName(part)
    return contracts.check(rows, contracts.watched_identity())
