"""Registry of queries and the tables they derive from the given ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import STOP_WORDS
from folioscope.operators import profile as P
from folioscope.session import materialized

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

NOW = "2024-01-31T00:00:00+00:00"
LANGS = ["de", "en", "es", "fr"]


def query(name: str, sql: str | None = None):
    """Register a Spark query and, where SQL can say it, the same query for DuckDB."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


#: Rows of a text table that one task may well hold.
TEXTS_PER_TASK = 5_000
#: The same for papers, whose texts are tokenized row by row: only splits beyond it pay for a shuffle of the texts.
PAPERS_PER_TASK = 50_000


def spread(df: DataFrame, name: str, per_task: int = TEXTS_PER_TASK) -> DataFrame:
    """Give a text table one task per ``per_task`` rows, and per core at least.

    Files of few and large row groups come in few tasks, however large they are: splits without a row
    group of their own stay empty. Rows per split are counted from the files' footers; a table that comes
    in small enough splits keeps them.
    """
    if name not in ("documents", "pages", "conversations"):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    # No cell is read for these counts.
    held = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("split")).count().collect()]
    total, most = sum(held), max(held, default=0)
    tasks = max(min(cores, 64), -(-total // per_task))
    return df.repartition(tasks) if most > 2 * max(1, -(-total // tasks)) else df


def table(spark: SparkSession, sf_dir: str, name: str, per_task: int = TEXTS_PER_TASK) -> DataFrame:
    """A given table; zone-less times become UTC instants."""
    df = spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"), name, per_task)
    naive = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive})


def text_time(column) -> F.Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def paper_key(doc_id) -> F.Column:
    doc = F.col(doc_id)
    return F.format_string("%04d.%05d", F.floor(doc / 100000), doc % 100000)


PAPER_KEY_SQL = "printf('%04d.%05d', doc_id // 100000, doc_id % 100000)"


def papers(spark: SparkSession, sf_dir: str, per_task: int = PAPERS_PER_TASK) -> DataFrame:
    return papers_of(table(spark, sf_dir, "documents", per_task))


def papers_of(documents: DataFrame) -> DataFrame:
    """Documents as candidate papers."""
    doc = F.col("doc_id")
    day = lambda n: F.make_interval(days=n.cast("int"))
    published = F.lit("2024-01-01 00:00:00").cast("timestamp") + day(doc % 30)
    key = paper_key("doc_id")
    return (
        documents.withColumn("paper_id", key)
        .select(
            "doc_id",
            "paper_id",
            F.lit(1).alias("revision"),
            F.split_part("text", F.lit("."), F.lit(1)).alias("title"),
            F.col("text").alias("summary"),
            F.array(F.col("source"), F.concat_ws("-", "source", (doc % 7).cast("string"))).alias(
                "authors"
            ),
            F.array(F.concat(F.lit("Institute "), (doc % 11).cast("string"))).alias("affiliations"),
            F.array("lang").alias("categories"),
            published.alias("published"),
            (published + day(F.col("n_chars") % 5)).alias("updated"),
            F.when(doc % 10 == 0, F.concat(F.lit("10.48550/arxiv."), "paper_id"))
            .when(doc % 3 == 0, F.concat(F.lit("10.5555/doc."), doc.cast("string")))
            .alias("doi"),
            F.col("lang"),
            F.col("n_chars"),
        )
    )


PAPERS_SQL = f"""papers AS (
  SELECT doc_id, {PAPER_KEY_SQL} AS paper_id, split_part(text, '.', 1) AS title, text AS summary,
    [source, source || '-' || CAST(doc_id % 7 AS VARCHAR)] AS authors,
    ['Institute ' || CAST(doc_id % 11 AS VARCHAR)] AS affiliations,
    [lang] AS categories, lang, n_chars,
    TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 30 AS INTEGER)) AS published,
    TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 30 + n_chars % 5 AS INTEGER)) AS updated,
    CASE WHEN doc_id % 10 = 0 THEN '10.48550/arxiv.' || {PAPER_KEY_SQL}
         WHEN doc_id % 3 = 0 THEN '10.5555/doc.' || CAST(doc_id AS VARCHAR) END AS doi
  FROM documents)"""

FOLD_SQL = "replace(lower({0}), 'ß', 'ss')"
RANK_TOKENS_SQL = "list_distinct(regexp_extract_all(" + FOLD_SQL + ", '[a-z][a-z0-9-]{{2,}}'))"
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
PROFILE_TOKENS_SQL = (
    "list_filter(list_transform(regexp_extract_all({0}, '[A-Za-z][A-Za-z0-9-]{{2,31}}'), "
    "lambda w: lower(w)), lambda w: NOT list_contains(" + STOP_SQL + ", w) AND NOT "
    "regexp_matches(w, '(sk-[A-Za-z0-9]{{12,}}|ghp_[A-Za-z0-9]{{12,}}|password|secret)'))"
)


def benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as library items of eight readers."""
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("p"), (F.col("item_id") % 8).cast("string")).alias("profile_id"),
        F.col("item_id").cast("string").alias("key"),
        F.lit(1).cast("long").alias("version"),
        F.lit("journalArticle").alias("item_type"),
        none.alias("parent_key"),
        F.lit("").alias("title"),
        F.array().cast("array<string>").alias("creators"),
        F.array().cast("array<struct<tag:string,manual:boolean>>").alias("tags"),
        F.array().cast("array<string>").alias("collections"),
        F.array().cast("array<string>").alias("identifiers"),
        F.col("text").alias("abstract"),
        none.alias("date"),
        F.lit(False).alias("trashed"),
        none.alias("note_text"),
        none.alias("annotation_text"),
        none.alias("annotation_comment"),
    )


def reader_number(profile_id="profile_id"):
    return F.substring(profile_id, 2, 9).cast("int")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight readers: topics and facets from their passages, one core and one adjacent language."""
    terms = P.profile_table(P.term_weights(benchmark_items(spark, sf_dir)))
    # Each reader's own terms serve as hint words, spread over the three kinds by length.
    kind = F.element_at(
        F.array(F.lit("domain"), F.lit("method"), F.lit("task")), (F.length("term") % 3 + 1)
    )
    hints = terms.select(kind.alias("kind"), "term", F.col("term").alias("value")).distinct()
    facets = P.profile_facets(terms.filter(F.col("horizon") == "long"), hints)
    no_categories = spark.createDataFrame(
        [], "profile_id string, category string, score double, rank int"
    )
    remote = P.project_remote(
        {"terms": terms, "categories": no_categories, "facets": facets}
    )
    n = reader_number()
    lang = lambda k: F.element_at(F.array(*map(F.lit, LANGS)), ((n + k) % 4 + 1))
    identity = lambda name, alias: F.array(
        F.struct(name.alias("name"), F.array(alias).alias("aliases"))
    )
    author = F.concat(F.lit("src"), n.cast("string"))
    place = F.concat(F.lit("Institute "), n.cast("string"))
    return remote.select(
        "profile_id",
        "topics",
        F.array(lang(0)).alias("core_categories"),
        F.array(lang(1)).alias("adjacent_categories"),
        F.array(lang(0), lang(1), lang(2)).alias("retrieval_categories"),
        identity(author, F.concat(author, F.lit(" group"))).alias("watched_authors"),
        identity(place, F.upper(place)).alias("watched_institutions"),
        "preference_facets",
        "schema_version",
        F.lit(7).cast("long").alias("source_library_version"),
        "representative_terms",
    )


PROFILE_SQL = f"""item_tokens AS (
  SELECT 'p' || CAST(item_id % 8 AS VARCHAR) AS profile_id,
    unnest({PROFILE_TOKENS_SQL.format('text')}) AS term FROM benchmark),
term_weight AS (SELECT profile_id, term, count(*) * 0.25::DOUBLE AS weight FROM item_tokens GROUP BY ALL),
term_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY weight DESC, term) AS rank
  FROM term_weight QUALIFY rank <= 80),
topic_list AS (
  SELECT profile_id, list(term ORDER BY rank) AS topics FROM term_ranked WHERE rank <= 30 GROUP BY ALL),
facet_kind AS (
  SELECT t.profile_id, ['domain','method','task'][length(t.term) % 3 + 1] AS kind, t.term AS value,
    least(t.weight / m.weight, 1.0) AS score
  FROM term_ranked t JOIN term_ranked m ON m.profile_id = t.profile_id AND m.rank = 1),
facet_k AS (
  SELECT *, row_number() OVER (PARTITION BY profile_id, kind ORDER BY score DESC, value) AS kr
  FROM facet_kind QUALIFY kr <= 4),
facet AS (
  SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, kind, value) AS rank
  FROM facet_k QUALIFY rank <= 12),
facet_list AS (
  SELECT profile_id, list({{'v': value, 's': score * score}} ORDER BY rank) AS facets
  FROM facet GROUP BY ALL),
profiles AS (
  SELECT t.profile_id, topics, facets, CAST(substr(t.profile_id, 2) AS INTEGER) AS n,
    [['de','en','es','fr'][n % 4 + 1]] AS core, [['de','en','es','fr'][(n + 1) % 4 + 1]] AS adjacent,
    [['de','en','es','fr'][n % 4 + 1], ['de','en','es','fr'][(n + 1) % 4 + 1],
     ['de','en','es','fr'][(n + 2) % 4 + 1]] AS wanted
  FROM topic_list t JOIN facet_list USING (profile_id))"""

# Scored pairs; the facet test needs tokens of three letters or more after hyphen splitting.
SCORED_SQL = f"""{PAPERS_SQL}, {PROFILE_SQL},
words AS (
  SELECT *, {RANK_TOKENS_SQL.format("title || ' ' || summary")} AS words FROM papers),
split_words AS (
  SELECT *, list_distinct(list_filter(flatten(list_transform(words, lambda w: string_split(w, '-'))),
    lambda p: length(p) >= 3)) AS parts FROM words),
pairs AS (
  SELECT w.*, p.profile_id, p.n, p.topics, p.facets,
    CASE WHEN list_has_any(w.categories, p.core) THEN 'core'
         WHEN list_has_any(w.categories, p.adjacent) THEN 'adjacent' ELSE 'exploration' END AS source,
    len(list_intersect(w.words, p.topics)) AS hits,
    greatest(0.0, 1.0 - greatest(epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(w.published), 0)
      / 86400000000.0 / 14) AS recency,
    CASE WHEN list_contains(w.authors, 'src' || CAST(p.n AS VARCHAR)) THEN 0.75 ELSE 0.0 END::DOUBLE AS watched_author,
    CASE WHEN list_contains(w.affiliations, 'Institute ' || CAST(p.n AS VARCHAR)) THEN 0.5 ELSE 0.0 END::DOUBLE AS place_hit
  FROM split_words w JOIN profiles p ON list_has_any(w.categories, p.wanted)),
features AS (
  SELECT *, least(hits / greatest(len(topics), 1), 1.0) AS lexical,
    CASE source WHEN 'core' THEN 1.0 WHEN 'adjacent' THEN 0.6 ELSE 0.2 END::DOUBLE AS category,
    least(coalesce(list_sum(list_transform(list_filter(facets, lambda f:
      length(f.v) >= 3 AND len(list_filter(regexp_extract_all(replace(f.v, '-', ' '), '[a-z][a-z0-9-]{{2,}}'),
        lambda t: NOT list_contains(parts, t))) = 0
      AND len(regexp_extract_all(replace(f.v, '-', ' '), '[a-z][a-z0-9-]{{2,}}')) > 0), lambda f: f.s)), 0.0) / 3, 1.0) AS facet,
    least(place_hit, greatest(0.0, 1.0 - watched_author)) AS watched_institution
  FROM pairs),
valued AS (
  SELECT *, lexical * 0.55 + category * 0.3 + facet * 0.15 AS interest_value, recency AS recency_value,
    watched_author + watched_institution AS identity_value FROM features),
scored AS (
  SELECT *, (0.40 * interest_value + 0.05 * recency_value + 0.10 * identity_value) / 0.55 AS score
  FROM valued)"""


def pool(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All candidates and all readers."""
    return papers(spark, sf_dir), materialized(profiles(spark, sf_dir), "profiles")


def pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Candidates paired with the readers that retrieve them, with their hits."""
    from folioscope.operators import ranking

    candidates, people = pool(spark, sf_dir)
    return ranking.assign_pool(candidates, people), people


def feedback_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback_of(table(spark, sf_dir, "events"))


def feedback_of(events: DataFrame) -> DataFrame:
    """Events as impressions and outcomes of papers."""
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_id"),
        F.when(kind == "view", "impression").otherwise("outcome").alias("event_type"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("paper_id"),
        F.col("ts").alias("occurred_at"),
        F.when(kind == "click", "interested")
        .when(kind == "purchase", "worthwhile")
        .when(kind == "error", "not_interested")
        .when(kind == "signup", "save_for_later")
        .alias("outcome"),
        F.date_format("ts", "yyyy-MM-dd").alias("batch_id"),
        F.when(kind == "view", k % 20 + 1).alias("displayed_rank"),
        F.array().cast("array<string>").alias("reason_codes"),
        F.lit(None).cast("string").alias("supersedes_event_id"),
    )


FEEDBACK_SQL = """feedback AS (
  SELECT 'e' || CAST(event_id AS VARCHAR) AS event_id,
    CASE WHEN event_type = 'view' THEN 'impression' ELSE 'outcome' END AS event_type,
    'u' || CAST(user_id AS VARCHAR) AS paper_id, ts AS occurred_at,
    CASE event_type WHEN 'click' THEN 'interested' WHEN 'purchase' THEN 'worthwhile'
      WHEN 'error' THEN 'not_interested' WHEN 'signup' THEN 'save_for_later' END AS outcome,
    strftime(ts, '%Y-%m-%d') AS batch_id,
    CASE WHEN event_type = 'view' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 20 + 1 END AS displayed_rank
  FROM events)"""
