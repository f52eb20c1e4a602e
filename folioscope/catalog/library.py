"""Library, profile and pool queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.catalog.base import (
    PAPER_KEY_SQL, PAPERS_SQL, PROFILE_TOKENS_SQL, benchmark_items, paper_key, papers, query,
    table, text_time,
)
from folioscope.operators import library, pool, profile, profile_counts
from folioscope.session import materialized

OBSERVED = "2024-02-01T00:00:00+00:00"
DONE = "2024-02-10T00:00:00+00:00"


def conversation_items(spark, sf_dir):
    """Conversations as library items: the first turn is the item, later turns hang below it."""
    conv, turn = F.col("conv_id"), F.col("turn")
    first = turn == 0
    none = F.lit(None).cast("string")
    root = F.concat(F.lit("c"), conv.cast("string"))
    remark = F.when(~first, F.col("text"))
    tag = lambda t, m: F.struct(t.alias("tag"), m.alias("manual"))
    tags = F.array(
        tag(F.concat(F.lit("topic"), F.col("role")), conv % 2 == 0),
        tag(F.lit("internal:hidden word"), F.lit(True)),
    )
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("p"), (conv % 8).cast("string")).alias("profile_id"),
        F.when(first, root).otherwise(F.concat_ws("-", root, turn.cast("string"))).alias("key"),
        F.lit(1).cast("long").alias("version"),
        F.when(first, "journalArticle").otherwise("note").alias("item_type"),
        F.when(~first, root).alias("parent_key"),
        F.when(first, F.split_part("text", F.lit("."), F.lit(1))).otherwise("").alias("title"),
        F.array().cast("array<string>").alias("creators"),
        F.when(first, tags).otherwise(F.array().cast("array<struct<tag:string,manual:boolean>>")).alias("tags"),
        F.when(first, F.array(F.concat(F.lit("k"), (conv % 5).cast("string"))))
        .otherwise(F.array().cast("array<string>")).alias("collections"),
        F.array().cast("array<string>").alias("identifiers"),
        F.when(first, F.col("text")).otherwise("").alias("abstract"),
        F.when(first & (conv % 7 != 0), F.format_string("%d-%02d", 2015 + conv % 10, 1 + conv % 9)).otherwise(none).alias("date"),
        F.lit(False).alias("trashed"),
        F.when(F.col("role") == "user", remark).alias("note_text"),
        F.when((F.col("role") == "assistant") & (turn % 4 == 1), remark).alias("annotation_text"),
        F.when((F.col("role") == "assistant") & (turn % 4 != 1), remark).alias("annotation_comment"),
    )


def conversation_collections(spark, sf_dir):
    """Regions name the collections the conversations sit in."""
    conv = F.col("conv_id")
    used = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("p"), (conv % 8).cast("string")).alias("profile_id"),
        (conv % 5).cast("int").alias("r_regionkey"),
    ).distinct()
    return used.join(table(spark, sf_dir, "region"), "r_regionkey").select(
        "profile_id", F.concat(F.lit("k"), F.col("r_regionkey").cast("string")).alias("key"),
        F.col("r_name").alias("name"),
    )


_T = PROFILE_TOKENS_SQL.format
LIBRARY_SQL = f"""root AS (
  SELECT 'p' || CAST(conv_id % 8 AS VARCHAR) AS profile_id, conv_id, role, text, split_part(text, '.', 1) AS title,
    CASE WHEN conv_id % 7 <> 0 THEN printf('%d-%02d', 2015 + conv_id % 10, 1 + conv_id % 9) ELSE '' END AS date,
    CASE WHEN conv_id % 7 = 0 THEN 0.35::DOUBLE ELSE greatest(0.1, exp(-greatest(epoch(TIMESTAMP '2024-02-01 00:00:00')
      - epoch(make_timestamp(2015 + conv_id % 10, 1 + conv_id % 9, 1, 0, 0, 0.0)), 0) / 86400.0 / 365)) END AS decay
  FROM conversations WHERE turn = 0),
signal AS (
  SELECT profile_id, decay, 0.25::DOUBLE AS w, unnest({_T("title || ' ' || text || ' ' || date")}) AS term FROM root
  UNION ALL SELECT profile_id, decay, CASE WHEN conv_id % 2 = 0 THEN 2.0 ELSE 0.25 END, unnest({_T("'topic' || role")}) FROM root
  UNION ALL SELECT r.profile_id, r.decay, CASE WHEN c.role = 'user' THEN 1.5 WHEN c.turn % 4 = 1 THEN 2.0 ELSE 2.5 END, unnest({_T('c.text')})
    FROM conversations c JOIN root r USING (conv_id) WHERE c.turn > 0 AND c.role IN ('user', 'assistant')
  UNION ALL SELECT profile_id, decay, 1.0, unnest({_T('r_name')}) FROM root JOIN region ON r_regionkey = conv_id % 5),
weights AS (SELECT profile_id, term, sum(w) AS weight, round(sum(w * decay), 9) AS recent FROM signal GROUP BY ALL),
long_terms AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY weight DESC, term) AS rank FROM weights QUALIFY rank <= 80),
recent_terms AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY recent DESC, term) AS rank FROM weights QUALIFY rank <= 30)"""


def _terms(spark, sf_dir):
    weights = profile.term_weights(
        conversation_items(spark, sf_dir), conversation_collections(spark, sf_dir),
        observed_at=OBSERVED,
    )
    return profile.profile_table(weights)


def _terms_query(spark, sf_dir, horizon):
    terms = _terms(spark, sf_dir).filter(F.col("horizon") == horizon)
    return terms.select(
        "profile_id", F.col("rank").cast("long").alias("rank"), "term",
        F.round("weight", 6).alias("weight"),
    )


@query("profile_terms", f"WITH {LIBRARY_SQL} SELECT profile_id, rank, term, round(weight, 6) AS weight FROM long_terms")
def profile_terms(spark, sf_dir):
    return _terms_query(spark, sf_dir, "long")


@query("profile_recent_terms", f"WITH {LIBRARY_SQL} SELECT profile_id, rank, term, round(recent, 6) AS weight FROM recent_terms")
def profile_recent_terms(spark, sf_dir):
    return _terms_query(spark, sf_dir, "recent")


_KINDS = ["domain", "method", "task"]
_CATEGORIES = ["cs.LG", "cs.CL", "cs.CV", "quant-ph"]


def _hints(terms):
    """Every term hints at its first three letters; kind and category follow its length."""
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), F.length("term") % 3 + 1)
    category = F.element_at(F.array(*map(F.lit, _CATEGORIES)), F.length("term") % 4 + 1)
    return terms.select("term").distinct().select(
        kind.alias("kind"), "term", F.left("term", F.lit(3)).alias("value"), category.alias("category")
    )


_FACET_SQL = f"""{LIBRARY_SQL},
best AS (SELECT profile_id, max(weight) AS top FROM long_terms GROUP BY ALL),
summed AS (
  SELECT l.profile_id, ['domain', 'method', 'task'][length(term) % 3 + 1] AS kind, left(term, 3) AS value, sum(weight) AS s,
    any_value(top) AS top FROM long_terms l JOIN best b ON b.profile_id = l.profile_id GROUP BY l.profile_id, kind, value),
per_kind AS (SELECT * FROM summed QUALIFY row_number() OVER (PARTITION BY profile_id, kind ORDER BY s DESC, value) <= 4),
facets AS (SELECT profile_id, kind, value, least(s / top, 1.0) AS score,
  row_number() OVER (PARTITION BY profile_id ORDER BY least(s / top, 1.0) DESC, kind, value) AS rank FROM per_kind QUALIFY rank <= 12)"""


@query("profile_facets", f"WITH {_FACET_SQL} SELECT profile_id, rank, kind, value, round(score, 6) AS score FROM facets")
def profile_facets(spark, sf_dir):
    terms = _terms(spark, sf_dir).filter(F.col("horizon") == "long")
    facets = profile.profile_facets(terms, _hints(terms))
    return facets.select(
        "profile_id", F.col("rank").cast("long").alias("rank"), "kind", "value",
        F.round("score", 6).alias("score"),
    )


@query(
    "remote_profile",
    f"""WITH {_FACET_SQL},
    cat AS (SELECT profile_id, ['cs.LG', 'cs.CL', 'cs.CV', 'quant-ph'][length(term) % 4 + 1] AS category, sum(weight) AS s FROM long_terms GROUP BY ALL),
    core AS (SELECT profile_id, list(category ORDER BY s DESC, category) AS core FROM cat GROUP BY ALL),
    near(category, neighbour) AS (VALUES ('cs.LG', 'stat.ML'), ('cs.LG', 'cs.AI'), ('cs.LG', 'cs.NE'), ('cs.CL', 'cs.AI'), ('cs.CV', 'cs.LG'), ('quant-ph', 'cond-mat.str-el')),
    adj AS (SELECT profile_id, string_agg(DISTINCT neighbour, ',' ORDER BY neighbour) AS adjacent FROM cat JOIN near USING (category) JOIN core USING (profile_id)
      WHERE NOT list_contains(core, neighbour) GROUP BY ALL),
    f AS (SELECT profile_id, string_agg(kind || ':' || value, ',' ORDER BY rank) AS facets FROM facets GROUP BY ALL)
    SELECT t.profile_id, string_agg(term, ',' ORDER BY rank) AS topics, array_to_string(any_value(core), ',') AS core,
      any_value(adjacent) AS adjacent, any_value(facets) AS facets, true AS within_budget
    FROM long_terms t JOIN core USING (profile_id) JOIN adj USING (profile_id) JOIN f USING (profile_id) WHERE rank <= 30 GROUP BY t.profile_id""",
)
def remote_profile(spark, sf_dir):
    terms = _terms(spark, sf_dir)
    hints = _hints(terms)
    facets = profile.profile_facets(terms.filter(F.col("horizon") == "long"), hints)
    tables = {
        "terms": terms, "categories": profile.profile_categories(terms, hints), "facets": facets,
    }
    remote = profile.project_remote(tables)
    named = F.transform("preference_facets", lambda f: F.concat_ws(":", f["kind"], f["value"]))
    return remote.select(
        "profile_id", F.concat_ws(",", "topics").alias("topics"),
        F.concat_ws(",", "core_categories").alias("core"),
        F.concat_ws(",", "adjacent_categories").alias("adjacent"),
        F.concat_ws(",", named).alias("facets"), "within_budget",
    )


@query(
    "item_digests",
    f"""WITH t AS (SELECT 'p' || CAST(item_id % 8 AS VARCHAR) AS profile_id, CAST(item_id AS VARCHAR) AS item_key,
      list_sort(list_distinct({_T('text')}))[1:40] AS terms FROM benchmark)
    SELECT profile_id, item_key, array_to_string(terms, ',') AS terms, CAST(len(terms) AS BIGINT) AS n FROM t""",
)
def item_digests(spark, sf_dir):
    digests = profile.item_digests(benchmark_items(spark, sf_dir))
    return digests.select(
        "profile_id", "item_key", F.concat_ws(",", "terms").alias("terms"),
        F.size("terms").cast("long").alias("n"),
    )


@query(
    "digest_cache",
    """SELECT length(text) % 2 = 0 AS reused, count(*) AS items FROM benchmark GROUP BY ALL""",
)
def digest_cache(spark, sf_dir):
    items = benchmark_items(spark, sf_dir)
    cached = profile.item_digests(items.filter(F.length("abstract") % 2 == 0))
    return profile.refresh_digests(items, cached).groupBy("reused").agg(
        F.count(F.lit(1)).alias("items")
    )


@query(
    "representative_items",
    """WITH t AS (SELECT 'p' || CAST(conv_id % 8 AS VARCHAR) AS profile_id, 'c' || CAST(conv_id AS VARCHAR) AS item_key,
      CASE WHEN conv_id % 7 <> 0 THEN CAST(2015 + conv_id % 10 AS INTEGER) END AS year FROM conversations WHERE turn = 0)
    SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY year DESC NULLS FIRST, item_key DESC) AS rank FROM t QUALIFY rank <= 8""",
)
def representative_items(spark, sf_dir):
    digests = profile.item_digests(conversation_items(spark, sf_dir))
    return profile.representative_items(digests).select(
        "profile_id", "item_key", "year", F.col("rank").cast("long").alias("rank")
    )


@query(
    "seed_children",
    """SELECT 'c' || CAST(r.conv_id AS VARCHAR) AS key, count(c.turn) AS children, count(CASE WHEN c.role = 'user' THEN 1 END) AS notes
    FROM conversations r LEFT JOIN conversations c ON c.conv_id = r.conv_id AND c.turn > 0 WHERE r.turn = 0 GROUP BY r.conv_id""",
)
def seed_children(spark, sf_dir):
    rows = library.children_of_seeds(conversation_items(spark, sf_dir))
    return rows.groupBy("key").agg(
        F.count("child_key").alias("children"), F.count("note_text").alias("notes")
    )


@query(
    "cdc_merge",
    """WITH old AS (SELECT * FROM customer WHERE c_nationkey <> 3),
    new AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 0 THEN c_acctbal - 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment
      FROM customer WHERE c_mktsegment <> 'BUILDING'),
    gone AS (SELECT c_custkey FROM customer WHERE c_nationkey = 7)
    SELECT c_custkey, n.c_custkey IS NOT NULL AND coalesce(o.c_acctbal <> n.c_acctbal, true) AS written,
      n.c_custkey IS NOT NULL AND coalesce(o.c_acctbal = n.c_acctbal, false) AS unchanged,
      n.c_custkey IS NULL OR g.c_custkey IS NOT NULL AS deleted,
      CASE WHEN NOT (n.c_custkey IS NULL OR g.c_custkey IS NOT NULL) THEN n.c_acctbal END AS balance
    FROM old o FULL JOIN new n USING (c_custkey) LEFT JOIN gone g USING (c_custkey)""",
)
def cdc_merge(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    old = customer.filter(F.col("c_nationkey") != 3)
    new = customer.filter(F.col("c_mktsegment") != "BUILDING").withColumn(
        "c_acctbal",
        F.when(F.col("c_acctbal") < 0, F.col("c_acctbal") - 1).otherwise(F.col("c_acctbal")),
    )
    gone = customer.filter(F.col("c_nationkey") == 7).select("c_custkey")
    changes = library.merge_changes(old, new, "c_custkey", deleted=gone, complete=True)
    return changes.select(
        "c_custkey", "written", "unchanged", "deleted", F.col("row.c_acctbal").alias("balance")
    )


def revisions(spark, sf_dir):
    """Documents as revisions: a hundred documents share one paper."""
    doc = F.col("doc_id")
    return papers(spark, sf_dir).withColumn(
        "paper_id", F.format_string("%04d.%05d", F.lit(1).cast("long"), doc % 100)
    ).select("doc_id", "paper_id", "updated", "title", "lang")


_REVISIONS_SQL = f"""{PAPERS_SQL}, revision AS (
  SELECT doc_id, printf('%04d.%05d', 1, doc_id % 100) AS paper_id, updated, lang FROM papers)"""


@query(
    "latest_revision",
    f"""WITH {_REVISIONS_SQL} SELECT paper_id, doc_id FROM revision
    QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY updated DESC, doc_id) = 1""",
)
def latest_revision(spark, sf_dir):
    newest = pool.latest_revisions(revisions(spark, sf_dir), F.col("doc_id"))
    return newest.select("paper_id", "doc_id")


@query(
    "pool_merge",
    f"""WITH {PAPERS_SQL}, mixed AS (
      SELECT paper_id, updated, 0 AS late FROM papers WHERE lang <> 'en'
      UNION ALL SELECT paper_id, updated + INTERVAL 1 DAY, 1 FROM papers WHERE lang <> 'de'),
    newest AS (SELECT paper_id, updated, late FROM mixed WHERE updated >= TIMESTAMP '2024-01-11 00:00:00'
      QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY updated DESC, late) = 1)
    SELECT paper_id, strftime(updated, '%Y-%m-%d') AS updated_on FROM newest ORDER BY updated DESC, paper_id DESC LIMIT 1000""",
)
def pool_merge(spark, sf_dir):
    rows = papers(spark, sf_dir).select("paper_id", "updated", "lang")
    incoming = rows.filter(F.col("lang") != "de").withColumn(
        "updated", F.col("updated") + F.expr("INTERVAL 1 DAY")
    )
    merged = pool.merge_pool(rows.filter(F.col("lang") != "en"), incoming, DONE)
    return merged.select("paper_id", F.date_format("updated", "yyyy-MM-dd").alias("updated_on"))


@query(
    "retrieval_window",
    f"""WITH {PAPERS_SQL}
    SELECT paper_id, lang FROM papers WHERE lang IN ('en', 'fr') AND published BETWEEN TIMESTAMP '2024-01-18 12:00:00' AND TIMESTAMP '2024-01-25 00:00:00'
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY published DESC, paper_id DESC) <= 500""",
)
def retrieval_window(spark, sf_dir):
    kept = pool.retrieve(
        papers(spark, sf_dir).select("paper_id", "lang", "categories", "published", "updated"),
        ["en", "fr"], "2024-01-25T00:00:00+00:00", checkpoint="2024-01-19T00:00:00+00:00",
    )
    return kept.select("paper_id", "lang")


def history(spark, sf_dir):
    """Viewed papers as the publication history."""
    return table(spark, sf_dir, "events").filter(F.col("event_type") == "view").groupBy(
        "user_id"
    ).agg(F.max("ts").alias("published_at")).select(
        paper_key("user_id").alias("paper_id"), F.lit(1).alias("revision"), "published_at"
    )


_HISTORY_SQL = f"""history AS (SELECT {PAPER_KEY_SQL.replace('doc_id', 'user_id')} AS paper_id, max(ts) AS published_at
  FROM events WHERE event_type = 'view' GROUP BY user_id)"""


@query(
    "suppressed_pool",
    f"""WITH {PAPERS_SQL}, {_HISTORY_SQL} SELECT paper_id FROM papers p
    WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.paper_id = p.paper_id AND h.published_at >= TIMESTAMP '2024-01-27 00:00:00')""",
)
def suppressed_pool(spark, sf_dir):
    return pool.suppress(papers(spark, sf_dir), history(spark, sf_dir), DONE).select("paper_id")


@query(
    "next_history",
    f"""WITH {PAPERS_SQL}, {_HISTORY_SQL}, new AS (SELECT paper_id FROM papers WHERE lang = 'fr')
    SELECT paper_id, strftime(published_at, '%Y-%m-%d %H:%M:%S.%f') AS published_at FROM history
    WHERE published_at >= TIMESTAMP '2024-01-11 00:00:00' AND paper_id NOT IN (SELECT paper_id FROM new)
    UNION ALL SELECT paper_id, '2024-02-10 00:00:00.000000' FROM new""",
)
def next_history(spark, sf_dir):
    new = papers(spark, sf_dir).filter(F.col("lang") == "fr")
    after = pool.next_history(history(spark, sf_dir), new, DONE)
    return after.select("paper_id", text_time("published_at").alias("published_at"))


@query(
    "known_excluded",
    f"""WITH {PAPERS_SQL}, held AS (
      SELECT 'arxiv:' || {PAPER_KEY_SQL} AS id FROM labels WHERE quality = 1
      UNION SELECT '10.5555/doc.' || CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 0)
    SELECT paper_id FROM papers WHERE 'arxiv:' || paper_id NOT IN (SELECT id FROM held) AND coalesce(doi, '') NOT IN (SELECT id FROM held)""",
)
def known_excluded(spark, sf_dir):
    doc = F.col("doc_id").cast("string")
    items = table(spark, sf_dir, "labels").select(
        F.lit(False).alias("trashed"), F.lit("journalArticle").alias("item_type"),
        F.array(
            F.when(F.col("quality") == 1, F.concat(F.lit("arXiv:"), paper_key("doc_id")))
            .otherwise(F.concat(F.lit("10.5555/DOC."), doc))
        ).alias("identifiers"),
    )
    return library.exclude_known(papers(spark, sf_dir), items).select("paper_id")


def _earlier_library(items):
    """An earlier state of a library: some items in the trash, some notes not yet written, some with
    other dates, and one more item beside every second one, gone since."""
    length = F.length("key")
    seed = F.col("parent_key").isNull()
    late = F.pmod(F.crc32("key"), F.lit(5))
    older = items.select(*[
        (F.col("trashed") | (late == 1)).alias(c) if c == "trashed"
        else F.when(late == 2, F.concat(F.lit("draft words "), F.left(c, length))).otherwise(F.col(c)).alias(c)
        if c == "note_text"
        else F.when(late == 3, F.lit("2011-04")).otherwise(F.col(c)).alias(c) if c == "date"
        else F.col(c)
        for c in items.columns
    ])
    gone = items.filter(seed & (late > 2)).withColumn("key", F.concat(F.lit("gone"), F.col("key")))
    return older.unionByName(gone)


@query(
    "profile_deltas",
    f"""WITH {LIBRARY_SQL} SELECT 'long' AS horizon, profile_id, rank, term, round(weight, 6) AS weight FROM long_terms
    UNION ALL SELECT 'recent', profile_id, rank, term, round(recent, 6) FROM recent_terms""",
)
def profile_deltas(spark, sf_dir):
    """Terms of the library as it is, from counts of an earlier state and signed deltas."""
    items = conversation_items(spark, sf_dir)
    earlier = _earlier_library(items)
    stored = materialized(profile_counts.count_terms(earlier), "profile-counts")
    counts = profile_counts.updated(stored, profile_counts.deltas(earlier, items))
    weights = profile_counts.weights_of(
        counts, conversation_collections(spark, sf_dir), observed_at=OBSERVED
    )
    return profile.profile_table(weights).select(
        "horizon", "profile_id", F.col("rank").cast("long").alias("rank"), "term",
        F.round("weight", 6).alias("weight"),
    )


@query(
    "profile_reprojection",
    f"""WITH {LIBRARY_SQL},
    bare AS (SELECT DISTINCT profile_id, CAST(profile_id[2:] AS INTEGER) AS n, length('{{"schema_version":4,"source_library_version":7,'
      || '"topics":[],"core_categories":[],"adjacent_categories":[],"representative_terms":[],"preference_facets":[]}}')
      + CASE WHEN CAST(profile_id[2:] AS INTEGER) % 2 = 0 THEN length('"cs.LG","cs.CV"') ELSE length('"quant-ph"') END AS size FROM root),
    topic AS (SELECT profile_id, n, rank, term, size, sum(length(term) + 3) OVER (PARTITION BY profile_id ORDER BY rank) - 1 AS room
      FROM long_terms JOIN bare USING (profile_id) WHERE rank <= 30),
    t AS (SELECT profile_id, any_value(n) AS n, any_value(size) + max(CASE WHEN size + room <= 220 + 60 * n THEN room ELSE 0 END) AS size,
      coalesce(string_agg(CASE WHEN size + room <= 220 + 60 * n THEN term END, ',' ORDER BY rank), '') AS topics FROM topic GROUP BY ALL),
    r AS (SELECT t.profile_id, t.n, t.topics, t.size + max(CASE WHEN t.size + room <= 220 + 60 * t.n THEN room ELSE 0 END) AS size,
      coalesce(string_agg(CASE WHEN t.size + room <= 220 + 60 * t.n THEN term END, ',' ORDER BY rank), '') AS representative
      FROM t JOIN topic USING (profile_id) WHERE rank <= 12 GROUP BY t.profile_id, t.n, t.topics, t.size),
    near(odd, place, neighbour) AS (VALUES (1, 1, 'cond-mat.str-el'), (0, 1, 'cs.AI'), (0, 2, 'cs.NE'), (0, 3, 'stat.ML')),
    a AS (SELECT r.*, place, neighbour, sum(length(neighbour) + 3) OVER (PARTITION BY profile_id ORDER BY place) - 1 AS room
      FROM r JOIN near ON odd = n % 2)
    SELECT profile_id, topics, representative,
      coalesce(string_agg(CASE WHEN size + room <= 220 + 60 * n THEN neighbour END, ',' ORDER BY place), '') AS adjacent,
      CAST(size + max(CASE WHEN size + room <= 220 + 60 * n THEN room ELSE 0 END) AS BIGINT) AS payload_bytes, 4 AS schema_version
    FROM a GROUP BY profile_id, topics, representative, size""",
)
def profile_reprojection(spark, sf_dir):
    """Profiles of versions 1 to 4, projected anew and cut to budgets between 220 and 640 bytes."""
    terms = _terms(spark, sf_dir).filter(F.col("horizon") == "long")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "term")))
    number = F.substring("profile_id", 2, 9).cast("int")
    raw = terms.groupBy("profile_id").agg(F.transform(ordered, lambda s: s["term"]).alias("topics")).select(
        "profile_id", (number % 4 + 1).alias("schema_version"), F.lit(7).alias("source_library_version"), "topics",
        F.when(number % 2 == 0, F.array(F.lit("cs.LG"), F.lit("cs.CV"))).otherwise(F.array(F.lit("quant-ph"))).alias("core_categories"),
        F.array(F.lit("old.XX")).alias("adjacent_categories"), F.array(F.lit("old")).alias("representative_terms"),
        F.array().cast("array<struct<kind:string,value:string>>").alias("preference_facets"),
    )
    projected = profile.reproject(raw)
    fitted = profile.fit_budget(projected, 220 + 60 * number, beside=["profile_id"])
    joined = lambda c, name: F.concat_ws(",", c).alias(name)
    return fitted.select(
        "profile_id", joined("topics", "topics"), joined("representative_terms", "representative"),
        joined("adjacent_categories", "adjacent"), F.col("payload_bytes").cast("long").alias("payload_bytes"), "schema_version",
    )
