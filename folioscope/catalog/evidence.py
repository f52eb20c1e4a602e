"""Identity, evidence, exchange, contract and publication queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.catalog.base import (
    TEXTS_PER_TASK, FOLD_SQL, NOW, PAPERS_SQL, PAPER_KEY_SQL, SCORED_SQL, paper_key, papers, pool, query,
    spread, table, text_time,
)
from folioscope.catalog.ranking import DIVERSE_PASSES, shortlisted, walk_sql
from folioscope.functions import hashing, identity, moments, text, urls
from folioscope.operators import contracts, evidence, exchange, publishing, ranking
from folioscope.plans import recommend as plans
from folioscope.session import materialized
from folioscope.sources.readers import parse_submissions


# ---- identity -------------------------------------------------------------------------------


@query(
    "doi_alias_join",
    f"""WITH {PAPERS_SQL}, id AS (SELECT paper_id, CASE WHEN doi LIKE '10.48550/arxiv.%' THEN 'arxiv:' || substr(doi, 16) ELSE 'doi:' || doi END AS canonical
      FROM papers WHERE doi IS NOT NULL),
    lab AS (SELECT 'arxiv:' || {PAPER_KEY_SQL} AS canonical, quality FROM labels)
    SELECT paper_id, canonical, CAST(quality AS BIGINT) AS quality FROM id JOIN lab USING (canonical)""",
)
def doi_alias_join(spark, sf_dir):
    named = papers(spark, sf_dir).filter(F.col("doi").isNotNull()).select(
        "paper_id",
        identity.canonical_identity(F.concat(F.lit(" DOI:"), F.upper("doi"))).alias("canonical"),
    )
    labels = table(spark, sf_dir, "labels").select(
        identity.canonical_identity(F.concat(F.lit("arXiv:"), paper_key("doc_id"), F.lit("v3"))).alias("canonical"),
        F.col("quality").cast("long").alias("quality"),
    )
    return named.join(labels, "canonical").select("paper_id", "canonical", "quality")


@query(
    "identity_match",
    """WITH watched AS (SELECT lower(replace(c_name, '#', ' ')) AS n FROM customer WHERE c_acctbal > 5000)
    SELECT o_orderkey, lower(replace(c_name, '#', ' ')) IN (SELECT n FROM watched) AS watched
    FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def identity_match(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    name = lambda c: text.normalized_identities(F.array(c))[0]
    watched = customer.filter(F.col("c_acctbal") > 5000).select(
        name(F.concat(F.upper("c_name"), F.lit(" !"))).alias("norm"), F.lit(True).alias("_hit")
    )
    flagged = customer.select("c_custkey", name(F.col("c_name")).alias("norm")).join(
        watched, "norm", "left"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return orders.join(flagged, "c_custkey").select(
        "o_orderkey", F.coalesce("_hit", F.lit(False)).alias("watched")
    )


@query(
    "product_dates",
    """WITH t AS (SELECT event_type, ts + INTERVAL 8 HOUR AS local FROM events)
    SELECT event_type, strftime(local, '%Y-%m-%d') AS product_date,
      CASE WHEN CAST(local AS TIME) >= TIME '18:30:00' OR CAST(local AS TIME) <= TIME '08:30:00' THEN 'allowed'
        WHEN event_type = 'view' THEN 'scheduled-skip' ELSE 'manual-blocked' END AS decision, count(*) AS events
    FROM t GROUP BY ALL""",
)
def product_dates(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "schedule").otherwise("workflow_dispatch")
    return table(spark, sf_dir, "events").groupBy(
        "event_type",
        moments.product_date(F.col("ts")).alias("product_date"),
        moments.generation_decision(F.col("ts"), kind).alias("decision"),
    ).agg(F.count(F.lit(1)).alias("events"))


# ---- evidence -------------------------------------------------------------------------------


_BARE_SQL = r"""regexp_replace(regexp_replace(html, '<!--.*?(?:-->|\z)', '', 'gs'),
  '<(?:script\b[^>]*>.*?(?:</script\s*>|\z)|style\b[^>]*>.*?(?:</style\s*>|\z))', '', 'gsi')"""
_TEXT_SQL = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace({0},
  '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'),
  '\s+', ' ', 'g'))"""


@query(
    "html_text",
    "SELECT page_id, " + _TEXT_SQL.format(
        r"regexp_replace(regexp_replace(" + _BARE_SQL
        + r""", '</?(?:div|p|li)\b[^>]*>|<br\b[^>]*>', ' ', 'gi'), '<[A-Za-z/!?][^>]*(?:>|\z)', '', 'gs')"""
    ) + " AS text FROM pages",
)
def html_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", text.html_to_text(F.col("html")).alias("text"))


def _section_pages(spark, sf_dir):
    """Documents as paper HTML, one heading per kind of section around the whole text."""
    headings = F.element_at(
        F.array(*map(F.lit, ["Our Approach", "Experiments &amp; Results", "Known Limitations", "Introduction"])),
        (F.col("doc_id") % 4 + 1).cast("int"),
    )
    body = F.concat(F.lit("<p>"), F.replace("summary", F.lit("<"), F.lit("&lt;")), F.lit("</p>"))
    page = F.concat(F.lit("<nav>menu</nav><h2>"), headings, F.lit("</h2>"), body, F.lit("<script>x()</script>"))
    return papers(spark, sf_dir, TEXTS_PER_TASK).select("doc_id", "paper_id", page.alias("html"))


_CUT_SQL = r"nullif(trim(substr(trim(regexp_replace(summary, '\s+', ' ', 'g')), 1, 4000)), '')"


@query(
    "paper_sections",
    f"""WITH {PAPERS_SQL} SELECT paper_id, CASE doc_id % 4 WHEN 0 THEN {_CUT_SQL} END AS method,
      CASE doc_id % 4 WHEN 1 THEN {_CUT_SQL} END AS evaluation,
      CASE doc_id % 4 WHEN 2 THEN {_CUT_SQL} END AS limitations FROM papers""",
)
def paper_sections(spark, sf_dir):
    found = evidence.sections(_section_pages(spark, sf_dir))
    return found.select("paper_id", "method", "evaluation", "limitations")


_PART_TEXT_SQL = _TEXT_SQL.format(r"regexp_replace({0}, '<[A-Za-z/!?][^>]*(?:>|\z)', ' ', 'gs')")


# Sections of these pages stay below the bounds on their size.
@query(
    "page_sections",
    r"""WITH part AS (SELECT page_id, unnest(string_split_regex(
      regexp_replace(""" + _BARE_SQL + r""", '<nav\b[^>]*>.*?(?:</nav\s*>|\z)', '', 'gsi'),
      '(?i)<h[1-6]\b[^>]*>')[2:]) AS part, generate_subscripts(string_split_regex(
      regexp_replace(""" + _BARE_SQL + r""", '<nav\b[^>]*>.*?(?:</nav\s*>|\z)', '', 'gsi'),
      '(?i)<h[1-6]\b[^>]*>')[2:], 1) AS i FROM pages),
    named AS (SELECT page_id, i, lower(""" + _PART_TEXT_SQL.format(
        r"regexp_extract(part, '(?is)\A(.*?)</h[1-6]\s*>', 1)") + r""") AS label,
      """ + _PART_TEXT_SQL.format(r"regexp_replace(part, '(?is)\A.*?</h[1-6]\s*>', '')") + r""" AS body
      FROM part WHERE regexp_matches(part, '(?i)</h[1-6]\s*>')),
    kinds AS (SELECT *, CASE """ + " ".join(
        f"WHEN regexp_matches(label, '{'|'.join(terms)}') THEN '{kind}'"
        for kind, terms in text.SECTION_TERMS.items()) + r""" END AS kind FROM named),
    found AS (SELECT page_id, kind, nullif(trim(substr(string_agg(body, ' ' ORDER BY i), 1, 4000)), '') AS body
      FROM kinds WHERE kind IS NOT NULL GROUP BY ALL)
    SELECT CAST(page_id AS VARCHAR) AS paper_id, '""" + evidence.SECTION_SOURCE + r"""' || page_id AS source_url,
      max(body) FILTER (kind = 'method') AS method, max(body) FILTER (kind = 'evaluation') AS evaluation,
      max(body) FILTER (kind = 'limitations') AS limitations
    FROM pages LEFT JOIN found USING (page_id) GROUP BY page_id""",
)
def page_sections(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("paper_id"), "html"
    )
    return evidence.sections(pages)


_HOSTS = [".example.com", ".example.net"]


@query(
    "project_urls",
    r"""WITH t AS (SELECT page_id, list_transform(regexp_extract_all(url || ' ' || html, 'https://[^\s<>"'']+'),
      lambda u: regexp_replace(u, '[.,;:!?)\]}]+$', '')) AS u FROM pages),
    ok AS (SELECT page_id, list_filter(list_transform(u, lambda x: CASE
      WHEN length(x) <= 2048 AND regexp_matches(x, '^https://[^/?#:@]+\.example\.(com|net)(:443)?/')
      THEN regexp_replace(x, '#.*$', '') END), lambda x: x IS NOT NULL) AS v FROM t)
    SELECT page_id, v[1] AS first_url, CAST(least(len(list_distinct(v)), 3) AS BIGINT) AS urls FROM ok WHERE len(v) > 0""",
)
def project_urls(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select(
        "page_id", urls.project_urls(F.concat_ws(" ", "url", "html"), ["example.com"], _HOSTS).alias("u")
    )
    return found.filter(F.size("u") > 0).select(
        "page_id", F.col("u")[0].alias("first_url"), F.size("u").cast("long").alias("urls")
    )


def listings(spark, sf_dir):
    """Parts as files of repositories named by brand and size."""
    size = F.col("p_size")
    name = F.concat(
        F.when(size % 5 == 0, "test_").when(size % 7 == 0, "data_").otherwise(""),
        F.replace("p_name", F.lit(" "), F.lit("_")),
        F.when(F.col("p_type") == "ECONOMY", ".py").otherwise(".md"),
    )
    return table(spark, sf_dir, "part").select(
        F.concat_ws("/", F.regexp_replace("p_brand", "#", ""), size.cast("string")).alias("repo"),
        name.alias("file_name"),
    )


_LISTING_SQL = """listing AS (
  SELECT replace(p_brand, '#', '') || '/' || CAST(p_size AS VARCHAR) AS repo,
    lower(CASE WHEN p_size % 5 = 0 THEN 'test_' WHEN p_size % 7 = 0 THEN 'data_' ELSE '' END || replace(p_name, ' ', '_')
      || CASE WHEN p_type = 'ECONOMY' THEN '.py' ELSE '.md' END) AS f FROM part),
flags AS (SELECT repo, bool_or(f IN ('src', 'source', 'code', 'implementation', 'models') OR regexp_matches(f, '\\.(py|ipynb|cpp|c|rs|go|java|jl|m)$')) AS code,
    bool_or(regexp_matches(f, 'test|eval|experiment|benchmark')) AS ev, bool_or(regexp_matches(f, 'data|results|metrics')) AS da, count(*) AS n
  FROM listing GROUP BY ALL)"""


@query(
    "repo_grade",
    f"""WITH {_LISTING_SQL}
    SELECT repo, CASE WHEN n > 200 THEN 'unknown' WHEN code AND ev AND da THEN 'implementation_data_and_evaluation'
      WHEN code AND ev THEN 'implementation_and_evaluation' WHEN code THEN 'implementation' ELSE 'documentation_only' END AS grade FROM flags""",
)
def repo_grade(spark, sf_dir):
    return evidence.grade_listings(listings(spark, sf_dir)).select("repo", "grade")


@query(
    "page_materials",
    f"""WITH {_LISTING_SQL},
    page AS (SELECT doc_id, 'Brand' || CAST(doc_id % 25 AS VARCHAR) || '/' || CAST(n_chars % 50 AS VARCHAR) AS repo,
      CASE n_chars % 3 WHEN 0 THEN true WHEN 1 THEN false END AS reachable FROM documents)
    SELECT {PAPER_KEY_SQL} AS paper_id, 'https://github.com/' || p.repo AS url, reachable,
      CASE WHEN NOT coalesce(reachable, false) OR n IS NULL OR n > 200 THEN 0.0 WHEN code AND ev AND da THEN 1.0 WHEN code AND ev THEN 0.8 WHEN code THEN 0.6 ELSE 0.2 END::DOUBLE AS material_score
    FROM page p LEFT JOIN flags f ON f.repo = p.repo""",
)
def page_materials(spark, sf_dir):
    pages = project_pages_of(spark, sf_dir)
    graded = evidence.repository_materials(pages, listings(spark, sf_dir))
    return pages.join(graded.select("paper_id", "material_score"), "paper_id").select(
        "paper_id", "url", "reachable", "material_score"
    )


def project_pages_of(spark, sf_dir):
    """Each paper links one repository in its abstract; a probe table says whether it answers."""
    docs = papers(spark, sf_dir)
    link = F.concat(
        F.lit("https://github.com/Brand"), (F.col("doc_id") % 25).cast("string"), F.lit("/"),
        (F.col("n_chars") % 50).cast("string"),
    )
    linked = docs.select(
        "paper_id", F.concat(F.col("title"), F.lit(" code: "), link, F.lit(").")).alias("summary"),
        (F.col("n_chars") % 3).alias("_m"),
    )
    answered = linked.select(
        "paper_id", F.when(F.col("_m") == 0, True).when(F.col("_m") == 1, False).alias("reachable")
    )
    found = linked.select("paper_id", urls.project_urls(F.col("summary"))[0].alias("url"))
    return found.join(answered, "paper_id")


@query(
    "project_pages",
    """WITH d AS (SELECT doc_id, list_filter(['https://github.com/a/' || CAST(n_chars % 40 AS VARCHAR), CASE WHEN doc_id % 2 = 0 THEN 'https://x.github.io/p' || CAST(doc_id % 30 AS VARCHAR) END],
        lambda u: u IS NOT NULL) AS u FROM documents WHERE true),
    probe AS (SELECT DISTINCT 'https://github.com/a/' || CAST(k AS VARCHAR) AS url, CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS reachable FROM (SELECT DISTINCT n_chars % 40 AS k FROM documents)
      UNION ALL SELECT 'https://x.github.io/p' || CAST(k AS VARCHAR), CASE k % 2 WHEN 0 THEN true ELSE false END FROM (SELECT DISTINCT doc_id % 30 AS k FROM documents)),
    links AS (SELECT doc_id, unnest(u) AS url, generate_subscripts(u, 1) AS pos FROM d),
    j AS (SELECT l.*, p.reachable FROM links l LEFT JOIN probe p USING (url))
    SELECT doc_id, coalesce(arg_min(url, pos) FILTER (reachable), arg_min(url, pos)) AS url,
      CASE WHEN bool_or(reachable) THEN true WHEN bool_or(reachable IS NULL) THEN NULL ELSE false END AS reachable FROM j GROUP BY doc_id""",
)
def project_pages(spark, sf_dir):
    doc, n = F.col("doc_id"), F.col("n_chars")
    docs = spread(table(spark, sf_dir, "documents"), "documents")
    first = F.concat(F.lit("https://github.com/a/"), (n % 40).cast("string"))
    second = F.concat(F.lit("https://x.github.io/p"), (doc % 30).cast("string"))
    linked = docs.select(
        doc.cast("string").alias("paper_id"),
        F.concat(
            F.lit("see "), first, F.lit("#top, "),
            F.when(doc % 2 == 0, F.concat(F.lit("and <"), second, F.lit("> "))).otherwise(""),
            F.lit(" or https://evil.com/x/y and http://github.com/q/r"),
        ).alias("summary"),
    )
    k = F.col("k")
    probes = (
        docs.select((n % 40).alias("k")).distinct().select(
            F.concat(F.lit("https://github.com/a/"), k.cast("string")).alias("url"),
            F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("reachable"),
        )
    ).unionByName(
        docs.select((doc % 30).alias("k")).distinct().select(
            F.concat(F.lit("https://x.github.io/p"), k.cast("string")).alias("url"),
            (k % 2 == 0).alias("reachable"),
        )
    )
    pages = evidence.project_pages(linked, probes)
    return pages.select(F.col("paper_id").cast("long").alias("doc_id"), "url", "reachable")


@query(
    "citation_context",
    f"""WITH {PAPERS_SQL}, works AS (SELECT doi, n_chars % 100 AS cited, lang = 'en' AS oa, CASE WHEN n_chars % 3 = 0 THEN n_chars % 2 = 0 END AS retracted
      FROM papers WHERE doi IS NOT NULL AND n_chars % 5 <> 0)
    SELECT 'arxiv:' || paper_id AS paper_id, cited AS citation_count, CASE WHEN w.doi IS NOT NULL THEN 'available' ELSE 'unknown' END AS open_access,
      retracted, CASE WHEN retracted IS NOT NULL THEN 0.8 ELSE 0.0 END::DOUBLE AS confidence,
      CASE WHEN w.doi IS NOT NULL THEN '2024-02-07' ELSE '2024-02-01' END AS expires_on
    FROM papers p LEFT JOIN works w USING (doi)""",
)
def citation_context(spark, sf_dir):
    docs = papers(spark, sf_dir)
    n = F.col("n_chars")
    works = docs.filter(F.col("doi").isNotNull() & (n % 5 != 0)).select(
        "doi", (n % 100).alias("cited_by_count"), n.alias("referenced_works_count"),
        (F.col("lang") == "en").alias("is_oa"), F.when(n % 3 == 0, n % 2 == 0).alias("is_retracted"),
    )
    context = evidence.citation_context(docs, works, NOW)
    return context.select(
        "paper_id", F.col("context.citation_count").alias("citation_count"),
        F.col("context.open_access.availability").alias("open_access"),
        F.col("context.retracted.claim").alias("retracted"),
        F.col("context.retracted.confidence").alias("confidence"),
        F.date_format("expires_at", "yyyy-MM-dd").alias("expires_on"),
    )


@query(
    "repository_facts",
    """WITH repo AS (SELECT DISTINCT s_name AS name, s_acctbal > 0 AS lic, s_nationkey % 2 = 0 AS arch, s_acctbal FROM supplier),
    page AS (SELECT c_custkey, 'Supplier#' || printf('%09d', c_custkey % 150) AS name FROM customer)
    SELECT c_custkey, CASE WHEN r.name IS NULL THEN 'unknown' ELSE 'available' END AS license, lic AS license_present, arch AS archived,
      CASE WHEN r.name IS NOT NULL THEN s_acctbal >= 1000 END AS maintained FROM page p LEFT JOIN repo r USING (name)""",
)
def repository_facts(spark, sf_dir):
    repo = lambda c: F.concat(F.lit("lab/"), F.regexp_replace(c, "#", "-"))
    facts = table(spark, sf_dir, "supplier").select(
        F.upper(repo(F.col("s_name"))).alias("full_name"), (F.col("s_acctbal") > 0).alias("has_license"),
        (F.col("s_nationkey") % 2 == 0).alias("archived"), F.lit(None).cast("boolean").alias("has_wiki"),
        F.when(F.col("s_acctbal") >= 1000, F.lit("2024-01-01")).otherwise(F.lit("2020-01-01")).cast("timestamp").alias("pushed_at"),
    )
    key = F.format_string("Supplier#%09d", F.col("c_custkey") % 150)
    pages = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("paper_id"),
        F.concat(F.lit("https://github.com/"), repo(key), F.lit(".git")).alias("url"),
    )
    found = evidence.repository_facts(pages, facts, NOW)
    return found.select(
        F.col("paper_id").cast("long").alias("c_custkey"),
        F.col("license_present.availability").alias("license"),
        F.col("license_present.claim").alias("license_present"),
        F.col("archived.claim").alias("archived"), F.col("maintained.claim").alias("maintained"),
    )


@query(
    "valid_evidence",
    """SELECT CAST(o_orderkey AS VARCHAR) AS paper_id FROM orders WHERE o_orderstatus = 'F' AND o_orderdate > TIMESTAMP '1998-01-01'""",
)
def valid_evidence(spark, sf_dir):
    cache = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("paper_id"), F.col("o_orderstatus").alias("provider"),
        F.lit("v1").alias("adapter_version"), F.col("o_orderdate").alias("expires_at"),
    )
    return evidence.valid_evidence(cache, "1998-01-01T00:00:00+00:00", "F", "v1").select("paper_id")


@query(
    "single_evidence",
    """SELECT CAST(o_custkey AS VARCHAR) AS paper_id, any_value(o_orderstatus) AS provider FROM orders
    WHERE o_orderdate > TIMESTAMP '2000-06-01' GROUP BY o_custkey HAVING count(*) = 1""",
)
def single_evidence(spark, sf_dir):
    cache = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("paper_id"), F.col("o_orderstatus").alias("provider"),
        F.col("o_orderdate").alias("expires_at"),
    )
    return evidence.single_valid_evidence(cache, "2000-06-01T00:00:00+00:00").select("paper_id", "provider")


_SCAN = {
    **publishing.SENSITIVE_PATTERNS,
    "e-mail": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "hex token": r'token = "[0-9a-f]{16,}"',
    "card number": r"\b[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}\b",
}


def _scan_sql() -> str:
    parts = []
    for label, pattern in _SCAN.items():
        quoted = pattern.replace("'", "''")
        parts.append(
            f"SELECT '{label}' AS label, len(regexp_extract_all(text, '{quoted}')) AS h FROM documents"
        )
    return f"WITH t AS ({' UNION ALL '.join(parts)}) SELECT label, count(*) AS rows, CAST(sum(h) AS BIGINT) AS hits FROM t WHERE h > 0 GROUP BY label"


@query("sensitive_scan", _scan_sql())
def sensitive_scan(spark, sf_dir):
    return publishing.scan_sensitive(table(spark, sf_dir, "documents"), "text", _SCAN)


# ---- exchange -------------------------------------------------------------------------------


def _keyed(spark, sf_dir):
    return papers(spark, sf_dir).select(
        "paper_id", "n_chars",
        hashing.joined_key(F.col("paper_id"), F.lit("7"), "prompt-v1", "model-a", F.col("lang"), F.col("n_chars")).alias("cache_key"),
    )


@query(
    "cache_split",
    f"""WITH {PAPERS_SQL} SELECT paper_id,
      sha256(paper_id || chr(0) || '7' || chr(0) || 'prompt-v1' || chr(0) || 'model-a' || chr(0) || lang || chr(0) || CAST(n_chars AS VARCHAR)) AS cache_key,
      n_chars % 2 = 0 AND n_chars % 3 <> 0 AS hit FROM papers""",
)
def cache_split(spark, sf_dir):
    wanted = _keyed(spark, sf_dir)
    cache = wanted.filter(F.col("n_chars") % 2 == 0).select(
        "cache_key", F.when(F.col("n_chars") % 3 == 0, "{broken").otherwise('{"quality": 1}').alias("payload")
    )
    split = exchange.split_by_cache(wanted, cache, F.get_json_object("payload", "$.quality").isNotNull())
    return split.select("paper_id", "cache_key", "hit")


@query(
    "model_batches",
    f"""WITH RECURSIVE {SCORED_SQL},
    short AS (SELECT profile_id, paper_id, summary, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, paper_id) AS r FROM scored QUALIFY r <= 60),
    rec AS (SELECT profile_id, paper_id, r, octet_length(encode(summary)) AS b, greatest(1, octet_length(encode(summary)) // 4) AS t FROM short),
    walk AS (
      SELECT profile_id, paper_id, r, 1 AS batch, 1 AS held, t AS ut, b + 2 AS ub FROM rec WHERE r = 1
      UNION ALL
      SELECT n.profile_id, n.paper_id, n.r, CASE WHEN fresh THEN w.batch + 1 ELSE w.batch END, CASE WHEN fresh THEN 1 ELSE w.held + 1 END,
        CASE WHEN fresh THEN n.t ELSE w.ut + n.t END, CASE WHEN fresh THEN n.b + 2 ELSE w.ub + n.b + 1 END
      FROM walk w JOIN rec n ON n.profile_id = w.profile_id AND n.r = w.r + 1,
      LATERAL (SELECT w.held >= 10 OR w.ut + n.t > 12000 OR w.ub + n.b + 1 > 65536 AS fresh))
    SELECT profile_id AS run_id, paper_id, CAST(batch AS BIGINT) AS batch_no FROM walk""",
)
def model_batches(spark, sf_dir):
    short = shortlisted(spark, sf_dir, 60).select("profile_id", "paper_id", "rank")
    records = short.join(papers(spark, sf_dir).select("paper_id", "summary"), "paper_id").select(
        F.col("profile_id").alias("run_id"), "paper_id", F.col("rank").alias("record_order"),
        F.col("summary").alias("record"),
    )
    packed, _ = exchange.pack_records(records, batch_size=10, max_requests=60)
    return packed.select("run_id", "paper_id", F.col("batch_no").cast("long").alias("batch_no"))


def _answers(spark, sf_dir, field: str, size: int, entry):
    """Answers in batches of ``size`` neighbouring documents, as JSON text."""
    docs = papers(spark, sf_dir).withColumn("batch_id", F.floor(F.col("doc_id") / size).cast("long"))
    listed = docs.withColumn("_e", entry).groupBy("batch_id").agg(
        F.concat(
            F.lit(f'{{"{field}":['), F.concat_ws(",", F.array_sort(F.collect_list("_e"))), F.lit("]}")
        ).alias("content")
    )
    return materialized(listed, "responses"), docs.select("batch_id", "paper_id")


@query(
    "proposal_contract",
    f"""WITH {PAPERS_SQL},
    entry AS (SELECT doc_id // 5 AS batch_id, paper_id, CAST(n_chars % 103 AS DOUBLE) / 100 AS q, title, title || ' shows a clear and careful new result' AS reason,
      len(list_distinct(list_filter(string_split_regex(trim({FOLD_SQL.format("replace(title || ' shows a clear and careful new result', '-', ' ')")}), '\\s+'), lambda w: regexp_matches(w, '^\\p{{L}}+$')))) AS words FROM papers),
    sound AS (SELECT batch_id, bool_and(q <= 1 AND length(title) BETWEEN 24 AND 800 AND length(reason) BETWEEN 24 AND 400 AND words >= 5) AS ok, count(*) AS n FROM entry GROUP BY ALL)
    SELECT batch_id, CASE WHEN ok THEN n ELSE 0 END AS accepted FROM sound""",
)
def proposal_contract(spark, sf_dir):
    entry = F.to_json(
        F.struct(
            F.col("paper_id").alias("arxiv_id"), ((F.col("n_chars") % 103).cast("double") / 100).alias("quality"),
            F.col("title").alias("summary"),
            F.concat("title", F.lit(" shows a clear and careful new result")).alias("reason"),
        )
    )
    answers, asked = _answers(spark, sf_dir, "proposals", 5, entry)
    valid, _ = exchange.parse_proposals(answers, asked)
    accepted = valid.groupBy("batch_id").agg(F.count(F.lit(1)).alias("accepted"))
    return answers.select("batch_id").join(accepted, "batch_id", "left").fillna(0, ["accepted"])


def _judgment_entry():
    n = F.col("n_chars")
    score = lambda i: F.when((n + i) % 4 != 0, ((n + i) % 11).cast("double") / 10)
    dims = F.struct(*[score(i).alias(d) for i, d in enumerate(exchange.DIMENSIONS)])
    return F.to_json(
        F.struct(
            F.col("paper_id").alias("arxiv_id"), dims.alias("dimensions"),
            ((n % 21).cast("double") / 19).alias("uncertainty"),
            F.array(F.lit("title"), F.when(n % 23 == 0, "title").otherwise("summary")).alias("evidence_fields"),
        ),
        {"ignoreNullFields": "false"},
    )


_JUDGED_SQL = f"""{PAPERS_SQL},
dims AS (SELECT doc_id, paper_id, n_chars, (n_chars % 21) / 19.0::DOUBLE AS u, list_transform(range(0, 8), lambda i: CASE WHEN (n_chars + i) % 4 <> 0 THEN ((n_chars + i) % 11) / 10.0::DOUBLE END) AS d FROM papers),
sound AS (SELECT doc_id // 4 AS batch_id, bool_and(u <= 1 AND n_chars % 23 <> 0 AND list_max(d) <= 1) AS ok FROM dims GROUP BY ALL),
judged AS (SELECT paper_id, u, list_filter(d[1:7], lambda x: x IS NOT NULL) AS k, d[3] AS advance, d[4] AS depth FROM dims JOIN sound ON sound.batch_id = doc_id // 4 WHERE ok)"""


def judgments_of(spark, sf_dir):
    answers, asked = _answers(spark, sf_dir, "judgments", 4, _judgment_entry())
    return exchange.parse_judgments(answers, asked)[0]


@query(
    "judged_quality",
    f"""WITH {_JUDGED_SQL} SELECT paper_id, round(coalesce(list_avg(k), 0.0) * (1 - u), 6) AS quality FROM judged""",
)
def judged_quality(spark, sf_dir):
    return judgments_of(spark, sf_dir).select(
        "paper_id", F.round(exchange.judged_quality(), 6).alias("quality")
    )


@query(
    "value_gate",
    f"""WITH {_JUDGED_SQL} SELECT paper_id, 1 - u >= 0.5 AND (coalesce(advance < 0.5, false) OR coalesce(depth < 0.5, false)) AS rejected
    FROM judged WHERE advance IS NOT NULL OR depth IS NOT NULL""",
)
def value_gate(spark, sf_dir):
    from folioscope.operators import selection

    values = exchange.value_assessments(judgments_of(spark, sf_dir))
    return values.select("paper_id", selection.value_rejected(selection.policy()).alias("rejected"))


@query(
    "quality_gate",
    f"""WITH {_JUDGED_SQL} SELECT p.paper_id, coalesce(list_avg(k) * (1 - u), 0.25) >= 0.25 AS kept FROM papers p LEFT JOIN judged j USING (paper_id)""",
)
def quality_gate(spark, sf_dir):
    sums = ranking.extra_feature_sums(exchange.judgment_features(judgments_of(spark, sf_dir)), ["paper_id"])
    joined = papers(spark, sf_dir).select("paper_id").join(sums, "paper_id", "left")
    value = F.col("_x_scientific_quality") / F.nullif(F.col("_n_scientific_quality"), F.lit(0))
    return joined.select("paper_id", (F.coalesce(value, F.lit(0.25)) >= 0.25).alias("kept"))


@query(
    "usage_totals",
    """SELECT o_orderpriority AS run_id, count(*) AS requests, CASE WHEN count(*) FILTER (o_orderdate < TIMESTAMP '1992-01-05') = 0 THEN CAST(sum(o_custkey) AS BIGINT) END AS actual_input,
      CAST(sum(o_orderkey) AS BIGINT) AS actual_output FROM orders GROUP BY ALL""",
)
def usage_totals(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    one = F.lit(1).cast("long")
    usage = orders.select(
        F.col("o_orderpriority").alias("run_id"), one.alias("requests"), one.alias("cache_hits"),
        one.alias("estimated_input"), one.alias("estimated_output"), one.alias("retry_count"),
        F.when(F.col("o_orderdate") >= F.lit("1992-01-05").cast("timestamp"), F.col("o_custkey")).alias("actual_input"),
        F.col("o_orderkey").alias("actual_output"), F.lit(1.0).alias("latency"),
    )
    return exchange.usage_totals(usage).select("run_id", "requests", "actual_input", "actual_output")


# ---- contracts ------------------------------------------------------------------------------


@query(
    "feature_contract",
    """WITH r AS (SELECT CASE WHEN event_type = 'error' THEN 'feature group is unknown' WHEN value / 50 > 1 THEN 'feature is not normalized'
      WHEN value < 5 AND NOT (value = 0) THEN 'unavailable feature carries a score' ELSE 'valid' END AS reason FROM events)
    SELECT reason, count(*) AS rows FROM r GROUP BY ALL""",
)
def feature_contract(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("name"), (F.col("value") / 50).alias("value"),
        (F.col("value") >= 5).alias("applicable"), F.lit(1.0).alias("confidence"),
        F.col("props").alias("provenance"),
        F.when(F.col("event_type") == "error", "other").otherwise("context").alias("grp"),
    )
    valid, rejects = contracts.check(rows, contracts.feature())
    both = rejects.select("reason").unionByName(valid.select(F.lit("valid").alias("reason")))
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "submission_ingest",
    """WITH s AS (SELECT event_id + 1 AS number, user_id, ts, CASE event_type WHEN 'click' THEN 'interested' WHEN 'error' THEN 'not_interested'
      WHEN 'signup' THEN 'save_for_later' WHEN 'view' THEN 'read' ELSE 'worthwhile' END AS action, value FROM events)
    SELECT 'issue-' || CAST(number AS VARCHAR) || '-' || CAST(i AS VARCHAR) AS event_id,
      'u' || CAST(user_id AS VARCHAR) || CASE WHEN i = 1 THEN 'b' ELSE '' END AS paper_id, CASE WHEN i = 0 THEN action ELSE 'read' END AS outcome,
      strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS occurred_at
    FROM s, (VALUES (0), (1)) v(i) WHERE action <> 'worthwhile' AND NOT (value > 40 AND value < 60)""",
)
def submission_ingest(spark, sf_dir):
    kind = F.col("event_type")
    action = (
        F.when(kind == "click", "interested").when(kind == "error", "not_interested")
        .when(kind == "signup", "save_for_later").when(kind == "view", "read").otherwise("worthwhile")
    )
    paper = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    second = F.when(F.col("value").between(40.0000001, 59.9999999), paper).otherwise(F.concat(paper, F.lit("b")))
    entry = lambda p, a: F.struct(p.alias("arxiv_id"), a.alias("action"), at.alias("updated_at"))
    body = F.to_json(
        F.struct(F.lit(1).alias("schema_version"), F.array(entry(paper, action), entry(second, F.lit("read"))).alias("feedback"))
    )
    submissions = table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("number"), body.alias("body"))
    events, _ = parse_submissions(submissions)
    return events.select("event_id", "paper_id", "outcome", text_time("occurred_at").alias("occurred_at"))


# ---- runs and publication ---------------------------------------------------------------------


def proposals_of(spark, sf_dir):
    return papers(spark, sf_dir).select(
        "paper_id", ((F.col("n_chars") % 10).cast("double") / 10).alias("quality"),
        F.col("title").alias("summary"), F.col("title").alias("reason"),
    )


_RECOMMEND_SQL = (
    f"WITH RECURSIVE {SCORED_SQL}, " + walk_sql("scored", "score", 0.2, 60, DIVERSE_PASSES, True)
    + """, rec AS (SELECT c.profile_id, c.paper_id, c.source, c.score, CAST(n_chars % 10 AS DOUBLE) / 10 AS quality, p.updated, p.title, p.lang, p.published
      FROM chosen_rows c JOIN papers p USING (paper_id) WHERE n_chars % 10 >= 5),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, quality DESC, updated DESC, paper_id) AS rank FROM rec)"""
)


def _recommended(spark, sf_dir):
    candidates, people = pool(spark, sf_dir)
    return plans.recommend(candidates, people, proposals_of(spark, sf_dir), NOW)


@query(
    "recommend",
    _RECOMMEND_SQL + " SELECT profile_id, rank, paper_id, source, round(score, 6) AS score, quality FROM ordered",
)
def recommend(spark, sf_dir):
    return _recommended(spark, sf_dir).select(
        "profile_id", F.col("rank").cast("long").alias("rank"), "paper_id", "source",
        F.round("score", 6).alias("score"), "quality",
    )


@query(
    "published_view",
    _RECOMMEND_SQL + """ SELECT profile_id, paper_id AS arxiv_id, strftime(published + INTERVAL 8 HOUR, '%Y-%m-%d') AS published_on, 'https://arxiv.org/abs/' || paper_id AS abstract_url
      FROM ordered WHERE lang = 'en' AND contains(lower(title || ' ' || title || ' ' || title), 'the')""",
)
def published_view(spark, sf_dir):
    rows = publishing.published_rows(_recommended(spark, sf_dir))
    valid, _ = contracts.check(rows, contracts.published())
    kept = publishing.reader_view(valid, category="en", topic="The")
    return kept.select("profile_id", "arxiv_id", "published_on", "abstract_url")


@query(
    "recommend_refined",
    f"""WITH RECURSIVE {SCORED_SQL}, {_JUDGED_SQL[len(PAPERS_SQL) + 2:]}, {_LISTING_SQL},
    short AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, paper_id) AS r0 FROM scored QUALIFY r0 <= 60),
    page AS (SELECT paper_id AS pid, 'Brand' || CAST(doc_id % 25 AS VARCHAR) || '/' || CAST(n_chars % 50 AS VARCHAR) AS repo, CASE n_chars % 3 WHEN 0 THEN true WHEN 1 THEN false END AS reachable FROM papers),
    material AS (SELECT pid, reachable, CASE WHEN NOT coalesce(reachable, false) OR n IS NULL OR n > 200 THEN NULL WHEN code AND ev AND da THEN 1.0 WHEN code AND ev THEN 0.8 WHEN code THEN 0.6 ELSE 0.2 END::DOUBLE AS m
      FROM page p LEFT JOIN flags f ON f.repo = p.repo),
    again AS (SELECT s.* EXCLUDE (score), j.u, j.advance, j.depth, list_avg(j.k) * (1 - j.u) AS sq, j.paper_id IS NOT NULL AS has_judgment,
        CASE WHEN j.paper_id IS NOT NULL THEN list_avg(list_filter([CASE WHEN reachable IS NOT NULL THEN CASE WHEN reachable THEN 1.0 ELSE 0.0 END END::DOUBLE, m], lambda x: x IS NOT NULL)) END AS rp, m
      FROM short s JOIN material ON pid = s.paper_id LEFT JOIN judged j ON j.paper_id = s.paper_id),
    rescored AS (SELECT *, (0.40 * interest_value + 0.05 * recency_value + 0.10 * identity_value + coalesce(0.35 * sq, 0) + coalesce(0.10 * rp, 0))
        / (0.55 + CASE WHEN sq IS NOT NULL THEN 0.35 ELSE 0 END + CASE WHEN rp IS NOT NULL THEN 0.10 ELSE 0 END) AS score FROM again),
    gated AS (SELECT * FROM rescored WHERE coalesce(sq, 0.25) >= 0.25 AND NOT (coalesce(1 - u >= 0.5, false) AND (coalesce(advance < 0.5, false) OR coalesce(depth < 0.5, false)))),
    {walk_sql("gated", "score", 0.2, 60, DIVERSE_PASSES, True)}
    SELECT c.profile_id, c.paper_id, c.source, round(c.score, 6) AS score, round(coalesce(g.sq, 0), 6) AS quality, g.m AS reproducibility
    FROM chosen_rows c JOIN gated g ON g.profile_id = c.profile_id AND g.paper_id = c.paper_id WHERE g.has_judgment""",
)
def recommend_refined(spark, sf_dir):
    candidates, people = pool(spark, sf_dir)
    judgments = materialized(judgments_of(spark, sf_dir), "judgments")
    pages = project_pages_of(spark, sf_dir)
    sections = papers(spark, sf_dir).select("paper_id").withColumns(
        {c: F.lit(None).cast("string") for c in ("method", "evaluation", "limitations")}
    )
    explanations = papers(spark, sf_dir).select(
        "paper_id", F.col("title").alias("summary"), F.col("title").alias("reason"),
        F.col("title").alias("limitation"),
    )
    run = plans.recommend_refined(
        candidates, people, NOW, judgments=judgments, explanations=explanations, sections=sections,
        pages=pages, materials=evidence.repository_materials(pages, listings(spark, sf_dir)),
    )
    return run["records"].select(
        "profile_id", "paper_id", "source", F.round("score", 6).alias("score"),
        F.round("quality", 6).alias("quality"), "reproducibility",
    )
