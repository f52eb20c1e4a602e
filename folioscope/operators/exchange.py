"""Tables around an external judge: records, cache split, packing, validation, usage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import hashing, identity, text
from folioscope.operators import contracts, scale
from folioscope.session import materialized

# ---- fixed values -------------------------------------------------------------------------
REQUEST_TOKENS = 12_000
REQUEST_BYTES = 64 * 1024
DIMENSIONS = [
    "contribution_clarity", "novelty", "solution_advance", "technical_depth",
    "insight_plausibility", "methodological_evidence", "empirical_evidence", "limitations",
]
LEGACY_DIMENSIONS = [
    "contribution_clarity", "novelty", "insight_plausibility", "methodological_evidence",
    "empirical_evidence", "limitations",
]
CONTRACT_DIMENSIONS = {
    "judge-v3": LEGACY_DIMENSIONS, "judge-v4": LEGACY_DIMENSIONS, "judge-v5": DIMENSIONS,
}
QUALITY_DIMENSIONS = DIMENSIONS[:-1]
JUDGE_EVIDENCE = [
    "title", "authors", "categories", "published", "summary", "method_evidence",
    "evaluation_evidence", "limitations_evidence",
]
EXPLANATION_EVIDENCE = [*JUDGE_EVIDENCE[:5], "quality_dimensions", "quality_uncertainty", *JUDGE_EVIDENCE[5:]]
SIGNALS = [
    "topic_overlap", "category_overlap", "preference_facet_overlap", "watched_author",
    "watched_institution",
]
MOST_SIGNALS = 4
RESPONSES_PER_TASK = 5_000
# -------------------------------------------------------------------------------------------


def model_record() -> Column:
    """Public metadata of a candidate; long lists are cut, texts never are."""
    return F.struct(
        F.col("paper_id").alias("arxiv_id"),
        "title",
        F.slice("authors", 1, 10).alias("authors"),
        F.slice("categories", 1, 10).alias("categories"),
        F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("published"),
        "summary",
    )


def fingerprint() -> Column:
    """Hash of everything a judge sees of a candidate, and its revision (H1)."""
    return hashing.content_hash([model_record().alias("record"), "revision", "updated"])


def judge_record(reference: Column | None = None) -> Column:
    """Record for judging: evidence that is absent is left out."""
    extra = [] if reference is None else [reference.alias("quality_reference")]
    return F.struct(
        model_record()["arxiv_id"].alias("arxiv_id"), "title",
        F.slice("authors", 1, 10).alias("authors"),
        F.slice("categories", 1, 10).alias("categories"),
        model_record()["published"].alias("published"), "summary",
        F.col("method").alias("method_evidence"),
        F.col("evaluation").alias("evaluation_evidence"),
        F.col("limitations").alias("limitations_evidence"), *extra,
    )


def relevance_signals() -> Column:
    """At most four categorical reasons a candidate was preferred."""
    checks = [
        F.col("lexical") > 0, F.col("category") >= 0.6, F.col("facet") > 0,
        F.col("watched_author") > 0, F.col("watched_institution") > 0,
    ]
    flags = F.array(*[F.when(c, F.lit(s)) for c, s in zip(checks, SIGNALS, strict=True)])
    return F.slice(F.array_compact(flags), 1, MOST_SIGNALS)


def explanation_record(with_signals: bool = False) -> Column:
    """Record for explaining a selected paper."""
    extra = [relevance_signals().alias("relevance_signals")] if with_signals else []
    return F.struct(
        model_record()["arxiv_id"].alias("arxiv_id"), "title",
        F.slice("authors", 1, 10).alias("authors"),
        F.slice("categories", 1, 10).alias("categories"),
        model_record()["published"].alias("published"), "summary",
        F.col("dimensions").alias("quality_dimensions"),
        F.col("uncertainty").alias("quality_uncertainty"),
        F.col("method").alias("method_evidence"),
        F.col("evaluation").alias("evaluation_evidence"),
        F.col("limitations").alias("limitations_evidence"), *extra,
    )


def token_estimate(record_json: Column) -> Column:
    """A quarter of the bytes, at least one (M3)."""
    return F.greatest(F.lit(1), F.floor(F.octet_length(record_json) / 4).cast("int"))


def proposal_key(profile_version, prompt_version: str, model: str) -> Column:
    """Cache key of a proposal (H2)."""
    return hashing.joined_key(
        F.col("paper_id"), F.lit(str(profile_version)), prompt_version, model, fingerprint()
    )


def layered_key(layer, profile_digest, evidence_snapshot, contract, model, language) -> Column:
    """Cache key of a judgment or explanation over every input that matters (H2)."""
    return hashing.joined_key(
        layer, F.col("paper_id"), fingerprint(), profile_digest, evidence_snapshot, contract, model,
        language,
    )


def split_by_cache(wanted: DataFrame, cache: DataFrame, valid: Column) -> DataFrame:
    """Wanted keys with their cached payload; an invalid payload counts as a miss."""
    joined = wanted.join(cache.select("cache_key", "payload"), "cache_key", "left")
    hit = F.col("payload").isNotNull() & F.coalesce(valid, F.lit(False))
    return joined.withColumn("hit", hit).withColumn("payload", F.when(F.col("hit"), F.col("payload")))


# ---- packing --------------------------------------------------------------------------------


def _batches(records: Column, most: int, tokens: int, size: int) -> Column:
    """Batch numbers of one run's ordered records: a record starts a new batch where the open one
    has no place left for it. A batch of n records is a JSON list: two brackets, n - 1 commas.
    """
    start = F.struct(
        F.array().cast("array<int>").alias("numbers"), F.lit(0).alias("records"),
        F.lit(0).cast("long").alias("tokens"), F.lit(0).cast("long").alias("bytes"),
    )

    def put(open_: Column, record: Column) -> Column:
        text = open_["bytes"] + record["bytes"] + 2 + open_["records"]
        fits = (
            (open_["records"] < most) & (open_["tokens"] + record["tokens"] <= tokens) & (text <= size)
        )
        number = F.coalesce(F.try_element_at(open_["numbers"], F.lit(-1)), F.lit(1)) + F.when(
            fits | (open_["records"] == 0), 0).otherwise(1)
        carried = lambda name, own: F.when(fits, open_[name] + own).otherwise(own).alias(name)
        return F.struct(
            F.concat(open_["numbers"], F.array(number)).alias("numbers"),
            carried("records", F.lit(1)), carried("tokens", record["tokens"].cast("long")),
            carried("bytes", record["bytes"].cast("long")),
        )

    return F.aggregate(records, start, put, lambda done: done["numbers"])


def pack_records(
    records: DataFrame,
    *,
    batch_size: int = 40,
    max_requests: int = 2,
    max_tokens: int = REQUEST_TOKENS,
    max_bytes: int = REQUEST_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Batches of whole records per run, and the runs that do not fit their request budget.

    ``records``: ``run_id``, ``paper_id``, ``record_order``, ``record`` (JSON text). A run with
    more records than ``batch_size * max_requests`` can never fit, so it is refused by counting
    and only runs of bounded size are packed.
    """
    if min(batch_size, max_requests, max_tokens, max_bytes) < 1:
        raise ValueError("batch limits must be positive")
    sized = records.select(
        "run_id", "paper_id", "record_order",
        F.octet_length("record").alias("bytes"), token_estimate(F.col("record")).alias("tokens"),
    )
    oversized = (F.col("tokens") > max_tokens) | (F.col("bytes") + 2 > max_bytes)
    runs = sized.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(oversized).alias("oversized")
    )
    most = batch_size * max_requests
    reason = F.when(F.col("oversized") > 0, "record exceeds the request budget").when(
        F.col("records") > most, "run exceeds the request budget"
    )
    fitting = runs.filter(reason.isNull()).select("run_id")
    ordered = sized.join(fitting, "run_id", "left_semi").groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("record_order", "paper_id", "tokens", "bytes"))).alias("_r")
    )
    numbered = F.arrays_zip(
        F.col("_r.paper_id").alias("paper_id"),
        _batches(F.col("_r"), batch_size, max_tokens, max_bytes).alias("batch_no"),
    )
    packed = ordered.select("run_id", F.inline(numbered).alias("paper_id", "batch_no"))
    used = packed.groupBy("run_id").agg(F.max("batch_no").alias("_used"))
    too_many = used.filter(F.col("_used") > max_requests).select(
        "run_id", F.lit("run exceeds the request budget").alias("reason")
    )
    refused = runs.filter(reason.isNotNull()).select("run_id", reason.alias("reason"))
    kept = packed.join(used.filter(F.col("_used") <= max_requests), "run_id", "left_semi")
    return kept, refused.unionByName(too_many)


# ---- validation -----------------------------------------------------------------------------


def _entries(responses: DataFrame, field: str) -> DataFrame:
    """Raw JSON text of every entry of a response.

    Responses are dealt anew by number: they are small and dear to parse, so tasks cut by bytes are few.
    """
    whole = F.col("content")
    responses = scale.spread_rows(responses, RESPONSES_PER_TASK)
    listed = F.from_json(F.get_json_object(whole, f"$.{field}"), "array<string>")
    exact = F.json_object_keys(whole) == F.array(F.lit(field))
    return responses.select(
        "batch_id", F.explode_outer(F.when(exact, listed)).alias("entry")
    )


def _keys(entry: Column) -> Column:
    return F.array_sort(F.json_object_keys(entry))


def _names(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in sorted(names)])


def _raw(entry: Column, *names: str) -> Column:
    """Raw texts of some fields, from one parse."""
    return F.from_json(entry, ", ".join(f"{n} string" for n in names))


def _number(entry: str, raw: str, name: str) -> Column:
    """A JSON number among the ``raw`` texts of ``entry``, NULL for any other kind of value."""
    text_, quoted = F.col(raw)[name], F.col(entry).rlike(rf'"{name}"\s*:\s*"')
    return F.when(~quoted & text_.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), text_.cast("double"))


def _within(value: Column, low: int, high: int) -> Column:
    return F.length(value).between(low, high)


def _complete(rows: DataFrame, rules: contracts.Rules, kept: Sequence[str], requested: DataFrame):
    """Entries that keep every rule, in batches that are all or nothing: every requested paper once,
    none beside them (J26).

    Entries are written once, each with the rule it breaks. Filters on a rule would otherwise be moved
    below the steps that parse, and parse an entry again for every use of each of its fields.
    """
    marked = contracts.marked(rows, rules, "why")
    answers = materialized(marked.select("batch_id", "why", *kept), "answers")
    valid = answers.filter(F.col("why").isNull()).drop("why")
    rejects = answers.filter(F.col("why").isNotNull()).select("batch_id", F.col("why").alias("reason"))
    answered = valid.groupBy("batch_id", "paper_id").agg(F.count(F.lit(1)).alias("_n"))
    matched = requested.select("batch_id", "paper_id", F.lit(1).alias("_asked")).join(
        answered, ["batch_id", "paper_id"], "full_outer"
    )
    reason = (
        F.when(F.col("_asked").isNull(), "paper was not requested")
        .when(F.col("_n").isNull(), "requested paper is missing")
        .when(F.col("_n") > 1, "paper is answered twice")
    )
    broken = matched.withColumn("reason", reason).filter(F.col("reason").isNotNull())
    all_rejects = rejects.unionByName(
        broken.select("batch_id", "reason")
    )
    failed = all_rejects.select("batch_id").distinct()
    return valid.join(failed, "batch_id", "left_anti"), all_rejects


def parse_proposals(responses: DataFrame, requested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Validated proposals and the reasons other batches fail (V8)."""
    e = F.col("entry")
    value = F.from_json(e, "arxiv_id string, summary string, reason string")
    rows = _entries(responses, "proposals").select(
        "batch_id", "entry", value.alias("v"), _raw(e, "quality").alias("raw")
    ).select(
        "*", "v.*", identity.paper_id(F.col("v.arxiv_id")).alias("paper_id"),
        _number("entry", "raw", "quality").alias("quality"),
    )
    rules = {
        "unsupported fields": _keys(e) == _names("arxiv_id", "quality", "summary", "reason"),
        "identifier is malformed": F.col("paper_id").isNotNull(),
        "quality is invalid": F.col("quality").between(0, 1),
        "text is invalid": _within(F.col("summary"), 24, 800) & _within(F.col("reason"), 24, 400),
        "reason is generic": ~text.is_generic_reason(F.col("reason")),
    }
    return _complete(rows, rules, ["paper_id", "quality", "summary", "reason"], requested)


def _evidence_ok(allowed: Sequence[str]) -> Column:
    fields = F.col("evidence_fields")
    return (
        F.size(fields).between(2, 6)
        & (F.size(F.array_except(fields, F.array(*map(F.lit, allowed)))) == 0)
        & (F.size(F.array_distinct(fields)) == F.size(fields))
    )


def parse_judgments(
    responses: DataFrame,
    requested: DataFrame,
    *,
    contract: str = "judge-v5",
    allowed: Sequence[str] = JUDGE_EVIDENCE,
) -> tuple[DataFrame, DataFrame]:
    """Validated judgments and the reasons other batches fail (V9)."""
    if contract not in CONTRACT_DIMENSIONS:
        raise ValueError("judge contract is unsupported")
    e = F.col("entry")
    names = CONTRACT_DIMENSIONS[contract]
    value = F.from_json(e, "arxiv_id string, dimensions string, evidence_fields array<string>")
    rows = _entries(responses, "judgments").select(
        "batch_id", "entry", value.alias("v"), _raw(e, "uncertainty").alias("raw")
    ).select("*", "v.*").select(
        "*", identity.paper_id(F.col("arxiv_id")).alias("paper_id"),
        _number("entry", "raw", "uncertainty").alias("uncertainty"),
        _raw(F.col("dimensions"), *names).alias("raw_dimensions"),
    )
    d = F.col("dimensions")
    null = lambda n: F.coalesce(d.rlike(rf'"{n}"\s*:\s*null'), F.lit(False))
    scored = rows.select(
        "batch_id", "entry", "paper_id", "uncertainty", "evidence_fields", _keys(d).alias("named"),
        F.array(*[null(n) for n in names]).alias("null"),
        F.array(*[_number("dimensions", "raw_dimensions", n) for n in names]).alias("scores"),
    )
    sound = F.forall(
        F.arrays_zip("null", "scores"),
        lambda x: x["null"] | F.coalesce(x["scores"].between(0, 1), F.lit(False)),
    )
    rules = {
        "unsupported fields": _keys(e)
        == _names("arxiv_id", "dimensions", "uncertainty", "evidence_fields"),
        "identifier is malformed": F.col("paper_id").isNotNull(),
        "dimensions are invalid": (F.col("named") == _names(*names)) & sound,
        "uncertainty is invalid": F.col("uncertainty").between(0, 1),
        "evidence references are invalid": _evidence_ok(allowed),
    }
    shaped = scored.withColumn(
        "dimensions", F.map_from_arrays(F.array(*map(F.lit, names)), "scores"))
    return _complete(
        shaped, rules, ["paper_id", "dimensions", "uncertainty", "evidence_fields"], requested)


def parse_explanations(
    responses: DataFrame, requested: DataFrame, allowed: Sequence[str] = EXPLANATION_EVIDENCE
) -> tuple[DataFrame, DataFrame]:
    """Validated explanations and the reasons other batches fail."""
    e = F.col("entry")
    shape = (
        "arxiv_id string, summary string, reason string, limitation string, "
        "evidence_fields array<string>"
    )
    rows = _entries(responses, "explanations").select(
        "batch_id", "entry", F.from_json(e, shape).alias("v")
    ).select("*", "v.*", identity.paper_id(F.col("v.arxiv_id")).alias("paper_id"))
    texts = F.lit(True)
    for name in ("summary", "reason", "limitation"):
        texts = texts & _within(F.col(name), 20, 800)
    rules = {
        "unsupported fields": _keys(e)
        == _names("arxiv_id", "summary", "reason", "limitation", "evidence_fields"),
        "identifier is malformed": F.col("paper_id").isNotNull(),
        "text is invalid": texts,
        "reason is generic": ~text.is_generic_reason(F.col("reason")),
        "evidence references are invalid": _evidence_ok(allowed),
    }
    return _complete(
        rows, rules, ["paper_id", "summary", "reason", "limitation", "evidence_fields"], requested)


def usage_totals(usage: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Totals per run; measured tokens only when every batch reported them."""
    whole = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.sum(c)).alias(c)
    summed = [
        F.sum(c).alias(c)
        for c in ("requests", "cache_hits", "estimated_input", "estimated_output", "retry_count")
    ]
    return usage.groupBy(*by).agg(
        *summed, whole("actual_input"), whole("actual_output"), F.sum("latency").alias("latency")
    )


# ---- judgments as ranking inputs --------------------------------------------------------------


def _mean_quality() -> Column:
    known = F.filter(
        F.array(*[F.try_element_at("dimensions", F.lit(n)) for n in QUALITY_DIMENSIONS]),
        lambda v: v.isNotNull(),
    )
    return F.when(
        F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known)
    )


def judged_quality() -> Column:
    """Mean known quality dimension times certainty; nothing known is zero."""
    return F.coalesce(_mean_quality() * (1.0 - F.col("uncertainty")), F.lit(0.0))


def judgment_features(judgments: DataFrame, contract: str = "judge-v5") -> DataFrame:
    """Judged quality as a ranking feature."""
    mean = _mean_quality()
    return judgments.select(
        "paper_id",
        F.lit("judge_quality").alias("name"),
        F.coalesce(mean, F.lit(0.0)).alias("value"),
        mean.isNotNull().alias("applicable"),
        F.when(mean.isNotNull(), 1.0 - F.col("uncertainty")).otherwise(0.0).alias("confidence"),
        F.lit(contract).alias("provenance"),
        F.lit("scientific_quality").alias("grp"),
    )


def value_assessments(judgments: DataFrame) -> DataFrame:
    """The two value dimensions and their certainty, where either is known (A10)."""
    advance = F.try_element_at("dimensions", F.lit("solution_advance"))
    depth = F.try_element_at("dimensions", F.lit("technical_depth"))
    return judgments.select(
        "paper_id", advance.alias("solution_advance"), depth.alias("technical_depth"),
        (1.0 - F.col("uncertainty")).alias("value_confidence"),
    ).filter(F.col("solution_advance").isNotNull() | F.col("technical_depth").isNotNull())
