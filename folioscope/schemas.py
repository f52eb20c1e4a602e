"""Declared schemas of the documents read and the tables kept."""

from __future__ import annotations

ATOM_ENTRY = """id string, updated string, published string, title string, summary string,
  author array<struct<name string, affiliation array<string>>>,
  category array<struct<_term string>>, doi string"""

RAW_ITEM = """key string, version bigint, data struct<key string, version bigint, itemType string,
  parentItem string, title string, abstractNote string, date string, note string,
  annotationText string, annotationComment string, DOI string, ISBN string, url string, extra string,
  deleted string, collections array<string>, tags array<struct<tag string, type int>>,
  creators array<struct<name string, firstName string, lastName string>>>"""

RAW_COLLECTION = """key string, version bigint,
  data struct<key string, version bigint, name string, parentCollection string>"""

CANDIDATE = """arxiv_id string, revision int, title string, authors array<string>,
  categories array<string>, published string, updated string, summary string,
  affiliations array<string>, doi string"""

POOL = f"""schema_version int, checkpoint string, seen_ids array<string>, in_progress string,
  degraded boolean, degraded_reason string, degraded_source_checkpoint string,
  candidates array<struct<{CANDIDATE}>>"""

IDENTITY = "struct<name string, aliases array<string>>"
FACET = "struct<kind string, value string, score double, confidence double, provenance array<string>>"

PROFILE = f"""schema_version int, source_library_version bigint, topics array<string>,
  core_categories array<string>, adjacent_categories array<string>,
  representative_terms array<string>, representative_papers array<string>,
  watched_authors array<{IDENTITY}>, watched_institutions array<{IDENTITY}>,
  source_library_synced_at string, preference_facets array<{FACET}>"""

SUBMISSION = "number bigint, body string"
ACTION = "arxiv_id string, action string, updated_at string"

FEEDBACK_EVENT = """event_id string, event_type string, paper_id string, occurred_at string,
  outcome string, batch_id string, displayed_rank int, reason_codes array<string>,
  supersedes_event_id string"""

FEEDBACK_LEDGER = f"""schema_version int, processed_issue_numbers array<bigint>,
  adjustments map<string,double>, legacy_adjustments map<string,double>,
  events array<struct<{FEEDBACK_EVENT}>>"""

CORPUS_EVENT = """event_id string, kind string, paper_id string, occurred_at string, source string,
  label string, compared_paper_id string, reason_codes array<string>,
  applicable_dimensions array<string>, private_rationale string, supersedes_event_id string,
  source_item_key string"""

CORPUS_LEDGER = f"schema_version int, events array<struct<{CORPUS_EVENT}>>"

SNAPSHOT = """schema_version int, snapshot_id string, corpus_revision bigint, corpus_digest string,
  cutoff_at string, splits array<struct<name string, paper_ids array<string>>>,
  labels array<array<string>>, pairwise_preferences array<array<string>>, label_count bigint,
  negative_count bigint, pairwise_count bigint, conflict_count bigint, created_at string"""

MANIFEST = """schema_version int, model string, candidate_count bigint,
  recommendation_count bigint, model_requests bigint, cache_hits bigint, estimated_tokens bigint,
  estimated_cost_usd double, duration_seconds double, generation_started_at string,
  generation_completed_at string, profile_library_version bigint, estimated_input_tokens bigint,
  estimated_output_tokens bigint, actual_input_tokens bigint, actual_output_tokens bigint,
  judge_requests bigint, explanation_requests bigint, judge_cache_hits bigint,
  explanation_cache_hits bigint, retry_count bigint, weight_set_version string,
  candidate_pool_degraded boolean, candidate_pool_degraded_reason string,
  candidate_pool_source_checkpoint string, actual_cost_usd double,
  provider_latency_seconds double, preference_context_enabled boolean,
  quality_profile_version string, quality_profile_criterion_count bigint,
  quality_profile_feedback_event_count bigint, scientific_value_filtered_count bigint"""

HISTORY = """schema_version int,
  entries array<struct<arxiv_id string, revision int, published_at string>>"""

FACT = """struct<availability string, confidence double, observed_at string, provider string,
  claim boolean>"""

EVIDENCE = f"""canonical_paper_id string, schema_version int, observed_at string,
  expires_at string, provider string, adapter_version string,
  repository struct<repository_url string, association {FACT}, license_present {FACT},
    archived {FACT}, releases {FACT}, documentation {FACT}, maintained {FACT}>,
  context struct<citation_count bigint, reference_count bigint, open_access {FACT},
    retracted {FACT}>"""

QUALITY_EXAMPLES = """schema_version int, examples array<struct<paper_id string, approved boolean,
  research_problems array<string>, methodological_expectations array<string>,
  evidence_standards array<string>, motivations array<string>,
  tolerated_limitations array<string>>>"""

_CRITERIA = "array<struct<name string, support double>>"
QUALITY_REGISTRY = f"""schema_version int, approved_version string,
  profiles array<struct<version string, schema_version int, policy_version string,
    policy_fingerprint string, research_problems {_CRITERIA},
    methodological_expectations {_CRITERIA}, evidence_standards {_CRITERIA},
    motivations {_CRITERIA}, tolerated_limitations {_CRITERIA}, approved_example_count bigint,
    explicit_feedback_event_count bigint>>"""

PUBLISHED_RECORD = """arxiv_id string, title string, authors array<string>,
  categories array<string>, published_on string, summary string, reason string,
  quota_source string, abstract_url string, pdf_url string, confidence double, quality double,
  uncertainty double, preference_signals array<string>, limitation string,
  quality_evidence_fields array<string>, reproducibility double, reproducibility_evidence string,
  evidence_provenance array<string>"""

PUBLISHED = f"""schema_version int, generated_at string, generation_started_at string,
  generation_completed_at string, artifact_built_at string, profile_library_version bigint,
  profile_snapshot_at string, profile_schema_version int, output_language string,
  recommendations array<struct<{PUBLISHED_RECORD}>>"""

WEIGHT_REGISTRY = """schema_version int, active_version string,
  weight_sets array<struct<version string, interest double, recency double, feedback double,
    identity double, scientific_quality double, reproducibility double, context double,
    negative_feedback_cap double, ablation boolean>>"""

WATCHLIST = f"""watched_authors array<{IDENTITY}>, watched_institutions array<{IDENTITY}>"""
