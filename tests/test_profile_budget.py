"""Old profile exports are read, projected anew and held to their byte budget."""

import json

import pytest
from pyspark.sql import functions as F

from folioscope.operators import contracts, profile
from folioscope.sources import readers, writers

TOPICS = [f"topic{'x' * (i % 5)}{i}" for i in range(33)] + ["größe"]


def export(version):
    row = {"schema_version": version, "source_library_version": 7, "topics": ["sk-abcdefghijkl9999", *TOPICS],
           "core_categories": ["cs.LG", "cs.CL", "a", "b", "c", "d", "e"], "adjacent_categories": ["stale"],
           "representative_terms": ["stale"], "representative_papers": [["2024", ["t"], ["cs.LG"]]]}
    if version >= 2:
        row |= {"watched_authors": [{"name": "Ada", "aliases": ["A. L."]}], "watched_institutions": []}
    if version >= 3:
        row["source_library_synced_at"] = "2026-08-01T00:00:00+00:00"
    if version >= 4:
        row["preference_facets"] = [
            {"kind": "domain", "value": f"v{i}", "score": 1.0, "confidence": 0.5, "provenance": ["me"]} for i in range(3)]
    return row


def compact(row):
    return len(json.dumps(row, ensure_ascii=False, separators=(",", ":")).encode())


@pytest.mark.parametrize("version", [1, 2, 3, 4])
def test_every_version_is_projected_anew(spark, tmp_path, version):
    (tmp_path / "me.json").write_text(json.dumps(export(version)))
    got = readers.read_remote_profiles(spark, str(tmp_path / "me.json"))
    row = got.first()
    assert (row.profile_id, row.schema_version, row.within_budget) == ("me", 4, True)
    assert row.topics == TOPICS[:30] and row.representative_terms == TOPICS[:12]
    assert row.core_categories == ["cs.LG", "cs.CL", "a", "b", "c", "d"]
    assert row.adjacent_categories == ["cs.AI", "cs.NE", "stat.ML"]
    assert len(row.watched_authors) == (version >= 2) and len(row.preference_facets) == (3 if version == 4 else 0)
    assert contracts.check(got.drop("payload_bytes", "within_budget"), contracts.remote_profile())[1].count() == 0
    with pytest.raises(Exception, match="over its byte budget: me"):
        readers.read_remote_profiles(spark, str(tmp_path / "me.json"), budget=row.payload_bytes - 1).collect()
    assert readers.read_remote_profiles(spark, str(tmp_path / "me.json"), budget=row.payload_bytes).count() == 1


def brute(row, budget, beside):
    """Lists filled one by one, entry by entry, each candidate payload encoded whole."""
    lists = [c for c in profile.PAYLOAD_LISTS if c in row]
    out = {k: ([] if k in lists and v is not None else v) for k, v in row.items() if k not in beside}
    size = lambda: compact({k: v for k, v in out.items() if v is not None})
    for c in lists:
        for entry in row[c] or []:
            out[c] = out[c] + [entry]
            if size() > budget:
                out[c] = out[c][:-1]
                break
    return out, size()


def test_lists_keep_their_longest_prefixes(spark):
    rows = [
        ("a", "note", TOPICS, ["cs.LG", "q\"uote"], [{"kind": "k", "value": "ü"}, {"kind": "k", "value": "w" * 40}]),
        ("b", None, None, [], []), ("c", "", ["", "x" * 5000, "short"], None, [{"kind": "k", "value": "v"}]),
        ("c", "", ["", "x" * 5000, "short"], None, [{"kind": "k", "value": "v"}]),
    ]
    schema = "profile_id string, extra string, topics array<string>, core_categories array<string>, preference_facets array<struct<kind string, value string>>"
    df = spark.createDataFrame(rows, schema)
    names = ["profile_id", "extra", "topics", "core_categories", "preference_facets"]
    for budget in (0, 80, 120, 200, 300, 6000):
        got = profile.fit_budget(df, budget, beside=["profile_id"]).orderBy("profile_id").collect()
        assert len(got) == len(rows)
        for r, values in zip(got, rows):
            want, size = brute(dict(zip(names, values)), budget, ["profile_id"])
            held = r.asDict(recursive=True)
            assert {k: held[k] for k in want} == want and r.payload_bytes == size
            assert r.within_budget == (size <= budget)
    assert profile.fit_budget(df.limit(0), 80).count() == 0
    everything = profile.fit_budget(df.filter(F.col("profile_id") == "a")).first()
    assert everything.topics == TOPICS and everything.within_budget


def test_export_of_older_versions_reads_back(spark, tmp_path):
    (tmp_path / "me.json").write_text(json.dumps(export(4)))
    now = readers.read_remote_profiles(spark, str(tmp_path / "me.json"))
    for version in (1, 2, 3, 4):
        path = str(tmp_path / f"v{version}")
        writers.exported_profile(now.drop("profile_id", "payload_bytes", "within_budget"), version).write.json(path)
        back = readers.read_remote_profiles(spark, path).first()
        assert back.topics == TOPICS[:30] and len(back.preference_facets) == (3 if version == 4 else 0)
