"""Sets of evidence, references to sets, broken log lines and the audit report."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from auditweave.operators import audits, cases, evidence
from auditweave.sources import files


def refs(spark, rows):
    return spark.createDataFrame([(c, e, "d", "t", r) for c, e, r in rows], "case_id string, evidence_id string, produced_by string, source_table string, record_id string")


def test_sets_and_their_items(spark):
    rows = [("A", f"e{i}", r) for r, items in {"r1": (1, 2, 3), "r2": (3, 2, 1), "r3": (1, 2), "r4": (4,), "r5": (2, 1)}.items() for i in items]
    rows += [("B", "e1", "r1"), ("B", "e2", "r1"), ("A", "e1", "r1"), ("C", "e1", "r1")]
    sets, items, records = evidence.dependency_sets(refs(spark, rows))
    by = {}
    for r in items.collect():
        by.setdefault((r.case_id, r.set_id), set()).add(r.evidence_id)
    held = {}
    for r in records.collect():
        held.setdefault((r.case_id, r.set_id), set()).add(r.record_id)
    assert sorted((c, sorted(by[c, s]), sorted(held[c, s])) for c, s in by) == [
        ("A", ["e1", "e2"], ["r3", "r5"]), ("A", ["e1", "e2", "e3"], ["r1", "r2"]), ("B", ["e1", "e2"], ["r1"])]
    assert {(r.case_id, r.set_id): (r["items"], r.shared_records) for r in sets.collect()} == {k: (len(by[k]), len(held[k])) for k in by}


def test_a_record_that_only_shares_the_digest_is_told_apart(spark, monkeypatch):
    monkeypatch.setattr(evidence, "member_digest", lambda member: F.lit("same"))
    rows = [("A", e, r) for r, items in {"r1": "ab", "r2": "ab", "r3": "bc"}.items() for e in items]
    _, items, records = evidence.dependency_sets(refs(spark, rows))
    of = {r.record_id: r.set_id for r in records.collect()}
    assert of["r1"] == of["r2"] != of["r3"]
    got = {}
    for r in items.collect():
        got.setdefault(r.set_id, set()).add(r.evidence_id)
    assert got == {of["r1"]: {"a", "b"}, of["r3"]: {"b", "c"}}


def test_many_hypotheses_refer_to_their_evidence(spark):
    """500 hypotheses on 2,000 items take 500 references and the exceptions, not a million rows."""
    hypotheses = spark.range(500).select(F.lit("A").alias("case_id"), F.format_string("H%d", "id").alias("hypothesis_id"),
                                         F.when(F.col("id") % 10 == 0, "rejected").otherwise("open").alias("status"))
    items = spark.range(2000).select(F.lit("A").alias("case_id"), F.format_string("E%d", "id").alias("evidence_id"))
    cites = [("A", "H1", "counter", "E5"), ("A", "H1", "counter", "E6"), ("A", "H1", "supporting", "E6"), ("A", "H1", "supporting", "E7"),
             ("A", "H2", "supporting", "outside"), ("A", "H10", "supporting", "E1"), ("A", "H10", "counter", "E2"), ("Z", "H1", "supporting", "E1")]
    citations = spark.createDataFrame(cites, "case_id string, hypothesis_id string, side string, evidence_id string")
    references, exceptions = cases.evidence_by_set(hypotheses, citations, items)
    assert references.count() == 450
    assert {tuple(r) for r in exceptions.collect()} == {("A", "H1", "E5", "excluded"), ("A", "H2", "outside", "added"), ("A", "H10", "E1", "added"), ("Z", "H1", "E1", "added")}
    whole = cases.attach_evidence(hypotheses, citations, items)
    assert whole.count() == whole.distinct().count() == 450 * 2000 - 1 + 3


def test_broken_lines_are_kept_and_counted(spark, tmp_path):
    good = [json.dumps({"response_text": f"t{i}", "usage": {"input_tokens": i, "output_tokens": 1}}) for i in range(5)] + [json.dumps({"response_text": None, "usage": None, "x": 1})]
    broken = ['{"response_text": "half', "[1]", "not json", '{"response_text": "x", "usage": 7}']
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text("\n".join([*good, "", "  ", *broken]) + "\n")
    recordings, bad = files.split_recordings(spark, str(tmp_path / "log"))
    assert {r.response_text for r in recordings.collect()} == {f"t{i}" for i in range(5)}
    assert {(r.file, r.line) for r in bad.collect()} == {("a.jsonl", line) for line in broken}
    assert files.load_recordings(spark, str(tmp_path / "log")).count() == 5


@pytest.mark.parametrize("samples", [1, 3])
def test_report_samples_the_least_ids(spark, samples):
    rows = [("a", "t", f"id{i % 40:02d}") for i in range(4000)] + [("b", "t", "x"), ("b", "t", None), ("c", "t", None)]
    df = spark.createDataFrame(rows, "check_name string, source_table string, record_id string").repartition(5)
    got = {r.check_name: (r.violations, r.first_id, r.sample_ids) for r in audits.audit_report(df, samples, (("a", "t"), ("b", "t"), ("c", "t"), ("d", "t"))).collect()}
    assert got["a"] == (4000, "id00", ["id00", "id01", "id02"][:samples])
    assert got["b"][0] == 2 and got["c"][0] == 1 and got["d"] == (0, None, [])
