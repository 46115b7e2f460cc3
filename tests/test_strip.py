"""Stripped text against the plain pattern at both ends, and cleaning of cited records only."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from auditweave.functions.clean import clean_text, strip
from auditweave.operators import detectors, verify
from auditweave.operators.verify import H


def test_strip_equals_the_pattern_on_odd_text(spark):
    rng = random.Random(2)
    parts = [" ", "\t", "\n", "\r", "\x0b", "\x0c", "\x1f", "\x7f", "\x85", "\u2028", "\u2029", "\u3000", "\xa0", "~", "!", "a", "\xf1", "\U0001f600"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(7))) for _ in range(4000)]
    texts += ["", " ", "\x85", None, "a \x85", " a \u2028", "a \t\u2029", "a \x85\n", "a\r\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.regexp_replace(F.regexp_replace("t", r"^\s+", ""), r"\s+$", "")
    for r in df.select("t", strip("t").alias("got"), plain.alias("want"), clean_text("t").alias("clean")).collect():
        assert r.got == r.want and r.clean == (r.want or None), repr(r.t)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plain_text_is_stripped_without_a_pattern(spark):
    """A pattern at each end of each column made filters so long that they were not compiled."""
    plan = _plan(spark.createDataFrame([("a",)], "t string").repartition(1).select(strip("t").alias("t")))
    assert "trim" in plan and plan.count("regexp_replace") <= 1


@pytest.mark.parametrize("days", [0, 3, 7])
def test_windows_are_those_that_open_on_a_day_with_an_invoice(spark, days):
    from datetime import date, timedelta
    from types import SimpleNamespace

    rng = random.Random(days)
    rows = [(f"u{i:03d}", f"V{rng.randrange(3)}", "C", str(date(2024, 1, 1) + timedelta(rng.randrange(40))), 100.0 + rng.randrange(12) / 4) for i in range(90)]
    frame = spark.createDataFrame(rows, "uuid string, issuer_rfc string, receiver_rfc string, issue_date string, total double")
    clusters, members = detectors.similar_invoice_cluster(SimpleNamespace(invoices=frame), 3, days, 0.02)
    want = {}
    for vendor in {r[1] for r in rows}:
        mine, reach = [r for r in rows if r[1] == vendor], ""
        for start in sorted({r[3] for r in mine}):
            end = str(date.fromisoformat(start) + timedelta(days))
            held = [r for r in mine if start <= r[3] <= end]
            totals = sorted(r[4] for r in held)
            median = (totals[(len(totals) - 1) // 2] + totals[len(totals) // 2]) / 2
            if len(held) >= 3 and (totals[-1] - totals[0]) / median <= 0.02:
                last = max(r[3] for r in held)
                if last > reach:
                    want[vendor, start] = (last, len(held), pytest.approx(sum(totals)), {r[0] for r in held})
                reach = max(reach, last)
    by = defaultdict(set)
    for r in members.collect():
        by[r.observation_id].add(r.uuid)
    got = {(r.issuer_rfc, r.first_issue_date): (r.last_issue_date, r.invoice_count, r.cluster_total, by[r.observation_id]) for r in clusters.collect()}
    assert got == want


def test_only_cited_records_are_cleaned(spark):
    """The cleaning of a large table stands above the join with the cited records."""
    from types import SimpleNamespace

    from auditweave.sources.estate import TABLES

    row = tuple(f" {c} " for c in TABLES["invoices"])
    estate = SimpleNamespace(table=lambda name: spark.createDataFrame([row], list(TABLES["invoices"])).repartition(1))
    cited = spark.createDataFrame([("h", " uuid "), ("h", "lost")], f"{H} string, record_id string")
    found = verify.looked_up(cited, estate, "invoices", "uuid", strip("issuer_rfc").alias("issuer"), how="left")
    assert {(r[H], r.record_id, r.issuer) for r in found.collect()} == {("h", " uuid ", "issuer_rfc"), ("h", "lost", None)}
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert next(i for i, x in enumerate(lines) if "trim" in x) < next(i for i, x in enumerate(lines) if "Join" in x)
