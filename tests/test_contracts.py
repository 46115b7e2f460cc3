"""Sources, claims and the gate on small fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from auditweave.functions import clean
from auditweave.operators import findings, verify
from auditweave.operators.verify import H
from auditweave.plans import registry
from auditweave.sources.estate import TABLES, Estate, EstateContractError, check_estate

SMALL = "/root/testdata/sf0.001"


def _table(spark, name, rows):
    numbers = {"subtotal", "iva", "total", "debit", "credit", "amount", "value"}
    schema = ", ".join(f"{c} {'double' if c in numbers else 'string'}" for c in TABLES[name])
    return spark.createDataFrame([[r.get(c) for c in TABLES[name]] for r in rows], schema)


def _estate(spark, **rows) -> Estate:
    return check_estate({name: _table(spark, name, rows.get(name, [])) for name in TABLES})


def test_missing_tables_and_columns_are_listed(spark):
    frames = {name: _table(spark, name, []) for name in TABLES}
    with pytest.raises(EstateContractError, match="ledger"):
        check_estate({k: v for k, v in frames.items() if k != "ledger"})
    with pytest.raises(EstateContractError, match="vendors: rfc"):
        check_estate({**frames, "vendors": frames["vendors"].drop("rfc")})
    assert check_estate({**frames, "vendors": frames["vendors"].withColumn("extra", F.lit(1))})


def test_cleaning_expressions(spark):
    row = spark.range(1).select(
        clean.clean_text(F.lit("\t \n")).alias("blank"), clean.iso_date(F.lit("2025-02-30")).alias("bad"), clean.iso_date(F.lit(" 2025-02-28 ")).alias("good"),
        clean.to_number(F.lit("1e999")).alias("inf"), clean.entity_prefix("EMP:", F.lit("EMP:1")).alias("once"),
        clean.clip(F.lit("abcdefghij"), 6).alias("cut"), clean.null_like(F.lit(" N/A ")).alias("none")).first()
    assert tuple(row) == (None, None, "2025-02-28", None, "EMP:1", "abc...", None)


def _sweep(spark, listing, invoices):
    e = _estate(spark, efos_list=listing, invoices=invoices)
    return {r[H].split("-")[1]: r for r in verify.efos_authorisation_sweep(e).collect()}


def _bill(uuid, issuer, day, total=100.0):
    return {"uuid": uuid, "issuer_rfc": issuer, "receiver_rfc": "CO", "issue_date": day, "total": total, "status": "vigente"}


def test_listing_sweep_outcomes(spark):
    listing = [{"rfc": r, "status": s, "publication_date": d} for r, s, d in (
        ("GOOD", " Definitivo ", "2024-01-01"), ("SOFT", "presunto", "2024-01-01"), ("LATE", "definitivo", "2025-01-01"),
        ("NODATE", "definitivo", "2024-13-01"), ("FEW", "definitivo", "2024-01-01"), ("QUIET", "definitivo", "2024-01-01"))]
    bills = [_bill(f"{r}-{i}", r, f"2024-0{i + 1}-10") for r in ("GOOD", "SOFT", "LATE", "NODATE") for i in range(3)] + [_bill("FEW-0", "FEW", "2024-05-01")]
    got = _sweep(spark, listing, bills)
    assert set(got) == {"GOOD", "SOFT", "LATE", "NODATE", "FEW"}
    assert got["GOOD"].outcome == "authorize_probable" and got["GOOD"].claimed_amount == 300.0
    assert all(got[r].outcome == "inconclusive" for r in ("SOFT", "LATE", "NODATE", "FEW"))
    assert any("fewer than 3" in x for x in got["FEW"].failed_requirements)


def test_claims_refuse_out_of_scope_and_unusable_records(spark):
    e = _estate(spark, efos_list=[{"rfc": "L", "status": "definitivo", "publication_date": "2024-01-01"}],
                invoices=[_bill("a", "L", "2024-02-01"), _bill("b", "OTHER", "2024-02-01"), _bill("c", "L", "2024-02-01", None), _bill("d", "L", "2024-02-01", -5.0)])
    cases = {"mixed": ["a", "b"], "null": ["a", "c"], "none": [], "minus": ["d"], "fine": ["a"]}
    hyp = spark.createDataFrame([(h, "phantom_vendor", "open") for h in cases] + [("nolist", "phantom_vendor", "open"), ("other", "round_trip", "open")],
                                f"{H} string, scheme_type string, status string")
    cites = [(h, "e", 0, "efos_list", "L", None) for h in cases] + [(h, "e", 1, "invoices", u, None) for h, us in cases.items() for u in us]
    cites += [("nolist", "e", 1, "invoices", "a", None)]
    refs = verify.cited_refs(spark.createDataFrame(cites, f"{H} string, evidence_id string, evidence_no int, source_table string, record_id string, note string"))
    got = {r[H]: (r.error, r.claimed_amount) for r in verify.route_claims(e, hyp, refs).collect()}
    assert got == {"mixed": ("records out of scope", None), "null": ("unusable amount", None), "none": ("no record in scope", None),
                   "minus": ("total is not positive", None), "fine": (None, 100.0), "nolist": ("no listed entity", None),
                   "other": ("no scope rule for this scheme", None)}


@pytest.mark.parametrize("claim, ok", [(102.0, True), (98.0, True), (102.01, False), (97.9, False)])
def test_reconciliation_edge_is_two_percent(spark, claim, ok):
    claims = spark.createDataFrame([("h", claim)], f"{H} string, claimed_amount double")
    ex = spark.createDataFrame([("h", "invoices", 100.0, True), ("h", "bank_txns", 5.0, True)], f"{H} string, source_table string, amount double, found boolean")
    assert verify.peso_reconciliation(claims, ex).first().reconciles is ok


def test_kickback_needs_the_exact_approver_and_two_accounts(spark):
    e = _estate(spark, vendors=[{"rfc": "V", "bank_clabe": "1"}, {"rfc": "SELF", "bank_clabe": "9"}],
                employees=[{"emp_id": "EMP:1", "name": "Ana Trevino", "bank_clabe": "2"}, {"emp_id": "EMP:9", "name": "Self", "bank_clabe": "9"}],
                bank_txns=[{"txn_id": "t", "from_clabe": "1", "to_clabe": "2", "amount": 10.0, "date": "2024-01-01"}],
                purchase_orders=[{"po_id": "p1", "vendor_rfc": "V", "approver": "Mariana Ana Trevino"}, {"po_id": "p2", "vendor_rfc": "V", "approver": "Ana Trevino"}])
    cites = {"near": ["vendors:V", "employees:EMP:1", "bank_txns:t", "purchase_orders:p1"], "exact": ["vendors:V", "employees:EMP:1", "bank_txns:t", "purchase_orders:p2"],
             "same": ["vendors:SELF", "employees:EMP:9"], "none": ["vendors:V"]}
    rows = [(h, "e", 0, *c.split(":", 1), None) for h, cs in cites.items() for c in cs]
    citations = spark.createDataFrame(rows, f"{H} string, evidence_id string, evidence_no int, source_table string, record_id string, note string")
    hyp = spark.createDataFrame([(h, "kickback", "supported") for h in cites], f"{H} string, scheme_type string, status string")
    exhibits, _ = verify.resolve_exhibits(e, citations)
    got = {r[H]: (r.status, r.reason) for r in verify.kickback_assessment(e, hyp, exhibits)[0].collect()}
    assert got["exact"] == ("verified", None)
    assert got["near"] == ("unresolved", "no cited order approved by that employee")
    assert got["same"] == ("unresolved", "shared account, but no transfer between two accounts")
    assert got["none"] == ("unresolved", "one side has no account")
    reviews = hyp.select(H, F.lit("survives").alias("challenger"), F.lit("clear").alias("method_critic"), F.lit(False).alias("useful_actions_remain"))
    tables = findings.build_findings(e, hyp, citations, reviews)
    assert [r[H] for r in tables["findings"].collect()] == ["exact"]
    assert sorted(r.entity for r in tables["entities"].collect()) == ["EMP:1", "RFC:V"]
    assert [r.exhibit_id for r in tables["exhibits"].orderBy("exhibit_no").collect()] == ["EX-001", "EX-002", "EX-003", "EX-004"]
    assert all(r.errors == [] for r in findings.validate_findings(tables).collect())


def test_every_oracle_has_a_query_and_the_flagship_runs(spark):
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert registry.queries()["q13_efos_authorisation_sweep"](spark, SMALL).count() == 2
