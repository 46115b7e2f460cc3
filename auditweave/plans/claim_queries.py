"""Queries for claims, verification, the gate and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditweave.operators import findings, verify
from auditweave.operators.verify import H, KICKBACK, PHANTOM
from auditweave.plans.case_material import CASES_SQL, all_hypotheses
from auditweave.plans.registry import query


@query("q1_cited_refs", CASES_SQL + "SELECT hypothesis_id, source_table, record_id, evidence_no, evidence_id, uses FROM refs")
def q1(given):
    return verify.cited_refs(all_hypotheses(given.estate)[1]).drop("note")


@query("q2_phantom_vendor_claim", CASES_SQL + """
SELECT hypothesis_id, in_scope_count, claimed_amount, error FROM claims WHERE scheme_type = 'phantom_vendor'""")
def q2(given):
    hyp, cites, _ = all_hypotheses(given.estate)
    claims, _ = verify.phantom_vendor_claim(given.estate, hyp.where(F.col("scheme_type") == PHANTOM), verify.cited_refs(cites))
    return claims.select(H, "in_scope_count", "claimed_amount", "error")


@query("q3_kickback_claim", CASES_SQL + """
SELECT hypothesis_id, in_scope_count, claimed_amount, error FROM claims WHERE scheme_type = 'kickback'""")
def q3(given):
    hyp, cites, _ = all_hypotheses(given.estate)
    claims, _ = verify.kickback_claim(given.estate, hyp.where(F.col("scheme_type") == KICKBACK), verify.cited_refs(cites))
    return claims.select(H, "in_scope_count", "claimed_amount", "error")


@query("q4_route_claims", CASES_SQL + "SELECT hypothesis_id, scheme_type, in_scope_count, claimed_amount, error FROM claims")
def q4(given):
    hyp, cites, _ = all_hypotheses(given.estate)
    return verify.route_claims(given.estate, hyp, verify.cited_refs(cites)).select(
        H, "scheme_type", "in_scope_count", "claimed_amount", "error")


@query("q5_resolve_exhibits", CASES_SQL + """
SELECT hypothesis_id, 'EXISTS-' || source_table || '-' || record_id AS check_id, CASE WHEN found THEN 'verified' ELSE 'failed' END AS check_status, uses - 1 AS duplicates FROM exh""")
def q5(given):
    exhibits, _ = verify.resolve_exhibits(given.estate, all_hypotheses(given.estate)[1])
    return exhibits.select(H, "check_id", "check_status", (F.col("uses") - 1).alias("duplicates"))


@query("q5_missing_exhibits", CASES_SQL + """
SELECT hypothesis_id, 'EXISTS-' || source_table || '-' || record_id AS check_id, CASE WHEN found THEN 'verified' ELSE 'failed' END AS check_status FROM exh
UNION ALL SELECT DISTINCT hypothesis_id, 'EXISTS-invoices-GONE-' || hypothesis_id, 'failed' FROM refs""")
def q5m(given):
    """Each hypothesis also cites an invoice that is in no book."""
    cites = all_hypotheses(given.estate)[1]
    lost = cites.select(H).distinct().select(H, F.lit("ev-gone").alias("evidence_id"), F.lit(9).alias("evidence_no"), F.lit("invoices").alias("source_table"),
                                             F.concat(F.lit("GONE-"), H).alias("record_id"), F.lit("Not in the books.").alias("note"))
    exhibits, _ = verify.resolve_exhibits(given.estate, cites.select(lost.columns).unionByName(lost))
    return exhibits.select(H, "check_id", "check_status")


@query("q6_efos_timing_assessment", CASES_SQL + """
SELECT hypothesis_id, CASE WHEN reason IS NULL THEN 'verified' ELSE 'unresolved' END AS status, reason, matched, first_rfc, qualifying, earlier,
       first_published, first_qualifying, last_qualifying FROM timing WHERE starts_with(hypothesis_id, 'sweep-')""")
def q6(given):
    hyp, cites, _ = all_hypotheses(given.estate)
    exhibits, _ = verify.resolve_exhibits(given.estate, cites)
    out, _ = verify.efos_timing_assessment(given.estate, hyp.where(F.col("scheme_type") == PHANTOM), exhibits)
    return out.select(H, "status", "reason", "matched", "first_rfc", "qualifying", "earlier", "first_published",
                      "first_qualifying", "last_qualifying")


@query("q7_kickback_assessment", CASES_SQL + """
SELECT hypothesis_id, CASE WHEN reason IS NULL THEN 'verified' ELSE 'unresolved' END AS status, reason, pairs, confirmed FROM link WHERE starts_with(hypothesis_id, 'pair-')""")
def q7(given):
    hyp, cites, _ = all_hypotheses(given.estate)
    exhibits, _ = verify.resolve_exhibits(given.estate, cites)
    return verify.kickback_assessment(given.estate, hyp.where(F.col("scheme_type") != PHANTOM), exhibits)[0]


@query("q8_peso_reconciliation", CASES_SQL + """
SELECT hypothesis_id, claimed_amount, best_table, best_sum, round(difference, 2) AS difference, reconciles FROM recon""")
def q8(given):
    hyp, cites, _ = all_hypotheses(given.estate)
    claims = verify.route_claims(given.estate, hyp, verify.cited_refs(cites))
    exhibits, _ = verify.resolve_exhibits(given.estate, cites)
    return verify.peso_reconciliation(claims, exhibits).withColumn("difference", F.round("difference", 2)).drop("missing_records")


def _reports(given):
    hyp, cites, reviews = all_hypotheses(given.estate)
    return verify.verification_report(given.estate, hyp, cites), reviews


@query("q9_verification_checks", CASES_SQL + "SELECT hypothesis_id, check_id, status FROM checks")
def q9c(given):
    return _reports(given)[0].checks.select(H, "check_id", "status")


@query("q9_verification_report", CASES_SQL + """
SELECT hypothesis_id, checks, failures, unresolved, unresolved_checks, exhibits, peso_verified FROM rep""")
def q9(given):
    return _reports(given)[0].reports.select(H, "checks", "failures", "unresolved", "unresolved_checks", "exhibits", "peso_verified")


@query("q10_rule_lookup", CASES_SQL + """
SELECT hypothesis_id, scheme_type, CASE scheme_type WHEN 'phantom_vendor' THEN 'CFF-69B' WHEN 'kickback' THEN 'SOD-PROC-01' END AS rule_id FROM hyp""")
def q10(given):
    return verify.rule_lookup(all_hypotheses(given.estate)[0]).select(H, "scheme_type", "rule_id")


@query("q11_evidence_gate", CASES_SQL + "SELECT hypothesis_id, scheme_type, rule_id, outcome FROM gate")
def q11(given):
    found, reviews = _reports(given)
    return verify.decide(found, reviews).select(H, "scheme_type", "rule_id", "outcome")


@query("q11_gate_requirements", CASES_SQL + """
, need AS (SELECT h.hypothesis_id, unnest(CASE WHEN h.status = 'rejected' THEN ['hypothesis is already rejected'] ELSE [
    CASE WHEN h.scheme_type NOT IN ('phantom_vendor', 'kickback') THEN 'no valid rule requested' END,
    CASE WHEN r.challenger IS NULL THEN 'challenger review is missing' END,
    CASE r.challenger WHEN 'needs_more_evidence' THEN 'challenger needs more evidence' WHEN 'legitimate_alternative' THEN 'challenger found a legitimate alternative'
      WHEN 'alternative_hypothesis' THEN 'challenger found another hypothesis' END,
    CASE WHEN r.method_critic IS NULL THEN 'method review is missing' END,
    CASE r.method_critic WHEN 'needs_more_work' THEN 'method review needs more work' WHEN 'cannot_support' THEN 'method review cannot support' END,
    CASE WHEN p.exhibits < 3 THEN 'fewer than 3 exhibits (found ' || p.exhibits || ')' END,
    CASE WHEN NOT coalesce((SELECT c.reconciles FROM recon c WHERE c.hypothesis_id = h.hypothesis_id), false) THEN 'amount does not reconcile' END,
    CASE WHEN p.failures > 0 THEN 'critical checks failed: ' || p.failures END, CASE WHEN p.unresolved > 0 THEN 'critical checks unresolved: ' || p.unresolved END,
    CASE WHEN NOT p.peso_verified THEN 'no verified amount check' END,
    CASE WHEN h.scheme_type IN ('phantom_vendor', 'kickback') AND NOT p.scheme_verified THEN 'no verified scheme check' END,
    CASE WHEN h.scheme_type NOT IN ('phantom_vendor', 'kickback') THEN 'no verifier for this scheme' END] END) AS requirement
  FROM hyp h LEFT JOIN rev r USING (hypothesis_id) JOIN rep p USING (hypothesis_id))
SELECT hypothesis_id, requirement FROM need WHERE requirement IS NOT NULL""")
def q11r(given):
    found, reviews = _reports(given)
    return verify.decide(found, reviews).select(H, F.explode("failed_requirements").alias("requirement"))


@query("q12_boundary_check", CASES_SQL + """
, b AS (
  SELECT hypothesis_id, substr(hypothesis_id, -2, 1) <> '5' AS ready, substr(hypothesis_id, -2, 1) <> '6' AS same,
    CASE substr(hypothesis_id, -2, 1) WHEN '7' THEN -claimed_amount WHEN '8' THEN CAST('NaN' AS DOUBLE) ELSE claimed_amount END AS a FROM claims)
SELECT hypothesis_id, CASE WHEN NOT ready THEN 'preverification_blocked' WHEN NOT same OR isnan(a) OR isinf(a) OR a <= 0 THEN 'error' ELSE 'evaluated' END AS route,
  CASE WHEN NOT ready THEN NULL WHEN NOT same THEN 'ready, but stopped for another reason' WHEN isnan(a) OR isinf(a) THEN 'amount is not finite' WHEN a <= 0 THEN 'amount is not positive' END AS boundary_error FROM b""")
def q12(given):
    hyp, cites, _ = all_hypotheses(given.estate)
    last = F.substring(H, -2, 1)
    claims = verify.route_claims(given.estate, hyp, verify.cited_refs(cites)).select(
        H, F.when(last == "7", -F.col("claimed_amount")).when(last == "8", F.lit(float("nan"))).otherwise(F.col("claimed_amount")).alias("claimed_amount"))
    ready = hyp.select(H, (last != "5").alias("ready_for_verification"),
                       F.when(last == "6", "investigator_stopped").otherwise("ready_for_verification").alias("stop_reason"))
    return verify.boundary_check(claims, ready).select(H, "route", "boundary_error")


SWEEP_SQL = CASES_SQL + """
SELECT g.hypothesis_id, g.outcome, r.claimed_amount, r.reconciles, p.exhibits, p.unresolved_checks
FROM gate g JOIN recon r USING (hypothesis_id) JOIN rep p USING (hypothesis_id) WHERE g.scheme_type = 'phantom_vendor'"""


@query("q13_efos_authorisation_sweep", SWEEP_SQL)
def q13(given):
    return verify.efos_authorisation_sweep(given.estate).select(
        H, "outcome", "claimed_amount", "reconciles", "exhibits", "unresolved_checks")


_EXHIBITS_SQL = CASES_SQL + """
, ok AS (SELECT g.hypothesis_id, g.scheme_type, g.rule_id, r.claimed_amount FROM gate g JOIN recon r USING (hypothesis_id) WHERE g.outcome = 'authorize_probable'),
ex AS (
  SELECT e.hypothesis_id, e.source_table, e.record_id, row_number() OVER (PARTITION BY e.hypothesis_id ORDER BY e.source_table, e.record_id) AS exhibit_no
  FROM exh e WHERE e.found)
"""


@query("f1_number_exhibits", _EXHIBITS_SQL + """
SELECT hypothesis_id, 'EX-' || CASE WHEN exhibit_no < 1000 THEN lpad(CAST(exhibit_no AS VARCHAR), 3, '0') ELSE CAST(exhibit_no AS VARCHAR) END AS exhibit_id, source_table, record_id FROM ex""")
def f1(given):
    exhibits, _ = verify.resolve_exhibits(given.estate, all_hypotheses(given.estate)[1])
    return findings.number_exhibits(exhibits).select(H, "exhibit_id", "source_table", "record_id")


def _built(given):
    return findings.build_findings(given.estate, *all_hypotheses(given.estate))


@query("f2_phantom_trail", _EXHIBITS_SQL + """
SELECT o.hypothesis_id, 'RFC:' || f.receiver AS from_entity, 'RFC:' || f.issuer AS to_entity, o.claimed_amount AS amount, f.d AS date
FROM ok o JOIN (SELECT ex.hypothesis_id, min(struct_pack(d := i.issue_date, n := ex.exhibit_no, issuer := i.issuer_rfc, receiver := i.receiver_rfc)) AS f
  FROM ex JOIN invoices i ON ex.source_table = 'invoices' AND i.uuid = ex.record_id GROUP BY 1) x USING (hypothesis_id) WHERE o.scheme_type = 'phantom_vendor'""")
def f2(given):
    tables = _built(given)
    mine = tables["findings"].where(F.col("scheme_type") == PHANTOM).select(H)
    return tables["trail"].join(mine, H, "left_semi").select(H, "from_entity", "to_entity", "amount", "date")


@query("f3_kickback_trail", _EXHIBITS_SQL + """
, own AS (SELECT a.account, (SELECT min(rfc) FROM vendors v WHERE v.bank_clabe = a.account) AS rfc, (SELECT min(emp_id) FROM employees e WHERE e.bank_clabe = a.account) AS emp_id
  FROM (SELECT bank_clabe AS account FROM vendors UNION SELECT bank_clabe FROM employees) a),
steps AS (
  SELECT ex.hypothesis_id, 'RFC:' || s.rfc AS from_entity, d.emp_id AS to_entity, b.amount, b.date,
    row_number() OVER (PARTITION BY ex.hypothesis_id ORDER BY b.date, ex.exhibit_no) AS step
  FROM ok JOIN ex USING (hypothesis_id) JOIN bank_txns b ON ex.source_table = 'bank_txns' AND b.txn_id = ex.record_id
  JOIN own s ON s.account = b.from_clabe AND s.rfc IS NOT NULL JOIN own d ON d.account = b.to_clabe AND d.emp_id IS NOT NULL
  WHERE ok.scheme_type = 'kickback' AND b.from_clabe <> b.to_clabe)
SELECT hypothesis_id, step, from_entity, to_entity, amount, date FROM steps s
WHERE NOT EXISTS (SELECT 1 FROM steps b JOIN steps p ON p.hypothesis_id = b.hypothesis_id AND p.step = b.step - 1
  WHERE b.hypothesis_id = s.hypothesis_id AND b.step <= s.step AND p.to_entity <> b.from_entity)""")
def f3(given):
    tables = _built(given)
    mine = tables["findings"].where(F.col("scheme_type") == KICKBACK).select(H)
    return tables["trail"].join(mine, H, "left_semi").select(H, "step", "from_entity", "to_entity", "amount", "date")


@query("f4_build_findings", _EXHIBITS_SQL + """
SELECT hypothesis_id, scheme_type, CASE rule_id WHEN 'CFF-69B' THEN 'SAT Articulo 69-B - Operaciones inexistentes (EFOS)'
  ELSE 'Control interno de la empresa Politica de compras - Segregacion de funciones en compras' END AS rule_broken, claimed_amount AS peso_amount FROM ok""")
def f4(given):
    return _built(given)["findings"].select(H, "scheme_type", "rule_broken", "peso_amount")


@query("f4_finding_entities", _EXHIBITS_SQL + """
SELECT o.hypothesis_id, 'RFC:' || p.rfc AS entity FROM ok o JOIN party p USING (hypothesis_id)
UNION SELECT o.hypothesis_id, 'RFC:' || p.rfc FROM ok o JOIN pairs p USING (hypothesis_id) WHERE p.approved
UNION SELECT o.hypothesis_id, p.emp_id FROM ok o JOIN pairs p USING (hypothesis_id) WHERE p.approved""")
def f4e(given):
    return _built(given)["entities"]


@query("f5_validate_findings", _EXHIBITS_SQL + "SELECT hypothesis_id, '' AS errors FROM ok")
def f5(given):
    return findings.validate_findings(_built(given)).withColumn("errors", F.array_join("errors", ";"))


@query("f5_broken_findings", _EXHIBITS_SQL + """
SELECT hypothesis_id, CASE substr(hypothesis_id, -4, 1) WHEN '1' THEN 'blank note' WHEN '2' THEN 'amount is not positive' WHEN '3' THEN 'blank narrative' WHEN '4' THEN 'no entity'
  WHEN '5' THEN 'exhibit id repeats' WHEN '6' THEN 'malformed entity' ELSE '' END AS errors FROM ok""")
def f5b(given):
    """Findings with one fault each, by a digit of their id."""
    tables = dict(_built(given))
    last = F.substring(H, -4, 1)
    tables["findings"] = tables["findings"].withColumn("peso_amount", F.when(last == "2", 0.0).otherwise(F.col("peso_amount"))).withColumn(
        "narrative", F.when(last == "3", " ").otherwise(F.col("narrative")))
    tables["entities"] = tables["entities"].where(last != "4").withColumn("entity", F.when(last == "6", "nobody").otherwise(F.col("entity")))
    exhibits = tables["exhibits"].withColumn("note", F.when(last == "1", " ").otherwise(F.col("note")))
    tables["exhibits"] = exhibits.unionByName(exhibits.where(last == "5"))
    return findings.validate_findings(tables).withColumn("errors", F.array_join("errors", ";"))


@query("f6_audit_result", _EXHIBITS_SQL + """
SELECT g.hypothesis_id, g.outcome = 'authorize_probable' AS authorised, g.outcome,
  CASE WHEN g.outcome = 'authorize_probable' THEN NULL WHEN g.scheme_type NOT IN ('phantom_vendor', 'kickback') THEN 'scheme is not supported'
    WHEN c.error IS NOT NULL THEN 'No claim: ' || c.error ELSE 'Gate' END AS reason FROM gate g JOIN claims c USING (hypothesis_id)""")
def f6(given):
    tables = _built(given)
    out = findings.audit_result(tables["decisions"], tables["findings"])
    return out.withColumn("reason", F.regexp_replace("reason", "^Gate: .*$", "Gate"))


@query("f7_total_exposure", _EXHIBITS_SQL + """
SELECT 'probable' AS confidence, count(*) AS findings, CAST(sum(CAST(claimed_amount AS DECIMAL(18,2))) AS DOUBLE) AS exposure FROM ok HAVING count(*) > 0""")
def f7(given):
    return findings.total_exposure(_built(given)["findings"])
