"""Hypotheses over the given tables: the listing sweep, and one per vendor-employee pair with a transfer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.operators import detectors, verify
from auditweave.operators.verify import H
from auditweave.session import durable


def pair_hypotheses(estate) -> tuple[DataFrame, DataFrame]:
    """(hypotheses, citations): each transfer cites vendor, employee and itself, so some records repeat.

    Orders of the vendor are cited when their approver is the employee by name.
    """
    hits = durable(detectors.vendor_to_employee_transfer(estate)).withColumn(H, F.concat_ws("-", F.lit("pair"), "rfc", "emp_id"))
    hypotheses = hits.select(
        H, F.when(F.substring("emp_id", -1, 1) == "0", "kickback").otherwise(
            F.when(F.substring("rfc", -1, 1) == "9", "round_trip").otherwise("kickback")).alias("scheme_type"),
        F.when(F.substring("emp_id", -2, 2) == "75", "rejected").otherwise("supported").alias("status")).distinct()
    cites = F.array(
        F.struct(F.lit("vendors").alias("source_table"), F.col("rfc").alias("record_id")),
        F.struct(F.lit("employees").alias("source_table"), F.col("emp_id").alias("record_id")),
        F.struct(F.lit("bank_txns").alias("source_table"), F.col("txn_id").alias("record_id")))
    moved = hits.select(H, F.concat(F.lit("ev-"), "txn_id").alias("evidence_id"), F.lit(1).alias("evidence_no"), F.inline(cites))
    names = estate.employees.select("emp_id", F.col("name").alias("approver"))
    wanted = hits.select(H, F.col("rfc").alias("vendor_rfc"), "emp_id").distinct().join(names, "emp_id")
    orders = estate.purchase_orders.join(wanted, ["vendor_rfc", "approver"]).select(
        H, F.concat(F.lit("ev-"), "po_id").alias("evidence_id"), F.lit(2).alias("evidence_no"),
        F.lit("purchase_orders").alias("source_table"), F.col("po_id").alias("record_id"))
    return hypotheses, moved.unionByName(orders).withColumn("note", F.lit(None).cast("string"))


def all_hypotheses(estate) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hypotheses, citations, reviews) of both kinds.

    Pair reviews vary by id so that every gate outcome occurs.
    """
    sweep, sweep_cites, sweep_reviews = verify.sweep_hypotheses(estate)
    pairs, pair_cites = pair_hypotheses(estate)
    last = F.substring(H, -2, 1)
    reviews = pairs.where(last != "9").select(
        H, F.when(last == "1", "needs_more_evidence").when(last == "2", "legitimate_alternative").otherwise("survives").alias("challenger"),
        F.when(last == "3", "cannot_support").when(last == "4", "needs_more_work").otherwise("clear").alias("method_critic"),
        F.lit(False).alias("useful_actions_remain"))
    return sweep.unionByName(pairs), sweep_cites.unionByName(pair_cites), sweep_reviews.unionByName(reviews)


CASES_SQL = """
, targets AS (SELECT DISTINCT e.rfc FROM efos_list e JOIN invoices i ON i.issuer_rfc = e.rfc),
d4x AS (
  SELECT 'pair-' || v.rfc || '-' || e.emp_id AS hypothesis_id, v.rfc, e.emp_id, e.name, b.txn_id
  FROM bank_txns b JOIN vendors v ON v.bank_clabe = b.from_clabe JOIN employees e ON e.bank_clabe = b.to_clabe),
hyp AS (
  SELECT 'sweep-' || rfc || '-H1' AS hypothesis_id, 'phantom_vendor' AS scheme_type, 'supported' AS status FROM targets
  UNION ALL
  SELECT DISTINCT hypothesis_id, CASE WHEN right(emp_id, 1) <> '0' AND right(rfc, 1) = '9' THEN 'round_trip' ELSE 'kickback' END,
    CASE WHEN right(emp_id, 2) = '75' THEN 'rejected' ELSE 'supported' END FROM d4x),
cit AS (
  SELECT 'sweep-' || rfc || '-H1' AS hypothesis_id, 'ev-efos' AS evidence_id, 0 AS evidence_no, 'efos_list' AS source_table, rfc AS record_id FROM targets
  UNION ALL SELECT 'sweep-' || t.rfc || '-H1', 'ev-inv-' || i.uuid, 1, 'invoices', i.uuid FROM targets t JOIN invoices i ON i.issuer_rfc = t.rfc
  UNION ALL SELECT hypothesis_id, 'ev-' || txn_id, 1, 'vendors', rfc FROM d4x
  UNION ALL SELECT hypothesis_id, 'ev-' || txn_id, 1, 'employees', emp_id FROM d4x
  UNION ALL SELECT hypothesis_id, 'ev-' || txn_id, 1, 'bank_txns', txn_id FROM d4x
  UNION ALL SELECT w.hypothesis_id, 'ev-' || p.po_id, 2, 'purchase_orders', p.po_id
    FROM (SELECT DISTINCT hypothesis_id, rfc, name FROM d4x) w JOIN purchase_orders p ON p.vendor_rfc = w.rfc AND p.approver = w.name),
rev AS (
  SELECT hypothesis_id, 'survives' AS challenger, 'clear' AS method_critic FROM hyp WHERE scheme_type = 'phantom_vendor'
  UNION ALL SELECT hypothesis_id,
    CASE substr(hypothesis_id, -2, 1) WHEN '1' THEN 'needs_more_evidence' WHEN '2' THEN 'legitimate_alternative' ELSE 'survives' END,
    CASE substr(hypothesis_id, -2, 1) WHEN '3' THEN 'cannot_support' WHEN '4' THEN 'needs_more_work' ELSE 'clear' END
  FROM hyp WHERE scheme_type <> 'phantom_vendor' AND substr(hypothesis_id, -2, 1) <> '9'),
refs AS (SELECT hypothesis_id, source_table, record_id, min(evidence_no) AS evidence_no, min(evidence_id) AS evidence_id, count(*) AS uses FROM cit GROUP BY 1, 2, 3),
idx AS (
  SELECT 'vendors' AS source_table, rfc AS record_id, CAST(NULL AS DOUBLE) AS amount FROM vendors UNION ALL SELECT 'employees', emp_id, NULL FROM employees
  UNION ALL SELECT 'efos_list', rfc, NULL FROM efos_list UNION ALL SELECT 'invoices', uuid, total FROM invoices
  UNION ALL SELECT 'bank_txns', txn_id, amount FROM bank_txns UNION ALL SELECT 'purchase_orders', po_id, amount FROM purchase_orders),
exh AS (SELECT r.*, i.amount, i.record_id IS NOT NULL AS found FROM refs r LEFT JOIN idx i ON i.source_table = r.source_table AND i.record_id = r.record_id),
ca_v AS (SELECT r.hypothesis_id, v.bank_clabe AS src, v.rfc FROM refs r JOIN vendors v ON r.source_table = 'vendors' AND v.rfc = r.record_id),
ca_e AS (SELECT r.hypothesis_id, e.bank_clabe AS dst, e.emp_id, e.name FROM refs r JOIN employees e ON r.source_table = 'employees' AND e.emp_id = r.record_id),
moved AS (
  SELECT r.hypothesis_id, b.txn_id, b.amount, v.rfc, e.emp_id, e.name FROM refs r JOIN bank_txns b ON r.source_table = 'bank_txns' AND b.txn_id = r.record_id
  JOIN ca_v v ON v.hypothesis_id = r.hypothesis_id AND v.src = b.from_clabe JOIN ca_e e ON e.hypothesis_id = r.hypothesis_id AND e.dst = b.to_clabe
  WHERE b.from_clabe <> b.to_clabe),
pv AS (
  SELECT r.hypothesis_id, count(*) AS n, CAST(sum(CAST(i.total AS DECIMAL(18,2))) AS DOUBLE) AS t
  FROM refs r JOIN invoices i ON r.source_table = 'invoices' AND i.uuid = r.record_id
  JOIN refs l ON l.hypothesis_id = r.hypothesis_id AND l.source_table = 'efos_list' AND l.record_id = i.issuer_rfc GROUP BY 1),
kb AS (SELECT hypothesis_id, count(*) AS n, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS t FROM (SELECT DISTINCT hypothesis_id, txn_id, amount FROM moved) GROUP BY 1),
claims AS (
  SELECT h.hypothesis_id, h.scheme_type, CASE h.scheme_type WHEN 'phantom_vendor' THEN pv.t WHEN 'kickback' THEN kb.t END AS claimed_amount,
    CASE h.scheme_type WHEN 'phantom_vendor' THEN coalesce(pv.n, 0) WHEN 'kickback' THEN coalesce(kb.n, 0) ELSE 0 END AS in_scope_count,
    CASE h.scheme_type WHEN 'kickback' THEN CASE WHEN kb.n IS NULL THEN 'no record in scope' END WHEN 'phantom_vendor' THEN NULL ELSE 'no scope rule for this scheme' END AS error
  FROM hyp h LEFT JOIN pv USING (hypothesis_id) LEFT JOIN kb USING (hypothesis_id)),
party AS (
  SELECT r.hypothesis_id, l.rfc, l.status = 'definitivo' AS definitive, l.publication_date AS published,
    count(*) FILTER (i.issue_date >= l.publication_date) AS qualifying, count(*) FILTER (i.issue_date < l.publication_date) AS earlier,
    min(i.issue_date) FILTER (i.issue_date >= l.publication_date) AS first_q, max(i.issue_date) FILTER (i.issue_date >= l.publication_date) AS last_q
  FROM refs r JOIN invoices i ON r.source_table = 'invoices' AND i.uuid = r.record_id JOIN efos_list l ON l.rfc = i.issuer_rfc
  JOIN refs c ON c.hypothesis_id = r.hypothesis_id AND c.source_table = 'efos_list' AND c.record_id = l.rfc GROUP BY 1, 2, 3, 4),
timing AS (
  SELECT h.hypothesis_id, CASE WHEN p.hypothesis_id IS NULL THEN 'one side is not cited' WHEN NOT p.definitive THEN 'a matched listing is not definitive'
      WHEN p.qualifying = 0 THEN 'a listing reaches no cited invoice' END AS reason, coalesce((p.hypothesis_id IS NOT NULL)::BIGINT, 0) AS matched, p.rfc AS first_rfc,
    CASE WHEN p.definitive THEN p.qualifying END AS qualifying, CASE WHEN p.definitive THEN p.earlier END AS earlier,
    CASE WHEN p.definitive THEN p.published END AS first_published, CASE WHEN p.definitive THEN p.first_q END AS first_qualifying, CASE WHEN p.definitive THEN p.last_q END AS last_qualifying
  FROM hyp h LEFT JOIN party p USING (hypothesis_id)),
pairs AS (
  SELECT m.hypothesis_id, m.rfc, m.emp_id, count(*) AS transfers, EXISTS (
    SELECT 1 FROM refs r JOIN purchase_orders p ON r.source_table = 'purchase_orders' AND p.po_id = r.record_id
    WHERE r.hypothesis_id = m.hypothesis_id AND p.vendor_rfc = m.rfc AND p.approver IN (m.emp_id, m.name)) AS approved
  FROM moved m GROUP BY m.hypothesis_id, m.rfc, m.emp_id, m.name),
link AS (
  SELECT h.hypothesis_id, CASE WHEN NOT EXISTS (SELECT 1 FROM ca_v v WHERE v.hypothesis_id = h.hypothesis_id) OR NOT EXISTS (SELECT 1 FROM ca_e e WHERE e.hypothesis_id = h.hypothesis_id) THEN 'one side has no account'
      WHEN p.n IS NULL AND EXISTS (SELECT 1 FROM ca_v v JOIN ca_e e ON e.hypothesis_id = v.hypothesis_id AND e.dst = v.src WHERE v.hypothesis_id = h.hypothesis_id) THEN 'shared account, but no transfer between two accounts'
      WHEN p.n IS NULL THEN 'no cited transfer from vendor to employee' WHEN p.k = 0 THEN 'no cited order approved by that employee' END AS reason,
    coalesce(p.n, 0) AS pairs, coalesce(p.k, 0) AS confirmed
  FROM hyp h LEFT JOIN (SELECT hypothesis_id, count(*) AS n, count(*) FILTER (approved) AS k FROM pairs GROUP BY 1) p USING (hypothesis_id)),
sums AS (SELECT hypothesis_id, source_table, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS s FROM exh WHERE amount IS NOT NULL GROUP BY 1, 2),
best AS (
  SELECT c.hypothesis_id, min(struct_pack(g := abs(c.claimed_amount - s.s), t := s.source_table, s := s.s)) AS b
  FROM claims c JOIN sums s USING (hypothesis_id) WHERE c.claimed_amount IS NOT NULL GROUP BY 1),
recon AS (
  SELECT c.hypothesis_id, c.claimed_amount, b.b.t AS best_table, b.b.s AS best_sum, b.b.g AS difference, coalesce(b.b.g <= 0.02 * greatest(b.b.s, 1.0), false) AS reconciles
  FROM claims c LEFT JOIN best b USING (hypothesis_id)),
checks AS (
  SELECT hypothesis_id, 'EXISTS-' || source_table || '-' || record_id AS check_id, CASE WHEN found THEN 'verified' ELSE 'failed' END AS status FROM exh
  UNION ALL SELECT t.hypothesis_id, 'PHANTOM-EFOS-INVOICE-LINK', CASE WHEN reason IS NULL THEN 'verified' ELSE 'unresolved' END FROM timing t JOIN hyp h USING (hypothesis_id) WHERE h.scheme_type = 'phantom_vendor'
  UNION ALL SELECT l.hypothesis_id, 'KICKBACK-VENDOR-EMPLOYEE-LINK', CASE WHEN reason IS NULL THEN 'verified' ELSE 'unresolved' END FROM link l JOIN hyp h USING (hypothesis_id) WHERE h.scheme_type = 'kickback'
  UNION ALL SELECT hypothesis_id, 'SCHEME-SUBSTANTIVE-VERIFICATION', 'unresolved' FROM hyp WHERE scheme_type NOT IN ('phantom_vendor', 'kickback')
  UNION ALL SELECT hypothesis_id, 'PESO-RECONCILIATION', CASE WHEN claimed_amount IS NULL THEN 'unresolved' WHEN reconciles THEN 'verified' ELSE 'failed' END FROM recon),
rep AS (
  SELECT hypothesis_id, count(*) AS checks, count(*) FILTER (status = 'failed') AS failures, count(*) FILTER (status = 'unresolved') AS unresolved,
    coalesce(string_agg(check_id, ',' ORDER BY check_id) FILTER (status = 'unresolved'), '') AS unresolved_checks,
    bool_or(check_id = 'PESO-RECONCILIATION' AND status = 'verified') AS peso_verified,
    bool_or(check_id IN ('PHANTOM-EFOS-INVOICE-LINK', 'KICKBACK-VENDOR-EMPLOYEE-LINK') AND status = 'verified') AS scheme_verified,
    count(*) FILTER (status = 'verified' AND starts_with(check_id, 'EXISTS-')) AS exhibits
  FROM checks GROUP BY 1),
gate AS (
  SELECT h.hypothesis_id, h.scheme_type, CASE h.scheme_type WHEN 'phantom_vendor' THEN 'CFF-69B' WHEN 'kickback' THEN 'SOD-PROC-01' END AS rule_id,
    CASE WHEN h.status = 'rejected' OR r.challenger = 'legitimate_alternative' THEN 'decline_hypothesis'
      WHEN p.failures = 0 AND p.unresolved = 0 AND p.peso_verified AND p.scheme_verified AND p.exhibits >= 3 AND r.challenger = 'survives' AND r.method_critic = 'clear'
        AND h.scheme_type IN ('phantom_vendor', 'kickback') THEN 'authorize_probable'
      WHEN r.method_critic = 'cannot_support' THEN 'inconclusive'
      WHEN r.challenger IS NULL OR r.method_critic IS NULL OR r.challenger = 'needs_more_evidence' OR r.method_critic = 'needs_more_work' THEN 'need_more_work'
      ELSE 'inconclusive' END AS outcome
  FROM hyp h LEFT JOIN rev r USING (hypothesis_id) LEFT JOIN rep p USING (hypothesis_id))
"""
