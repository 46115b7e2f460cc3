"""Queries for the rule detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditweave.operators import detectors
from auditweave.operators.observations import signal_rank
from auditweave.plans.graph_queries import CYCLES_SQL
from auditweave.plans.registry import query

SPREAD = 0.5  # the given amounts vary widely, so the narrow default would compare almost nothing


def sql_id(family: str, prefix: str, parts: str) -> str:
    return f"'OBS-{family}-{prefix}-' || upper(substr(sha1({parts}), 1, 12))"


def sql_digest(member: str) -> str:
    return f"CAST(sum(CAST('0x' || substr(sha1({member}), 1, 14) AS BIGINT)) AS VARCHAR)"


D1_SQL = f"""
, d1 AS (SELECT {sql_id('DET', 'VENDOR-EMPLOYEE-CLABE', "v.rfc || '|' || e.emp_id || '|' || v.bank_clabe")} AS observation_id,
  v.rfc, e.emp_id, v.bank_clabe AS account FROM vendors v JOIN employees e ON e.bank_clabe = v.bank_clabe)
"""
D2_SQL = f"""
, d2 AS (SELECT {sql_id('DET', 'SHARED-VENDOR-CLABE', "bank_clabe || '|' || count(*) || '|' || " + sql_digest('rfc'))} AS observation_id,
  bank_clabe AS account, count(*) AS vendor_count, min(rfc) AS first_rfc FROM vendors GROUP BY bank_clabe HAVING count(*) >= 2)
"""
D3_SQL = f"""
, d3 AS (SELECT {sql_id('DET', 'EFOS-MATCH', "l.rfc || '|' || l.status || '|' || l.publication_date")} AS observation_id,
  l.rfc, l.status AS statuses, l.publication_date AS publication_dates FROM efos_list l WHERE l.rfc IN (SELECT rfc FROM vendors))
"""
D4_SQL = f"""
, d4 AS (SELECT {sql_id('DET', 'VENDOR-TO-EMPLOYEE', "v.rfc || '|' || e.emp_id || '|' || b.txn_id")} AS observation_id,
  v.rfc, e.emp_id, b.txn_id, b.date, b.amount, b.from_clabe AS vendor_account, b.to_clabe AS employee_account
  FROM bank_txns b JOIN vendors v ON v.bank_clabe = b.from_clabe JOIN employees e ON e.bank_clabe = b.to_clabe)
"""
def d5_sql(spread: float) -> str:
    return f"""
, irow AS (SELECT uuid, issuer_rfc, receiver_rfc, CAST(issue_date AS DATE) AS d, total FROM invoices WHERE total > 0),
win AS (
  SELECT s.issuer_rfc, s.receiver_rfc, s.d AS start, max(r.d) AS last_day, count(*) AS n, median(r.total) AS med,
         (max(r.total) - min(r.total)) / median(r.total) AS spread, CAST(sum(CAST(r.total AS DECIMAL(18,2))) AS DOUBLE) AS cluster_total,
         {sql_digest('r.uuid')} AS digest
  FROM (SELECT DISTINCT issuer_rfc, receiver_rfc, d FROM irow) s
  JOIN irow r ON r.issuer_rfc = s.issuer_rfc AND r.receiver_rfc = s.receiver_rfc AND r.d BETWEEN s.d AND s.d + 7
  GROUP BY 1, 2, 3 HAVING count(*) >= 3 AND median(r.total) > 0 AND (max(r.total) - min(r.total)) / median(r.total) <= {spread}),
d5 AS (
  SELECT {sql_id('REL', 'INVOICE-CLUSTER', "issuer_rfc || '|' || receiver_rfc || '|' || start || '|' || n || '|' || digest")} AS observation_id, w.*
  FROM win w WHERE NOT EXISTS (
    SELECT 1 FROM win o WHERE o.issuer_rfc = w.issuer_rfc AND o.receiver_rfc = w.receiver_rfc AND o.start < w.start AND o.last_day >= w.last_day))
"""


D5_SQL = d5_sql(SPREAD)
D7_SQL = CYCLES_SQL + f"""
, d7 AS (SELECT {sql_id('REL', 'BANK-CYCLE', "array_to_string(n, '|') || '|' || replace(txn_ids, ',', '|')")} AS observation_id, n, txn_ids, dates, amounts, span FROM cycles)
"""
OWNERS_SQL = """
, owner_entities AS (
  SELECT DISTINCT bank_clabe AS account, 'RFC:' || rfc AS entity FROM vendors
  UNION SELECT bank_clabe, CASE WHEN starts_with(emp_id, 'EMP:') THEN emp_id ELSE 'EMP:' || emp_id END FROM employees)
"""
D8_SCOPE_SQL = """
, d8i AS (
  SELECT i.issuer_rfc AS rfc, i.uuid, i.total FROM invoices i
  WHERE i.issuer_rfc IN (SELECT rfc FROM vendors) AND i.issuer_rfc NOT IN (SELECT vendor_rfc FROM contracts) AND i.status <> 'cancelado'
    AND substr(i.uuid, 1, 8) IN (SELECT trim(substr(reference, 11)) FROM bank_txns WHERE starts_with(reference, 'Pago CFDI ')))
"""
D8_SQL = D8_SCOPE_SQL + f"""
, d8o AS (
  SELECT vendor_rfc AS rfc, list(struct_pack(po := po_id, a := round(amount, 2)) ORDER BY po_id) AS free, count(*) AS on_file FROM purchase_orders
  WHERE vendor_rfc IN (SELECT rfc FROM vendors) AND vendor_rfc NOT IN (SELECT vendor_rfc FROM contracts) GROUP BY 1),
d8n AS (SELECT rfc, uuid, total, row_number() OVER (PARTITION BY rfc ORDER BY uuid) AS rn FROM d8i),
d8w AS (
  SELECT s.rfc, 0::BIGINT AS rn, ''::VARCHAR AS uuid, 0::DOUBLE AS total, ''::VARCHAR AS po, coalesce(o.free, []) AS free
  FROM (SELECT DISTINCT rfc FROM d8n) s LEFT JOIN d8o o ON o.rfc = s.rfc
  UNION ALL
  SELECT x.rfc, x.rn, x.uuid, x.total, x.pick.po, CASE WHEN x.pick IS NULL THEN x.free ELSE list_filter(x.free, lambda y: y.po <> x.pick.po) END
  FROM (SELECT n.rfc, n.rn, n.uuid, n.total, w.free, list_filter(w.free, lambda y: abs(y.a - n.total) <= greatest(0.02 * n.total, 1.0))[1] AS pick
        FROM d8w w JOIN d8n n ON n.rfc = w.rfc AND n.rn = w.rn + 1) x),
d8u AS (SELECT rfc, uuid, total FROM d8w WHERE rn > 0 AND po IS NULL),
d8 AS (
  SELECT {sql_id('REL', 'VENDOR-UNSUPPORTED', 'u.rfc')} AS observation_id, u.rfc, u.unsupported_count, u.unsupported_total, coalesce(o.on_file, 0) AS purchase_orders_on_file
  FROM (SELECT rfc, count(*) AS unsupported_count, CAST(sum(CAST(total AS DECIMAL(18,2))) AS DOUBLE) AS unsupported_total FROM d8u GROUP BY 1 HAVING count(*) >= 3) u
  LEFT JOIN d8o o ON o.rfc = u.rfc)
"""


def heads_sql(spread: float) -> str:
    """Every rule detector and the heads of their observations."""
    return D1_SQL + D2_SQL + D3_SQL + D4_SQL + d5_sql(spread) + D7_SQL + D8_SQL + OWNERS_SQL + """
, obs AS (
  SELECT observation_id, 1 AS rank, 'vendor_employee_shared_clabe' AS signal FROM d1 UNION ALL SELECT observation_id, 2, 'shared_vendor_clabe' FROM d2
  UNION ALL SELECT observation_id, 3, 'vendor_efos_record_match' FROM d3 UNION ALL SELECT observation_id, 4, 'vendor_to_employee_bank_transfer' FROM d4
  UNION ALL SELECT observation_id, 5, 'short_window_similar_invoice_cluster' FROM d5 UNION ALL SELECT observation_id, 6, 'directed_bank_transfer_cycle' FROM d7
  UNION ALL SELECT observation_id, 7, 'paid_invoices_without_po_or_contract' FROM d8)
"""


@query("d1_vendor_employee_shared_account", D1_SQL + "SELECT * FROM d1")
def d1(given):
    return detectors.vendor_employee_shared_account(given.estate)


OWNER_SETS_SQL = f"""
, owners AS (SELECT bank_clabe AS account, 'vendor' AS role, rfc AS owner FROM vendors UNION ALL SELECT bank_clabe, 'employee', emp_id FROM employees),
sets AS (SELECT account, count(*) FILTER (role = 'vendor') AS vendor_count, min(owner) FILTER (role = 'vendor') AS first_vendor,
  count(*) FILTER (role = 'employee') AS employee_count, min(owner) FILTER (role = 'employee') AS first_employee, {sql_digest("role || ':' || owner")} AS digest FROM owners GROUP BY 1),
d1g AS (SELECT account, vendor_count, first_vendor, employee_count, first_employee,
  {sql_id('DET', 'ACCOUNT-OWNERS', "account || '|' || vendor_count || '|' || employee_count || '|' || digest")} AS observation_id FROM sets WHERE vendor_count > 0 AND employee_count > 0),
d4g AS (SELECT b.txn_id, b.from_clabe AS vendor_account, b.to_clabe AS employee_account, b.amount, b.date, v.vendor_count, e.employee_count,
  {sql_id('DET', 'ACCOUNT-TRANSFER', "b.txn_id || '|' || v.digest || '|' || e.digest")} AS observation_id
  FROM bank_txns b JOIN sets v ON v.account = b.from_clabe AND v.vendor_count > 0 JOIN sets e ON e.account = b.to_clabe AND e.employee_count > 0)
"""


@query("d1_shared_account_groups", OWNER_SETS_SQL + "SELECT * FROM d1g")
def d1g(given):
    return detectors.shared_account_groups(given.estate)[0]


@query("d1_shared_account_members", OWNER_SETS_SQL + "SELECT o.account, o.role, o.owner, d1g.observation_id FROM owners o JOIN d1g USING (account)")
def d1gm(given):
    return detectors.shared_account_groups(given.estate)[1]


@query("d4_transfer_groups", OWNER_SETS_SQL + "SELECT * FROM d4g")
def d4g(given):
    return detectors.transfer_groups(given.estate)[0]


@query("d4_transfer_members", OWNER_SETS_SQL + """
SELECT account, role, owner FROM owners WHERE (role = 'vendor' AND account IN (SELECT vendor_account FROM d4g)) OR (role = 'employee' AND account IN (SELECT employee_account FROM d4g))""")
def d4gm(given):
    return detectors.transfer_groups(given.estate)[1]


@query("d2_shared_vendor_account", D2_SQL + "SELECT * FROM d2")
def d2(given):
    return detectors.shared_vendor_account(given.estate)[0]


@query("d2_shared_vendor_members", D2_SQL + "SELECT d2.observation_id, v.rfc, d2.account FROM d2 JOIN vendors v ON v.bank_clabe = d2.account")
def d2m(given):
    return detectors.shared_vendor_account(given.estate)[1]


@query("d3_efos_vendor_match", D3_SQL + "SELECT * FROM d3")
def d3(given):
    listed = detectors.efos_vendor_match(given.estate)
    return listed.withColumn("statuses", F.array_join("statuses", ",")).withColumn(
        "publication_dates", F.array_join("publication_dates", ","))


@query("d4_vendor_to_employee_transfer", D4_SQL + "SELECT * FROM d4")
def d4(given):
    return detectors.vendor_to_employee_transfer(given.estate)


@query("d5_similar_invoice_cluster", D5_SQL + """
SELECT observation_id, issuer_rfc, receiver_rfc, CAST(start AS VARCHAR) AS first_issue_date, CAST(last_day AS VARCHAR) AS last_issue_date,
       n AS invoice_count, cluster_total, round(med, 4) AS median_total, round(spread, 6) AS relative_spread FROM d5""")
def d5(given):
    clusters, _ = detectors.similar_invoice_cluster(given.estate, max_spread=SPREAD)
    return clusters.withColumn("median_total", F.round("median_total", 4)).withColumn("relative_spread", F.round("relative_spread", 6))


@query("d5_cluster_members", D5_SQL + """
SELECT d5.observation_id, r.issuer_rfc, r.receiver_rfc, r.uuid, r.total FROM d5
JOIN irow r ON r.issuer_rfc = d5.issuer_rfc AND r.receiver_rfc = d5.receiver_rfc AND r.d BETWEEN d5.start AND d5.last_day""")
def d5m(given):
    return detectors.similar_invoice_cluster(given.estate, max_spread=SPREAD)[1]


@query("d6_account_owner_entities", OWNERS_SQL + "SELECT * FROM owner_entities")
def d6(given):
    return detectors.account_owner_entities(given.estate)


@query("d7_bank_cycle_observation", D7_SQL + """
SELECT observation_id, array_to_string(n, ',') AS accounts, txn_ids, span::BIGINT AS date_span_days FROM d7""")
def d7(given):
    cycles, _ = detectors.bank_cycle_observation(given.estate, max_cycles=None)
    return cycles.select("observation_id", F.array_join("accounts", ",").alias("accounts"),
                         F.array_join("txn_ids", ",").alias("txn_ids"), F.col("date_span_days").cast("bigint"))


@query("d7_bank_cycle_entities", D7_SQL + OWNERS_SQL + """
SELECT observation_id, min(i) AS section, entity FROM (
  SELECT observation_id, CAST(i - 1 AS INT) AS i, o.entity FROM (SELECT observation_id, n, unnest(range(1, len(n) + 1)) AS i FROM d7) x
  JOIN owner_entities o ON o.account = x.n[x.i]) GROUP BY observation_id, entity
UNION ALL SELECT observation_id, CAST(999 + i AS INT), 'CLABE:' || n[i] FROM (SELECT observation_id, n, unnest(range(1, len(n) + 1)) AS i FROM d7)""")
def d7e(given):
    return detectors.bank_cycle_observation(given.estate, max_cycles=None)[1]


@query("d8_unsupported_candidates", D8_SCOPE_SQL + "SELECT * FROM d8i")
def d8c(given):
    return detectors.unsupported_candidates(given.estate)[0]


@query("d8_paid_without_po_or_contract", D8_SQL + "SELECT * FROM d8")
def d8(given):
    return detectors.paid_without_po_or_contract(given.estate)[0]


@query("d8_unsupported_invoices", D8_SQL + "SELECT d8.observation_id, d8u.rfc, d8u.uuid, d8u.total FROM d8u JOIN d8 USING (rfc)")
def d8m(given):
    return detectors.paid_without_po_or_contract(given.estate)[1]


@query("d9_run_rule_detectors")
def d9(given):
    found = detectors.run_rule_detectors(given.estate)
    return found.heads.select("observation_id", "detector_name", "signal_type", "statement", "facts",
                              signal_rank().alias("detector_rank"))


@query("d9_observation_heads", heads_sql(0.03) + "SELECT observation_id, signal AS signal_type, rank::INT AS detector_rank FROM obs")
def d9h(given):
    found = detectors.run_rule_detectors(given.estate)
    return found.heads.select("observation_id", "signal_type", signal_rank().cast("int").alias("detector_rank"))


@query("d9_heads_by_account", heads_sql(0.03) + OWNER_SETS_SQL + """
SELECT observation_id, signal AS signal_type, rank::INT AS detector_rank FROM obs WHERE rank NOT IN (1, 4)
UNION ALL SELECT observation_id, 'vendor_employee_shared_clabe', 1 FROM d1g UNION ALL SELECT observation_id, 'vendor_to_employee_bank_transfer', 4 FROM d4g""")
def d9g(given):
    found = detectors.run_rule_detectors(given.estate, pairs=False)
    return found.heads.select("observation_id", "signal_type", signal_rank().cast("int").alias("detector_rank"))


@query("d9_entities_by_account", OWNER_SETS_SQL + """
SELECT g.observation_id, CASE role WHEN 'vendor' THEN 0 ELSE 1 END::INT AS section, CASE role WHEN 'vendor' THEN 'RFC:' || owner ELSE owner END AS entity FROM d1g g JOIN owners USING (account)
UNION ALL SELECT observation_id, 2, 'CLABE:' || account FROM d1g
UNION ALL SELECT g.observation_id, 0, 'RFC:' || o.owner FROM d4g g JOIN owners o ON o.account = g.vendor_account AND o.role = 'vendor'
UNION ALL SELECT g.observation_id, 1, o.owner FROM d4g g JOIN owners o ON o.account = g.employee_account AND o.role = 'employee'
UNION ALL SELECT observation_id, 2, 'CLABE:' || vendor_account FROM d4g UNION ALL SELECT observation_id, 3, 'CLABE:' || employee_account FROM d4g""")
def d9ge(given):
    e = given.estate
    shared = detectors.observe_account_groups(*detectors.shared_account_groups(e))
    return shared.entities.unionByName(detectors.observe_transfer_groups(*detectors.transfer_groups(e)).entities)
