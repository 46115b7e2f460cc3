"""Queries for sources, cleaning expressions and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditweave.functions import clean
from auditweave.operators import lookups
from auditweave.plans.registry import query
from auditweave.sources.estate import TABLES, check_estate, estate_profile, table_counts

_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES)


@query("s1_load_estate", _COUNTS)
def s1(given):
    estate = check_estate({name: given.estate.table(name) for name in TABLES})
    return table_counts(estate)


@query("s3_estate_profile", """
SELECT table_name AS item, CAST(row_count AS VARCHAR) AS value FROM (""" + _COUNTS + """)
UNION ALL SELECT 'company_rfc', (SELECT receiver_rfc FROM invoices GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
UNION ALL SELECT 'period_start', (SELECT min(issue_date) FROM invoices)
UNION ALL SELECT 'period_end', (SELECT max(issue_date) FROM invoices)""")
def s3(given):
    return estate_profile(given.estate)


# The texts below mix blanks, line ends and "nothing" words into real rows.
_DOCS = """
WITH t AS (
  SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '  ' || chr(10) ELSE ' ' || source || chr(9) END AS padded,
         CASE WHEN doc_id % 5 = 0 THEN ' N/A ' ELSE lang END AS word, text
  FROM documents)
"""


def _texts(given):
    key = F.col("doc_id")
    return given.base("documents").select(
        "doc_id",
        F.when(key % 7 == 0, F.lit("  \n")).otherwise(F.concat(F.lit(" "), "source", F.lit("\t"))).alias("padded"),
        F.when(key % 5 == 0, F.lit(" N/A ")).otherwise(F.col("lang")).alias("word"),
        "text",
    )


@query("p1_clean_text", _DOCS + r"""
SELECT doc_id, nullif(regexp_replace(regexp_replace(padded, '^\s+', ''), '\s+$', ''), '') AS cleaned FROM t""", estate=False)
def p1(given):
    return _texts(given).select("doc_id", clean.clean_text("padded").alias("cleaned"))


_EVENTS = """
WITH e AS (
  SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'n.d.' WHEN event_id % 13 = 0 THEN 'NaN' ELSE CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END AS amount_text,
         CASE WHEN event_id % 17 = 0 THEN 'no date' ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS date_text,
         CASE event_id % 4 WHEN 0 THEN '2024-02-30' WHEN 1 THEN '24-1-5' WHEN 2 THEN ' ' || CAST(CAST(ts AS DATE) AS VARCHAR) || ' ' ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS iso_text,
         user_id, event_type
  FROM events)
"""


def _event_texts(given):
    key, day = F.col("event_id"), F.col("ts").cast("date").cast("string")
    return given.base("events").select(
        "event_id",
        F.when(key % 11 == 0, "n.d.").when(key % 13 == 0, "NaN")
        .otherwise(F.round(F.col("value") * 100).cast("bigint").cast("string")).alias("amount_text"),
        F.when(key % 17 == 0, "no date").otherwise(day).alias("date_text"),
        F.when(key % 4 == 0, "2024-02-30").when(key % 4 == 1, "24-1-5")
        .when(key % 4 == 2, F.concat(F.lit(" "), day, F.lit(" "))).otherwise(day).alias("iso_text"),
        "user_id", "event_type",
    )


@query("p2_to_number", _EVENTS + """
SELECT event_id, CASE WHEN isfinite(TRY_CAST(amount_text AS DOUBLE)) THEN TRY_CAST(amount_text AS DOUBLE) END AS number FROM e""", estate=False)
def p2(given):
    return _event_texts(given).select("event_id", clean.to_number("amount_text").alias("number"))


@query("p3_to_date", _EVENTS + "SELECT event_id, CAST(TRY_CAST(date_text AS DATE) AS VARCHAR) AS day FROM e", estate=False)
def p3(given):
    return _event_texts(given).select("event_id", clean.to_date("date_text").cast("string").alias("day"))


@query("p4_iso_date", _EVENTS + r"""
SELECT event_id, CASE WHEN regexp_matches(trim(iso_text), '^\d{4}-\d{2}-\d{2}$') AND TRY_CAST(trim(iso_text) AS DATE) IS NOT NULL
  THEN trim(iso_text) END AS iso FROM e""", estate=False)
def p4(given):
    return _event_texts(given).select("event_id", clean.iso_date("iso_text").alias("iso"))


@query("p5_normalize_status", "SELECT rfc, lower(trim(coalesce('  ' || upper(status) || ' ', ''))) AS status FROM efos_list")
def p5(given):
    spoiled = F.concat(F.lit("  "), F.upper("status"), F.lit(" "))
    return given.estate.efos_list.select("rfc", clean.normalize_status(spoiled).alias("status"))


@query("p6_entity_prefix", """
SELECT emp_id, CASE WHEN starts_with(e, 'EMP:') THEN e ELSE 'EMP:' || e END AS entity
FROM (SELECT emp_id, CASE WHEN right(emp_id, 1) = '5' THEN substr(emp_id, 5) ELSE emp_id END AS e FROM employees)""")
def p6(given):
    bare = F.when(F.col("emp_id").endswith("5"), F.substring("emp_id", 5, 20)).otherwise(F.col("emp_id"))
    return given.estate.employees.select("emp_id", clean.entity_prefix("EMP:", bare).alias("entity"))


@query("p7_normalize_entity", r"""
, raw AS (
  SELECT rfc, CASE CAST(right(rfc, 1) AS INT) % 5 WHEN 0 THEN '  ' WHEN 1 THEN 'EMP:' || rfc WHEN 2 THEN 'RFC:' WHEN 3 THEN rfc || ' X' ELSE 'RFC:' || rfc END AS t
  FROM vendors),
c AS (SELECT rfc, nullif(trim(t), '') AS t FROM raw),
e AS (
  SELECT rfc, t, CASE WHEN t IS NULL THEN 'empty entity' WHEN starts_with(t, 'EMP:') THEN 'wrong prefix'
    WHEN nullif(trim(regexp_replace(t, '^RFC:', '')), '') IS NULL THEN 'empty payload'
    WHEN regexp_matches(regexp_replace(t, '^RFC:', ''), '\s') THEN 'white space in entity' END AS entity_error
  FROM c)
SELECT rfc, entity_error, CASE WHEN entity_error IS NULL THEN CASE WHEN starts_with(t, 'RFC:') THEN t ELSE 'RFC:' || t END END AS entity FROM e""")
def p7(given):
    digit = F.substring("rfc", -1, 1).cast("int") % 5
    raw = (
        F.when(digit == 0, F.lit("  ")).when(digit == 1, F.concat(F.lit("EMP:"), "rfc"))
        .when(digit == 2, F.lit("RFC:")).when(digit == 3, F.concat("rfc", F.lit(" X")))
        .otherwise(F.concat(F.lit("RFC:"), "rfc"))
    )
    entity, error = clean.normalize_entity(raw)
    return given.estate.vendors.select("rfc", entity.alias("entity"), error.alias("entity_error"))


@query("p8_observation_id", """
SELECT uuid, 'OBS-DET-TEST-' || upper(substr(sha1(issuer_rfc || '|' || receiver_rfc || '|' || uuid), 1, 12)) AS observation_id FROM invoices""")
def p8(given):
    parts = ["issuer_rfc", "receiver_rfc", "uuid"]
    return given.estate.invoices.select("uuid", clean.observation_id("DET", "TEST", parts).alias("observation_id"))


@query("p9_null_like", _DOCS + """
SELECT doc_id, CASE WHEN lower(trim(word)) NOT IN ('null', 'none', 'nil', 'n/a', 'na', '') THEN word END AS word FROM t""", estate=False)
def p9(given):
    return _texts(given).select("doc_id", clean.null_like("word").alias("word"))


@query("p10_clip", _DOCS + r"""
, s AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS x FROM t)
SELECT doc_id, CASE WHEN length(x) > 180 THEN regexp_replace(substr(x, 1, 177), '\s+$', '') || '...' ELSE x END AS clipped FROM s""", estate=False)
def p10(given):
    return _texts(given).select("doc_id", clean.clip("text", 180).alias("clipped"))


def _order_refs(given):
    """One reference per invoice to the order that should exist, and one to the contract of its issuer."""
    inv = given.estate.invoices
    orders = inv.select(F.lit("purchase_orders").alias("source_table"),
                        F.concat(F.lit("PO-"), F.substring("uuid", 1, 8)).alias("record_id"))
    agreements = inv.select(F.lit("contracts").alias("source_table"),
                            F.concat(F.lit("CTR-"), F.substring("issuer_rfc", 4, 20)).alias("record_id"))
    books = inv.select(F.lit("vendors").alias("source_table"), F.col("issuer_rfc").alias("record_id"))
    return orders.unionByName(agreements).unionByName(books)


_REFS = """
, refs AS (
  SELECT 'purchase_orders' AS source_table, 'PO-' || substr(uuid, 1, 8) AS record_id FROM invoices
  UNION ALL SELECT 'contracts', 'CTR-' || substr(issuer_rfc, 4) FROM invoices
  UNION ALL SELECT 'vendors', issuer_rfc FROM invoices),
idx AS (
  SELECT 'purchase_orders' AS source_table, po_id AS record_id, amount FROM purchase_orders
  UNION ALL SELECT 'contracts', contract_id, value FROM contracts
  UNION ALL SELECT 'vendors', rfc, CAST(NULL AS DOUBLE) FROM vendors)
"""


@query("l1_resolve_records", _REFS + """
SELECT r.source_table, r.record_id, i.record_id IS NOT NULL AS found FROM refs r LEFT JOIN idx i USING (source_table, record_id)""")
def l1(given):
    return lookups.resolve_records(given.estate, _order_refs(given)).drop("amount")


@query("l2_record_amounts", _REFS + """
SELECT r.source_table, r.record_id, i.amount FROM refs r LEFT JOIN idx i USING (source_table, record_id)""")
def l2(given):
    return lookups.record_amounts(given.estate, _order_refs(given))


@query("l3_vendor_record", """
SELECT r.rfc, v.legal_name, v.bank_clabe, v.rfc IS NOT NULL AS found
FROM (SELECT DISTINCT issuer_rfc AS rfc FROM invoices) r LEFT JOIN vendors v ON v.rfc = r.rfc""")
def l3v(given):
    asked = given.estate.invoices.select(F.col("issuer_rfc").alias("rfc")).distinct()
    table = given.estate.vendors.select("rfc", "legal_name", "bank_clabe")
    return lookups.records_by_key(asked, table, "rfc")


@query("l3_employee_record", """
SELECT r.emp_id, e.name, e.role, e.emp_id IS NOT NULL AS found
FROM (SELECT 'EMP:' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS emp_id FROM customer) r LEFT JOIN employees e ON e.emp_id = r.emp_id""")
def l3e(given):
    asked = given.base("customer").select(F.concat(F.lit("EMP:"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("emp_id"))
    return lookups.records_by_key(asked, given.estate.employees.select("emp_id", "name", "role"), "emp_id")


@query("l3_invoice_record", """
SELECT r.uuid, i.issuer_rfc, i.total, i.status, i.uuid IS NOT NULL AS found
FROM (SELECT substr(reference, 11) || '-CFDI' AS uuid FROM bank_txns) r LEFT JOIN invoices i ON i.uuid = r.uuid""")
def l3i(given):
    asked = given.estate.bank_txns.select(F.concat(F.substring("reference", 11, 20), F.lit("-CFDI")).alias("uuid"))
    return lookups.records_by_key(asked, given.estate.invoices.select("uuid", "issuer_rfc", "total", "status"), "uuid")


@query("l3_bank_record", """
SELECT r.txn_id, b.from_clabe, b.to_clabe, b.amount, b.txn_id IS NOT NULL AS found
FROM (SELECT 'BNK-P-' || substr(uuid, 1, 8) AS txn_id FROM invoices) r LEFT JOIN bank_txns b ON b.txn_id = r.txn_id""")
def l3b(given):
    asked = given.estate.invoices.select(F.concat(F.lit("BNK-P-"), F.substring("uuid", 1, 8)).alias("txn_id"))
    return lookups.records_by_key(asked, given.estate.bank_txns.select("txn_id", "from_clabe", "to_clabe", "amount"), "txn_id")


@query("l4_vendor_invoices", """
SELECT v.rfc AS issuer_rfc, i.uuid, i.issue_date, i.total, CASE WHEN i.uuid IS NOT NULL THEN row_number() OVER (PARTITION BY v.rfc ORDER BY i.issue_date, i.uuid) END AS position
FROM vendors v LEFT JOIN invoices i ON i.issuer_rfc = v.rfc""")
def l4(given):
    asked = given.estate.vendors.select(F.col("rfc").alias("issuer_rfc"))
    return lookups.vendor_invoices(given.estate, asked).select("issuer_rfc", "uuid", "issue_date", "total", "position")


@query("l5_vendor_purchase_orders", """
SELECT v.rfc AS vendor_rfc, p.po_id, p.date, p.amount, CASE WHEN p.po_id IS NOT NULL THEN row_number() OVER (PARTITION BY v.rfc ORDER BY p.date, p.po_id) END AS position
FROM vendors v LEFT JOIN purchase_orders p ON p.vendor_rfc = v.rfc""")
def l5(given):
    asked = given.estate.vendors.select(F.col("rfc").alias("vendor_rfc"))
    return lookups.vendor_purchase_orders(given.estate, asked).select("vendor_rfc", "po_id", "date", "amount", "position")


@query("l6_vendor_contracts", """
SELECT v.rfc AS vendor_rfc, c.contract_id, c.value, CASE WHEN c.contract_id IS NOT NULL THEN row_number() OVER (PARTITION BY v.rfc ORDER BY c.start_date, c.contract_id) END AS position
FROM vendors v LEFT JOIN contracts c ON c.vendor_rfc = v.rfc""")
def l6(given):
    asked = given.estate.vendors.select(F.col("rfc").alias("vendor_rfc"))
    return lookups.vendor_contracts(given.estate, asked).select("vendor_rfc", "contract_id", "value", "position")


@query("l7_account_transactions", """
, accts AS (SELECT DISTINCT bank_clabe AS account FROM vendors UNION SELECT '012000000000000999'),
hits AS (
  SELECT a.account, b.txn_id, b.date, b.amount, CASE WHEN b.txn_id IS NOT NULL THEN row_number() OVER (PARTITION BY a.account ORDER BY b.date, b.txn_id) END AS position
  FROM accts a LEFT JOIN bank_txns b ON b.from_clabe = a.account OR b.to_clabe = a.account)
SELECT * FROM hits""")
def l7(given):
    company = given.estate.bank_txns.select(F.col("from_clabe").alias("account")).where("account LIKE '012%'")
    asked = given.estate.vendors.select(F.col("bank_clabe").alias("account")).union(company).distinct()
    return lookups.account_transactions(given.estate, asked).select("account", "txn_id", "date", "amount", "position")


@query("l8_invoice_ledger", """
SELECT i.uuid AS invoice_uuid, l.entry_id, l.debit, l.credit, CASE WHEN l.entry_id IS NOT NULL THEN row_number() OVER (PARTITION BY i.uuid ORDER BY l.date, l.entry_id) END AS position
FROM invoices i LEFT JOIN ledger l ON l.invoice_uuid = i.uuid""")
def l8(given):
    asked = given.estate.invoices.select(F.col("uuid").alias("invoice_uuid"))
    return lookups.invoice_ledger(given.estate, asked).select("invoice_uuid", "entry_id", "debit", "credit", "position")


@query("l9_account_owner", """
, accts AS (SELECT from_clabe AS account FROM bank_txns UNION SELECT to_clabe FROM bank_txns)
SELECT a.account, (SELECT min(rfc) FROM vendors v WHERE v.bank_clabe = a.account) AS vendor_rfc,
       (SELECT min(emp_id) FROM employees e WHERE e.bank_clabe = a.account) AS emp_id FROM accts a""")
def l9(given):
    bank = given.estate.bank_txns
    asked = bank.select(F.col("from_clabe").alias("account")).union(bank.select("to_clabe")).distinct()
    return lookups.account_owner(given.estate, asked)


@query("l10_efos_lookup", """
SELECT r.rfc, e.status, e.publication_date, e.rfc IS NOT NULL AS found
FROM (SELECT DISTINCT issuer_rfc AS rfc FROM invoices) r LEFT JOIN efos_list e ON e.rfc = r.rfc""")
def l10(given):
    asked = given.estate.invoices.select(F.col("issuer_rfc").alias("rfc")).distinct()
    return lookups.efos_lookup(given.estate, asked).drop("legal_name")


@query("l11_invoice_settlements", """
SELECT i.uuid, b.txn_id, b.date, b.amount FROM invoices i LEFT JOIN bank_txns b ON b.reference = 'Pago CFDI ' || substr(i.uuid, 1, 8)""")
def l11(given):
    return lookups.invoice_settlements(given.estate, given.estate.invoices.select("uuid")).select("uuid", "txn_id", "date", "amount")


@query("l12_efos_targets", "SELECT DISTINCT e.rfc FROM efos_list e JOIN invoices i ON i.issuer_rfc = e.rfc")
def l12(given):
    return lookups.efos_targets(given.estate)
