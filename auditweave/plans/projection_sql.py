"""The projection of ``sources.projection`` as common table expressions, for the oracle."""

ESTATE = """
book AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_orderpriority, CAST(o.o_orderdate AS DATE) AS day,
         CAST(round(o.o_totalprice * 100) AS BIGINT) AS cents, l.suppkey
  FROM orders o LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS suppkey FROM lineitem GROUP BY 1) l
    ON l.l_orderkey = o.o_orderkey),
vendors AS (
  SELECT 'SUP' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS rfc, s_name AS legal_name, '1990-01-01' AS registered_date,
         'Nation ' || CAST(s_nationkey AS VARCHAR) AS address,
         '058' || lpad(CAST(CASE WHEN s_suppkey % 10 = 7 THEN s_suppkey - 1 ELSE s_suppkey END AS VARCHAR), 15, '0') AS bank_clabe,
         'CAT-' || CAST(s_nationkey AS VARCHAR) AS category, 'v' || CAST(s_suppkey AS VARCHAR) || '@example.com' AS contact_email
  FROM supplier),
employees AS (
  SELECT 'EMP:' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS emp_id, c_name AS name, c_mktsegment AS role,
         (CASE WHEN c_custkey % 20 = 5 THEN '058' ELSE '072' END) || lpad(CAST(c_custkey AS VARCHAR), 15, '0') AS bank_clabe,
         '1991-01-01' AS hire_date
  FROM customer WHERE c_custkey % 5 = 0),
invoices AS (
  SELECT lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || '-CFDI' AS uuid,
         CASE WHEN suppkey IS NOT NULL THEN 'SUP' || lpad(CAST(suppkey AS VARCHAR), 9, '0') ELSE 'EMP920101AB1' END AS issuer_rfc,
         CASE WHEN suppkey IS NOT NULL THEN 'EMP920101AB1' ELSE 'CUS' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS receiver_rfc,
         CAST(day AS VARCHAR) AS issue_date,
         CAST((cents * 100 - (cents * 100) % 116) / 116 AS BIGINT) / 100.0 AS subtotal,
         (cents - CAST((cents * 100 - (cents * 100) % 116) / 116 AS BIGINT)) / 100.0 AS iva,
         cents / 100.0 AS total, 'Servicio ' || o_orderpriority AS concepto_text, 'G03' AS uso_cfdi,
         CASE WHEN o_orderstatus = 'O' AND o_orderkey % 50 <> 0 THEN '99' ELSE '03' END AS forma_pago,
         CASE WHEN o_orderstatus = 'O' THEN 'PPD' ELSE 'PUE' END AS metodo_pago,
         CASE WHEN o_orderkey % 37 = 0 THEN 'cancelado' ELSE 'vigente' END AS status
  FROM book),
purchase_orders AS (
  SELECT 'PO-' || lpad(CAST(b.o_orderkey AS VARCHAR), 8, '0') AS po_id, 'SUP' || lpad(CAST(b.suppkey AS VARCHAR), 9, '0') AS vendor_rfc,
         CAST(b.day AS VARCHAR) AS date,
         (CASE WHEN b.o_orderkey % 4 = 1 THEN b.cents + CAST((b.cents - b.cents % 100) / 100 AS BIGINT) ELSE b.cents END) / 100.0 AS amount,
         'Compras' AS requester, c.c_name AS approver, 'Pedido ' || b.o_orderpriority AS description
  FROM book b LEFT JOIN customer c ON c.c_custkey = b.o_custkey WHERE b.suppkey IS NOT NULL AND b.o_orderkey % 4 <> 0),
contracts AS (
  SELECT 'CTR-' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS contract_id, 'SUP' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS vendor_rfc,
         '1992-01-01' AS start_date, CAST(100000 + s_suppkey AS DOUBLE) AS value, 'Contrato marco de servicios con ' || s_name AS scope_text
  FROM supplier WHERE s_suppkey % 3 = 0),
efos_list AS (
  SELECT 'SUP' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS rfc, s_name AS legal_name,
         CASE WHEN s_suppkey % 9 = 1 THEN 'definitivo' ELSE 'presunto' END AS status,
         CASE WHEN s_suppkey % 2 = 1 THEN '1998-06-01' ELSE '2003-01-01' END AS publication_date
  FROM supplier WHERE s_suppkey % 9 IN (1, 4)),
ledger AS (
  SELECT b.o_orderkey * 4 + g.leg AS entry_id, CAST(b.day AS VARCHAR) AS date,
         CASE g.leg WHEN 0 THEN '6000' WHEN 1 THEN '1180' ELSE '2010' END AS account_code,
         CASE g.leg WHEN 0 THEN 'Gasto' WHEN 1 THEN 'IVA acreditable' ELSE 'Proveedores' END AS account_name,
         (CASE g.leg WHEN 0 THEN CAST((b.cents * 100 - (b.cents * 100) % 116) / 116 AS BIGINT)
                     WHEN 1 THEN b.cents - CAST((b.cents * 100 - (b.cents * 100) % 116) / 116 AS BIGINT) ELSE 0 END) / 100.0 AS debit,
         (CASE g.leg WHEN 2 THEN b.cents ELSE 0 END) / 100.0 AS credit, 'Registro de CFDI' AS description,
         lpad(CAST(b.o_orderkey AS VARCHAR), 8, '0') || '-CFDI' AS invoice_uuid, 'CC-01' AS cost_center, 'Contabilidad' AS approver
  FROM book b CROSS JOIN (VALUES (0), (1), (2)) g(leg) WHERE g.leg <> 2 OR b.o_orderkey % 101 <> 0),
bank_txns AS (
  SELECT 'BNK-P-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS txn_id, CAST(day + 30 AS VARCHAR) AS date,
         '012000000000000999' AS from_clabe,
         '058' || lpad(CAST(CASE WHEN suppkey % 10 = 7 THEN suppkey - 1 ELSE suppkey END AS VARCHAR), 15, '0') AS to_clabe,
         cents / 100.0 AS amount, 'Pago CFDI ' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS reference, 'SPEI' AS channel
  FROM book WHERE suppkey IS NOT NULL AND o_orderstatus IN ('F', 'P') AND o_orderkey % 37 <> 0
  UNION ALL
  SELECT 'BNK-E-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0'), CAST(day + 35 AS VARCHAR),
         '058' || lpad(CAST(CASE WHEN suppkey % 10 = 7 THEN suppkey - 1 ELSE suppkey END AS VARCHAR), 15, '0'),
         (CASE WHEN (o_custkey - o_custkey % 5) % 20 = 5 THEN '058' ELSE '072' END)
           || lpad(CAST(o_custkey - o_custkey % 5 AS VARCHAR), 15, '0'),
         CAST((cents * 7 - (cents * 7) % 100) / 100 AS BIGINT) / 100.0, 'Reembolso', 'SPEI'
  FROM book WHERE suppkey IS NOT NULL AND o_orderkey % 20 = 3
  UNION ALL
  SELECT 'BNK-V-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0'), CAST(day + 3 AS VARCHAR),
         '058' || lpad(CAST(suppkey AS VARCHAR), 15, '0'),
         '058' || lpad(CAST(CASE WHEN (suppkey + 1) % 10 = 7 THEN suppkey ELSE suppkey + 1 END AS VARCHAR), 15, '0'),
         CAST((cents * 985 - (cents * 985) % 1000) / 1000 AS BIGINT) / 100.0, 'Traspaso', 'SPEI'
  FROM book WHERE suppkey IS NOT NULL AND suppkey % 10 IN (1, 3) AND o_orderkey % 25 = 7
  UNION ALL
  SELECT 'BNK-R-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0'), CAST(day + 9 AS VARCHAR),
         '058' || lpad(CAST(suppkey AS VARCHAR), 15, '0'), '012000000000000999',
         CAST((cents * 97 - (cents * 97) % 100) / 100 AS BIGINT) / 100.0, 'Devolucion', 'SPEI'
  FROM book WHERE suppkey IS NOT NULL AND suppkey % 10 = 2 AND o_orderkey % 25 = 7)
"""
