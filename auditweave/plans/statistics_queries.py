"""Queries for the statistical detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditweave.operators import statistics as st
from auditweave.plans.detector_queries import sql_digest, sql_id
from auditweave.plans.registry import query
from auditweave.session import durable


def books(given):
    """(invoices, payments, ledger): two payments and one ledger row per order, some of them off."""
    key = F.col("o_orderkey")
    rows = given.base("orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    tenth = ((F.col("cents") - F.col("cents") % 10) / 10).cast("bigint")
    fifth = ((F.col("cents") - F.col("cents") % 20) / 20).cast("bigint")
    third = ((F.col("cents") - F.col("cents") % 3) / 3).cast("bigint")
    text = key.cast("string")
    invoices = rows.where(key % 29 != 0).select(text.alias("invoice_id"), (F.col("cents") / 100.0).alias("total_amount"))
    rest = F.col("cents") - third + F.when(key % 7 == 0, tenth).when(key % 7 == 1, -tenth).otherwise(0)
    parts = F.array(F.struct(F.lit("1").alias("part"), third.alias("c")), F.struct(F.lit("2").alias("part"), rest.alias("c")))
    payments = rows.where(key % 11 != 0).select("o_orderkey", F.inline(parts)).select(
        F.concat_ws("-", F.lit("PAY"), text, "part").alias("payment_id"), text.alias("invoice_id"), (F.col("c") / 100.0).alias("payment_amount"))
    booked = F.col("cents") + F.when(key % 13 == 0, -fifth).when(key % 13 == 1, fifth).otherwise(0)
    ledger = rows.select(F.concat_ws("-", F.lit("LED"), text).alias("transaction_id"), text.alias("invoice_id"), (booked / 100.0).alias("recorded_amount"))
    return invoices, payments, ledger


BOOKS_SQL = """
WITH o AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS id, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders),
tinv AS (SELECT id AS invoice_id, c AS cents FROM o WHERE k % 29 <> 0),
tpay AS (
  SELECT 'PAY-' || id || '-1' AS payment_id, id AS invoice_id, CAST((c - c % 3) / 3 AS BIGINT) AS cents FROM o WHERE k % 11 <> 0
  UNION ALL SELECT 'PAY-' || id || '-2', id, c - CAST((c - c % 3) / 3 AS BIGINT)
    + CASE k % 7 WHEN 0 THEN CAST((c - c % 10) / 10 AS BIGINT) WHEN 1 THEN -CAST((c - c % 10) / 10 AS BIGINT) ELSE 0 END FROM o WHERE k % 11 <> 0),
tled AS (SELECT 'LED-' || id AS transaction_id, id AS invoice_id, c + CASE k % 13 WHEN 0 THEN -CAST((c - c % 20) / 20 AS BIGINT) WHEN 1 THEN CAST((c - c % 20) / 20 AS BIGINT) ELSE 0 END AS cents FROM o),
m AS (
  SELECT invoice_id, coalesce(i.cents, 0) AS b, coalesce(p.cents, 0) AS p, coalesce(l.cents, 0) AS l
  FROM tinv i FULL JOIN (SELECT invoice_id, sum(cents)::BIGINT AS cents FROM tpay GROUP BY 1) p USING (invoice_id)
  FULL JOIN (SELECT invoice_id, sum(cents)::BIGINT AS cents FROM tled GROUP BY 1) l USING (invoice_id)),
t1 AS (
  SELECT invoice_id, b / 100.0 AS invoiced_amount, p / 100.0 AS paid_amount, l / 100.0 AS ledger_amount, (p - b) / 100.0 AS diff_payment_invoice,
    (l - p) / 100.0 AS diff_ledger_payment, (l - b) / 100.0 AS diff_ledger_invoice,
    CASE WHEN abs(p - b) <= 1 AND l < p THEN 'LEDGER_UNDER_RECORDING' WHEN abs(p - b) <= 1 THEN 'LEDGER_OVER_RECORDING'
      WHEN b = 0 AND p > 0 THEN 'ORPHAN_PAYMENT' WHEN p = 0 AND b > 0 THEN 'UNPAID_INVOICE' WHEN p > b THEN 'OVERPAYMENT' ELSE 'UNDERPAYMENT' END AS mismatch_type,
    CASE WHEN b > 0 THEN least(abs((p - b) / 100.0) / (b / 100.0), 1.0) ELSE 1.0 END AS ratio
  FROM m WHERE abs(p - b) > 1 OR abs(l - p) > 1 OR abs(l - b) > 1),
t1s AS (
  SELECT *, CASE mismatch_type WHEN 'LEDGER_UNDER_RECORDING' THEN 0.9 WHEN 'LEDGER_OVER_RECORDING' THEN 0.8 WHEN 'ORPHAN_PAYMENT' THEN 0.85 WHEN 'UNPAID_INVOICE' THEN 0.4
    WHEN 'OVERPAYMENT' THEN round(0.5 + 0.5 * ratio, 2) ELSE round(0.2 + 0.3 * ratio, 2) END::DOUBLE AS score FROM t1)
"""


@query("t1_triple_reconciliation", BOOKS_SQL + "SELECT * EXCLUDE (ratio) FROM t1s", estate=False)
def t1(given):
    return st.triple_reconciliation(*books(given))


@query("t1_reconciliation_records", BOOKS_SQL + """
SELECT invoice_id, 'invoice' AS kind, invoice_id AS record_id FROM t1 WHERE invoiced_amount > 0
UNION ALL SELECT invoice_id, 'payment', payment_id FROM tpay WHERE invoice_id IN (SELECT invoice_id FROM t1)
UNION ALL SELECT invoice_id, 'ledger', transaction_id FROM tled WHERE invoice_id IN (SELECT invoice_id FROM t1)""", estate=False)
def t1r(given):
    invoices, payments, ledger = books(given)
    return st.reconciliation_records(st.triple_reconciliation(invoices, payments, ledger), payments, ledger)


_ENTROPY_SQL = """
WITH vc AS (SELECT l_partkey, l_returnflag AS v, count(*) AS c FROM lineitem GROUP BY 1, 2),
n AS (SELECT l_partkey, sum(c)::BIGINT AS n FROM vc GROUP BY 1),
ent AS (
  SELECT l_partkey, max(n) AS sample_size, count(*) AS unique_values, abs(sum(-(c / n) * log2(c / n))) AS h, min(struct_pack(c := -c, v := v)) AS top
  FROM vc JOIN n USING (l_partkey) GROUP BY 1),
e2 AS (SELECT *, CASE WHEN h > 1e-12 THEN h ELSE 0 END AS hh, CASE WHEN sample_size > 1 THEN log2(sample_size) ELSE 1.0 END AS mx FROM ent),
e3 AS (SELECT *, greatest(0.0, least(1.0, hh / mx)) AS nh FROM e2)
"""


@query("t2_entropy_collapse", _ENTROPY_SQL + """
SELECT l_partkey, sample_size, unique_values, round(hh, 4) AS shannon_entropy, round(mx, 4) AS max_entropy, round(nh, 4) AS normalized_entropy,
  top.v AS dominant_value, -top.c AS dominant_count, round(-top.c / sample_size, 4) AS dominant_ratio, round(1 - round(nh, 4), 2) AS score,
  'ENTROPY_COLLAPSE_STRUCTURED_PATTERN' AS mismatch_type FROM e3 WHERE sample_size >= 3 AND round(nh, 4) < 0.35""", estate=False)
def t2(given):
    return st.entropy_collapse(given.base("lineitem"), "l_returnflag", "l_partkey")


def transactions(given, vendor="event_type"):
    return given.base("events").select(F.col("event_id").alias("transaction_id"), F.col(vendor).cast("string").alias("vendor_id"),
                                       F.col("value").alias("amount"), F.col("ts").alias("timestamp"))


@query("t3_off_hours", """
WITH e AS (SELECT event_id AS transaction_id, event_type AS vendor_id, hour(ts)::INT AS hour, hour(ts) >= 23 OR hour(ts) < 5 AS is_night, isodow(ts) >= 6 AS is_weekend FROM events)
SELECT transaction_id, vendor_id, hour, is_night, is_weekend, concat_ws(',', CASE WHEN is_night THEN 'night' END, CASE WHEN is_weekend THEN 'weekend' END) AS reasons,
  CASE WHEN is_night AND is_weekend THEN 0.8 WHEN is_night THEN 0.7 ELSE 0.6 END::DOUBLE AS score FROM e WHERE is_night OR is_weekend""", estate=False)
def t3(given):
    found = st.off_hours(transactions(given))
    return found.select("transaction_id", "vendor_id", "hour", "is_night", "is_weekend", F.array_join("reasons", ",").alias("reasons"), "score")


def _burst_sql(minutes: int, vendor: str = "event_type") -> str:
    return f"""
WITH RECURSIVE e AS (
  SELECT event_id, CAST({vendor} AS VARCHAR) AS v, ts, value, row_number() OVER (PARTITION BY {vendor} ORDER BY ts, event_id) - 1 AS pos,
    count(*) OVER (PARTITION BY {vendor} ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL {minutes} MINUTES FOLLOWING) AS stop FROM events),
cand AS (SELECT v, pos, stop FROM e WHERE stop - pos > 3),
nxt AS (SELECT c.v, c.pos, c.stop, n.pos AS nxt FROM cand c ASOF LEFT JOIN cand n ON c.v = n.v AND c.stop <= n.pos),
chain AS (
  SELECT n.* FROM nxt n JOIN (SELECT v, min(pos) AS pos FROM cand GROUP BY 1) f ON f.v = n.v AND f.pos = n.pos
  UNION ALL SELECT n.* FROM chain c JOIN nxt n ON n.v = c.v AND n.pos = c.nxt),
mem AS (SELECT c.v, row_number() OVER (PARTITION BY c.v ORDER BY c.pos) AS burst, c.pos, c.stop FROM chain c),
rows_ AS (SELECT m.v, m.burst, e.event_id, e.ts, e.value FROM mem m JOIN e ON e.v = m.v AND e.pos >= m.pos AND e.pos < m.stop)
"""


_BURST_SELECT = """
SELECT v AS vendor_id, burst, count(*) AS transaction_count, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0, 2) AS duration_seconds,
  CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_burst_amount FROM rows_ GROUP BY 1, 2"""


def _bursts(frame):
    return frame.select("vendor_id", "burst", "transaction_count", "duration_seconds", "total_burst_amount")


@query("t4_velocity_burst", _burst_sql(5) + _BURST_SELECT, estate=False)
def t4(given):
    return _bursts(st.velocity_burst(transactions(given))[0])


@query("t4_velocity_burst_dense", _burst_sql(25) + _BURST_SELECT, estate=False)
def t4d(given):
    return _bursts(st.velocity_burst(transactions(given), minutes=25.0)[0])


@query("t4_burst_members", _burst_sql(25) + "SELECT v AS vendor_id, burst, CAST(event_id AS VARCHAR) AS transaction_id FROM rows_", estate=False)
def t4m(given):
    return st.velocity_burst(transactions(given), minutes=25.0)[1]


@query("t5_isolation_forest")
def t5(given):
    rows = transactions(given).withColumn("hour", F.hour("timestamp"))
    return st.isolation_forest(rows).select("transaction_id", "vendor_id", "amount", "hour", "score", "decision")


#: Minutes of a burst in the pack: the given events are days apart per user, so five minutes hold none.
PACK_MINUTES = 120


def pack_transactions(given):
    """Transactions per user; every seventh user pays round amounts only."""
    rows = transactions(given, "user_id")
    even = F.col("vendor_id").cast("bigint") % 7 == 0
    return rows.withColumn("amount", F.when(even, F.floor(F.col("amount") / 50) * 50.0).otherwise(F.col("amount")))


_PACKS: dict[tuple[str, str], st.StatisticalPack] = {}


def stored_pack(given) -> st.StatisticalPack:
    """All five detectors, written once per application: the given tables do not change while it runs."""
    key = (given.spark.sparkContext.applicationId, given.folder)
    if key not in _PACKS:
        made = st.run_statistical_pack(*books(given), pack_transactions(given), minutes=PACK_MINUTES)
        _PACKS[key] = st.StatisticalPack(durable(made.heads), durable(made.records))
    return _PACKS[key]


def four_detectors(pack: st.StatisticalPack) -> st.StatisticalPack:
    """Without the forest, which SQL cannot grow."""
    heads = pack.heads.where("rule_or_model <> 'isolation_forest'")
    return st.StatisticalPack(heads, pack.records.join(heads.select("observation_id").distinct(), "observation_id", "left_semi"))


_PACK_SQL = BOOKS_SQL.replace("WITH o AS", "WITH RECURSIVE o AS", 1) + _burst_sql(PACK_MINUTES, "user_id").replace("WITH RECURSIVE e AS", ", e AS", 1) + f"""
, ev AS (SELECT CAST(user_id AS VARCHAR) AS u, CAST(event_id AS VARCHAR) AS id, ts, hour(ts) >= 23 OR hour(ts) < 5 AS is_night, isodow(ts) >= 6 AS is_weekend,
    CASE WHEN user_id % 7 = 0 THEN floor(value / 50) * 50.0 ELSE value END AS x FROM events),
vc AS (SELECT u, x, count(*) AS c FROM ev GROUP BY 1, 2), n AS (SELECT u, sum(c)::BIGINT AS n FROM vc GROUP BY 1),
ent AS (SELECT u, max(n) AS n, count(*) AS vals, abs(sum(-(c / n) * log2(c / n))) AS h, min(struct_pack(c := -c, x := x)) AS top FROM vc JOIN n USING (u) GROUP BY 1),
low AS (SELECT *, round(CASE WHEN h > 1e-12 THEN h / log2(n) ELSE 0 END, 4) AS nh FROM ent WHERE n >= 3 AND round(h / log2(n), 4) < 0.35),
late AS (SELECT * FROM ev WHERE is_night OR is_weekend),
grp AS (
  SELECT 'triple_reconciliation' AS model, invoice_id AS target, 0 AS burst, 'invoice' AS kind, invoice_id AS record_id FROM t1 WHERE invoiced_amount > 0
  UNION ALL SELECT 'triple_reconciliation', invoice_id, 0, 'payment', payment_id FROM tpay WHERE invoice_id IN (SELECT invoice_id FROM t1)
  UNION ALL SELECT 'triple_reconciliation', invoice_id, 0, 'ledger', transaction_id FROM tled WHERE invoice_id IN (SELECT invoice_id FROM t1)
  UNION ALL SELECT 'entropy', u, 0, 'transaction_id', id FROM ev SEMI JOIN low USING (u)
  UNION ALL SELECT 'velocity_burst', v, burst, 'transaction_id', CAST(event_id AS VARCHAR) FROM rows_),
gid AS (SELECT model, target, burst, 'OBS-STA-' || replace(upper(model), '_', '-') || '-'
    || upper(substr(sha1(target || '|' || {sql_digest("kind || ':' || record_id")}), 1, 12)) AS observation_id FROM grp GROUP BY 1, 2, 3),
lid AS (SELECT {sql_id('STA', 'OFF-HOURS', "u || '|' || id")} AS observation_id, * FROM late),
rec AS (SELECT observation_id, target, kind, record_id FROM grp JOIN gid USING (model, target, burst)
  UNION ALL SELECT observation_id, u, 'transaction_id', id FROM lid),
obs AS (
  SELECT observation_id, model AS rule_or_model, target, mismatch_type, score AS anomaly_score FROM t1s JOIN gid ON model = 'triple_reconciliation' AND target = invoice_id
  UNION ALL SELECT observation_id, model, target, 'ENTROPY_COLLAPSE_STRUCTURED_PATTERN', round(1 - nh, 2) FROM low JOIN gid ON model = 'entropy' AND target = u
  UNION ALL SELECT observation_id, 'off_hours', u, 'OFF_HOURS_EXECUTION', CASE WHEN is_night AND is_weekend THEN 0.8 WHEN is_night THEN 0.7 ELSE 0.6 END FROM lid
  UNION ALL SELECT observation_id, model, target, 'HIGH_VELOCITY_BURST', 0.85 FROM gid WHERE model = 'velocity_burst'),
vec AS (
  SELECT target, bool_or(mismatch_type IN ('LEDGER_UNDER_RECORDING', 'OVERPAYMENT', 'UNDERPAYMENT')) AS e1_match,
    bool_or(mismatch_type = 'ENTROPY_COLLAPSE_STRUCTURED_PATTERN') AS e2_entropy, bool_or(mismatch_type IN ('OFF_HOURS_EXECUTION', 'HIGH_VELOCITY_BURST')) AS e3_temporal, false AS e4_outlier,
    count(*) AS observations, string_agg(DISTINCT mismatch_type, ',' ORDER BY mismatch_type) AS labels FROM obs GROUP BY 1),
post AS (
  SELECT target, a, l, w, round(0.02 * a / (0.02 * a + 0.98 * l), 4) AS posterior FROM (
    SELECT target, (CASE WHEN e1_match THEN 0.85 ELSE 1.0 - 0.85 END)::DOUBLE * (CASE WHEN e2_entropy THEN 0.70 ELSE 1.0 - 0.70 END)::DOUBLE
        * (CASE WHEN e3_temporal THEN 0.65 ELSE 1.0 - 0.65 END)::DOUBLE * (1.0 - 0.80)::DOUBLE AS a,
      (CASE WHEN e1_match THEN 0.03 ELSE 1.0 - 0.03 END)::DOUBLE * (CASE WHEN e2_entropy THEN 0.05 ELSE 1.0 - 0.05 END)::DOUBLE
        * (CASE WHEN e3_temporal THEN 0.08 ELSE 1.0 - 0.08 END)::DOUBLE * (1.0 - 0.10)::DOUBLE AS l,
      (CASE WHEN e1_match THEN 0.35 ELSE 0 END + CASE WHEN e2_entropy THEN 0.25 ELSE 0 END + CASE WHEN e3_temporal THEN 0.20 ELSE 0 END)::DOUBLE AS w
    FROM vec WHERE e1_match OR e2_entropy OR e3_temporal))
"""


def _t6(pack):
    return pack.heads.select("observation_id", "rule_or_model", st.target_of().alias("target"), "mismatch_type", "anomaly_score")


def _facts(pack):
    """Facts one per row; what reads as a number is compared as one."""
    rows = pack.heads.select("observation_id", F.explode(F.from_json("facts", "map<string,string>")).alias("fact", "value"))
    number = F.expr("try_cast(value AS double)")
    return rows.select("observation_id", "fact", number.alias("number"), F.when(number.isNull(), F.col("value")).alias("text"))


def _t7(pack):
    return st.evidence_vector(pack.heads).withColumn("labels", F.array_join("labels", ","))


def _t8(pack):
    out = st.naive_bayes_posterior(st.evidence_vector(pack.heads))
    return out.select("target", "posterior", "posterior_legit", "likelihood_ratio", "weighted", "difference")


def _t9(pack):
    return st.posterior_bands(st.naive_bayes_posterior(st.evidence_vector(pack.heads))).select("target", "band", "verdict")


@query("t6_run_statistical_pack")
def t6(given):
    return stored_pack(given).heads


@query("t6_records")
def t6r(given):
    return stored_pack(given).records


@query("t6_heads_four_detectors", _PACK_SQL + "SELECT * FROM obs", estate=False)
def t6h4(given):
    return _t6(four_detectors(stored_pack(given)))


@query("t6_records_four_detectors", _PACK_SQL + "SELECT * FROM rec", estate=False)
def t6r4(given):
    return four_detectors(stored_pack(given)).records


@query("t6_facts_four_detectors", _PACK_SQL + """
, b AS (SELECT observation_id, count(*) AS k, min(r.ts) AS t0, max(r.ts) AS t1, round((epoch_us(max(r.ts)) - epoch_us(min(r.ts))) / 1000000.0, 2) AS s,
    sum(CAST(ev.x AS DECIMAL(18, 2))) AS a FROM rows_ r JOIN ev ON ev.id = CAST(r.event_id AS VARCHAR) JOIN gid ON model = 'velocity_burst' AND target = r.v AND gid.burst = r.burst GROUP BY 1)
, f AS (
  SELECT observation_id, unnest(['invoiced_amount', 'paid_amount', 'ledger_amount', 'diff_payment_invoice', 'diff_ledger_payment', 'diff_ledger_invoice']) AS fact,
    unnest([invoiced_amount, paid_amount, ledger_amount, diff_payment_invoice, diff_ledger_payment, diff_ledger_invoice])::DOUBLE AS number, NULL AS text
    FROM t1 JOIN gid ON model = 'triple_reconciliation' AND target = invoice_id
  UNION ALL SELECT observation_id, unnest(['sample_size', 'unique_values', 'shannon_entropy', 'max_entropy', 'normalized_entropy', 'dominant_value', 'dominant_count', 'dominant_ratio']),
    unnest([n, vals, round(h, 4), round(log2(n), 4), nh, top.x, -top.c, round(-top.c / n, 4)]::DOUBLE[]), NULL FROM low JOIN gid ON model = 'entropy' AND target = u
  UNION ALL SELECT observation_id, unnest(['transaction_id', 'hour', 'amount']), unnest([id::DOUBLE, hour(ts)::DOUBLE, x]), NULL FROM lid
  UNION ALL SELECT observation_id, unnest(['at', 'is_night', 'is_weekend', 'reasons']), NULL, unnest([rtrim(rtrim(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.'), is_night::VARCHAR, is_weekend::VARCHAR,
    concat_ws(',', CASE WHEN is_night THEN 'night' END, CASE WHEN is_weekend THEN 'weekend' END)]) FROM lid
  UNION ALL SELECT observation_id, unnest(['transaction_count', 'duration_seconds', 'total_burst_amount']), unnest([k, s, a]::DOUBLE[]), NULL FROM b
  UNION ALL SELECT observation_id, unnest(['window_start', 'window_end']), NULL, unnest([rtrim(rtrim(strftime(t0, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.'), rtrim(rtrim(strftime(t1, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.')]) FROM b)
SELECT * FROM f""", estate=False)
def t6f4(given):
    return _facts(four_detectors(stored_pack(given)))


@query("t7_evidence_vector_with_forest")  # its earlier name
@query("t7_evidence_vector")
def t7(given):
    return _t7(stored_pack(given))


@query("t7_evidence_vector_four_detectors", _PACK_SQL + "SELECT * FROM vec", estate=False)
def t7_four(given):
    return _t7(four_detectors(stored_pack(given)))


@query("t7_provenance")
def t7p(given):
    return st.provenance(stored_pack(given))


@query("t7_provenance_four_detectors", _PACK_SQL + "SELECT DISTINCT target, kind, record_id FROM rec", estate=False)
def t7p_four(given):
    return st.provenance(four_detectors(stored_pack(given)))


@query("t8_naive_bayes_posterior_with_forest")  # its earlier name
@query("t8_naive_bayes_posterior")
def t8(given):
    return _t8(stored_pack(given))


@query("t8_naive_bayes_posterior_four_detectors", _PACK_SQL + """
SELECT target, posterior, round(1 - posterior, 4) AS posterior_legit, round(a / l, 2) AS likelihood_ratio, round(w, 4) AS weighted,
  round(posterior - round(w, 4), 4) AS difference FROM post""", estate=False)
def t8_four(given):
    return _t8(four_detectors(stored_pack(given)))


@query("t9_posterior_bands_with_forest")  # its earlier name
@query("t9_posterior_bands")
def t9(given):
    return _t9(stored_pack(given))


@query("t9_posterior_bands_four_detectors", _PACK_SQL + """
SELECT target, CASE WHEN posterior >= 0.7 THEN 'high' WHEN posterior >= 0.15 THEN 'medium' ELSE 'low' END AS band,
  CASE WHEN posterior >= 0.8 THEN 'critical' WHEN posterior >= 0.2 THEN 'review' ELSE 'discarded' END AS verdict FROM post""", estate=False)
def t9_four(given):
    return _t9(four_detectors(stored_pack(given)))


@query("t10_verify_reconciliation_claims", BOOKS_SQL + """
, cl AS (
  SELECT 'CLM-' || id AS claim_id, id AS invoice_id, CASE WHEN k % 2 = 0 THEN 'invoice_overpayment' ELSE 'invoice_underpayment' END AS claim_type,
    CASE WHEN k % 7 < 2 THEN CAST((c - c % 10) / 10 AS BIGINT) ELSE 0 END / 100.0 AS claimed, k % 3 = 0 AS narrow FROM o),
x AS (
  SELECT cl.*, i.cents AS inv, coalesce(p.c, 0) AS paid, coalesce(l.cents, 0) AS led FROM cl LEFT JOIN tinv i USING (invoice_id)
  LEFT JOIN (SELECT cl.claim_id, sum(t.cents)::BIGINT AS c FROM cl JOIN tpay t USING (invoice_id) WHERE NOT narrow OR t.payment_id LIKE '%-1' GROUP BY 1) p USING (claim_id)
  LEFT JOIN tled l USING (invoice_id)),
y AS (SELECT *, greatest(0, CASE WHEN claim_type LIKE '%overpayment%' THEN paid - coalesce(inv, 0) ELSE coalesce(inv, 0) - paid END) / 100.0 AS exposure FROM x)
SELECT claim_id, invoice_id, coalesce(inv, 0) / 100.0 AS invoice_amount, paid / 100.0 AS total_payments, led / 100.0 AS total_ledger, exposure AS calculated_exposure,
  (paid - led) / 100.0 AS ledger_discrepancy, inv IS NOT NULL AND abs(exposure - claimed) <= 0.01 AS verified,
  concat_ws('; ', CASE WHEN inv IS NULL THEN 'invoice is not in the books' END, CASE WHEN abs(exposure - claimed) > 0.01 THEN 'exposure differs from the claim' END) AS errors FROM y""", estate=False)
def t10(given):
    invoices, payments, ledger = books(given)
    key, cents = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("bigint")
    claims = given.base("orders").select(
        F.concat_ws("-", F.lit("CLM"), key.cast("string")).alias("claim_id"), key.cast("string").alias("invoice_id"),
        F.when(key % 2 == 0, "invoice_overpayment").otherwise("invoice_underpayment").alias("claim_type"),
        (F.when(key % 7 < 2, ((cents - cents % 10) / 10).cast("bigint")).otherwise(0) / 100.0).alias("claimed_exposure"))
    cited = given.base("orders").where(key % 3 == 0).select(
        F.concat_ws("-", F.lit("CLM"), key.cast("string")).alias("claim_id"), F.lit("payment").alias("kind"),
        F.concat_ws("-", F.lit("PAY"), key.cast("string"), F.lit("1")).alias("record_id"))
    return st.verify_reconciliation_claims(claims, cited, invoices, payments, ledger)


@query("t11_verify_entropy_claims", _ENTROPY_SQL + """
SELECT 'CLM-' || p_partkey AS claim_id, p_partkey AS l_partkey, sample_size, round(hh, 4) AS shannon_entropy, round(nh, 4) AS normalized_entropy,
  coalesce(nh < 0.25, false) AS verified, CASE WHEN sample_size IS NULL THEN 'no recorded transactions' WHEN nh >= 0.25 THEN 'entropy shows no collapse' END AS error
FROM part LEFT JOIN e3 ON l_partkey = p_partkey""", estate=False)
def t11(given):
    claims = given.base("part").select(F.concat_ws("-", F.lit("CLM"), F.col("p_partkey").cast("string")).alias("claim_id"), F.col("p_partkey").alias("l_partkey"))
    return st.verify_entropy_claims(claims, given.base("lineitem"), "l_returnflag", "l_partkey")
