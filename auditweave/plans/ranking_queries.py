"""Queries for the peer ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.operators import graph, ranking
from auditweave.operators.ranking import NODE
from auditweave.plans.graph_queries import FEATURES_SQL, SCALED_SQL
from auditweave.plans.registry import query
from auditweave.session import durable


def _scaled(given) -> DataFrame:
    return graph.robust_peer_scale(graph.long_features(graph.node_features(given.estate)))


def _values(given) -> DataFrame:
    return durable(_scaled(given)).select(*NODE, "feature", F.col("scaled").alias("value"))


def _arcs(given) -> DataFrame:
    return graph.transfer_edges(given.estate.bank_txns).select("src", "dst").distinct()


_REL_SQL = """
, rel AS (
  SELECT DISTINCT 'owns' AS relation, 'vendor' AS st, rfc AS s, 'account' AS dt, bank_clabe AS d FROM vendors UNION ALL SELECT DISTINCT 'owned_by', 'account', bank_clabe, 'vendor', rfc FROM vendors
  UNION ALL SELECT DISTINCT 'owns', 'employee', emp_id, 'account', bank_clabe FROM employees UNION ALL SELECT DISTINCT 'owned_by', 'account', bank_clabe, 'employee', emp_id FROM employees
  UNION ALL SELECT DISTINCT 'transfers', 'account', from_clabe, 'account', to_clabe FROM bank_txns)
"""


@query("a1_neighbour_means", SCALED_SQL + _REL_SQL + """
SELECT r.dt AS node_type, r.d AS entity_id, r.relation || '/' || r.st || '/' || x.feature AS feature, round(avg(x.scaled), 3) AS value
FROM rel r JOIN scaled x ON x.node_type = r.st AND x.entity_id = r.s GROUP BY 1, 2, 3""")
def a1(given):
    means = ranking.neighbour_means(_values(given), ranking.relations(given.estate))
    return means.withColumn("value", F.round("value", 3))


_ATTRIBUTES = ("transfer_count", "total_amount", "mean_amount", "max_abs_amount", "span_days")


@query("a1_neighbour_means_two_hops", SCALED_SQL + _REL_SQL + f"""
, arcs AS (
  SELECT from_clabe AS src, to_clabe AS dst, count(*)::DOUBLE AS transfer_count, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total_amount,
    CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean_amount, max(abs(amount)) AS max_abs_amount,
    (max(CAST(date AS DATE)) - min(CAST(date AS DATE)))::DOUBLE AS span_days FROM bank_txns GROUP BY 1, 2),
attr AS (SELECT dst, unnest([{', '.join(f"'{a}'" for a in _ATTRIBUTES)}]) AS feature, unnest([{', '.join(f'sign({a}) * ln(1 + abs({a}))' for a in _ATTRIBUTES)}]) AS v FROM arcs),
h1 AS (
  SELECT node_type, entity_id, feature, avg(v) AS v FROM (
    SELECT r.dt AS node_type, r.d AS entity_id, r.relation || '/' || r.st || '/' || x.feature AS feature, x.scaled AS v FROM rel r JOIN scaled x ON x.node_type = r.st AND x.entity_id = r.s
    UNION ALL SELECT 'account', dst, 'transfers/edge/' || feature, v FROM attr) GROUP BY 1, 2, 3),
h2 AS (SELECT r.dt AS node_type, r.d AS entity_id, r.relation || '/' || r.st || '/' || h.feature AS feature, avg(h.v) AS v FROM rel r JOIN h1 h ON h.node_type = r.st AND h.entity_id = r.s GROUP BY 1, 2, 3)
SELECT node_type, entity_id, feature, round(v, 3) AS value FROM h1 UNION ALL SELECT node_type, entity_id, feature, round(v, 3) FROM h2""")
def a1b(given):
    means = ranking.neighbour_means(_values(given), durable(ranking.relations(given.estate)), hops=2, edge_values=ranking.transfer_attributes(given.estate))
    return means.withColumn("value", F.round("value", 3))


@query("a2_masked_feature_error")
def a2(given):
    values = _values(given)
    return ranking.masked_feature_error(values, durable(ranking.neighbour_means(values, ranking.relations(given.estate))))


_FRACTION = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0"


@query("a3_masking_sample", SCALED_SQL + f"""
SELECT node_type, entity_id, feature FROM long WHERE {_FRACTION.format("entity_id || '|' || feature || '|11'")} < 0.15""")
def a3(given):
    return ranking.masking_sample(graph.long_features(graph.node_features(given.estate)), 0.15, 11)


@query("a3_edge_holdout", f"""
, a AS (SELECT DISTINCT from_clabe AS src, to_clabe AS dst FROM bank_txns),
r AS (SELECT src, dst, row_number() OVER (ORDER BY {_FRACTION.format("src || '|' || dst || '|11'")}, src, dst) AS n, count(*) OVER () AS t FROM a)
SELECT src, dst FROM r WHERE n <= least(floor(t * 0.2), t - 1)""")
def a3e(given):
    return ranking.edge_holdout(durable(_arcs(given)), 0.2, 11)


@query("a4_negative_edges")
def a4(given):
    arcs = durable(_arcs(given))
    return ranking.negative_edges(graph.transfer_nodes(arcs), arcs, 500, 11)


@query("a5_edge_surprise")
def a5(given):
    return ranking.edge_surprise(_values(given), durable(_arcs(given)))[0]


_NODE_SQL = FEATURES_SQL + """
, val AS (
  SELECT 'vendor' AS node_type, entity_id, round(invoice_total, 2) AS x1, round(po_total, 2) AS x2, round(ledger_debit_total, 2) AS x3, NULL::DOUBLE AS ev FROM vf
  UNION ALL SELECT 'employee', entity_id, round(bank_total_in, 2), bank_txn_count_in, bank_unique_counterparties, NULL FROM ef
  UNION ALL SELECT 'account', entity_id, round(total_in, 2), round(total_out, 2), round(max_abs_amount, 2), CASE WHEN count_out > 0 THEN mean_amount_out END FROM af),
runs0 AS (SELECT 1 AS seed, node_type, entity_id, x1 AS x, ev FROM val UNION ALL SELECT 2, node_type, entity_id, x2, ev FROM val UNION ALL SELECT 3, node_type, entity_id, x3, ev FROM val),
pct AS (
  SELECT seed, node_type, entity_id, x, ev, CASE WHEN n > 1 THEN (lo + (tie - 1) / 2.0) / (n - 1) ELSE 0.5 END AS fp FROM (
    SELECT *, rank() OVER (PARTITION BY seed, node_type ORDER BY x) - 1 AS lo, count(*) OVER (PARTITION BY seed, node_type, x) AS tie, count(*) OVER (PARTITION BY seed, node_type) AS n FROM runs0)),
ept AS (
  SELECT seed, entity_id, CASE WHEN n > 1 THEN (lo + (tie - 1) / 2.0) / (n - 1) ELSE 0.5 END AS ep FROM (
    SELECT *, rank() OVER (PARTITION BY seed ORDER BY ev) - 1 AS lo, count(*) OVER (PARTITION BY seed, ev) AS tie, count(*) OVER (PARTITION BY seed) AS n
    FROM runs0 WHERE node_type = 'account' AND ev IS NOT NULL)),
runs AS (
  SELECT p.*, e.ep, CASE WHEN e.ep IS NULL THEN p.fp ELSE (p.fp + e.ep) / 2 END AS score FROM pct p LEFT JOIN ept e ON e.seed = p.seed AND e.entity_id = p.entity_id AND p.node_type = 'account'),
stable AS (
  SELECT node_type, entity_id, median(score) AS ms, quantile_cont(score, 0.75) - quantile_cont(score, 0.25) AS iqr, stddev_pop(score) AS sd, min(score) AS mn, max(score) AS mx,
    median(fp) AS mfp, median(ep) AS mep FROM runs GROUP BY 1, 2),
cand AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_type ORDER BY ms DESC, iqr, entity_id) AS rank FROM (
    SELECT *, count(*) OVER (PARTITION BY node_type) AS peers FROM stable) WHERE peers >= 5 AND ms >= 0.85 AND iqr <= 0.25) WHERE rank <= 3)
"""


def _scores(given) -> DataFrame:
    """Three plain features per node type stand in for three seeds, so SQL can follow."""
    made = graph.node_features(given.estate)
    picks = {"vendor": ("invoice_total", "po_total", "ledger_debit_total"), "employee": ("bank_total_in", "bank_txn_count_in", "bank_unique_counterparties"),
             "account": ("total_in", "total_out", "max_abs_amount")}
    edge = F.when(F.col("count_out") > 0, F.col("mean_amount_out"))
    parts = []
    for kind, names in picks.items():
        base = made[kind].select(F.lit(kind).alias("node_type"), "entity_id", *[F.round(n, 2).alias(f"x{i}") for i, n in enumerate(names)],
                                 (edge if kind == "account" else F.lit(None).cast("double")).alias("edge_value"))
        parts.append(base)
    return durable(reduce(DataFrame.unionByName, parts))


def _run(scores: DataFrame, i: int) -> DataFrame:
    return ranking.node_score(scores.select(*NODE, F.col(f"x{i}").alias("feature_value"), "edge_value")).withColumn("seed", F.lit(i + 1))


def _stable(given) -> DataFrame:
    scores = _scores(given)
    runs = reduce(DataFrame.unionByName, [_run(scores, i) for i in range(3)])
    return durable(ranking.seed_stability(runs)[0])


@query("a6_peer_percentile", _NODE_SQL + "SELECT node_type, entity_id, round(fp, 6) AS percentile FROM pct WHERE seed = 1")
def a6(given):
    out = ranking.peer_percentile(_scores(given).select(*NODE, "x0"), ["node_type"], "x0", "percentile")
    return out.select(*NODE, F.round("percentile", 6).alias("percentile"))


@query("a7_node_score", _NODE_SQL + "SELECT node_type, entity_id, round(score, 6) AS score, round(ep, 6) AS edge_percentile FROM runs WHERE seed = 1")
def a7(given):
    return _run(_scores(given), 0).select(*NODE, F.round("score", 6).alias("score"), F.round("edge_percentile", 6).alias("edge_percentile"))


@query("a8_seed_stability", _NODE_SQL + """
SELECT node_type, entity_id, round(ms, 6) AS median_score, round(iqr, 6) AS score_iqr, round(sd, 6) AS score_std, round(mn, 6) AS score_min, round(mx, 6) AS score_max,
  round(mfp, 6) AS median_feature_percentile, round(mep, 6) AS median_edge_percentile FROM stable""")
def a8(given):
    stable = _stable(given)
    return stable.select(*NODE, *[F.round(c, 6).alias(c) for c in stable.columns if c not in NODE])


@query("a9_select_candidates", _NODE_SQL + "SELECT node_type, entity_id, rank, peers AS peer_count FROM cand")
def a9(given):
    return ranking.select_candidates(_stable(given)).select(*NODE, "rank", "peer_count")


_EVIDENCE_SQL = _NODE_SQL + """
, bk AS (SELECT txn_id, amount, from_clabe AS account FROM bank_txns UNION SELECT txn_id, amount, to_clabe FROM bank_txns),
g AS (
  SELECT c.node_type, c.entity_id, 1 AS g, 'vendors' AS t, v.rfc AS r, 0.0::DOUBLE AS w FROM cand c JOIN vendors v ON c.node_type = 'vendor' AND v.rfc = c.entity_id
  UNION ALL SELECT c.node_type, c.entity_id, 2, 'efos_list', v.rfc, 0 FROM cand c JOIN efos_list v ON c.node_type = 'vendor' AND v.rfc = c.entity_id
  UNION ALL SELECT c.node_type, c.entity_id, 3, 'invoices', i.uuid, i.total FROM cand c JOIN invoices i ON c.node_type = 'vendor' AND i.issuer_rfc = c.entity_id
  UNION ALL SELECT c.node_type, c.entity_id, 4, 'purchase_orders', i.po_id, i.amount FROM cand c JOIN purchase_orders i ON c.node_type = 'vendor' AND i.vendor_rfc = c.entity_id
  UNION ALL SELECT c.node_type, c.entity_id, 5, 'contracts', i.contract_id, i.value FROM cand c JOIN contracts i ON c.node_type = 'vendor' AND i.vendor_rfc = c.entity_id
  UNION ALL SELECT c.node_type, c.entity_id, 6, 'ledger', CAST(l.entry_id AS VARCHAR), 0 FROM cand c JOIN invoices i ON c.node_type = 'vendor' AND i.issuer_rfc = c.entity_id JOIN ledger l ON l.invoice_uuid = i.uuid
  UNION ALL SELECT c.node_type, c.entity_id, 7, 'bank_txns', b.txn_id, b.amount FROM cand c JOIN vendors v ON c.node_type = 'vendor' AND v.rfc = c.entity_id JOIN bk b ON b.account = v.bank_clabe
  UNION ALL SELECT c.node_type, c.entity_id, 1, 'employees', v.emp_id, 0 FROM cand c JOIN employees v ON c.node_type = 'employee' AND v.emp_id = c.entity_id
  UNION ALL SELECT c.node_type, c.entity_id, 2, 'bank_txns', b.txn_id, b.amount FROM cand c JOIN employees v ON c.node_type = 'employee' AND v.emp_id = c.entity_id JOIN bk b ON b.account = v.bank_clabe
  UNION ALL SELECT c.node_type, c.entity_id, 1, 'vendors', v.rfc, 0 FROM cand c JOIN vendors v ON c.node_type = 'account' AND v.bank_clabe = c.entity_id
  UNION ALL SELECT c.node_type, c.entity_id, 2, 'employees', v.emp_id, 0 FROM cand c JOIN employees v ON c.node_type = 'account' AND v.bank_clabe = c.entity_id
  UNION ALL SELECT c.node_type, c.entity_id, 3, 'bank_txns', b.txn_id, b.amount FROM cand c JOIN bk b ON c.node_type = 'account' AND b.account = c.entity_id),
turn AS (SELECT *, row_number() OVER (PARTITION BY node_type, entity_id, g ORDER BY w DESC, r) AS turn FROM g),
pos AS (SELECT *, row_number() OVER (PARTITION BY node_type, entity_id ORDER BY turn, g) AS position FROM turn)
"""


@query("a10_candidate_evidence", _EVIDENCE_SQL + "SELECT node_type, entity_id, position, t AS source_table, r AS record_id FROM pos WHERE position <= 12")
def a10(given):
    return ranking.candidate_evidence(given.estate, durable(ranking.select_candidates(_stable(given))))


_CONTEXT_SQL = SCALED_SQL + _NODE_SQL[len(FEATURES_SQL):] + """
, d AS (SELECT s.*, row_number() OVER (PARTITION BY s.node_type, s.entity_id ORDER BY round(abs(s.scaled), 6) DESC, s.feature) AS rank FROM scaled s JOIN cand c USING (node_type, entity_id))
"""


@query("a11_feature_deviation_context", _CONTEXT_SQL + """
SELECT node_type, entity_id, rank, feature, round(raw_value, 2) AS raw_value, round(round(scaled, 6), 4) AS scaled FROM d WHERE rank <= 5""")
def a11(given):
    scaled = _scaled(given).withColumn("scaled", F.round("scaled", 6))
    out = ranking.feature_deviation_context(scaled, durable(ranking.select_candidates(_stable(given))))
    return out.withColumn("raw_value", F.round("raw_value", 2)).withColumn("scaled", F.round("scaled", 4))


@query("a12_ranking_observations")
def a12(given):
    runs, scaled = ranking.score_nodes(given.estate)
    stable = durable(ranking.seed_stability(runs)[0])
    return ranking.ranking_observations(given.estate, stable, scaled).heads
