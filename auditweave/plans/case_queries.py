"""Queries for leads, cases and evidence analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditweave.operators import cases, detectors, evidence, verify
from auditweave.operators.observations import Observations
from auditweave.plans import detector_queries as dq
from auditweave.plans.case_material import CASES_SQL, all_hypotheses
from auditweave.plans.registry import query
from auditweave.session import durable


_OBSERVED: dict[tuple[str, str], Observations] = {}


def observed(given) -> Observations:
    """Observations of every rule detector, all cycles and the order matching included.

    Written once per application, like the estate they come from.
    """
    key = (given.spark.sparkContext.applicationId, given.folder)
    if key not in _OBSERVED:
        found = detectors.run_rule_detectors(given.estate, max_spread=dq.SPREAD)
        _OBSERVED[key] = Observations(durable(found.heads), durable(found.entities), durable(found.refs))
    return _OBSERVED[key]


OBS_SQL = dq.heads_sql(dq.SPREAD) + """
, legs7 AS (SELECT observation_id, n, txn_ids, unnest(range(1, len(n) + 1)) AS i FROM d7),
ents AS (
  SELECT observation_id, 0 AS section, 'RFC:' || rfc AS entity FROM d1 UNION ALL SELECT observation_id, 1, emp_id FROM d1 UNION ALL SELECT observation_id, 2, 'CLABE:' || account FROM d1
  UNION ALL SELECT observation_id, 0, 'CLABE:' || account FROM d2 UNION ALL SELECT d2.observation_id, 1, 'RFC:' || v.rfc FROM d2 JOIN vendors v ON v.bank_clabe = d2.account
  UNION ALL SELECT observation_id, 0, 'RFC:' || rfc FROM d3
  UNION ALL SELECT observation_id, 0, 'RFC:' || rfc FROM d4 UNION ALL SELECT observation_id, 1, emp_id FROM d4
  UNION ALL SELECT observation_id, 2, 'CLABE:' || vendor_account FROM d4 UNION ALL SELECT observation_id, 3, 'CLABE:' || employee_account FROM d4
  UNION ALL SELECT observation_id, 0, 'RFC:' || issuer_rfc FROM d5 UNION ALL SELECT observation_id, 1, 'RFC:' || receiver_rfc FROM d5
  UNION ALL SELECT observation_id, min(i) - 1, o.entity FROM legs7 x JOIN owner_entities o ON o.account = x.n[x.i] GROUP BY observation_id, o.entity
  UNION ALL SELECT observation_id, 999 + i, 'CLABE:' || n[i] FROM legs7
  UNION ALL SELECT observation_id, 0, 'RFC:' || rfc FROM d8),
orefs AS (
  SELECT observation_id, 'vendors' AS source_table, rfc AS record_id, 'deterministic_tabular' AS det FROM d1 UNION ALL SELECT observation_id, 'employees', emp_id, 'deterministic_tabular' FROM d1
  UNION ALL SELECT d2.observation_id, 'vendors', v.rfc, 'deterministic_tabular' FROM d2 JOIN vendors v ON v.bank_clabe = d2.account
  UNION ALL SELECT observation_id, 'vendors', rfc, 'deterministic_tabular' FROM d3 UNION ALL SELECT observation_id, 'efos_list', rfc, 'deterministic_tabular' FROM d3
  UNION ALL SELECT observation_id, 'vendors', rfc, 'deterministic_relational' FROM d4 UNION ALL SELECT observation_id, 'employees', emp_id, 'deterministic_relational' FROM d4 UNION ALL SELECT observation_id, 'bank_txns', txn_id, 'deterministic_relational' FROM d4
  UNION ALL SELECT d5.observation_id, 'invoices', r.uuid, 'deterministic_relational' FROM d5 JOIN irow r ON r.issuer_rfc = d5.issuer_rfc AND r.receiver_rfc = d5.receiver_rfc AND r.d BETWEEN d5.start AND d5.last_day
  UNION ALL SELECT observation_id, 'bank_txns', split_part(txn_ids, ',', CAST(i AS INT)), 'deterministic_relational' FROM legs7
  UNION ALL SELECT observation_id, 'vendors', rfc, 'detect_unsupported_paid_vendor_invoices' FROM d8
  UNION ALL SELECT d8.observation_id, 'invoices', d8u.uuid, 'detect_unsupported_paid_vendor_invoices' FROM d8 JOIN d8u USING (rfc)),
own1 AS (SELECT account, min(entity) FILTER (starts_with(entity, 'RFC:')) AS v, min(entity) FILTER (starts_with(entity, 'EMP:')) AS e FROM owner_entities GROUP BY 1),
offp AS (
  SELECT observation_id, section, entity AS loc, 0 AS sub, entity FROM ents WHERE starts_with(entity, 'RFC:') OR starts_with(entity, 'EMP:')
  UNION ALL SELECT t.observation_id, t.section, t.entity, 0, o.v FROM ents t JOIN own1 o ON t.entity = 'CLABE:' || o.account WHERE o.v IS NOT NULL
  UNION ALL SELECT t.observation_id, t.section, t.entity, 1, o.e FROM ents t JOIN own1 o ON t.entity = 'CLABE:' || o.account WHERE o.e IS NOT NULL),
official AS (SELECT observation_id, entity, min(struct_pack(s := section, a := loc, u := sub)) AS place FROM offp GROUP BY 1, 2),
subj AS (SELECT o.observation_id, o.rank, o.signal, f.f.e AS subject FROM obs o JOIN (SELECT observation_id, min(struct_pack(s := section, e := entity)) AS f FROM ents GROUP BY 1) f USING (observation_id)),
leadno AS (SELECT subject, row_number() OVER (ORDER BY subject) AS lead_no FROM (SELECT DISTINCT subject FROM subj)),
mem AS (SELECT 'LEAD-' || CASE WHEN lead_no < 10000 THEN lpad(CAST(lead_no AS VARCHAR), 4, '0') ELSE CAST(lead_no AS VARCHAR) END AS lead_id, lead_no, subject, observation_id, rank, signal FROM subj JOIN leadno USING (subject)),
lent AS (SELECT m.lead_id, o.entity, min(struct_pack(r := m.rank, o := m.observation_id, p := o.place)) AS place FROM official o JOIN mem m USING (observation_id) GROUP BY 1, 2),
lsig AS (SELECT lead_id, string_agg(signal, ', ' ORDER BY signal) AS signals, sum(CASE signal WHEN 'shared_vendor_clabe' THEN 1 ELSE 2 END)::BIGINT + 3 AS questions FROM (SELECT DISTINCT lead_id, signal FROM mem) GROUP BY 1),
leads AS (
  SELECT m.lead_id, m.lead_no, m.subject, count(*) AS observation_count, any_value(s.signals) AS signals, any_value(s.questions) AS questions,
    (SELECT arg_min(l.entity, l.place) FROM lent l WHERE l.lead_id = m.lead_id) AS entity
  FROM mem m JOIN lsig s USING (lead_id) GROUP BY 1, 2, 3)
"""


@query("c1_official_entities", OBS_SQL + "SELECT observation_id, entity, place.s::INT AS section FROM official")
def c1(given):
    return cases.official_entities(observed(given), given.estate).drop("place")


def _leads(given):
    obs = observed(given)
    return obs, cases.build_leads(obs, given.estate)


@query("c2_build_leads", OBS_SQL + "SELECT lead_id, subject, entity, observation_count, signals, questions FROM leads")
def c2(given):
    leads = _leads(given)[1]["leads"]
    return leads.select("lead_id", "subject", "entity", "observation_count", F.array_join("signals", ", ").alias("signals"),
                        F.size("open_questions").cast("bigint").alias("questions"))


@query("c2_lead_entities", OBS_SQL + "SELECT lead_id, entity FROM lent")
def c2e(given):
    return _leads(given)[1]["entities"]


_CASE_SQL = OBS_SQL + """
, ev AS (SELECT replace(lead_id, 'LEAD-', 'CASE-') AS case_id, 'EV-' || m.observation_id AS evidence_id, m.observation_id, signal FROM mem m),
evr AS (SELECT ev.case_id, ev.evidence_id, r.source_table, r.record_id, r.det FROM ev JOIN orefs r USING (observation_id))
"""


def _cases(given):
    obs, made = _leads(given)
    return obs, made, cases.build_cases(made["leads"], made["members"], obs)


@query("c3_build_cases", _CASE_SQL + "SELECT case_id, evidence_id, source_table, record_id, det AS produced_by FROM evr")
def c3(given):
    return _cases(given)[2]["evidence_refs"].select("case_id", "evidence_id", "source_table", "record_id", "produced_by")


@query("c3_case_problems", OBS_SQL + """
SELECT NULL AS lead_id, observation_id, 'observation id repeats' AS problem FROM obs WHERE right(observation_id, 1) IN ('3', 'C')
UNION ALL SELECT lead_id, observation_id, 'lead cites a missing observation' FROM mem WHERE right(observation_id, 1) = '7'""")
def c3p(given):
    """Sound observations have no problem, so some heads are written twice and some are lost on the way to the cases."""
    obs, made = _leads(given)
    last = F.substring("observation_id", -1, 1)
    heads = obs.heads.where(last != "7")
    faulty = Observations(heads.unionByName(heads.where(last.isin("3", "C"))), obs.entities, obs.refs)
    return cases.build_cases(made["leads"], made["members"], faulty)["problems"]


@query("c3_sound_case_problems", "SELECT '' AS lead_id, '' AS observation_id, '' AS problem WHERE false")
def c3s(given):
    return _cases(given)[2]["problems"]


@query("c4_select_cases", OBS_SQL + "SELECT lead_id, subject FROM leads WHERE lead_no <= 25")
def c4(given):
    return cases.select_cases(_leads(given)[1]["leads"], 25).select("lead_id", "subject")


_HYP_SQL = """
, oldh AS (SELECT conv_id AS case_id, 'H' || min(turn) AS hypothesis_id, 'open' AS status FROM conversations GROUP BY conv_id, role),
newh AS (SELECT conv_id AS case_id, 'H' || turn AS hypothesis_id, CASE WHEN turn % 2 = 0 THEN 'supported' ELSE 'rejected' END AS status FROM conversations WHERE length(text) % 3 <> 0),
oldc AS (SELECT case_id, hypothesis_id, 'supporting' AS side, 'E' || t.turn AS evidence_id, t.turn AS seq FROM oldh h JOIN conversations t ON t.conv_id = h.case_id WHERE length(t.text) % 2 = 0),
newc AS (SELECT case_id, hypothesis_id, CASE WHEN t.turn % 3 = 0 THEN 'counter' ELSE 'supporting' END AS side, 'E' || t.turn AS evidence_id, t.turn AS seq FROM newh h JOIN conversations t ON t.conv_id = h.case_id),
kept AS (SELECT case_id, hypothesis_id, coalesce(n.status, o.status) AS status FROM oldh o FULL JOIN newh n USING (case_id, hypothesis_id)),
cites AS (SELECT case_id, hypothesis_id, side, evidence_id, min(struct_pack(age := age, seq := seq)) AS p FROM (SELECT *, 0 AS age FROM oldc UNION ALL SELECT *, 1 FROM newc) GROUP BY 1, 2, 3, 4)
"""


def _hypotheses(given):
    talk = given.base("conversations").withColumnRenamed("conv_id", "case_id")
    old = talk.groupBy("case_id", "role").agg(F.min("turn").alias("t")).select(
        "case_id", F.concat(F.lit("H"), F.col("t").cast("string")).alias("hypothesis_id"), F.lit("open").alias("status"))
    new = talk.where(F.length("text") % 3 != 0).select(
        "case_id", F.concat(F.lit("H"), F.col("turn").cast("string")).alias("hypothesis_id"),
        F.when(F.col("turn") % 2 == 0, "supported").otherwise("rejected").alias("status"))
    items = talk.select("case_id", F.concat(F.lit("E"), F.col("turn").cast("string")).alias("evidence_id"), F.col("turn").alias("seq"), F.length("text").alias("n"))
    old_c = old.join(items.where("n % 2 = 0"), "case_id").select("case_id", "hypothesis_id", F.lit("supporting").alias("side"), "evidence_id", "seq")
    new_c = new.join(items, "case_id").select(
        "case_id", "hypothesis_id", F.when(F.col("seq") % 3 == 0, "counter").otherwise("supporting").alias("side"), "evidence_id", "seq")
    return cases.merge_hypotheses(old, new, old_c, new_c), items


@query("c5_merge_hypotheses", _HYP_SQL + "SELECT case_id, hypothesis_id, status FROM kept")
def c5(given):
    return _hypotheses(given)[0][0]


@query("c5_merged_evidence", _HYP_SQL + "SELECT case_id, hypothesis_id, side, evidence_id, p.age AS age, p.seq AS seq FROM cites")
def c5e(given):
    return _hypotheses(given)[0][1]


@query("c6_attach_evidence", _HYP_SQL + """
SELECT k.case_id, k.hypothesis_id, 'E' || t.turn AS evidence_id FROM kept k JOIN conversations t ON t.conv_id = k.case_id
WHERE k.status IN ('open', 'supported') AND NOT EXISTS (SELECT 1 FROM cites c WHERE c.case_id = k.case_id AND c.hypothesis_id = k.hypothesis_id AND c.side = 'counter' AND c.evidence_id = 'E' || t.turn)
UNION SELECT case_id, hypothesis_id, evidence_id FROM cites WHERE side = 'supporting'""")
def c6(given):
    (kept, cites), items = _hypotheses(given)
    return cases.attach_evidence(kept, cites, items)


@query("c6_set_references", _HYP_SQL + "SELECT case_id, hypothesis_id FROM kept WHERE status IN ('open', 'supported')")
def c6r(given):
    (kept, cites), items = _hypotheses(given)
    return cases.evidence_by_set(kept, cites, items)[0]


@query("c6_set_exceptions", _HYP_SQL + """
, sides AS (SELECT case_id, hypothesis_id, evidence_id, bool_or(side = 'counter') AS against, bool_or(side = 'supporting') AS backed FROM cites GROUP BY 1, 2, 3),
told AS (SELECT s.*, EXISTS (SELECT 1 FROM kept k WHERE k.case_id = s.case_id AND k.hypothesis_id = s.hypothesis_id AND k.status IN ('open', 'supported'))
    AND EXISTS (SELECT 1 FROM conversations t WHERE t.conv_id = s.case_id AND 'E' || t.turn = s.evidence_id) AS covered FROM sides s)
SELECT case_id, hypothesis_id, evidence_id, CASE WHEN backed THEN 'added' ELSE 'excluded' END AS kind FROM told WHERE (covered AND against AND NOT backed) OR (backed AND NOT covered)""")
def c6x(given):
    (kept, cites), items = _hypotheses(given)
    return cases.evidence_by_set(kept, cites, items)[1]


ACTIONS_SQL = """
, act AS (SELECT conv_id AS case_id, turn AS step, 'get_' || role AS action_name, CAST(length(text) % 4 AS VARCHAR) AS n, role, turn % 5 <> 3 AS success, length(text) % 3 AS produced FROM conversations)
"""


def actions_of(given):
    size = F.length("text")
    return given.base("conversations").select(
        F.col("conv_id").alias("case_id"), F.col("turn").alias("step"), F.concat(F.lit("get_"), "role").alias("action_name"),
        F.when(F.col("turn") % 2 == 0, F.create_map(F.lit("n"), (size % 4).cast("string"), F.lit("k"), F.col("role"))).otherwise(
            F.create_map(F.lit("k"), F.col("role"), F.lit("n"), (size % 4).cast("string"))).alias("arguments"),
        (F.col("turn") % 5 != 3).alias("success"), (size % 3).alias("produced"))


@query("c7_repeated_actions", ACTIONS_SQL + """
, f AS (SELECT *, min(step) OVER (PARTITION BY case_id, action_name, n) AS first_step FROM act)
SELECT case_id, step, action_name, first_step FROM f WHERE step > first_step""")
def c7(given):
    return cases.repeated_actions(actions_of(given))


_COVER_SQL = """
, cov AS (
  SELECT x.entity, CASE WHEN starts_with(x.entity, 'EMP:') THEN CASE WHEN e.emp_id IS NOT NULL THEN 'Employee ' || x.entity || ' (' || e.role || ') is on record.' ELSE 'No employee record for ' || x.entity || ' was found.' END
    WHEN v.rfc IS NULL THEN 'No vendor record for ' || substr(x.entity, 5) || ' was found.'
    ELSE 'Read ' || (SELECT count(*) FROM invoices i WHERE i.issuer_rfc = v.rfc) || ' invoice(s), ' || (SELECT count(*) FROM purchase_orders p WHERE p.vendor_rfc = v.rfc) || ' purchase order(s), '
      || (SELECT count(*) FROM contracts c WHERE c.vendor_rfc = v.rfc) || ' contract(s) for ' || v.rfc || ' (' || v.legal_name || ').'
      || coalesce((SELECT ' Contract ' || c.contract_id || ' states: ' || c.scope_text FROM contracts c WHERE c.vendor_rfc = v.rfc), ' No contract is on record; that is a missing record and does not show that none exists.') END AS coverage,
    CASE WHEN starts_with(x.entity, 'EMP:') THEN 'get_employee' WHEN v.rfc IS NULL THEN 'get_vendor' ELSE 'get_vendor,get_vendor_contracts,get_vendor_purchase_orders,get_vendor_invoices' END AS calls
  FROM (SELECT DISTINCT entity FROM lent) x LEFT JOIN vendors v ON x.entity = 'RFC:' || v.rfc LEFT JOIN employees e ON e.emp_id = x.entity)
"""


@query("c8_entity_coverage", OBS_SQL + _COVER_SQL + "SELECT * FROM cov")
def c8(given):
    out = cases.entity_coverage(given.estate, durable(_leads(given)[1]["entities"]))
    return out.select("entity", "coverage", F.array_join("calls", ",").alias("calls"))


@query("c9_unmet_check_detail", CASES_SQL + """
, un AS (
  SELECT c.hypothesis_id, c.check_id || ' (' || c.status || '): ' || CASE c.check_id WHEN 'PHANTOM-EFOS-INVOICE-LINK' THEN t.reason WHEN 'KICKBACK-VENDOR-EMPLOYEE-LINK' THEN l.reason
    WHEN 'SCHEME-SUBSTANTIVE-VERIFICATION' THEN 'no verifier for this scheme' ELSE 'no claimed amount' END AS x
  FROM checks c LEFT JOIN timing t USING (hypothesis_id) LEFT JOIN link l USING (hypothesis_id) WHERE c.status = 'unresolved')
SELECT hypothesis_id, 'Unmet critical check(s): ' || string_agg(x, ' | ' ORDER BY x) AS detail FROM un GROUP BY 1""")
def c9(given):
    hyp, cites, _ = all_hypotheses(given.estate)
    return cases.unmet_check_detail(verify.verification_report(given.estate, hyp, cites).checks)


DECLINED_SQL = OBS_SQL + _COVER_SQL + """
, reach AS (SELECT e.rfc, bool_or(e.status = 'definitivo' AND i.issue_date >= e.publication_date) AND count(*) >= 2 AS ok FROM efos_list e JOIN invoices i ON i.issuer_rfc = e.rfc GROUP BY 1),
declined AS (
  SELECT l.lead_id, l.entity, l.signals AS signal, c.coverage || ' ' || CASE WHEN r.rfc IS NOT NULL THEN 'Listing sweep: inconclusive.' ELSE 'No verifier can confirm this pattern, so nobody is accused.' END AS reason,
    c.calls, CASE WHEN r.rfc IS NOT NULL THEN 'validator' ELSE 'investigator' END AS closed_by
  FROM leads l JOIN cov c USING (entity) LEFT JOIN reach r ON l.entity = 'RFC:' || r.rfc WHERE NOT coalesce(r.ok, false))
"""


def declined_leads(given):
    """(declined, dropped, findings) of the sweep and of all other leads."""
    sweep = durable(verify.efos_authorisation_sweep(given.estate))
    entity = F.concat(F.lit("RFC:"), F.regexp_extract("hypothesis_id", "^sweep-(.*)-H1$", 1)).alias("entity")
    accused = sweep.where("outcome = 'authorize_probable'").select(entity, "claimed_amount", "hypothesis_id")
    refusals = sweep.where("outcome <> 'authorize_probable'").select(entity, F.format_string("Listing sweep: %s.", "outcome").alias("refusal"))
    leads = durable(_leads(given)[1]["leads"])
    declined, dropped = cases.leads_not_pursued(given.estate, leads, accused, refusals)
    return declined, dropped, accused


@query("c10_leads_not_pursued", DECLINED_SQL + "SELECT * FROM declined")
def c10(given):
    return declined_leads(given)[0].withColumn("calls", F.array_join("calls", ","))


@query("c10_reviewed_evidence", _CASE_SQL + """
, lab AS (SELECT DISTINCT case_id, source_table || '.' || record_id AS label FROM evr),
nth AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY label) AS i, count(*) OVER (PARTITION BY case_id) AS records FROM lab)
SELECT case_id, 'reviewed ' || string_agg(label, ', ' ORDER BY i) || CASE WHEN records > 6 THEN ' (+' || (records - 6) || ' more)' ELSE '' END AS summary, records
FROM nth WHERE i <= 6 GROUP BY case_id, records""")
def c10r(given):
    return cases.reviewed_evidence(_cases(given)[2]["evidence_refs"])


@query("c10_closed_by", OBS_SQL + """
, o AS (SELECT lead_id AS case_id, CASE lead_no % 3 WHEN 0 THEN 'ready' WHEN 1 THEN 'blocked' ELSE 'error' END AS status, lead_no % 5 = 0 AS declined,
  CASE lead_no % 4 WHEN 0 THEN 'investigator_stop' WHEN 1 THEN 'review_blocked' WHEN 2 THEN 'budget' END AS stop_reason FROM leads)
SELECT case_id, CASE WHEN status = 'error' THEN NULL WHEN declined THEN 'validator' WHEN stop_reason = 'review_blocked' THEN 'challenger' ELSE 'investigator' END AS closed_by FROM o""")
def c10b(given):
    n = F.col("lead_no")
    outcomes = _leads(given)[1]["leads"].select(
        F.col("lead_id").alias("case_id"), F.when(n % 3 == 0, "ready").when(n % 3 == 1, "blocked").otherwise("error").alias("status"), (n % 5 == 0).alias("gate_declined"),
        F.when(n % 4 == 0, "investigator_stop").when(n % 4 == 1, "review_blocked").when(n % 4 == 2, "budget").alias("stop_reason"))
    return cases.closed_by(outcomes).select("case_id", "closed_by")


@query("c11_run_counters", OBS_SQL + """
, st AS (SELECT CASE lead_no % 3 WHEN 0 THEN 'ready' WHEN 1 THEN 'blocked' ELSE 'error' END AS s FROM leads)
SELECT 'observations' AS counter, (SELECT count(*) FROM obs) AS value UNION ALL SELECT 'leads', count(*) FROM leads UNION ALL SELECT 'processed', count(*) FROM st
UNION ALL SELECT 'ready', count(*) FROM st WHERE s = 'ready' UNION ALL SELECT 'blocked', count(*) FROM st WHERE s = 'blocked' UNION ALL SELECT 'error', count(*) FROM st WHERE s = 'error'""")
def c11(given):
    obs, made = _leads(given)
    leads = durable(made["leads"])
    status = F.when(F.col("lead_no") % 3 == 0, "ready").when(F.col("lead_no") % 3 == 1, "blocked").otherwise("error")
    return cases.run_counters(obs, leads, leads.select(F.col("lead_id").alias("case_id"), status.alias("status")))


@query("v1_evidence_independence", _CASE_SQL + """
SELECT case_id, count(DISTINCT source_table || '.' || record_id) AS distinct_records, count(DISTINCT evidence_id) AS evidence_items FROM evr GROUP BY 1""")
def v1(given):
    return evidence.evidence_independence(durable(_cases(given)[2]["evidence_refs"]))[0]


@query("v1_shared_records", _CASE_SQL + """
SELECT case_id, source_table, record_id, count(DISTINCT evidence_id) AS evidence_count, min(evidence_id) AS first_evidence, string_agg(DISTINCT det, ',' ORDER BY det) AS detectors
FROM evr GROUP BY 1, 2, 3 HAVING count(DISTINCT evidence_id) > 1 OR count(DISTINCT det) > 1""")
def v1s(given):
    shared = evidence.evidence_independence(_cases(given)[2]["evidence_refs"])[1]
    return shared.withColumn("detectors", F.array_join("detectors", ","))


@query("v2_evidence_dependencies", _CASE_SQL + """
, s AS (SELECT case_id, source_table || '.' || record_id AS r, list(DISTINCT evidence_id ORDER BY evidence_id) AS ids FROM evr GROUP BY 1, 2 HAVING count(DISTINCT evidence_id) > 1)
SELECT case_id, len(ids) AS items, ids[1] AS first_item, ids[-1] AS last_item, count(*) AS shared_records, min(r) AS first_record FROM s GROUP BY case_id, ids""")
def v2(given):
    groups, _ = evidence.evidence_dependencies(_cases(given)[2]["evidence_refs"])
    return groups.drop("d1", "d2")


_SETS_SQL = _CASE_SQL + f"""
, once AS (SELECT DISTINCT case_id, source_table, record_id, evidence_id FROM evr),
held AS (SELECT case_id, source_table, record_id, list(evidence_id ORDER BY evidence_id) AS ids, {dq.sql_digest('evidence_id')} AS digest FROM once GROUP BY 1, 2, 3 HAVING count(*) > 1),
named AS (SELECT *, {dq.sql_id('SET', 'EVIDENCE', "case_id || '|' || len(ids) || '|' || digest")} AS set_id FROM held)
"""


@query("v2_set_items", _SETS_SQL + "SELECT case_id, set_id, unnest(ids) AS evidence_id FROM (SELECT DISTINCT case_id, set_id, ids FROM named)")
def v2i(given):
    return evidence.dependency_sets(_cases(given)[2]["evidence_refs"])[1]


@query("v2_set_records", _SETS_SQL + """
SELECT n.case_id, n.set_id, n.source_table, n.record_id, len(n.ids) AS items, count(*) OVER (PARTITION BY n.case_id, n.ids) AS shared_records FROM named n""")
def v2r(given):
    sets, _, records = evidence.dependency_sets(_cases(given)[2]["evidence_refs"])
    return records.join(sets, ["case_id", "set_id"])


@query("v3_absence_claims", ACTIONS_SQL + """
SELECT case_id, step, action_name, CASE WHEN success THEN 'no record in the supplied books' ELSE 'the lookup did not run' END AS conclusion
FROM act WHERE NOT success OR produced = 0""")
def v3(given):
    return evidence.absence_claims(actions_of(given))


@query("v4_cycle_continuity", dq.D7_SQL + """
SELECT observation_id, len(amounts)::BIGINT AS legs, CASE WHEN list_min(amounts) > 0 THEN round(list_max(amounts) / list_min(amounts), 4) END AS largest_to_smallest,
  CASE WHEN list_min(amounts) > 0 THEN round((list_max(amounts) - list_min(amounts)) / list_max(amounts), 4) END AS relative_spread, span::BIGINT AS date_span_days FROM d7""")
def v4(given):
    cycles, _ = detectors.bank_cycle_observation(given.estate, max_cycles=None)
    return evidence.cycle_continuity(cycles).drop("amounts").withColumn("date_span_days", F.col("date_span_days").cast("bigint"))


@query("v5_shared_identifier_claims", dq.D1_SQL + dq.D2_SQL + dq.D4_SQL + """
SELECT observation_id, 'vendor_employee_shared_clabe' AS signal_type, EXISTS (SELECT 1 FROM d4 WHERE d4.rfc = d1.rfc AND d4.emp_id = d1.emp_id) AS transfer_observed FROM d1
UNION ALL SELECT observation_id, 'shared_vendor_clabe', false FROM d2""")
def v5(given):
    e = given.estate
    return evidence.shared_identifier_claims(detectors.vendor_employee_shared_account(e), detectors.shared_vendor_account(e)[0],
                                             detectors.vendor_to_employee_transfer(e))


def _scored(given):
    """Scored heads: one per weekend or night event; the weekend ones declare what the score means."""
    from auditweave.operators.statistics import off_hours
    from auditweave.plans.statistics_queries import transactions

    rows = off_hours(transactions(given))
    return rows.select(F.concat(F.lit("OBS-"), F.col("transaction_id").cast("string")).alias("observation_id"), F.lit("off_hours").alias("detector_name"),
                       "score", F.when(F.col("is_weekend"), F.lit("fixed weight of the rule")).otherwise(F.lit(" ")).alias("score_semantics"))


@query("v6_score_semantics_audit", """
WITH e AS (SELECT event_id, hour(ts) >= 23 OR hour(ts) < 5 AS n, isodow(ts) >= 6 AS w FROM events)
SELECT 'OBS-' || event_id AS observation_id, 'off_hours' AS detector_name, CASE WHEN n AND w THEN 0.8 WHEN n THEN 0.7 ELSE 0.6 END::DOUBLE AS score, w AS semantics_declared
FROM e WHERE n OR w""", estate=False)
def v6(given):
    return evidence.score_semantics_audit(_scored(given))


@query("v7_declared_alternatives", OBS_SQL + "SELECT observation_id, signal AS signal_type, CASE signal WHEN 'shared_vendor_clabe' THEN 1 ELSE 2 END::BIGINT AS checks FROM obs")
def v7(given):
    told = evidence.declared_alternatives(observed(given).heads)
    return told.select("observation_id", "signal_type", F.size("recommended_checks").cast("bigint").alias("checks"))


@query("v8_case_briefing")
def v8(given):
    e = given.estate
    obs, _, made = _cases(given)
    independence, _ = evidence.evidence_independence(durable(made["evidence_refs"]))
    members = made["evidence"].select("case_id", "observation_id")
    absences = evidence.absence_claims(actions_of(given)).withColumn("case_id", F.format_string("CASE-%04d", F.col("case_id") + 1))
    cycles = evidence.cycle_continuity(detectors.bank_cycle_observation(e, max_cycles=None)[0])
    shared = evidence.shared_identifier_claims(detectors.vendor_employee_shared_account(e), detectors.shared_vendor_account(e)[0],
                                               detectors.vendor_to_employee_transfer(e))
    out = evidence.case_briefing(independence, absences, members, cycles, shared, evidence.score_semantics_audit(obs.heads))
    return out.select("case_id", F.to_json(F.struct("independence", "absence", "continuity", "identifiers", "scores")).alias("briefing"))


@query("v9_record_consumers", dq.D1_SQL + dq.D2_SQL + dq.CYCLES_SQL + """
, u AS (
  SELECT 'vendors' AS t, rfc AS r, 'graph' AS a FROM vendors UNION SELECT 'vendors', rfc, 'efos_match' FROM vendors WHERE rfc IN (SELECT rfc FROM efos_list)
  UNION SELECT 'vendors', rfc, 'efos_timing' FROM vendors WHERE rfc IN (SELECT rfc FROM efos_list) UNION SELECT 'vendors', rfc, 'shared_account' FROM d1
  UNION SELECT 'vendors', rfc, 'shared_vendor_account' FROM vendors WHERE bank_clabe IN (SELECT account FROM d2)
  UNION SELECT 'employees', emp_id, 'graph' FROM employees UNION SELECT 'employees', emp_id, x FROM employees, (VALUES ('shared_account'), ('employee_transfer')) v(x) WHERE bank_clabe IN (SELECT bank_clabe FROM vendors)
  UNION SELECT 'bank_txns', txn_id, x FROM bank_txns, (VALUES ('transfer_multigraph'), ('graph')) v(x)
  UNION SELECT 'bank_txns', txn_id, 'employee_transfer' FROM bank_txns WHERE from_clabe IN (SELECT bank_clabe FROM vendors) AND to_clabe IN (SELECT bank_clabe FROM employees)
  UNION SELECT 'bank_txns', txn_id, 'cycles' FROM bank_txns WHERE EXISTS (SELECT 1 FROM legs l WHERE l.src = from_clabe AND l.dst = to_clabe)
  UNION SELECT 'invoices', uuid, 'invoice_cluster' FROM invoices UNION SELECT 'invoices', uuid, x FROM invoices, (VALUES ('efos_timing'), ('reconciliation')) v(x) WHERE issuer_rfc IN (SELECT rfc FROM efos_list))
SELECT t AS source_table, r AS record_id, string_agg(a, ',' ORDER BY a) AS analyses FROM u GROUP BY 1, 2 HAVING count(*) >= 3""")
def v9(given):
    return evidence.record_consumers(given.estate).withColumn("analyses", F.array_join("analyses", ","))


@query("v10_same_money_groups", """
, l AS (SELECT invoice_uuid, count(*) AS n, CAST(sum(CAST(debit AS DECIMAL(18,2))) AS DOUBLE) AS d FROM ledger GROUP BY 1),
b AS (SELECT right(reference, 8) AS k, count(*) AS n, min(txn_id) AS t FROM bank_txns GROUP BY 1)
SELECT i.uuid, i.total, coalesce(l.n, 0) AS ledger_rows, l.d AS ledger_debit, coalesce(b.n, 0) AS transfers, b.t AS first_txn_id
FROM invoices i LEFT JOIN l ON l.invoice_uuid = i.uuid LEFT JOIN b ON b.k = substr(i.uuid, 1, 8) WHERE l.n > 0 OR b.n > 0""")
def v10(given):
    return evidence.same_money_groups(given.estate)
