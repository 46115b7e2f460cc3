"""Queries for result files and scores."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.operators import evaluation as ev
from auditweave.operators import findings
from auditweave.plans.case_material import all_hypotheses
from auditweave.plans.case_queries import DECLINED_SQL, OBS_SQL, _leads, declined_leads, observed
from auditweave.plans.lookup_queries import _COUNTS
from auditweave.plans.registry import query
from auditweave.session import durable, work_folder
from auditweave.sources import files
from auditweave.sources.estate import TABLES, load_estate_csv, table_counts
from auditweave.sources.projection import COMPANY_RFC

COMPANY = "RFC:" + COMPANY_RFC


def shared_folder(spark) -> str:
    """A new folder below the work folder, which every executor can reach."""
    return f"{work_folder(spark)}/files-{uuid.uuid4().hex}"


@query("s2_load_estate_csv", _COUNTS)
def s2(given):
    folder = shared_folder(given.spark)
    for name in TABLES:
        given.estate.table(name).write.option("header", True).csv(f"{folder}/{name}.csv")
    return table_counts(load_estate_csv(given.spark, folder))


def recordings(given) -> DataFrame:
    """Conversations as recorded responses: a JSON object inside text, keyed by turn."""
    body = (
        F.when(F.col("turn") % 5 == 0, F.lit('{"decision": "stop"}')).when(F.col("turn") % 5 == 1, F.lit('{"survives_challenge": true, "outcome": "x"}'))
        .when(F.col("turn") % 5 == 2, F.lit('{"outcome": "clear"}')).when(F.col("turn") % 5 == 3, F.lit('{"outcome": "legitimate_alternative"}')).otherwise(F.lit("no object"))
    )
    return given.base("conversations").select(
        F.concat(F.lit("Answer:\n"), body, F.lit("\nend")).alias("response_text"),
        F.struct(F.length("text").cast("bigint").alias("input_tokens"), F.col("turn").cast("bigint").alias("output_tokens")).alias("usage"))


_ROLES_SQL = """
SELECT CASE turn % 5 WHEN 0 THEN 'investigator' WHEN 1 THEN 'challenger' WHEN 2 THEN 'method_critic' WHEN 3 THEN 'challenger' ELSE 'unknown' END AS role,
  count(*) AS calls, sum(length(text))::BIGINT AS tokens_in, sum(turn)::BIGINT AS tokens_out FROM conversations GROUP BY 1"""


@query("s2_quoted_cells", """
SELECT rfc, 'ACME "' || legal_name || '", SA' || chr(10) || 'de CV' AS legal_name, registered_date, address, bank_clabe, category, contact_email, NULL::BIGINT AS entry_id, NULL::VARCHAR AS entry_id_unparsed FROM vendors
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN entry_id % 4 <> 1 THEN entry_id END, CASE WHEN entry_id % 4 = 1 THEN 'E-' || entry_id END FROM ledger""")
def s2q(given):
    folder, e = shared_folder(given.spark), given.estate
    changed = {
        "vendors": e.vendors.withColumn("legal_name", F.concat(F.lit('ACME "'), "legal_name", F.lit('", SA\nde CV'))),
        "ledger": e.ledger.withColumn("entry_id", F.when(F.col("entry_id") % 4 == 1, F.concat(F.lit("E-"), "entry_id")).otherwise(F.col("entry_id").cast("string"))),
    }
    for name in TABLES:
        frame = changed.get(name, e.table(name))
        frame.write.option("header", True).option("quote", '"').option("escape", '"').csv(f"{folder}/{name}.csv")
    read = load_estate_csv(given.spark, folder, multi_line=True)
    return read.vendors.unionByName(read.ledger.select("entry_id", "entry_id_unparsed"), allowMissingColumns=True)


def _log_with_broken_lines(given) -> str:
    """The recordings as a log in which a blank or a broken line follows each good one."""
    folder = shared_folder(given.spark)
    cut = F.concat(F.lit('{"response_text": "turn '), F.col("turn").cast("string"))
    broken = given.base("conversations").select(F.when(F.col("turn") % 2 == 0, "").when(F.col("turn") % 3 == 0, "[1, 2]").otherwise(cut).alias("value"))
    recordings(given).select(F.to_json(F.struct("*")).alias("value")).unionByName(broken).write.text(folder)
    return folder


@query("s4_load_recordings", _ROLES_SQL, estate=False)
def s4(given):
    return ev.recording_roles(files.load_recordings(given.spark, _log_with_broken_lines(given)))


@query("s4_broken_lines", """
SELECT CASE WHEN turn % 3 = 0 THEN '[1, 2]' ELSE '{"response_text": "turn ' || turn END AS line, count(*) AS lines FROM conversations WHERE turn % 2 <> 0 GROUP BY 1""", estate=False)
def s4b(given):
    broken = files.split_recordings(given.spark, _log_with_broken_lines(given))[1]
    return broken.groupBy("line").agg(F.count("file").alias("lines"))


@query("w7_recording_roles", _ROLES_SQL, estate=False)
def w7(given):
    return ev.recording_roles(recordings(given))


def answer_key(given) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(schemes, scheme_entities, decoys): definitive listings, and provisional ones as decoys."""
    e = given.estate
    listed = e.efos_list.where("status = 'definitivo'")
    total = e.invoices.groupBy(F.col("issuer_rfc").alias("rfc")).agg(F.sum(F.col("total").cast("decimal(18,2)")).cast("double").alias("peso_amount"))
    schemes = listed.join(total, "rfc", "left").select(F.concat(F.lit("S-"), "rfc").alias("scheme_id"), F.lit("phantom_vendor").alias("type"),
                                                       F.coalesce("peso_amount", F.lit(0.0)).alias("peso_amount"), F.lit("given").alias("difficulty"))
    entities = listed.select(F.concat(F.lit("S-"), "rfc").alias("scheme_id"), F.concat(F.lit("RFC:"), "rfc").alias("entity"))
    decoys = e.efos_list.where("status = 'presunto'").select(F.concat(F.lit("RFC:"), "rfc").alias("entity"), F.concat(F.lit("D-"), "rfc").alias("code"))
    return schemes, entities, decoys


KEY_SQL = """
, sch AS (
  SELECT 'S-' || e.rfc AS scheme_id, 'RFC:' || e.rfc AS entity, coalesce((SELECT CAST(sum(CAST(total AS DECIMAL(18,2))) AS DOUBLE) FROM invoices i WHERE i.issuer_rfc = e.rfc), 0.0) AS peso_amount
  FROM efos_list e WHERE status = 'definitivo'),
dec AS (SELECT 'RFC:' || rfc AS entity, 'D-' || rfc AS code FROM efos_list WHERE status = 'presunto')
"""
_SCORED_SQL = DECLINED_SQL + KEY_SQL + """
, acc AS (SELECT 'RFC:' || r.rfc AS entity, (SELECT CAST(sum(CAST(total AS DECIMAL(18,2))) AS DOUBLE) FROM invoices i WHERE i.issuer_rfc = r.rfc) AS amount FROM reach r WHERE r.ok)
, touched AS (SELECT entity FROM acc UNION SELECT entity FROM declined),
q AS (
  SELECT d.lead_id, d.closed_by, regexp_matches(lower(reason), 'invoice|contract|purchase order|purchase_order|ledger|bank|clabe|account|employee|vendor|efos|publication|evidence gate')
      AND len(string_split(reason, ' ')) >= 8 AS specific,
    regexp_matches(lower(reason), 'insufficient evidence|not enough evidence|no evidence|inconclusive|unclear|needs more work|cannot determine') AS gen,
    d.entity IN (SELECT entity FROM dec) AS decoy, regexp_matches(lower(reason), 'contract|purchase order|publication') AS doc, d.calls FROM declined d)
"""


@query("s7_load_answer_key", KEY_SQL + """
SELECT 'scheme' AS kind, scheme_id AS id, entity FROM sch UNION ALL SELECT 'decoy', code, entity FROM dec""")
def s7(given):
    folder = shared_folder(given.spark)
    schemes, entities, decoys = answer_key(given)
    # One document per scheme or decoy: a key may be as long as the estate.
    docs = schemes.join(entities, "scheme_id").select(
        F.lit(42).alias("seed"), F.lit(COMPANY_RFC).alias("company_rfc"),
        F.array(F.struct("scheme_id", "type", F.array("entity", F.lit(COMPANY)).alias("entities"), "peso_amount", "difficulty")).alias("schemes"))
    more = decoys.select(F.lit(42).alias("seed"), F.lit(COMPANY_RFC).alias("company_rfc"), F.array(F.struct("entity", "code")).alias("decoys"))
    docs.write.json(f"{folder}/schemes")
    more.write.json(f"{folder}/decoys")
    read_schemes, read_entities, _ = files.load_answer_key(given.spark, f"{folder}/schemes")
    _, _, read_decoys = files.load_answer_key(given.spark, f"{folder}/decoys")
    told = read_schemes.select("scheme_id").join(read_entities, "scheme_id").select(F.lit("scheme").alias("kind"), F.col("scheme_id").alias("id"), "entity")
    return told.unionByName(read_decoys.select(F.lit("decoy").alias("kind"), F.col("code").alias("id"), "entity"))


@query("w1_label_entities", OBS_SQL + KEY_SQL + """
SELECT observation_id, CASE min(CASE WHEN entity IN (SELECT entity FROM sch) THEN 1 WHEN entity IN (SELECT entity FROM dec) THEN 2 WHEN entity = 'RFC:EMP920101AB1' THEN 3 ELSE 4 END)
  WHEN 1 THEN 'SCHEME' WHEN 2 THEN 'DECOY' WHEN 3 THEN 'COMPANY' ELSE 'honest' END AS label FROM ents GROUP BY 1""")
def w1(given):
    _, entities, decoys = answer_key(given)
    return ev.label_entities(observed(given).entities, entities, decoys, COMPANY)


@query("w2_discovery_coverage", OBS_SQL + KEY_SQL + """
, sn AS (SELECT DISTINCT entity FROM ents), sig AS (SELECT scheme_id FROM sch WHERE entity IN (SELECT entity FROM sn))
SELECT 'scheme signalled' AS finding, scheme_id AS item FROM sig UNION ALL SELECT 'scheme not signalled', scheme_id FROM sch WHERE scheme_id NOT IN (SELECT scheme_id FROM sig)
UNION ALL SELECT 'expected scheme lost', scheme_id FROM sch WHERE scheme_id NOT IN (SELECT scheme_id FROM sig)
UNION ALL SELECT 'decoy fires', entity FROM dec WHERE entity IN (SELECT entity FROM sn)
UNION ALL SELECT 'malformed entity', entity FROM sn WHERE NOT starts_with(entity, 'CLABE:') AND length(entity) - length(replace(entity, ':', '')) > 1
UNION ALL SELECT 'lead without official subject', lead_id FROM leads WHERE entity IS NULL
UNION ALL SELECT 'flagged vendor without label', entity FROM sn WHERE entity IN (SELECT 'RFC:' || rfc FROM vendors) AND entity NOT IN (SELECT entity FROM sch) AND entity NOT IN (SELECT entity FROM dec)""")
def w2(given):
    schemes, entities, decoys = answer_key(given)
    obs, made = _leads(given)
    return ev.discovery_coverage(obs, made["leads"], entities, decoys, schemes.select("scheme_id"), given.estate.vendors)


def _scored(given):
    schemes, entities, decoys = answer_key(given)
    declined, _, accused = declined_leads(given)
    declined = durable(declined)
    outcomes = ev.scheme_outcomes(schemes, entities, accused, declined)
    return outcomes, accused.withColumnRenamed("claimed_amount", "peso_amount"), declined, entities, decoys


_DETECTION_SQL = """
SELECT (SELECT count(*) FROM sch) AS schemes_total, (SELECT count(*) FROM sch WHERE entity IN (SELECT entity FROM acc)) AS schemes_with_finding,
  (SELECT count(*) FROM sch WHERE entity IN (SELECT entity FROM touched)) AS schemes_signalled,
  (SELECT coalesce(round(sum(peso_amount), 2), 0) FROM sch WHERE entity IN (SELECT entity FROM acc)) AS peso_actual, (SELECT count(*) FROM acc) AS findings_total,
  (SELECT coalesce(round(sum(amount), 2), 0) FROM acc) AS peso_claimed,
  round((SELECT count(*) FROM sch WHERE entity IN (SELECT entity FROM acc)) / greatest((SELECT count(*) FROM sch), 1), 3) AS scheme_recall, true AS peso_reconciles"""


@query("w3_detection_score", _SCORED_SQL + _DETECTION_SQL)
def w3(given):
    outcomes, found, *_ = _scored(given)
    return ev.detection_score(outcomes, found)


@query("w4_safety_score", _SCORED_SQL + """
SELECT (SELECT count(*) FROM acc WHERE entity NOT IN (SELECT entity FROM sch)) AS unsupported_accusations, (SELECT count(*) FROM dec) AS decoys_total,
  (SELECT count(*) FROM dec WHERE entity IN (SELECT entity FROM acc)) AS decoys_accused, (SELECT count(*) FROM dec WHERE entity IN (SELECT entity FROM touched)) AS decoys_triggered,
  (SELECT count(*) FROM dec WHERE entity NOT IN (SELECT entity FROM touched)) AS decoys_untriggered,
  round((SELECT count(*) FROM acc WHERE entity NOT IN (SELECT entity FROM sch)) / greatest((SELECT count(*) FROM acc), 1), 3) AS false_accusation_rate""")
def w4(given):
    _, found, declined, entities, decoys = _scored(given)
    return ev.safety_score(found, declined, entities, decoys, COMPANY)


@query("w5_reason_quality", _SCORED_SQL + """
SELECT count(*) AS leads_closed, count(*) FILTER (specific) AS leads_with_specific_reason, count(*) FILTER (gen AND NOT specific) AS leads_with_generic_reason,
  count(*) FILTER (decoy AND specific) AS legitimate_alternatives_found, count(*) FILTER (decoy AND doc) AS leads_naming_clearing_document, count(*) FILTER (decoy) AS correctly_inconclusive FROM q""")
def w5(given):
    _, found, declined, _, decoys = _scored(given)
    return ev.reason_totals(ev.reason_quality(declined, decoys, found))


@query("w5_closed_by", _SCORED_SQL + "SELECT closed_by, count(*) AS leads FROM q GROUP BY 1")
def w5c(given):
    _, found, declined, _, decoys = _scored(given)
    return ev.closed_by_breakdown(ev.reason_quality(declined, decoys, found))


@query("w6_lookup_redundancy", """
WITH l AS (SELECT conv_id, count(*) AS n, count(DISTINCT role) AS u FROM conversations WHERE conv_id % 7 <> 3 GROUP BY 1)
SELECT sum(n)::BIGINT AS tool_calls_total, sum(u)::BIGINT AS tool_calls_unique, (SELECT count(DISTINCT conv_id) FROM conversations WHERE conv_id % 7 = 3) AS leads_with_no_lookup, sum(n - u)::BIGINT AS redundant_actions, round(sum(n - u) / sum(n), 3) AS redundancy_rate FROM l""", estate=False)
def w6(given):
    """A conversation is a lead and its turns are calls; every seventh lead makes none."""
    turns = given.base("conversations").select(F.col("conv_id").alias("lead_id"), F.concat(F.lit("get_"), "role").alias("action"))
    return ev.lookup_redundancy(turns.select("lead_id"), turns.where("lead_id % 7 <> 3"))


_RUNS_SQL = """
, r AS (
  SELECT 'before' AS side, category AS estate, count(*)::DOUBLE AS findings_total, sum(length(legal_name))::DOUBLE AS tool_calls_unique, min(length(rfc))::DOUBLE AS redundant_actions FROM vendors GROUP BY category
  UNION ALL SELECT 'after', category, count(*) FILTER (right(rfc, 1) <> '3'), sum(length(legal_name)) + 1, min(length(rfc)) - count(*) % 2 FROM vendors GROUP BY category),
m AS (UNPIVOT r ON findings_total, tool_calls_unique, redundant_actions INTO NAME metric VALUE v),
p AS (SELECT b.estate, b.metric, b.v AS before, a.v AS after FROM m b JOIN m a ON a.estate = b.estate AND a.metric = b.metric AND a.side = 'after' AND b.side = 'before'),
z AS (SELECT DISTINCT estate, x.metric, 0.0::DOUBLE AS before, 0.0::DOUBLE AS after FROM p, (SELECT unnest([""" + ", ".join(
    f"'{m}'" for m, _ in ev.METRICS if m not in ("findings_total", "tool_calls_unique", "redundant_actions")) + """]) AS metric) x),
y AS (SELECT * FROM p UNION ALL SELECT estate, metric, before, after FROM z),
t AS (SELECT * FROM y UNION ALL SELECT '*', metric, sum(before), sum(after) FROM y GROUP BY metric)
"""


def _runs(given) -> DataFrame:
    v = given.estate.vendors.groupBy("category")
    n = F.count(F.lit(1))
    before = v.agg(n.alias("findings_total"), F.sum(F.length("legal_name")).alias("tool_calls_unique"), F.min(F.length("rfc")).alias("redundant_actions"))
    after = v.agg(F.count(F.when(~F.col("rfc").endswith("3"), 1)).alias("findings_total"), (F.sum(F.length("legal_name")) + 1).alias("tool_calls_unique"),
                  (F.min(F.length("rfc")) - n % 2).alias("redundant_actions"))
    return before.withColumn("label", F.concat(F.lit("before-"), "category")).unionByName(after.withColumn("label", F.concat(F.lit("after-"), "category")))


@query("w8_compare_runs", _RUNS_SQL + """
SELECT estate, metric, before, after, round(after - before, 3) AS change,
  CASE WHEN abs(after - before) < 1e-9 THEN '=' WHEN (metric <> 'redundant_actions') = (after > before) THEN 'BETTER' ELSE 'WORSE' END AS mark FROM t""")
def w8(given):
    return ev.compare_runs(_runs(given))


@query("w9_run_score", _SCORED_SQL + """
, det AS (""" + _DETECTION_SQL + """)
SELECT 'given' AS label, det.*, (SELECT count(*) FROM q) AS leads_closed, (SELECT count(*) FROM q WHERE specific) AS leads_with_specific_reason,
  (SELECT sum(len(string_split(calls, ',')))::BIGINT FROM q) AS tool_calls_total, (SELECT count(*) FROM conversations) AS llm_calls,
  42::BIGINT AS estate_seed, 1.5::DOUBLE AS mxn_cost, 2.25::DOUBLE AS wall_clock_seconds,
  (SELECT string_agg(role || '=' || calls, ',' ORDER BY role) FROM (""" + _ROLES_SQL + """)) AS calls_by_role FROM det""")
def w9(given):
    outcomes, found, declined, entities, decoys = _scored(given)
    meta = found.agg(F.lit(42).alias("seed"), F.lit(0).alias("llm_calls"), F.lit(1.5).alias("mxn_cost"), F.lit(2.25).alias("wall_clock_seconds"))
    row = ev.run_score("given", outcomes, found, found, declined, entities, decoys, recordings(given), COMPANY, meta)
    row = row.withColumn("calls_by_role", F.array_join(F.transform("calls_by_role", lambda x: F.concat(x["role"], F.lit("="), x["calls"])), ","))
    return row.select("estate_seed", "mxn_cost", "wall_clock_seconds", "calls_by_role", "label", "schemes_total", "schemes_with_finding", "schemes_signalled", "peso_actual", "findings_total", "peso_claimed", "scheme_recall",
                      "peso_reconciles", "leads_closed", "leads_with_specific_reason", "tool_calls_total", "llm_calls")


@query("s6_write_results_csv", """
WITH r AS (SELECT category, count(*) AS n, count(*) FILTER (right(rfc, 1) <> '3') AS f FROM vendors GROUP BY 1)
SELECT category AS seed, n AS schemes_planted, f AS schemes_found, round(100.0 * f / n, 1)::DOUBLE AS recall_pct, 2 * n AS decoys_planted, n - f AS decoys_accused,
  round(100.0 * (n - f) / (2 * n), 1)::DOUBLE AS false_accusation_rate_pct, f * 100.25::DOUBLE AS peso_claimed, n * 100.25::DOUBLE AS peso_actual, f = n AS peso_reconciles,
  n + 1 AS llm_calls, n * 0.125::DOUBLE AS mxn_cost, n * 1.5::DOUBLE AS wall_clock_s FROM r""".replace("WITH r AS", ", r AS"))
def s6(given):
    folder = shared_folder(given.spark)
    n, f = F.col("n"), F.col("f")
    runs = given.estate.vendors.groupBy(F.col("category").alias("seed")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("rfc").endswith("3"), 1)).alias("f"))
    runs = runs.select(
        "seed", n.alias("schemes_planted"), f.alias("schemes_found"), F.round(100.0 * f / n, 1).alias("recall_pct"), (2 * n).alias("decoys_planted"),
        (n - f).alias("decoys_accused"), F.round(100.0 * (n - f) / (2 * n), 1).alias("false_accusation_rate_pct"), (f * 100.25).alias("peso_claimed"),
        (n * 100.25).alias("peso_actual"), (f == n).alias("peso_reconciles"), (n + 1).alias("llm_calls"), (n * 0.125).alias("mxn_cost"), (n * 1.5).alias("wall_clock_s"))
    files.write_results_csv(runs, folder)
    return given.spark.read.schema(runs.schema).option("header", True).csv(folder)


@query("s5_write_submission")
def s5(given):
    folder = shared_folder(given.spark)
    tables = findings.build_findings(given.estate, *all_hypotheses(given.estate))
    kept = {k: durable(tables[k]) for k in ("findings", "entities", "exhibits", "trail")}
    meta = kept["findings"].agg(F.lit(42).alias("seed"), F.lit(0).alias("llm_calls"), F.lit(0.0).alias("mxn_cost"), F.lit(0.0).alias("wall_clock_seconds"))
    files.write_submission(kept, declined_leads(given)[0], meta, folder)
    back = files.read_submission(given.spark, folder)
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("part"), "rows") for name, df in back.items()]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out
