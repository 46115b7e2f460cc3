"""Scores of a run against an answer key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave.functions.clean import money
from auditweave.operators.observations import Observations

# Fixed values.
GENERIC_MARKERS = (
    "insufficient evidence", "not enough evidence", "no evidence", "inconclusive", "unclear", "needs more work", "cannot determine",
)
# Compared with lower-case text, so the capital ones never match; kept as they are published.
SPECIFIC_MARKERS = (
    "invoice", "contract", "purchase order", "purchase_order", "ledger", "bank", "clabe", "account", "employee", "vendor", "efos",
    "publication", "evidence gate", "CTR-", "PO-", "BNK-", "RFC:", "EMP:",
)
CLEARING = r"contract|CTR-|purchase order|PO-|publication"
SPECIFIC_WORDS = 8
METRICS = (
    ("schemes_with_finding", "up"), ("peso_claimed", "up"), ("peso_actual", "up"), ("schemes_signalled", "up"), ("case_failures", "down"),
    ("unsupported_accusations", "down"), ("decoys_accused", "down"), ("findings_total", "up"), ("leads_closed", "up"),
    ("leads_with_specific_reason", "up"), ("leads_with_generic_reason", "down"), ("legitimate_alternatives_found", "up"),
    ("leads_naming_clearing_document", "up"), ("correctly_inconclusive", "up"), ("tool_calls_unique", "up"), ("redundant_actions", "down"),
    ("leads_with_no_lookup", "down"), ("llm_calls", "down"), ("mxn_cost", "down"), ("wall_clock_seconds", "down"),
)


def _n(condition: Column, name: str) -> Column:
    return F.count(F.when(condition, 1)).alias(name)


def label_entities(entities: DataFrame, scheme_entities: DataFrame, decoys: DataFrame, company: str) -> DataFrame:
    """(observation_id, label): the strongest label among an observation's entities."""
    schemes = scheme_entities.select("entity").distinct().withColumn("s", F.lit(True))
    known = decoys.select("entity").distinct().withColumn("d", F.lit(True))
    df = entities.select("observation_id", "entity").join(schemes, "entity", "left").join(known, "entity", "left")
    rank = F.when(F.col("s"), 1).when(F.col("d"), 2).when(F.col("entity") == company, 3).otherwise(4)
    least = df.groupBy("observation_id").agg(F.min(rank).alias("r"))
    label = F.when(F.col("r") == 1, "SCHEME").when(F.col("r") == 2, "DECOY").when(F.col("r") == 3, "COMPANY").otherwise("honest")
    return least.select("observation_id", label.alias("label"))


def discovery_coverage(obs: Observations, leads: DataFrame, scheme_entities: DataFrame, decoys: DataFrame, expected: DataFrame,
                       vendors: DataFrame) -> DataFrame:
    """(finding, item): what discovery reached, missed or spoilt, one row per case."""
    seen = obs.entities.select("entity").distinct()

    def row(df: DataFrame, kind: str, item: str) -> DataFrame:
        return df.select(F.lit(kind).alias("finding"), F.col(item).cast("string").alias("item"))

    signalled = scheme_entities.join(seen, "entity", "left_semi").select("scheme_id").distinct()
    silent = scheme_entities.select("scheme_id").distinct().join(signalled, "scheme_id", "left_anti")
    colons = F.length("entity") - F.length(F.replace("entity", F.lit(":"), F.lit("")))
    malformed = seen.where((colons > 1) & ~F.col("entity").startswith("CLABE:"))
    labelled = scheme_entities.select("entity").union(decoys.select("entity"))
    flagged = seen.where(F.col("entity").startswith("RFC:")).join(
        vendors.select(F.concat(F.lit("RFC:"), "rfc").alias("entity")), "entity", "left_semi")
    return reduce(DataFrame.unionByName, [
        row(signalled, "scheme signalled", "scheme_id"), row(silent, "scheme not signalled", "scheme_id"),
        row(expected.join(signalled, "scheme_id", "left_anti"), "expected scheme lost", "scheme_id"),
        row(decoys.join(seen, "entity", "left_semi"), "decoy fires", "entity"), row(malformed, "malformed entity", "entity"),
        row(leads.where("entity IS NULL"), "lead without official subject", "lead_id"),
        row(flagged.join(labelled, "entity", "left_anti"), "flagged vendor without label", "entity"),
    ])


def scheme_outcomes(schemes: DataFrame, scheme_entities: DataFrame, finding_entities: DataFrame, lead_entities: DataFrame) -> DataFrame:
    """Per scheme: was one of its entities accused, or at least looked at?"""
    accused = finding_entities.select("entity").distinct().withColumn("a", F.lit(True))
    touched = finding_entities.select("entity").union(lead_entities.select("entity")).distinct().withColumn("t", F.lit(True))
    hits = scheme_entities.join(touched, "entity", "left").join(accused, "entity", "left").groupBy("scheme_id").agg(
        F.max(F.coalesce("a", F.lit(False))).alias("has_finding"), F.max(F.coalesce("t", F.lit(False))).alias("signalled"))
    return schemes.join(hits, "scheme_id", "left").na.fill(False, ["has_finding", "signalled"])


def detection_score(outcomes: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: recall, and the claimed amount against the amount at stake in the schemes that were found."""
    hit = F.col("has_finding")
    key = outcomes.agg(
        F.count(F.lit(1)).alias("schemes_total"), _n(hit, "schemes_with_finding"), _n(F.col("signalled"), "schemes_signalled"),
        F.coalesce(F.sum(F.when(hit, money("peso_amount"))).cast("double"), F.lit(0.0)).alias("peso_actual")).withColumn("run", F.lit(1))
    claimed = findings.agg(F.count(F.lit(1)).alias("findings_total"),
                           F.coalesce(F.sum(money("peso_amount")).cast("double"), F.lit(0.0)).alias("peso_claimed")).withColumn("run", F.lit(1))
    df = key.join(claimed, "run").drop("run")
    near = F.abs(F.col("peso_claimed") - F.col("peso_actual")) <= 0.02 * F.greatest("peso_actual", F.lit(1.0))
    recall = F.round(F.col("schemes_with_finding") / F.greatest("schemes_total", F.lit(1)), 3)
    return df.withColumn("scheme_recall", recall).withColumn("peso_reconciles", F.when(F.col("schemes_with_finding") > 0, near).otherwise(True))


def unsupported_accusations(finding_entities: DataFrame, scheme_entities: DataFrame, decoys: DataFrame, company: str) -> DataFrame:
    """(entity, answer_key) for each accused entity that no scheme supports."""
    wrong = finding_entities.select("entity").distinct().where(F.col("entity") != company).join(
        scheme_entities.select("entity"), "entity", "left_anti")
    known = decoys.groupBy("entity").agg(F.min("code").alias("code"), F.lit(True).alias("d"))
    return wrong.join(known, "entity", "left").select("entity", F.when(
        F.col("d"), F.concat(F.lit("decoy "), F.coalesce("code", F.lit("?")))).otherwise("honest, unnamed").alias("answer_key"))


def safety_score(finding_entities: DataFrame, lead_entities: DataFrame, scheme_entities: DataFrame, decoys: DataFrame, company: str) -> DataFrame:
    wrong = unsupported_accusations(finding_entities, scheme_entities, decoys, company)
    accused = finding_entities.select("entity").distinct()
    touched = accused.union(lead_entities.select("entity")).distinct()
    known = decoys.select("entity").distinct()
    flags = known.join(accused.withColumn("a", F.lit(True)), "entity", "left").join(touched.withColumn("t", F.lit(True)), "entity", "left")
    one = F.lit(1).alias("run")
    parts = [
        wrong.agg(F.count(F.lit(1)).alias("unsupported_accusations")).select("*", one),
        accused.where(F.col("entity") != company).agg(F.count(F.lit(1)).alias("accused")).select("*", one),
        flags.agg(F.count(F.lit(1)).alias("decoys_total"), _n(F.col("a"), "decoys_accused"), _n(F.col("t"), "decoys_triggered")).select("*", one),
    ]
    df = reduce(lambda a, b: a.join(b, "run"), parts).drop("run")
    rate = F.round(F.col("unsupported_accusations") / F.greatest("accused", F.lit(1)), 3)
    return df.withColumn("decoys_untriggered", F.col("decoys_total") - F.col("decoys_triggered")).withColumn("false_accusation_rate", rate).drop("accused")


def _marked(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def reason_quality(leads: DataFrame, decoys: DataFrame, accused: DataFrame) -> DataFrame:
    """Per closed lead: is the reason specific, generic, and does it name the document that clears it?"""
    low = F.lower("reason")
    specific = _marked(low, SPECIFIC_MARKERS) & (F.size(F.split(F.trim("reason"), r"\s+")) >= SPECIFIC_WORDS)
    known = decoys.select("entity").distinct().withColumn("d", F.lit(True))
    named = accused.select("entity").distinct().withColumn("a", F.lit(True))
    df = leads.join(known, "entity", "left").join(named, "entity", "left").withColumn("specific", specific)
    decoy = F.coalesce("d", F.lit(False))
    return df.select(
        "lead_id", F.coalesce("closed_by", F.lit("unspecified")).alias("closed_by"), "specific", (_marked(low, GENERIC_MARKERS) & ~F.col("specific")).alias("generic"),
        (decoy & F.col("specific")).alias("alternative_found"), (decoy & low.rlike(CLEARING)).alias("names_document"),
        (decoy & F.col("a").isNull()).alias("left_alone"))


def reason_totals(quality: DataFrame) -> DataFrame:
    return quality.agg(
        F.count(F.lit(1)).alias("leads_closed"), _n(F.col("specific"), "leads_with_specific_reason"), _n(F.col("generic"), "leads_with_generic_reason"),
        _n(F.col("alternative_found"), "legitimate_alternatives_found"), _n(F.col("names_document"), "leads_naming_clearing_document"),
        _n(F.col("left_alone"), "correctly_inconclusive"))


def closed_by_breakdown(quality: DataFrame) -> DataFrame:
    return quality.groupBy("closed_by").agg(F.count(F.lit(1)).alias("leads"))


def lookup_redundancy(leads: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls in total, calls that differ within their lead, and leads without any.

    ``calls`` has (lead_id, action), one row per call.
    """
    per = calls.groupBy("lead_id", "action").agg(F.count(F.lit(1)).alias("n"))
    one = F.lit(1).alias("run")
    made = per.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("tool_calls_total"), F.count(F.lit(1)).alias("tool_calls_unique")).select("*", one)
    idle = leads.select("lead_id").distinct().join(calls.select("lead_id"), "lead_id", "left_anti").agg(
        F.count(F.lit(1)).alias("leads_with_no_lookup")).select("*", one)
    df = made.join(idle, "run").drop("run")
    extra = F.col("tool_calls_total") - F.col("tool_calls_unique")
    return df.withColumn("redundant_actions", extra).withColumn("redundancy_rate", F.round(extra / F.greatest("tool_calls_total", F.lit(1)), 3))


def recording_roles(recordings: DataFrame) -> DataFrame:
    """Responses and tokens per role, told by the keys of the JSON object inside each response."""
    body = F.regexp_extract("response_text", r"(?s)\{.*\}", 0)
    keys = F.coalesce(F.json_object_keys(body), F.array().cast("array<string>"))
    outcome = F.coalesce(F.get_json_object(body, "$.outcome"), F.lit(""))
    role = (
        F.when(F.array_contains(keys, "decision") | F.array_contains(keys, "requested_action"), "investigator")
        .when(F.array_contains(keys, "survives_challenge") | outcome.contains("legitimate_alternative"), "challenger")
        .when(F.array_contains(keys, "outcome"), "method_critic").otherwise("unknown")
    )
    zero = F.lit(0).cast("bigint")
    return recordings.groupBy(role.alias("role")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum(F.coalesce("usage.input_tokens", zero)).alias("tokens_in"),
        F.sum(F.coalesce("usage.output_tokens", zero)).alias("tokens_out"))


def compare_runs(runs: DataFrame) -> DataFrame:
    """``before-X`` against ``after-X``, metric by metric, and their sum under estate ``*``.

    ``runs`` has ``label`` and any of the metrics; all of them are compared, absent ones as 0.
    """
    zero, names = F.lit(0.0), [m for m, _ in METRICS]
    values = [(F.coalesce(F.col(m).cast("double"), zero) if m in runs.columns else zero).alias(m) for m in names]
    long = runs.select("label", *values).unpivot(["label"], names, "metric", "value")
    split = long.select(F.regexp_extract("label", "^(before|after)-(.*)$", 1).alias("side"), F.regexp_extract("label", "^(before|after)-(.*)$", 2).alias("estate"), "metric", "value")
    before = split.where("side = 'before'").select("estate", "metric", F.col("value").alias("before"))
    after = split.where("side = 'after'").select("estate", "metric", F.col("value").alias("after"))
    pairs = before.join(after, ["estate", "metric"])
    totals = pairs.groupBy("metric").agg(F.sum("before").alias("before"), F.sum("after").alias("after")).withColumn("estate", F.lit("*"))
    df = pairs.unionByName(totals)
    change = F.col("after") - F.col("before")
    up = F.col("metric").isin(*[m for m, d in METRICS if d == "up"])
    mark = F.when(F.abs(change) < 1e-9, "=").when(F.when(up, change > 0).otherwise(change < 0), "BETTER").otherwise("WORSE")
    return df.select("estate", "metric", "before", "after", F.round(change, 3).alias("change"), mark.alias("mark"))


def run_score(label: str, outcomes: DataFrame, findings: DataFrame, finding_entities: DataFrame, leads: DataFrame, scheme_entities: DataFrame,
              decoys: DataFrame, recordings: DataFrame, company: str, metadata: DataFrame | None = None) -> DataFrame:
    """All scores of one run as one row.

    ``metadata`` (one row: seed, llm_calls, mxn_cost, wall_clock_seconds) is what the run says of itself.
    Recordings are counted for ``llm_calls`` only where it names none; without metadata the costs are NULL.
    """
    lead_entities = leads.select("entity")
    # Roles are a short fixed list.
    by_role = F.array_sort(F.collect_list(F.struct("role", "calls")))
    roles = recording_roles(recordings).agg(F.sum("calls").alias("recorded"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
                                            by_role.alias("calls_by_role")).withColumn("label", F.lit(label))
    stated = {"seed": "bigint", "llm_calls": "bigint", "mxn_cost": "double", "wall_clock_seconds": "double"}
    if metadata is None:
        metadata = recordings.sparkSession.range(1)
    said = metadata.agg(*(F.max(F.col(c).cast(t) if c in metadata.columns else F.lit(None).cast(t)).alias(c) for c, t in stated.items()))
    roles = roles.join(said.withColumn("label", F.lit(label)), "label").drop("label").withColumn(
        "llm_calls", F.coalesce(F.when(F.col("llm_calls") > 0, F.col("llm_calls")), "recorded", F.lit(0))).withColumnRenamed(
        "seed", "estate_seed").drop("recorded")
    parts = [
        detection_score(outcomes, findings), safety_score(finding_entities, lead_entities, scheme_entities, decoys, company),
        reason_totals(reason_quality(leads, decoys, finding_entities)), lookup_redundancy(leads, leads.select("lead_id", F.explode("calls").alias("action"))), roles,
    ]
    keyed = [p.withColumn("label", F.lit(label)) for p in parts]
    return reduce(lambda a, b: a.join(b, "label"), keyed)
