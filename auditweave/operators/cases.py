"""Leads and cases from observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave.functions.clean import clean_text, clip, entity_prefix
from auditweave.operators.lookups import account_owners
from auditweave.operators.observations import SIGNALS, Observations, signal_rank
from auditweave.operators.ordering import positions
from auditweave.sources.estate import Estate

# Fixed values.
UNKNOWN = "UNKNOWN_SUBJECT"
SCOPE_CHARS, CALCULATION_CHARS, SHOWN_RECORDS = 180, 400, 6
VENDOR_CALLS = ("get_vendor", "get_vendor_contracts", "get_vendor_purchase_orders", "get_vendor_invoices")
OPEN_QUESTIONS = (
    "What lawful course of business produces these very entries?",
    "What document, once obtained, would settle which course it was?",
    "What in the books already contradicts the lead?",
)
NO_VERIFIER = "No verifier can confirm this pattern, so nobody is accused."


def official_entities(obs: Observations, estate: Estate) -> DataFrame:
    """(observation_id, section, entity): taxpayers and employees, accounts replaced by their owners.

    An account without a recorded owner is dropped; it never leaves the system.
    """
    given = obs.entities
    named = given.where(F.col("entity").rlike("^(RFC|EMP):.")).select(
        "observation_id", F.struct("section", F.col("entity").alias("at"), F.lit(0).alias("sub")).alias("place"), "entity")
    accounts = given.where(F.col("entity").startswith("CLABE:")).withColumn("account", F.trim(F.expr("substring(entity, 7)")))
    owners = F.array(F.struct(F.lit(0).alias("sub"), entity_prefix("RFC:", "vendor_rfc").alias("owner")),
                     F.struct(F.lit(1).alias("sub"), entity_prefix("EMP:", "emp_id").alias("owner")))
    resolved = accounts.join(account_owners(estate), "account").select(
        "observation_id", "section", F.col("entity").alias("at"), F.inline(owners)).where("owner IS NOT NULL").select(
        "observation_id", F.struct("section", "at", "sub").alias("place"), F.col("owner").alias("entity"))
    return named.unionByName(resolved).groupBy("observation_id", "entity").agg(F.min("place").alias("place")).select(
        "observation_id", F.col("place.section").alias("section"), "place", "entity")


def build_leads(obs: Observations, estate: Estate) -> dict[str, DataFrame]:
    """Tables ``leads``, ``members`` (lead_id, observation_id) and ``entities`` (lead_id, entity).

    Observations with the same first entity make one lead; leads are numbered in
    the order of that entity over the whole estate.
    """
    first = obs.entities.groupBy("observation_id").agg(F.min(F.struct("section", "entity")).alias("f"))
    heads = obs.heads.select("observation_id", "signal_type").join(first, "observation_id", "left").select(
        "observation_id", "signal_type", F.coalesce("f.entity", F.lit(UNKNOWN)).alias("subject"))
    numbered = positions(heads.select("subject").distinct(), [], ["subject"], "lead_no").withColumn(
        "lead_id", F.format_string("LEAD-%04d", "lead_no"))
    members = heads.join(numbered, "subject")
    place = F.struct(signal_rank().alias("rank"), F.col("observation_id").alias("obs"), "place")
    entities = official_entities(obs, estate).join(members.select("lead_id", "observation_id", "signal_type"), "observation_id").groupBy(
        "lead_id", "entity").agg(F.min(place).alias("place"))
    lead_entity = entities.groupBy("lead_id").agg(F.min_by("entity", "place").alias("entity"))
    # Signals are a short fixed list, so the set of a lead stays an array.
    leads = members.groupBy("lead_id", "lead_no", "subject").agg(
        F.count(F.lit(1)).alias("observation_count"), F.sort_array(F.collect_set("signal_type")).alias("signals"))
    leads = leads.join(lead_entity, "lead_id", "left")
    who = F.coalesce("entity", F.lit("an account without a recorded owner"))
    reason = F.format_string("%d signal(s) concern %s: %s. They are grounds to look, not an accusation.",
                             "observation_count", who, F.array_join("signals", ", "))
    return {
        "leads": leads.withColumn("reason_opened", reason).withColumn("open_questions", _questions(F.col("signals"))),
        "members": members.select("lead_id", "observation_id", "signal_type"),
        "entities": entities.select("lead_id", "entity"),
    }


def _questions(signals: Column) -> Column:
    """Checks of each signal in detector order, then the fixed questions, each once."""
    from auditweave.operators.observations import GUIDANCE

    parts = [F.when(F.array_contains(signals, s), F.array(*[F.lit(t) for t in GUIDANCE[s][2]])).otherwise(F.array().cast("array<string>"))
             for s in SIGNALS]
    return F.array_distinct(F.concat(*parts, F.array(*[F.lit(q) for q in OPEN_QUESTIONS])))


def build_cases(leads: DataFrame, members: DataFrame, obs: Observations) -> dict[str, DataFrame]:
    """Tables ``cases``, ``evidence``, ``evidence_refs`` and ``problems``.

    A duplicated observation id, or a lead that cites a missing one, is a problem row.
    """
    repeated = obs.heads.groupBy("observation_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.lit(None).cast("string").alias("lead_id"), "observation_id", F.lit("observation id repeats").alias("problem"))
    lost = members.join(obs.heads.select("observation_id"), "observation_id", "left_anti").select(
        "lead_id", "observation_id", F.lit("lead cites a missing observation").alias("problem"))
    case_id = F.regexp_replace("lead_id", "^LEAD-", "CASE-").alias("case_id")
    evidence = members.join(obs.heads, ["observation_id", "signal_type"]).select(
        case_id, F.concat(F.lit("EV-"), "observation_id").alias("evidence_id"), "observation_id", "signal_type", "statement",
        F.lit("neutral").alias("direction"), F.col("detector_name").alias("produced_by"))
    refs = evidence.select("case_id", "evidence_id", "observation_id", "produced_by").join(obs.refs, "observation_id")
    return {
        "cases": leads.select(case_id, "lead_id", "entity", F.lit("open").alias("status")),
        "evidence": evidence, "evidence_refs": refs, "problems": repeated.unionByName(lost),
    }


def select_cases(leads: DataFrame, max_cases: int) -> DataFrame:
    """The first leads in their numbered order."""
    return leads.where(F.col("lead_no") <= max_cases)


def merge_hypotheses(existing: DataFrame, incoming: DataFrame, old_cites: DataFrame, new_cites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hypotheses, citations): new text and status win; evidence is joined and never lost.

    Hypotheses are keyed by (case_id, hypothesis_id). Citations are rows
    (case_id, hypothesis_id, side, evidence_id, seq); old ones keep their place first.
    """
    key = ["case_id", "hypothesis_id"]
    fields = [c for c in incoming.columns if c not in key]
    left = existing.select(*key, F.struct(*fields).alias("old"))
    right = incoming.select(*key, F.struct(*fields).alias("new"))
    kept = left.join(right, key, "full_outer").select(*key, F.coalesce("new", "old").alias("h")).select(*key, "h.*")
    rows = old_cites.withColumn("age", F.lit(0)).unionByName(new_cites.withColumn("age", F.lit(1)))
    cites = rows.groupBy(*key, "side", "evidence_id").agg(F.min(F.struct("age", "seq")).alias("place"))
    return kept, cites.select(*key, "side", "evidence_id", F.col("place.age").alias("age"), F.col("place.seq").alias("seq"))


def evidence_by_set(hypotheses: DataFrame, citations: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(references, exceptions): what supports each hypothesis, without an item per hypothesis.

    A living hypothesis refers to all evidence of its case: one row (case_id, hypothesis_id). exceptions
    (case_id, hypothesis_id, evidence_id, kind) names what is ``excluded`` from that, being listed against it and
    not for it, and what is ``added``, being listed for it and not in what it refers to. Rows grow with hypotheses
    and citations; ``supporting_evidence`` writes the items out.
    """
    key = ["case_id", "hypothesis_id"]
    references = hypotheses.where(F.col("status").isin("open", "supported")).select(*key).distinct()
    sides = citations.where(F.col("side").isin("counter", "supporting")).groupBy(*key, "evidence_id").agg(
        F.bool_or(F.col("side") == "counter").alias("against"), F.bool_or(F.col("side") == "supporting").alias("backed"))
    offered = evidence.select("case_id", "evidence_id", F.lit(True).alias("offered")).distinct()
    told = sides.join(references.withColumn("refers", F.lit(True)), key, "left").join(offered, ["case_id", "evidence_id"], "left")
    covered = F.coalesce(F.col("refers") & F.col("offered"), F.lit(False))
    kind = F.when(covered & F.col("against") & ~F.col("backed"), "excluded").when(F.col("backed") & ~covered, "added")
    return references, told.withColumn("kind", kind).where("kind IS NOT NULL").select(*key, "evidence_id", "kind")


def supporting_evidence(references: DataFrame, exceptions: DataFrame, evidence: DataFrame) -> DataFrame:
    """(case_id, hypothesis_id, evidence_id): the references written out."""
    key = ["case_id", "hypothesis_id", "evidence_id"]
    offered = references.join(evidence.select("case_id", "evidence_id").distinct(), "case_id").select(*key)
    return offered.join(exceptions.where("kind = 'excluded'"), key, "left_anti").unionByName(exceptions.where("kind = 'added'").select(*key))


def attach_evidence(hypotheses: DataFrame, citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every item of a case supports each living hypothesis, unless it is listed against it."""
    return supporting_evidence(*evidence_by_set(hypotheses, citations, evidence), evidence)


def repeated_actions(actions: DataFrame) -> DataFrame:
    """Actions of a case that ask again what an earlier step asked.

    ``arguments`` is a map; its entries are sorted, so their order does not matter.
    """
    signed = actions.withColumn("signature", F.to_json(F.sort_array(F.map_entries("arguments"))))
    key = ["case_id", "action_name", "signature"]
    first = signed.groupBy(*key).agg(F.min("step").alias("first_step"), F.count(F.lit(1)).alias("uses")).where("uses > 1")
    return signed.join(first, key).where("step > first_step").select("case_id", "step", "action_name", "first_step")


def entity_coverage(estate: Estate, entities: DataFrame) -> DataFrame:
    """One sentence per entity on the documents that would explain it, and the lookups made."""
    df = entities.select("entity").distinct().withColumn("value", F.expr("substring(entity, 5)"))
    wanted = df.where(F.col("entity").startswith("RFC:")).select(F.col("value").alias("rfc"))

    def counted(table: DataFrame, key: str, name: str) -> DataFrame:
        return table.withColumnRenamed(key, "rfc").join(wanted, "rfc", "left_semi").groupBy("rfc").agg(F.count(F.lit(1)).alias(name))

    agreements = estate.contracts.withColumnRenamed("vendor_rfc", "rfc").join(wanted, "rfc", "left_semi").groupBy("rfc").agg(
        F.count(F.lit(1)).alias("contracts"),
        F.min(F.struct(F.coalesce("start_date", F.lit("")).alias("d"), "contract_id", "scope_text")).alias("c"))
    vendors = (
        estate.vendors.select("rfc", "legal_name").join(wanted, "rfc", "left_semi").dropDuplicates(["rfc"])
        .join(counted(estate.invoices, "issuer_rfc", "invoices"), "rfc", "left")
        .join(counted(estate.purchase_orders, "vendor_rfc", "orders"), "rfc", "left").join(agreements, "rfc", "left")
        .na.fill(0, ["invoices", "orders", "contracts"]).withColumnRenamed("rfc", "value").withColumn("is_vendor", F.lit(True)))
    # The books may hold an employee id with or without its prefix.
    staff = estate.employees.select(entity_prefix("EMP:", "emp_id").alias("entity"), "role").groupBy("entity").agg(
        F.min("role").alias("role"), F.lit(True).alias("is_employee"))
    df = df.join(vendors, "value", "left").join(staff, "entity", "left")
    scope = clip(F.coalesce("c.scope_text", F.lit("")), SCOPE_CHARS)
    label = F.when(F.col("contracts") > 1, F.format_string("Contract %s (1 of %d read)", "c.contract_id", "contracts")).otherwise(
        F.format_string("Contract %s", "c.contract_id"))
    papers = F.when(F.col("contracts") == 0, " No contract is on record; that is a missing record and does not show that none exists.").when(
        scope != "", F.concat(F.lit(" "), label, F.lit(" states: "), scope)).otherwise("")
    read = F.format_string("Read %d invoice(s), %d purchase order(s), %d contract(s) for %s (%s).", "invoices", "orders", "contracts", "value",
                           F.coalesce(clean_text("legal_name"), F.lit("name not recorded")))
    employee = F.col("entity").startswith("EMP:")
    sentence = (
        F.when(employee & F.col("is_employee"), F.format_string("Employee %s (%s) is on record.", "entity",
               F.coalesce(clean_text("role"), F.lit("role not recorded"))))
        .when(employee, F.format_string("No employee record for %s was found.", "entity"))
        .when(F.col("is_vendor"), F.concat(read, papers))
        .otherwise(F.format_string("No vendor record for %s was found.", "value"))
    )
    calls = F.when(employee, F.array(F.lit("get_employee"))).when(
        F.col("is_vendor"), F.array(*[F.lit(c) for c in VENDOR_CALLS])).otherwise(F.array(F.lit("get_vendor")))
    return df.select("entity", sentence.alias("coverage"), calls.alias("calls"), "invoices", "orders", "contracts")


def unmet_check_detail(checks: DataFrame) -> DataFrame:
    """(hypothesis_id, detail): what did not clear. Missing records are counted and the first is named."""
    unmet = checks.where("critical AND status <> 'verified'")
    single = F.col("check_id").startswith("EXISTS-")
    text = F.concat(F.format_string("%s (%s)", "check_id", "status"),
                    F.coalesce(F.concat(F.lit(": "), clip("calculation", CALCULATION_CHARS)), F.lit("")))
    rows = unmet.groupBy("hypothesis_id").agg(
        F.array_sort(F.collect_set(F.when(~single, text))).alias("named"), F.count(F.when(single, 1)).alias("missing"),
        F.min(F.when(single, F.col("check_id"))).alias("first_missing"))
    missing = F.when(F.col("missing") > 0, F.format_string("%d cited record(s) not found, first %s", "missing", "first_missing"))
    parts = F.array_join(F.array_compact(F.concat("named", F.array(missing))), " | ")
    return rows.select("hypothesis_id", F.concat(F.lit("Unmet critical check(s): "), parts).alias("detail"))


def leads_not_pursued(estate: Estate, leads: DataFrame, accused: DataFrame, refusals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(declined, dropped): every lead whose entity is not accused, with the documents read.

    ``accused`` has entity; ``refusals`` has (entity, refusal) for leads a verifier
    turned down. A lead without an official entity is dropped.
    """
    dropped = leads.where("entity IS NULL").select("lead_id", "subject")
    open_leads = leads.where("entity IS NOT NULL").join(accused.select("entity").distinct(), "entity", "left_anti")
    coverage = entity_coverage(estate, open_leads.select("entity")).select("entity", "coverage", "calls")
    told = refusals.groupBy("entity").agg(F.min("refusal").alias("refusal"))
    df = open_leads.join(coverage, "entity", "left").join(told, "entity", "left")
    return df.select(
        "lead_id", "entity", F.array_join("signals", ", ").alias("signal"),
        F.concat_ws(" ", "coverage", F.coalesce("refusal", F.lit(NO_VERIFIER))).alias("reason"), "calls",
        F.when(F.col("refusal").isNotNull(), "validator").otherwise("investigator").alias("closed_by")), dropped


def closed_by(outcomes: DataFrame) -> DataFrame:
    """Who closed a case that went through review: nobody closed one that failed to run."""
    stop = F.coalesce("stop_reason", F.lit(""))
    who = (
        F.when(F.col("status") == "error", F.lit(None).cast("string")).when(F.col("gate_declined"), "validator")
        .when(stop.startswith("investigator_"), "investigator")
        .when(stop.isin("review_blocked", "no_reviewable_hypothesis"), "challenger").otherwise("investigator")
    )
    return outcomes.withColumn("closed_by", who)


def reviewed_evidence(refs: DataFrame) -> DataFrame:
    """(case_id, summary): the first six records of each case and how many more there are."""
    from auditweave.operators.ordering import top_rows

    distinct = refs.select("case_id", F.concat_ws(".", "source_table", "record_id").alias("label")).distinct()
    shown = top_rows(distinct, ["case_id"], [F.col("label")], SHOWN_RECORDS, "n").groupBy("case_id").agg(
        F.array_sort(F.collect_list("label")).alias("labels"))
    total = distinct.groupBy("case_id").agg(F.count(F.lit(1)).alias("records"))
    more = F.when(F.col("records") > SHOWN_RECORDS, F.format_string(" (+%d more)", F.col("records") - SHOWN_RECORDS)).otherwise("")
    return shown.join(total, "case_id").select("case_id", F.concat(F.lit("reviewed "), F.array_join("labels", ", "), more).alias("summary"), "records")


def run_counters(obs: Observations, leads: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(counter, value) of one run; ``outcomes`` has (case_id, status)."""
    n = F.count(F.lit(1))
    status = F.col("status")
    parts = outcomes.agg(
        n.alias("processed"), F.count(F.when(status == "ready", 1)).alias("ready"),
        F.count(F.when(status == "blocked", 1)).alias("blocked"), F.count(F.when(status == "error", 1)).alias("error"),
    ).unpivot([], ["processed", "ready", "blocked", "error"], "counter", "value")
    seen = obs.heads.agg(n.alias("value")).select(F.lit("observations").alias("counter"), "value")
    opened = leads.agg(n.alias("value")).select(F.lit("leads").alias("counter"), "value")
    return seen.unionByName(opened).unionByName(parts)
