"""Findings and what becomes of every case."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditweave.functions.clean import clean_text, entity_prefix, sum_money
from auditweave.operators import verify
from auditweave.operators.lookups import account_owners
from auditweave.operators.ordering import positions
from auditweave.operators.verify import H, PHANTOM, KICKBACK
from auditweave.session import durable
from auditweave.sources.estate import Estate

MAX_WORDS = 150  # fixed value


def number_exhibits(exhibits: DataFrame) -> DataFrame:
    """Resolved records in (table, id) order, numbered EX-001 onwards within each hypothesis."""
    found = exhibits.where("found").select(H, "source_table", "record_id", "note")
    placed = positions(found, [H], ["source_table", "record_id"], "exhibit_no")
    default = F.format_string("Record %s of %s was found.", "record_id", "source_table")
    return placed.select(
        H, F.format_string("EX-%03d", "exhibit_no").alias("exhibit_id"), "exhibit_no", "source_table", "record_id",
        F.coalesce(clean_text("note"), default).alias("note"))


def phantom_trail(estate: Estate, exhibits: DataFrame, amounts: DataFrame) -> DataFrame:
    """One step per finding: receiver to issuer, on the earliest dated cited invoice."""
    bills = verify.looked_up(
        exhibits.where("source_table = 'invoices'").select(H, "record_id", "exhibit_no", "exhibit_id"), estate, "invoices", "uuid",
        clean_text("issue_date").alias("date"), clean_text("issuer_rfc").alias("issuer"), clean_text("receiver_rfc").alias("receiver"),
        keep=("exhibit_no", "exhibit_id"))
    first = bills.where("date IS NOT NULL").groupBy(H).agg(
        F.min(F.struct("date", "exhibit_no", "exhibit_id", "issuer", "receiver")).alias("f"))
    return first.where("f.issuer IS NOT NULL AND f.receiver IS NOT NULL").join(amounts, H).select(
        H, F.lit(1).cast("bigint").alias("step"), F.concat(F.lit("RFC:"), "f.receiver").alias("from_entity"),
        F.concat(F.lit("RFC:"), "f.issuer").alias("to_entity"), F.col("claimed_amount").alias("amount"),
        F.col("f.date").alias("date"), F.col("f.exhibit_id").alias("exhibit_id"))


def kickback_trail(estate: Estate, exhibits: DataFrame) -> DataFrame:
    """Cited vendor-to-employee transfers by date, up to the first that does not connect."""
    owners = account_owners(estate)
    moved = verify.looked_up(
        exhibits.where("source_table = 'bank_txns'").select(H, "record_id", "exhibit_no", "exhibit_id"), estate, "bank_txns", "txn_id",
        clean_text("from_clabe").alias("src"), clean_text("to_clabe").alias("dst"), "amount", clean_text("date").alias("date"),
        keep=("exhibit_no", "exhibit_id"))
    steps = moved.where("src <> dst AND amount IS NOT NULL AND date IS NOT NULL").join(
        owners.select(F.col("account").alias("src"), "vendor_rfc"), "src").join(
        owners.select(F.col("account").alias("dst"), "emp_id"), "dst").where("vendor_rfc IS NOT NULL AND emp_id IS NOT NULL")
    steps = steps.select(H, "date", "exhibit_no", "exhibit_id", "amount", entity_prefix("RFC:", "vendor_rfc").alias("from_entity"),
                         entity_prefix("EMP:", "emp_id").alias("to_entity"))
    placed = positions(steps, [H], ["date", "exhibit_no"], "step")
    # A step connects when the one before it ends where it begins; the trail is the run before the first break.
    before = placed.select(H, (F.col("step") + 1).alias("step"), F.col("to_entity").alias("previous"))
    linked = placed.join(before, [H, "step"], "left")
    breaks = linked.where((F.col("step") > 1) & ~F.col("previous").eqNullSafe(F.col("from_entity"))).groupBy(H).agg(
        F.min("step").alias("break_at"))
    return linked.join(breaks, H, "left").where("break_at IS NULL OR step < break_at").select(
        H, "step", "from_entity", "to_entity", "amount", "date", "exhibit_id")


def _span(first: str, last: str):
    return F.when(F.col(first) == F.col(last), F.col(first)).otherwise(F.concat_ws(" to ", first, last))


def phantom_finding(assessment: DataFrame, claims: DataFrame) -> DataFrame:
    """(hypothesis_id, narrative): only what the checks established, with counts and spans."""
    df = assessment.where("status = 'verified'").join(claims.where("claimed_amount IS NOT NULL").select(H, "claimed_amount"), H)
    attributed = F.col("qualifying") + F.col("earlier") + F.col("undated")
    timing = F.when(
        F.col("qualifying") == attributed,
        F.format_string("All %d cited invoices date from after the listing (%s).", "qualifying", _span("first_qualifying", "last_qualifying")),
    ).otherwise(F.format_string(
        "%d of %d cited invoices date from after the listing (%s); the others are part of the amount all the same.",
        "qualifying", attributed, _span("first_qualifying", "last_qualifying")))
    who = F.when(F.col("matched") == 1, F.col("first_rfc")).otherwise(F.format_string("%s and %d more", "first_rfc", F.col("matched") - 1))
    text = F.concat_ws(" ", F.format_string("Issuer %s is listed as definitive (published %s).", who, _span("first_published", "last_published")),
                       timing, F.format_string("The amount of MXN %.2f agrees with the cited records.", "claimed_amount"),
                       F.lit("Confidence is probable; intent is not shown."))
    return df.select(H, text.alias("narrative"))


def kickback_finding(assessment: DataFrame, claims: DataFrame) -> DataFrame:
    df = assessment.where("status = 'verified'").join(claims.where("claimed_amount IS NOT NULL").select(H, "claimed_amount"), H)
    linked = F.format_string("Cited transfers link %d vendor-employee pair(s); in %d of them the paid employee also approved an order of the vendor.", "pairs", "confirmed")
    text = F.concat_ws(" ", linked, F.format_string("The transfers in scope add up to MXN %.2f. Graded probable.", "claimed_amount"))
    return df.select(H, text.alias("narrative"))


def build_findings(estate: Estate, hypotheses: DataFrame, citations: DataFrame, reviews: DataFrame) -> dict[str, DataFrame]:
    """Tables ``findings``, ``entities``, ``exhibits``, ``trail`` and ``refused``.

    A finding needs an authorised gate, a narrative of its scheme and an
    applicable rule. Whatever is authorised but lacks one goes to ``refused``.
    """
    found = verify.verification_report(estate, hypotheses, citations)
    decisions = durable(verify.decide(found, reviews))
    passed = decisions.where("outcome = 'authorize_probable' AND confidence = 'probable'").select(H, "scheme_type", "rule_id", "claimed_amount")
    resolved = found.exhibits.join(passed.select(H), H, "left_semi")
    exhibits = number_exhibits(resolved)
    timing, issuers, links, pairs = found.timing, found.issuers, found.links, found.parties
    text = phantom_finding(timing, passed).unionByName(kickback_finding(links, passed))
    rules = verify.rule_table(estate.spark).select(
        "rule_id", F.concat_ws(" ", "source", "source_reference", F.lit("-"), "title").alias("rule_broken"))
    full = passed.join(text, H, "left").join(F.broadcast(rules), "rule_id", "left")
    missing = F.col("narrative").isNull() | F.col("rule_broken").isNull() | ~(F.col("claimed_amount") > 0)
    findings = full.where(~missing).select(H, "scheme_type", "rule_id", "rule_broken", F.col("claimed_amount").alias("peso_amount"),
                                           "narrative", F.lit("probable").alias("confidence"))
    ok = findings.select(H)
    named = issuers.join(timing.where("status = 'verified'").select(H), H, "left_semi").select(
        H, F.concat(F.lit("RFC:"), "rfc").alias("entity"))
    both = pairs.where("approved").select(H, F.explode(F.array(F.concat(F.lit("RFC:"), "rfc"), entity_prefix("EMP:", "emp_id"))).alias("entity"))
    phantom_only = passed.where(F.col("scheme_type") == PHANTOM).select(H)
    trail = phantom_trail(estate, exhibits.join(phantom_only, H, "left_semi"), passed.select(H, "claimed_amount")).unionByName(
        kickback_trail(estate, exhibits.join(phantom_only, H, "left_anti")))
    return {
        "findings": findings,
        "entities": named.unionByName(both).distinct().join(ok, H, "left_semi"),
        "exhibits": exhibits.join(ok, H, "left_semi"),
        "trail": trail.join(ok, H, "left_semi"),
        "refused": full.where(missing).select(H, "scheme_type"),
        "decisions": decisions,
    }


def validate_findings(tables: dict[str, DataFrame]) -> DataFrame:
    """(hypothesis_id, errors): the output contract, one array of broken rules per finding."""
    ex = tables["exhibits"].groupBy(H, "exhibit_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(clean_text("note").isNull()).alias("blank"))
    exhibits = ex.groupBy(H).agg(F.count(F.lit(1)).alias("ids"), F.sum("n").alias("exhibits"), F.max("blank").alias("blank"))
    entity = F.col("entity")
    entities = tables["entities"].groupBy(H).agg(
        F.count(F.lit(1)).alias("entities"),
        F.bool_and(entity.rlike("^(RFC|EMP):") & ~F.trim(entity).isin("RFC:", "EMP:")).alias("well_formed"))
    steps = tables["trail"].join(ex.select(H, "exhibit_id", F.lit(True).alias("known")), [H, "exhibit_id"], "left")
    before = tables["trail"].select(H, (F.col("step") + 1).alias("step"), F.col("to_entity").alias("previous"))
    steps = steps.join(before, [H, "step"], "left").groupBy(H).agg(
        F.bool_and(F.coalesce("known", F.lit(False))).alias("known"),
        F.bool_and((F.col("step") == 1) | F.col("previous").eqNullSafe(F.col("from_entity"))).alias("connected"))
    df = tables["findings"].join(exhibits, H, "left").join(entities, H, "left").join(steps, H, "left")
    words = F.size(F.split(F.trim("narrative"), r"\s+"))
    errors = F.array_compact(F.array(
        F.when(F.coalesce("exhibits", F.lit(0)) < verify.MIN_EXHIBITS, "fewer than 3 exhibits"),
        F.when(F.col("ids") < F.col("exhibits"), "exhibit id repeats"),
        F.when(F.coalesce("blank", F.lit(False)), "blank note"),
        F.when(F.coalesce("entities", F.lit(0)) == 0, "no entity"),
        F.when(~F.coalesce("well_formed", F.lit(True)), "malformed entity"),
        F.when(clean_text("narrative").isNull(), "blank narrative"),
        F.when(words > MAX_WORDS, "narrative is too long"),
        F.when(~F.coalesce("known", F.lit(True)), "trail cites an unknown exhibit"),
        F.when(~F.coalesce("connected", F.lit(True)), "trail is not connected"),
        F.when(~(F.col("peso_amount") > 0), "amount is not positive"),
    ))
    return df.select(H, errors.alias("errors"))


def audit_result(decisions: DataFrame, findings: DataFrame) -> DataFrame:
    """Per case: authorised, or the first reason that can be quoted."""
    df = decisions.join(findings.select(H, F.lit(True).alias("has_finding")), H, "left")
    gate = F.concat(F.lit("Gate: "), "outcome", F.lit("; "), F.array_join("failed_requirements", "; "))
    reason = (
        F.when(F.col("has_finding"), F.lit(None).cast("string"))
        .when(~F.col("scheme_type").isin(PHANTOM, KICKBACK) | F.col("scheme_type").isNull(), F.lit("scheme is not supported"))
        .when(F.col("claim_error").isNotNull(), F.concat(F.lit("No claim: "), "claim_error"))
        .when(F.col("rule_id").isNull(), F.lit("no rule for this scheme"))
        .when(F.col("outcome") != "authorize_probable", gate)
        .otherwise(F.lit("the finding was refused when it was put together"))
    )
    return df.select(H, F.coalesce("has_finding", F.lit(False)).alias("authorised"), "outcome", reason.alias("reason"))


def total_exposure(findings: DataFrame) -> DataFrame:
    return findings.groupBy("confidence").agg(F.count(F.lit(1)).alias("findings"), sum_money("peso_amount").alias("exposure"))
