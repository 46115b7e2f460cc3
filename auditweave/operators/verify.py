"""Claims, checks and the evidence gate, for many hypotheses at once (Q1-Q13).

``hypotheses`` has (hypothesis_id, scheme_type, status). ``citations`` has
(hypothesis_id, evidence_id, evidence_no, source_table, record_id, note), one row
per cited record. A hypothesis may cite a large part of the estate, so nothing
here gathers its records into one row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave.functions.clean import clean_text, iso_date, money, normalize_status, strip
from auditweave.operators.lookups import efos_targets, resolve_records
from auditweave.session import durable
from auditweave.sources.estate import Estate

# Fixed values.
DEFINITIVE = "definitivo"
PHANTOM, KICKBACK = "phantom_vendor", "kickback"
PHANTOM_CHECK, KICKBACK_CHECK = "PHANTOM-EFOS-INVOICE-LINK", "KICKBACK-VENDOR-EMPLOYEE-LINK"
OTHER_CHECK, PESO_CHECK = "SCHEME-SUBSTANTIVE-VERIFICATION", "PESO-RECONCILIATION"
TOLERANCE = 0.02
MIN_EXHIBITS = 3
RULES = (
    ("CFF-69B", "Operaciones inexistentes (EFOS)", "SAT", "Articulo 69-B", [PHANTOM]),
    ("SOD-PROC-01", "Segregacion de funciones en compras", "Control interno de la empresa", "Politica de compras", [KICKBACK]),
)

H = "hypothesis_id"
REF = ["source_table", "record_id"]


def cited_refs(citations: DataFrame) -> DataFrame:
    """Each cited record once per hypothesis, at its first place."""
    first = F.min(F.struct("evidence_no", "evidence_id", "note")).alias("f")
    return citations.groupBy(H, *REF).agg(first, F.count(F.lit(1)).alias("uses")).select(
        H, *REF, F.col("f.evidence_no").alias("evidence_no"), F.col("f.evidence_id").alias("evidence_id"),
        F.col("f.note").alias("note"), "uses",
    )


def _cited(refs: DataFrame, table: str) -> DataFrame:
    return refs.where(F.col("source_table") == table).select(H, "record_id")


def looked_up(cited: DataFrame, estate: Estate, table: str, key: str, *columns: Column | str,
              how: str = "inner", keep: tuple[str, ...] = ()) -> DataFrame:
    """(hypothesis_id, record_id, columns) of cited records: joined as given and cleaned afterwards, so only cited ones are.

    ``keep`` names columns of ``cited`` that stay.
    """
    given = estate.table(table).withColumn("record_id", F.col(key).cast("string")).drop(H, *keep)
    return cited.join(given, "record_id", how).select(H, "record_id", *keep, *columns)


def _records(estate: Estate, table: str, key: str, *columns: Column) -> DataFrame:
    return estate.table(table).select(F.col(key).cast("string").alias("record_id"), *columns)


def phantom_vendor_claim(estate: Estate, hypotheses: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims, rows): the sum of cited invoices of cited listed issuers, or the reason for none."""
    listed = _cited(refs, "efos_list").join(
        _records(estate, "efos_list", "rfc", clean_text("rfc").alias("issuer")), "record_id"
    ).select(H, "issuer").dropna().distinct().withColumn("listed", F.lit(True))
    rows = looked_up(
        _cited(refs, "invoices"), estate, "invoices", "uuid", strip("issuer_rfc").alias("issuer"),
        F.col("total").try_cast("double").alias("amount"), how="left",
    ).join(listed, [H, "issuer"], "left").withColumn("in_scope", F.coalesce("listed", F.lit(False))).drop("listed")
    inside = F.col("in_scope")
    sums = rows.groupBy(H).agg(
        F.count(F.when(inside, 1)).alias("in_scope_count"), F.count(F.when(~inside, 1)).alias("out_of_scope_count"),
        F.count(F.when(inside & F.col("amount").isNull(), 1)).alias("unusable_count"),
        F.sum(F.when(inside, money("amount"))).alias("total"),
    )
    parties = listed.groupBy(H).agg(F.count(F.lit(1)).alias("entity_count"), F.min("issuer").alias("first_entity"))
    counts = ["entity_count", "in_scope_count", "out_of_scope_count", "unusable_count"]
    claims = hypotheses.select(H, "scheme_type").join(parties, H, "left").join(sums, H, "left").na.fill(0, counts)
    error = (
        F.when(F.col("scheme_type") != PHANTOM, F.lit("wrong scheme"))
        .when(F.col("entity_count") == 0, F.lit("no listed entity"))
        .when(F.col("unusable_count") > 0, F.lit("unusable amount"))
        .when(F.col("in_scope_count") == 0, F.lit("no record in scope"))
        .when(F.col("out_of_scope_count") > 0, F.lit("records out of scope"))
        .when(F.col("total") <= 0, F.lit("total is not positive"))
    )
    return _finish_claim(claims, error, "invoices"), rows


def _finish_claim(claims: DataFrame, error: Column, table: str) -> DataFrame:
    amount = F.col("total").cast("double")
    formula = F.format_string(f"sum over %d {table} records = %.2f", "in_scope_count", amount)
    return claims.withColumn("error", error).select(
        H, "scheme_type", F.lit(table).alias("source_table"), "entity_count", "in_scope_count", "out_of_scope_count",
        F.when(F.col("error").isNull(), amount).alias("claimed_amount"),
        F.when(F.col("error").isNull(), formula).alias("formula"), "error",
    )


def _cited_accounts(estate: Estate, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accounts of the cited vendors and of the cited employees, per hypothesis."""
    vendors = _cited(refs, "vendors").join(
        _records(estate, "vendors", "rfc", clean_text("bank_clabe").alias("src"), clean_text("rfc").alias("rfc")), "record_id"
    ).select(H, "src", "rfc").dropna().distinct()
    employees = _cited(refs, "employees").join(
        _records(estate, "employees", "emp_id", clean_text("bank_clabe").alias("dst"), clean_text("emp_id").alias("emp_id"),
                 clean_text("name").alias("name")), "record_id"
    ).select(H, "dst", "emp_id", "name").dropna(subset=["dst", "emp_id"]).distinct()
    return durable(vendors), durable(employees)


def cited_transfers(estate: Estate, refs: DataFrame, accounts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Cited transfers between two different cited accounts, vendor to employee.

    One row per transfer and pair of parties; an account with several owners
    names all of them. ``accounts`` are those of the cited parties, where they are known.
    """
    vendors, employees = accounts or _cited_accounts(estate, refs)
    moved = looked_up(_cited(refs, "bank_txns"), estate, "bank_txns", "txn_id", strip("from_clabe").alias("src"), strip("to_clabe").alias("dst"),
                       F.col("amount").try_cast("double").alias("amount"), clean_text("date").alias("date")).where("src <> dst")
    return moved.join(vendors, [H, "src"]).join(employees, [H, "dst"])


def kickback_claim(estate: Estate, hypotheses: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims, rows): what moved from cited vendors to cited employees, each transfer once."""
    vendors, employees = _cited_accounts(estate, refs)
    parties = vendors.select(H, F.lit("v").alias("k"), F.col("rfc").alias("id")).unionByName(
        employees.select(H, F.lit("e").alias("k"), F.col("emp_id").alias("id"))
    ).groupBy(H).agg(F.count(F.when(F.col("k") == "v", 1)).alias("vendors"), F.count(F.when(F.col("k") == "e", 1)).alias("people"))
    rows = durable(cited_transfers(estate, refs, (vendors, employees)))
    once = rows.groupBy(H, "record_id").agg(F.max("amount").alias("amount"))
    sums = once.groupBy(H).agg(
        F.count(F.lit(1)).alias("in_scope_count"), F.count(F.when(F.col("amount").isNull(), 1)).alias("unusable_count"),
        F.sum(money("amount")).alias("total"),
    )
    named = rows.select(H, F.explode(F.array("rfc", "emp_id")).alias("id")).distinct().groupBy(H).agg(
        F.count(F.lit(1)).alias("entity_count"))
    claims = hypotheses.select(H, "scheme_type").join(parties, H, "left").join(sums, H, "left").join(named, H, "left")
    claims = claims.na.fill(0, ["vendors", "people", "in_scope_count", "unusable_count", "entity_count"]).withColumn(
        "out_of_scope_count", F.lit(0).cast("bigint"))
    error = (
        F.when(F.col("scheme_type") != KICKBACK, F.lit("wrong scheme"))
        .when((F.col("vendors") == 0) | (F.col("people") == 0), F.lit("no pair of accounts"))
        .when(F.col("unusable_count") > 0, F.lit("unusable amount"))
        .when(F.col("in_scope_count") == 0, F.lit("no record in scope"))
        .when(F.col("total") <= 0, F.lit("total is not positive"))
    )
    return _finish_claim(claims, error, "bank_txns"), once


def route_claims(estate: Estate, hypotheses: DataFrame, refs: DataFrame) -> DataFrame:
    """Every hypothesis through the rule of its scheme; other schemes are refused in words."""
    scheme = F.coalesce(F.col("scheme_type"), F.lit(""))
    rest = hypotheses.where(~scheme.isin(PHANTOM, KICKBACK)).select(
        H, "scheme_type", F.lit(None).cast("string").alias("source_table"),
        *[F.lit(0).cast("bigint").alias(c) for c in ("entity_count", "in_scope_count", "out_of_scope_count")],
        F.lit(None).cast("double").alias("claimed_amount"), F.lit(None).cast("string").alias("formula"),
        F.lit("no scope rule for this scheme").alias("error"),
    )
    for name, rule in ((PHANTOM, phantom_vendor_claim), (KICKBACK, kickback_claim)):
        mine = hypotheses.where(scheme == name)
        if not mine.isEmpty():
            rest = rest.unionByName(rule(estate, mine, refs.join(mine.select(H), H, "left_semi"))[0])
    return rest


def resolve_exhibits(estate: Estate, citations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(exhibits, duplicates): each cited record with its existence check, and repeated citations.

    The exhibit keeps the amount of the record for the reconciliation.
    """
    exhibits = resolve_records(estate, durable(cited_refs(citations)))
    exhibits = exhibits.withColumn("check_id", F.concat_ws("-", F.lit("EXISTS"), *REF)).withColumn(
        "check_status", F.when(F.col("found"), "verified").otherwise("failed"))
    repeats = exhibits.where("uses > 1").select(H, *REF, (F.col("uses") - 1).alias("duplicates"))
    return exhibits, repeats


def efos_timing_assessment(estate: Estate, hypotheses: DataFrame, exhibits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assessments, parties): does the listing of every matched issuer reach a cited invoice?

    ``parties`` has one row per hypothesis and matched issuer. Dates are compared
    as ISO text; an undated invoice is counted as undated and never as earlier.
    """
    found = exhibits.where("found")
    status = normalize_status("status")
    published = iso_date("publication_date")
    listing = _cited(found, "efos_list").join(
        _records(estate, "efos_list", "rfc", clean_text("rfc").alias("rfc"), status.alias("status"), published.alias("published")),
        "record_id", "left")
    bills = durable(looked_up(_cited(found, "invoices"), estate, "invoices", "uuid", clean_text("issuer_rfc").alias("rfc"),
                               iso_date("issue_date").alias("issued"), how="left"))
    sides = listing.select(H, "rfc", F.lit(1).alias("l")).unionByName(bills.select(H, "rfc", F.lit(0).alias("l"))).groupBy(H).agg(
        F.count(F.when(F.col("l") == 1, 1)).alias("listed_refs"), F.count(F.when(F.col("l") == 0, 1)).alias("invoice_refs"),
        F.count(F.when(F.col("rfc").isNull(), 1)).alias("without_rfc"))
    per_listing = listing.dropna(subset=["rfc"]).groupBy(H, "rfc").agg(
        F.bool_and(F.col("status") == DEFINITIVE).alias("definitive"),
        F.bool_and(F.col("published").isNotNull()).alias("dated"), F.max("published").alias("published"))
    # Counted per day first: the dates of one issuer are few, its invoices may not be.
    days = bills.dropna(subset=["rfc"]).groupBy(H, "rfc", "issued").agg(F.count(F.lit(1)).alias("n"))
    joined = days.join(per_listing, [H, "rfc"])
    reached = F.col("issued") >= F.col("published")
    parties = durable(joined.groupBy(H, "rfc", "definitive", "dated", "published").agg(
        F.sum(F.when(reached, F.col("n")).otherwise(0)).alias("qualifying"),
        F.sum(F.when(~reached, F.col("n")).otherwise(0)).alias("earlier"),
        F.sum(F.when(F.col("issued").isNull(), F.col("n")).otherwise(0)).alias("undated"),
        F.min(F.when(reached, F.col("issued"))).alias("first_qualifying"), F.max(F.when(reached, F.col("issued"))).alias("last_qualifying"),
        F.max(F.when(~reached, F.col("issued"))).alias("last_earlier"),
    ))
    per_case = parties.groupBy(H).agg(
        F.count(F.lit(1)).alias("matched"), F.min("rfc").alias("first_rfc"), F.bool_and("definitive").alias("all_definitive"),
        F.bool_and("dated").alias("all_dated"), F.bool_and(F.col("qualifying") > 0).alias("all_reached"),
        F.sum("qualifying").alias("qualifying"), F.sum("earlier").alias("earlier"), F.sum("undated").alias("undated"),
        F.min("published").alias("first_published"), F.max("published").alias("last_published"),
        F.min("first_qualifying").alias("first_qualifying"), F.max("last_qualifying").alias("last_qualifying"),
    )
    out = hypotheses.select(H).join(sides, H, "left").join(per_case, H, "left")
    out = out.na.fill(0, ["listed_refs", "invoice_refs", "without_rfc", "matched"])
    reason = (
        F.when((F.col("listed_refs") == 0) | (F.col("invoice_refs") == 0), "one side is not cited")
        .when(F.col("without_rfc") > 0, "a cited record has no taxpayer id")
        .when(F.col("matched") == 0, "no cited issuer is listed")
        .when(~F.col("all_definitive"), "a matched listing is not definitive")
        .when(~F.col("all_dated"), "a matched listing has no date")
        .when(~F.col("all_reached"), "a listing reaches no cited invoice")
    )
    out = out.withColumn("reason", reason)
    verdict = F.when(F.col("reason").isNull(), "verified").when(F.col("reason") == "no cited issuer is listed", "failed").otherwise("unresolved")
    dated = F.col("all_definitive") & F.col("all_dated")
    shown = ["qualifying", "earlier", "undated", "first_published", "last_published", "first_qualifying", "last_qualifying"]
    return out.select(H, verdict.alias("status"), "reason", "matched", "first_rfc",
                      *[F.when(dated, F.col(c)).alias(c) for c in shown]), parties


def kickback_assessment(estate: Estate, hypotheses: DataFrame, exhibits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assessments, parties): a cited transfer, and a cited order of that vendor approved by that employee."""
    found = exhibits.where("found")
    vendors, employees = _cited_accounts(estate, found)
    moved = cited_transfers(estate, found, (vendors, employees))
    pairs = durable(moved.groupBy(H, "rfc", "emp_id", "name").agg(F.count(F.lit(1)).alias("transfers")))
    orders = looked_up(_cited(found, "purchase_orders"), estate, "purchase_orders", "po_id", clean_text("vendor_rfc").alias("rfc"),
                        clean_text("approver").alias("approver")).select(H, "rfc", "approver").dropna().distinct()
    names = pairs.select(H, "rfc", "emp_id", F.explode(F.array("emp_id", "name")).alias("approver"))
    confirmed = names.join(orders, [H, "rfc", "approver"]).select(H, "rfc", "emp_id").distinct().withColumn("approved", F.lit(True))
    parties = durable(pairs.join(confirmed, [H, "rfc", "emp_id"], "left").withColumn("approved", F.coalesce("approved", F.lit(False))))
    shared = vendors.join(employees.select(H, F.col("dst").alias("src")), [H, "src"], "left_semi").select(H).distinct()
    out = (
        hypotheses.select(H)
        .join(vendors.groupBy(H).agg(F.count(F.lit(1)).alias("vendors")), H, "left")
        .join(employees.groupBy(H).agg(F.count(F.lit(1)).alias("people")), H, "left")
        .join(shared.withColumn("shared", F.lit(True)), H, "left")
        .join(parties.groupBy(H).agg(F.count(F.lit(1)).alias("pairs"), F.count(F.when(F.col("approved"), 1)).alias("confirmed")), H, "left")
        .na.fill(0, ["vendors", "people", "pairs", "confirmed"])
    )
    reason = (
        F.when((F.col("vendors") == 0) | (F.col("people") == 0), "one side has no account")
        .when((F.col("pairs") == 0) & F.col("shared"), "shared account, but no transfer between two accounts")
        .when(F.col("pairs") == 0, "no cited transfer from vendor to employee")
        .when(F.col("confirmed") == 0, "no cited order approved by that employee")
    )
    out = out.withColumn("reason", reason)
    verdict = F.when(F.col("reason").isNull(), "verified").otherwise("unresolved")
    return out.select(H, verdict.alias("status"), "reason", "pairs", "confirmed"), parties


def peso_reconciliation(claims: DataFrame, exhibits: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Set each claim against the cited sum of every table; the nearest table decides."""
    sums = exhibits.where("amount IS NOT NULL").groupBy(H, "source_table").agg(F.sum(money("amount")).cast("double").alias("table_sum"))
    claimed = claims.select(H, "claimed_amount")
    gap = F.abs(F.col("claimed_amount") - F.col("table_sum"))
    best = claimed.where("claimed_amount IS NOT NULL").join(sums, H).groupBy(H).agg(
        F.min(F.struct(gap.alias("gap"), F.col("source_table").alias("t"), F.col("table_sum").alias("s"))).alias("b"))
    missing = exhibits.where("NOT found").groupBy(H).agg(F.count(F.lit(1)).alias("missing_records"))
    out = claimed.join(best, H, "left").join(missing, H, "left").na.fill(0, ["missing_records"])
    edge = F.lit(tolerance) * F.greatest(F.col("b.s"), F.lit(1.0))
    return out.select(
        H, "claimed_amount", F.col("b.t").alias("best_table"), F.col("b.s").alias("best_sum"), F.col("b.gap").alias("difference"),
        F.coalesce(F.col("b.gap") <= edge, F.lit(False)).alias("reconciles"), "missing_records",
    )


@dataclass(frozen=True)
class Assessment:
    """Everything the checks of one run read or produce."""

    hypotheses: DataFrame
    exhibits: DataFrame
    claims: DataFrame
    timing: DataFrame
    issuers: DataFrame
    links: DataFrame
    parties: DataFrame
    recon: DataFrame
    checks: DataFrame
    reports: DataFrame


def verification_report(estate: Estate, hypotheses: DataFrame, citations: DataFrame) -> Assessment:
    """Every check in a long table, and one summary row per hypothesis.

    Exhibits, claims and the reconciliation are read by several checks, so they are written once.
    """
    exhibits, _ = resolve_exhibits(estate, citations.join(hypotheses.select(H), H, "left_semi"))
    exhibits = durable(exhibits)
    claims = durable(route_claims(estate, hypotheses, exhibits))
    scheme = F.coalesce(F.col("scheme_type"), F.lit(""))
    phantom, issuers = efos_timing_assessment(estate, hypotheses.where(scheme == PHANTOM), exhibits)
    kickback, parties = kickback_assessment(estate, hypotheses.where(scheme == KICKBACK), exhibits)
    phantom, kickback = durable(phantom), durable(kickback)
    recon = durable(peso_reconciliation(claims, exhibits))
    peso = F.when(F.col("claimed_amount").isNull(), "unresolved").when(F.col("reconciles"), "verified").otherwise("failed")

    def check(df: DataFrame, check_id: Column, status: Column, calculation: Column) -> DataFrame:
        return df.select(H, check_id.alias("check_id"), status.alias("status"), calculation.cast("string").alias("calculation"),
                         F.lit(True).alias("critical"))

    parts = [
        check(exhibits, F.col("check_id"), F.col("check_status"), F.lit(None)),
        check(phantom, F.lit(PHANTOM_CHECK), F.col("status"), F.col("reason")),
        check(kickback, F.lit(KICKBACK_CHECK), F.col("status"), F.col("reason")),
        check(hypotheses.where(~scheme.isin(PHANTOM, KICKBACK)), F.lit(OTHER_CHECK), F.lit("unresolved"),
              F.lit("no verifier for this scheme")),
        check(recon, F.lit(PESO_CHECK), peso, F.when(F.col("claimed_amount").isNull(), F.lit("no claimed amount"))
              .otherwise(F.format_string("nearest table %s, sum %.2f", "best_table", "best_sum"))),
    ]
    checks = reduce(DataFrame.unionByName, parts)
    failed, open_ = F.col("status") == "failed", F.col("status") == "unresolved"
    named = F.when(~F.col("check_id").startswith("EXISTS-"), F.col("check_id"))
    # Only the few checks that are not about single records are listed by name.
    summary = checks.groupBy(H).agg(
        F.count(F.lit(1)).alias("checks"), F.count(F.when(failed, 1)).alias("failures"), F.count(F.when(open_, 1)).alias("unresolved"),
        F.array_join(F.sort_array(F.collect_set(F.when(failed, named))), ",").alias("failed_checks"),
        F.array_join(F.sort_array(F.collect_set(F.when(open_, named))), ",").alias("unresolved_checks"),
        F.bool_or((F.col("check_id") == PHANTOM_CHECK) & (F.col("status") == "verified")).alias("phantom_verified"),
        F.bool_or((F.col("check_id") == KICKBACK_CHECK) & (F.col("status") == "verified")).alias("kickback_verified"),
        F.bool_or((F.col("check_id") == PESO_CHECK) & (F.col("status") == "verified")).alias("peso_verified"),
    )
    resolved = exhibits.where("found").groupBy(H).agg(F.count(F.lit(1)).alias("exhibits"))
    reports = hypotheses.select(H, "scheme_type").join(summary, H, "left").join(resolved, H, "left").join(
        recon.select(H, "reconciles", "claimed_amount"), H, "left").na.fill(0, ["checks", "failures", "unresolved", "exhibits"])
    return Assessment(hypotheses, exhibits, claims, phantom, issuers, kickback, parties, recon, checks, reports)


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [list(r) for r in RULES], "rule_id string, title string, source string, source_reference string, applies_to array<string>"
    )


def rule_lookup(hypotheses: DataFrame) -> DataFrame:
    """The one rule that applies to a scheme; NULL when there is none or more than one."""
    rules = rule_table(hypotheses.sparkSession).select("rule_id", F.explode("applies_to").alias("scheme_type"))
    single = rules.groupBy("scheme_type").agg(F.count(F.lit(1)).alias("n"), F.min("rule_id").alias("rule_id")).where("n = 1")
    # The rule book is a fixed list.
    return hypotheses.join(F.broadcast(single.drop("n")), "scheme_type", "left")


def evidence_gate(hypotheses: DataFrame, reviews: DataFrame, reports: DataFrame) -> DataFrame:
    """Fail-closed decision per hypothesis.

    ``hypotheses`` has the requested ``rule_id``; ``reviews`` has challenger,
    method_critic and useful_actions_remain. A hypothesis without a report is refused.
    """
    rules = rule_table(hypotheses.sparkSession).select("rule_id", "applies_to")
    df = hypotheses.select(H, "scheme_type", F.col("status").alias("hypothesis_status"), "rule_id").join(
        F.broadcast(rules), "rule_id", "left").join(reviews, H, "left").join(reports.drop("scheme_type"), H, "left")
    scheme, challenger, critic = F.col("scheme_type"), F.col("challenger"), F.col("method_critic")
    reported = F.col("checks").isNotNull()
    known = F.array(*[F.lit(r[0]) for r in RULES])

    def need(condition: Column, text: str | Column) -> Column:
        return F.when(condition, F.lit(text) if isinstance(text, str) else text)

    verified = F.when(scheme == PHANTOM, F.col("phantom_verified")).when(scheme == KICKBACK, F.col("kickback_verified"))
    needs = F.array_compact(F.array(
        need(F.col("rule_id").isNull() | ~F.array_contains(known, F.coalesce("rule_id", F.lit(""))), "no valid rule requested"),
        need(F.col("applies_to").isNotNull() & scheme.isNull(), "hypothesis has no scheme"),
        need(F.col("applies_to").isNotNull() & ~F.array_contains("applies_to", scheme), "rule does not apply to the scheme"),
        need(challenger.isNull(), "challenger review is missing"),
        need(challenger == "needs_more_evidence", "challenger needs more evidence"),
        need(challenger == "legitimate_alternative", "challenger found a legitimate alternative"),
        need(challenger == "alternative_hypothesis", "challenger found another hypothesis"),
        need(critic.isNull(), "method review is missing"),
        need(critic == "needs_more_work", "method review needs more work"),
        need(critic == "cannot_support", "method review cannot support"),
        need(~reported, "verification report is missing"),
        need(reported & (F.col("checks") == 0), "report has no checks"),
        need(reported & (F.col("exhibits") < MIN_EXHIBITS), F.format_string("fewer than 3 exhibits (found %d)", "exhibits")),
        need(reported & ~F.coalesce("reconciles", F.lit(False)), "amount does not reconcile"),
        need(reported & (F.col("failures") > 0), F.format_string("critical checks failed: %d", "failures")),
        need(reported & (F.col("unresolved") > 0), F.format_string("critical checks unresolved: %d", "unresolved")),
        need(reported & ~F.coalesce("peso_verified", F.lit(False)), "no verified amount check"),
        need(reported & scheme.isin(PHANTOM, KICKBACK) & ~F.coalesce(verified, F.lit(False)), "no verified scheme check"),
        need(reported & scheme.isNotNull() & ~scheme.isin(PHANTOM, KICKBACK), "no verifier for this scheme"),
    ))
    rejected = F.col("hypothesis_status") == "rejected"
    df = df.withColumn("failed_requirements", F.when(rejected, F.array(F.lit("hypothesis is already rejected"))).otherwise(needs))
    outcome = (
        F.when(rejected | (challenger == "legitimate_alternative"), "decline_hypothesis")
        .when(F.size("failed_requirements") == 0, "authorize_probable")
        .when(critic == "cannot_support", "inconclusive")
        .when(F.coalesce("useful_actions_remain", F.lit(False)) | challenger.isNull() | critic.isNull()
              | (challenger == "needs_more_evidence") | (critic == "needs_more_work"), "need_more_work")
        .otherwise("inconclusive")
    )
    return df.select(H, "scheme_type", "rule_id", outcome.alias("outcome"),
                     F.when(outcome == "authorize_probable", F.lit("probable")).alias("confidence"), "failed_requirements")


def boundary_check(claims: DataFrame, ready: DataFrame) -> DataFrame:
    """Cases that may go to verification, the blocked ones, and claims that break the contract.

    ``ready`` has ready_for_verification and stop_reason. A blocked case passes
    through unevaluated; a bad amount is an error, not an outcome.
    """
    df = ready.join(claims, H, "left")
    amount = F.col("claimed_amount")
    error = (
        F.when(~F.col("ready_for_verification"), F.lit(None).cast("string"))
        .when(F.col("stop_reason") != "ready_for_verification", F.lit("ready, but stopped for another reason"))
        .when(F.isnan(amount) | (F.abs(amount) == float("inf")), F.lit("amount is not finite"))
        .when(amount <= 0, F.lit("amount is not positive"))
    )
    df = df.withColumn("boundary_error", error)
    route = F.when(~F.col("ready_for_verification"), "preverification_blocked").when(
        F.col("boundary_error").isNotNull(), "error").otherwise("evaluated")
    return df.withColumn("route", route)


def sweep_hypotheses(estate: Estate) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hypotheses, citations, reviews) of the listing sweep: one case per listed issuer.

    Each cites its listing row and all of its invoices; both reviews count as passed.
    """
    targets = durable(efos_targets(estate))
    hypotheses = targets.select(
        F.concat(F.lit("sweep-"), "rfc", F.lit("-H1")).alias(H), F.lit(PHANTOM).alias("scheme_type"), F.lit("supported").alias("status"), "rfc")
    listing = targets.select(
        F.concat(F.lit("sweep-"), "rfc", F.lit("-H1")).alias(H), F.lit("ev-efos").alias("evidence_id"), F.lit(0).alias("evidence_no"),
        F.lit("efos_list").alias("source_table"), F.col("rfc").alias("record_id"), F.lit("Listing row of the issuer.").alias("note"))
    bills = estate.invoices.join(targets, F.col("issuer_rfc") == F.col("rfc")).select(
        F.concat(F.lit("sweep-"), "rfc", F.lit("-H1")).alias(H), F.concat(F.lit("ev-inv-"), "uuid").alias("evidence_id"),
        F.lit(1).alias("evidence_no"), F.lit("invoices").alias("source_table"), F.col("uuid").alias("record_id"),
        F.lit("Invoice issued by the listed taxpayer.").alias("note"))
    reviews = hypotheses.select(H, F.lit("survives").alias("challenger"), F.lit("clear").alias("method_critic"),
                                F.lit(False).alias("useful_actions_remain"))
    return hypotheses.drop("rfc"), listing.unionByName(bills), reviews


def decide(found: Assessment, reviews: DataFrame) -> DataFrame:
    """The gate's outcome with the report and the claim it rests on."""
    # The gate reads the reports too, and they go over every exhibit.
    reports = durable(found.reports)
    gate = evidence_gate(rule_lookup(found.hypotheses), reviews, reports)
    claims = found.claims.select(H, "formula", F.col("error").alias("claim_error"))
    return gate.join(reports.drop("scheme_type"), H, "left").join(claims, H, "left")


def efos_authorisation_sweep(estate: Estate) -> DataFrame:
    """Outcome, claim and checks for every listed taxpayer that issued an invoice."""
    hypotheses, citations, reviews = sweep_hypotheses(estate)
    return decide(verification_report(estate, hypotheses, citations), reviews)
