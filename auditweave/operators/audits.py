"""Whole-estate data-quality audits.

Most checks give (check_name, source_table, record_id), one row per violation;
``all_violations`` runs them all, ``audit_report`` counts and samples them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave.functions.clean import clean_text, money
from auditweave.operators.lookups import KEY_CHARS, SETTLEMENT_PREFIX
from auditweave.operators.ordering import top_rows
from auditweave.session import durable
from auditweave.sources.estate import TABLES, Estate

# Fixed values.
CHECK_WEIGHTS = (3, 7, 1)
STATUSES, LIST_STATUSES = ("vigente", "cancelado"), ("definitivo", "presunto")
CREDIT_METHOD, CREDIT_FORM = "PPD", "99"


def _rows(df: DataFrame, check: str, table: str, key: str | None = None) -> DataFrame:
    return df.select(F.lit(check).alias("check_name"), F.lit(table).alias("source_table"),
                     F.col(key or TABLES[table][0]).cast("string").alias("record_id"))


def invoice_arithmetic(estate: Estate, tolerance: float = 0.011) -> DataFrame:
    """Totals that are not subtotal plus VAT."""
    off = F.abs(F.col("total") - (F.col("subtotal") + F.col("iva"))) > tolerance
    return _rows(estate.invoices.where(off), "invoice_arithmetic", "invoices")


def vat_rates(estate: Estate) -> DataFrame:
    """(rate, invoices): several rates may be in force at once."""
    rated = estate.invoices.where("subtotal > 0").select(F.round(F.col("iva") / F.col("subtotal"), 2).alias("rate"))
    return rated.groupBy("rate").agg(F.count(F.lit(1)).alias("invoices"))


def ledger_balance(estate: Estate) -> DataFrame:
    """Invoices whose ledger rows do not balance, and one row for the whole ledger when it does not."""
    sides = [F.sum(money("debit")).alias("debit"), F.sum(money("credit")).alias("credit")]
    apart = estate.ledger.groupBy("invoice_uuid").agg(*sides).where("invoice_uuid IS NOT NULL AND debit <> credit")
    whole = estate.ledger.agg(*sides).where("debit <> credit").withColumn("all", F.lit("*"))
    return _rows(apart, "ledger_balance_per_invoice", "ledger", "invoice_uuid").unionByName(
        _rows(whole, "ledger_balance_total", "ledger", "all"))


def referential_integrity(estate: Estate) -> DataFrame:
    def orphans(child: str, column: str, parent: str) -> DataFrame:
        keys = estate.table(parent).select(F.col(TABLES[parent][0]).alias(column))
        rows = estate.table(child).where(F.col(column).isNotNull()).join(keys, column, "left_anti")
        return _rows(rows, f"{child}_without_{parent}", child)

    return orphans("ledger", "invoice_uuid", "invoices").unionByName(
        orphans("purchase_orders", "vendor_rfc", "vendors")).unionByName(orphans("contracts", "vendor_rfc", "vendors"))


def account_is_valid(account: Column) -> Column:
    """Eighteen digits, the last of which is the weighted control digit."""
    weights = F.array(*[F.lit(CHECK_WEIGHTS[i % 3]) for i in range(17)])
    digits = F.transform(F.sequence(F.lit(1), F.lit(17)), lambda i: F.substring(account, i, F.lit(1)).cast("int"))
    total = F.aggregate(F.zip_with(digits, weights, lambda d, w: (d * w) % 10), F.lit(0), lambda a, x: a + x)
    well_formed = account.rlike(r"^\d{18}$")
    return F.when(well_formed, (10 - total % 10) % 10 == F.substring(account, 18, 1).cast("int")).otherwise(F.lit(False))


def account_number_audit(estate: Estate) -> DataFrame:
    """Every place that names an account with a bad number."""
    places = [("vendors", "bank_clabe"), ("employees", "bank_clabe"), ("bank_txns", "from_clabe"), ("bank_txns", "to_clabe")]
    parts = []
    for table, column in places:
        bad = estate.table(table).where(~F.coalesce(account_is_valid(F.col(column)), F.lit(False)))
        parts.append(_rows(bad, f"account_number_{column}", table))
    return reduce(DataFrame.unionByName, parts)


def period_bounds(estate: Estate, start: str, end: str) -> DataFrame:
    """(source_table, first_date, last_date, outside): dates outside the period are counted."""
    parts = []
    for table, column in (("invoices", "issue_date"), ("ledger", "date"), ("bank_txns", "date")):
        out = (F.col(column) < start) | (F.col(column) > end)
        parts.append(estate.table(table).agg(
            F.min(column).alias("first_date"), F.max(column).alias("last_date"), F.count(F.when(out, 1)).alias("outside")
        ).withColumn("source_table", F.lit(table)))
    return reduce(DataFrame.unionByName, parts)


def code_rules(estate: Estate) -> DataFrame:
    inv, listed, staff = estate.invoices, estate.efos_list, estate.employees
    return reduce(DataFrame.unionByName, [
        _rows(inv.where((F.col("metodo_pago") == CREDIT_METHOD) & (F.col("forma_pago") != CREDIT_FORM)), "credit_needs_form_99", "invoices"),
        _rows(inv.where(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))), "invoice_status", "invoices"),
        _rows(listed.where(~F.coalesce(F.col("status").isin(*LIST_STATUSES), F.lit(False))), "listing_status", "efos_list"),
        _rows(staff.where(~F.col("emp_id").startswith("EMP:")), "employee_id_prefix", "employees"),
    ])


def cancelled_invoices(estate: Estate) -> DataFrame:
    return estate.invoices.where("status = 'cancelado'").select("uuid", "issuer_rfc", "total")


def cancelled_but_settled(estate: Estate) -> DataFrame:
    reference = F.concat(F.lit(SETTLEMENT_PREFIX), F.substring("uuid", 1, KEY_CHARS))
    rows = cancelled_invoices(estate).withColumn("reference", reference)
    return _rows(rows.join(estate.bank_txns, "reference", "left_semi"), "cancelled_but_settled", "invoices")


def listing_timing_profile(estate: Estate) -> DataFrame:
    """Per listed taxpayer: first and last invoice against the publication date."""
    bills = estate.invoices.groupBy(F.col("issuer_rfc").alias("rfc")).agg(
        F.count(F.lit(1)).alias("invoices"), F.min("issue_date").alias("first_invoice"), F.max("issue_date").alias("last_invoice"))
    df = estate.efos_list.select("rfc", "status", "publication_date").join(bills, "rfc")
    published = F.col("publication_date")
    place = F.when(F.col("last_invoice") < published, "all before").when(F.col("first_invoice") >= published, "all after").otherwise("across")
    return df.withColumn("placement", place)


def approver_bands(estate: Estate, low: float = 100_000, high: float = 500_000, manager: str = "Gerente") -> DataFrame:
    """(approver, band, orders, by_manager): who signs which amounts."""
    band = F.when(F.col("amount") < low, "low").when(F.col("amount") >= high, "high").otherwise("middle")
    signed = estate.purchase_orders.groupBy("approver", band.alias("band")).agg(F.count(F.lit(1)).alias("orders"))
    managers = estate.employees.where(F.col("role").startswith(manager)).select(F.col("name").alias("approver")).distinct()
    return signed.join(managers.withColumn("by_manager", F.lit(True)), "approver", "left").withColumn(
        "by_manager", F.coalesce("by_manager", F.lit(False)))


def paper_trail(estate: Estate, company_account: str) -> DataFrame:
    """Invoiced vendors: is there a contract or order, and a payment from the company?"""
    billed = estate.vendors.select("rfc", "bank_clabe").join(estate.invoices.select(F.col("issuer_rfc").alias("rfc")), "rfc", "left_semi")
    cover = estate.contracts.select(F.col("vendor_rfc").alias("rfc")).union(estate.purchase_orders.select("vendor_rfc")).distinct()
    paid = estate.bank_txns.where(F.col("from_clabe") == company_account).select(F.col("to_clabe").alias("bank_clabe")).distinct()
    df = billed.join(cover.withColumn("has_cover", F.lit(True)), "rfc", "left").join(paid.withColumn("is_paid", F.lit(True)), "bank_clabe", "left")
    return df.select("rfc", F.coalesce("has_cover", F.lit(False)).alias("has_cover"), F.coalesce("is_paid", F.lit(False)).alias("is_paid"))


def similar_name_vendors(estate: Estate, length: int = 4) -> DataFrame:
    """Unlisted vendors whose name holds the stem of a listed one.

    The stem is the start of the second word, or of the only one. Names are cut
    into pieces of that length, so a stem is found by an equi-join and a common
    stem never pairs every vendor with every listed one.
    """
    words = F.split(F.lower(clean_text("legal_name")), r"\s+")
    word = F.when(F.size(words) > 1, F.element_at(words, 2)).otherwise(F.element_at(words, 1))
    stems = estate.efos_list.select(F.substring(word, 1, length).alias("stem")).where(F.length("stem") == length).distinct()
    listed = estate.efos_list.select("rfc")
    name = F.lower(clean_text("legal_name"))
    starts = F.sequence(F.lit(1), F.greatest(F.length(name) - (length - 1), F.lit(1)))
    pieces = estate.vendors.join(listed, "rfc", "left_anti").select(
        "rfc", "legal_name", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(name, i, F.lit(length))))).alias("stem"))
    return pieces.join(stems, "stem").select("rfc", "legal_name", "stem")


def label_reconciliation(schemes: DataFrame, records: DataFrame, amounts: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Each labelled amount against the nearest table sum of its own records.

    ``schemes`` (scheme_id, peso_amount), ``records`` (scheme_id, source_table,
    record_id), ``amounts`` (source_table, record_id, amount).
    """
    sums = records.distinct().join(amounts, ["source_table", "record_id"]).where("amount IS NOT NULL").groupBy("scheme_id", "source_table").agg(
        F.sum(money("amount")).cast("double").alias("s"))
    gap = F.abs(F.col("peso_amount") - F.col("s"))
    best = schemes.join(sums, "scheme_id").groupBy("scheme_id").agg(F.min(F.struct(gap.alias("gap"), F.col("source_table").alias("t"), "s")).alias("b"))
    ok = F.coalesce(F.col("b.gap") <= F.lit(tolerance) * F.greatest(F.col("b.s"), F.lit(1.0)), F.lit(False))
    return schemes.join(best, "scheme_id", "left").select(
        "scheme_id", "peso_amount", F.col("b.t").alias("best_table"), F.col("b.s").alias("best_sum"), ok.alias("reconciles"))


#: Every check of ``all_violations`` and the table it is about.
CHECKS = (
    ("invoice_arithmetic", "invoices"), ("ledger_balance_per_invoice", "ledger"), ("ledger_balance_total", "ledger"),
    ("ledger_without_invoices", "ledger"), ("purchase_orders_without_vendors", "purchase_orders"), ("contracts_without_vendors", "contracts"),
    ("account_number_bank_clabe", "vendors"), ("account_number_bank_clabe", "employees"),
    ("account_number_from_clabe", "bank_txns"), ("account_number_to_clabe", "bank_txns"),
    ("outside_period", "invoices"), ("outside_period", "ledger"), ("outside_period", "bank_txns"),
    ("credit_needs_form_99", "invoices"), ("invoice_status", "invoices"), ("listing_status", "efos_list"), ("employee_id_prefix", "employees"),
    ("cancelled_but_settled", "invoices"), ("definitive_listing_not_before_invoices", "efos_list"), ("provisional_listing_not_after_invoices", "efos_list"),
    ("small_order_signed_by_manager", "purchase_orders"), ("invoiced_without_cover", "vendors"), ("invoiced_without_payment", "vendors"),
    ("name_like_a_listed_vendor", "vendors"), ("label_not_reconciled", "schemes"),
)


def _row_checks(estate: Estate, start: str, end: str) -> DataFrame:
    """The checks that a row answers by itself: each table is read once, whatever the number of its checks."""
    def bad_account(column: str) -> Column:
        return ~F.coalesce(account_is_valid(F.col(column)), F.lit(False))

    def outside(column: str) -> Column:
        return (F.col(column) < start) | (F.col(column) > end)

    def not_in(column: str, allowed: tuple[str, ...]) -> Column:
        return ~F.coalesce(F.col(column).isin(*allowed), F.lit(False))

    checks = {
        "invoices": {
            "invoice_arithmetic": F.abs(F.col("total") - (F.col("subtotal") + F.col("iva"))) > 0.011, "outside_period": outside("issue_date"),
            "credit_needs_form_99": (F.col("metodo_pago") == CREDIT_METHOD) & (F.col("forma_pago") != CREDIT_FORM), "invoice_status": not_in("status", STATUSES)},
        "ledger": {"outside_period": outside("date")},
        "bank_txns": {"outside_period": outside("date"), "account_number_from_clabe": bad_account("from_clabe"), "account_number_to_clabe": bad_account("to_clabe")},
        "vendors": {"account_number_bank_clabe": bad_account("bank_clabe")},
        "employees": {"account_number_bank_clabe": bad_account("bank_clabe"), "employee_id_prefix": ~F.col("emp_id").startswith("EMP:")},
        "efos_list": {"listing_status": not_in("status", LIST_STATUSES)},
    }
    parts = []
    for table, named in checks.items():
        hits = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in named.items()]))
        parts.append(estate.table(table).select(F.explode(hits).alias("check_name"), F.lit(table).alias("source_table"),
                                                F.col(TABLES[table][0]).cast("string").alias("record_id")))
    return reduce(DataFrame.unionByName, parts)


def all_violations(estate: Estate, start: str, end: str, company_account: str, manager: str = "Gerente",
                   labels: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """(check_name, source_table, record_id) of all ``CHECKS``; ``labels`` are the arguments of ``label_reconciliation``."""
    timing = listing_timing_profile(estate)
    late = timing.where("status = 'definitivo' AND placement <> 'all after'")
    early = timing.where("status = 'presunto' AND placement <> 'all before'")
    managers = estate.employees.where(F.col("role").startswith(manager)).select(F.col("name").alias("approver")).distinct()
    small = estate.purchase_orders.where("amount < 100000").join(managers, "approver", "left_semi")
    trail = paper_trail(estate, company_account).distinct()
    parts = [
        _row_checks(estate, start, end), ledger_balance(estate), referential_integrity(estate), cancelled_but_settled(estate),
        _rows(late, "definitive_listing_not_before_invoices", "efos_list"), _rows(early, "provisional_listing_not_after_invoices", "efos_list"),
        _rows(small, "small_order_signed_by_manager", "purchase_orders"),
        _rows(trail.where("NOT has_cover"), "invoiced_without_cover", "vendors"), _rows(trail.where("NOT is_paid"), "invoiced_without_payment", "vendors"),
        _rows(similar_name_vendors(estate).select("rfc").distinct(), "name_like_a_listed_vendor", "vendors"),
    ]
    if labels is not None:
        parts.append(_rows(label_reconciliation(*labels).where("NOT reconciles"), "label_not_reconciled", "schemes", "scheme_id"))
    return reduce(DataFrame.unionByName, parts)


def audit_report(violations: DataFrame, samples: int = 5, checks: tuple[tuple[str, str], ...] = CHECKS) -> DataFrame:
    """(check_name, source_table, violations, first_id, sample_ids): one row per check, also of those without a violation.

    ``sample_ids`` are the ``samples`` smallest different ids. Each task hands on no more than that for a
    check, however many rows violate it.
    """
    check = ["check_name", "source_table"]
    violations = durable(violations)
    counts = violations.groupBy(*check).agg(F.count(F.lit(1)).alias("violations"))
    least = top_rows(violations.distinct(), check, [F.col("record_id")], samples, "place")
    picked = least.groupBy(*check).agg(F.sort_array(F.collect_list("record_id")).alias("sample_ids"))
    known = violations.sparkSession.createDataFrame(list(checks), "check_name string, source_table string")
    out = known.join(counts, check, "full_outer").join(picked, check, "left")
    return out.select(*check, F.coalesce("violations", F.lit(0)).alias("violations"), F.get("sample_ids", F.lit(0)).alias("first_id"),
                      F.coalesce("sample_ids", F.array().cast("array<string>")).alias("sample_ids"))
