"""What the evidence of a case is worth before anyone reads it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.functions.clean import money, observation_id
from auditweave.operators import detectors
from auditweave.operators.graph import date_span_days
from auditweave.operators.lookups import KEY_CHARS
from auditweave.operators.observations import member_digest, with_guidance
from auditweave.session import durable
from auditweave.sources.estate import Estate

REF = ["source_table", "record_id"]


def evidence_independence(refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases, shared): distinct records under each case, and records that serve twice.

    ``refs`` has (case_id, evidence_id, produced_by, source_table, record_id).
    Producers are few names; evidence items are counted, not gathered.
    """
    once = refs.groupBy("case_id", *REF, "evidence_id").agg(F.collect_set("produced_by").alias("by"))
    per_record = once.groupBy("case_id", *REF).agg(
        F.count(F.lit(1)).alias("evidence_count"), F.min("evidence_id").alias("first_evidence"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("by")))).alias("detectors"))
    records = per_record.groupBy("case_id").agg(F.count(F.lit(1)).alias("distinct_records"))
    items = refs.select("case_id", "evidence_id").distinct().groupBy("case_id").agg(F.count(F.lit(1)).alias("evidence_items"))
    shared = per_record.where((F.col("evidence_count") > 1) | (F.size("detectors") > 1))
    return records.join(items, "case_id"), shared


def evidence_dependencies(refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, records): sets of evidence items that share a record, and the records of each set.

    A set is known by its size and two order-free sums of 64-bit hashes, so it
    takes one small row whatever its size. Its items are the evidence of its first record.
    """
    once = refs.select("case_id", "evidence_id", *REF).distinct()

    def digest(seed: int):
        return F.sum(F.xxhash64("evidence_id", F.lit(seed)).cast("decimal(38,0)"))

    sets = once.groupBy("case_id", *REF).agg(
        F.count(F.lit(1)).alias("items"), F.min("evidence_id").alias("first_item"), F.max("evidence_id").alias("last_item"),
        digest(1).alias("d1"), digest(2).alias("d2")).where("items > 1")
    key = ["case_id", "items", "first_item", "last_item", "d1", "d2"]
    groups = sets.groupBy(*key).agg(F.count(F.lit(1)).alias("shared_records"), F.min(F.struct(*REF)).alias("first_record"))
    groups = groups.select("case_id", "items", "first_item", "last_item", "shared_records",
                           F.concat_ws(".", "first_record.source_table", "first_record.record_id").alias("first_record"), "d1", "d2")
    return groups, sets.select("case_id", *REF, "items", "first_item", "d1", "d2")


def dependency_sets(refs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, items, records): the sets of evidence items that share a record, with their members as rows.

    ``sets`` has (case_id, set_id, items, shared_records), ``items`` (case_id, set_id, evidence_id),
    ``records`` (case_id, set_id, source_table, record_id). Records with equal item sets meet by an order-free
    digest; the items of each record are then compared one by one with those of the set's first
    record, and a record that only shares the digest gets a set of its own.
    """
    once = durable(refs.select("case_id", *REF, "evidence_id").distinct())
    held = once.groupBy("case_id", *REF).agg(F.count(F.lit(1)).alias("items"), member_digest("evidence_id").alias("digest")).where("items > 1")
    digest = observation_id("SET", "EVIDENCE", ["case_id", "items", "digest"])
    held = durable(held.select("case_id", *REF, "items", digest.alias("set_id")))
    first = held.groupBy("case_id", "set_id").agg(F.min(F.struct(*REF)).alias("r")).select("case_id", "set_id", "r.*")
    members = once.join(held.select("case_id", *REF, "set_id"), ["case_id", *REF])
    of_first = members.join(first, ["case_id", "set_id", *REF], "left_semi").select("case_id", "set_id", "evidence_id")
    # A record has as many items as its set, so one that is not among the set's is enough to tell it apart.
    strange = members.join(of_first, ["case_id", "set_id", "evidence_id"], "left_anti").select("case_id", *REF).distinct()
    own = F.concat_ws("-", "set_id", "source_table", "record_id")
    records = held.join(strange.withColumn("__strange", F.lit(True)), ["case_id", *REF], "left").withColumn(
        "set_id", F.when(F.col("__strange"), own).otherwise(F.col("set_id")))
    records = durable(records.select("case_id", "set_id", *REF, "items"))
    sets = records.groupBy("case_id", "set_id").agg(F.max("items").alias("items"), F.count(F.lit(1)).alias("shared_records"))
    named = records.groupBy("case_id", "set_id").agg(F.min(F.struct(*REF)).alias("r")).select("case_id", "set_id", "r.*")
    items = once.join(named, ["case_id", *REF]).select("case_id", "set_id", "evidence_id")
    return sets, items, records.drop("items")


def absence_claims(actions: DataFrame) -> DataFrame:
    """Lookups that found nothing, and lookups that failed; neither proves an absence."""
    empty = F.col("success") & (F.col("produced") == 0)
    kind = F.when(empty, "no record in the supplied books").when(~F.col("success"), "the lookup did not run")
    return actions.withColumn("conclusion", kind).where("conclusion IS NOT NULL").select("case_id", "step", "action_name", "conclusion")


def cycle_continuity(cycles: DataFrame) -> DataFrame:
    """How far each circle is from one sum going round. No threshold is applied."""
    low, high = F.array_min("amounts"), F.array_max("amounts")
    return cycles.select(
        "observation_id", F.size("amounts").cast("bigint").alias("legs"), F.sort_array("amounts").alias("amounts"),
        F.when(low > 0, F.round(high / low, 4)).alias("largest_to_smallest"),
        F.when(low > 0, F.round((high - low) / high, 4)).alias("relative_spread"),
        date_span_days(F.col("dates")).alias("date_span_days"))


def shared_identifier_claims(pairs: DataFrame, shared: DataFrame, transfers: DataFrame) -> DataFrame:
    """Shared accounts, with whether money also moved between the same two parties."""
    moved = transfers.select("rfc", "emp_id").distinct().withColumn("moved", F.lit(True))
    mixed = pairs.join(moved, ["rfc", "emp_id"], "left").select(
        "observation_id", F.lit("vendor_employee_shared_clabe").alias("signal_type"), F.coalesce("moved", F.lit(False)).alias("transfer_observed"))
    vendors = shared.select("observation_id", F.lit("shared_vendor_clabe").alias("signal_type"), F.lit(False).alias("transfer_observed"))
    return mixed.unionByName(vendors)


def score_semantics_audit(heads: DataFrame) -> DataFrame:
    """Scored observations; a score without a declared meaning cannot be read."""
    declared = F.length(F.trim(F.coalesce("score_semantics", F.lit("")))) > 0
    return heads.where("score IS NOT NULL").select("observation_id", "detector_name", "score", declared.alias("semantics_declared"))


def declared_alternatives(heads: DataFrame) -> DataFrame:
    """Observations whose detector states limits, alternatives or checks."""
    parts = ["limitations", "legitimate_alternatives", "recommended_checks"]
    told = with_guidance(heads)
    return told.where(reduce(lambda a, b: a | b, [F.size(p) > 0 for p in parts])).select("observation_id", "signal_type", "statement", *parts)


def case_briefing(independence: DataFrame, absences: DataFrame, members: DataFrame, cycles: DataFrame, shared: DataFrame,
                  scores: DataFrame) -> DataFrame:
    """One row per case that sums up the analyses above; details stay in their own tables.

    ``members`` maps (case_id, observation_id).
    """
    def per_case(df: DataFrame, *aggs) -> DataFrame:
        return df.join(members, "observation_id").groupBy("case_id").agg(*aggs)

    n = F.count(F.lit(1))
    gaps = absences.groupBy("case_id").agg(F.count(F.when(F.col("conclusion").startswith("no record"), 1)).alias("empty_lookups"), n.alias("absences"))
    circle = per_case(cycles, n.alias("cycles"), F.min("relative_spread").alias("closest_spread"))
    ident = per_case(shared, n.alias("shared_identifiers"), F.count(F.when(F.col("transfer_observed"), 1)).alias("with_transfer"))
    score = per_case(scores, n.alias("scores"), F.count(F.when(~F.col("semantics_declared"), 1)).alias("undeclared_scores"))
    df = independence
    for part in (gaps, circle, ident, score):
        df = df.join(part, "case_id", "left")
    counts = ["empty_lookups", "absences", "cycles", "shared_identifiers", "with_transfer", "scores", "undeclared_scores"]
    df = df.na.fill(0, counts)
    return df.select("case_id", F.struct("distinct_records", "evidence_items").alias("independence"),
                     F.struct("empty_lookups", "absences").alias("absence"), F.struct("cycles", "closest_spread").alias("continuity"),
                     F.struct("shared_identifiers", "with_transfer").alias("identifiers"), F.struct("scores", "undeclared_scores").alias("scores"))


def record_consumers(estate: Estate, minimum: int = 3) -> DataFrame:
    """Records that ``minimum`` or more analyses read. Analyses are a short fixed list."""
    vendors, employees, bank, invoices = estate.vendors, estate.employees, estate.bank_txns, estate.invoices
    pairs = detectors.vendor_employee_shared_account(estate)
    listed = estate.efos_list.select("rfc").distinct()
    on_account = vendors.select("bank_clabe").distinct()
    staff_account = employees.select("bank_clabe").distinct()
    from auditweave.operators.graph import simple_cycles, transfer_edges

    cycles = simple_cycles(transfer_edges(bank)).select("accounts", F.posexplode("accounts").alias("i", "src"))
    arcs = cycles.select("src", F.element_at("accounts", (F.col("i") + 1) % F.size("accounts") + 1).alias("dst")).distinct()
    shared_staff = employees.join(on_account, "bank_clabe", "left_semi")
    moved = bank.join(on_account.withColumnRenamed("bank_clabe", "from_clabe"), "from_clabe", "left_semi").join(
        staff_account.withColumnRenamed("bank_clabe", "to_clabe"), "to_clabe", "left_semi")
    circled = bank.join(arcs, (bank.from_clabe == arcs.src) & (bank.to_clabe == arcs.dst), "left_semi")
    issued = invoices.join(listed.withColumnRenamed("rfc", "issuer_rfc"), "issuer_rfc", "left_semi")
    uses = [
        (vendors, "vendors", "rfc", "graph"), (vendors.join(listed, "rfc", "left_semi"), "vendors", "rfc", "efos_match"),
        (vendors.join(listed, "rfc", "left_semi"), "vendors", "rfc", "efos_timing"), (pairs, "vendors", "rfc", "shared_account"),
        (detectors.shared_vendor_account(estate)[1], "vendors", "rfc", "shared_vendor_account"),
        (employees, "employees", "emp_id", "graph"), (shared_staff, "employees", "emp_id", "shared_account"),
        (shared_staff, "employees", "emp_id", "employee_transfer"),
        (bank, "bank_txns", "txn_id", "transfer_multigraph"), (bank, "bank_txns", "txn_id", "graph"),
        (moved, "bank_txns", "txn_id", "employee_transfer"), (circled, "bank_txns", "txn_id", "cycles"),
        (invoices, "invoices", "uuid", "invoice_cluster"), (issued, "invoices", "uuid", "efos_timing"), (issued, "invoices", "uuid", "reconciliation"),
    ]
    rows = [df.select(F.lit(t).alias("source_table"), F.col(k).alias("record_id"), F.lit(a).alias("analysis")) for df, t, k, a in uses]
    per_record = reduce(DataFrame.unionByName, rows).groupBy(*REF).agg(F.sort_array(F.collect_set("analysis")).alias("analyses"))
    return per_record.where(F.size("analyses") >= minimum)


def same_money_groups(estate: Estate) -> DataFrame:
    """One event in three tables: an invoice, its ledger rows, the transfer that quotes it."""
    booked = estate.ledger.where("invoice_uuid IS NOT NULL").groupBy(F.col("invoice_uuid").alias("uuid")).agg(
        F.count(F.lit(1)).alias("ledger_rows"), F.sum(money("debit")).cast("double").alias("ledger_debit"))
    key = F.substring("uuid", 1, KEY_CHARS)
    moved = estate.bank_txns.select(F.substring("reference", -KEY_CHARS, KEY_CHARS).alias("k"), "txn_id", "amount").groupBy("k").agg(
        F.count(F.lit(1)).alias("transfers"), F.min("txn_id").alias("first_txn_id"))
    df = estate.invoices.select("uuid", "total", key.alias("k")).join(booked, "uuid", "left").join(moved, "k", "left").drop("k")
    return df.na.fill(0, ["ledger_rows", "transfers"]).where("ledger_rows > 0 OR transfers > 0")
