"""Rule detectors (D1-D9): matches as tables, then the observations they make."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditweave.functions.clean import clean_text, entity_prefix, money, observation_id, sum_money, to_date, to_number
from auditweave.operators import graph
from auditweave.operators.lookups import KEY_CHARS, SETTLEMENT_PREFIX, settlements
from auditweave.operators.observations import (
    Observations, make_entities, make_heads, make_refs, member_digest, union_observations,
)
from auditweave.operators.ordering import exact_quantiles, positions, running_max
from auditweave.session import durable, send_with_tasks
from auditweave.sources.estate import Estate

send_with_tasks(__name__)

# Fixed values.
TABULAR, RELATIONAL, UNSUPPORTED = (
    "deterministic_tabular", "deterministic_relational", "detect_unsupported_paid_vendor_invoices",
)


def _accounts(frame: DataFrame, key: str) -> DataFrame:
    return frame.select(clean_text(key).alias(key), clean_text("bank_clabe").alias("account")).dropna().distinct()


def _rfc(column: str = "rfc"):
    return F.concat(F.lit("RFC:"), F.col(column))


def _account(column: str = "account"):
    return F.concat(F.lit("CLABE:"), F.col(column))


# D1

def vendor_employee_shared_account(estate: Estate) -> DataFrame:
    pairs = _accounts(estate.vendors, "rfc").join(_accounts(estate.employees, "emp_id"), "account")
    return pairs.withColumn("observation_id", observation_id("DET", "VENDOR-EMPLOYEE-CLABE", ["rfc", "emp_id", "account"]))


def observe_shared_account(pairs: DataFrame) -> Observations:
    text = F.format_string("Vendor %s and employee %s are recorded with the same account.", "rfc", "emp_id")
    return Observations(
        make_heads(pairs, TABULAR, "vendor_employee_shared_clabe", text, ["rfc", "emp_id", "account"]),
        make_entities(pairs, (0, _rfc()), (1, entity_prefix("EMP:", "emp_id")), (2, _account())),
        make_refs(pairs, ("vendors", F.col("rfc")), ("employees", F.col("emp_id"))),
    )


def account_owners(estate: Estate) -> DataFrame:
    """(account, role, owner): every vendor and employee recorded with an account, one row each."""
    vendors = _accounts(estate.vendors, "rfc").select("account", F.lit("vendor").alias("role"), F.col("rfc").alias("owner"))
    staff = _accounts(estate.employees, "emp_id").select("account", F.lit("employee").alias("role"), F.col("emp_id").alias("owner"))
    return vendors.unionByName(staff)


def _owner_sets(owners: DataFrame) -> DataFrame:
    """Per account: how many vendors and employees own it, the first of each, and their digest in no order."""
    def of(role: str, name: str):
        return F.count(F.when(F.col("role") == role, 1)).alias(f"{name}_count"), F.min(F.when(F.col("role") == role, F.col("owner"))).alias(f"first_{name}")

    named = owners.withColumn("__member", F.concat_ws(":", "role", "owner"))
    return named.groupBy("account").agg(*of("vendor", "vendor"), *of("employee", "employee"), member_digest("__member").alias("digest"))


def shared_account_groups(estate: Estate) -> tuple[DataFrame, DataFrame]:
    """(groups, members): accounts of vendors and employees together, and their owners one per row.

    n vendors and m employees of an account take n + m rows here; ``vendor_employee_shared_account``
    gives the n * m pairs.
    """
    owners = account_owners(estate)
    groups = _owner_sets(owners).where("vendor_count > 0 AND employee_count > 0")
    groups = groups.withColumn("observation_id", observation_id("DET", "ACCOUNT-OWNERS", ["account", "vendor_count", "employee_count", "digest"]))
    return groups.drop("digest"), owners.join(groups.select("account", "observation_id"), "account")


def observe_account_groups(groups: DataFrame, members: DataFrame) -> Observations:
    """The same signal as ``observe_shared_account``, with one head per account."""
    text = F.format_string("One account is recorded for %d vendor(s) and %d employee(s).", "vendor_count", "employee_count")
    vendors, staff = (members.where(F.col("role") == role) for role in ("vendor", "employee"))
    return Observations(
        make_heads(groups, TABULAR, "vendor_employee_shared_clabe", text, ["account", "vendor_count", "employee_count", "first_vendor", "first_employee"]),
        make_entities(vendors, (0, _rfc("owner"))).unionByName(make_entities(staff, (1, entity_prefix("EMP:", "owner")))).unionByName(
            make_entities(groups, (2, _account()))),
        make_refs(vendors, ("vendors", F.col("owner"))).unionByName(make_refs(staff, ("employees", F.col("owner")))),
    )


# D2

def shared_vendor_account(estate: Estate) -> tuple[DataFrame, DataFrame]:
    """(accounts, members): accounts of two or more vendors, and their vendors one per row."""
    held = _accounts(estate.vendors, "rfc")
    shared = held.groupBy("account").agg(
        F.count(F.lit(1)).alias("vendor_count"), F.min("rfc").alias("first_rfc"), member_digest("rfc").alias("digest")
    ).where("vendor_count >= 2")
    shared = shared.withColumn("observation_id", observation_id("DET", "SHARED-VENDOR-CLABE", ["account", "vendor_count", "digest"]))
    return shared.drop("digest"), held.join(shared.select("account", "observation_id"), "account")


def observe_shared_vendors(shared: DataFrame, members: DataFrame) -> Observations:
    text = F.format_string("One account is recorded for %d vendors.", "vendor_count")
    return Observations(
        make_heads(shared, TABULAR, "shared_vendor_clabe", text, ["account", "vendor_count", "first_rfc"]),
        make_entities(shared, (0, _account())).unionByName(make_entities(members, (1, _rfc()))),
        make_refs(members, ("vendors", F.col("rfc"))),
    )


# D3

def efos_vendor_match(estate: Estate) -> DataFrame:
    """Listed vendors. Statuses and dates come from small sets of values, so they stay arrays."""
    vendors = estate.vendors.select(clean_text("rfc").alias("rfc")).dropna().distinct()
    listed = estate.efos_list.withColumn("rfc", clean_text("rfc")).join(vendors, "rfc", "left_semi").groupBy("rfc").agg(
        F.sort_array(F.collect_set(clean_text("status"))).alias("statuses"),
        F.sort_array(F.collect_set(clean_text("publication_date"))).alias("publication_dates"),
    )
    parts = F.concat(F.array("rfc"), "statuses", "publication_dates")
    return listed.withColumn("observation_id", observation_id("DET", "EFOS-MATCH", [F.array_join(parts, "|")]))


def observe_listed_vendors(listed: DataFrame) -> Observations:
    text = F.format_string("Vendor %s is on the tax listing supplied with the books.", "rfc")
    return Observations(
        make_heads(listed, TABULAR, "vendor_efos_record_match", text, ["rfc", "statuses", "publication_dates"]),
        make_entities(listed, (0, _rfc())),
        make_refs(listed, ("vendors", F.col("rfc")), ("efos_list", F.col("rfc"))),
    )


# D4

def vendor_to_employee_transfer(estate: Estate) -> DataFrame:
    moved = estate.bank_txns.select(
        clean_text("txn_id").alias("txn_id"), clean_text("from_clabe").alias("vendor_account"),
        clean_text("to_clabe").alias("employee_account"), to_number("amount").alias("amount"), clean_text("date").alias("date"),
    ).dropna(subset=["txn_id", "vendor_account", "employee_account", "amount"])
    vendors = _accounts(estate.vendors, "rfc").withColumnRenamed("account", "vendor_account")
    employees = _accounts(estate.employees, "emp_id").withColumnRenamed("account", "employee_account")
    # Payees first: the company's own account pays most transfers, so all of them would meet at its key.
    hits = moved.join(employees, "employee_account").join(vendors, "vendor_account").select(
        "employee_account", "vendor_account", "txn_id", "amount", "date", "rfc", "emp_id")
    return hits.withColumn("observation_id", observation_id("DET", "VENDOR-TO-EMPLOYEE", ["rfc", "emp_id", "txn_id"]))


def observe_employee_transfer(hits: DataFrame) -> Observations:
    text = F.format_string("A transfer runs from the account of vendor %s to the account of employee %s.", "rfc", "emp_id")
    return Observations(
        make_heads(hits, RELATIONAL, "vendor_to_employee_bank_transfer", text, ["rfc", "emp_id", "txn_id", "date", "amount"]),
        make_entities(hits, (0, _rfc()), (1, entity_prefix("EMP:", "emp_id")),
                      (2, _account("vendor_account")), (3, _account("employee_account"))),
        make_refs(hits, ("vendors", F.col("rfc")), ("employees", F.col("emp_id")), ("bank_txns", F.col("txn_id"))),
    )


def transfer_groups(estate: Estate) -> tuple[DataFrame, DataFrame]:
    """(transfers, members): transfers from accounts of vendors to accounts of employees, and the owners of both.

    One row per transfer however many own its accounts, and one row per (account, side, owner) however
    many transfers it has; ``vendor_to_employee_transfer`` gives every vendor-employee pair of every transfer.
    """
    owners = account_owners(estate)
    sets = _owner_sets(owners)
    moved = estate.bank_txns.select(
        clean_text("txn_id").alias("txn_id"), clean_text("from_clabe").alias("vendor_account"),
        clean_text("to_clabe").alias("employee_account"), to_number("amount").alias("amount"), clean_text("date").alias("date"),
    ).dropna(subset=["txn_id", "vendor_account", "employee_account", "amount"])
    payers = sets.where("vendor_count > 0").select(F.col("account").alias("vendor_account"), "vendor_count", F.col("digest").alias("payer_digest"))
    payees = sets.where("employee_count > 0").select(F.col("account").alias("employee_account"), "employee_count", F.col("digest").alias("payee_digest"))
    found = moved.join(payers, "vendor_account").join(payees, "employee_account")
    found = found.withColumn("observation_id", observation_id("DET", "ACCOUNT-TRANSFER", ["txn_id", "payer_digest", "payee_digest"]))
    sides = found.select(F.inline(F.array(
        F.struct(F.col("vendor_account").alias("account"), F.lit("vendor").alias("role")),
        F.struct(F.col("employee_account").alias("account"), F.lit("employee").alias("role"))))).distinct()
    return found.drop("payer_digest", "payee_digest"), owners.join(sides, ["account", "role"])


def observe_transfer_groups(transfers: DataFrame, members: DataFrame) -> Observations:
    """The same signal as ``observe_employee_transfer``, with one head per transfer."""
    text = F.format_string("A transfer runs from an account of %d vendor(s) to an account of %d employee(s).", "vendor_count", "employee_count")
    key = transfers.select("observation_id", "vendor_account", "employee_account")
    payers = key.withColumnRenamed("vendor_account", "account").join(members.where("role = 'vendor'"), "account")
    payees = key.withColumnRenamed("employee_account", "account").join(members.where("role = 'employee'"), "account")
    return Observations(
        make_heads(transfers, RELATIONAL, "vendor_to_employee_bank_transfer", text,
                   ["txn_id", "date", "amount", "vendor_account", "employee_account", "vendor_count", "employee_count"]),
        make_entities(payers, (0, _rfc("owner"))).unionByName(make_entities(payees, (1, entity_prefix("EMP:", "owner")))).unionByName(
            make_entities(transfers, (2, _account("vendor_account")), (3, _account("employee_account")))),
        make_refs(payers, ("vendors", F.col("owner"))).unionByName(make_refs(payees, ("employees", F.col("owner")))).unionByName(
            make_refs(transfers, ("bank_txns", F.col("txn_id")))),
    )


# D5

def similar_invoice_cluster(
    estate: Estate, min_count: int = 3, window_days: int = 7, max_spread: float = 0.03
) -> tuple[DataFrame, DataFrame]:
    """(clusters, members): maximal runs of like invoices inside ``window_days``.

    All invoices of one day share their window, so windows are built from daily
    totals, each from the rows of its days; a day enters at most window_days + 1 of them. Windows that can still pass
    get their median from the days' histograms: amounts and how often they occur are
    added up over the window, and the middle one is found by running totals, so
    neither the invoices nor the amounts of a window meet in one task.
    """
    if min_count < 2 or window_days < 0 or max_spread < 0:
        raise ValueError("bad cluster parameters")
    pair = ["issuer_rfc", "receiver_rfc"]
    rows = estate.invoices.select(
        clean_text("uuid").alias("uuid"), *[clean_text(c).alias(c) for c in pair],
        to_date("issue_date").alias("day"), to_number("total").alias("total"),
    ).dropna().where("total > 0")
    # Read for the days, the histograms and the members, so written once.
    rows = durable(rows.groupBy("uuid").agg(F.min(F.struct(*pair, "day", "total")).alias("r")).select("uuid", "r.*"))
    daily = rows.groupBy(*pair, "day").agg(
        F.count(F.lit(1)).alias("n"), F.min("total").alias("low"), F.max("total").alias("high"),
        F.sum(money("total")).alias("money"), member_digest("uuid").cast("decimal(38,0)").alias("digest")
    )
    # A window opens on a day with an invoice. A pair has one row per day, so its rows are days of a calendar.
    ahead = Window.partitionBy(*pair).orderBy(F.unix_date("day")).rangeBetween(Window.currentRow, window_days)
    windows = daily.select(
        *pair, F.col("day").alias("start"), F.sum("n").over(ahead).alias("invoice_count"), F.min("low").over(ahead).alias("low"),
        F.max("high").over(ahead).alias("high"), F.max("day").over(ahead).alias("last_day"),
        F.sum("money").over(ahead).cast("double").alias("cluster_total"),
        F.sum("digest").over(ahead).cast("decimal(38,0)").cast("string").alias("digest"),
    )
    # The median is at most the largest amount, so this loses no window.
    hopeful = durable(windows.where((F.col("invoice_count") >= min_count)
                                    & (F.col("high") - F.col("low") <= max_spread * F.col("high"))))
    days = hopeful.select(*pair, "start", F.explode(F.sequence(F.col("start"), F.col("last_day"))).alias("day"))
    histograms = rows.join(days.select(*pair, "day").distinct(), [*pair, "day"], "left_semi").groupBy(*pair, "day", "total").agg(F.count(F.lit(1)).alias("n"))
    medians = exact_quantiles(histograms.join(days, [*pair, "day"]), [*pair, "start"], "total", [0.5], weight="n").withColumnRenamed("q50", "median_total")
    spread = (F.col("high") - F.col("low")) / F.col("median_total")
    candidates = hopeful.join(medians, [*pair, "start"]).withColumn("relative_spread", spread).where(
        (F.col("median_total") > 0) & (F.col("relative_spread") <= max_spread)
    )
    # Starts per pair are days of a calendar; a later window can only lie inside an earlier one.
    earlier = Window.partitionBy(*pair).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    kept = candidates.withColumn("reach", F.max("last_day").over(earlier)).where("reach IS NULL OR reach < last_day")
    clusters = kept.withColumn(
        "observation_id", observation_id("REL", "INVOICE-CLUSTER", [*pair, F.col("start").cast("string"), "invoice_count", "digest"])
    ).select("observation_id", *pair, F.col("start").cast("string").alias("first_issue_date"),
             F.col("last_day").cast("string").alias("last_issue_date"), "invoice_count", "cluster_total",
             "median_total", "relative_spread")
    spans = clusters.select("observation_id", *pair, F.explode(
        F.sequence(F.to_date("first_issue_date"), F.to_date("last_issue_date"))).alias("day"))
    return clusters, rows.join(spans, [*pair, "day"]).select("observation_id", *pair, "uuid", "total")


def observe_clusters(clusters: DataFrame, members: DataFrame) -> Observations:
    text = F.format_string("%d invoices from %s to %s between %s and %s have like totals.", "invoice_count",
                           "issuer_rfc", "receiver_rfc", "first_issue_date", "last_issue_date")
    facts = ["issuer_rfc", "receiver_rfc", "invoice_count", "first_issue_date", "last_issue_date", "cluster_total", "relative_spread"]
    return Observations(
        make_heads(clusters, RELATIONAL, "short_window_similar_invoice_cluster", text, facts),
        make_entities(clusters, (0, _rfc("issuer_rfc")), (1, _rfc("receiver_rfc"))),
        make_refs(members, ("invoices", F.col("uuid"))),
    )


# D6, D7

def account_owner_entities(estate: Estate) -> DataFrame:
    """(account, entity), one row per recorded owner."""
    vendors = _accounts(estate.vendors, "rfc").select("account", _rfc().alias("entity"))
    employees = _accounts(estate.employees, "emp_id").select("account", entity_prefix("EMP:", "emp_id").alias("entity"))
    return vendors.unionByName(employees).distinct()


def bank_cycle_observation(estate: Estate, max_len: int = 4, max_cycles: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(cycles, entities): owners in cycle order first, then the accounts."""
    cycles = graph.bank_cycles(graph.transfer_edges(estate.bank_txns), max_len, max_cycles)
    parts = F.array_join(F.concat("accounts", "txn_ids"), "|")
    cycles = durable(cycles.withColumn("observation_id", observation_id("REL", "BANK-CYCLE", [parts])))
    legs = cycles.select("observation_id", F.posexplode("accounts").alias("leg", "account"))
    owners = legs.join(account_owner_entities(estate), "account").groupBy("observation_id", "entity").agg(
        F.min("leg").alias("section")
    )
    accounts = legs.select("observation_id", _account().alias("entity"), (F.lit(1000) + F.col("leg")).alias("section"))
    return cycles, owners.unionByName(accounts).select("observation_id", F.col("section").cast("int"), "entity")


def observe_cycles(cycles: DataFrame, entities: DataFrame) -> Observations:
    text = F.format_string("Recorded transfers close a circle over %d accounts.", F.size("accounts"))
    facts = ["accounts", "txn_ids", "dates", "amounts", "date_span_days"]
    refs = cycles.select("observation_id", F.lit("bank_txns").alias("source_table"), F.explode("txn_ids").alias("record_id"),
                         F.lit(None).cast("string").alias("note"))
    return Observations(make_heads(cycles, RELATIONAL, "directed_bank_transfer_cycle", text, facts), entities, refs)


# D8

def unsupported_candidates(estate: Estate, prefix: str = SETTLEMENT_PREFIX) -> tuple[DataFrame, DataFrame]:
    """(invoices, orders): settled invoices and orders of vendors that have no contract."""
    in_scope = estate.vendors.select(clean_text("rfc").alias("rfc")).dropna().distinct().join(
        estate.contracts.select(clean_text("vendor_rfc").alias("rfc")), "rfc", "left_anti"
    )
    invoices = estate.invoices.select(
        clean_text("issuer_rfc").alias("rfc"), clean_text("uuid").alias("uuid"), F.round(to_number("total"), 2).alias("total"),
        F.lower(F.coalesce(clean_text("status"), F.lit(""))).alias("status"),
    ).where("uuid IS NOT NULL AND total IS NOT NULL AND status <> 'cancelado'").drop("status")
    invoices = invoices.join(in_scope, "rfc", "left_semi").withColumn("uuid_key", F.substring("uuid", 1, KEY_CHARS))
    invoices = invoices.join(settlements(estate, prefix).select("uuid_key").distinct(), "uuid_key", "left_semi")
    orders = estate.purchase_orders.select(
        clean_text("vendor_rfc").alias("rfc"), F.col("po_id"), F.round(to_number("amount"), 2).alias("amount")
    ).where("amount IS NOT NULL").join(in_scope, "rfc", "left_semi")
    return invoices.select("rfc", "uuid", "total"), orders


def _reach(total):
    """How far an order may lie from an invoice of that total."""
    return np.maximum(0.02 * total, 1.0)


def first_fit(totals: np.ndarray, amounts: np.ndarray) -> list[tuple[int, int]]:
    """(i, j): each total in turn takes the first free amount within its reach.

    The amounts in reach are a range of the sorted amounts; a tree of minima over them gives
    the first free one, so n totals take n log n steps.
    """
    order = np.argsort(amounts, kind="stable")
    held = amounts[order]
    leaves, none = 1 << max(len(held) - 1, 0).bit_length(), len(held)
    tree = [none] * (2 * leaves)
    tree[leaves:leaves + len(held)] = order.tolist()
    for at in range(leaves - 1, 0, -1):
        tree[at] = min(tree[2 * at], tree[2 * at + 1])
    place = np.empty(len(held), np.int64)
    place[order] = np.arange(len(held))
    far = _reach(totals)
    lows, highs = np.searchsorted(held, totals - far, "left"), np.searchsorted(held, totals + far, "right")
    hits: list[tuple[int, int]] = []
    for i, total in enumerate(totals.tolist()):
        low, high, reach = int(lows[i]), int(highs[i]), far[i]
        # Sums and differences round apart at the ends of the range; the difference decides.
        while low > 0 and abs(held[low - 1] - total) <= reach:
            low -= 1
        while high < none and abs(held[high] - total) <= reach:
            high += 1
        while low < high and not abs(held[low] - total) <= reach:
            low += 1
        while low < high and not abs(held[high - 1] - total) <= reach:
            high -= 1
        first, low, high = none, low + leaves, high + leaves
        while low < high:
            if low & 1:
                first = min(first, tree[low])
                low += 1
            if high & 1:
                high -= 1
                first = min(first, tree[high])
            low, high = low >> 1, high >> 1
        if first < none:
            hits.append((i, first))
            at = leaves + int(place[first])
            tree[at] = none
            while at > 1:
                at >>= 1
                tree[at] = min(tree[2 * at], tree[2 * at + 1])
    return hits


def _fit_cell(left: pa.Table, right: pa.Table) -> pa.Table:
    """First fit inside one cell: invoices by uuid, orders by id, each order once. Cells are many and small, so no frames are built."""
    left, right = left.take(pc.sort_indices(left["uuid"])), right.take(pc.sort_indices(right["po_id"]))
    hits = first_fit(left["total"].to_numpy(), right["amount"].to_numpy()) if len(left) and len(right) else []
    mine = left.take(pa.array([i for i, _ in hits], pa.int64()))
    theirs = right.take(pa.array([j for _, j in hits], pa.int64()))
    return pa.table({"rfc": mine["rfc"], "uuid": mine["uuid"], "po_id": theirs["po_id"]})


_CELL = ["rfc", "island"]


def _islands(invoices: DataFrame, orders: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``island``: invoices of different islands can want no common order.

    Only vendors with more than ``block`` rows on a side are cut. Their invoices' reaches and their orders are
    sorted together by amount; an island begins where no earlier reach goes on, and is known by the
    amount at which it begins. Orders in no reach are left out.
    """
    whole = F.lit(0.0).alias("island")
    counts = [side.groupBy("rfc").agg(F.count(F.lit(1)).alias("n")) for side in (invoices, orders)]
    large = durable(counts[0].unionByName(counts[1]).where(F.col("n") > block).select("rfc").distinct())
    if large.isEmpty():
        return invoices.select("*", whole), orders.select("*", whole)
    far = F.greatest(0.02 * F.col("total"), F.lit(1.0))
    slack = 1e-9 * F.greatest(F.abs("total"), F.lit(1.0))
    reaches = invoices.join(large, "rfc", "left_semi").select(
        "rfc", (F.col("total") - far - slack).alias("key"), F.lit(0).alias("kind"), F.col("uuid").alias("id"), F.col("total").alias("money"),
        (F.col("total") + far + slack).alias("reach"))
    points = orders.join(large, "rfc", "left_semi").select(
        "rfc", F.col("amount").alias("key"), F.lit(1).alias("kind"), F.col("po_id").alias("id"), F.col("amount").alias("money"), F.lit(None).cast("double").alias("reach"))
    order = ["key", "kind", "id"]
    covered = running_max(reaches.unionByName(points), ["rfc"], order, F.col("reach"), "covered")
    covered = covered.where("kind = 0 OR covered >= key").drop("reach")
    begins = F.when((F.col("kind") == 0) & (F.col("covered").isNull() | (F.col("covered") < F.col("key"))), F.col("key"))
    placed = durable(running_max(covered.withColumn("begins", begins), ["rfc"], order, F.col("begins"), "begun"))
    placed = placed.withColumn("island", F.coalesce("begins", "begun"))
    sides = []
    for side, kind, name, money in ((invoices, 0, "uuid", "total"), (orders, 1, "po_id", "amount")):
        cut = placed.where(F.col("kind") == kind).select("rfc", F.col("id").alias(name), F.col("money").alias(money), "island")
        small = side.join(large, "rfc", "left_anti").select("rfc", name, money, whole)
        sides.append(small.unionByName(cut))
    return sides[0], sides[1]


def _blocks(rows: DataFrame, order: str, name: str, block: int) -> DataFrame:
    """Add the number of each row's ordered block within its vendor's island."""
    largest = rows.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= block:
        return rows.withColumn(name, F.lit(0).cast("bigint"))
    placed = positions(rows, _CELL, [order], "p")
    return durable(placed.withColumn(name, F.floor((F.col("p") - 1) / block)).drop("p"))


def match_orders(invoices: DataFrame, orders: DataFrame, block: int = 200_000) -> DataFrame:
    """(rfc, uuid, po_id): the greedy one-to-one match of each vendor, in uuid and po_id order.

    A vendor with more than ``block`` rows is first cut into islands of amounts that want no common
    order; all islands are matched side by side. An island beyond ``block`` rows is cut into ordered
    blocks on both sides: cell (a, b) tries invoice block a on order block b and needs only cells (a, b-1)
    and (a-1, b), the invoices still open after earlier orders, and the orders not taken by earlier invoices.
    All cells with the same a + b run side by side. No task holds more than two blocks.
    """
    invoices, orders = _islands(invoices, orders, block)
    inv, po = _blocks(invoices, "uuid", "a", block), _blocks(orders, "po_id", "b", block)
    depth = inv.groupBy(*_CELL).agg(F.max("a").alias("a")).join(po.groupBy(*_CELL).agg(F.max("b").alias("b")), _CELL)
    last = depth.agg(F.max(F.col("a") + F.col("b"))).first()[0]
    schema = "rfc string, uuid string, po_id string"
    done: list[DataFrame] = []
    for diagonal in range(0 if last is None else last + 1):
        left, right = inv.where(F.col("a") <= diagonal), po.where(F.col("b") <= diagonal)
        right = right.withColumn("a", F.lit(diagonal) - F.col("b"))
        if done:
            taken = reduce(DataFrame.unionByName, done)
            left = left.join(taken, ["rfc", "uuid"], "left_anti")
            right = right.join(taken, ["rfc", "po_id"], "left_anti")
        cells = left.groupBy(*_CELL, "a").cogroup(right.groupBy(*_CELL, "a"))
        done.append(durable(cells.applyInArrow(_fit_cell, schema)))
    if not done:
        return invoices.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, done)


def paid_without_po_or_contract(
    estate: Estate, minimum: int = 3, prefix: str = SETTLEMENT_PREFIX, block: int = 200_000
) -> tuple[DataFrame, DataFrame]:
    """(vendors, members): vendors with ``minimum`` or more settled invoices that match no order."""
    invoices, orders = map(durable, unsupported_candidates(estate, prefix))
    matched = match_orders(invoices, orders, block)
    open_rows = durable(invoices.join(matched, ["rfc", "uuid"], "left_anti"))
    on_file = orders.groupBy("rfc").agg(F.count(F.lit(1)).alias("purchase_orders_on_file"))
    vendors = open_rows.groupBy("rfc").agg(
        F.count(F.lit(1)).alias("unsupported_count"), sum_money("total").alias("unsupported_total")
    ).where(F.col("unsupported_count") >= minimum)
    vendors = vendors.join(on_file, "rfc", "left").na.fill(0, ["purchase_orders_on_file"])
    vendors = vendors.withColumn("observation_id", observation_id("REL", "VENDOR-UNSUPPORTED", ["rfc"]))
    return vendors, open_rows.join(vendors.select("rfc", "observation_id"), "rfc")


def observe_unsupported(vendors: DataFrame, members: DataFrame) -> Observations:
    text = F.format_string("%d settled invoices of vendor %s match no order, and the vendor has no contract on record.",
                           "unsupported_count", "rfc")
    refs = make_refs(vendors, ("vendors", F.col("rfc")), note="Vendor record of the issuer.").unionByName(
        make_refs(members, ("invoices", F.col("uuid")), note="Settled invoice without an order of a like amount."))
    return Observations(
        make_heads(vendors, UNSUPPORTED, "paid_invoices_without_po_or_contract", text,
                   ["rfc", "unsupported_count", "unsupported_total", "purchase_orders_on_file"]),
        make_entities(vendors, (0, _rfc())), refs,
    )


# D9

def run_rule_detectors(estate: Estate, max_spread: float = 0.03, max_cycles: int | None = None, pairs: bool = True) -> Observations:
    """All rule detectors in their fixed order.

    The matches are written once: heads, entities and evidence all read them. With ``pairs`` shared accounts
    and transfers have one head per vendor and employee; without, one per account and per transfer, so
    heads, entities and evidence grow with the owners of an account and not with their product.
    """
    if pairs:
        shared = observe_shared_account(durable(vendor_employee_shared_account(estate)))
        moved = observe_employee_transfer(durable(vendor_to_employee_transfer(estate)))
    else:
        shared = observe_account_groups(*map(durable, shared_account_groups(estate)))
        moved = observe_transfer_groups(*map(durable, transfer_groups(estate)))
    parts = [
        shared,
        observe_shared_vendors(*map(durable, shared_vendor_account(estate))),
        observe_listed_vendors(durable(efos_vendor_match(estate))),
        moved,
        observe_clusters(*map(durable, similar_invoice_cluster(estate, max_spread=max_spread))),
        observe_cycles(*bank_cycle_observation(estate, max_cycles=max_cycles)),
        observe_unsupported(*map(durable, paid_without_po_or_contract(estate))),
    ]
    return union_observations(parts)
