"""The transfer graph: edges, cycles and node features."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave.functions.clean import clean_text, sum_money, to_date, to_number
from auditweave.operators.ordering import exact_quantiles
from auditweave.session import durable
from auditweave.sources.estate import Estate

# Feature names in their published order.
VENDOR_FEATURES = (
    "registered_vendor", "invoice_count", "invoice_total", "invoice_mean", "invoice_std",
    "invoice_active_span_days", "po_count", "po_total", "contract_count", "contract_total",
    "ledger_entry_count", "ledger_debit_total", "ledger_credit_total", "efos_match",
    "bank_total_in", "bank_total_out", "bank_txn_count_in", "bank_txn_count_out", "bank_unique_counterparties",
)
EMPLOYEE_FEATURES = (
    "bank_total_in", "bank_total_out", "bank_txn_count_in", "bank_txn_count_out",
    "bank_unique_counterparties", "vendor_owned_counterparties",
)
ACCOUNT_FEATURES = (
    "total_in", "total_out", "count_in", "count_out", "unique_senders", "unique_receivers",
    "mean_amount_in", "mean_amount_out", "std_amount", "max_abs_amount", "vendor_owner_count", "employee_owner_count",
)
BINARY_FEATURES = ("registered_vendor", "efos_match")
FEATURES = {"vendor": VENDOR_FEATURES, "employee": EMPLOYEE_FEATURES, "account": ACCOUNT_FEATURES}


def transfer_edges(bank: DataFrame) -> DataFrame:
    """Valid transfers, one row each; parallel transfers stay apart."""
    return bank.select(
        clean_text("txn_id").alias("txn_id"), clean_text("from_clabe").alias("src"), clean_text("to_clabe").alias("dst"),
        to_number("amount").alias("amount"), clean_text("date").alias("date"),
        clean_text("reference").alias("reference"), clean_text("channel").alias("channel"),
    ).where("txn_id IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL AND amount IS NOT NULL")


def duplicate_transfers(edges: DataFrame) -> DataFrame:
    """Transfer ids used more than once: provenance would be ambiguous."""
    return edges.groupBy("txn_id").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1")


def transfer_multigraph(bank: DataFrame, named: int = 20) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges). Fails when transfer ids repeat; the message names ``named`` of them, ``duplicate_transfers`` all."""
    edges = transfer_edges(bank)
    repeated = duplicate_transfers(edges).orderBy("txn_id").limit(named).collect()
    if repeated:
        raise ValueError("duplicate txn_id values: " + ", ".join(r.txn_id for r in repeated))
    return transfer_nodes(edges), edges


def transfer_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("account")).union(edges.select("dst")).distinct()


def representative_edges(edges: DataFrame) -> DataFrame:
    """For each (src, dst) the earliest transfer, ties to the smaller id."""
    row = F.struct(F.coalesce("date", F.lit("")).alias("key"), "txn_id", "date", "amount")
    return edges.groupBy("src", "dst").agg(F.min(row).alias("e")).select(
        "src", "dst", F.col("e.txn_id").alias("txn_id"), F.col("e.date").alias("date"), F.col("e.amount").alias("amount")
    )


def date_span_days(dates: Column) -> Column:
    """Days between the first and last date; NULL when any date is unusable."""
    parsed = F.transform(dates, to_date)
    usable = (F.size(parsed) > 0) & F.forall(parsed, lambda d: d.isNotNull())
    return F.when(usable, F.date_diff(F.array_max(parsed), F.array_min(parsed)))


def _can_close(arcs: DataFrame) -> DataFrame:
    """Drop arcs whose source is never entered or whose target is never left."""
    left = arcs.join(arcs.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
    return left.join(arcs.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def simple_cycles(edges: DataFrame, max_len: int = 4) -> DataFrame:
    """(cycle): each simple directed cycle once, as an array that starts at its least account.

    Nodes are ranked by (degree, id) and a cycle is grown from its highest node
    through lower ones only, in two halves that meet. A hub is therefore an end
    of a half and never its middle, so the number of half paths stays near
    edges * sqrt(edges) instead of the square of the hub's degree.
    """
    if max_len < 2:
        raise ValueError("max_len must be at least 2")
    # The arcs are read many times below, so they are worked out once and written.
    arcs = durable(edges.select("src", "dst").where(F.col("src") != F.col("dst")).distinct())
    arcs = durable(_can_close(_can_close(arcs)))
    ends = arcs.select(F.col("src").alias("id")).union(arcs.select("dst"))
    degree = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))

    def ranked(column: str) -> DataFrame:
        node = F.struct("degree", "id")
        return degree.select(F.col("id").alias(column), node.alias(f"{column}_node"))

    arcs = durable(arcs.join(ranked("src"), "src").join(ranked("dst"), "dst").select(
        F.col("src_node").alias("a"), F.col("dst_node").alias("b")
    ))
    forward = {1: arcs.where("a > b").select(F.col("a").alias("top"), F.col("b").alias("end"), F.array("b").alias("out"))}
    backward = {1: arcs.where("a < b").select(F.col("b").alias("top"), F.col("a").alias("end"), F.array("a").alias("back"))}
    for n in range(2, (max_len + 1) // 2 + 1):
        step = forward[n - 1].join(arcs, F.col("end") == F.col("a")).where("b < top AND NOT array_contains(out, b)")
        forward[n] = step.select("top", F.col("b").alias("end"), F.concat("out", F.array("b")).alias("out"))
    for n in range(2, max_len // 2 + 1):
        step = backward[n - 1].join(arcs, F.col("end") == F.col("b")).where("a < top AND NOT array_contains(back, a)")
        backward[n] = step.select("top", F.col("a").alias("end"), F.concat(F.array("a"), "back").alias("back"))
    found = []
    for length in range(2, max_len + 1):
        half = (length + 1) // 2
        met = forward[half].join(backward[length - half], ["top", "end"])
        nodes = F.concat(F.array("top"), "out", F.slice("back", 2, max_len))
        found.append(met.select(nodes.alias("n")).where(F.size(F.array_distinct("n")) == length))
    cycles = reduce(DataFrame.unionByName, found).select(F.transform("n", lambda x: x.id).alias("n"))
    least = F.array_position("n", F.array_min("n")).cast("int")
    turned = F.concat(F.slice("n", least, F.size("n")), F.slice("n", F.lit(1), least - 1))
    return cycles.select(turned.alias("accounts"))


def bank_cycles(edges: DataFrame, max_len: int = 4, max_cycles: int | None = None) -> DataFrame:
    """Cycles with the representative transfer of every arc, in a fixed order.

    Shorter cycles come first, then by accounts; ``max_cycles`` keeps the first ones.
    """
    cycles = simple_cycles(edges, max_len)
    if max_cycles is not None:
        cycles = cycles.orderBy(F.size("accounts"), "accounts").limit(max_cycles)
    legs = cycles.select("accounts", F.posexplode("accounts").alias("leg", "src"))
    after = F.element_at("accounts", (F.col("leg") + 1) % F.size("accounts") + 1)
    legs = legs.withColumn("dst", after)
    # An array holds one entry per leg, so it is never longer than max_len.
    parts = legs.join(representative_edges(edges), ["src", "dst"]).groupBy("accounts").agg(
        F.array_sort(F.collect_list(F.struct("leg", "txn_id", "date", "amount"))).alias("legs")
    )
    dates = F.transform("legs", lambda x: x.date)
    return parts.select(
        "accounts",
        F.transform("legs", lambda x: x.txn_id).alias("txn_ids"),
        dates.alias("dates"),
        F.transform("legs", lambda x: x.amount).alias("amounts"),
        date_span_days(dates).alias("date_span_days"),
    )


def transfer_edge_features(edges: DataFrame) -> DataFrame:
    """Per (src, dst). The records behind an edge are the rows of ``edges`` themselves."""
    day = to_date("date")
    return edges.groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("transfer_count"),
        sum_money("amount").alias("total_amount"),
        (sum_money("amount") / F.count(F.lit(1))).alias("mean_amount"),
        F.max(F.abs("amount")).alias("max_abs_amount"),
        F.coalesce(F.date_diff(F.max(day), F.min(day)), F.lit(0)).cast("bigint").alias("span_days"),
        F.min("txn_id").alias("first_txn_id"),
    )


def ownership_edges(estate: Estate) -> DataFrame:
    """(relation, src_type, src, dst_type, dst, source_table, record_id), both directions."""

    def owned(frame: DataFrame, key: str, kind: str, table: str) -> DataFrame:
        rows = frame.select(clean_text(key).alias("id"), clean_text("bank_clabe").alias("account")).dropna().distinct()
        out = rows.select(
            F.lit("owns").alias("relation"), F.lit(kind).alias("src_type"), F.col("id").alias("src"),
            F.lit("account").alias("dst_type"), F.col("account").alias("dst"),
            F.lit(table).alias("source_table"), F.col("id").alias("record_id"),
        )
        back = rows.select(
            F.lit("owned_by").alias("relation"), F.lit("account").alias("src_type"), F.col("account").alias("src"),
            F.lit(kind).alias("dst_type"), F.col("id").alias("dst"),
            F.lit(table).alias("source_table"), F.col("id").alias("record_id"),
        )
        return out.unionByName(back)

    return owned(estate.vendors, "rfc", "vendor", "vendors").unionByName(
        owned(estate.employees, "emp_id", "employee", "employees")
    )


def graph_nodes(estate: Estate) -> DataFrame:
    """(node_type, entity_id). The tax listing alone does not make a node."""
    edges = transfer_edges(estate.bank_txns)
    sources = [
        ("vendor", estate.vendors, "rfc"), ("vendor", estate.invoices, "issuer_rfc"),
        ("vendor", estate.purchase_orders, "vendor_rfc"), ("vendor", estate.contracts, "vendor_rfc"),
        ("employee", estate.employees, "emp_id"),
        ("account", estate.vendors, "bank_clabe"), ("account", estate.employees, "bank_clabe"),
        ("account", edges, "src"), ("account", edges, "dst"),
    ]
    parts = [f.select(F.lit(kind).alias("node_type"), clean_text(c).alias("entity_id")) for kind, f, c in sources]
    return reduce(DataFrame.unionByName, parts).dropna().distinct()


def _half_edges(edges: DataFrame) -> DataFrame:
    out = edges.select(F.col("src").alias("account"), F.col("dst").alias("peer"), F.lit(1).alias("out"), "amount")
    into = edges.select(F.col("dst").alias("account"), F.col("src").alias("peer"), F.lit(0).alias("out"), "amount")
    return out.unionByName(into)


def _account_bank(edges: DataFrame) -> DataFrame:
    """Totals per account; peers are counted on distinct arcs, never on transfers."""
    half = _half_edges(edges)
    out, amount = F.col("out") == 1, F.col("amount")
    totals = half.groupBy("account").agg(
        sum_money(F.when(~out, amount)).alias("total_in"), sum_money(F.when(out, amount)).alias("total_out"),
        F.count(F.when(~out, 1)).alias("count_in"), F.count(F.when(out, 1)).alias("count_out"),
        F.stddev_pop("amount").alias("std_amount"), F.max(F.abs("amount")).alias("max_abs_amount"),
    )
    arcs = half.select("account", "peer", "out").distinct()
    peers = arcs.groupBy("account").agg(
        F.count(F.when(F.col("out") == 0, 1)).alias("unique_senders"),
        F.count(F.when(F.col("out") == 1, 1)).alias("unique_receivers"),
    )
    return totals.join(peers, "account")


def _counterparties(edges: DataFrame, estate: Estate) -> DataFrame:
    peers = _half_edges(edges).select("account", "peer").distinct()
    owned = estate.vendors.select(clean_text("bank_clabe").alias("peer")).dropna().distinct().withColumn("v", F.lit(1))
    return peers.join(owned, "peer", "left").groupBy("account").agg(
        F.count(F.lit(1)).alias("bank_unique_counterparties"), F.count("v").alias("vendor_owned_counterparties")
    )


def _zero(df: DataFrame, names: tuple[str, ...]) -> list[Column]:
    return [F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names]


@dataclass(frozen=True)
class Shared:
    """What the features of several node types read: all nodes, totals per account and peers per account."""

    nodes: DataFrame
    bank: DataFrame
    peers: DataFrame


def shared_parts(estate: Estate) -> Shared:
    edges = transfer_edges(estate.bank_txns)
    return Shared(graph_nodes(estate), _account_bank(edges), _counterparties(edges, estate))


def account_features(estate: Estate, shared: Shared | None = None) -> DataFrame:
    bank = (shared or shared_parts(estate)).bank
    owners = ownership_edges(estate).where("relation = 'owns'").groupBy(F.col("dst").alias("account")).agg(
        F.count(F.when(F.col("src_type") == "vendor", 1)).alias("vendor_owner_count"),
        F.count(F.when(F.col("src_type") == "employee", 1)).alias("employee_owner_count"),
    )
    rows = bank.join(owners, "account", "full_outer")
    rows = rows.withColumn("mean_amount_in", F.when(F.col("count_in") > 0, F.col("total_in") / F.col("count_in")))
    rows = rows.withColumn("mean_amount_out", F.when(F.col("count_out") > 0, F.col("total_out") / F.col("count_out")))
    return rows.select(F.col("account").alias("entity_id"), *_zero(rows, ACCOUNT_FEATURES))


def _owner_bank(shared: Shared, frame: DataFrame, key: str) -> DataFrame:
    """Bank totals and counterparties of each owner's account."""
    owners = frame.select(clean_text(key).alias("entity_id"), clean_text("bank_clabe").alias("account")).dropna()
    owners = owners.groupBy("entity_id").agg(F.min("account").alias("account"))
    bank = shared.bank.select(
        "account", F.col("total_in").alias("bank_total_in"), F.col("total_out").alias("bank_total_out"),
        F.col("count_in").alias("bank_txn_count_in"), F.col("count_out").alias("bank_txn_count_out"),
    )
    return owners.join(bank, "account", "left").join(shared.peers, "account", "left").drop("account")


def vendor_features(estate: Estate, shared: Shared | None = None) -> DataFrame:
    shared = shared or shared_parts(estate)
    nodes = shared.nodes.where("node_type = 'vendor'").select("entity_id")
    total, day = to_number("total"), to_date("issue_date")
    inv = estate.invoices.groupBy(clean_text("issuer_rfc").alias("entity_id")).agg(
        F.count(total).alias("invoice_count"), sum_money(total).alias("invoice_total"),
        (sum_money(total) / F.nullif(F.count(total), F.lit(0))).alias("invoice_mean"),
        F.stddev_pop(total).alias("invoice_std"), F.date_diff(F.max(day), F.min(day)).alias("invoice_active_span_days"),
    )
    po = estate.purchase_orders.groupBy(clean_text("vendor_rfc").alias("entity_id")).agg(
        F.count(to_number("amount")).alias("po_count"), sum_money(to_number("amount")).alias("po_total")
    )
    con = estate.contracts.groupBy(clean_text("vendor_rfc").alias("entity_id")).agg(
        F.count(to_number("value")).alias("contract_count"), sum_money(to_number("value")).alias("contract_total")
    )
    # Ledger rows are summed per invoice first, so the join to issuers is one row per invoice.
    by_invoice = estate.ledger.groupBy(clean_text("invoice_uuid").alias("uuid")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce(to_number("debit"), F.lit(0.0)).cast("decimal(18,2)")).alias("d"),
        F.sum(F.coalesce(to_number("credit"), F.lit(0.0)).cast("decimal(18,2)")).alias("c"),
    )
    issuer = estate.invoices.select(clean_text("uuid").alias("uuid"), clean_text("issuer_rfc").alias("entity_id")).dropna()
    led = by_invoice.join(issuer, "uuid").groupBy("entity_id").agg(
        F.sum("n").alias("ledger_entry_count"),
        F.sum("d").cast("double").alias("ledger_debit_total"), F.sum("c").cast("double").alias("ledger_credit_total"),
    )
    registered = estate.vendors.select(clean_text("rfc").alias("entity_id")).distinct().withColumn("registered_vendor", F.lit(1))
    listed = estate.efos_list.select(clean_text("rfc").alias("entity_id")).distinct().withColumn("efos_match", F.lit(1))
    rows = nodes
    for part in (registered, inv, po, con, led, listed, _owner_bank(shared, estate.vendors, "rfc")):
        rows = rows.join(part, "entity_id", "left")
    return rows.select("entity_id", *_zero(rows, VENDOR_FEATURES))


def employee_features(estate: Estate, shared: Shared | None = None) -> DataFrame:
    shared = shared or shared_parts(estate)
    nodes = shared.nodes.where("node_type = 'employee'").select("entity_id")
    rows = nodes.join(_owner_bank(shared, estate.employees, "emp_id"), "entity_id", "left")
    return rows.select("entity_id", *_zero(rows, EMPLOYEE_FEATURES))


def node_features(estate: Estate) -> dict[str, DataFrame]:
    """The features of all three node types; what they share is worked out once and written."""
    made = shared_parts(estate)
    shared = Shared(durable(made.nodes), durable(made.bank), durable(made.peers))
    return {
        "vendor": vendor_features(estate, shared),
        "employee": employee_features(estate, shared),
        "account": account_features(estate, shared),
    }


def long_features(features: dict[str, DataFrame]) -> DataFrame:
    """(node_type, entity_id, feature, raw_value)."""
    parts = [
        frame.unpivot(["entity_id"], list(FEATURES[kind]), "feature", "raw_value").withColumn("node_type", F.lit(kind))
        for kind, frame in features.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def robust_peer_scale(values: DataFrame) -> DataFrame:
    """Add ``scaled``: signed log, minus the peers' median, over their interquartile range.

    ``values`` is the long form. Flags stay 0 or 1 and a constant column maps to 0.
    """
    raw = F.coalesce(to_number("raw_value"), F.lit(0.0))
    # Read for the quantiles and for the rows, so the features are worked out once and written.
    logged = durable(values.withColumn("raw_value", raw).withColumn("logged", F.round(F.signum(raw) * F.log1p(F.abs(raw)), 9)))
    peers = exact_quantiles(
        logged.where(~F.col("feature").isin(*BINARY_FEATURES)), ["node_type", "feature"], "logged", [0.25, 0.5, 0.75]
    )
    width = F.col("q75") - F.col("q25")
    scale = F.when(width > 1e-12, width).otherwise(F.lit(1.0))
    flag = F.when(F.col("raw_value") > 0, 1.0).otherwise(0.0)
    scaled = F.when(F.col("feature").isin(*BINARY_FEATURES), flag).otherwise((F.col("logged") - F.col("q50")) / scale)
    # One row per feature name, a fixed list.
    return logged.join(F.broadcast(peers), ["node_type", "feature"], "left").select(
        "node_type", "entity_id", "feature", "raw_value", scaled.alias("scaled")
    )
