"""Groups of any size: order matching by islands, accounts with many owners."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditweave.operators import detectors, graph, ordering, ranking
from auditweave.plans.registry import Given


def plain_first_fit(totals, amounts):
    free, out = [True] * len(amounts), []
    for i, total in enumerate(totals):
        for j, amount in enumerate(amounts):
            if free[j] and abs(amount - total) <= max(0.02 * total, 1.0):
                free[j] = False
                out.append((i, j))
                break
    return out


def test_first_fit_by_a_tree_of_minima():
    rng = random.Random(4)
    for n in (0, 1, 2, 7, 60):
        for spread in (3, 400, 100_000):
            totals = np.array([round(rng.random() * spread, 2) for _ in range(n)], float)
            # Amounts at the very ends of a reach.
            amounts = np.array([round(rng.random() * spread, 2) for _ in range(n)] + [t * 1.02 for t in totals] + [t - 1.0 for t in totals] + [float("nan")], float)
            rng.shuffle(amounts)
            assert detectors.first_fit(totals, amounts) == plain_first_fit(totals, amounts)


def test_running_max_with_one_hot_group(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"g{i % 5}", i * 7919 % 2003, rng.randrange(900) if rng.random() < 0.4 else None) for i in range(1500)]
    df = spark.createDataFrame(rows, "g string, o bigint, v bigint").repartition(6)
    got = {(r.g, r.o): r.before for r in ordering.running_max(df, ["g"], ["o"], F.col("v"), "before").collect()}
    want, most = {}, {}
    for g, o, v in sorted(rows, key=lambda r: r[:2]):
        want[g, o] = most.get(g)
        most[g] = max((x for x in (most.get(g), v) if x is not None), default=None)
    assert got == want


@pytest.mark.parametrize("block", [5, 40])
def test_islands_change_no_match(spark, block):
    rng = random.Random(block)
    vendors = ["hot"] * 5 + ["cold", "lone"]
    invoices = [(rng.choice(vendors), f"u{i:03d}", round(1.05 ** rng.randrange(0, 220), 2)) for i in range(160)]
    orders = [(rng.choice(vendors[:6]), f"p{i:03d}", round(1.05 ** rng.randrange(0, 220), 2)) for i in range(120)]
    inv = spark.createDataFrame(invoices, "rfc string, uuid string, total double")
    po = spark.createDataFrame(orders, "rfc string, po_id string, amount double")
    left, right = detectors._islands(inv, po, block)
    assert left.count() == len(invoices) and left.where("rfc = 'hot'").select("island").distinct().count() > 5
    # No invoice reaches an order of another island.
    apart = left.alias("l").join(right.alias("r"), "rfc").where("l.island <> r.island AND abs(amount - total) <= greatest(0.02 * total, 1.0)")
    assert apart.count() == 0
    want = set()
    for vendor in set(vendors):
        mine, theirs = (sorted((i, m) for v, i, m in side if v == vendor) for side in (invoices, orders))
        want |= {(vendor, mine[a][0], theirs[b][0]) for a, b in plain_first_fit([m for _, m in mine], [m for _, m in theirs])}
    assert {tuple(r) for r in detectors.match_orders(inv, po, block).select("rfc", "uuid", "po_id").collect()} == want


def test_a_vendor_of_200_000_invoices_and_orders_takes_a_bounded_number_of_rounds(spark, monkeypatch):
    """Amounts in 50 far apart bands are 50 islands; each is matched in the one round there is."""
    n = 200_000
    amount = F.pow(F.lit(3.0), F.col("id") % 50) + 100 + (F.col("id") % 17) / 100.0
    inv = spark.range(n).select(F.lit("v").alias("rfc"), F.format_string("u%07d", "id").alias("uuid"), F.round(amount, 2).alias("total"))
    po = spark.range(n).select(F.lit("v").alias("rfc"), F.format_string("p%07d", "id").alias("po_id"), F.round(amount, 2).alias("amount"))
    rounds = []
    plain = detectors.durable
    monkeypatch.setattr(detectors, "durable", lambda df: rounds.append(df.columns) or plain(df))
    matched = detectors.match_orders(inv, po, 50_000)
    assert matched.count() == n and sum(c == ["rfc", "uuid", "po_id"] for c in rounds) == 1


def estate_of(spark, vendors, employees, transfers):
    base = Given(spark, "/root/testdata/sf0.001").estate
    from dataclasses import replace

    return replace(
        base,
        vendors=spark.createDataFrame(vendors, "rfc string, bank_clabe string"),
        employees=spark.createDataFrame(employees, "emp_id string, bank_clabe string"),
        bank_txns=spark.createDataFrame(transfers, "txn_id string, from_clabe string, to_clabe string, amount double, date string"))


def test_ten_thousand_owners_on_each_side_take_as_many_rows(spark):
    n = 10_000
    vendors = [(f"R{i}", "hub") for i in range(n)] + [("S1", "own"), ("S2", None)]
    staff = [(f"E{i}", "hub") for i in range(n)] + [("F1", "home"), ("F2", "own")]
    moved = [("t1", "hub", "hub", 5.0, "2024-01-01"), ("t2", "hub", "home", 6.0, "2024-01-01"), ("t3", "home", "hub", 7.0, None), ("t4", "own", "x", 1.0, None)]
    estate = estate_of(spark, vendors, staff, moved)
    groups, members = detectors.shared_account_groups(estate)
    assert {(r.account, r.vendor_count, r.employee_count) for r in groups.collect()} == {("hub", n, n), ("own", 1, 1)}
    assert members.count() == 2 * n + 2
    found = detectors.observe_account_groups(groups, members)
    assert (found.heads.count(), found.entities.count(), found.refs.count()) == (2, 2 * n + 4, 2 * n + 2)
    transfers, owners = detectors.transfer_groups(estate)
    assert {r.txn_id for r in transfers.collect()} == {"t1", "t2"} and owners.count() == 2 * n + 1


def test_groups_hold_the_pairs(spark):
    vendors = [("R1", "a"), ("R2", "a"), ("R3", "b"), ("R3", "b"), ("R4", "c")]
    staff = [("E1", "a"), ("E2", "a"), ("E3", "b"), ("E4", "z")]
    estate = estate_of(spark, vendors, staff, [("t1", "a", "b", 1.0, None), ("t2", "c", "z", 2.0, None)])
    _, members = detectors.shared_account_groups(estate)
    v, e = (members.where(F.col("role") == r).select("account", F.col("owner").alias(n)) for r, n in (("vendor", "rfc"), ("employee", "emp_id")))
    columns = ["rfc", "emp_id", "account"]
    assert {tuple(r) for r in v.join(e, "account").select(columns).collect()} == {
        tuple(r) for r in detectors.vendor_employee_shared_account(estate).select(columns).collect()}
    transfers, owners = detectors.transfer_groups(estate)
    payers = owners.where("role = 'vendor'").select(F.col("account").alias("vendor_account"), F.col("owner").alias("rfc"))
    payees = owners.where("role = 'employee'").select(F.col("account").alias("employee_account"), F.col("owner").alias("emp_id"))
    columns = ["txn_id", "rfc", "emp_id"]
    assert {tuple(r) for r in transfers.join(payers, "vendor_account").join(payees, "employee_account").select(columns).collect()} == {
        tuple(r) for r in detectors.vendor_to_employee_transfer(estate).select(columns).collect()}


def test_means_without_a_fold_are_all_minus_that_fold(spark):
    rng = random.Random(9)
    names = ["x", "y", "z"]
    values = [("account", f"a{i}", n, round(rng.random(), 3)) for i in range(12) for n in names if rng.random() < 0.8]
    arcs = sorted({(f"a{rng.randrange(12)}", f"a{rng.randrange(14)}") for _ in range(60)})
    edges = [(s, d, i % 4) for i, (s, d) in enumerate(arcs)]
    frame = spark.createDataFrame(values, "node_type string, entity_id string, feature string, value double")
    got = {(r["entity_id"], r["without"]): [r["g0"], r["g1"], r["g2"]] for r in
           ranking.fold_means(frame, spark.createDataFrame(edges, "src string, dst string, fold bigint"), names, 4).collect()}
    held = {(e, f): v for _, e, f, v in values}
    for without in range(4):
        for dst in {d for _, d, _ in edges}:
            for i, f in enumerate(names):
                mine = [held[s, f] for s, d, fold in edges if d == dst and fold != without and (s, f) in held]
                if (dst, without) in got:
                    assert got[dst, without][i] == pytest.approx(sum(mine) / len(mine) if mine else 0.0, abs=1e-9)
                else:
                    assert not any((s, g) in held for s, d, _ in edges if d == dst for g in names)


def test_surprise_of_each_arc_is_from_folds_that_did_not_hold_it(spark):
    rng = random.Random(3)
    names = list(graph.ACCOUNT_FEATURES)
    values = [("account", f"a{i}", n, rng.gauss(0, 1)) for i in range(20) for n in names]
    arcs = sorted({(f"a{rng.randrange(10)}", f"a{rng.randrange(10)}") for _ in range(40)} | {("a0", "a19")})
    frame = spark.createDataFrame(values, "node_type string, entity_id string, feature string, value double")
    ends, scored = ranking.edge_surprise(frame, spark.createDataFrame(arcs, "src string, dst string"), folds=2)
    rows = scored.collect()
    assert sorted((r["src"], r["dst"]) for r in rows) == arcs and {r["fold"] for r in rows} == {0, 1} and all(r["surprise"] > 0 for r in rows)
    by = {}
    for r in rows:
        for e in (r["src"], r["dst"]):
            by.setdefault(e, []).append(r["surprise"])
    assert {r["entity_id"]: r["edge_value"] for r in ends.collect()} == pytest.approx({e: sum(v) / len(v) for e, v in by.items()})


def test_clusters_of_one_hot_pair_have_the_median_of_all_their_invoices(spark):
    """Twenty thousand invoices of one pair in eight days, a few amounts each, against numpy."""
    from dataclasses import replace

    rng = random.Random(8)
    rows = [(f"u{i:05d}", "V", "C", f"2024-01-{1 + i % 8:02d}", 100.0 + rng.randrange(200) / 100) for i in range(20_000)]
    rows += [(f"w{i}", "V", "C", f"2024-03-{i + 1:02d}", 50.0 + 9 * i) for i in range(4)]
    base = Given(spark, "/root/testdata/sf0.001").estate
    estate = replace(base, invoices=spark.createDataFrame(rows, "uuid string, issuer_rfc string, receiver_rfc string, issue_date string, total double"))
    clusters, members = detectors.similar_invoice_cluster(estate, max_spread=0.05)
    got = {r["first_issue_date"]: (r["invoice_count"], r["median_total"], r["cluster_total"]) for r in clusters.collect()}
    totals = np.array([r[4] for r in rows[:20_000]])
    assert got["2024-01-01"] == (20_000, pytest.approx(float(np.median(totals))), pytest.approx(float(totals.sum())))
    assert members.where("uuid like 'u%'").count() == 20_000 and len(got) == 1
