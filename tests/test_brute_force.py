"""Operators without SQL, and the skew-proof primitives, against plain loops."""

from __future__ import annotations

import random
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditweave.operators import detectors, graph, ordering, ranking, statistics


def test_running_total_with_one_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(5)}", i * 7919 % 2003, rng.randrange(9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, o bigint, a bigint").repartition(6)
    got = {(r.g, r.o): r.before for r in ordering.running_total(df, ["g"], ["o"], F.col("a"), "before").collect()}
    want, sums = {}, defaultdict(int)
    for g, o, a in sorted(rows):
        want[(g, o)] = sums[g]
        sums[g] += a
    assert got == want


def test_positions_without_group(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("k"))
    assert all(r.position == r.k + 1 for r in ordering.positions(df, [], ["k"]).collect())


def test_exact_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([np.zeros(300), rng.normal(size=301)])
    df = spark.createDataFrame([("a", float(v)) for v in values], "g string, v double")
    row = ordering.exact_quantiles(df, ["g"], "v", [0.25, 0.5, 0.75]).first()
    assert np.allclose([row.q25, row.q50, row.q75], np.percentile(values, [25, 50, 75]))


def _first_fit(invoices, orders):
    taken, out = set(), set()
    for vendor, uuid, total in sorted(invoices):
        for owner, po, amount in sorted(orders):
            if owner == vendor and po not in taken and abs(amount - total) <= max(0.02 * total, 1.0):
                taken.add(po)
                out.add((vendor, uuid, po))
                break
    return out


@pytest.mark.parametrize("block", [3, 1000])
def test_order_matching_is_first_fit_in_any_block_size(spark, block):
    rng = random.Random(block)
    vendors = ["hot"] * 4 + ["cold", "lone"]
    invoices = [(rng.choice(vendors), f"u{i:03d}", float(rng.randrange(90, 110))) for i in range(40)]
    orders = [(rng.choice(vendors[:5]), f"p{i:03d}", float(rng.randrange(90, 110))) for i in range(25)]
    got = detectors.match_orders(spark.createDataFrame(invoices, "rfc string, uuid string, total double"),
                                 spark.createDataFrame(orders, "rfc string, po_id string, amount double"), block)
    assert {tuple(r) for r in got.select("rfc", "uuid", "po_id").collect()} == _first_fit(invoices, orders)


def test_bursts_equal_the_greedy_scan(spark):
    rng = random.Random(5)
    base, rows = 1_700_000_000, []
    for i in range(400):
        vendor = "hot" if rng.random() < 0.7 else f"v{rng.randrange(3)}"
        rows.append((f"t{i:03d}", vendor, 1.0, base + rng.randrange(0, 9000)))
    df = spark.createDataFrame(rows, "transaction_id string, vendor_id string, amount double, s bigint").withColumn(
        "timestamp", F.timestamp_seconds("s"))
    _, members = statistics.velocity_burst(df)
    got = defaultdict(set)
    for r in members.collect():
        got[(r.vendor_id, r.burst)].add(r.transaction_id)
    want = set()
    for vendor in {r[1] for r in rows}:
        mine = sorted((s, t) for t, v, _, s in rows if v == vendor)
        i = 0
        while i < len(mine):
            j = i
            while j < len(mine) and mine[j][0] - mine[i][0] <= 300:
                j += 1
            if j - i > 3:
                want.add((vendor, frozenset(t for _, t in mine[i:j])))
                i = j
            else:
                i += 1
    assert {(v, frozenset(m)) for (v, _), m in got.items()} == want


@pytest.mark.parametrize("max_len", [4, 5])
def test_cycles_with_a_hub_equal_enumeration(spark, max_len):
    rng = random.Random(max_len)
    nodes = [f"n{i}" for i in range(9)]
    arcs = {(a, b) for a in nodes for b in nodes if rng.random() < 0.22} | {("hub", n) for n in nodes} | {(n, "hub") for n in nodes[:5]}
    edges = spark.createDataFrame([(a, b) for a, b in arcs], "src string, dst string")
    got = sorted(tuple(r.accounts) for r in graph.simple_cycles(edges, max_len).collect())
    want = set()
    everyone = nodes + ["hub"]
    for length in range(2, max_len + 1):
        for path in permutations(everyone, length):
            if path[0] == min(path) and all((path[i], path[(i + 1) % length]) in arcs for i in range(length)):
                want.add(path)
    assert got == sorted(want)


def test_duplicate_transfer_ids_are_refused(spark):
    bank = spark.createDataFrame([("x", "2024-01-01", "a", "b", 1.0, "r", "c")] * 2,
                                 "txn_id string, date string, from_clabe string, to_clabe string, amount double, reference string, channel string")
    with pytest.raises(ValueError, match="x"):
        graph.transfer_multigraph(bank)


def test_forest_repeats_and_flags_near_its_share(spark):
    rng = np.random.default_rng(2)
    rows = [(f"t{i:04d}", float(rng.normal(100, 5)), float(rng.integers(8, 18))) for i in range(900)] + [("odd", 9000.0, 3.0)]
    df = spark.createDataFrame(rows, "transaction_id string, amount double, hour double")
    first = {r.transaction_id: r.score for r in statistics.isolation_forest(df).collect()}
    again = {r.transaction_id: r.score for r in statistics.isolation_forest(df.repartition(3)).collect()}
    assert first == again
    assert first["odd"] == 1.0
    assert 0.05 <= len(first) / len(rows) <= 0.12


def test_peer_percentile_counts_ties_half(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 2.0), ("d", 5.0)], "entity_id string, v double").withColumn("node_type", F.lit("x"))
    got = {r.entity_id: r.p for r in ranking.peer_percentile(df, ["node_type"], "v", "p").collect()}
    assert got == {"a": 0.5 / 3, "b": 0.5 / 3, "c": 2 / 3, "d": 1.0}


def test_planted_outlier_has_the_largest_masked_error(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        x = float(rng.normal())
        for j, name in enumerate(graph.EMPLOYEE_FEATURES):
            rows.append(("employee", f"e{i}", name, x * (j + 1) + float(rng.normal(0, 0.01))))
    rows += [("employee", "odd", name, 3.0 if j % 2 else -3.0) for j, name in enumerate(graph.EMPLOYEE_FEATURES)]
    own = spark.createDataFrame(rows, "node_type string, entity_id string, feature string, value double")
    out = ranking.masked_feature_error(own, own.limit(0)).orderBy(F.desc("error")).first()
    assert out.entity_id == "odd"


def test_held_edges_are_hidden_from_neighbour_means(spark):
    values = spark.createDataFrame([("account", "a", "f", 1.0), ("account", "b", "f", 5.0)], "node_type string, entity_id string, feature string, value double")
    edges = spark.createDataFrame([("transfers", "account", "a", "account", "c"), ("transfers", "account", "b", "account", "c")],
                                  "relation string, src_type string, src string, dst_type string, dst string")
    held = spark.createDataFrame([("b", "c")], "src string, dst string")
    assert ranking.neighbour_means(values, edges).first().value == 3.0
    assert ranking.neighbour_means(values, edges, held=held).first().value == 1.0


def test_every_edge_is_scored_once_and_drawn_pairs_are_no_edges(spark):
    rng = random.Random(8)
    names = [f"a{i}" for i in range(14)]
    arcs = spark.createDataFrame(sorted({tuple(rng.sample(names, 2)) for _ in range(40)}), "src string, dst string")
    drawn = ranking.negative_edges(graph.transfer_nodes(arcs), arcs, 20, 3)
    assert drawn.join(arcs, ["src", "dst"]).isEmpty() and drawn.where("src = dst").isEmpty()
    assert drawn.distinct().count() == drawn.count() > 0
    total = arcs.count()
    assert ranking.edge_holdout(arcs, 0.25, 1).count() == total // 4
