"""All seeds and folds of the edge surprise in one pass."""

from __future__ import annotations

import random

import pytest

from auditweave import session
from auditweave.operators import graph, ordering, ranking


def made(spark, seed):
    rng = random.Random(seed)
    values = [("account", f"a{i}", n, rng.gauss(0, 1)) for i in range(20) for n in graph.ACCOUNT_FEATURES]
    arcs = sorted({(f"a{rng.randrange(10)}", f"a{rng.randrange(10)}") for _ in range(40)} | {("a0", "a19"), ("a3", "a3")})
    return (spark.createDataFrame(values, "node_type string, entity_id string, feature string, value double"),
            spark.createDataFrame(arcs, "src string, dst string"))


def test_more_seeds_and_folds_take_no_more_writes(spark, monkeypatch):
    writes = []

    def counted(df, *rest, **named):
        writes.append(1)
        return session.durable(df, *rest, **named)

    for module in (ranking, ordering):
        monkeypatch.setattr(module, "durable", counted)
    values, arcs = made(spark, 3)
    taken = {}
    for seeds, folds in (((5,), 2), ((5, 6, 9), 4)):
        writes.clear()
        scored = ranking.edge_surprises(values, arcs, seeds, folds)[1]
        assert {(r["seed"], r["fold"]) for r in scored.collect()} == {(s, f) for s in seeds for f in range(folds)}
        taken[len(seeds)] = len(writes)
    assert taken[1] == taken[3]


def test_seeds_together_are_the_seeds_one_by_one(spark):
    values, arcs = made(spark, 4)
    seeds = (5, 6)  # their folds draw from seeds that overlap
    accounts, scored = ranking.edge_surprises(values, arcs, seeds, 2)
    ends, arcs_told = accounts.collect(), scored.collect()
    for seed in seeds:
        alone, each = ranking.edge_surprise(values, arcs, seed, 2)
        assert {r["entity_id"]: r["edge_value"] for r in ends if r["seed"] == seed} == pytest.approx(
            {r["entity_id"]: r["edge_value"] for r in alone.collect()})
        assert {(r["src"], r["dst"], r["fold"]): r["surprise"] for r in arcs_told if r["seed"] == seed} == pytest.approx(
            {(r["src"], r["dst"], r["fold"]): r["surprise"] for r in each.collect()})


def test_one_arc_trains_and_is_held_and_no_arc_gives_no_row(spark):
    values, _ = made(spark, 5)
    one = spark.createDataFrame([("a1", "a2")], "src string, dst string")
    accounts, scored = ranking.edge_surprises(values, one, (5, 6))
    assert sorted((r["seed"], r["src"], r["dst"], r["fold"]) for r in scored.collect()) == [(5, "a1", "a2", 0), (6, "a1", "a2", 0)]
    assert sorted((r["seed"], r["entity_id"]) for r in accounts.collect()) == [(5, "a1"), (5, "a2"), (6, "a1"), (6, "a2")]
    accounts, scored = ranking.edge_surprises(values, one.limit(0), (5, 6))
    assert accounts.columns == ["seed", "entity_id", "edge_value"] and accounts.isEmpty() and scored.isEmpty()


def test_sets_of_pairs_are_those_of_their_seeds(spark):
    _, arcs = made(spark, 6)
    nodes = graph.transfer_nodes(arcs)
    sets = ranking.negative_edge_sets(nodes, arcs, 60, [3, 4]).collect()
    for seed in (3, 4):
        want = {(r["src"], r["dst"]) for r in ranking.negative_edges(nodes, arcs, 60, seed).collect()}
        assert {(r["src"], r["dst"]) for r in sets if r["draw_seed"] == seed} == want
    assert len(sets) == len({tuple(r) for r in sets})
