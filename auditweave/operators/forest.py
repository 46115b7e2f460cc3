"""Isolation forest: small trees grown side by side, rows scored where they lie."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.operators.ordering import top_rows
from auditweave.session import send_with_tasks

send_with_tasks(__name__)

# Fixed values.
TREES, SAMPLE = 100, 256


def _average_path(n: np.ndarray | float) -> np.ndarray:
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, long))


def _grow(points: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Nodes as (feature, cut, left, right, path); a leaf has feature -1."""
    limit = math.ceil(math.log2(max(len(points), 2)))
    nodes: list[tuple] = []

    def split(part: np.ndarray, depth: int) -> int:
        here = len(nodes)
        nodes.append(())
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(part) <= 1 or not len(usable):
            nodes[here] = (-1, 0.0, -1, -1, float(depth + _average_path(len(part))))
            return here
        feature = int(rng.choice(usable))
        cut = float(rng.uniform(low[feature], high[feature]))
        mask = part[:, feature] < cut
        if not mask.any() or mask.all():
            mask = part[:, feature] <= low[feature]
        nodes[here] = (feature, cut, split(part[mask], depth + 1), split(part[~mask], depth + 1), 0.0)
        return here

    split(points, 0)
    return nodes


def isolation_scores(df: DataFrame, features: list[str], id_column: str, seed: int) -> DataFrame:
    """Add ``raw_score`` in (-1, 0): lower is more isolated.

    Every tree draws SAMPLE of all rows, those with the least hash of (id, tree).
    Rows that a tree cannot draw are left out before anything moves: its edge lets
    some 16 standard deviations more than SAMPLE through, or every row. The trees
    together have a fixed greatest size, which is why they may be sent to every task.
    """
    edge = min(1.0, (SAMPLE + 16 * math.sqrt(SAMPLE)) / max(df.count(), 1))
    draws = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda tree: F.struct(
        tree.alias("tree"), F.shiftrightunsigned(F.xxhash64(F.col(id_column).cast("string"), tree, F.lit(seed)), 1).alias("__d")))
    hopeful = F.filter(draws, lambda d: d["__d"] <= F.lit(min(int(edge * (1 << 63)), (1 << 63) - 1)))
    trees = df.select(id_column, *features, F.inline(hopeful))
    drawn = top_rows(trees, ["tree"], [F.col("__d"), F.col(id_column)], SAMPLE, "pick")

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pick")
        tree = int(part["tree"].iloc[0])
        nodes = _grow(part[features].to_numpy(dtype=float), np.random.default_rng([seed, tree]))
        out = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "path"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", tree)
        return out

    schema = "tree int, node int, feature int, cut double, left int, right int, path double"
    built = drawn.groupBy("tree").applyInPandas(grow, schema).toPandas().sort_values(["tree", "node"])
    forest = [part.drop(columns=["tree", "node"]).to_numpy() for _, part in built.groupby("tree")]
    size = int(drawn.groupBy("tree").count().agg(F.max("count")).first()[0] or 1)
    shared = df.sparkSession.sparkContext.broadcast(forest)
    scale = float(_average_path(size)) or 1.0

    def score(*columns: pd.Series) -> pd.Series:
        points = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        total = np.zeros(len(points))
        for nodes in shared.value:
            at = np.zeros(len(points), dtype=int)
            inner = nodes[at, 0] >= 0
            while inner.any():
                live = np.flatnonzero(inner)
                node = nodes[at[live]]
                goes_left = points[live, node[:, 0].astype(int)] < node[:, 1]
                at[live] = np.where(goes_left, node[:, 2], node[:, 3]).astype(int)
                inner[live] = nodes[at[live], 0] >= 0
            total += nodes[at, 4]
        return pd.Series(-np.exp2(-(total / max(len(shared.value), 1)) / scale))

    score.__annotations__ = {"columns": pd.Series, "return": pd.Series}
    scorer = F.pandas_udf(score, "double")
    return df.withColumn("raw_score", scorer(*[F.col(f) for f in features]))
