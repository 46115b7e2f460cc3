"""Peer-anomaly ranking over the graph."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditweave.functions.clean import clean_text, observation_id
from auditweave.operators import graph
from auditweave.operators.observations import Observations, make_heads
from auditweave.operators.ordering import positions, running_total, top_rows
from auditweave.session import durable, forget
from auditweave.sources.estate import Estate

# Fixed values.
MIN_PEERS, MIN_MEDIAN, MAX_IQR, TOP_PER_TYPE, EVIDENCE_LIMIT, TOP_FEATURES, FOLDS = 5, 0.85, 0.25, 3, 12, 5, 5
AT_ONCE = 4
RIDGE = 1e-3
NODE = ["node_type", "entity_id"]
EDGE_ATTRIBUTES = ("transfer_count", "total_amount", "mean_amount", "max_abs_amount", "span_days")


def relations(estate: Estate) -> DataFrame:
    """(relation, src_type, src, dst_type, dst): ownership both ways, and transfers."""
    owned = graph.ownership_edges(estate).select("relation", "src_type", "src", "dst_type", "dst").distinct()
    moved = graph.transfer_edges(estate.bank_txns).select("src", "dst").distinct().select(
        F.lit("transfers").alias("relation"), F.lit("account").alias("src_type"), "src", F.lit("account").alias("dst_type"), "dst")
    return owned.unionByName(moved)


def neighbour_means(values: DataFrame, edges: DataFrame, hops: int = 1, edge_values: DataFrame | None = None,
                    held: DataFrame | None = None) -> DataFrame:
    """Mean of each neighbour feature per relation: (node_type, entity_id, feature, value).

    ``values`` has the same columns. ``edge_values`` (src, dst, feature, value)
    joins the transfer messages; ``held`` (src, dst) hides transfers. The second
    hop reads the first, and feature names show the path.
    """
    if held is not None:
        hidden = held.select("src", "dst").withColumn("relation", F.lit("transfers"))
        edges = edges.join(hidden, ["relation", "src", "dst"], "left_anti")
    out, layer = [], values
    for hop in range(hops):
        sent = layer.select(F.col("node_type").alias("src_type"), F.col("entity_id").alias("src"), "feature", "value")
        messages = edges.join(sent, ["src_type", "src"]).select(
            "dst_type", "dst", F.concat_ws("/", "relation", "src_type", "feature").alias("feature"), "value")
        if edge_values is not None and hop == 0:
            moved = edges.where("relation = 'transfers'").join(edge_values, ["src", "dst"]).select(
                "dst_type", "dst", F.concat(F.lit("transfers/edge/"), "feature").alias("feature"), "value")
            messages = messages.unionByName(moved)
        layer = messages.groupBy(F.col("dst_type").alias("node_type"), F.col("dst").alias("entity_id"), "feature").agg(
            F.avg("value").alias("value"))
        out.append(layer)
    return reduce(DataFrame.unionByName, out)


def transfer_attributes(estate: Estate) -> DataFrame:
    """(src, dst, feature, value): logged attributes of every transfer arc."""
    arcs = graph.transfer_edge_features(graph.transfer_edges(estate.bank_txns))
    logged = arcs.select("src", "dst", *[F.signum(F.col(c).cast("double")) * F.log1p(F.abs(F.col(c).cast("double"))) for c in EDGE_ATTRIBUTES])
    return logged.toDF("src", "dst", *EDGE_ATTRIBUTES).unpivot(["src", "dst"], list(EDGE_ATTRIBUTES), "feature", "value")


def _wide(values: DataFrame, features: list[str]) -> DataFrame:
    columns = [F.coalesce(F.max(F.when(F.col("feature") == f, F.col("value"))), F.lit(0.0)).alias(f"f{i}") for i, f in enumerate(features)]
    return values.groupBy("entity_id").agg(*columns)


def masked_feature_error(own: DataFrame, around: DataFrame) -> DataFrame:
    """(node_type, entity_id, error): how badly each feature is told by the others and the neighbourhood.

    Predicting every feature from all the rest by ridge regression needs only the
    inverse of one correlation matrix, so each node type takes one pass and a
    feature-by-feature matrix, never a fit per feature.
    """
    parts = []
    for kind, names in graph.FEATURES.items():
        mine = own.where(F.col("node_type") == kind)
        near = around.where(F.col("node_type") == kind)
        extra = sorted(r.feature for r in near.select("feature").distinct().collect())  # a fixed vocabulary of feature paths
        features = [*names, *extra]
        wide = durable(_wide(mine.unionByName(near).select("entity_id", "feature", "value"), features))
        columns = [f"f{i}" for i in range(len(features))]
        moments = wide.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
        if moments is None or moments[0] is None:
            continue
        varied = [c for c in columns if (moments[f"s_{c}"] or 0.0) > 1e-12]
        if len(varied) < 2:
            continue
        z = wide.select("entity_id", *[((F.col(c) - F.lit(moments[f"m_{c}"])) / F.lit(moments[f"s_{c}"])).alias(c) for c in varied])
        vectors = VectorAssembler(inputCols=varied, outputCol="v").transform(z)
        corr = Correlation.corr(vectors, "v").head()[0].toArray()
        inverse = np.linalg.inv(np.nan_to_num(corr) + RIDGE * np.eye(len(varied)))
        squares = []
        for j, column in enumerate(varied):
            if column in columns[: len(names)]:
                terms = [F.lit(float(inverse[j, k])) * F.col(c) for k, c in enumerate(varied)]
                residual = reduce(lambda a, b: a + b, terms) / F.lit(float(inverse[j, j]))
                squares.append(residual * residual)
        if squares:
            error = reduce(lambda a, b: a + b, squares) / F.lit(float(len(names)))
            parts.append(z.select(F.lit(kind).alias("node_type"), "entity_id", error.alias("error")))
    return reduce(DataFrame.unionByName, parts)


def _fraction(*parts: Column | str) -> Column:
    """Number in [0, 1) from a digest that every engine computes alike."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def masking_sample(values: DataFrame, rate: float, seed: int) -> DataFrame:
    """Cells to hide; when the rate hides none, the one with the least hash."""
    drawn = values.withColumn("h", _fraction("entity_id", "feature", F.lit(str(seed))))
    least = drawn.agg(F.min("h")).first()[0]
    edge = rate if least is None or least < rate else float(np.nextafter(least, 1.0))
    return drawn.where(F.col("h") < edge).select(*NODE, "feature")


def edge_holdout(arcs: DataFrame, rate: float, seed: int) -> DataFrame:
    """Held-out arcs (src, dst): an exact share, and at least one arc stays."""
    total = arcs.count()
    held = min(int(total * rate), max(total - 1, 0))
    drawn = arcs.select("src", "dst").withColumn("h", _fraction("src", "dst", F.lit(str(seed))))
    return positions(drawn, [], ["h", "src", "dst"], "n").where(F.col("n") <= held).select("src", "dst")


def negative_edges(nodes: DataFrame, arcs: DataFrame, count: int, seed: int) -> DataFrame:
    """``count`` seeded pairs (src, dst) that are no arcs, or all such pairs where there are fewer."""
    return negative_edge_sets(nodes, arcs, count, [seed]).select("src", "dst")


def negative_edge_sets(nodes: DataFrame, arcs: DataFrame, count: int, seeds: Sequence[int]) -> DataFrame:
    """(draw_seed, src, dst): the ``negative_edges`` of each of the different ``seeds``, drawn in one pass."""
    indexed = durable(positions(nodes.select("account"), [], ["account"], "n"))
    size = indexed.count()
    if size < 2 or count < 1:
        return arcs.select(F.lit(0).cast("bigint").alias("draw_seed"), "src", "dst").limit(0)
    known = durable(arcs.select("src", "dst").where("src <> dst").distinct())
    count = min(count, size * (size - 1) - known.count())
    rounds, short, parts = 3, list(seeds), []
    while short:
        fresh = durable(_free_pairs(indexed, known, size, count * rounds, short))
        found = {r.draw_seed: r.pairs for r in fresh.groupBy("draw_seed").agg(F.count(F.lit(1)).alias("pairs")).collect()}
        full = [s for s in short if found.get(s, 0) >= count]
        if full:
            numbered = positions(fresh.where(F.col("draw_seed").isin(full)), ["draw_seed"], ["draw"], "n")
            parts.append(numbered.where(F.col("n") <= count).select("draw_seed", "src", "dst"))
        short = [s for s in short if s not in full]
        rounds *= 2
    return reduce(DataFrame.unionByName, parts)


def _free_pairs(indexed: DataFrame, known: DataFrame, size: int, draws: int, seeds: Sequence[int]) -> DataFrame:
    """Per seed the different pairs among its first ``draws`` draws that are no arcs, with the draw that named them."""

    def end(seed: int, side: str) -> Column:
        return (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(side)), F.lit(size)) + 1).alias(side)

    drawn = [F.struct(F.lit(s).cast("bigint").alias("draw_seed"), end(s, "a"), end(s, "b")) for s in seeds]
    draws = known.sparkSession.range(draws).select(F.col("id").alias("draw"), F.inline(F.array(*drawn))).where("a <> b")
    pairs = draws.join(indexed.select(F.col("n").alias("a"), F.col("account").alias("src")), "a").join(
        indexed.select(F.col("n").alias("b"), F.col("account").alias("dst")), "b")
    return pairs.groupBy("draw_seed", "src", "dst").agg(F.min("draw").alias("draw")).join(known, ["src", "dst"], "left_anti")


def fold_means(values: DataFrame, edges: DataFrame, names: list[str], folds: int, by: Sequence[str] = ()) -> DataFrame:
    """(entity_id, without, g0, g1, ...): means over the sources of an account's arcs, each fold left out in turn.

    ``values`` are features of accounts in long form, ``edges`` (src, dst, fold). Sums and counts per
    (account, fold) are made in one pass; the mean without a fold is all minus that fold. A feature that no
    source has is 0, as in a wide table of means. ``by`` names columns of ``edges`` that keep sets of arcs apart.
    """
    sent = values.where(F.col("feature").isin(names)).select(F.col("entity_id").alias("src"), "feature", "value")
    sent = sent.groupBy("src").agg(*[F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f"v{i}") for i, f in enumerate(names)])
    width = range(len(names))
    sums = durable(edges.join(sent, "src").groupBy(*by, F.col("dst").alias("entity_id"), "fold").agg(
        *[F.coalesce(F.sum(f"v{i}"), F.lit(0.0)).alias(f"s{i}") for i in width], *[F.count(f"v{i}").alias(f"n{i}") for i in width]))
    total = sums.groupBy(*by, "entity_id").agg(*[F.sum(f"s{i}").alias(f"ts{i}") for i in width], *[F.sum(f"n{i}").alias(f"tn{i}") for i in width])
    turns = total.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)).cast("array<bigint>")))
    left = turns.join(sums.withColumn("fold", F.col("fold").cast("bigint")), [*by, "entity_id", "fold"], "left").na.fill(0.0).na.fill(0)
    means = [F.when(F.col(f"tn{i}") > F.col(f"n{i}"), (F.col(f"ts{i}") - F.col(f"s{i}")) / (F.col(f"tn{i}") - F.col(f"n{i}"))).otherwise(0.0).alias(f"g{i}") for i in width]
    return left.select(*by, "entity_id", F.col("fold").alias("without"), *means)


def edge_surprise(values: DataFrame, arcs: DataFrame, seed: int = 11, folds: int = FOLDS) -> tuple[DataFrame, DataFrame]:
    """(accounts, scored): -log p of every arc from a model that did not see it, averaged per endpoint.

    ``values`` holds scaled account features. Accounts without an arc have no row.
    """
    accounts, scored = edge_surprises(values, arcs, (seed,), folds)
    return accounts.drop("seed"), scored.drop("seed")


def edge_surprises(values: DataFrame, arcs: DataFrame, seeds: Sequence[int], folds: int = FOLDS) -> tuple[DataFrame, DataFrame]:
    """``edge_surprise`` for every seed, with the seed as a column.

    Folds, means, drawn pairs and vectors of all seeds and folds are made together, so the number of jobs
    does not grow with them; only the models are fitted one by one, several at a time.
    """
    arcs = durable(arcs.select("src", "dst").distinct())
    total = arcs.count()
    k = min(folds, total)
    if not k:
        no_seed = F.lit(seeds[0]).alias("seed")
        empty = arcs.select(no_seed, F.col("src").alias("entity_id"), F.lit(0.0).alias("edge_value")).limit(0)
        return empty, arcs.select("src", "dst", F.lit(0.0).alias("surprise"), F.lit(0).alias("fold"), no_seed).limit(0)
    drawn = F.array(*[F.struct(F.lit(s).alias("seed"), _fraction("src", "dst", F.lit(str(s))).alias("h")) for s in seeds])
    ordered = durable(positions(arcs.select("src", "dst", F.inline(drawn)), ["seed"], ["h", "src", "dst"], "n"))
    names = list(graph.ACCOUNT_FEATURES)
    mine = values.where("node_type = 'account'")
    own = durable(_wide(mine, names))
    edges = ordered.select("seed", "src", "dst", ((F.col("n") - 1) % k).cast("int").alias("fold"))
    width = len(names)
    model = ["seed", "without"]
    around = fold_means(mine, edges, names, k, ["seed"]).withColumn("without", F.col("without").cast("int"))
    turns = [(s, fold) for s in seeds for fold in range(k)]
    # One row per model: some seeds times a few folds.
    models = F.array(*[F.struct(F.lit(s).alias("seed"), F.lit(fold).alias("without"), F.lit(s + fold).cast("bigint").alias("draw_seed")) for s, fold in turns])
    both = durable(own.select("*", F.inline(models)).drop("draw_seed").join(around, ["entity_id", *model], "left").na.fill(0.0))
    negative = negative_edge_sets(own.select(F.col("entity_id").alias("account")), arcs, max(total - total // k, 1),
                                  sorted({s + fold for s, fold in turns}))
    negative = negative.join(F.broadcast(arcs.sparkSession.range(1).select(F.inline(models))), "draw_seed").select(
        *model, "src", "dst", F.lit("train").alias("part"), F.lit(0.0).alias("label"))
    # An arc is held by the model of its fold and trains the others; a lone arc does both.
    roles = F.when(F.col("fold") != F.col("without"), F.array(F.lit("train"))).when(
        F.lit(k > 1), F.array(F.lit("held"))).otherwise(F.array(F.lit("train"), F.lit("held")))
    positive = edges.withColumn("without", F.explode(F.array(*[F.lit(f) for f in range(k)]))).select(
        *model, "src", "dst", F.explode(roles).alias("part"), F.lit(1.0).alias("label"))
    columns = [f"f{i}" for i in range(width)] + [f"g{i}" for i in range(width)]
    left = both.select(*model, F.col("entity_id").alias("src"), *[F.col(c).alias(f"s_{c}") for c in columns])
    right = both.select(*model, F.col("entity_id").alias("dst"), *[F.col(c).alias(f"d_{c}") for c in columns])
    pairs = positive.unionByName(negative).join(left, [*model, "src"]).join(right, [*model, "dst"])
    pairs = pairs.select(*model, "part", "src", "dst", "label", *[(F.col(f"s_{c}") * F.col(f"d_{c}")).alias(f"p_{c}") for c in columns])
    vectors = VectorAssembler(inputCols=[f"p_{c}" for c in columns], outputCol="v").transform(pairs)
    vectors = durable(vectors.select("src", "dst", "label", "v", *model, "part"), by=(*model, "part"))

    def of(turn: tuple[int, int], part: str) -> DataFrame:
        return vectors.where((F.col("seed") == turn[0]) & (F.col("without") == turn[1]) & (F.col("part") == part))

    def fit(turn: tuple[int, int]) -> LogisticRegressionModel:
        return LogisticRegression(featuresCol="v", labelCol="label", maxIter=10, regParam=0.1).fit(of(turn, "train").select("label", "v"))

    with ThreadPool(min(AT_ONCE, len(turns))) as pool:
        fitted = pool.map(inheritable_thread_target(arcs.sparkSession)(fit), turns, chunksize=1)
    told = [m.transform(of(turn, "held")).select("src", "dst", vector_to_array("probability")[1].alias("p"), F.col("without").alias("fold"), "seed")
            for turn, m in zip(turns, fitted, strict=True)]
    scored = durable(reduce(DataFrame.unionByName, told).select(
        "src", "dst", (-F.log(F.greatest("p", F.lit(1e-9)))).alias("surprise"), "fold", "seed"))
    forget(vectors)
    ends = scored.select("seed", F.explode(F.array("src", "dst")).alias("entity_id"), "surprise")
    return ends.groupBy("seed", "entity_id").agg(F.avg("surprise").alias("edge_value")), scored


def peer_percentile(values: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """Add ``name``: share of peers below, ties counted half; 0.5 for a lone node.

    Equal values are counted before the sort, so ties cost one row.
    """
    counts = durable(values.groupBy(*group, value).agg(F.count(F.lit(1)).alias("__n")))
    below = running_total(counts, group, [value], F.col("__n"), "__below")
    sizes = counts.groupBy(*group).agg(F.sum("__n").alias("__size"))
    rank = (F.col("__below") + (F.col("__n") - 1) / F.lit(2.0)) / (F.col("__size") - 1)
    told = below.join(sizes, group).select(*group, value, F.when(F.col("__size") > 1, rank).otherwise(F.lit(0.5)).alias(name))
    return values.join(told, [*group, value])


def node_score(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the feature percentile and, where an edge was scored, the edge percentile.

    ``scores`` has (node_type, entity_id, feature_value, edge_value); accounts
    without a scored edge are no peers for the edge percentile. ``by`` names
    columns that keep whole sets of scores apart, such as the seed.
    """
    ranked = peer_percentile(scores.select(*by, *NODE, "feature_value"), [*by, "node_type"], "feature_value", "feature_percentile")
    active = scores.where("node_type = 'account' AND edge_value IS NOT NULL").select(*by, *NODE, "edge_value")
    edges = peer_percentile(active, [*by, "node_type"], "edge_value", "edge_percentile")
    df = ranked.join(edges, [*by, *NODE], "left")
    both = (F.col("feature_percentile") + F.col("edge_percentile")) / 2
    return df.withColumn("score", F.coalesce(both, F.col("feature_percentile")))


def seed_stability(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stable, problems) over (seed, node_type, entity_id, score, feature_percentile, edge_percentile).

    There are few seeds, so the values of one node fit a row. A key that repeats
    within a seed, or is missing from one, is a problem.
    """
    middle = F.lit(0.5)
    keyed = runs.groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("seed").alias("seeds"),
        F.percentile("score", middle).alias("median_score"), F.percentile("feature_percentile", middle).alias("median_feature_percentile"),
        F.percentile("edge_percentile", middle).alias("median_edge_percentile"),
        (F.percentile("score", F.lit(0.75)) - F.percentile("score", F.lit(0.25))).alias("score_iqr"),
        F.stddev_pop("score").alias("score_std"), F.min("score").alias("score_min"), F.max("score").alias("score_max"))
    seeds = runs.select("seed").distinct().count()
    problem = F.when(F.col("rows") > F.col("seeds"), "key repeats within a seed").when(F.col("seeds") < seeds, "key is missing from a seed")
    return keyed.drop("rows", "seeds"), keyed.withColumn("problem", problem).where("problem IS NOT NULL").select(*NODE, "problem")


def select_candidates(stable: DataFrame, min_peers: int = MIN_PEERS, min_median: float = MIN_MEDIAN, max_iqr: float = MAX_IQR,
                      top: int = TOP_PER_TYPE) -> DataFrame:
    """The first few nodes of each type that stand out in every run."""
    peers = stable.groupBy("node_type").agg(F.count(F.lit(1)).alias("peer_count"))
    fit = stable.join(peers, "node_type").where(
        (F.col("peer_count") >= min_peers) & (F.col("median_score") >= min_median) & (F.col("score_iqr") <= max_iqr))
    return top_rows(fit, ["node_type"], [F.desc("median_score"), F.col("score_iqr"), F.col("entity_id")], top, "rank")


def _evidence_groups(estate: Estate, picked: DataFrame) -> DataFrame:
    """(node_type, entity_id, group_no, source_table, record_id, weight) of every record tied to a candidate."""
    none = F.lit(0.0)

    def of(kind: str, key: str) -> DataFrame:
        return picked.where(F.col("node_type") == kind).select(*NODE, F.col("entity_id").alias(key))

    def rows(df: DataFrame, number: int, table: str, record: str, weight: Column = none) -> DataFrame:
        return df.select(*NODE, F.lit(number).alias("group_no"), F.lit(table).alias("source_table"),
                         F.col(record).cast("string").alias("record_id"), F.coalesce(F.abs(weight.cast("double")), none).alias("weight"))

    v, e, a = (of("vendor", "rfc"), of("employee", "emp_id"), of("account", "account"))
    bank = estate.bank_txns.select("txn_id", "amount", F.explode(F.array_distinct(F.array(clean_text("from_clabe"), clean_text("to_clabe")))).alias("account"))
    bills = estate.invoices.select(clean_text("issuer_rfc").alias("rfc"), "uuid", "total").join(v, "rfc")
    orders = estate.purchase_orders.select(clean_text("vendor_rfc").alias("rfc"), "po_id", "amount").join(v, "rfc")
    deals = estate.contracts.select(clean_text("vendor_rfc").alias("rfc"), "contract_id", "value").join(v, "rfc")
    known = estate.vendors.select(clean_text("rfc").alias("rfc"), clean_text("bank_clabe").alias("account"))
    staff = estate.employees.select(clean_text("emp_id").alias("emp_id"), clean_text("bank_clabe").alias("account"))
    parts = [
        rows(known.join(v, "rfc"), 1, "vendors", "rfc"),
        rows(estate.efos_list.select(clean_text("rfc").alias("rfc")).join(v, "rfc"), 2, "efos_list", "rfc"),
        rows(bills, 3, "invoices", "uuid", F.col("total")), rows(orders, 4, "purchase_orders", "po_id", F.col("amount")),
        rows(deals, 5, "contracts", "contract_id", F.col("value")),
        rows(estate.ledger.join(bills.withColumnRenamed("uuid", "invoice_uuid"), "invoice_uuid"), 6, "ledger", "entry_id"),
        rows(bank.join(known.join(v, "rfc").select(*NODE, "account"), "account"), 7, "bank_txns", "txn_id", F.col("amount")),
        rows(staff.join(e, "emp_id"), 1, "employees", "emp_id"),
        rows(bank.join(staff.join(e, "emp_id").select(*NODE, "account"), "account"), 2, "bank_txns", "txn_id", F.col("amount")),
        rows(known.join(a, "account"), 1, "vendors", "rfc"), rows(staff.join(a, "account"), 2, "employees", "emp_id"),
        rows(bank.join(a, "account"), 3, "bank_txns", "txn_id", F.col("amount")),
    ]
    return reduce(DataFrame.unionByName, parts)


def candidate_evidence(estate: Estate, picked: DataFrame, limit: int = EVIDENCE_LIMIT) -> DataFrame:
    """Up to ``limit`` records per candidate, taken in turn from its groups, largest amounts first."""
    groups = _evidence_groups(estate, picked).groupBy(*NODE, "group_no", "source_table", "record_id").agg(F.max("weight").alias("weight"))
    inside = top_rows(groups, [*NODE, "group_no"], [F.desc("weight"), F.col("record_id")], limit, "turn")
    # At most seven groups of ``limit`` rows are left per candidate.
    order = Window.partitionBy(*NODE).orderBy("turn", "group_no")
    ranked = inside.withColumn("position", F.row_number().over(order).cast("bigint"))
    return ranked.where(F.col("position") <= limit).select(*NODE, "position", "source_table", "record_id")


def feature_deviation_context(scaled: DataFrame, picked: DataFrame, top: int = TOP_FEATURES) -> DataFrame:
    """The features of each candidate that lie furthest from its peers. A node has few features."""
    mine = scaled.join(picked.select(*NODE), NODE, "left_semi")
    order = Window.partitionBy(*NODE).orderBy(F.desc(F.abs("scaled")), "feature")
    ranked = mine.withColumn("rank", F.row_number().over(order).cast("bigint"))
    return ranked.where(F.col("rank") <= top).select(*NODE, "rank", "feature", "raw_value", "scaled")


def score_nodes(estate: Estate, seeds: tuple[int, ...] = (11, 17, 23)) -> tuple[DataFrame, DataFrame]:
    """(runs, scaled): node scores for every seed; the seed moves the folds and the drawn pairs."""
    if len(set(seeds)) != len(seeds) or not seeds:
        raise ValueError("seeds must be present and unique")
    scaled = durable(graph.robust_peer_scale(graph.long_features(graph.node_features(estate))))
    values = scaled.select(*NODE, "feature", F.col("scaled").alias("value"))
    edges = durable(relations(estate))
    around = durable(neighbour_means(values, edges, edge_values=transfer_attributes(estate)))
    errors = durable(masked_feature_error(values, around))
    arcs = edges.where("relation = 'transfers'").select("src", "dst")
    surprise, _ = edge_surprises(values, arcs, seeds)
    every = errors.withColumnRenamed("error", "feature_value").withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    scores = durable(every.join(surprise.withColumn("node_type", F.lit("account")), ["seed", *NODE], "left"))
    return durable(node_score(scores, ["seed"])), scaled


def ranking_observations(estate: Estate, stable: DataFrame, scaled: DataFrame) -> Observations:
    """Candidates with at least one record, as observations with a declared score meaning."""
    picked = durable(select_candidates(stable))
    refs = durable(candidate_evidence(estate, picked))
    picked = picked.join(refs.select(*NODE).distinct(), NODE, "left_semi").withColumn(
        "observation_id", observation_id("GNN", "RELATIONAL", ["node_type", "entity_id"]))
    # Five entries per candidate at most.
    context = feature_deviation_context(scaled, picked).groupBy(*NODE).agg(
        F.array_sort(F.collect_list(F.struct("rank", "feature", "raw_value", "scaled"))).alias("deviations"))
    full = picked.join(context, NODE, "left")
    text = F.format_string("%s %s stands out among its peers in these books.", F.initcap("node_type"), "entity_id")
    heads = make_heads(full, "peer_ranking", "gnn_relational_anomaly", text,
                       ["node_type", "entity_id", "median_score", "score_iqr", "peer_count", "rank", "deviations"],
                       F.col("median_score"), "relative rank among peers of one type; not a probability")
    kind = F.col("node_type")
    name = F.when(kind == "vendor", F.concat(F.lit("RFC:"), "entity_id")).when(
        (kind == "employee") & ~F.col("entity_id").startswith("EMP:"), F.concat(F.lit("EMP:"), "entity_id")).when(
        kind == "account", F.concat(F.lit("CLABE:"), "entity_id")).otherwise(F.col("entity_id"))
    entities = full.select("observation_id", F.lit(0).alias("section"), name.alias("entity"))
    rows = refs.join(full.select(*NODE, "observation_id"), NODE).select("observation_id", "source_table", "record_id",
                                                                         F.lit(None).cast("string").alias("note"))
    return Observations(heads, entities, rows)

