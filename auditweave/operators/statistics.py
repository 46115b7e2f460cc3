"""Reconciliation and statistical detectors.

Records behind an observation are returned as rows of their own, so one invoice
or vendor may own any share of the payments.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave.functions.clean import money, observation_id
from auditweave.operators.forest import isolation_scores
from auditweave.operators.observations import member_digest
from auditweave.operators.ordering import exact_quantiles, running_total
from auditweave.session import durable

# Evidence model.
PRIOR = 0.02
EVIDENCE = ("e1_match", "e2_entropy", "e3_temporal", "e4_outlier")
IF_ANOMALY = (0.85, 0.70, 0.65, 0.80)
IF_LEGITIMATE = (0.03, 0.05, 0.08, 0.10)
WEIGHTS = (0.35, 0.25, 0.20, 0.20)
EVIDENCE_LABELS = (
    ("LEDGER_UNDER_RECORDING", "OVERPAYMENT", "UNDERPAYMENT"),
    ("ENTROPY_COLLAPSE_STRUCTURED_PATTERN",),
    ("OFF_HOURS_EXECUTION", "HIGH_VELOCITY_BURST"),
    ("MULTIDIMENSIONAL_ISOLATION_ANOMALY",),
)


# T1

def triple_reconciliation(invoices: DataFrame, payments: DataFrame, ledger: DataFrame | None = None,
                          tolerance: float = 0.01) -> DataFrame:
    """Invoices against payments and ledger; one row per invoice id that disagrees."""
    paid = payments.groupBy("invoice_id").agg(F.sum(money("payment_amount")).alias("paid"))
    billed = invoices.groupBy("invoice_id").agg(F.sum(money("total_amount")).alias("billed"))
    df = billed.join(paid, "invoice_id", "full_outer")
    if ledger is not None:
        booked = ledger.groupBy("invoice_id").agg(F.sum(money("recorded_amount")).alias("booked"))
        df = df.join(booked, "invoice_id", "full_outer")
    else:
        df = df.withColumn("booked", F.lit(None).cast("decimal(28,2)"))
    zero = F.lit(0).cast("decimal(28,2)")
    df = df.select("invoice_id", *[F.coalesce(F.col(c).cast("decimal(28,2)"), zero).alias(c) for c in ("billed", "paid", "booked")])
    diff = {"pi": F.col("paid") - F.col("billed"), "lp": F.col("booked") - F.col("paid"), "li": F.col("booked") - F.col("billed")}
    df = df.select("*", *[v.cast("double").alias(k) for k, v in diff.items()])
    off_paid = F.abs("pi") > tolerance
    off_books = ((F.abs("lp") > tolerance) | (F.abs("li") > tolerance)) & F.lit(ledger is not None)
    billed_d, paid_d = F.col("billed").cast("double"), F.col("paid").cast("double")
    ratio = F.when(billed_d > 0, F.least(F.abs("pi") / billed_d, F.lit(1.0))).otherwise(F.lit(1.0))
    label = (
        F.when(~off_paid & (F.col("lp") < 0), "LEDGER_UNDER_RECORDING").when(~off_paid, "LEDGER_OVER_RECORDING")
        .when((billed_d == 0) & (paid_d > 0), "ORPHAN_PAYMENT").when((paid_d == 0) & (billed_d > 0), "UNPAID_INVOICE")
        .when(F.col("pi") > 0, "OVERPAYMENT").otherwise("UNDERPAYMENT")
    )
    score = (
        F.when(F.col("mismatch_type") == "LEDGER_UNDER_RECORDING", 0.90).when(F.col("mismatch_type") == "LEDGER_OVER_RECORDING", 0.80)
        .when(F.col("mismatch_type") == "ORPHAN_PAYMENT", 0.85).when(F.col("mismatch_type") == "UNPAID_INVOICE", 0.40)
        .when(F.col("mismatch_type") == "OVERPAYMENT", F.round(0.5 + 0.5 * ratio, 2)).otherwise(F.round(0.2 + 0.3 * ratio, 2))
    )
    return df.where(off_paid | off_books).withColumn("mismatch_type", label).select(
        "invoice_id", billed_d.alias("invoiced_amount"), paid_d.alias("paid_amount"), F.col("booked").cast("double").alias("ledger_amount"),
        F.col("pi").alias("diff_payment_invoice"), F.col("lp").alias("diff_ledger_payment"), F.col("li").alias("diff_ledger_invoice"),
        "mismatch_type", score.alias("score"))


def reconciliation_records(found: DataFrame, payments: DataFrame, ledger: DataFrame) -> DataFrame:
    """(invoice_id, kind, record_id) behind each row of ``triple_reconciliation``."""
    keys = found.select("invoice_id")
    own = found.where("invoiced_amount > 0").select("invoice_id", F.lit("invoice").alias("kind"), F.col("invoice_id").alias("record_id"))
    paid = payments.join(keys, "invoice_id", "left_semi").select("invoice_id", F.lit("payment").alias("kind"), F.col("payment_id").alias("record_id"))
    booked = ledger.join(keys, "invoice_id", "left_semi").select("invoice_id", F.lit("ledger").alias("kind"), F.col("transaction_id").alias("record_id"))
    return own.unionByName(paid).unionByName(booked)


# T2, T11

def value_entropy(df: DataFrame, value: str, group: str) -> DataFrame:
    """Shannon entropy of the values of each group, over the largest it could be."""
    counts = df.where(F.col(group).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    rows = counts.groupBy(group).agg(F.sum("c").alias("n"))
    share = F.col("c") / F.col("n")
    known = counts.where(F.col(value).isNotNull()).join(rows, group)
    stats = known.groupBy(group).agg(
        F.max("n").alias("sample_size"), F.count(F.lit(1)).alias("unique_values"),
        F.sum(-share * F.log2(share)).alias("raw"),
        F.min(F.struct((-F.col("c")).alias("c"), F.col(value).alias("v"))).alias("top"),
    )
    size = F.col("sample_size")
    entropy = F.when(F.abs("raw") > 1e-12, F.abs("raw")).otherwise(0.0)
    ceiling = F.when(size > 1, F.log2(size)).otherwise(1.0)
    return stats.withColumn("entropy", entropy).withColumn("max_entropy", ceiling).select(
        group, "sample_size", "unique_values", "entropy", "max_entropy",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("entropy") / F.col("max_entropy"))).alias("normalized"),
        F.col("top.v").alias("dominant_value"), (-F.col("top.c")).alias("dominant_count"))


def entropy_collapse(df: DataFrame, value: str, group: str, threshold: float = 0.35, min_samples: int = 3) -> DataFrame:
    """Groups whose values repeat far more than their number suggests."""
    stats = value_entropy(df, value, group).where(F.col("sample_size") >= min_samples)
    low = stats.withColumn("normalized", F.round("normalized", 4)).where(F.col("normalized") < threshold)
    return low.select(
        group, "sample_size", "unique_values", F.round("entropy", 4).alias("shannon_entropy"), F.round("max_entropy", 4).alias("max_entropy"),
        F.col("normalized").alias("normalized_entropy"), "dominant_value", "dominant_count",
        F.round(F.col("dominant_count") / F.col("sample_size"), 4).alias("dominant_ratio"), F.round(1 - F.col("normalized"), 2).alias("score"),
        F.lit("ENTROPY_COLLAPSE_STRUCTURED_PATTERN").alias("mismatch_type"))


def verify_entropy_claims(claims: DataFrame, df: DataFrame, value: str, group: str, threshold: float = 0.25) -> DataFrame:
    """Recompute each claimed collapse against a stricter bound; an absent entity is an error."""
    stats = value_entropy(df.join(claims.select(group).distinct(), group, "left_semi"), value, group)
    out = claims.join(stats, group, "left")
    collapsed = F.coalesce(F.col("normalized") < threshold, F.lit(False))
    error = F.when(F.col("sample_size").isNull(), "no recorded transactions").when(~collapsed, "entropy shows no collapse")
    return out.select("claim_id", group, "sample_size", F.round("entropy", 4).alias("shannon_entropy"),
                      F.round("normalized", 4).alias("normalized_entropy"), collapsed.alias("verified"), error.alias("error"))


# T3

def off_hours(df: DataFrame, timestamp: str = "timestamp", night_start: int = 23, night_end: int = 5) -> DataFrame:
    """Transactions at night or at the weekend."""
    hour, weekend = F.hour(timestamp), F.weekday(timestamp) >= 5
    night = (hour >= night_start) | (hour < night_end)
    rows = df.withColumn("hour", hour).withColumn("is_night", night).withColumn("is_weekend", weekend).where("is_night OR is_weekend")
    reasons = F.array_compact(F.array(F.when(F.col("is_night"), "night"), F.when(F.col("is_weekend"), "weekend")))
    score = F.when(F.col("is_night") & F.col("is_weekend"), 0.80).when(F.col("is_night"), 0.70).otherwise(0.60)
    return rows.withColumn("reasons", reasons).withColumn("score", score).withColumn("mismatch_type", F.lit("OFF_HOURS_EXECUTION"))


# T4

def _reached(nodes: DataFrame, vendor: str) -> DataFrame:
    """Nodes on the greedy path, by pointer doubling.

    ``nodes`` has (vendor, node, next, root); ``next`` is NULL where a stretch
    ends. A path of n bursts takes log2(n) joins.
    """
    on_path = durable(nodes.where("root").select(vendor, "node"))
    jump = durable(nodes.where("next IS NOT NULL").select(vendor, "node", "next"))
    while not jump.isEmpty():
        landed = on_path.join(jump, [vendor, "node"]).select(vendor, F.col("next").alias("node"))
        on_path = durable(on_path.unionByName(landed).distinct())
        further = jump.select(vendor, F.col("node").alias("next"), F.col("next").alias("beyond"))
        jump = durable(jump.join(further, [vendor, "next"]).select(vendor, "node", F.col("beyond").alias("next")))
    return on_path


def _near_bursts(rows: DataFrame, vendor: str, width: int, min_count: int) -> DataFrame:
    """The rows that a burst may hold.

    A window is as wide as a bucket, so it lies in two neighbours. Where no two neighbours hold more than
    ``min_count`` rows together no window does, and rows that share no such pair are in no burst.
    """
    bucket = F.floor(F.col("at") / F.lit(max(width, 1))).alias("bucket")
    rows = rows.withColumn("bucket", bucket)
    counts = rows.groupBy(vendor, "bucket").agg(F.count(F.lit(1)).alias("n"))
    pairs = counts.select(vendor, F.explode(F.array(F.col("bucket"), F.col("bucket") - 1)).alias("pair"), "n")
    full = pairs.groupBy(vendor, "pair").agg(F.sum("n").alias("n")).where(F.col("n") > min_count)
    wanted = full.select(vendor, F.explode(F.array(F.col("pair"), F.col("pair") + 1)).alias("bucket")).distinct()
    return rows.join(wanted, [vendor, "bucket"], "left_semi").drop("bucket")


def velocity_burst(df: DataFrame, vendor: str = "vendor_id", timestamp: str = "timestamp", id_column: str = "transaction_id",
                   minutes: float = 5.0, min_count: int = 3) -> tuple[DataFrame, DataFrame]:
    """(bursts, members): greedy runs of more than ``min_count`` rows inside ``minutes``.

    Rows are numbered in time order per vendor. Each row also asks how many rows
    lie up to its window's end; question and rows are sorted together, so no
    vendor or minute has to fit one task. A row with enough followers may open a
    burst, and the next opener at or after its end continues the path. Rows in
    stretches too thin for a burst are left out before anything is sorted.
    """
    micros = F.unix_micros(F.col(timestamp).cast("timestamp"))
    rows = df.where(F.col(vendor).isNotNull() & F.col(timestamp).isNotNull()).select(
        F.col(vendor), F.col(id_column).alias("id"), micros.alias("at"), money("amount").alias("amount"))
    width = int(round(minutes * 60_000_000))
    rows = durable(_near_bursts(rows, vendor, width, min_count))
    marks = F.array(F.struct(F.col("at").alias("key"), F.lit(0).alias("kind")), F.struct((F.col("at") + width).alias("key"), F.lit(1).alias("kind")))
    asked = running_total(rows.select(vendor, "id", "at", "amount", F.inline(marks)), [vendor], ["key", "kind", "id"],
                          F.when(F.col("kind") == 0, 1).otherwise(0).cast("bigint"), "n")
    placed = durable(asked.groupBy(vendor, "id").agg(
        F.max("at").alias("at"), F.max("amount").alias("amount"),
        F.max(F.when(F.col("kind") == 0, F.col("n"))).alias("pos"), F.max(F.when(F.col("kind") == 1, F.col("n"))).alias("stop")))
    openers = placed.where(F.col("stop") - F.col("pos") > min_count).select(vendor, "pos", "stop")
    marks = F.array(F.struct(F.col("pos").alias("key"), F.lit(1).alias("kind")), F.struct(F.col("stop").alias("key"), F.lit(0).alias("kind")))
    counted = running_total(openers.select(vendor, "pos", "stop", F.inline(marks)), [vendor], ["key", "kind", "pos"],
                            F.when(F.col("kind") == 1, 1).otherwise(0).cast("bigint"), "n")
    nodes = durable(counted.groupBy(vendor, "pos", "stop").agg(
        F.max(F.when(F.col("kind") == 1, F.col("n"))).alias("node"), F.max(F.when(F.col("kind") == 0, F.col("n"))).alias("next")))
    # Windows end in the order in which they begin, so only the opener before can reach over this one.
    before = nodes.select(vendor, (F.col("node") + 1).alias("node"), F.col("stop").alias("reach"))
    nodes = nodes.join(before, [vendor, "node"], "left").withColumn("root", F.col("reach").isNull() | (F.col("reach") <= F.col("pos")))
    roots = nodes.select(vendor, F.col("node").alias("next"), F.col("root").alias("next_root"))
    linked = nodes.join(roots, [vendor, "next"], "left").withColumn(
        "next", F.when(~F.coalesce("next_root", F.lit(True)), F.col("next"))).drop("next_root", "reach")
    linked = durable(linked)
    bursts = linked.join(_reached(linked, vendor), [vendor, "node"], "left_semi").select(vendor, "pos", "stop")
    # Each row belongs to the last burst that begins at or before it, if that burst still runs.
    starts = bursts.select(vendor, F.col("pos").alias("key"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("id"), "stop",
                           F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("decimal(18,2)").alias("amount"))
    items = placed.select(vendor, F.col("pos").alias("key"), F.lit(1).alias("kind"), F.col("id").cast("string").alias("id"),
                          F.lit(None).cast("bigint").alias("stop"), "at", "amount")
    mixed = durable(running_total(starts.unionByName(items), [vendor], ["key", "kind"],
                                  F.when(F.col("kind") == 0, 1).otherwise(0).cast("bigint"), "n"))
    ends = mixed.where("kind = 0").select(vendor, (F.col("n") + 1).alias("burst"), F.col("stop").alias("burst_stop"))
    members = mixed.where("kind = 1").select(vendor, F.col("n").alias("burst"), F.col("key").alias("pos"), "id", "at", "amount")
    members = members.join(ends, [vendor, "burst"]).where("pos < burst_stop").drop("burst_stop", "pos")
    seconds = (F.max("at") - F.min("at")) / F.lit(1_000_000.0)
    summary = members.groupBy(vendor, "burst").agg(
        F.count(F.lit(1)).alias("transaction_count"), F.timestamp_micros(F.min("at")).cast("string").alias("window_start"),
        F.timestamp_micros(F.max("at")).cast("string").alias("window_end"), F.round(seconds, 2).alias("duration_seconds"),
        F.sum("amount").cast("double").alias("total_burst_amount"), F.lit(0.85).alias("score"),
        F.lit("HIGH_VELOCITY_BURST").alias("mismatch_type"))
    return summary, members.select(vendor, "burst", F.col("id").alias(id_column))


# T5

def isolation_forest(df: DataFrame, features: tuple[str, ...] = ("amount", "hour"), contamination: float = 0.1,
                     seed: int = 42, id_column: str = "transaction_id") -> DataFrame:
    """Rows in the lowest ``contamination`` share of the forest's scores.

    Not equal bit for bit to any other library's forest; equal to itself for one seed.
    """
    filled = df
    for name in features:
        filled = filled.withColumn(name, F.coalesce(F.col(name).cast("double"), F.lit(0.0)))
    scored = durable(isolation_scores(filled, list(features), id_column, seed))
    cut = exact_quantiles(scored, [], "raw_score", [contamination], prefix="cut")
    edge = cut.first()
    if edge is None:
        return scored.withColumn("score", F.lit(0.0)).withColumn("mismatch_type", F.lit("")).limit(0)
    low, high = scored.agg(F.min("raw_score"), F.max("raw_score")).first()
    width = (high - low) if high > low else 1.0
    return scored.where(F.col("raw_score") < F.lit(edge[0])).withColumn(
        "score", F.round(1 - (F.col("raw_score") - F.lit(low)) / F.lit(width), 2)).withColumn(
        "decision", F.round(F.col("raw_score") - F.lit(edge[0]), 4)).withColumn(
        "mismatch_type", F.lit("MULTIDIMENSIONAL_ISOLATION_ANOMALY"))


# T6 - T9

@dataclass(frozen=True)
class StatisticalPack:
    """The statistical observations and what they rest on, one row per record."""

    heads: DataFrame  # observation_id, rule_or_model, vendor_id, group_by_value, invoice_id, mismatch_type, anomaly_score, facts
    records: DataFrame  # observation_id, target, kind, record_id


TARGET = ("vendor_id", "group_by_value", "invoice_id")


def target_of() -> Column:
    """Whom an observation is about."""
    return F.coalesce(*TARGET, F.lit("UNKNOWN_ENTITY"))


def _heads(found: DataFrame, model: str, facts: Sequence[str], **targets: str) -> DataFrame:
    def pick(name: str) -> Column:
        return (F.col(targets[name]).cast("string") if name in targets else F.lit(None).cast("string")).alias(name)

    return found.select("observation_id", F.lit(model).alias("rule_or_model"), *map(pick, TARGET), "mismatch_type",
                        F.col("score").cast("double").alias("anomaly_score"), F.to_json(F.struct(*facts)).alias("facts"))


def _of_group(found: DataFrame, records: DataFrame, keys: Sequence[str], model: str, facts: Sequence[str], **targets: str) -> StatisticalPack:
    """Observations with records (``keys``, kind, record_id); the id digests the records, in no order."""
    keys = list(keys)
    records = durable(records.select(*keys, "kind", F.col("record_id").cast("string").alias("record_id")).distinct())
    digests = records.withColumn("__member", F.concat_ws(":", "kind", "record_id")).groupBy(*keys).agg(member_digest("__member").alias("digest"))
    tag = model.upper().replace("_", "-")
    named = durable(found.join(digests, keys, "left").withColumn("observation_id", observation_id("STA", tag, [*targets.values(), "digest"])))
    heads = _heads(named, model, facts, **targets)
    owned = records.join(named.select(*keys, "observation_id", F.col(next(iter(targets.values()))).cast("string").alias("target")), keys)
    return StatisticalPack(heads, owned.select("observation_id", "target", "kind", "record_id"))


def _of_rows(found: DataFrame, id_column: str, model: str, facts: Sequence[str]) -> StatisticalPack:
    """Observations of single transactions."""
    tag = model.upper().replace("_", "-")
    named = found.withColumn("observation_id", observation_id("STA", tag, ["vendor_id", id_column]))
    records = named.select("observation_id", F.coalesce(F.col("vendor_id").cast("string"), F.lit("UNKNOWN_ENTITY")).alias("target"),
                           F.lit(id_column).alias("kind"), F.col(id_column).cast("string").alias("record_id"))
    return StatisticalPack(_heads(named, model, facts, vendor_id="vendor_id"), records)


def run_statistical_pack(invoices: DataFrame, payments: DataFrame, ledger: DataFrame, transactions: DataFrame,
                         minutes: float = 5.0, id_column: str = "transaction_id") -> StatisticalPack:
    """All statistical detectors: heads with ids and facts, and the records behind each."""
    differs = durable(triple_reconciliation(invoices, payments, ledger))
    even = durable(entropy_collapse(transactions, "amount", "vendor_id"))
    repeated = transactions.join(even.select("vendor_id"), "vendor_id").select(
        "vendor_id", F.lit(id_column).alias("kind"), F.col(id_column).alias("record_id"))
    late = off_hours(transactions).withColumn("reasons", F.array_join("reasons", ",")).withColumn("at", F.col("timestamp").cast("string"))
    bursts, members = map(durable, velocity_burst(transactions, id_column=id_column, minutes=minutes))
    lonely = isolation_forest(transactions.withColumn("hour", F.hour("timestamp")), id_column=id_column)
    parts = [
        _of_group(differs, reconciliation_records(differs, payments, ledger), ["invoice_id"], "triple_reconciliation",
                  ["invoiced_amount", "paid_amount", "ledger_amount", "diff_payment_invoice", "diff_ledger_payment", "diff_ledger_invoice"],
                  invoice_id="invoice_id"),
        _of_group(even, repeated, ["vendor_id"], "entropy",
                  ["sample_size", "unique_values", "shannon_entropy", "max_entropy", "normalized_entropy", "dominant_value", "dominant_count", "dominant_ratio"],
                  group_by_value="vendor_id"),
        _of_rows(late, id_column, "off_hours", [id_column, "at", "hour", "is_night", "is_weekend", "amount", "reasons"]),
        _of_group(bursts, members.select("vendor_id", "burst", F.lit(id_column).alias("kind"), F.col(id_column).alias("record_id")), ["vendor_id", "burst"],
                  "velocity_burst", ["transaction_count", "window_start", "window_end", "duration_seconds", "total_burst_amount"], vendor_id="vendor_id"),
        _of_rows(durable(lonely), id_column, "isolation_forest", [id_column, "amount", "hour", "decision"]),
    ]
    return StatisticalPack(*(reduce(DataFrame.unionByName, [getattr(p, name) for p in parts]) for name in ("heads", "records")))


def provenance(pack: StatisticalPack) -> DataFrame:
    """``target, kind, record_id``: what all observations of a target rest on, each record once."""
    return pack.records.select("target", "kind", "record_id").distinct()


def evidence_vector(observations: DataFrame) -> DataFrame:
    """Four flags per target. Labels are few, so their set stays an array."""
    target = target_of().alias("target")
    flags = [F.bool_or(F.col("mismatch_type").isin(*labels)).alias(name) for name, labels in zip(EVIDENCE, EVIDENCE_LABELS)]
    return observations.groupBy(target).agg(
        *flags, F.count(F.lit(1)).alias("observations"), F.sort_array(F.collect_set("mismatch_type")).alias("labels"))


def _product(rates: tuple[float, ...]) -> Column:
    factors = [F.when(F.col(name), F.lit(p)).otherwise(F.lit(1.0) - F.lit(p)) for name, p in zip(EVIDENCE, rates)]
    return reduce(lambda a, b: a * b, factors)


def naive_bayes_posterior(vectors: DataFrame) -> DataFrame:
    """Posterior of an anomaly per target; targets without any evidence are dropped."""
    anomaly, legitimate = _product(IF_ANOMALY), _product(IF_LEGITIMATE)
    joint, other = F.lit(PRIOR) * anomaly, F.lit(1.0 - PRIOR) * legitimate
    weighted = reduce(lambda a, b: a + b, [F.when(F.col(n), F.lit(w)).otherwise(0.0) for n, w in zip(EVIDENCE, WEIGHTS)])
    ratio = F.when(legitimate > 0, F.round(anomaly / legitimate, 2)).otherwise(F.lit(float("inf")))
    out = vectors.where(" OR ".join(EVIDENCE)).withColumn("posterior", F.round(joint / (joint + other), 4))
    out = out.withColumn("weighted", F.round(weighted, 4)).withColumn("likelihood_ratio", ratio)
    return out.withColumn("posterior_legit", F.round(1 - F.col("posterior"), 4)).withColumn(
        "difference", F.round(F.col("posterior") - F.col("weighted"), 4))


def posterior_bands(posteriors: DataFrame) -> DataFrame:
    """``band`` for the text of an observation, ``verdict`` for the comparison table: two scales by design."""
    p = F.col("posterior")
    return posteriors.withColumn("band", F.when(p >= 0.70, "high").when(p >= 0.15, "medium").otherwise("low")).withColumn(
        "verdict", F.when(p >= 0.80, "critical").when(p >= 0.20, "review").otherwise("discarded"))


# T10

def verify_reconciliation_claims(claims: DataFrame, cited: DataFrame, invoices: DataFrame, payments: DataFrame, ledger: DataFrame) -> DataFrame:
    """Recompute the exposure of each claim (claim_id, claim_type, invoice_id, claimed_exposure).

    ``cited`` (claim_id, kind, record_id) narrows payments or ledger rows to the
    cited ones, for claims that cite any.
    """
    keys = claims.select("claim_id", "invoice_id")
    narrowed = cited.groupBy("claim_id").agg(F.bool_or(F.col("kind") == "payment").alias("only_payments"), F.bool_or(F.col("kind") == "ledger").alias("only_ledger"))
    keys = keys.join(narrowed, "claim_id", "left").na.fill(False, ["only_payments", "only_ledger"])

    def total(rows: DataFrame, key: str, amount: str, kind: str, only: str) -> DataFrame:
        mine = cited.where(F.col("kind") == kind).select("claim_id", F.col("record_id").alias(key), F.lit(True).alias("cited")).distinct()
        hit = rows.join(keys, "invoice_id").join(mine, ["claim_id", key], "left").where(~F.col(only) | F.col("cited"))
        return hit.groupBy("claim_id").agg(F.sum(money(amount)).alias(f"{kind}_total"), F.count(F.lit(1)).alias(f"{kind}_records"))

    billed = invoices.groupBy("invoice_id").agg(F.max(money("total_amount")).alias("invoice_amount"))
    out = claims.join(billed, "invoice_id", "left").join(
        total(payments, "payment_id", "payment_amount", "payment", "only_payments"), "claim_id", "left").join(
        total(ledger, "transaction_id", "recorded_amount", "ledger", "only_ledger"), "claim_id", "left")
    zero = F.lit(0).cast("decimal(28,2)")
    found = F.col("invoice_amount").isNotNull()
    amount, paid, booked = (F.coalesce(F.col(c).cast("decimal(28,2)"), zero) for c in ("invoice_amount", "payment_total", "ledger_total"))
    exposure = F.when(F.lower("claim_type").contains("overpayment"), F.greatest(zero, paid - amount)).otherwise(F.greatest(zero, amount - paid))
    out = out.withColumn("exposure", exposure.cast("double"))
    errors = F.array_compact(F.array(
        F.when(~found, "invoice is not in the books"),
        F.when(F.abs(F.col("exposure") - F.col("claimed_exposure")) > 0.01, "exposure differs from the claim")))
    return out.select("claim_id", "invoice_id", amount.cast("double").alias("invoice_amount"), paid.cast("double").alias("total_payments"),
                      booked.cast("double").alias("total_ledger"), F.col("exposure").alias("calculated_exposure"),
                      (paid - booked).cast("double").alias("ledger_discrepancy"), (F.size(errors) == 0).alias("verified"),
                      F.array_join(errors, "; ").alias("errors"))
