"""The observation tables every detector fills.

An observation is one row of ``heads``. Its entities and its evidence are rows of
their own, because one shared account or one busy vendor can tie a large part of
the estate to a single observation, and an array of that size fits no task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Signal names in the order in which the detectors run.
SIGNALS = (
    "vendor_employee_shared_clabe",
    "shared_vendor_clabe",
    "vendor_efos_record_match",
    "vendor_to_employee_bank_transfer",
    "short_window_similar_invoice_cluster",
    "directed_bank_transfer_cycle",
    "paid_invoices_without_po_or_contract",
    "gnn_relational_anomaly",
)

# What a signal cannot show, what else could explain it, and what to look at next.
GUIDANCE: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "vendor_employee_shared_clabe": (
        ("One account on two records shows a link in these books and nothing about intent.",),
        ("A record entered twice or wrongly.", "The vendor is the employee, trading under their own name."),
        ("Read every transfer of the shared account.", "Ask for the document behind the relationship."),
    ),
    "shared_vendor_clabe": (
        ("Several vendors on one account are not thereby one owner.",),
        ("A group with one treasury.", "A payment service that collects for several vendors."),
        ("Compare names, addresses and contracts of the vendors.",),
    ),
    "vendor_efos_record_match": (
        ("A listing concerns the issuer, not each of its invoices.",),
        ("The listing is provisional, or later than the invoices.",),
        ("Read status and publication date.", "Set the invoice dates against the publication date."),
    ),
    "vendor_to_employee_bank_transfer": (
        ("A transfer shows that money moved, not why.",),
        ("A refund or a repayment.", "A stale account record."),
        ("Read the payments into the vendor's account before it.", "Read the orders that the employee approved."),
    ),
    "short_window_similar_invoice_cluster": (
        ("The books hold no approval threshold, so none can have been evaded on this record alone.",),
        ("Instalments.", "A fixed rate that is billed often."),
        ("Compare with orders, contracts and approvers.", "Obtain the approval policy."),
    ),
    "directed_bank_transfer_cycle": (
        ("Transfers that close a circle need not be the same money.", "Dates carry no time of day."),
        ("Settlement in both directions.", "Cash pooling."),
        ("Name the owner of each account.", "Compare amounts and dates of the legs."),
    ),
    "paid_invoices_without_po_or_contract": (
        ("A missing record is not a missing order.", "Orders are matched by amount, for want of a key."),
        ("A framework agreement kept elsewhere.", "Small spending that needs no order."),
        ("Look for contracts of this vendor.", "Compare with the cover of like vendors."),
    ),
    "gnn_relational_anomaly": (
        ("The score ranks an entity among its peers in these books; it is no probability.",),
        ("A rare but ordinary role.",),
        ("Read the records behind the largest deviations.",),
    ),
}


@dataclass(frozen=True)
class Observations:
    heads: DataFrame  # observation_id, detector_name, signal_type, statement, facts, score, score_semantics
    entities: DataFrame  # observation_id, section, entity: ordered by (section, entity)
    refs: DataFrame  # observation_id, source_table, record_id, note


def make_heads(df: DataFrame, detector: str, signal: str, statement: Column, facts: Sequence[str],
               score: Column | None = None, semantics: str | None = None) -> DataFrame:
    return df.select(
        "observation_id",
        F.lit(detector).alias("detector_name"),
        F.lit(signal).alias("signal_type"),
        statement.alias("statement"),
        F.to_json(F.struct(*facts)).alias("facts"),
        (score if score is not None else F.lit(None)).cast("double").alias("score"),
        F.lit(semantics).cast("string").alias("score_semantics"),
    )


def make_entities(df: DataFrame, *parts: tuple[int, Column]) -> DataFrame:
    items = F.array(*[F.struct(F.lit(n).alias("section"), c.alias("entity")) for n, c in parts])
    return df.select("observation_id", F.inline(items))


def make_refs(df: DataFrame, *parts: tuple[str, Column], note: str | None = None) -> DataFrame:
    items = F.array(*[F.struct(F.lit(t).alias("source_table"), c.cast("string").alias("record_id")) for t, c in parts])
    return df.select("observation_id", F.inline(items)).withColumn("note", F.lit(note).cast("string"))


def union_observations(parts: Sequence[Observations]) -> Observations:
    def union(name: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [getattr(p, name) for p in parts])

    return Observations(union("heads"), union("entities"), union("refs"))


def with_guidance(heads: DataFrame) -> DataFrame:
    """Add limitations, legitimate_alternatives and recommended_checks, fixed per signal."""
    signal = F.col("signal_type")

    def pick(i: int) -> Column:
        chain = None
        for name, texts in GUIDANCE.items():
            value = F.array(*[F.lit(t) for t in texts[i]])
            chain = F.when(signal == name, value) if chain is None else chain.when(signal == name, value)
        return chain

    return heads.select(
        "*", pick(0).alias("limitations"), pick(1).alias("legitimate_alternatives"), pick(2).alias("recommended_checks")
    )


def signal_rank(column: str = "signal_type") -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SIGNALS]), F.col(column)).cast("bigint")


def member_digest(member: str) -> Column:
    """Order-free digest of a set of distinct texts, for ids of groups of any size."""
    return F.sum(F.conv(F.substring(F.sha1(F.col(member)), 1, 14), 16, 10).cast("decimal(38,0)")).cast("string")
