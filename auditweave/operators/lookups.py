"""Record lookups as batch joins.

Every lookup keeps the requests that found nothing, because "no record" is an
answer of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.functions.clean import clean_text, strip
from auditweave.operators.ordering import positions
from auditweave.session import durable
from auditweave.sources.estate import AMOUNT_COLUMNS, TABLES, Estate

SETTLEMENT_PREFIX = "Pago CFDI "  # fixed value
KEY_CHARS = 8  # fixed value: characters of a uuid quoted in a settlement


def record_rows(estate: Estate, tables: Sequence[str] = tuple(TABLES)) -> DataFrame:
    """(source_table, record_id, amount) of every record of ``tables``."""
    parts = []
    for name in tables:
        columns = TABLES[name]
        amount = F.col(AMOUNT_COLUMNS[name]).try_cast("double") if name in AMOUNT_COLUMNS else F.lit(None).cast("double")
        parts.append(estate.table(name).select(
            F.lit(name).alias("source_table"), F.col(columns[0]).cast("string").alias("record_id"), amount.alias("amount")
        ))
    return reduce(DataFrame.unionByName, parts)


def resolve_records(estate: Estate, refs: DataFrame) -> DataFrame:
    """Add ``found`` and ``amount`` to rows with (source_table, record_id).

    Only tables that are cited are read, each joined with its own part of the wanted
    keys, and the records are cut to those before they are made unique.
    """
    key = ["source_table", "record_id"]
    wanted = durable(refs.select(*key).where(F.col("source_table").isin(*TABLES)).distinct())
    cited = sorted(row[0] for row in wanted.select("source_table").distinct().collect())  # eight names at most
    parts = []
    for name in cited or ["vendors"]:
        mine = wanted.where(F.col("source_table") == name).select("record_id")
        parts.append(record_rows(estate, [name]).join(mine, "record_id").groupBy(*key).agg(
            F.max("amount").alias("amount"), F.lit(True).alias("found")))
    hits = reduce(DataFrame.unionByName, parts)
    return refs.join(hits, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def record_amounts(estate: Estate, refs: DataFrame) -> DataFrame:
    return resolve_records(estate, refs).drop("found")


def records_by_key(requests: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """One row per request: the record's columns, or NULLs with ``found`` false."""
    return (
        requests.join(table.withColumn("__hit", F.lit(True)), key, "left")
        .withColumn("found", F.coalesce("__hit", F.lit(False)))
        .drop("__hit")
    )


def _history(requests: DataFrame, table: DataFrame, key: str, order: list[str]) -> DataFrame:
    """All records of each requested key with their position in ``order``."""
    rows = table.join(requests.select(key).distinct(), key, "left_semi")
    dated = rows.withColumn("__first", F.coalesce(order[0], F.lit("")))
    placed = positions(dated, [key], ["__first", *order[1:]]).drop("__first")
    return requests.join(placed, key, "left")


def vendor_invoices(estate: Estate, requests: DataFrame) -> DataFrame:
    return _history(requests, estate.invoices, "issuer_rfc", ["issue_date", "uuid"])


def vendor_purchase_orders(estate: Estate, requests: DataFrame) -> DataFrame:
    return _history(requests, estate.purchase_orders, "vendor_rfc", ["date", "po_id"])


def vendor_contracts(estate: Estate, requests: DataFrame) -> DataFrame:
    return _history(requests, estate.contracts, "vendor_rfc", ["start_date", "contract_id"])


def invoice_ledger(estate: Estate, requests: DataFrame) -> DataFrame:
    return _history(requests, estate.ledger, "invoice_uuid", ["date", "entry_id"])


def account_transactions(estate: Estate, requests: DataFrame) -> DataFrame:
    """Transfers that leave or enter an account; ``requests`` has ``account``.

    Two equi-joins instead of one OR condition. A transfer from an account to
    itself is taken from the first branch only.
    """
    bank = estate.bank_txns
    out = bank.withColumn("account", F.col("from_clabe"))
    into = bank.where(~F.col("to_clabe").eqNullSafe(F.col("from_clabe"))).withColumn("account", F.col("to_clabe"))
    return _history(requests, out.unionByName(into), "account", ["date", "txn_id"])


def account_owners(estate: Estate) -> DataFrame:
    """(account, vendor_rfc, emp_id): the smallest recorded owner of each kind."""
    vendor = estate.vendors.select(clean_text("bank_clabe").alias("account"), clean_text("rfc").alias("vendor_rfc"))
    employee = estate.employees.select(clean_text("bank_clabe").alias("account"), clean_text("emp_id").alias("emp_id"))
    return (
        vendor.unionByName(employee, allowMissingColumns=True)
        .where(F.col("account").isNotNull())
        .groupBy("account")
        .agg(F.min("vendor_rfc").alias("vendor_rfc"), F.min("emp_id").alias("emp_id"))
    )


def account_owner(estate: Estate, requests: DataFrame) -> DataFrame:
    return requests.join(account_owners(estate), "account", "left")


def efos_lookup(estate: Estate, requests: DataFrame) -> DataFrame:
    return records_by_key(requests, estate.efos_list, "rfc")


def settlements(estate: Estate, prefix: str = SETTLEMENT_PREFIX) -> DataFrame:
    """(uuid_key, txn_id, amount, date) of bank rows that quote an invoice."""
    text = clean_text("reference")
    return (
        estate.bank_txns.where(text.startswith(prefix))
        .select(strip(F.substring(text, len(prefix) + 1, 1 << 20)).alias("uuid_key"), "txn_id", "amount", "date")
    )


def invoice_settlements(estate: Estate, requests: DataFrame) -> DataFrame:
    """Bank rows whose reference quotes the invoice; ``requests`` has ``uuid``."""
    keyed = requests.withColumn("reference", F.concat(F.lit(SETTLEMENT_PREFIX), F.substring("uuid", 1, KEY_CHARS)))
    return keyed.join(estate.bank_txns, "reference", "left")


def efos_targets(estate: Estate) -> DataFrame:
    """Listed taxpayers that issued at least one invoice."""
    issuers = estate.invoices.select(F.col("issuer_rfc").alias("rfc"))
    return estate.efos_list.select("rfc").distinct().join(issuers, "rfc", "left_semi")
