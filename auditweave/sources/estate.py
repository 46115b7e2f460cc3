"""The eight-table estate: contract, loading and profile."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave.functions.clean import clean_text

# The estate contract. Key column first.
TABLES = {
    "vendors": ("rfc", "legal_name", "registered_date", "address", "bank_clabe", "category", "contact_email"),
    "invoices": (
        "uuid", "issuer_rfc", "receiver_rfc", "issue_date", "subtotal", "iva", "total",
        "concepto_text", "uso_cfdi", "forma_pago", "metodo_pago", "status",
    ),
    "ledger": (
        "entry_id", "date", "account_code", "account_name", "debit", "credit",
        "description", "invoice_uuid", "cost_center", "approver",
    ),
    "bank_txns": ("txn_id", "date", "from_clabe", "to_clabe", "amount", "reference", "channel"),
    "purchase_orders": ("po_id", "vendor_rfc", "date", "amount", "requester", "approver", "description"),
    "contracts": ("contract_id", "vendor_rfc", "start_date", "value", "scope_text"),
    "employees": ("emp_id", "name", "role", "bank_clabe", "hire_date"),
    "efos_list": ("rfc", "legal_name", "status", "publication_date"),
}
AMOUNT_COLUMNS = {"invoices": "total", "bank_txns": "amount", "purchase_orders": "amount", "contracts": "value"}
NUMERIC_COLUMNS = {
    "invoices": ("subtotal", "iva", "total"),
    "ledger": ("debit", "credit"),
    "bank_txns": ("amount",),
    "purchase_orders": ("amount",),
    "contracts": ("value",),
}


@dataclass(frozen=True)
class Estate:
    vendors: DataFrame
    invoices: DataFrame
    ledger: DataFrame
    bank_txns: DataFrame
    purchase_orders: DataFrame
    contracts: DataFrame
    employees: DataFrame
    efos_list: DataFrame

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    @property
    def spark(self) -> SparkSession:
        return self.vendors.sparkSession


class EstateContractError(ValueError):
    """Tables or columns of the contract are missing."""


def check_estate(frames: dict[str, DataFrame]) -> Estate:
    """Check names only, so nothing is scanned. Extra columns pass."""
    missing = [name for name in TABLES if name not in frames]
    if missing:
        raise EstateContractError("missing tables: " + ", ".join(missing))
    gaps = []
    for name, columns in TABLES.items():
        absent = [c for c in columns if c not in frames[name].columns]
        if absent:
            gaps.append(f"{name}: {', '.join(absent)}")
    if gaps:
        raise EstateContractError("missing columns: " + "; ".join(gaps))
    return Estate(**{f.name: frames[f.name] for f in fields(Estate)})


def load_estate(spark: SparkSession, folder: str, layout: str = "{folder}/{table}.parquet") -> Estate:
    """Open eight parquet tables below ``folder``."""
    frames = {}
    missing = []
    for name in TABLES:
        path = layout.format(folder=folder, table=name)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            frames[name] = spark.read.parquet(path)
        else:
            missing.append(name)
    if missing:
        raise EstateContractError("missing tables: " + ", ".join(missing))
    return check_estate(frames)


def load_estate_csv(
    spark: SparkSession, folder: str, layout: str = "{folder}/{table}.csv", multi_line: bool = False
) -> Estate:
    """Open eight CSV files with a header; listed numbers and ledger entry ids are cast.

    A quote inside a quoted cell is written twice. ``multi_line`` allows line breaks in quoted cells; a
    file is then read by one task. Text that is no number is kept in ``<column>_unparsed``.
    """
    frames = {}
    for name, columns in TABLES.items():
        reader = spark.read.option("header", True).option("encoding", "UTF-8").option("quote", '"').option("escape", '"')
        raw = reader.option("multiLine", multi_line).csv(layout.format(folder=folder, table=name))
        raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
        for column in NUMERIC_COLUMNS.get(name, ()):
            if column in raw.columns:
                text = F.col(column)
                number = text.try_cast("double")
                raw = raw.withColumn(f"{column}_unparsed", F.when(number.isNull(), clean_text(text)))
                raw = raw.withColumn(column, number)
        if name == "ledger" and "entry_id" in raw.columns:
            number = F.col("entry_id").try_cast("bigint")
            raw = raw.withColumn("entry_id_unparsed", F.when(number.isNull(), clean_text("entry_id"))).withColumn("entry_id", number)
        frames[name] = raw
    return check_estate(frames)


def table_counts(estate: Estate) -> DataFrame:
    """(table_name, row_count) for all eight tables."""
    parts = [
        estate.table(name).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name in TABLES
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def company_profile(estate: Estate) -> DataFrame:
    """(item, value): the audited company and the period.

    The company is the commonest receiver; ties go to the smaller id.
    """
    issued = estate.invoices.agg(
        F.min(clean_text("issue_date")).alias("period_start"), F.max(clean_text("issue_date")).alias("period_end")
    ).unpivot([], ["period_start", "period_end"], "item", "value")
    company = (
        estate.invoices.select(clean_text("receiver_rfc").alias("value"))
        .where(F.col("value").isNotNull())
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "value")
        .limit(1)
        .select(F.lit("company_rfc").alias("item"), "value")
    )
    return company.unionByName(issued)


def estate_profile(estate: Estate) -> DataFrame:
    """(item, value) as text: row counts, company and period."""
    counts = table_counts(estate).select(F.col("table_name").alias("item"), F.col("row_count").cast("string").alias("value"))
    return counts.unionByName(company_profile(estate))
