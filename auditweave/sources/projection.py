"""The TPC-H-like star schema seen as an estate.

Amounts are worked out in whole cents and divided by 100 at the end, so any
engine gets the same digits.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave.session import durable, work_folder
from auditweave.sources.estate import TABLES, Estate, load_estate

# Fixed values.
COMPANY_RFC = "EMP920101AB1"
COMPANY_ACCOUNT = "012000000000000999"
SETTLEMENT_PREFIX = "Pago CFDI "


class Source:
    """The given tables of one folder; each file's schema is read once."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder, self._frames = spark, folder, {}

    def __call__(self, table: str) -> DataFrame:
        if table not in self._frames:
            self._frames[table] = self._spark.read.parquet(f"{self._folder}/{table}.parquet")
        return self._frames[table]


def _pad(column: str | Column, width: int) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.lpad(column.cast("string"), width, "0")


def _vendor_rfc(key: str) -> Column:
    return F.concat(F.lit("SUP"), _pad(key, 9))


def _vendor_account(key: str) -> Column:
    k = F.col(key)
    return F.concat(F.lit("058"), _pad(F.when(k % 10 == 7, k - 1).otherwise(k), 15))


def _employee_account(key: str) -> Column:
    k = F.col(key)
    return F.concat(F.when(k % 20 == 5, F.lit("058")).otherwise(F.lit("072")), _pad(key, 15))


def _div(cents: Column, by: int) -> Column:
    return ((cents - cents % by) / by).cast("bigint")


def _day(column: str) -> Column:
    return F.col(column).cast("date")


def order_book(source: Source) -> DataFrame:
    """One row per order with its supplier and whole-cent amount."""
    suppliers = (
        source("lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("suppkey"))
    )
    orders = source("orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
        _day("o_orderdate").alias("day"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
    )
    return orders.join(suppliers, orders.o_orderkey == suppliers.l_orderkey, "left").drop("l_orderkey")


def invoices(book: DataFrame) -> DataFrame:
    net = _div(F.col("cents") * 100, 116)
    bought = F.col("suppkey").isNotNull()
    return book.select(
        F.concat(_pad("o_orderkey", 8), F.lit("-CFDI")).alias("uuid"),
        F.when(bought, _vendor_rfc("suppkey")).otherwise(F.lit(COMPANY_RFC)).alias("issuer_rfc"),
        F.when(bought, F.lit(COMPANY_RFC)).otherwise(F.concat(F.lit("CUS"), _pad("o_custkey", 9))).alias("receiver_rfc"),
        F.col("day").cast("string").alias("issue_date"),
        (net / F.lit(100.0)).alias("subtotal"),
        ((F.col("cents") - net) / F.lit(100.0)).alias("iva"),
        (F.col("cents") / F.lit(100.0)).alias("total"),
        F.concat(F.lit("Servicio "), "o_orderpriority").alias("concepto_text"),
        F.lit("G03").alias("uso_cfdi"),
        F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 50 != 0), F.lit("99"))
        .otherwise(F.lit("03")).alias("forma_pago"),
        F.when(F.col("o_orderstatus") == "O", F.lit("PPD")).otherwise(F.lit("PUE")).alias("metodo_pago"),
        F.when(F.col("o_orderkey") % 37 == 0, F.lit("cancelado")).otherwise(F.lit("vigente")).alias("status"),
    )


def vendors(source: Source) -> DataFrame:
    return source("supplier").select(
        _vendor_rfc("s_suppkey").alias("rfc"),
        F.col("s_name").alias("legal_name"),
        F.lit("1990-01-01").alias("registered_date"),
        F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string")).alias("address"),
        _vendor_account("s_suppkey").alias("bank_clabe"),
        F.concat(F.lit("CAT-"), F.col("s_nationkey").cast("string")).alias("category"),
        F.concat(F.lit("v"), F.col("s_suppkey").cast("string"), F.lit("@example.com")).alias("contact_email"),
    )


def employees(source: Source) -> DataFrame:
    return source("customer").where(F.col("c_custkey") % 5 == 0).select(
        F.concat(F.lit("EMP:"), _pad("c_custkey", 6)).alias("emp_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("role"),
        _employee_account("c_custkey").alias("bank_clabe"),
        F.lit("1991-01-01").alias("hire_date"),
    )


def purchase_orders(source: Source, book: DataFrame) -> DataFrame:
    people = source("customer").select("c_custkey", "c_name")
    raised = book.where(F.col("suppkey").isNotNull() & (F.col("o_orderkey") % 4 != 0))
    cents = F.col("cents")
    ordered = F.when(F.col("o_orderkey") % 4 == 1, cents + _div(cents, 100)).otherwise(cents)
    return raised.join(people, raised.o_custkey == people.c_custkey, "left").select(
        F.concat(F.lit("PO-"), _pad("o_orderkey", 8)).alias("po_id"),
        _vendor_rfc("suppkey").alias("vendor_rfc"),
        F.col("day").cast("string").alias("date"),
        (ordered / F.lit(100.0)).alias("amount"),
        F.lit("Compras").alias("requester"),
        F.col("c_name").alias("approver"),
        F.concat(F.lit("Pedido "), "o_orderpriority").alias("description"),
    )


def contracts(source: Source) -> DataFrame:
    return source("supplier").where(F.col("s_suppkey") % 3 == 0).select(
        F.concat(F.lit("CTR-"), _pad("s_suppkey", 9)).alias("contract_id"),
        _vendor_rfc("s_suppkey").alias("vendor_rfc"),
        F.lit("1992-01-01").alias("start_date"),
        (F.lit(100000.0) + F.col("s_suppkey")).alias("value"),
        F.concat(F.lit("Contrato marco de servicios con "), "s_name").alias("scope_text"),
    )


def efos_list(source: Source) -> DataFrame:
    k = F.col("s_suppkey")
    return source("supplier").where((k % 9).isin(1, 4)).select(
        _vendor_rfc("s_suppkey").alias("rfc"),
        F.col("s_name").alias("legal_name"),
        F.when(k % 9 == 1, F.lit("definitivo")).otherwise(F.lit("presunto")).alias("status"),
        F.when(k % 2 == 1, F.lit("1998-06-01")).otherwise(F.lit("2003-01-01")).alias("publication_date"),
    )


def ledger(book: DataFrame) -> DataFrame:
    net = _div(F.col("cents") * 100, 116)
    lines = F.array(
        F.struct(F.lit(0).alias("leg"), net.alias("d"), F.lit(0).cast("bigint").alias("c")),
        F.struct(F.lit(1).alias("leg"), (F.col("cents") - net).alias("d"), F.lit(0).cast("bigint").alias("c")),
        F.struct(F.lit(2).alias("leg"), F.lit(0).cast("bigint").alias("d"), F.col("cents").alias("c")),
    )
    legs = book.select("o_orderkey", "day", F.explode(lines).alias("l")).where(
        (F.col("l.leg") != 2) | (F.col("o_orderkey") % 101 != 0)
    )
    leg = F.col("l.leg")
    return legs.select(
        (F.col("o_orderkey") * 4 + leg).alias("entry_id"),
        F.col("day").cast("string").alias("date"),
        F.when(leg == 0, "6000").when(leg == 1, "1180").otherwise("2010").alias("account_code"),
        F.when(leg == 0, "Gasto").when(leg == 1, "IVA acreditable").otherwise("Proveedores").alias("account_name"),
        (F.col("l.d") / F.lit(100.0)).alias("debit"),
        (F.col("l.c") / F.lit(100.0)).alias("credit"),
        F.lit("Registro de CFDI").alias("description"),
        F.concat(_pad("o_orderkey", 8), F.lit("-CFDI")).alias("invoice_uuid"),
        F.lit("CC-01").alias("cost_center"),
        F.lit("Contabilidad").alias("approver"),
    )


def bank_txns(book: DataFrame) -> DataFrame:
    """Up to four transfers per order, from one pass over the orders."""
    company = F.lit(COMPANY_ACCOUNT)
    k, key, cents = F.col("suppkey"), F.col("o_orderkey"), F.col("cents")
    rows = book.where(k.isNotNull()).withColumn("person", F.col("o_custkey") - F.col("o_custkey") % 5).withColumn("peer", k + 1)
    vendor = _vendor_account("suppkey")

    def leg(when: Column, tag: str, lag: int, src: Column, dst: Column, amount: Column, reference: Column) -> Column:
        return F.when(when, F.struct(
            F.concat(F.lit(f"BNK-{tag}-"), _pad("o_orderkey", 8)).alias("txn_id"),
            F.date_add("day", lag).cast("string").alias("date"),
            src.alias("from_clabe"), dst.alias("to_clabe"),
            (amount / F.lit(100.0)).alias("amount"), reference.alias("reference"),
            F.lit("SPEI").alias("channel"),
        ))

    moved = key % 25 == 7
    legs = F.array(
        leg(F.col("o_orderstatus").isin("F", "P") & (key % 37 != 0), "P", 30, company, vendor, cents,
            F.concat(F.lit(SETTLEMENT_PREFIX), _pad("o_orderkey", 8))),
        leg(key % 20 == 3, "E", 35, vendor, _employee_account("person"), _div(cents * 7, 100), F.lit("Reembolso")),
        leg((k % 10).isin(1, 3) & moved, "V", 3, vendor, _vendor_account("peer"), _div(cents * 985, 1000), F.lit("Traspaso")),
        leg((k % 10 == 2) & moved, "R", 9, vendor, company, _div(cents * 97, 100), F.lit("Devolucion")),
    )
    return rows.select(F.explode(F.array_compact(legs)).alias("t")).select("t.*")


_STORED: dict[tuple[str, str], str] = {}


def stored_estate(spark: SparkSession, folder: str) -> Estate:
    """The projected estate of ``folder``, written once per application and opened like any other.

    The given tables are read-only, so the files stay right as long as the application runs.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STORED:
        target = f"{work_folder(spark)}/estate-{uuid.uuid4().hex}"
        made = ProjectedEstate(spark, folder)
        made.book = durable(made.book)
        for name in TABLES:
            made.table(name).write.parquet(f"{target}/{name}.parquet")
        _STORED[key] = target
    return load_estate(spark, _STORED[key])


class ProjectedEstate:
    """An estate whose tables are put together when they are first asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.source = spark, Source(spark, folder)

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    @cached_property
    def book(self) -> DataFrame:
        return order_book(self.source)

    @cached_property
    def vendors(self) -> DataFrame:
        return vendors(self.source)

    @cached_property
    def invoices(self) -> DataFrame:
        return invoices(self.book)

    @cached_property
    def ledger(self) -> DataFrame:
        return ledger(self.book)

    @cached_property
    def bank_txns(self) -> DataFrame:
        return bank_txns(self.book)

    @cached_property
    def purchase_orders(self) -> DataFrame:
        return purchase_orders(self.source, self.book)

    @cached_property
    def contracts(self) -> DataFrame:
        return contracts(self.source)

    @cached_property
    def employees(self) -> DataFrame:
        return employees(self.source)

    @cached_property
    def efos_list(self) -> DataFrame:
        return efos_list(self.source)
