"""Sharding by proportional stratified interleaving.

The rows of each source are put in a seeded random order and ranked; all rows are then
sorted by fractional rank, rank / rows of the source, and the sorted rows are cut into
runs of equal length. Every run so holds nearly the same share of every source.

Both rankings are exact without sorting a source, or the table, in one task: the hash
(or the fraction) is cut into ranges, ranges are counted, earlier ranges are summed, and
a window numbers the rows inside a range only. A range of one source holds about
``range_rows`` rows however large the source is.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditweave.llm.tables import hash60, text_or_empty
from auditweave.session import durable

_SPAN = 1 << 60


def _with_place(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__place``: the number of the file it was read from, as its name has it, and the row's number there."""
    try:
        named = docs.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:  # not rows of Parquet files as they are
        named = durable(docs).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    part = F.regexp_extract("__file", "^part-(\\d+)-", 1)
    return named.withColumn("__place", F.concat_ws(":", F.when(part != "", part).otherwise(F.col("__file")), "__row")).drop("__file", "__row")


def assign_shards(docs: DataFrame, shards: int = 8, seed: int = 17, range_rows: int = 16_384,
                  carry: tuple[str, ...] = (), spread_copies: bool = False) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, source, any more) with ``size, text_crc32, law, shard, slot, grown_shard``.

    The law is ``rows``: shard sizes differ by one row at most, ``slot`` counts the rows of a
    shard from 0 without a gap. ``size`` is the UTF-8 bytes of the text plus 1.

    Rows are shuffled by a hash of id and checksum, so equal ids, or NULL ones, of different texts do not stay together.
    Rows equal in both do, unless ``spread_copies``: then the row's place in its file is hashed too, and copies spread
    like independent rows, but the order depends on how the input is stored.

    NULL text: size 1, checksum 0. NULL source: a stratum of its own, after all others. NULL
    or repeated doc_id: rows like any other. Empty table: no row. Of the input's columns, doc_id, source
    and those named in ``carry`` are returned. ``docs`` is read three times, twice without its text, so
    it should be stored rows.
    """
    text = text_or_empty()
    docs, place = (_with_place(docs), [F.col("__place")]) if spread_copies else (docs, [])
    rows = docs.select(
        "doc_id", "source",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).cast("bigint").alias("text_crc32"),
        hash60(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.crc32(text), *place).alias("__key"),
        F.col("source").isNull().alias("__none"),
        F.coalesce("source", F.lit("")).alias("__source"),
        *(F.col(c).alias(f"__carry_{c}") for c in carry),
    )
    total = rows.count()
    ranges = max(1, -(-total // range_rows))
    placed = _position(_fractional_rank(rows, ranges), ranges)
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return (
        placed.withColumn("shard", F.expr(f"cast(__position * {shards} div {max(total, 1)} as int)"))
        .withColumn("slot", F.col("__position") - first)
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                F.lit(None).cast("int").alias("grown_shard"), "source", F.col("__fraction").alias("fraction"),
                *(F.col(f"__carry_{c}").alias(c) for c in carry))
    )


def _fractional_rank(rows: DataFrame, ranges: int) -> DataFrame:
    """Add ``__rank`` from 1 in hash order within the source, and ``__fraction`` = (rank - 1/2) / rows."""
    stratum = ["__none", "__source"]
    rows = rows.withColumn("__range", F.expr(f"__key div {-(-_SPAN // ranges)}L"))
    counted = rows.groupBy(*stratum, "__range").agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(*stratum)
    earlier = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select(
        *stratum, "__range",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"), F.sum("__n").over(whole).alias("__rows"))
    inside = Window.partitionBy(*stratum, "__range").orderBy("__key", "doc_id", "size", "text_crc32")
    return (
        rows.withColumn("__inside", F.row_number().over(inside))
        .join(before, [*stratum, "__range"])
        .withColumn("__rank", F.col("__before") + F.col("__inside"))
        .withColumn("__fraction", (2 * F.col("__rank") - 1) / (2.0 * F.col("__rows")))
        .drop("__before", "__inside", "__range", "__key")
    )


def _position(rows: DataFrame, ranges: int) -> DataFrame:
    """Add ``__position`` from 0 in the order of fraction, source and rank."""
    rows = rows.withColumn("__range", F.floor(F.col("__fraction") * ranges))
    # One row per range, a few bytes for each 16,384 rows of input.
    counted = rows.groupBy("__range").agg(F.count("*").alias("__n"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__range").orderBy("__fraction", "__none", "__source", "__rank")
    return (
        rows.withColumn("__inside", F.row_number().over(inside) - 1)
        .join(before, "__range")
        .withColumn("__position", F.col("__before") + F.col("__inside"))
    )
