"""Mixing sources to target weights by Poisson replication.

A source whose share should be w of B bytes in all, and that has b bytes, is repeated
w * B / b times in the mean. Each document draws its number of copies by inverting the
Poisson distribution of that mean at a hash of its id, so a rerun draws the same copies;
the copies are then dealt out by a hash of (id, copy), which shuffles them globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave.llm.tables import hash60, text_or_empty, uniform
from auditweave.session import durable

#: exp(-mean) is exact enough below this; larger means are sums of several draws.
_MEAN_OF_ONE_DRAW = 32.0


def source_rates(docs: DataFrame, weights: DataFrame | None = None, temperature: float = 2.0) -> DataFrame:
    """Per source: ``source, bytes, weight, rate``; rate is the mean number of copies of a document.

    ``weights`` (source, weight): any positive numbers; a source that it lacks has weight 0, as has a
    NULL weight. Without it, a source weighs bytes ** (1 / temperature), which lifts small sources.
    A document counts as its UTF-8 bytes plus 1, so a source of empty texts has a rate too. NULL is a
    source of its own. The expected bytes of the mixture are those of the input. Rates
    have nine decimals, so that the order of summation does not show.
    """
    stats = docs.groupBy("source").agg(F.sum(F.octet_length(text_or_empty()) + 1).cast("bigint").alias("bytes"))
    if weights is None:
        stats = stats.withColumn("__w", F.pow(F.col("bytes").cast("double"), F.lit(1.0 / temperature)))
    else:
        given = weights.groupBy(F.col("source").alias("__source")).agg(F.max("weight").cast("double").alias("__w"))
        stats = stats.join(given, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
        stats = stats.withColumn("__w", F.greatest(F.coalesce("__w", F.lit(0.0)), F.lit(0.0)))
    stats = durable(stats)
    total = stats.agg(F.sum("bytes").alias("b"), F.sum("__w").alias("w")).first()
    weight = F.col("__w") / F.lit(float(total["w"] or 1.0))
    return stats.select("source", "bytes", weight.alias("weight"),
                        F.round(weight * F.lit(float(total["b"] or 0)) / F.col("bytes"), 9).alias("rate"))


def _with_distribution(rates: DataFrame) -> DataFrame:
    """Add ``__draws`` and ``__cdf``: P(X <= k), k = 0, 1, ... of one draw, until it is 1 in double precision."""
    rates = rates.withColumn("__draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / _MEAN_OF_ONE_DRAW)).cast("int"))
    rates = rates.withColumn("__mean", F.col("rate") / F.col("__draws"))
    # 12 standard deviations and 30 more terms are beyond the last bit for every mean up to 32.
    terms = F.sequence(F.lit(1), F.ceil(F.col("__mean") + 12 * F.sqrt("__mean") + 30).cast("int"))
    start = F.struct(F.exp(-F.col("__mean")).alias("p"), F.array(F.exp(-F.col("__mean"))).alias("c"))

    def add(state: Column, k: Column) -> Column:
        p = state["p"] * F.col("__mean") / k
        return F.struct(p.alias("p"), F.concat(state["c"], F.array(F.element_at(state["c"], -1) + p)).alias("c"))

    return rates.withColumn("__cdf", F.aggregate(terms, start, add, lambda s: s["c"])).drop("__mean")


def _with_rate(docs: DataFrame, rates: DataFrame, broadcast_sources: int, salts: int = 64) -> DataFrame:
    """Bring the rate of its source to each document; a hot source is never one task's work."""
    rates = rates.withColumnRenamed("source", "__source")
    same = F.col("source").eqNullSafe(F.col("__source"))
    if rates.count() <= broadcast_sources:
        return docs.join(F.broadcast(rates), same).drop("__source")
    spread = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    docs = docs.withColumn("__own", F.pmod(F.xxhash64("doc_id", "text"), F.lit(salts)).cast("int"))
    return docs.join(spread, same & (F.col("__own") == F.col("__salt"))).drop("__source", "__own", "__salt")


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, seed: int = 29, temperature: float = 2.0,
                broadcast_sources: int = 10_000) -> DataFrame:
    """The columns of ``docs`` (doc_id, text, source and any more), with ``copy, rate, order_key`` added.

    One row per drawn copy, ``copy`` from 1; a document may be drawn 0 times. Rows are dealt to
    partitions by ``order_key``, a hash of (id, copy), and the text, and sorted by the key inside, so neither sources
    nor the input's order survive. Input columns named like the three added ones are replaced.

    NULL source: a source of its own. NULL text: an empty text. NULL doc_id: all such rows draw the
    same count. Repeated rows draw the same count and the same keys. Empty table: no row.
    """
    docs = docs.drop("copy", "rate", "order_key")
    columns = docs.columns
    rates = durable(_with_distribution(source_rates(docs, weights, temperature)))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))

    def draw(j: Column) -> Column:
        point = uniform(F.lit(seed), name, j)
        return F.struct(point.alias("u"))

    drawn = _with_rate(docs, rates.select("source", "rate", "__draws", "__cdf"), broadcast_sources)
    # The points are made first, so that the filter compares numbers only.
    drawn = drawn.withColumn("__points", F.transform(F.sequence(F.lit(1), F.col("__draws")), draw))
    count = F.aggregate("__points", F.lit(0),
                        lambda n, x: n + F.size(F.filter("__cdf", lambda c: c <= x["u"])))
    copies = (
        drawn.withColumn("__copies", count).where("__copies > 0").drop("__points", "__cdf", "__draws")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
        .withColumn("order_key", hash60(F.lit(seed), name, F.col("copy")))
    )
    # Rows of one id, or of none, have the same key; their texts deal them apart.
    return copies.select(*columns, "copy", "rate", "order_key").repartition("order_key", F.xxhash64("text")).sortWithinPartitions("order_key")
