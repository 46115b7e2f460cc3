"""The corpus pipeline: from raw documents to mixed, interleaved shards.

Every stage is ``(name, function)``; the function takes (spark, docs, sf_dir), with the stored rows
that the stage before kept, and returns a DataFrame. All but the last return the columns of
``documents``. Rules for NULLs, ties, repeated rows and empty tables are those of the operators.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave.llm import decontamination, mixing, ngram_jaccard, quality_fm, sharding
from auditweave.llm.tables import table
from auditweave.session import durable, forget

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
CONTRACT = ("doc_id", "text", "lang", "source", "n_chars")


def _any_names(stage: Stage) -> Stage:
    """A stage over columns of any name: those beyond the contract's have other names inside, and come out as they were."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inner = [c if c in CONTRACT else f"__own_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*inner), sf_dir).select(*inner).toDF(*docs.columns)

    return run


@_any_names
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents whose score is below one half go."""
    model = quality_fm.train(docs, table(spark, sf_dir, "labels"))
    return quality_fm.with_score(docs, model).where("score >= 0.5").select(docs.columns)


@_any_names
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of a group of near duplicates the document of least id stays, once.

    Texts without a word, and rows without an id, are duplicates of nothing and stay.
    """
    groups = ngram_jaccard.near_duplicates(docs)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(first, "doc_id", "left_semi")
    once = named.withColumn("__mark", F.xxhash64("text")).dropDuplicates(["doc_id", "__mark"]).drop("__mark")
    return once.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


@_any_names
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that give away a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


@_any_names
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poisson replication towards weights by the square root of a source's bytes; rows repeat."""
    return mixing.mix_sources(docs).select(docs.columns)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Proportional stratified interleaving into eight shards, texts included; copies of a document spread like any rows."""
    dealt = sharding.assign_shards(docs.select(*CONTRACT), shards=8, range_rows=4_096, carry=("text", "lang", "n_chars"), spread_copies=True)
    return dealt.drop("fraction", "grown_shard")


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix),
    ("sharding", deal_shards),
]

#: The first stage is a trained model, which SQL cannot repeat; the tests compare each stage by itself.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        kept = durable(stage(spark, docs, sf_dir))
        forget(docs)  # what the stage before wrote; given tables are never touched
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
