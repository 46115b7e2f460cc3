"""Result files, recordings and answer keys."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditweave.session import durable

# Fixed values.
RESULT_COLUMNS = (
    "seed", "schemes_planted", "schemes_found", "recall_pct", "decoys_planted", "decoys_accused", "false_accusation_rate_pct",
    "peso_claimed", "peso_actual", "peso_reconciles", "llm_calls", "mxn_cost", "wall_clock_s",
)
RECORDING_SCHEMA = "response_text string, usage struct<input_tokens: bigint, output_tokens: bigint>"
KEY_SCHEMA = (
    "seed bigint, company_rfc string, "
    "schemes array<struct<scheme_id: string, type: string, entities: array<string>, peso_amount: double, difficulty: string>>, "
    "decoys array<struct<entity: string, code: string, signal: string, why_innocent: string>>"
)


def load_recordings(spark: SparkSession, path: str) -> DataFrame:
    """Recorded responses, one JSON object per line; ``split_recordings`` also gives the lines that are left out."""
    return split_recordings(spark, path)[0]


def split_recordings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(recordings, broken): the good lines, and (file, line) of those that are no JSON object of the schema.

    Lines are read once and kept, so both parts come from one scan and nothing
    vanishes uncounted. Blank lines belong to neither.
    """
    read = spark.read.schema(f"{RECORDING_SCHEMA}, __line string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__line").json(path)
    # Spark's parser forgets a broken line when only the other columns are asked for; the written rows hold all.
    kept = durable(read.select("*", F.col("_metadata.file_name").alias("__file")))
    good = kept.where("__line IS NULL AND (response_text IS NOT NULL OR usage IS NOT NULL)").drop("__line", "__file")
    broken = kept.where("__line IS NOT NULL AND trim(__line) <> ''").select(F.col("__file").alias("file"), F.col("__line").alias("line"))
    return good, broken


def write_submission(tables: dict[str, DataFrame], declined: DataFrame, metadata: DataFrame, path: str) -> None:
    """Write the submission as JSON lines below ``path``: findings, their parts, declined leads, metadata.

    A finding may cite any number of exhibits, so parts are files of their own,
    joined by ``finding_id``. NULL fields are left out and amounts must be
    finite. The parts go to a folder of this run; a manifest of one line, written
    last, makes them the current submission, so readers see one run whole.
    """
    amounts = [(tables["findings"], "peso_amount"), (tables["trail"], "amount")]
    for frame, column in amounts:
        value = F.col(column).cast("double")
        bad = frame.where(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")))
        if not bad.isEmpty():
            raise ValueError(f"{column} holds a value that is not finite")
    parts = {**{k: tables[k].withColumnRenamed("hypothesis_id", "finding_id") for k in ("findings", "entities", "exhibits", "trail")},
             "leads_not_pursued": declined, "run_metadata": metadata}
    run = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    for name, frame in parts.items():
        frame.write.option("ignoreNullFields", True).json(f"{path}/runs/{run}/{name}")
    metadata.sparkSession.range(1).select(F.lit(run).alias("run")).coalesce(1).write.mode("append").json(f"{path}/manifest")


def read_submission(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The parts of the newest run that the manifest names."""
    run = spark.read.schema("run string").json(f"{path}/manifest").agg(F.max("run")).first()[0]
    if run is None:
        raise FileNotFoundError(f"no submission was published in {path}")
    schemas = {
        "findings": "finding_id string, scheme_type string, rule_id string, rule_broken string, peso_amount double, narrative string, confidence string",
        "entities": "finding_id string, entity string",
        "exhibits": "finding_id string, exhibit_id string, source_table string, record_id string, note string",
        "trail": "finding_id string, step bigint, from_entity string, to_entity string, amount double, date string, exhibit_id string",
        "leads_not_pursued": "lead_id string, entity string, signal string, reason string, calls array<string>, closed_by string",
        "run_metadata": "seed bigint, llm_calls bigint, mxn_cost double, wall_clock_seconds double",
    }
    return {name: spark.read.schema(schema).json(f"{path}/runs/{run}/{name}") for name, schema in schemas.items()}


def write_results_csv(runs: DataFrame, path: str) -> None:
    """The thirteen named columns of each run's results."""
    runs.select(*RESULT_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def load_answer_key(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(schemes, scheme_entities, decoys); the audited company is no label.

    Reads one document per file, or one per line.
    """
    lines = spark.read.schema(KEY_SCHEMA).json(path)
    company = F.concat(F.lit("RFC:"), "company_rfc")
    schemes = lines.select(company.alias("company"), F.inline("schemes"))
    entities = schemes.select("company", "scheme_id", F.explode("entities").alias("entity")).where("entity <> company")
    decoys = lines.select(F.inline("decoys"))
    return (schemes.select("scheme_id", "type", "peso_amount", "difficulty"),
            entities.select("scheme_id", F.trim("entity").alias("entity")).distinct(),
            decoys.select(F.trim("entity").alias("entity"), "code"))
