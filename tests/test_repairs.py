"""Long ids, quoted cells, absent metrics, costs and the published submission."""

import pytest
from pyspark.sql import functions as F

from auditweave.operators import cases, evaluation, ranking, statistics
from auditweave.operators.forest import SAMPLE, TREES, isolation_scores
from auditweave.operators.observations import Observations
from auditweave.plans.registry import Given
from auditweave.session import work_folder
from auditweave.sources import files
from auditweave.sources.estate import TABLES, check_estate, load_estate_csv

LONG = "X" * 80


def small_estate(spark, **rows):
    frames = {n: spark.createDataFrame(rows.get(n, []), ", ".join(f"{c} string" for c in cols)) for n, cols in TABLES.items()}
    return check_estate(frames)


def test_ids_of_eighty_characters_keep_their_owner(spark):
    vendor = (LONG, "Name", "2020-01-01", "street", LONG, "cat", "mail")
    estate = small_estate(spark, vendors=[vendor])
    entities = spark.createDataFrame([("OBS-1", 0, f"CLABE:{LONG}")], "observation_id string, section int, entity string")
    found = cases.official_entities(Observations(None, entities, None), estate).collect()
    assert [r["entity"] for r in found] == [f"RFC:{LONG}"]
    told = cases.entity_coverage(estate, spark.createDataFrame([(f"RFC:{LONG}",)], "entity string")).collect()
    assert len(told) == 1 and "Name" in str(told[0])


def test_quoted_cells_and_entry_ids_survive(spark):
    folder = f"{work_folder(spark)}/csv-repairs"
    estate = small_estate(spark, vendors=[("R1", 'ACME "NORTE", SA\nde CV', "2020-01-01", "a", "b", "c", "d")],
                          ledger=[("E-7", "2020-01-01", "1", "n", "1.0", "x", "d", "u", "c", "a"), ("8", "2020-01-01", "1", "n", "2", "0", "d", "u", "c", "a")])
    for name in TABLES:
        estate.table(name).write.option("header", True).option("escape", '"').csv(f"{folder}/{name}.csv")
    read = load_estate_csv(spark, folder, multi_line=True)
    assert read.vendors.first()["legal_name"] == 'ACME "NORTE", SA\nde CV'
    rows = {(r["entry_id"], r["entry_id_unparsed"], r["credit_unparsed"]) for r in read.ledger.collect()}
    assert rows == {(None, "E-7", "x"), (8, None, None)}


def test_absent_metrics_count_as_zero(spark):
    runs = spark.createDataFrame([("before-a", 1.0), ("after-a", 3.0)], "label string, findings_total double")
    rows = evaluation.compare_runs(runs).collect()
    assert len(rows) == 2 * 20 and {(r["metric"], r["mark"]) for r in rows if r["mark"] != "="} == {("findings_total", "BETTER")}


def test_a_submission_is_replaced_as_a_whole(spark):
    path = f"{work_folder(spark)}/submission"
    empty = {k: spark.createDataFrame([], s) for k, s in {
        "entities": "hypothesis_id string, entity string", "exhibits": "hypothesis_id string, exhibit_id string",
        "trail": "hypothesis_id string, amount double"}.items()}
    meta = spark.createDataFrame([(1, 0)], "seed bigint, llm_calls bigint")
    for finding in ("first", "second"):
        found = spark.createDataFrame([(finding, 5.0)], "hypothesis_id string, peso_amount double")
        files.write_submission({"findings": found, **empty}, spark.createDataFrame([], "lead_id string"), meta, path)
    with pytest.raises(ValueError):
        broken = spark.createDataFrame([("third", float("nan"))], "hypothesis_id string, peso_amount double")
        files.write_submission({"findings": broken, **empty}, spark.createDataFrame([], "lead_id string"), meta, path)
    assert [r["finding_id"] for r in files.read_submission(spark, path)["findings"].collect()] == ["second"]


def test_negative_pairs_are_all_there_are_when_few_are_left(spark):
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(5)], "account string")
    arcs = spark.createDataFrame([(f"n{i}", f"n{j}") for i in range(5) for j in range(5) if i < j], "src string, dst string")
    drawn = {(r["src"], r["dst"]) for r in ranking.negative_edges(nodes, arcs, 100, 3).collect()}
    assert drawn == {(f"n{i}", f"n{j}") for i in range(5) for j in range(5) if i > j}


def test_every_tree_may_draw_every_row_and_outliers_score_lowest(spark):
    df = spark.range(4000).select("id", (F.col("id") % 100).cast("double").alias("x"),
                                  F.when(F.col("id") % 200 == 77, 1e5 + F.col("id") * 100).otherwise(F.col("id") % 7).cast("double").alias("y"))
    lowest = isolation_scores(df, ["x", "y"], "id", 42).orderBy("raw_score").limit(15).collect()
    assert sum(r["id"] % 200 == 77 for r in lowest) >= 12 and (TREES, SAMPLE) == (100, 256)


def test_evidence_of_every_detector_reaches_the_vector(spark):
    labels = [label for group in statistics.EVIDENCE_LABELS for label in group]
    rows = spark.createDataFrame([("m", f"v{i}", None, None, label, 0.5) for i, label in enumerate(labels)],
                                 "rule_or_model string, vendor_id string, group_by_value string, invoice_id string, mismatch_type string, anomaly_score double")
    flags = {r["labels"][0]: [r[e] for e in statistics.EVIDENCE].index(True) for r in statistics.evidence_vector(rows).collect()}
    assert flags == {label: i for i, group in enumerate(statistics.EVIDENCE_LABELS) for label in group}


def test_the_projected_estate_is_written_once(spark):
    one, other = (Given(spark, "/root/testdata/sf0.001").estate for _ in range(2))
    assert one.invoices.inputFiles() == other.invoices.inputFiles()
