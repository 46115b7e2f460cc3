"""Whole results of the statistical queries, by the second review."""

from pyspark.sql import functions as F

from auditweave.operators import statistics as st
from auditweave.plans import statistics_queries as sq
from auditweave.plans.registry import Given, queries

SMALL = "/root/testdata/sf0.001"


def test_vectors_hold_the_forest(spark):
    given, known = Given(spark, SMALL), queries()
    hourly = sq.pack_transactions(given).withColumn("hour", F.hour("timestamp"))
    outliers = {r[0] for r in st.isolation_forest(hourly).select(F.coalesce(F.col("vendor_id"), F.lit("UNKNOWN_ENTITY"))).collect()}
    whole = {r["target"]: r for r in known["t7_evidence_vector"](spark, SMALL).collect()}
    four = {r["target"]: r for r in known["t7_evidence_vector_four_detectors"](spark, SMALL).collect()}
    assert outliers and {t for t, r in whole.items() if r["e4_outlier"]} == outliers and set(whole) == set(four) | outliers
    flags = ("e1_match", "e2_entropy", "e3_temporal")
    assert all([whole[t][f] for f in flags] == [r[f] for f in flags] for t, r in four.items())
    posterior = {r["target"]: r["posterior"] for r in known["t8_naive_bayes_posterior"](spark, SMALL).collect()}
    before = {r["target"]: r["posterior"] for r in known["t8_naive_bayes_posterior_four_detectors"](spark, SMALL).collect()}
    assert outliers <= set(posterior) and all(posterior[t] > before[t] for t in outliers & set(before))
    assert {r["target"] for r in known["t9_posterior_bands"](spark, SMALL).collect()} == set(posterior)
