"""Ids, facts and records of the statistical observations."""

from pyspark.sql import functions as F

from auditweave.operators import statistics as st
from auditweave.plans import statistics_queries as sq
from auditweave.plans.registry import Given

SMALL = "/root/testdata/sf0.001"


def pack_of(spark, order):
    given = Given(spark, SMALL)
    rows = [("a1", "v", 50.0, "2024-01-06 02:00:00"), ("a2", "v", 50.0, "2024-01-06 02:01:00"), ("a3", "v", 50.0, "2024-01-06 02:02:00"),
            ("a4", "v", 50.0, "2024-01-06 02:03:00"), ("a5", None, 7.0, "2024-01-06 12:00:00"), ("a6", "w", 9.0, "2024-01-03 12:00:00"),
            ("a6", "w", 9.0, "2024-01-03 12:00:00"), ("a7", "w", 1e6, None)]
    df = spark.createDataFrame(order(rows), "transaction_id string, vendor_id string, amount double, timestamp string")
    return st.run_statistical_pack(*sq.books(given), df.withColumn("timestamp", F.to_timestamp("timestamp")))


def test_records_tell_observations_apart_and_ids_ignore_order(spark):
    pack = pack_of(spark, list)
    heads = {r["observation_id"]: r for r in pack.heads.collect()}
    records = {}
    for r in pack.records.collect():
        records.setdefault(r["observation_id"], set()).add((r["kind"], r["record_id"]))
    assert set(records) == set(heads) and all(r["facts"].startswith("{") for r in heads.values())
    mine = [records[i] for i, r in heads.items() if r["rule_or_model"] == "off_hours" and r["vendor_id"] == "v"]
    assert sorted(mine, key=sorted) == [{("transaction_id", f"a{i}")} for i in range(1, 5)]
    whole = {("transaction_id", f"a{i}") for i in range(1, 5)}
    assert [records[i] for i, r in heads.items() if r["rule_or_model"] in ("entropy", "velocity_burst") and "v" in (r["vendor_id"], r["group_by_value"])] == [whole] * 2
    again = pack_of(spark, lambda rows: rows[::-1])
    assert {r[0] for r in again.heads.select("observation_id").collect()} == set(heads)


def test_provenance_joins_all_records_of_a_target(spark):
    pack = pack_of(spark, list)
    got = {tuple(r) for r in st.provenance(pack).collect()}
    assert {r for r in got if r[0] == "v"} == {("v", "transaction_id", f"a{i}") for i in range(1, 5)}
    assert ("UNKNOWN_ENTITY", "transaction_id", "a5") in got
    targets = {r[0] for r in pack.heads.select(st.target_of()).collect()}
    assert {r[0] for r in got} == targets


def test_a_lonely_transaction_is_its_own_record(spark):
    pack = sq.stored_pack(Given(spark, SMALL))
    lonely = pack.heads.where("rule_or_model = 'isolation_forest'")
    named = lonely.select("observation_id", F.get_json_object("facts", "$.transaction_id").alias("record_id"), F.coalesce("vendor_id", F.lit("UNKNOWN_ENTITY")).alias("target"))
    found = pack.records.join(lonely.select("observation_id"), "observation_id", "left_semi").select("observation_id", "record_id", "target")
    assert named.count() > 0 and {tuple(r) for r in named.collect()} == {tuple(r) for r in found.collect()}


def test_thin_stretches_hold_no_burst(spark):
    rows = [("v", i, 150 * i) for i in range(40)] + [("w", 100 + i, 10_000 + 299 * i) for i in range(3)] + [("x", 200 + i, 20_000 + 60 * i) for i in range(4)]
    df = spark.createDataFrame(rows, "vendor_id string, transaction_id int, s bigint").select("vendor_id", "transaction_id", F.lit(1.0).alias("amount"), F.timestamp_seconds("s").alias("timestamp"))
    kept = st._near_bursts(df.select("vendor_id", F.unix_micros("timestamp").alias("at")), "vendor_id", 300_000_000, 3)
    assert {r[0] for r in kept.select("vendor_id").distinct().collect()} <= {"v", "x"}
    bursts, members = st.velocity_burst(df)
    assert [(r["vendor_id"], r["transaction_count"]) for r in bursts.collect()] == [("x", 4)] and members.count() == 4
