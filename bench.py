"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from auditweave.plans.registry import queries
from auditweave.session import build_session

HEADLINE = (
    "s1_load_estate", "l2_record_amounts", "l7_account_transactions", "d1_vendor_employee_shared_account",
    "d4_vendor_to_employee_transfer", "d5_similar_invoice_cluster", "d8_paid_without_po_or_contract",
    "n3_bank_cycles", "n5_transfer_edge_features", "n9_vendor_features", "t1_triple_reconciliation",
    "t2_entropy_collapse", "t3_off_hours", "t4_velocity_burst", "t8_naive_bayes_posterior", "q13_efos_authorisation_sweep",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "20g",
        "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="auditweave-"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    known, times = queries(), {}
    spark.range(1).count()
    for name in HEADLINE:
        started = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
