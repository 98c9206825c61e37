"""Times the headline queries and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from basewright import queries as base

HEADLINE = [
    "fastq_record", "phred", "quality_histogram", "line_reads", "color_means", "gram_phasing", "robust_weight", "deconvolve_both", "stripe_halo",
    "neighbour_pairs", "cycle_width", "edge_share", "acc_solve", "acc_jacobi_1", "mismatch_rate_by_cycle", "acc_full", "deconvolve_full",
]

if __name__ == "__main__":
    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    settings = {
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "8g",
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    every, took = base.queries(), {}
    every["call_base"](spark, sf).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        start = time.time()
        every[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
