"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: The hot loop first, then what surrounds it.
HEADLINE = ("emc_iteration", "emc_iteration_3d", "refined_iteration", "posterior_blocks", "log_likelihood", "tomograms_blocks", "frames_counts", "frames_powder", "classes_powder", "frames_polar", "frames_ones_multi", "orientation_order")


def main() -> None:
    from speckle.plans.catalog import QUERIES

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["frames_powder"](spark, SF_DIR).count()  # starts the session's threads and caches file listings
    seconds, rows = {}, {}
    for name in HEADLINE:
        began = time.perf_counter()
        df = QUERIES[name](spark, SF_DIR)
        df.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        if name == "log_likelihood":
            rows[name] = df.count()
    # once more, with Python workers running and code compiled
    warm = {}
    for name in ("emc_iteration", "emc_iteration_3d"):
        began = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        warm[name] = round(time.perf_counter() - began, 3)
    out = {"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/"))}
    out["frame_view_pairs_per_second"] = round(rows["log_likelihood"] / seconds["emc_iteration"])
    out["warm"] = warm
    turns = spark.read.parquet(f"{SF_DIR}/supplier.parquet").count()
    out["frame_view_pairs_per_second_3d"] = round(rows["log_likelihood"] / 12 * turns / warm["emc_iteration_3d"])  # twelve angles in the plane
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
