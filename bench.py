"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from quillon.plans import registry

HEADLINE = (
    "p95_by_hour", "a_req", "a_qry", "a_job", "a_cache", "a_tier_day_qry", "a_merge_req", "a_dds_qry", "a_hist_wide", "q_pctl_qry", "q_sketch_50", "q_sketch_all", "q_sketch_50", "q_sketch_all",
    "w_conc", "w_peak", "i_exc", "i_thr_query", "w_streak", "j_trace", "j_dict", "m_ckr", "q_users", "q_n1", "src_parse", "p_def", "h_diagnose",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = registry.queries()
    times = {}
    found["a_req"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's compiler and readers
    for name in HEADLINE:
        start = time.perf_counter()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
