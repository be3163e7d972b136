"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "J1_predictor_merge", "J2_attach_chemistry_fill", "W1_capped_sample", "A8_support_histogram", "A9_raw_sums",
    "M3_two_grain_model", "M6_group_posterior", "M12_flagship_evaluation", "M12_evaluation_by_support",
    "M13_bundle_evaluation", "C1_partner_features", "F23_coelution_counts", "J11_mass_window_join", "C2_candidate_table",
    "C7_softmax_probabilities", "C9_assignment_evaluation", "L1_acquisition_hybrid", "A30_curve_areas",
    "W13_correction_factor_selection",
    "M10_partial_pooling", "M20_coherence_mixture",
]


def forget() -> None:
    """Drop what earlier queries of the session have written for later ones."""
    from peakloom.catalog import inputs, labelling, storage

    for memo in (inputs._kept, storage._paths, labelling._pool):
        memo.clear()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("peakloom-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.log.level", "ERROR")
        .getOrCreate()
    )
    from peakloom.catalog import load

    queries, _ = load()
    # start the Python workers and the code generator before the clock runs
    spark.range(1000).mapInPandas(lambda it: it, "id long").count()
    times: dict[str, float] = {}
    for name in HEADLINE:
        forget()  # every query builds its own inputs within its time
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
