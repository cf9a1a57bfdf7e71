"""Headline timings: one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores,
``BENCH_REPEAT`` the timed runs per query (median is reported after one warm-up).
Every query is run to the end through a no-op sink, so nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEAT = int(os.environ.get("BENCH_REPEAT", "1"))
HEADLINE = [
    "importance_value", "dominant_species", "tree_structure", "seedling_structure", "cover_by_type", "plot_features",
    "flow_table", "totals_beside_species", "melt_name_parts", "cast_wide_fill", "null_safe_full_join", "hot_key_full_join",
    "group_max_rows", "first_per_key", "row_numbers", "season_year_mean", "climate_anomaly", "terrain_slope_aspect",
    "sample_raster", "mask_polygon", "mosaic_max", "resample_grid", "nearest_cell", "semivariogram", "predictor_summary",
    "median_se", "boxplot_stats", "histogram", "anova_oneway", "tukey_pairs", "median_test", "ks_two_sample", "spearman_test",
    "spearman_matrix", "lm_by_group", "nested_f", "bray_prepost", "anosim_permutations", "nmds", "poisson_glm", "nb_glm",
    "model_average", "bootstrap_ci", "pair_median", "all_subsets", "subset_ranking", "averaged_effects", "species_models",
    "nb_checks", "quasipoisson_glm", "partial_r2", "tukey_three_levels", "letters",
]


def main() -> None:
    from regrove.registry import queries
    from regrove.session import local_session
    spark = local_session(CPUS, app="regrove-bench")
    spark.sparkContext.setLogLevel("ERROR")
    table = queries()
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    run = lambda n: table[n](spark, FOLDER).write.format("noop").mode("overwrite").save()
    for name in names:
        run(name)
        taken = []
        for _ in range(REPEAT):
            start = time.perf_counter()
            run(name)
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"), "cpus": int(CPUS)}))


if __name__ == "__main__":
    main()
