"""Wall time of the headline queries; prints one JSON line.

Every query runs to completion into Spark's no-op sink, so all columns are computed and
nothing is collected.  One untimed query warms the session up first.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from voltpanel.operators import features, impute  # noqa: E402
from voltpanel.plans import fixtures as fx  # noqa: E402
from voltpanel.plans.catalog import QUERIES  # noqa: E402
from voltpanel.session import build_session  # noqa: E402

HEADLINE = [
    "src_paged_json",
    "merge_sources_keep_newest",
    "upsert_demand",
    "upsert_prediction",
    "upsert_score",
    "calendar_densify",
    "impute_ratio",
    "impute_backtest",
    "modelling_table",
    "live_demand_features",
    "forecast_features",
    "featureset_inference",
    "inference_row",
    "alignment_audit",
    "cv_folds",
    "offline_metrics",
    "trailing_scores",
    "yoy_smoothed",
    "weekday_box",
    "autocorrelation",
    "corr_matrix",
    "regime_correlation",
    "base_scan",
    "ridge_cv",
    "stream_ingest_upsert",
    "rescore_revisions",
]
# The same operators over nations instead of regions: more zones, and gaps at every size.
BY_NATION = {
    "impute_ratio_by_nation": lambda spark, sf: fx.demand(spark, sf, "nation"),
    "impute_backtest_by_nation": lambda spark, sf: impute.impute_backtest(
        *(lambda raw: (raw, fx.parent_series(raw)))(fx.demand_raw(spark, sf, "nation"))
    ),
    "featureset_inference_by_nation": lambda spark, sf: features.feature_set(fx.modelling(spark, sf, "nation"), "inference"),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("voltpanel-bench", cores=cores, shuffle_partitions=int(cores))
    spark.sparkContext.setLogLevel("ERROR")

    def run(build) -> float:
        start = time.perf_counter()
        build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    builds = {name: QUERIES[name] for name in HEADLINE} | BY_NATION
    wanted = sys.argv[1:] or list(builds)
    run(QUERIES["offline_metrics"])
    times = {name: run(builds[name]) for name in wanted}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
