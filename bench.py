"""Time the headline queries; prints one JSON line.

Every query is run into the noop sink, so all its rows and columns are computed and
nothing is collected. Each is timed as the best of two runs after a warm-up of the session.
The value is the total of HEADLINE, which stays the same from round to round; MORE is timed too.
"""

from __future__ import annotations

import json
import os
import time

from commercelake.plans import catalog
from commercelake.session import build_session

HEADLINE = [
    "g01_commission_split",
    "g02_seller_balance",
    "g03_seller_central",
    "g05_checkout_metrics",
    "j01_sale_enrichment",
    "j03_cart_total",
    "j05_refund_amount",
    "j06_shipping_quotes",
    "j13_rate_in_force",
    "w01_wallet_fold",
    "w02_running_balance",
    "d01_dedup_by_url",
    "t03_split_files",
    "t12_secret_scan",
    "m07_latency_percentiles",
    "c01_demand_score",
    "c04_escrow_status",
    "c14_recommendations",
    "j16_view_to_purchase",
    "st03_hourly_demand",
]


MORE = [
    "j08_new_items",
    "m10_threshold_status",
    "m12_baseline_trigger",
    "m13_ice_score",
    "s02_snapshot_upsert",
    "s06_flatten_results",
    "s07_flatten_instant_answers",
    "s09_write_report",
    "st06_live_wallet",
    "st09_live_attribution",
    "t16_fix_bundle",
    "t17_infer_filename",
    "t18_discard_unknown_targets",
    "w01_wallet_periods",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(os.environ.get("BENCH_CPUS", "8"), "commercelake-bench")
    catalog.QUERIES["g05_checkout_metrics"](spark, folder).collect()
    seconds = {}
    for key in HEADLINE + MORE:
        runs = []
        for _ in range(2):
            begun = time.perf_counter()
            catalog.QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - begun)
        seconds[key] = round(min(runs), 3)
    scale = folder.rstrip("/").rsplit("sf", 1)[-1]
    total = round(sum(seconds[key] for key in HEADLINE), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": float(scale)}))
    spark.stop()


if __name__ == "__main__":
    main()
