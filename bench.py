"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "profile_counts", "profile_numeric_stats", "profile_top_values", "detect_types", "quantile_deciles", "fd_pairs", "pearson_pairs", "cramers_v", "eta_squared",
    "fit_parameters", "ks_one_sample", "best_distribution", "cond_numeric_pivot", "cond_numeric_target", "random_format", "email_join", "gen_normal", "gen_uuid4",
    "recon_functional_dep", "recon_conditional", "val_anchor_exact", "val_ks", "val_cat_freq", "flagship",
]
#: The reference's own workload: a generated table of users of this size, compressed, rebuilt and compared.
USERS = int(os.environ.get("BENCH_USERS", "100000"))


def timed(f) -> float:
    began = time.perf_counter()
    f()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    from quarry import examples
    from quarry.plans import pipeline, queries
    from quarry.session import session
    from quarry.sources import tables

    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session("bench")
    seconds: dict[str, float] = {}
    spark.range(1000).selectExpr("sum(id)").collect()
    for name in HEADLINES:
        seconds[name] = timed(lambda name=name: queries.QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save())
    with tempfile.TemporaryDirectory() as folder:
        csv, out = f"{folder}/users.csv", f"{folder}/back.csv"
        tables.write_csv(examples.users(spark, USERS), csv)
        made = {}
        seconds["users_compress"] = timed(lambda: made.setdefault("c", pipeline.compress(spark, csv, folder, "users", anchor_files=1)))
        seconds["users_decompress"] = timed(lambda: pipeline.decompress(spark, made["c"].recipe_path, out))
        seconds["users_validate"] = timed(lambda: made.setdefault("v", pipeline.validate_pair(spark, csv, out, recipe_path=made["c"].recipe_path)))
        facts = {"users_rows": USERS, "users_ratio": round(made["c"].compression_ratio, 2), "users_score": made["v"].report.overall_score}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": directory.rstrip("/").rsplit("sf", 1)[-1]} | facts))
    spark.stop()


if __name__ == "__main__":
    main()
