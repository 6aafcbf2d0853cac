"""Times the main stages on one stored transaction table and prints one JSON line.

BENCH_SF_DIR names the input folder, BENCH_CPUS the local cores, BENCH_TREES the number of
boosted trees (120 unless set, the library default).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, functions as F  # noqa: E402

from tallyrisk import schema  # noqa: E402
from tallyrisk.operators import contract, features, inject, metrics, positions, quality  # noqa: E402
from tallyrisk.plans import pipelines  # noqa: E402
from tallyrisk.session import clean_up, fresh_path, local_session, materialize  # noqa: E402
from tallyrisk.sources import sample_view  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
TREES = int(os.environ.get("BENCH_TREES", "120"))


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    times: dict[str, float] = {}

    def timed(name, work):
        start = time.time()
        out = work()
        times[name] = round(time.time() - start, 3)
        return out

    tx = timed("store_transactions", lambda: materialize(sample_view.transactions(spark, SF_DIR), "transactions"))
    scores = sample_view.account_scores(spark, SF_DIR)
    timed("quality_report", lambda: quality.validate(tx))
    timed("feature_table", lambda: materialize(features.engineered_table(tx), "features"))
    timed("sample_weights", lambda: run(features.sample_weights(tx)))
    timed("temporal_split", lambda: run(positions.temporal_split(tx)))
    timed("score_injection", lambda: materialize(inject.inject_scores(tx, scores), "enriched"))
    manifest = timed("graph_build", lambda: pipelines.build_graph_tables(tx, fresh_path(spark, "graph")))
    timed("rolling_velocities", lambda: run(contract.velocities(tx)))
    timed("rolling_distinct", lambda: run(contract.distinct_beneficiaries(tx)))
    timed("peer_percentile", lambda: run(contract.peer_percentile(tx)))
    scored = tx.select(F.col("label_is_fraud").alias("label"), F.lit("test").alias("split"),
                       F.least(F.lit(1.0), F.col("amount_inr") / 1.5e6).alias("probability"))
    timed("metrics", lambda: metrics.evaluate(scored, ["split"]).collect())
    tables = pipelines.graph_tables(spark, manifest)
    timed("account_model_training", lambda: pipelines.train_accounts(tables)[2].collect())
    timed(f"boosted_trees_{TREES}", lambda: pipelines.train_transactions(
        tx, {"trees": TREES, "depth": 5})[1].collect())
    print(json.dumps({
        "metric": "stage_seconds_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1], "rows": tx.count(), "features": len(schema.FEATURES)}))
    clean_up(spark)


if __name__ == "__main__":
    main()
