"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
``value`` is the total wall time of the headline queries (each timed from
DataFrame construction to the last row written to a no-op sink).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from skufold.operators import results as res  # noqa: E402
from skufold.operators.cluster import ClusterConfig  # noqa: E402
from skufold.plans import flows  # noqa: E402
from skufold.plans import registry  # noqa: E402
from skufold.session import local_session  # noqa: E402


def _drain(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None

    def e1_flow(spark, d):
        """extract -> normalize -> identity -> hashed TF-IDF vectors -> density
        cut / k-means route -> brand summary."""
        cfg = flows.RunConfig(cluster=ClusterConfig(epsilon=0.1))
        det = flows.catalog_run(spark, d, cfg)
        return res.brand_summary(det)

    headline = {
        "extract": registry.Q["R1_catalog_extract"],
        "normalize": registry.Q["N13_normalize_name"],
        "facets_identity": registry.Q["F6_facets_identity"],
        "identity_brand_summary": registry.Q["O4_brand_summary"],
        "representatives": registry.Q["O13_representatives"],
        "variant_types": registry.Q["O12_variant_type_summary"],
        "density_clusters": registry.Q["C4_density_clusters"],
        "density_clusters_ms3": registry.Q["C4_density_clusters_ms3"],
        "kmeans_clusters": registry.Q["C8_kmeans_clusters"],
        "catalog_flow": e1_flow,
    }
    # warm-up: JVM start and first codegen are not part of any query
    _drain(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.count(F.lit(1))))
    times = {}
    for name, fn in headline.items():
        t = time.time()
        _drain(fn(spark, sf_dir))
        times[name] = round(time.time() - t, 3)
        print(f"[bench] {name}: {times[name]}s", file=sys.stderr, flush=True)
    n_products = flows.products(spark, sf_dir).count()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times,
                      "sf": sf, "products": n_products,
                      "catalog_flow_products_per_sec": round(n_products / times["catalog_flow"], 1)}))


if __name__ == "__main__":
    main()
