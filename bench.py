"""Headline timings: prints one JSON line.

``BENCH_SF_DIR`` is the table folder, ``BENCH_CPUS`` the number of local executor threads.  Every query
is written to the no-op sink in full; the better of two runs counts.  ``throughput`` holds the rates that
"""

from __future__ import annotations

import json
import logging
import os
import tempfile
import time

from pyspark.sql import functions as F

from wardline.operators import adjudicate as A
from wardline.operators import drift as D
from wardline.operators import identity as I
from wardline.operators import merkle as M
from wardline.queries import load
from wardline.queries.drifting import CURRENT, closed
from wardline.queries.policies import KERNEL, sample_policy
from wardline.queries.registry import QUERIES
from wardline.queries.views import CORPUS_VERSION, cases, claims, indicators, raw_lines, stored_events
from wardline.session import build_session

HEADLINE = [
    "a02_normalize",
    "b01_evidence_id",
    "c04_seal_batches",
    "c05_inclusion_proofs",
    "d16_auth_burst",
    "d17_auth_new_asn",
    "d19_token_replayed",
    "f01_admit",
    "g09_adjudicate",
    "h03_indicator_match",
    "i02_facet_counts",
    "i06_fold_feed",
    "i10_compress_idle",
    "j01_windowed_rule",
    "j11_case_grouping",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def best(fn, times: int = 2) -> float:
    took = []
    for _ in range(times):
        t = time.perf_counter()
        run(fn())
        took.append(time.perf_counter() - t)
    return round(min(took), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    logging.getLogger("py4j").setLevel(logging.ERROR)
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": str(max(8, int(cpus))), "spark.ui.enabled": "false", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    load()
    queries = {name: best(lambda n=name: QUERIES[n](spark, sf_dir)) for name in HEADLINE}

    # rates on stored inputs
    root = tempfile.mkdtemp(prefix="wardline-bench-")
    stored = {
        "closed": closed(spark, sf_dir),
        "claims": I.with_claim_id(claims(spark, sf_dir)),
        "cases": cases(spark, sf_dir),
        "lines": raw_lines(spark, sf_dir),
        "evidence": stored_events(spark, sf_dir).select(F.expr("time div 3600000000000L").alias("batch"), "evidence_id"),
    }
    tables = {}
    for name, df in stored.items():
        df.repartition(int(cpus)).write.parquet(f"{root}/{name}")
        tables[name] = spark.read.parquet(f"{root}/{name}")
    A.claim_groups(tables["claims"]).write.parquet(f"{root}/groups")
    groups = spark.read.parquet(f"{root}/groups")
    policy = sample_policy(spark)
    corpus = indicators(spark, sf_dir)
    sizes = {k: v.count() for k, v in tables.items()}
    seconds = {
        "sweep": best(lambda: D.drift_sweep(tables["closed"], tables["claims"], policy, CURRENT, corpus, CORPUS_VERSION, KERNEL, groups=groups)),
        "adjudicate": best(lambda: A.adjudicate(tables["cases"], tables["claims"], policy, KERNEL)),
        "replay": best(lambda: D.replay_pin(tables["closed"], groups, policy)),
        "hash": best(lambda: I.with_evidence_id(tables["lines"])),
        "seal": best(lambda: M.seal_batches(tables["evidence"], "batch").batches),
    }
    throughput = {
        "sweep_cases_per_s": round(sizes["closed"] / seconds["sweep"], 1),
        "adjudicated_claims_per_s": round(sizes["claims"] / seconds["adjudicate"], 1),
        "replayed_cases_per_s": round(sizes["closed"] / seconds["replay"], 1),
        "hashed_events_per_s": round(sizes["lines"] / seconds["hash"], 1),
        "sealed_leaves_per_s": round(sizes["evidence"] / seconds["seal"], 1),
    }
    queries.update({f"stored_{k}": v for k, v in seconds.items()})
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(queries.values()), 3),
        "unit": "sec",
        "queries": queries,
        "throughput": throughput,
        "rows": sizes,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }
    spark.stop()
    print(json.dumps(line))


if __name__ == "__main__":
    main()
