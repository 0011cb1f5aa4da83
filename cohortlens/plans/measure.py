"""How long a plan takes, and which of Spark's means are on in a session."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def measured(make: Callable[..., DataFrame], *args, n_runs: int = 10, **kwargs) -> dict[str, float]:
    """mean_ms, std_ms, min_ms, max_ms, n_runs of making a DataFrame and computing all its rows, which go nowhere."""
    if n_runs < 1:
        raise ValueError("n_runs is 1 or more")
    times = []
    for _ in range(n_runs):
        start = time.perf_counter()
        make(*args, **kwargs).write.format("noop").mode("overwrite").save()
        times.append((time.perf_counter() - start) * 1000)
    return {"mean_ms": float(np.mean(times)), "std_ms": float(np.std(times)), "min_ms": min(times), "max_ms": max(times), "n_runs": n_runs}


def session_status(spark: SparkSession) -> dict[str, bool]:
    """What the operators' plans rely on: each is on or off in this session."""
    on = lambda key: spark.conf.get(key) == "true"  # noqa: E731, Spark knows the defaults of these
    return {
        "adaptive_plans": on("spark.sql.adaptive.enabled"),
        "skew_joins": on("spark.sql.adaptive.enabled") and on("spark.sql.adaptive.skewJoin.enabled"),
        "generated_code": on("spark.sql.codegen.wholeStage"),
        "filter_pushdown": on("spark.sql.parquet.filterPushdown"),
        "shared_folder": spark.conf.get("spark.checkpoint.dir", None) is not None,
    }
