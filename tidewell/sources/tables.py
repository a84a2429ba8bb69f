"""Reading tables, and saving and loading fitted operators."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from tidewell.plans.fit import FitPlan


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(spark: SparkSession, plan: FitPlan, path: str) -> None:
    """A row for each estimator: its path in the tree, its kind and its state; large dictionaries as tables beside it."""
    rows = [(p, type(op).__name__, json.dumps(op.state())) for p, op in plan.modules.items()]
    for p, op in plan.modules.items():
        if getattr(op, "table", None) is not None:
            op.table.write.mode("overwrite").parquet(f"{path}/dictionary-{p}")
    states = spark.createDataFrame(rows, "path string, kind string, state string")
    states.coalesce(1).write.mode("overwrite").parquet(f"{path}/estimators")


def load(spark: SparkSession, plan: FitPlan, path: str) -> FitPlan:
    """Puts saved states into a tree of the same shape."""
    for r in spark.read.parquet(f"{path}/estimators").orderBy("path").collect():  # a row for each estimator
        op, state = plan.modules[r["path"]], json.loads(r["state"])
        if type(op).__name__ != r["kind"]:
            raise ValueError(f"{r['path']} was a {r['kind']}, is a {type(op).__name__}")
        if "small" in state and state["small"] is None:
            op.load(state, spark.read.parquet(f"{path}/dictionary-{r['path']}"))
        else:
            op.load(state)
    return plan
