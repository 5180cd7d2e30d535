"""Python workers import this package to run its functions."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver was started."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
