"""What a session needs before Python workers can import this library."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = str(Path(__file__).resolve().parent.parent)


def attach(spark: SparkSession) -> SparkSession:
    """Puts the library's own place on the Python path of workers on this machine; a cluster ships it with --py-files."""
    own = spark.sparkContext.environment
    parts = [p for p in own.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in parts:
        own["PYTHONPATH"] = os.pathsep.join([_ROOT, *parts])
    return spark
