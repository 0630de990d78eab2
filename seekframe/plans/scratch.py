"""Scratch folders for queries that write: below the folder that the cluster shares, else a temporary one."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="seekframe-")
    return f"{base}/scratch-{uuid.uuid4().hex}"
