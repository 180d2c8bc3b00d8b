"""A folder for files that a query writes on its way."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path under the folder that the cluster shares (spark.checkpoint.dir); a local one only in local mode, where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='quernel-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"
