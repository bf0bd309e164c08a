"""Where intermediate tables may be written."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

SHARED_DIR_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """This library's folder in the cluster's shared folder.

    Only a local session without that setting falls back to its warehouse; on
    a cluster the folder must be one that all executors share.
    """
    shared = spark.conf.get(SHARED_DIR_SETTING, None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SHARED_DIR_SETTING} to a folder all executors share")
        shared = spark.conf.get("spark.sql.warehouse.dir") + "/scratch"
    return f"{shared.rstrip('/')}/tripweave"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below ``shared_folder``."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
