"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession


@cache
def _local() -> str:
    return tempfile.mkdtemp(prefix="stepframe-")


def shared_folder(spark: SparkSession) -> str:
    """A new name below ``spark.checkpoint.dir``.

    Where that is unset, a local folder serves, but only under a local master: executors elsewhere would write
    to disks that nobody else reads. The session's settings are not changed.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + _local()
    return f"{base.rstrip('/')}/stepframe/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
