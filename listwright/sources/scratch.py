"""Where a job may put tables that others of its tasks have to read."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder the session names in ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine takes a path beside its warehouse; a cluster has
    no folder that all executors see, so there it is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}-scratch"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
