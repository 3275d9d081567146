"""Session settings and the shared folder for written tables."""

import os
import re
import uuid

from pyspark.sql import SparkSession


def local_session(cpus="*", app="labelgauge"):
    """A local session for tests and the benchmark; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark, name):
    """A new folder path for a written table, below ``spark.checkpoint.dir``.

    The cluster names that setting; where it is unset, a session within one machine uses its warehouse
    folder, and a cluster's session raises, as its machines may share no other folder. What is written
    there stays until the caller removes it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")
