"""What a session needs before jobs that run Python on workers or checkpoint."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Put this package's folder on the workers' path; a cluster has it from ``--py-files``."""
    home = str(Path(__file__).resolve().parents[1])
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if home not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [home, known]))
    return spark


def shared_folder(spark: SparkSession) -> SparkSession:
    """Make checkpoint() usable: in the cluster's folder, or where none is set and all runs on this machine, in one of our own.

    Raises RuntimeError on several machines without such a folder.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or "file:///tmp/checkpoints/geoloom")
    return spark
