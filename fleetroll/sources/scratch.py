"""Places for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"

#: Paths given out, by application.
_given: defaultdict[str, list[str]] = defaultdict(list)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder the session names; a temporary folder only for a local session without one."""
    root = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="fleetroll-")
    path = f"{root.rstrip('/')}/fleetroll/{name}-{uuid.uuid4().hex}"
    _given[spark.sparkContext.applicationId].append(path)
    return path


def release_scratch(spark: SparkSession, keep: Iterable[str] = ()) -> list[str]:
    """Deletes the intermediate tables of this application but those in ``keep``; returns the deleted paths.

    Results that are still to be computed from them are lost, so write a result first. Other applications' tables stay.
    """
    application, kept, gone = spark.sparkContext.applicationId, set(keep), []
    for path in _given[application]:
        if path not in kept:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            if place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True):
                gone.append(path)
    _given[application] = [path for path in _given[application] if path in kept]
    return gone
