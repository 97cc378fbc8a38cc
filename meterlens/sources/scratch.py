"""Folder for intermediate tables and stream checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


#: Folders that this process has named, by the application they were made for.
_named: dict[str, list[str]] = {}


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared ``spark.checkpoint.dir`` of the session. Where that is
    unset, a session in one process uses a local temporary folder; on a cluster executors would
    not see it, so an error is raised."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        folder = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        _named.setdefault(spark.sparkContext.applicationId, []).append(folder)
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix=f"{name}-")
    _named.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def clear_scratch(spark: SparkSession) -> int:
    """Delete the folders that this session was given so far, and say how many. To be called when the
    results that were read from them have been written: a table made by an operator is computed from
    its folders whenever it is used."""
    folders = _named.pop(spark.sparkContext.applicationId, [])
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(folders)
