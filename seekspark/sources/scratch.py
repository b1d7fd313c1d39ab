"""A folder for what a session derives and reads again: indexes and lists. It goes when the driver ends."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}
_made: dict[tuple[str, str], Any] = {}


def _path(spark: SparkSession, path: str) -> tuple[Any, Any]:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def workspace(spark: SparkSession) -> str:
    """In the shared folder that ``spark.checkpoint.dir`` names; a local session without one gets a temporary folder."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="seekspark-")
        _folders[app] = f"{base.rstrip('/')}/derived-{app}"
        target, system = _path(spark, _folders[app])
        system.mkdirs(target)
        system.deleteOnExit(target)
    return _folders[app]


def version(frame: DataFrame) -> str:
    """Changes when the files that ``frame`` reads do."""
    seen = []
    for f in sorted(frame.inputFiles()):
        target, system = _path(frame.sparkSession, f)
        status = system.getFileStatus(target)
        seen.append(f"{f} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(seen).encode()).hexdigest()[:16]


def once(spark: SparkSession, name: str, source: DataFrame, make: Callable[[str], Any]) -> Any:
    """What ``make(folder)`` gives, made once a session for each version of ``source``'s files."""
    folder = f"{workspace(spark)}/{name}-{version(source)}"
    key = (spark.sparkContext.applicationId, folder)
    if key not in _made:
        _made[key] = make(folder)
    return _made[key]
