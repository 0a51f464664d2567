"""Sessions: getting this package to the executors, and the folder that all of them share."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()
_folders: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the executors once a context, unless they can import it anyway
    (it is on PYTHONPATH or in the working folder)."""
    context = spark.sparkContext
    at_hand = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + [os.getcwd()]
    if context.applicationId in _shipped or any(Path(p).resolve() == ROOT for p in at_hand):
        return
    _shipped.add(context.applicationId)
    folder = tempfile.mkdtemp(prefix="linkspan-src-")
    for path in (ROOT / "linkspan").rglob("*.py"):
        target = Path(folder, "src", path.relative_to(ROOT))
        target.parent.mkdir(parents=True, exist_ok=True)
        shutil.copy(path, target)
    context.addPyFile(shutil.make_archive(f"{folder}/linkspan", "zip", f"{folder}/src"))


def run_folder(spark: SparkSession) -> str:
    """This application's own folder in spark.checkpoint.dir, removed when the application ends. Where
    the setting is unset, a local folder serves a local master; on a cluster that is an error, as the
    executors would not see each other's files."""
    context = spark.sparkContext
    if context.applicationId not in _folders:
        given = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not given:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            given = "file://" + tempfile.mkdtemp(prefix="linkspan-")
        path = f"{given.rstrip('/')}/linkspan-{context.applicationId}"
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(place)
        _folders[context.applicationId] = path
    return _folders[context.applicationId]


def fresh_path(spark: SparkSession) -> str:
    """A path in the run's folder that nothing has been written to."""
    return f"{run_folder(spark)}/{uuid.uuid4().hex}"
