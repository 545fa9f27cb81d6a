"""What a session needs: the package on its executors, and the folder that they share."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_folders: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="ragframe-code-"), "ragframe.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("ragframe", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. A local master without it, as in tests, gets a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        if sc.applicationId not in _folders:
            _folders[sc.applicationId] = tempfile.mkdtemp(prefix="ragframe-shared-")
        named = _folders[sc.applicationId]
    if not named:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df in the shared folder: what follows reads it again, and doesn't compute it anew."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
