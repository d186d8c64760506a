"""What a session needs before operators run on it."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context: their Python need not have it, wherever the driver runs."""
    context = spark.sparkContext
    if getattr(context, "_quire_shipped", False):
        return
    package = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="quire-package-")) / "quire.zip"  # on the driver; Spark serves it from there
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(at))
    context._quire_shipped = True


_workspaces: dict[str, str] = {}


def workspace(spark: SparkSession) -> str:
    """A folder of this session in the one that all executors share, ``spark.checkpoint.dir``; unset on one machine, a temporary one."""
    context = spark.sparkContext
    if context.applicationId not in _workspaces:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            set_ = context._jsc.sc().getCheckpointDir()
            at = set_.get() if set_.isDefined() else None
        if not at:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            at = "file://" + tempfile.mkdtemp(prefix="quire-work-")
        _workspaces[context.applicationId] = f"{at}/quire-{uuid.uuid4().hex}"
    return _workspaces[context.applicationId]
