"""Session defaults. Nothing here overrides what a cluster has set for an existing session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def get_session(app: str = "sparkprep", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master or not os.environ.get("SPARK_MASTER"):
        builder = builder.master(master or "local[*]")
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**defaults, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once a context, as they may not have it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_sparkprep_shipped", False):
        return
    package = Path(__file__).parent
    at = Path(tempfile.mkdtemp(prefix="sparkprep-")) / "sparkprep.zip"  # the driver serves it, nobody else reads it
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    sc.addPyFile(str(at))
    sc._sparkprep_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: ``spark.checkpoint.dir``. A local one only where all executors are local."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir()
    if at is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None:
            if not (sc.master or "").startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            at = tempfile.mkdtemp(prefix="sparkprep-")
        sc.setCheckpointDir(at)
        at = sc.getCheckpointDir()
    return at


def materialised(df):
    """``df`` written once to the shared folder: its partitions and their order stay as they are, whatever reads it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
