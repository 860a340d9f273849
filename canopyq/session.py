"""Session defaults and the shared folder for results that cut lineage."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent

#: Settings under which a cached node table joins with itself without another shuffle.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def tuned(spark: SparkSession) -> SparkSession:
    """Set the runtime defaults on a session that the caller made."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def with_checkpoint_dir(spark: SparkSession) -> SparkSession:
    """Keep the cluster's spark.checkpoint.dir; only on a local master without one, as in tests, set a local one. Elsewhere a missing one is an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return spark
    if shared := context.getConf().get("spark.checkpoint.dir"):
        context.setCheckpointDir(shared)
        return spark
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="canopyq-checkpoint-"))
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the written files."""
    with_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipped(spark: SparkSession) -> SparkSession:
    """Let the Python workers import this package where their path does not have it: Spark sends them an archive of it."""
    path = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    context = spark.sparkContext
    if str(_PACKAGE.parent) in path or any(f.endswith("canopyq-package.zip") for f in context.listFiles):
        return spark
    archive = Path(tempfile.mkdtemp()) / "canopyq-package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(_PACKAGE.rglob("*.py")):
            z.write(file, file.relative_to(_PACKAGE.parent))
    context.addPyFile(str(archive))
    return spark
