"""Session settings, shared-folder checkpoints and table access."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quire", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; on a cluster pass only what differs from the cluster's defaults."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    if master:
        b = b.master(master)
    for k, v in {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per context, so that they need no installation of it."""
    sc = spark.sparkContext
    if getattr(sc, "_quire_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="quire-package-"), "quire_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("quire", os.path.relpath(full, package)))
    sc.addPyFile(archive)
    sc._quire_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage.

    ``spark.checkpoint.dir`` of the session wins. Only where it is unset (tests,
    local runs) a folder of this machine is made; on a cluster master that would
    lose data with the machine, so it is refused there.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quire-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder; survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, for tables that one step writes and another reads."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``; the package is shipped to the workers on first use."""
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
