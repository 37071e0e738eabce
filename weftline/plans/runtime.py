"""Session-level helpers that every operator shares: tables, lineage cuts, Arrow batching."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


PACKAGE = __name__.split(".")[0]


def share_package(spark: SparkSession) -> None:
    """Lets Python workers import the package: from where the driver has it on this machine, on a cluster from an archive sent to them."""
    sc = spark.sparkContext
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = sc.environment
    if home not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [home, known.get("PYTHONPATH", "")]))
        if not sc.master.startswith("local"):
            ship_package(spark, home)


def ship_package(spark: SparkSession, home: str) -> str:
    """Writes the package's sources as an archive to the checkpoint folder, which all machines share, and adds it to the job; gives its path."""
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(home, PACKAGE)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, home))
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/{PACKAGE}.zip")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(held.getvalue()))
    out.close()
    sc.addPyFile(path.toString())
    return path.toString()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``root`` (a file or a folder of files)."""
    share_package(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder.

    The cluster names it in ``spark.checkpoint.dir``; only a local session without one gets a
    temporary folder. On a cluster without the setting this fails instead of writing to one machine.
    """
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if given is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        given = tempfile.mkdtemp(prefix="weftline-checkpoint-")
    sc.setCheckpointDir(given)
    return given


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
