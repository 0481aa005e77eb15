"""Sessions, table loading and lineage cuts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sparkloom", cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session given there."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that the cluster names in ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own; on a cluster a machine-local one
    would be lost with its machine, so its lack is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if shared is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        context.setCheckpointDir(shared or os.path.join(tempfile.mkdtemp(prefix="sparkloom-"), "checkpoints"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: as :func:`cut`, but in columns, so that
    what follows reads only those it needs."""
    folder = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python tasks can import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory(prefix="sparkloom-") as folder:
        copy = Path(folder, "tree", package.name)
        shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(str(Path(folder, package.name)), "zip", copy.parent)
        keep = Path(tempfile.mkdtemp(prefix="sparkloom-"), f"{package.name}.zip")
        shutil.copy(archive, keep)
    context.addPyFile(str(keep))
    _shipped.add(context.applicationId)
