"""Sessions for local runs, and the two things every iterative operator needs of a session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, memory: str = "8g", **conf) -> SparkSession:
    """A session on this machine, for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("foliospark")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once an application: they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    home = Path(__file__).parent
    # the driver serves the file as long as the application runs
    folder = tempfile.mkdtemp(prefix="foliospark-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, f"{home.name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(home.rglob("*.py")):
            z.write(file, file.relative_to(home.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def cut(df: DataFrame) -> DataFrame:
    """`df` materialised in the checkpoint folder that all executors share, its lineage cut.

    The folder is the session's spark.checkpoint.dir. Only where a session names none and runs in
    one process (tests) is a temporary folder of this machine taken."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="foliospark-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table of `folder`."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
