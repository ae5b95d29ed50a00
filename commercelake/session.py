"""Session settings and the shared folder for cut lineage and streaming state."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(cpus: int | str = 8, app: str = "commercelake") -> SparkSession:
    """Local session for tests and the bench; a cluster passes its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the Python workers, once per application.

    They import it by name, and elsewhere than in the repository they would not find it. The
    archive is served by the driver; executors need no shared folder for it.
    """
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        home = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="commercelake-code-")) / "commercelake"
        spark.sparkContext.addPyFile(shutil.make_archive(str(target), "zip", home.parent, home.name))
        _SHIPPED.add(app)


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Only a local master may fall back to a temporary folder: there the driver and
    the executors are one process on one machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="commercelake-")
    discard_at_exit(spark, root)
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; never reused between runs."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def discard_at_exit(spark: SparkSession, path: str) -> None:
    """Have Hadoop delete an existing folder when the application's driver ends.

    Not earlier: plans that read it may still run.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)


def cut_lineage(df):
    """Write to the shared folder, for as long as the application runs, and read back.

    The files outlive lost executors, and unlike a checkpointed plan the new one starts
    with file statistics and without the old one's constraints, which grow with each round
    of a loop.
    """
    path = shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    discard_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
