"""Session defaults and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import re
import shutil
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "codeloom", more: dict[str, str] | None = None) -> SparkSession:
    """A session for tests and benches; on a cluster the submitter configures its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config(map=more or {})
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset a folder of our own, if master is local.

    On a cluster a folder of this machine would be another one on each executor, so there it raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = known.get() if known.isDefined() else tempfile.mkdtemp(prefix="codeloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def _drop(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release() -> None:
    """Delete all tables written by ``cut`` and all ``scratch`` folders; call it when their results have been read."""
    while _written:
        _drop(*_written.pop())


@atexit.register
def _forget() -> None:
    while _written:
        spark, path = _written.pop()
        try:
            _drop(spark, path)
        except Exception as e:  # the session may have ended before; a folder of this machine can still be deleted
            local = re.sub(r"^file:(?://)?(?=/)", "", path)
            if local.startswith("/"):
                shutil.rmtree(local, ignore_errors=True)
            else:
                print(f"codeloom: {path} is left in the shared folder: {type(e).__name__}", file=sys.stderr)


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder, deleted with the tables."""
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application, in case it isn't installed on them."""
    sc = spark.sparkContext
    if getattr(sc, "_codeloom_shipped", None) is None:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="codeloom-pkg-")) / "codeloom_pkg.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"{root.name}/{f.relative_to(root)}")
        sc.addPyFile(str(target))
        sc._codeloom_shipped = str(target)
    return spark
