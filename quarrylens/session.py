"""Session helpers: defaults for tests, shipping of the package, and tables that cut lineage."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quarrylens")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _package() -> bytes:
    root, out = os.path.dirname(os.path.abspath(__file__)), io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    p = os.path.join(folder, f)
                    z.write(p, os.path.join("quarrylens", os.path.relpath(p, root)))
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, by way of the shared folder.

    Without a shared folder the package has to be installed on the workers.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    try:
        path = f"{shared_dir(spark)}/ql-code-{uuid.uuid4().hex}/quarrylens.zip"
    except ValueError:
        return
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(sc._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(_package()))
    out.close()
    _written.append((spark, path))
    sc.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: what the cluster names in spark.checkpoint.dir, else, in local mode, one of our own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    own = "file://" + tempfile.mkdtemp(prefix="ql-shared-")
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone
        pass


def drop_staged(path: str | None = None) -> None:
    """Delete one written table, or all that this process wrote."""
    for item in list(_written):
        if path is None or item[1] == path:
            _delete(*item)
            _written.remove(item)


atexit.register(drop_staged)


def scratch(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that is deleted when the process ends."""
    path = f"{shared_dir(spark)}/ql-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def staged(df: DataFrame, label: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor costs a re-read, not a re-run.

    The table is deleted when the process ends, or by drop_staged(df.staged_path).
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out
