"""Sessions, input tables and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SPARK_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "134217728",
}


def get_session(app: str = "scriptorium", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``conf`` overrides, dots in keys written as ``__``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SPARK_DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of a folder of Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its files have fewer splits than there are cores, as a table of one row group has. Larger tables
    stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where that is unset and the
    master is local. A cluster without the setting is an error, as a machine's own folder is no shared one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="scriptorium-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


_left: list = []


@atexit.register
def release() -> None:
    """Delete all tables that ``scratch`` named and nothing has deleted yet. Runs at the driver's end; a long session may call it
    between queries, after whose results have been taken no plan reads them."""
    while _left:
        fs, path = _left.pop()
        try:
            fs.delete(path, True)
        except Exception:  # the JVM may have gone first
            return


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted at the latest when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    _left.append((p.getFileSystem(spark._jsc.hadoopConfiguration()), p))
    return path


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written to the shared folder and read again. Its lineage ends there, so that a lost executor costs no
    earlier stage; columns are stored encoded and compressed, which a checkpoint's rows aren't."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scriptorium_path = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete the files of materialized frames that no later plan reads."""
    for df in frames:
        path = getattr(df, "_scriptorium_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, for runs from a checkout that they don't have."""
    sc = spark.sparkContext
    if getattr(sc, "_scriptorium_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():
        archive = Path(tempfile.mkdtemp(prefix="scriptorium-")) / "scriptorium.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(archive))
    sc._scriptorium_shipped = True
