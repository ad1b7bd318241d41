"""Session helpers: building a session, the shared scratch folder, written tables, size checks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def build_session(app_name: str = "lathework", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; keyword ``a__b`` sets ``spark.a.b``."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config("spark." + key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only a local master may run without that setting; it then gets one temporary folder per
    application. On a cluster a machine-local folder would be lost with its executor, so it is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="lathework-")
    return _LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared scratch folder; ``clear_scratch`` deletes it."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has written to the scratch folder. Call it before the session stops.

    Tables that were read from there are gone afterwards.
    """
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        files, folder = path_object(spark, path)
        files.delete(folder, True)


@atexit.register
def _clear_local() -> None:
    """The temporary folders of local sessions end with the process."""
    for folder in _LOCAL_SCRATCH.values():
        shutil.rmtree(folder, ignore_errors=True)


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage at a table that survives lost executors, and freezes values that depend on
    the physical layout (partition ids, draws, model answers). Readers get column pruning.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def path_object(spark: SparkSession, path: str):
    """The file system of a path and the path itself, as Hadoop objects."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def path_children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it does not exist."""
    files, folder = path_object(spark, path)
    return [status.getPath().getName() for status in files.listStatus(folder)] if files.exists(folder) else []


def spread(scan: DataFrame) -> DataFrame:
    """Deal a small input out over all cores before costly work on its rows.

    ``scan`` must be a plain file scan. One that already has a partition per core (any large table) is
    returned as it is, so no shuffle is added at scale.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def fits(df: DataFrame, max_rows: int) -> bool:
    """True if ``df`` has at most ``max_rows`` rows; reads no more than ``max_rows + 1`` of them."""
    return df.limit(max_rows + 1).count() <= max_rows
