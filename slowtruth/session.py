"""Session helpers: where intermediate tables live and how they are written.

Intermediate tables go to the shared folder the cluster names in
``spark.checkpoint.dir``, so losing an executor never loses them. A private
folder is made only in local mode, where nothing is configured (tests).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_STAGED: dict[str, list[str]] = {}


def local_session(cores: str = "*", partitions: int = 8, app: str = "slowtruth") -> SparkSession:
    """A session for tests and for the benchmark on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.python.unix.domain.socket.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that every executor can reach."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    already_set = spark.sparkContext._jsc.sc().getCheckpointDir()
    if already_set.isDefined():
        return already_set.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="slowtruth-")
    return _LOCAL_DIRS[app]


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None, **options: str) -> DataFrame:
    """Write ``df`` once as Parquet (with the writer's ``options``) and return a scan of what was written.

    Cuts the lineage and pins values such as row ids, which must be the same for
    every later reader.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write.options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> int:
    """Delete the intermediate tables this application wrote; call when results are saved."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = _STAGED.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    return len(paths)
