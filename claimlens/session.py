"""Session settings and shared storage."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A frame of at most so many rows of a few small values may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000

_own: dict[str, str] = {}
_written: dict[str, SparkSession] = {}


def build(app: str = "claimlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is tested with; conf adds to them or overrides them."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Only where that is unset (tests,
    local mode) a temporary folder of this machine is used."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="claimlens-")
    return _own[app]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, and survives lost executors."""
    folder = f"{shared_dir(df.sparkSession)}/claimlens/{df.sparkSession.sparkContext.applicationId}"
    if folder not in _written:
        _written[folder] = df.sparkSession
    path = f"{folder}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def limited(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its rows, which the caller has counted, are at most BROADCAST_ROWS; else Spark joins
    it by a shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def counted(df: DataFrame, tag: str) -> tuple[DataFrame, int]:
    """df written (see materialize) and marked for a broadcast if it is small, with its number of rows. Where it is not,
    nothing but the scan stands under its side of a join, so that Spark can split a large key of the other side."""
    df = materialize(df, tag)
    n = df.count()
    return limited(df, n), n


def discard(*frames: DataFrame) -> None:
    """Delete the files behind frames made by materialize() that nothing reads any more."""
    for df in frames:
        for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
            if "/claimlens/" in f:
                _delete(df.sparkSession, f)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def clean() -> None:
    """Delete what materialize() wrote in this application; frames that read it can't be used any more. Runs at exit; a
    driver that was killed leaves the folder of its application id."""
    for folder, spark in _written.items():
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, folder)
        except Exception:  # the session has gone; nothing more can be done from here
            pass
    _written.clear()
    for folder in _own.values():
        shutil.rmtree(folder.removeprefix("file://"), ignore_errors=True)
    _own.clear()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at path, in whatever store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def sweep(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of frames that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settle(spark: SparkSession) -> None:
    """Let the executors collect their garbage and give back the memory that their heaps grew to: G1 does so in a full
    collection only, and what stays touched adds to the memory of the Python workers of what runs next."""
    tasks = 2 * spark.sparkContext.defaultParallelism  # so many that each executor gets some
    spark.range(0, tasks, 1, tasks).selectExpr("reflect('java.lang.System', 'gc') as done").write.format("noop").mode("overwrite").save()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
