"""Session settings and the shared folder for staged tables."""

from __future__ import annotations

import functools
import shutil
import tempfile
import weakref
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from adloom.sources import files


def session(app: str = "adloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; `conf` wins over them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


class _OwnDir:
    """A folder that goes with the process."""

    def __init__(self) -> None:
        self.path = tempfile.mkdtemp(prefix="adloom-")
        weakref.finalize(self, shutil.rmtree, self.path, ignore_errors=True)


@functools.cache
def _own_dir() -> _OwnDir:
    return _OwnDir()


#: Folders of a cluster that a trial run has shown to be shared, by application.
_shared: set[tuple[str, str]] = set()


def _try_folder(spark: SparkSession, folder: str) -> None:
    """Fail unless the driver and the tasks find what every other task has written."""
    key = (spark.sparkContext.applicationId, folder)
    if key in _shared:
        return
    tasks = 4 * spark.sparkContext.defaultParallelism
    path = f"{folder}/trial-{uuid.uuid4().hex}"
    spark.range(0, tasks, 1, tasks).write.parquet(path)
    found = spark.read.schema("id bigint").parquet(path).count()
    if found != tasks:
        raise OSError(f"of {tasks} rows that as many tasks wrote to {path}, {found} are there")
    files.delete(spark, path)
    _shared.add(key)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, taken from `spark.checkpoint.dir`.

    Only a local master may go without the setting; it gets a folder that goes with the process. On a cluster, a folder of
    the machine's file system may be a mount that all machines share or one that each has for itself: its name does not
    tell, so a trial run does, once in an application.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    local = spark.sparkContext.master.startswith("local")
    if not folder and local:
        return _own_dir().path
    refused = "set spark.checkpoint.dir to a folder every executor can reach"
    if not folder:
        raise ValueError(refused)
    folder = folder.rstrip("/")
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    scheme = folder.partition(":/")[0] if ":/" in folder else default.partition(":")[0]
    if scheme == "file" and not local:
        try:
            _try_folder(spark, folder)
        except Exception as e:  # whatever ends the trial would end the writing of tables
            raise ValueError(f"{refused}; {folder} is none") from e
    return folder


def staging_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    For results that are narrow and used more than once: they are worked out once, and a lost
    executor takes nothing with it.
    """
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def observed(df: DataFrame, **figures: Column) -> tuple[DataFrame, Observation]:
    """The table with aggregates that are worked out on its rows when it is written, without another pass.

    It must be written as it is, or filtered: tasks that write count once however often they are run, those that write
    shuffle files may count twice after an executor is lost.
    """
    seen = Observation()
    return df.observe(seen, *[value.alias(name) for name, value in figures.items()]), seen


def materialize_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """`materialize`, and the number of rows, counted while they are written."""
    rows, seen = observed(df, n=F.count("*"))
    table = materialize(rows, name)
    return table, seen.get["n"]


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a small table before costly work on its rows.

    A table estimated at a full file split per core or more has enough splits and stays as it is.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    to_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    split = to_bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * split else df
