"""Session settings and the shared folder used to cut long plans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lustra.functions.columns import ref


def local_session(cores: int = 8, name: str = "lustra") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session without the setting gets a temporary folder; a cluster without it
    is an error, because executors would not see each other's files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        path = tempfile.mkdtemp(prefix="lustra-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def new_shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/lustra/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage", partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Later passes then read only the columns they need, and a lost executor costs a re-read
    of a file instead of the whole history.  Readers of one value of ``partition_by`` open its files only.
    """
    spark = df.sparkSession
    for field in df.schema.fields:
        if isinstance(field.dataType, T.NullType):
            df = df.withColumn(field.name, F.expr(f"CAST({ref(field.name)} AS STRING)"))
    path = new_shared_path(spark, label)
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that nothing will read again: what was computed from them is staged itself."""
    for df in staged:
        if path := getattr(df, "_staged_at", None):
            _delete(df.sparkSession, path)


def stage_observed(df: DataFrame, measures: Mapping[str, str], label: str = "stage") -> tuple[DataFrame, dict[str, object]]:
    """``stage`` with aggregates of the written rows, taken while they are written.

    They are measured in the stage that writes, whose tasks count once each however often they are tried.
    """
    seen = Observation()
    names = list(measures)
    # Whatever the names are, the metrics are numbered.
    written = stage(df.observe(seen, *[F.expr(measures[n]).alias(f"m{i}") for i, n in enumerate(names)]), label)
    return written, {n: seen.get[f"m{i}"] for i, n in enumerate(names)}


def release(spark: SparkSession) -> None:
    """Delete every table this application has staged; call it when no result that reads them is needed."""
    _delete(spark, f"{shared_dir(spark).rstrip('/')}/lustra/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint that keeps the partitioning and the order inside partitions."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
