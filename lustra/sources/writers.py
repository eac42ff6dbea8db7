"""Writers for tables and for the reports of a cleaning job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lustra.functions.columns import ref
from lustra.functions.frames import with_exprs

# CSV has no nested values; these report columns are written as JSON text.
_NESTED = ("array", "struct", "map")


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in _NESTED]
    return with_exprs(df, {c: f"to_json({ref(c)})" for c in nested})


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    writer = flat(df).write.mode(mode).option("header", True).option("sep", sep)
    writer.option("quote", '"').option("escape", '"').csv(path)


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_csv(df, path, "\t", mode)


def write_report(df: DataFrame, path: str, job_id: str, kind: str = "json", mode: str = "overwrite") -> None:
    """Write a report table under ``job_id=<id>``, so that jobs can be read together.

    Only the partition of this job is replaced, so a job that is tried again leaves one report and no other job's
    is touched; ``append`` adds to what is there.
    """
    own = df.withColumn("job_id", F.lit(job_id))
    own.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("job_id").format(kind).save(path)


def write_profile(profile: DataFrame, path: str, job_id: str, kind: str = "json") -> None:
    write_report(profile, path, job_id, kind)


def write_audit(audit: DataFrame, path: str, job_id: str, kind: str = "json") -> None:
    write_report(audit.withColumn("written_at", F.current_timestamp()), path, job_id, kind)


def write_errors(errors: DataFrame, path: str, job_id: str, kind: str = "json") -> None:
    write_report(errors, path, job_id, kind)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One record per line; nested values stay nested."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)
