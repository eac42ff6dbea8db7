"""Cleaning of files as they land.

Only row-local rules run on the stream.  Statistics it needs (fill values, outlier bounds)
are fitted beforehand on a batch and enter as literals, see ``fit_row_rules``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lustra.functions.columns import as_list, ref
from lustra.operators import casting, missing, outliers, textual, validate
from lustra.sources.readers import null_tokens


def fit_row_rules(sample: DataFrame, fill: Mapping[str, str] | None = None, cap: list[str] | None = None, exact: bool = True) -> dict:
    """Fill values and clip bounds of a batch, as literals for ``apply_row_rules``."""
    return {
        "fill": missing.fit_fill(sample, fill or {}, exact),
        "clip": outliers.fit_iqr(sample, cap or [], exact=exact),
    }


def apply_row_rules(df: DataFrame, rules: Mapping) -> DataFrame:
    """Row-local cleaning, the same for batch and stream.

    Keys, in this order: ``null_tokens`` (True or a list), ``required`` (drop rows without),
    ``fill`` (column to value), ``cast_types``, ``normalize_text``, ``clip`` (column to bounds).
    """
    if tokens := rules.get("null_tokens"):
        df = null_tokens(df) if tokens is True else null_tokens(df, tokens)
    for column in rules.get("required", []):
        df = missing.drop_missing_rows(df, column)
    df = missing.apply_fill(df, rules.get("fill", {}))
    df = casting.cast_types(df, rules.get("cast_types", {}))
    if rules.get("normalize_text"):
        df = textual.normalize_text(df, rules["normalize_text"])
    return outliers.apply_clip(df, rules.get("clip", {}))


def checked(df: DataFrame, rules: Mapping, row_id: str | list[str] = ()) -> DataFrame:
    """Cleaned rows with their broken rules and ``is_valid``."""
    out = validate.with_errors(apply_row_rules(df, rules), rules.get("schema", {}), as_list(row_id))
    return out.withColumn("is_valid", F.expr("size(errors) = 0"))


def without_repeats(df: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """Drop repeats of a key that arrive within ``delay`` of each other; state stays bounded."""
    if isinstance(df.schema[event_time].dataType, T.TimestampNTZType):
        df = df.withColumn(event_time, F.expr(f"CAST({ref(event_time)} AS TIMESTAMP)"))
    return df.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def clean_stream(
    spark: SparkSession,
    landing: str,
    schema: str | T.StructType,
    rules: Mapping,
    out: str,
    checkpoint: str,
    kind: str = "parquet",
    row_id: str | list[str] = (),
    options: Mapping[str, str] | None = None,
    repeats: tuple[list[str], str, str] | None = None,
) -> StreamingQuery:
    """Start cleaning the files in ``landing`` and stop when none are left.

    Valid and quarantined rows go to one table partitioned by ``is_valid``: each file is
    read once, and the file sink commits a micro-batch as a whole, so a restart neither loses
    nor repeats rows.  ``repeats`` is ``(keys, event time, delay)`` for stream deduplication.
    """
    source = spark.readStream.schema(schema).format(kind)
    for name, value in (options or {}).items():
        source = source.option(name, value)
    df = source.load(landing)
    if repeats is not None:
        df = without_repeats(df, *repeats)
    return (
        checked(df, rules, row_id)
        .writeStream.format("parquet")
        .partitionBy("is_valid")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def _written(spark: SparkSession, out: str, schema: str | T.StructType | None) -> DataFrame:
    """The stream's table; with the ``schema`` of its input even before any row was written."""
    if schema is None:
        return spark.read.parquet(out)
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    added = T.StructType.fromDDL(f"errors array<struct<{validate.ERROR}>>, is_valid string")
    return spark.read.schema(T.StructType([*fields.fields, *added.fields])).parquet(out)


def read_valid(spark: SparkSession, out: str, schema: str | T.StructType | None = None) -> DataFrame:
    return _written(spark, out, schema).filter("is_valid = 'true'").drop("is_valid", "errors")


def read_quarantine(spark: SparkSession, out: str, schema: str | T.StructType | None = None) -> DataFrame:
    return _written(spark, out, schema).filter("is_valid = 'false'").drop("is_valid")
