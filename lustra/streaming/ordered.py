"""Deduplication of files as they land, by event time: state that expires, late rows to the quarantine.

Every micro-batch is a join with the keys remembered so far and writes three kinds of rows: new ones,
repeats and late ones.  All it leaves is written under its batch number, so a batch that is tried again
after a failure replaces its own files, and a restart continues where the checkpoint ends.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lustra.functions.columns import ref, refs
from lustra.functions.frames import aggregate_by

KINDS = ("new", "repeat", "late")


def split_batch(batch: DataFrame, known: DataFrame, keys: Sequence[str], event_time: str, order_by: Sequence[str], delay: str, watermark: str | None) -> DataFrame:
    """Rows of a batch with ``kind``: ``late`` before the watermark, ``repeat`` of a remembered key or of an earlier row of the batch, else ``new``.

    ``known`` has the keys remembered, with ``last_time``.  A null event time is late.  Null keys equal each other.
    """
    late = f"{ref(event_time)} IS NULL" if watermark is None else f"coalesce({ref(event_time)} < TIMESTAMP '{watermark}', true)"
    marked = batch.withColumn("__late", F.expr(late))
    same = " AND ".join(f"{ref(k)} <=> {ref('__k_' + k)}" for k in keys)
    seen = known.selectExpr(*[f"{ref(k)} AS {ref('__k_' + k)}" for k in keys], "true AS __seen")
    # A key is remembered once, so rows are not multiplied; adaptive execution splits a key that most rows have.
    joined = marked.join(seen, F.expr(same), "left")
    # Of rows of one key, only the first in order can be new: found by aggregation, not by sorting a key's rows.
    order = f"struct({refs([event_time, *order_by])})"
    first = aggregate_by(marked.filter("NOT __late"), keys, {"__first": f"min({order})"})
    first = first.selectExpr(*[f"{ref(k)} AS {ref('__f_' + k)}" for k in keys], "__first")
    joined = joined.join(first, F.expr(" AND ".join(f"{ref(k)} <=> {ref('__f_' + k)}" for k in keys)), "left")
    kind = f"CASE WHEN __late THEN 'late' WHEN __seen OR NOT ({order} <=> __first) THEN 'repeat' ELSE 'new' END"
    return joined.withColumn("kind", F.expr(kind)).select(*[F.col(ref(c)) for c in batch.columns], "kind")


def remembered(known: DataFrame, batch: DataFrame, keys: Sequence[str], event_time: str, watermark: str, delay: str) -> DataFrame:
    """Keys with the last time they were seen on time; those last seen ``delay`` before the watermark are forgotten."""
    now = batch.filter("kind <> 'late'").selectExpr(*[ref(k) for k in keys], f"CAST({ref(event_time)} AS TIMESTAMP) AS last_time")
    latest = aggregate_by(known.select(*[F.col(ref(k)) for k in keys], "last_time").unionAll(now), keys, {"last_time": "max(last_time)"})
    return latest.filter(f"last_time + INTERVAL {delay} >= TIMESTAMP '{watermark}'")


def dedup_stream(
    spark: SparkSession, landing: str, schema: str | T.StructType, keys: Sequence[str], event_time: str, delay: str, out: str, checkpoint: str,
    order_by: Sequence[str] = (), kind: str = "parquet", files_per_batch: int = 1, options: Mapping[str, str] | None = None,
) -> StreamingQuery:
    """Start deduplicating the files in ``landing`` in the order they came, and stop when none are left.

    The watermark of a batch is the latest event time of the batches before it, less ``delay`` (an interval as
    ``2 days``).  Rows before it are late and go to the quarantine.  A key is remembered until the watermark has
    passed the last time it was seen by ``delay``; its rows until then are repeats.  Of rows of one key in a batch
    the first by event time and ``order_by``, which should be unique, is new.  State is as large as the keys of that time.

    ``out`` has a folder per batch and kind, ``checkpoint`` the stream's own files and the state of the last two batches.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    source = spark.readStream.schema(fields).format(kind).option("maxFilesPerTrigger", files_per_batch)
    for name, value in (options or {}).items():
        source = source.option(name, value)
    state = f"{checkpoint}/keys"
    remember = T.StructType([*[fields[k] for k in keys], T.StructField("last_time", T.TimestampType())])

    def sink(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        batch = batch.withColumn(event_time, F.expr(f"CAST({ref(event_time)} AS TIMESTAMP)"))
        before = _read(session, f"{state}/batch={number - 1}", remember)
        watermark = _watermark(session, f"{state}/time={number - 1}")
        split = split_batch(batch, before, keys, event_time, order_by, delay, watermark)
        path = f"{out}/batch={number}"
        split.write.mode("overwrite").partitionBy("kind").parquet(path)
        written = session.read.schema(split.schema).parquet(path)
        latest = written.agg(F.expr(f"CAST(max({ref(event_time)}) - INTERVAL {delay} AS STRING)")).first()[0]
        moved = max((t for t in (watermark, latest) if t is not None), default=None)
        if moved is not None:
            remembered(before, written, keys, event_time, moved, delay).write.mode("overwrite").parquet(f"{state}/batch={number}")
            session.createDataFrame([(moved,)], "watermark string").coalesce(1).write.mode("overwrite").parquet(f"{state}/time={number}")
        for name in ("batch", "time"):
            _delete(session, f"{state}/{name}={number - 2}")

    return source.load(landing).writeStream.foreachBatch(sink).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()


def read_kind(spark: SparkSession, out: str, kind: str, schema: str | T.StructType, event_time: str) -> DataFrame:
    """Rows of one kind of all batches; none before any row was written."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kept = [T.StructField(f.name, T.TimestampType()) if f.name == event_time else f for f in fields.fields]
    return _read(spark, out, T.StructType([*kept, T.StructField("kind", T.StringType())])).filter(F.col("kind") == kind).drop("kind", "batch")


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    where, files = _path(spark, path)
    return spark.read.schema(schema).parquet(path) if files.exists(where) else spark.createDataFrame([], schema)


def _watermark(spark: SparkSession, path: str) -> str | None:
    where, files = _path(spark, path)
    return spark.read.parquet(path).first()[0] if files.exists(where) else None


def _delete(spark: SparkSession, path: str) -> None:
    where, files = _path(spark, path)
    files.delete(where, True)
