"""Row identity and row numbers without funnelling rows through one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lustra.functions.columns import ref
from lustra.session import cut


def read_parquet_with_row_id(spark: SparkSession, path: str) -> DataFrame:
    """Parquet rows with their file and their position in it as a stable row id."""
    df = spark.read.parquet(path)
    return df.selectExpr("*", "_metadata.file_path AS row_file", "_metadata.row_index AS row_index")


def number_rows(df: DataFrame, order_by: Sequence[str] = (), name: str = "row_number") -> DataFrame:
    """Consecutive numbers from 0 by the expressions ``order_by`` (or in the current order).

    The sorted rows are checkpointed, so that the partitions counted are the partitions
    numbered.  Only one count per partition is gathered.
    """
    fixed = cut(df.orderBy(*[F.expr(o) for o in order_by]) if order_by else df)
    # The id is the partition number shifted by 33 bits plus the position in the partition.
    numbered = fixed.withColumn("__mono", F.monotonically_increasing_id()).withColumn("__part", F.expr("shiftright(__mono, 33)"))
    before = "sum(__n) OVER (ORDER BY __part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    counts = numbered.groupBy("__part").agg(F.expr("count(1) AS __n"))
    # One row per partition of the input: small by construction.
    starts = F.broadcast(counts.selectExpr("__part", f"coalesce({before}, 0) AS __start"))
    place = F.expr(f"__start + (__mono & {(1 << 33) - 1}L)")
    return numbered.join(starts, "__part").withColumn(name, place).drop("__part", "__mono", "__start")


def sums_before(df: DataFrame, order_by: Sequence[str], sums: Mapping[str, str]) -> DataFrame:
    """``df`` with, under each name, the sum of an expression over all rows before this one in order.

    A range sort deals the rows out, so that many rows of one key are split; sums inside a partition are running
    sums, and one row per partition carries the rest.  The sorted rows are checkpointed.
    """
    fixed = cut(df.orderBy(*[F.expr(o) for o in order_by]))
    numbered = fixed.withColumn("__mono", F.monotonically_increasing_id()).withColumn("__part", F.expr("shiftright(__mono, 33)"))
    totals = numbered.groupBy("__part").agg(*[F.expr(f"sum({x}) AS {ref('__' + name)}") for name, x in sums.items()])
    over = "OVER ({}ORDER BY {} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    # One row per partition of the input: small by construction.
    starts = F.broadcast(totals.selectExpr("__part AS __of", *[f"coalesce(sum({ref('__' + n)}) {over.format('', '__part')}, 0) AS {ref('__' + n)}" for n in sums]))
    inside = numbered.selectExpr("*", *[f"coalesce(sum({x}) {over.format('PARTITION BY __part ', '__mono')}, 0) AS {ref(n)}" for n, x in sums.items()])
    found = inside.join(starts, F.expr("__part = __of"))
    return found.withColumns({n: F.expr(f"{ref(n)} + {ref('__' + n)}") for n in sums}).drop("__mono", "__part", "__of", *[f"__{n}" for n in sums])
