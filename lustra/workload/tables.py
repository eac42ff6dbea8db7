"""Input tables, and the people table with known issues derived from ``customer``.

The expressions are plain SQL that Spark and other engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATA = ("id", "name", "age", "email", "phone", "salary", "hire_date", "department", "is_active")
ROW_ID = ("k", "copy_no")

BASE = (
    "c_custkey AS k",
    "1000 + c_custkey AS id",
    "CASE c_custkey % 4 WHEN 0 THEN 'Ada' WHEN 1 THEN 'Bela' WHEN 2 THEN 'Chen' ELSE 'Dora' END || ' ' || "
    "CASE c_custkey % 5 WHEN 0 THEN 'Adams' WHEN 1 THEN 'Brown' WHEN 2 THEN 'Kim' WHEN 3 THEN 'Lee' ELSE 'White' END AS name",
    "24 + c_custkey % 35 AS age",
    "'user' || CAST(c_custkey AS STRING) || '@example.com' AS email",
    "lpad(CAST(200 + c_custkey % 700 AS STRING), 3, '0') || '-' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || '-' || "
    "lpad(CAST((c_custkey * 7919) % 10000 AS STRING), 4, '0') AS phone",
    "55000 + (c_custkey * 7919) % 125000 AS salary",
    "CAST(2015 + c_custkey % 9 AS STRING) AS yy",
    "lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0') AS mm",
    "lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') AS dd",
    "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Engineering' WHEN 'BUILDING' THEN 'Finance' WHEN 'FURNITURE' THEN 'Sales' "
    "WHEN 'HOUSEHOLD' THEN 'HR' ELSE 'Operations' END AS department",
    "CASE WHEN c_custkey % 3 = 0 THEN 'false' ELSE 'true' END AS is_active",
)
TRUTH = (
    "CAST(id AS STRING) AS id", "name", "CAST(age AS STRING) AS age", "email", "phone",
    "CAST(salary AS STRING) AS salary", "yy || '-' || mm || '-' || dd AS hire_date", "department", "is_active",
)
DIRTY = (
    "k",
    "CAST(id AS STRING) AS id",
    "CASE WHEN k % 19 = 0 THEN upper(name) WHEN k % 23 = 0 THEN lower(name) ELSE name END AS name",
    "CASE WHEN k % 7 = 0 THEN NULL WHEN k % 13 = 0 THEN '' WHEN k % 17 = 0 THEN 'thirty' "
    "WHEN k % 29 = 0 THEN CAST(age AS STRING) || '.0' WHEN k % 31 = 0 THEN '999' ELSE CAST(age AS STRING) END AS age",
    "CASE WHEN k % 11 = 0 THEN NULL WHEN k % 37 = 0 THEN 'user' || CAST(k AS STRING) || '.example.com' ELSE email END AS email",
    "CASE WHEN k % 41 = 0 THEN NULL WHEN k % 10 = 3 THEN replace(phone, '-', '') "
    "WHEN k % 10 = 6 THEN replace(phone, '-', ' ') ELSE phone END AS phone",
    "CASE WHEN k % 43 = 0 THEN '' WHEN k % 47 = 0 THEN '-50000' ELSE CAST(salary AS STRING) END AS salary",
    "CASE k % 8 WHEN 1 THEN yy||'/'||mm||'/'||dd WHEN 3 THEN dd||'-'||mm||'-'||yy "
    "WHEN 5 THEN mm||'/'||dd||'/'||yy ELSE yy||'-'||mm||'-'||dd END AS hire_date",
    "CASE WHEN k % 9 = 0 AND department = 'Engineering' THEN 'Eng' WHEN k % 9 = 0 AND department = 'HR' THEN 'hr' "
    "ELSE department END AS department",
    "CASE WHEN k % 53 = 0 THEN 'yes' WHEN k % 59 = 0 THEN '0' ELSE is_active END AS is_active",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*BASE)


def people_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base(spark, sf_dir).selectExpr(*TRUTH)


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty rows with ``(k, copy_no)`` as row id: 0 original, 1 exact copy, 2 near copy."""
    rows = _base(spark, sf_dir).selectExpr(*DIRTY)
    copies = "concat(array(0), if(k % 20 = 0, array(1), array()), if(k % 50 = 25, array(2), array()))"
    out = rows.withColumn("copy_no", F.explode(F.expr(copies)))
    jr = F.when(F.col("copy_no") == 2, F.concat("name", F.lit(" Jr"))).otherwise(F.col("name"))
    return out.withColumn("name", jr).select(*ROW_ID, *DATA)
