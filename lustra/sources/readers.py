"""File readers with uniform missing-value handling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lustra.functions.columns import is_fractional, is_text, lits, number, ref
from lustra.functions.frames import with_exprs
from lustra.operators.casting import infer_types
from lustra.session import stage

# Texts read as missing.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def null_tokens(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Missing-value texts and NaN become null."""
    cells = {}
    for f in df.schema.fields:
        if is_text(f.dataType):
            cells[f.name] = f"CASE WHEN {ref(f.name)} NOT IN ({lits(tokens)}) THEN {ref(f.name)} END"
        elif is_fractional(f.dataType):
            cells[f.name] = f"CAST({number(df, f.name)} AS {f.dataType.simpleString()})"
    return with_exprs(df, cells)


def normalize_columns(df: DataFrame) -> DataFrame:
    """Strip column names; names that become equal are an error."""
    names = [str(c).strip() for c in df.columns]
    clash = sorted({n for n in names if names.count(n) > 1})
    if clash:
        raise ValueError(f"column names collide after stripping: {clash}")
    return df.toDF(*names)


def _delimited(spark: SparkSession, path: str | list[str], sep: str, infer: bool, schema: str | T.StructType | None) -> DataFrame:
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
    if schema is not None:
        return normalize_columns(null_tokens(reader.schema(schema).csv(path)))
    df = normalize_columns(null_tokens(reader.csv(path)))
    return infer_types(df) if infer else df


def read_csv(spark: SparkSession, path: str | list[str], infer: bool = True, schema: str | T.StructType | None = None) -> DataFrame:
    """CSV with a header.  Types are inferred over the whole input, after missing-value texts
    are taken out; give a schema (or ``infer=False`` for text columns) to save that scan."""
    return _delimited(spark, path, ",", infer, schema)


def read_tsv(spark: SparkSession, path: str | list[str], infer: bool = True, schema: str | T.StructType | None = None) -> DataFrame:
    return _delimited(spark, path, "\t", infer, schema)


def read_json(spark: SparkSession, path: str | list[str], lines: bool = False, schema: str | T.StructType | None = None) -> DataFrame:
    """JSON documents holding arrays of records, or one record per line.

    A multi-line document is parsed by a single task; large data belongs in line form.
    """
    reader = spark.read.option("multiLine", not lines)
    if schema is not None:
        reader = reader.schema(schema)
    return normalize_columns(reader.json(path))


@dataclass(frozen=True)
class Checked:
    """Records read, and those that could not be: ``(file, block_start, record)``, for the quarantine."""

    rows: DataFrame
    malformed: DataFrame


def read_checked(
    spark: SparkSession, path: str | list[str], kind: str = "csv", schema: str | T.StructType | None = None, header: bool = True, infer: bool = True,
) -> Checked:
    """Read ``csv``, ``tsv``, ``jsonl`` or ``json`` without failing on broken records and without losing them.

    Malformed are records with too few or too many fields, values that do not fit a given ``schema``, and JSON that
    cannot be parsed, each with its text, its file and where the part of the file it was read in begins.  The input is
    parsed once: a table staged by whether a record was broken serves both sides.  Column names and missing
    values are treated as by the other readers, types are inferred unless a schema is given.
    """
    if kind not in ("csv", "tsv", "json", "jsonl"):
        raise ValueError(f"cannot check records of {kind!r}")
    reader = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BROKEN)
    if kind in ("csv", "tsv"):
        sep = "\t" if kind == "tsv" else ","
        reader = reader.option("header", header).option("sep", sep).option("quote", '"').option("escape", '"')
        given = spark.read.options(header=header, sep=sep, quote='"', escape='"').csv(path).schema if schema is None else schema
    else:
        reader = reader.option("multiLine", kind == "json")
        given = spark.read.option("multiLine", kind == "json").option("columnNameOfCorruptRecord", _BROKEN).json(path).schema if schema is None else schema
    fields = [f for f in (T.StructType.fromDDL(given) if isinstance(given, str) else given).fields if f.name != _BROKEN]
    reader = reader.schema(T.StructType([*fields, T.StructField(_BROKEN, T.StringType())]))
    raw = reader.csv(path) if kind in ("csv", "tsv") else reader.json(path)
    names = [ref(f.name) for f in fields]
    parsed = raw.selectExpr(*names, _BROKEN, "_metadata.file_path AS __file", "_metadata.file_block_start AS __block")
    parsed = stage(parsed.withColumn("__kind", F.expr(f"IF({_BROKEN} IS NULL, 0, 1)")), "parsed", "__kind")
    rows = normalize_columns(null_tokens(parsed.filter("__kind = 0").selectExpr(*names)))
    if infer and schema is None and kind in ("csv", "tsv"):
        rows = infer_types(rows)
    return Checked(rows, parsed.filter("__kind = 1").selectExpr("__file AS file", "__block AS block_start", f"{_BROKEN} AS record"))


_BROKEN = "__record"


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return normalize_columns(spark.read.parquet(*([path] if isinstance(path, str) else path)))


READERS = {
    ".csv": read_csv,
    ".tsv": read_tsv,
    ".json": read_json,
    ".jsonl": lambda spark, path: read_json(spark, path, lines=True),
    ".parquet": read_parquet,
}


def read_any(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Pick the reader by the lower-cased extension; ``kind`` names it for extension-less folders."""
    extension = (kind if kind else PurePosixPath(path.rstrip("/")).suffix).lower()
    if extension not in READERS:
        raise ValueError(f"unsupported format {extension!r}; supported: {sorted(READERS)}")
    return READERS[extension](spark, path)
