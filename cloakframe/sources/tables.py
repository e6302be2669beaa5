"""Reading, writing, and first checks of tables."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns
from ..functions import schema as roles
from ..operators.stats import COLUMNS_PER_JOB, null_count, single_row
from ..session import materialize
from . import csv_files

MAX_ROWS = 1_000_000
MAX_COLUMNS = 1_000


def null_tokens_to_null(c: Column) -> Column:
    return F.when(~F.trim(c).isin(patterns.NULL_TOKENS), c)


def normalize_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text cells holding a null token become null."""
    chosen = [c for c in (columns or df.columns) if c in roles.text_columns(df)]
    return df.withColumns({c: null_tokens_to_null(F.col(c)) for c in chosen})


# Candidate types of a text column, narrowest first.
_CANDIDATES: list[tuple[str, T.DataType]] = [("bigint", T.LongType()), ("double", T.DoubleType()), ("timestamp_ntz", T.TimestampNTZType()), ("boolean", T.BooleanType())]


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, T.DataType]:
    """Narrowest type that every non-null text value fits, from one aggregate over the whole table."""
    chosen = [c for c in (columns or df.columns) if c in roles.text_columns(df)]
    exprs: dict[str, Column] = {}
    for i, c in enumerate(chosen):
        exprs[f"n{i}"] = F.count(c)
        for name, _ in _CANDIDATES:
            exprs[f"{name}{i}"] = F.count(F.expr(f"try_cast(`{c}` AS {name})"))
    row = single_row(df, exprs) if exprs else {}
    out: dict[str, T.DataType] = {}
    for i, c in enumerate(chosen):
        fits = [t for name, t in _CANDIDATES if row[f"n{i}"] and row[f"{name}{i}"] == row[f"n{i}"]]
        out[c] = fits[0] if fits else T.StringType()
    return out


@dataclass(frozen=True)
class Dialect:
    delimiter: str
    encoding: str
    multi_line: bool  # a quoted value spans lines somewhere


def csv_dialect(spark: SparkSession, path: str) -> Dialect:
    """The dialect of most splits of a CSV folder (:func:`csv_files.csv_splits` decides it per file)."""
    found = csv_files.kinds(csv_files.csv_splits(spark, path))
    return Dialect(found[0]["delimiter"], found[0]["encoding"], found[0]["multi_line"]) if found else Dialect(",", "utf-8", False)


def sniff_csv(spark: SparkSession, path: str) -> tuple[str, str]:
    """(delimiter, encoding) of :func:`csv_dialect`."""
    found = csv_dialect(spark, path)
    return found.delimiter, found.encoding


_CORRUPT = csv_files.CORRUPT


def read_csv_records(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None, multi_line: bool | None = None, assemble: bool | None = None) -> DataFrame:
    """Every record as text columns; ``_corrupt_record`` holds those that do not fit the header, and is null otherwise.

    Delimiter, encoding and line feeds within quotes are decided per file where they are not given. Files of one
    dialect are read by Spark's reader; files of several dialects, and files of several splits with records
    that span lines, are put together from lines (``assemble`` forces or forbids it), so such files stay splittable.
    An encoding that is given and neither UTF-8 nor Latin-1 goes to Spark's reader.
    """
    if delimiter is None or encoding is None or multi_line is None:
        given = {"delimiter": delimiter, "encoding": encoding and encoding.lower(), "multi_line": multi_line}
        splits = csv_files.csv_splits(spark, path).withColumns({k: F.lit(v) for k, v in given.items() if v is not None})
        splits = materialize(splits, "csv")
        found = csv_files.kinds(splits)
        lines = encoding is None or encoding.lower() in ("utf-8", "iso-8859-1")
        if assemble is None:
            assemble = len(found) > 1 or any(k["multi_line"] and k["last"] > 0 for k in found)
        if assemble and lines and any(k["first"] for k in found):
            return csv_files.parse_records(csv_files.split_records(spark, path, splits, found), found)
        first = found[0] if found else {"delimiter": ",", "encoding": "utf-8", "multi_line": False}
        delimiter, encoding = delimiter or first["delimiter"], encoding or first["encoding"]
        multi_line = any(k["multi_line"] for k in found) if multi_line is None else multi_line
    options = {"header": True, "sep": delimiter, "encoding": encoding, "escape": '"', "multiLine": multi_line, "lineSep": "\n" if multi_line else None}
    reader = spark.read.options(**{k: v for k, v in options.items() if v is not None})
    header = reader.csv(path).schema
    schema = T.StructType([*[T.StructField(f.name, T.StringType()) for f in header], T.StructField(_CORRUPT, T.StringType())])
    # without pruning, the columns asked for never decide which records count as corrupt
    return reader.options(mode="PERMISSIVE", columnNameOfCorruptRecord=_CORRUPT, columnPruning=False).schema(schema).csv(path)


def scan_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    delimiter: str | None = None,
    encoding: str | None = None,
    infer: bool = True,
    multi_line: bool | None = None,
) -> DataFrame:
    """CSV with a header; the dialect is found from the whole text, null tokens become null.

    Records that do not fit the header are left out with a warning that counts them;
    :func:`read_csv_records` shows them. Pass ``schema`` on large inputs: it saves the type-inference pass.
    """
    records = read_csv_records(spark, path, delimiter, encoding, multi_line)
    columns = [c for c in records.columns if c != _CORRUPT]
    wrong = records.agg(F.count(_CORRUPT).alias("n"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(columns)]).first()["n"]
    if wrong:
        warnings.warn(f"{wrong} records of {path} do not fit the header and are left out", stacklevel=2)
    raw = normalize_nulls(records.where(F.col(_CORRUPT).isNull()).select(*columns))
    if schema is not None:
        types = {f.name: f.dataType for f in schema if f.name in raw.columns}
    else:
        types = infer_types(raw) if infer else {}
    return raw.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types and types[c] != T.StringType() else F.col(c) for c in raw.columns])


def scan_json(spark: SparkSession, path: str, schema: T.StructType | None = None, record_array: bool = False) -> DataFrame:
    """JSON lines (splittable), or one array of records per file with ``record_array``."""
    reader = spark.read.option("multiLine", record_array)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def write_csv(df: DataFrame, path: str, delimiter: str = ",", mode: str = "overwrite") -> None:
    """Quoted where needed, so that :func:`scan_csv` reads every value back (carriage returns next to line feeds excepted)."""
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode(mode).options(header=True, sep=delimiter, escape='"', **keep).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One record per line, in as many files as there are partitions."""
    df.write.mode(mode).json(path)


def save_dataset(df: DataFrame, root: str, file_id: str) -> str:
    """Keep a processed table under its file id; saving again replaces it."""
    path = f"{root}/file_id={file_id}"
    df.write.mode("overwrite").parquet(path)
    return path


def load_dataset(spark: SparkSession, root: str, file_id: str) -> DataFrame | None:
    """The table saved under a file id, or None."""
    try:
        return spark.read.parquet(f"{root}/file_id={file_id}")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def load_gate(df: DataFrame, max_rows: int | None = None, max_columns: int | None = MAX_COLUMNS) -> DataFrame:
    """``(severity, check, value)``: no rows or columns, limits exceeded; empty columns, sparsity above 0.9.

    ``max_rows`` is off by default; ``MAX_ROWS`` is the limit meant for interactive uploads.
    """
    width = len(df.columns)
    counted = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"n{i}") for i, c in enumerate(df.columns)])
    filled = sum((F.col(f"n{i}") for i in range(width)), F.lit(0))
    empty = sum(((F.col(f"n{i}") == 0).cast("int") for i in range(width)), F.lit(0))
    sparsity = F.lit(1.0) - F.try_divide(filled.cast("double"), F.col("rows") * width)
    has_rows = F.col("rows") > 0
    rules = [
        (~has_rows, "error", "no_rows", F.col("rows")),
        (F.lit(width == 0), "error", "no_columns", F.lit(width)),
        (F.lit(max_rows is not None) & (F.col("rows") > F.lit(max_rows or 0)), "error", "too_many_rows", F.col("rows")),
        (F.lit(max_columns is not None and width > (max_columns or 0)), "error", "too_many_columns", F.lit(width)),
        (has_rows & (empty > 0), "warning", "empty_columns", empty),
        (has_rows & (sparsity > 0.9), "warning", "sparse", sparsity),
    ]
    cells = [
        F.when(cond, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("check"), v.cast("double").alias("value")))
        for cond, s, c, v in rules
    ]
    return counted.select(F.inline(F.filter(F.array(*cells), lambda x: x.isNotNull())))


def table_metadata(df: DataFrame) -> DataFrame:
    """``(column, position, type, role, rows, missing)`` per column."""
    out = None
    for start in range(0, len(df.columns), COLUMNS_PER_JOB):
        fields = list(enumerate(df.schema))[start : start + COLUMNS_PER_JOB]
        wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[null_count(f.name).alias(f"m{i}") for i, f in fields])
        cells = []
        for i, f in fields:
            role = "numeric" if roles.is_numeric(f.dataType) else "datetime" if roles.is_temporal(f.dataType) else "categorical"
            cells.append(
                F.struct(
                    F.lit(f.name).alias("column"), F.lit(i).alias("position"), F.lit(roles.role_name(f.dataType)).alias("type"),
                    F.lit(role).alias("role"), F.col("_rows").alias("rows"), F.coalesce(F.col(f"m{i}"), F.lit(0)).alias("missing"),
                )
            )
        part = wide.select(F.inline(F.array(*cells)))
        out = part if out is None else out.unionByName(part)
    return out


def redacted_preview(df: DataFrame, key: Sequence[str], n: int = 10) -> DataFrame:
    """The first ``n`` (at most 100) rows by key, text of tell-tale columns hidden."""
    hidden = [c for c in roles.text_columns(df) if any(k in c.lower() for k in patterns.PREVIEW_NAMES)]
    top = df.orderBy(*key).limit(min(n, 100))
    return top.withColumns({c: F.lit("[REDACTED]") for c in hidden}) if hidden else top
