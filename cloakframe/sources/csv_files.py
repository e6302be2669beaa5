"""Dialect of every CSV file of a folder, and records of files that are split inside quoted values.

All figures come from splits, keyed by (file, first byte), so a large file is read by many tasks:
a line is a function of the state before it (outside or inside quotes), a split is the
composition of its lines, and a running composition over a file's splits tells the state at the
start of each. Only lines of records with line feeds are grouped; a record is one cell.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DELIMITERS = [",", ";", "\t", "|"]
CORRUPT = "_corrupt_record"
_SPLIT = ["file", "block"]


def _lines(spark: SparkSession, path: str, feeds_only: bool = False) -> DataFrame:
    """``value, file, block, at``: lines with their file, the first byte of their split and their order in it."""
    reader = spark.read.option("lineSep", "\n") if feeds_only else spark.read
    return reader.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def _number(text: Column, letter: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))


def csv_splits(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, first_block, head, rows, delimiter, encoding, multi_line``, one row per split, the dialect decided per file.

    The delimiter is the one whose number outside quotes agrees most often with the file's first
    line, the one with more of them on ties. One line that is not UTF-8 makes a file Latin-1; one
    line with an odd number of quotes makes its records span lines. Blank lines count for neither.
    """
    marks = [f"d{i}" for i in range(len(DELIMITERS))]
    bare = F.when(F.contains("value", F.lit('"')), F.regexp_replace("value", '"[^"]*"', "")).otherwise(F.col("value"))
    filled = F.length(F.trim("value")) > 0
    lines = _lines(spark, path).select(*_SPLIT, "at", "value", filled.alias("filled"), *[_number(bare, d).alias(m) for d, m in zip(DELIMITERS, marks, strict=True)])
    shapes = lines.groupBy(*_SPLIT, "filled", *marks).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~F.is_valid_utf8("value")).alias("invalid"), F.count_if(_number(F.col("value"), '"') % 2 == 1).alias("odd"))
    heads = lines.where("filled").groupBy("file").agg(F.min_by(F.struct("value", *marks), F.struct("block", "at")).alias("head"))
    joined = shapes.join(heads, "file", "left")
    agreed = [F.sum(F.when(F.col("filled") & (F.col(m) == F.col(f"head.{m}")), F.col("rows")).otherwise(0)).alias(f"a{m}") for m in marks]
    files = joined.groupBy("file").agg(
        F.first("head").alias("head"), F.sum("rows").alias("rows"), F.min(F.when(F.col("filled"), F.col("block"))).alias("first_block"),
        F.sum("invalid").alias("invalid"), F.sum("odd").alias("odd"), *agreed)
    rated = F.array(*[F.when(F.col(f"head.{m}") > 0, F.struct(F.col(f"a{m}").alias("a"), F.col(f"head.{m}").alias("n"), F.lit(-i).alias("i"))) for i, m in enumerate(marks)])
    best = F.coalesce(F.element_at(F.array(*map(F.lit, DELIMITERS)), F.lit(1) - F.array_max(rated)["i"]), F.lit(","))
    dialects = files.select(
        "file", "first_block", F.col("head.value").alias("head"), "rows", best.alias("delimiter"),
        F.when(F.col("invalid") > 0, "iso-8859-1").otherwise("utf-8").alias("encoding"), (F.col("odd") > 0).alias("multi_line"))
    return shapes.select(*_SPLIT).distinct().join(dialects, "file")


def kinds(splits: DataFrame) -> list:
    """Every dialect of ``splits`` once (four delimiters, two encodings, spanning lines or not), that of most splits first."""
    found = splits.groupBy("delimiter", "encoding", "multi_line").agg(
        F.count(F.lit(1)).alias("splits"), F.max("block").alias("last"), F.min(F.when(F.col("head").isNotNull(), F.struct("file", "first_block", "head"))).alias("first"))
    return sorted(found.collect(), key=lambda k: (-k["splits"], k["delimiter"], k["encoding"], k["multi_line"]))


def _open_pattern(delimiter: str) -> str:
    """A line whose last field begins with a quote that the line does not close; quotes count at the start of a field only."""
    quoted = '"[^"]*+(?:""[^"]*+)*+'
    d = "\\" + delimiter if delimiter == "|" else delimiter
    return rf'\A(?:(?:{quoted}"[^{d}]*+|[^"{d}][^{d}]*+)?+{d})*+{quoted}\z'


def _running(lines: DataFrame, order: Window) -> DataFrame:
    """``lines`` with ``r0, r1``: the state after each row when its group begins outside (0) or inside (1) quotes.

    ``f0, f1`` are the states after the row alone. The composition up to a row is
    the last constant row before it, turned over by the flips since.
    """
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    flip = ((F.col("f0") == 1) & (F.col("f1") == 0)).cast("int")
    counted = lines.withColumn("_flips", F.sum(flip).over(upto))
    fixed = F.when(F.col("f0") == F.col("f1"), F.struct(F.col("f0").alias("state"), F.col("_flips").alias("flips")))
    known = counted.withColumn("_fixed", F.last(fixed, ignorenulls=True).over(upto))
    after = lambda start: F.coalesce((F.col("_fixed.state") + F.col("_flips") - F.col("_fixed.flips")) % 2, (F.lit(start) + F.col("_flips")) % 2).cast("int")
    return known.withColumn("r0", after(0)).withColumn("r1", after(1)).drop("_flips", "_fixed")


def header_names(fields: list[str]) -> list[str]:
    """Column names of a header's fields: empty ones by position, repeated ones with their position."""
    lowered = [f.lower() for f in fields]
    return [f"_c{i}" if not f else f"{f}{i}" if lowered.count(f.lower()) > 1 else f for i, f in enumerate(fields)]


def split_records(spark: SparkSession, path: str, splits: DataFrame, found: list) -> DataFrame:
    """``file, header, record, delimiter, encoding`` of every record of the files that ``splits`` describes."""
    multi = any(k["multi_line"] for k in found)
    lines = _lines(spark, path, multi).join(splits.select(*_SPLIT, "first_block", "delimiter", "encoding", "multi_line"), _SPLIT)

    def opens(text: Column) -> Column:
        return F.coalesce(*[F.when(F.col("delimiter") == d, text.rlike(_open_pattern(d)).cast("int")) for d in sorted({k["delimiter"] for k in found})])

    quote = F.contains("value", F.lit('"'))
    lines = lines.withColumn("f0", F.when(F.col("multi_line") & quote, opens(F.col("value"))).otherwise(0)).withColumn(
        "f1", F.when(~F.col("multi_line"), 0).when(quote, opens(F.concat(F.lit('"'), "value"))).otherwise(1))
    order = Window.partitionBy(*_SPLIT).orderBy("at")
    ran = _running(lines, order)
    # the state at the start of each split, and where a record that it continues began
    ends = ran.groupBy(*_SPLIT).agg(
        F.max_by("r0", "at").alias("f0"), F.max_by("r1", "at").alias("f1"), F.count_if(F.col("r0") == 0).alias("n0"), F.count_if(F.col("r1") == 0).alias("n1"))
    along = Window.partitionBy("file").orderBy("block")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    starts = _running(ends, along).withColumn("start", F.coalesce(F.lag("r0").over(along), F.lit(0)))
    starts = starts.withColumn("closed", F.when(F.col("start") == 0, F.col("n0")).otherwise(F.col("n1")))
    tail = F.last(F.when(F.col("closed") > 0, F.struct("block", F.col("closed").alias("record"))), ignorenulls=True).over(before)
    begun = F.coalesce(tail, F.struct(F.min("block").over(before).alias("block"), F.lit(0).cast("long").alias("record")))
    bounds = starts.select(*_SPLIT, "start", F.when(F.col("start") == 1, begun).alias("begun"))
    stated = ran.join(bounds, _SPLIT).withColumn("after", F.when(F.col("start") == 0, F.col("r0")).otherwise(F.col("r1")))
    stated = stated.withColumn("before", F.coalesce(F.lag("after").over(order), F.col("start")))
    closed = F.coalesce(F.sum(F.when(F.col("after") == 0, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    stated = stated.withColumn("number", closed).withColumn("alone", (F.col("before") == 0) & (F.col("after") == 0))
    stated = stated.where(~(F.col("alone") & (F.length(F.trim(F.rtrim(F.col("value"), F.lit("\r")))) == 0)))  # blank lines between records
    owner = F.when((F.col("number") == 0) & (F.col("start") == 1), F.col("begun")).otherwise(F.struct("block", F.col("number").alias("record")))
    first = F.min(F.when(~((F.col("number") == 0) & (F.col("start") == 1)), F.col("number"))).over(Window.partitionBy(*_SPLIT))
    stated = stated.withColumn("header", (F.col("block") == F.col("first_block")) & (F.col("number") == first) & ~((F.col("number") == 0) & (F.col("start") == 1)))
    kept = ["file", "header", "record", "delimiter", "encoding"]
    single = stated.where("alone").withColumn("record", F.col("value")).select(*kept)
    if not multi:
        return single
    spans = stated.where("not alone").groupBy("file", owner.alias("owner")).agg(
        F.max("header").alias("header"), F.first("delimiter").alias("delimiter"), F.first("encoding").alias("encoding"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"]), "\n").alias("record"))
    return single.unionByName(spans.select(*kept))


def parse_records(records: DataFrame, found: list) -> DataFrame:
    """The fields of ``records`` as text columns named by the first file's header, and ``_corrupt_record``.

    Columns go by position. A header is the first record of its file.
    """
    plain = records.withColumn("record", F.rtrim("record", F.lit("\r")))
    plain = plain.withColumn("record", F.coalesce(*[
        F.when(F.col("encoding") == e, F.col("record") if e == "utf-8" else F.decode(F.col("record").cast("binary"), e)) for e in sorted({k["encoding"] for k in found})]))
    heads = [(k["first"]["file"], k["first"]["head"], k["delimiter"], k["encoding"]) for k in found if k["first"]]
    _, text, delimiter, encoding = min(heads)
    if encoding != "utf-8" or text.count('"') % 2:  # not whole or not decoded yet
        one = plain.where("header").agg(F.min_by(F.struct("record", "delimiter"), "file").alias("h")).first()["h"]
        text, delimiter = one["record"], one["delimiter"]
    names = header_names(next(csv.reader([text.lstrip("﻿").rstrip("\r")], delimiter=delimiter)))
    ddl = ", ".join(f"`{c.replace('`', '``')}` STRING" for c in [*names, CORRUPT])
    options = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    cells = F.coalesce(*[F.when(F.col("delimiter") == d, F.from_csv("record", ddl, {**options, "sep": d})) for d in sorted({k["delimiter"] for k in found})])
    return plain.where("not header").select(cells.alias("c")).select("c.*")
