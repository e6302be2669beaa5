"""Manifests of raw files: size, extension, digest, suspicious content."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator, Sequence

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.patterns import SUSPICIOUS

# Accepted extensions, their mime types, what else counts as that type, and characters a name must not have.
EXTENSIONS = [".csv", ".xlsx", ".xls", ".pdf"]
MIME = {
    ".csv": ["text/csv", "text/plain", "application/csv"],
    ".xlsx": ["application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/zip"],
    ".xls": ["application/vnd.ms-excel", "application/msexcel"],
    ".pdf": ["application/pdf"],
}
BAD_NAME_CHARACTERS = r'[<>:"|?*\\/]'
MAX_FILE_SIZE = 100 * 1024 * 1024
BLOCK = 4 << 20  # bytes read at once
GROUP = 128 << 20  # bytes of the files of one task
OPEN_COST = 1 << 20  # bytes that opening a file counts for


def suspicious_patterns(text: Column) -> Column:
    """Patterns that occur anywhere in the whole text, in fixed order."""
    lowered = F.lower(text)
    found = F.array(*[F.when(lowered.contains(p), F.lit(p)) for p in SUSPICIOUS])
    return F.filter(found, lambda p: p.isNotNull())


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))


def mime_compatible(ext: Column, mime: Column) -> Column:
    """True when the detected type fits the extension (unknown extensions fit nothing)."""
    fits = F.lit(False)
    for e, allowed in MIME.items():
        fits = fits | ((ext == e) & mime.isin(allowed))
    return fits


def content_manifest(df: DataFrame, content: str, keep: Sequence[str] = ()) -> DataFrame:
    """Size, SHA-256 and suspicious patterns of a text or binary column."""
    found = suspicious_patterns(F.col(content).cast("string"))
    return df.select(
        *keep, F.octet_length(content).cast("bigint").alias("size"), F.sha2(F.col(content), 256).alias("sha256"),
        F.array_join(found, ",").alias("patterns"), (F.size(found) > 0).alias("suspicious"),
    )


def name_errors(name: Column, size: Column, max_size: int = MAX_FILE_SIZE) -> Column:
    """Why a file is refused: name characters, extension, emptiness, size."""
    rules = [
        (F.length(name) == 0, "no_name"),
        (name.rlike(BAD_NAME_CHARACTERS), "bad_characters"),
        (~extension(name).isin(EXTENSIONS), "bad_extension"),
        (size <= 0, "empty"),
        (size > max_size, "too_large"),
    ]
    return F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in rules]), lambda t: t.isNotNull())


def _opened(path: str):
    """The file system and the path in it that pyarrow opens ``path`` with."""
    where = path if "://" in path else os.path.abspath(re.sub(r"^file:", "", path))
    return fs.FileSystem.from_uri(where)


class _Group(InputPartition):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        self.files = files


class _ManifestReader(DataSourceReader):
    def __init__(self, path: str, block: int, group: int) -> None:
        self.path, self.block, self.group = path, block, group

    def partitions(self) -> list[InputPartition]:
        """Files in groups of about ``group`` bytes, one file at least. Empty files are listed too."""
        system, base = _opened(self.path)
        info = system.get_file_info(base)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(base, recursive=True))
        groups, size = [[]], 0
        for f in sorted((f for f in found if f.type == fs.FileType.File), key=lambda f: f.path):
            if groups[-1] and size + f.size > self.group:
                groups.append([])
                size = 0
            groups[-1].append((f.path, f.size))
            size += f.size + OPEN_COST
        return [_Group(g) for g in groups]

    def read(self, partition: _Group) -> Iterator[tuple]:
        system, _ = _opened(self.path)
        longest = max(map(len, SUSPICIOUS)) - 1
        for path, _ in partition.files:
            digest, found, tail, size = hashlib.sha256(), set(), b"", 0
            with system.open_input_stream(path) as stream:
                while block := stream.read(self.block):
                    digest.update(block)
                    size += len(block)
                    text = (tail + block).lower()  # patterns may lie across blocks
                    found |= {p for p in SUSPICIOUS if p.encode() in text}
                    tail = text[-longest:]
            yield path, size, digest.hexdigest(), [p for p in SUSPICIOUS if p in found]


class FileManifestSource(DataSource):
    """``path, length, sha256, found`` of every file below the option ``path``, read in blocks: no file is too large for a task."""

    @classmethod
    def name(cls) -> str:
        return "file_manifest"

    def schema(self) -> str:
        return "path string, length bigint, sha256 string, found array<string>"

    def reader(self, schema) -> DataSourceReader:
        return _ManifestReader(self.options["path"], int(self.options.get("block", BLOCK)), int(self.options.get("group", GROUP)))


def file_manifest(spark: SparkSession, path: str, max_size: int = MAX_FILE_SIZE, block: int = BLOCK) -> DataFrame:
    """One row per file under ``path``, files of zero bytes included, of any size.

    Every file is hashed and searched in blocks of ``block`` bytes; letters A-Z count as a-z in the search.
    ``max_size`` only adds the error ``too_large``. The driver lists the files, as every file source does;
    ``path`` is one that pyarrow opens (local, hdfs, s3, gs).
    """
    spark.dataSource.register(FileManifestSource)
    raw = spark.read.format("file_manifest").option("block", block).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    errors = name_errors(name, F.col("length"), max_size)
    suspicious = F.size("found") > 0
    return raw.select(
        "path", name.alias("name"), extension(name).alias("extension"), F.col("length").alias("size"), "sha256", F.array_join("found", ",").alias("patterns"),
        suspicious.alias("suspicious"), F.array_join(errors, ",").alias("errors"), ((F.size(errors) == 0) & ~suspicious).alias("valid"),
    )
