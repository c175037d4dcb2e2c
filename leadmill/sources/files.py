"""CSV and Parquet sources and sinks."""

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from leadmill.schemas import TABLES

# Cell texts that mean "no value" in a CSV file.
CSV_NULLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def select_available(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The known columns that exist, in the given order."""
    return df.select(*[F.col(f"`{c}`") for c in columns if c in df.columns])


def file_position() -> Column:
    """Orderable position of a row in its file.

    Ids rise within a file block, and blocks rise within a file, so the order does
    not depend on how Spark packs blocks into tasks.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_raw_csv(
    spark: SparkSession,
    path: str | list[str],
    columns: Sequence[str] | None = None,
    *,
    row_no: bool = False,
    multi_line: bool = True,
) -> DataFrame:
    """CSV with a header, every column as text; no type inference, so no extra pass.

    Quoted cells may have line breaks, so a file is one task's work; `multi_line=False` is for
    files known to have none, which are then split. Files may differ in the order of columns:
    each is read by its own header, and a file that lacks a column gives NULL for it.
    """
    def reader():
        return (
            spark.read.option("header", True).option("escape", '"')
            .option("multiLine", multi_line).option("inferSchema", False)
        )

    # Files with the same header are read together; only headers come to the driver.
    alike: dict[str, list[str]] = {}
    for file in _files(spark, path):
        alike.setdefault(_header(spark, file), []).append(file)
    headers: dict[tuple, list[str]] = {}
    for files in alike.values():
        headers.setdefault(tuple(reader().csv(files[0]).columns), []).extend(files)
    every = list(dict.fromkeys(c for header in headers for c in header))
    raw = None
    for header, files in headers.items():
        part = reader().csv(files).select(
            "*", *([file_position().alias("row_no")] if row_no else [])
        )
        part = part.select(
            *[F.col(f"`{c}`") if c in header else F.lit(None).cast("string").alias(c) for c in every],
            *(["row_no"] if row_no else []),
        )
        raw = part if raw is None else raw.unionByName(part)
    names = [c for c in (columns or every) if c in every]
    cells = [F.when(~F.col(f"`{c}`").isin(CSV_NULLS), F.col(f"`{c}`")).alias(c) for c in names]
    return raw.select(*cells, *(["row_no"] if row_no else []))


def _files(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The files of raw exports, also those in subfolders: a few, unlike those of a table.

    Files and folders whose names begin with a dot or an underscore are none of an export.
    """
    found = []
    for p in [path] if isinstance(path, str) else path:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        todo = [s.getPath() for s in fs.globStatus(at) or []]
        files = []
        while todo:
            here = todo.pop()
            if not fs.getFileStatus(here).isDirectory():
                files.append(here.toString())
                continue
            inside = [s.getPath() for s in fs.listStatus(here)]
            todo += [q for q in inside if q.getName()[0] not in "._"]
        if not files:
            raise FileNotFoundError(p)
        found += sorted(files)
    return found


def _header(spark: SparkSession, file: str) -> str:
    """The first line of a file, up to a line end outside quotes."""
    conf = spark._jsc.hadoopConfiguration()
    hadoop, java = spark._jvm.org.apache.hadoop, spark._jvm.java.io
    at = hadoop.fs.Path(file)
    stream = at.getFileSystem(conf).open(at)
    codec = hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
    if codec is not None:
        stream = codec.createInputStream(stream)
    lines = java.BufferedReader(java.InputStreamReader(stream, "UTF-8"))
    text = ""
    while (line := lines.readLine()) is not None:
        text += line + "\n"
        if text.strip() and text.count('"') % 2 == 0:
            break
    lines.close()
    return text


def load_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def load_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The five model tables, each a Parquet folder with its declared schema."""
    return {
        name: load_table(spark, f"{folder}/{name}", schema) for name, schema in TABLES.items()
    }


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns, order and types of the schema; absent columns become NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def append_table(df: DataFrame, path: str, partition_by: Sequence[str] | None = None) -> None:
    """Append rows; a table that exists keeps its layout."""
    stored = layout(df.sparkSession, path)
    if partition_by is not None and stored is not None and list(partition_by) != stored:
        raise ValueError(f"{path} is partitioned by {stored}")
    by = stored if stored is not None else list(partition_by or [])
    df.write.mode("append").partitionBy(*by).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def layout(spark: SparkSession, path: str) -> list[str] | None:
    """The columns that a stored table is partitioned by; None if there is no table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    columns, empty = [], True
    while True:
        names = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName()[0] not in "._"]
        empty = empty and not names
        folders = [p for p in names if "=" in p.getName()]
        if not folders:
            return None if empty else columns
        at = folders[0]
        columns.append(at.getName().split("=")[0])


def reload_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace the whole table. The new rows must not be read from the table itself.

    They are written beside it first, and take its place when they are complete: a write that
    fails leaves the old table. Between two renames there is no table for a moment; tables that
    must change together, or be read meanwhile, belong into a store (`sources.store`).
    """
    target = _plain(path)
    for root in _scanned(df):
        if (_plain(root) + "/").startswith(target + "/") or (target + "/").startswith(_plain(root) + "/"):
            raise ValueError(f"{path} is also an input; write to a new folder instead")
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path
    at = place(path.rstrip("/"))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    mark = uuid.uuid4().hex
    new, old = (place(at.getParent(), f".{at.getName()}-{what}-{mark}") for what in ("new", "old"))
    try:
        df.write.partitionBy(*partition_by).parquet(new.toString())
        had = fs.exists(at)
        if had and not fs.rename(at, old):
            raise OSError(f"{path} cannot be moved")
        if not fs.rename(new, at):
            if had:
                fs.rename(old, at)
            raise OSError(f"{path} cannot be replaced")
        fs.delete(old, True)
    finally:
        fs.delete(new, True)


def _plain(path: str) -> str:
    """A path without scheme and doubled slashes, to compare it."""
    tail = path.split(":", 1)[1] if ":" in path.split("/", 1)[0] else path
    return "/" + "/".join(p for p in tail.split("/") if p)


def _scanned(df: DataFrame) -> list[str]:
    """Root paths of the file scans of a plan: one or a few per scan, however many files."""
    roots, todo = [], [df._jdf.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if node.getClass().getSimpleName() == "LogicalRelation":
            relation = node.relation()
            if relation.getClass().getSimpleName() == "HadoopFsRelation":
                paths = relation.location().rootPaths()
                roots += [paths.apply(i).toString() for i in range(paths.size())]
    return roots
