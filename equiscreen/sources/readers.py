"""Sources to DataFrames.

Nothing is inferred: text columns, cast later.  A row's place in its source is ``input_ordinal``, from 1, where order
matters; it is made from the file's order without bringing rows to one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.orderings import settled, small


def with_ordinal(df: DataFrame, name: str = "input_ordinal") -> DataFrame:
    """Rows numbered from 1 in the frame's order: counts by partition first, then each row its place in its own.

    The rows are settled once, as a number within a partition holds only for one run of it.
    """
    rows = settled(df.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    starts = starts.select("__part", "__first", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__start"))
    return rows.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__at") - F.col("__first") + 1).drop("__part", "__at", "__first", "__start")


def csv_text(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = ",", encoding: str = "utf-8") -> DataFrame:
    """All columns as text, a byte-order mark before the first name dropped; rows of the wrong width dropped."""
    names = columns or [c.lstrip("﻿").strip() for c in spark.read.option("header", True).option("sep", sep).option("encoding", encoding).csv(path).columns]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, "_corrupt_record"]])
    df = spark.read.schema(schema).options(header=True, sep=sep, encoding=encoding, mode="PERMISSIVE", enforceSchema=True).csv(path)
    return df.where(F.col("_corrupt_record").isNull() | (F.col("_corrupt_record") == "")).drop("_corrupt_record")


def csv_any_charset(spark: SparkSession, path: str, columns: list[str] | None = None, charsets: tuple[str, ...] = ("utf-8", "latin1")) -> DataFrame:
    """S3: the first charset in which no replacement character turns up, else the last."""
    for c in charsets[:-1]:
        lines = spark.read.text(path) if c == "utf-8" else spark.read.option("encoding", c).text(path)
        if lines.where(F.col("value").contains("�")).limit(1).isEmpty():
            return csv_text(spark, path, columns, encoding=c)
    return csv_text(spark, path, columns, encoding=charsets[-1])


def pipe_directory(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-delimited, the footer line dropped."""
    df = csv_text(spark, path, sep="|")
    return df.where(~F.lower(F.coalesce(F.col(f"`{df.columns[0]}`"), F.lit(""))).startswith("file creation time"))


SEPARATORS = (",", ";", "|", "\t")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0), value of every line of every file, however the files are split: counts by split, then places within it."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    lines = settled(lines)  # the splits of one reading: those of another may differ
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    starts = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    starts = starts.select("file", "block", "first", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    return lines.join(small(starts), ["file", "block"]).select("file", (F.col("start") + F.col("at") - F.col("first")).alias("line"), "value")


def cells(line: Column, sep: str) -> Column:
    """A header's cells: without quotes, blanks and a byte-order mark."""
    return F.transform(F.split(line, "\\" + sep if sep in "|.^$*+?()[]{}" else sep), lambda c: F.trim(F.regexp_replace(F.trim(c), '^\ufeff|^"|"$', "")))


def best_headers(lines: DataFrame, words: list[str], separators: tuple[str, ...] = SEPARATORS, most: int = 120, rule: str | int = "best") -> DataFrame:
    """File, line, sep, hits, names: each file's own header among its first ``most`` lines.

    ``rule``: ``best`` is the line and separator with most of ``words``, then most cells, then the first line; files with none of the words
    have no header.  ``named`` is the first line that has each of ``words`` as a cell, and line 0 where none has.  A number is that line.
    The separator is the one with most cells.
    """
    found = F.array(*[F.struct(F.lit(s).alias("sep"), cells(F.col("value"), s).alias("names")) for s in separators])
    low = F.transform("names", lambda c: F.lower(c))
    hits = sum((F.lower("value").contains(w.lower()).cast("int") for w in words), F.lit(0))
    head = lines.where(F.col("line") < most if isinstance(rule, str) else F.col("line") == rule)
    rows = head.select("file", "line", "value", F.inline(found)).withColumns({"hits": hits, "all": F.array_except(F.array(*[F.lit(w.lower()) for w in words]) if words else F.array().cast("array<string>"), low)})
    n = F.size("names")
    order = {"best": F.struct("hits", n, -F.col("line"), "sep"), "named": F.struct(F.size("all") == 0, F.when(F.size("all") == 0, -F.col("line")).otherwise(F.when(F.col("line") == 0, 0).otherwise(-1)), n, "sep")}
    best = rows.groupBy("file").agg(F.max_by(F.struct("line", "sep", "hits", "names"), order.get(rule, F.struct(n, "sep"))).alias("b")).select("file", "b.*")
    return best.where("hits > 0") if rule == "best" else best


def best_header(spark: SparkSession, path: str, words: list[str], separators: tuple[str, ...] = SEPARATORS, lines: int = 120) -> tuple[int, str]:
    """The best (line number from 0, separator) of one file."""
    found = best_headers(numbered_lines(spark, path), words, separators, lines).first()
    if found is None:
        raise ValueError(f"no header with any of {words} in the first {lines} lines of {path}")
    return found["line"], found["sep"]


def csv_with_preamble(spark: SparkSession, path: str, header: int | str = "best", words: list[str] | None = None, sep: str | None = None, lines: int = 25, file_column: str | None = None) -> DataFrame:
    """Delimited files whose headers stand on later lines, each file's on its own, under its own separator and names.

    The columns are those of all files, in the order in which they come; a file has nulls in those it lacks.  Rows with fewer cells
    than their header are dropped.  A record is one line.  Only names of columns and separators come to the driver.
    """
    every = numbered_lines(spark, path)
    heads = settled(best_headers(every, words or [], (sep,) if sep else SEPARATORS, lines, header))
    first = heads.select("file", F.posexplode("names").alias("pos", "name")).where("name <> ''").groupBy("name").agg(F.min(F.struct("file", "pos")).alias("at"))
    columns = [r["name"] for r in first.orderBy("at").collect()]
    shape = heads.agg(F.max(F.size("names")).alias("width"), F.collect_set("sep").alias("seps")).first()
    width, seps = shape["width"] or 0, sorted(shape["seps"])
    body = every.alias("l").join(small(heads.select("file", F.col("line").alias("head"), "sep", "names")), "file").where("line > head")
    made = F.when(F.lit(False), F.array().cast("array<string>"))
    fields = [f"c{i}" for i in range(width)]
    for s in seps:
        row = F.from_csv("value", ", ".join(f"{f} string" for f in fields), {"sep": s})
        made = made.when(F.col("sep") == s, F.array(*[row[f] for f in fields]))
        body = body.where((F.col("sep") != s) | (F.size(F.split("value", "\\" + s if s == "|" else s)) >= F.size("names")))
    out = body.withColumn("cells", made)
    at = lambda c: F.get("cells", F.array_position("names", c).cast("int") - 1)  # noqa: E731  a name that is not there is at -1
    found = lambda c: F.when(F.array_contains("names", c), at(c))
    return out.select(*[found(c).alias(c) for c in columns], *([F.col("file").alias(file_column)] if file_column else []))


def json_columns(spark: SparkSession, path: str) -> DataFrame:
    """``{"fields": [...], "data": [[...], ...]}`` as rows of text columns."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "fields array<string>, data array<array<string>>").alias("d"))
    fields = doc.select("d.fields").first()["fields"]
    return doc.select(F.explode("d.data").alias("r")).select(*[F.get("r", F.lit(i)).alias(c) for i, c in enumerate(fields)])


def json_records(spark: SparkSession, path: str, keys: tuple[str, ...] = ("records", "memos", "items", "data", "rows", "results")) -> DataFrame:
    """A list of records, or the list under a known key, or the first list of records there is."""
    df = spark.read.json(path, multiLine=True)
    lists = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    found = next((k for k in keys if k in lists), lists[0] if lists else None)
    return df if found is None else df.select(F.explode(found).alias("r")).select("r.*")


def json_files(spark: SparkSession, path: str, pattern: str = r"^([A-Z0-9.\-]+)_") -> DataFrame:
    """Many JSON files; ticker and time come from the file's name."""
    from ..functions.exprs import stamp_of_name

    name = F.col("_metadata.file_name")
    return spark.read.json(path, multiLine=True).select("*", name.alias("file_name"), F.regexp_extract(name, pattern, 1).alias("file_ticker"), stamp_of_name(name).alias("file_time"))


#: Files up to this size are hashed as a value of Spark's reader; larger ones, which no value holds, are read in pieces.
WHOLE_FILE, PIECE = 256 << 20, 8 << 20


def file_manifest(spark: SparkSession, path: str, whole: int = WHOLE_FILE) -> DataFrame:
    """Path, size, time, SHA-256 and the ticker that the name begins with.

    Files of over ``whole`` bytes are read as streams in the tasks, ``PIECE`` bytes at a time, by the file system that their address
    names, so no file's size is a bound and a task holds one piece.
    """
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    named = [F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    ticker = F.upper(F.regexp_extract(stem, r"^([A-Za-z0-9.\-]+)", 1)).alias("ticker")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small_ones = files.where(F.col("length") <= whole).select("path", *named, F.sha2("content", 256).alias("sha256"), ticker)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p in b.column("path").to_pylist():
                system, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", p))
                h = hashlib.sha256()
                with system.open_input_stream(at) as f:
                    while piece := f.read(PIECE):
                        h.update(piece)
                out.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.string()), b.column("ticker")], names=["path", "size", "modified", "sha256", "ticker"])

    large = files.where(F.col("length") > whole).select("path", *named, ticker).repartition("path")  # a task for a few large files
    return small_ones.unionByName(large.mapInArrow(hashed, "path string, size long, modified timestamp, sha256 string, ticker string"))


def fresh(df: DataFrame, date: str, days: int) -> DataFrame:
    """Rows at most so many days old."""
    return df.where(F.datediff(F.current_date(), F.col(date)) <= days)


def first_source(spark: SparkSession, *paths: str) -> DataFrame:
    """The first Parquet table that exists and has rows."""
    from pyspark.errors import AnalysisException

    for p in paths:
        try:
            df = spark.read.parquet(p)
        except AnalysisException:
            continue
        if not df.limit(1).isEmpty():
            return df
    raise FileNotFoundError(f"none of {paths} has rows")
