"""Writers: JSON lines, CSV with a byte order mark, sheets, reports, metrics."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenmill.functions.text import sheet_cell
from lumenmill.operators.export import markdown


def json_lines(df: DataFrame, path: str) -> None:
    """Distributed JSON lines; nulls are written."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def csv_parts(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("emptyValue", "").csv(path, header=True)


def text_file(spark: SparkSession, path: str, pieces: Iterable[str], mark: bool = False) -> None:
    """One file in any file system that Spark knows (a path without a scheme is the default one's)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        held = ["\ufeff"] if mark else []
        size = 0
        for piece in pieces:
            held.append(piece)
            size += len(piece)
            if size > 1 << 20:
                out.write(bytearray("".join(held).encode()))
                held, size = [], 0
        out.write(bytearray("".join(held).encode()))
    finally:
        out.close()


def csv_file(df: DataFrame, path: str) -> None:
    """One file with header and byte order mark; rows stream through the driver."""

    def lines():
        buffer = io.StringIO(newline="")
        out = csv.writer(buffer)
        out.writerow(df.columns)
        for row in df.toLocalIterator():
            out.writerow(["" if v is None else v for v in row])
            yield buffer.getvalue()
            buffer.seek(0)
            buffer.truncate()
        yield buffer.getvalue()

    text_file(df.sparkSession, path, lines(), mark=True)


def cells(df: DataFrame) -> DataFrame:
    """Columns as a sheet takes them: text cleaned and cut, nested values as JSON."""

    def cell(f: T.StructField):
        nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        return sheet_cell(F.to_json(f.name) if nested else F.col(f.name).cast("string")).alias(f.name)

    return df.select(*[cell(f) for f in df.schema.fields])


def sheet(df: DataFrame, path: str) -> None:
    """An .xlsx file where openpyxl is installed, else the same cells as CSV beside it."""
    try:
        from openpyxl import Workbook
    except ImportError:
        csv_file(cells(df), re.sub(r"\.xlsx$", "", path) + ".csv")
        return
    book = Workbook(write_only=True)
    page = book.create_sheet()
    page.append(df.columns)
    for row in cells(df).toLocalIterator():
        page.append(list(row))
    book.save(path)


def metrics(spark: SparkSession, values: dict, path: str, more: dict | None = None) -> None:
    text_file(spark, path, [json.dumps({**values, **(more or {})}, ensure_ascii=False, indent=2)])


def report(sections: dict[str, DataFrame], path: str) -> None:
    """A Markdown report with a table for each section."""
    frames = list(sections.items())
    text_file(frames[0][1].sparkSession, path, (("\n" if i else "") + markdown(df, title) for i, (title, df) in enumerate(frames)))


def prefixed(path: str, prefix: str = "", variant: str = "") -> str:
    """folder/[prefix_]name[_variant].suffix"""
    folder, _, name = path.rpartition("/")
    stem, dot, suffix = name.rpartition(".")
    stem = stem if dot else suffix
    suffix = f".{suffix}" if dot else ""
    return f"{folder}/" * bool(folder) + f"{prefix}_" * bool(prefix) + stem + f"_{variant}" * bool(variant) + suffix


def scheme_outputs(labels: DataFrame, keywords: DataFrame, samples: DataFrame, folder: str, variant: str = "") -> None:
    """The files of a labelling: labels, submission, keywords, samples."""
    at = lambda name: prefixed(f"{folder}/{name}", variant=variant)
    json_lines(labels.select("record_id", "cluster_id", "category"), at("labels.jsonl"))
    csv_file(labels.select("record_id", "cluster_id"), at("submit.csv"))
    csv_file(keywords, at("keywords.csv"))
    sheet(samples, at("samples.xlsx"))
