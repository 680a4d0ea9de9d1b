"""XLSX sheets as a batch data source: format ``xlsx_cells`` gives (file, row, col, value) of one sheet of each workbook of a path.

Workbooks are zip archives of XML; nothing but the standard library is needed. Each workbook is one task.
"""

from __future__ import annotations

import glob
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as Et

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheet_names(path: str) -> dict[str, str]:
    """Sheet names and the archive members that hold them."""
    with zipfile.ZipFile(path) as z:
        target = {r.get("Id"): r.get("Target") for r in Et.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = Et.fromstring(z.read("xl/workbook.xml"))
        return {s.get("name"): "xl/" + target[s.get(_R)].lstrip("/").removeprefix("xl/") for s in book.iter(f"{_M}sheet")}


def column_number(letters: str) -> int:
    """A is 1, Z 26, AA 27."""
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def cells(path: str, sheet: str) -> Iterator[tuple[int, int, str]]:
    """(row, column, text) of the cells of a sheet that hold anything, from 1."""
    member = sheet_names(path)[sheet]
    with zipfile.ZipFile(path) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_M}t")) for si in Et.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_M}si")]
        with z.open(member) as f:
            for _, c in Et.iterparse(f):
                if c.tag != f"{_M}c":
                    continue
                at = re.match(r"([A-Z]+)(\d+)", c.get("r", ""))
                v = c.find(f"{_M}v")
                text = "".join(t.text or "" for t in c.iter(f"{_M}t")) if c.get("t") == "inlineStr" else (v.text if v is not None else None)
                if at and text is not None:
                    yield int(at[2]), column_number(at[1]), shared[int(text)] if c.get("t") == "s" else text
                c.clear()


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.sheet, path = options["sheet"], options["path"]
        self.files = sorted(glob.glob(os.path.join(path, "*.xlsx")) if os.path.isdir(path) else glob.glob(path))

    def partitions(self) -> list[_Part]:
        return [_Part(f) for f in self.files]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for r, c, v in cells(partition.path, self.sheet):
            yield os.path.basename(partition.path), r, c, v


class XlsxCells(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx_cells"

    def schema(self) -> str:
        return "file string, row int, col int, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_cells(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """(file, row, col, value) of the named sheet of the workbooks of a path, folder or glob."""
    spark.dataSource.register(XlsxCells)
    return spark.read.format("xlsx_cells").option("sheet", sheet).option("path", path).load()


def hourly_rows(sheet: DataFrame, date_label: str = "Date", hour_label: str = "Hour") -> DataFrame:
    """(file, col, label, date, hour, timestep, value) of a sheet with a header row that holds a date and an hour column.

    Label is the header of each value column; time steps count the rows below the header from 0. Sheets without such a header give
    nothing.
    """
    clean = sheet.withColumn("_v", F.lower(F.trim("value")))
    d = clean.where(F.col("_v") == date_label.lower()).groupBy("file", "row").agg(F.min("col").alias("date_col"))
    h = clean.where(F.col("_v") == hour_label.lower()).groupBy("file", "row").agg(F.min("col").alias("hour_col"))
    head = d.join(h, ["file", "row"]).groupBy("file").agg(F.min_by(F.struct("row", "date_col", "hour_col"), "row").alias("h")).select("file", F.col("h.row").alias("head"), "h.date_col", "h.hour_col")
    body = sheet.join(head, "file").where("row > head")
    key = lambda c, name: body.where(F.col("col") == F.col(c)).select("file", "row", F.col("value").alias(name))
    labels = sheet.join(head, "file").where("row = head").select("file", "col", F.trim("value").alias("label"))
    values = body.where("col <> date_col and col <> hour_col").select("file", "row", "col", (F.col("row") - F.col("head") - 1).alias("timestep"), "value")
    out = values.join(key("date_col", "date"), ["file", "row"]).join(key("hour_col", "hour"), ["file", "row"], "left").join(labels, ["file", "col"])
    return out.select("file", "col", "label", "date", F.col("hour").try_cast("int").alias("hour"), "timestep", F.col("value").try_cast("double").alias("value"))
