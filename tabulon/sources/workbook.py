"""A folder of ``.xlsx`` workbooks as one table: first sheet, header row, parallel over files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.session import ship_package
from tabulon.sources.infer import infer

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column_number(reference: str) -> int:
    n = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        n = n * 26 + ord(letter) - 64
    return n - 1


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{MAIN}sheets")
    wanted = sheets[0].get(RELATION)
    for relation in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if relation.get("Id") == wanted:
            target = relation.get("Target").lstrip("/")
            return target if target.startswith("xl/") else f"xl/{target}"
    raise ValueError("workbook has no first sheet")


# Fixed values of the file format: built-in number formats that show dates or times
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
EPOCH, EPOCH_1904 = datetime(1899, 12, 30), datetime(1904, 1, 1)


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles that show a number as a date: by a built-in format, or one of the book's with day, month or year signs."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = set()
    for f in root.iter(f"{MAIN}numFmt"):
        code = re.sub(r'"[^"]*"|\\[.]|\[[^\]]*\]', "", f.get("formatCode", "")).lower()
        if re.search(r"[ymdhs]", code):
            own.add(int(f.get("numFmtId")))
    formats = root.find(f"{MAIN}cellXfs")
    ids = [int(x.get("numFmtId", 0)) for x in formats] if formats is not None else []
    return {i for i, n in enumerate(ids) if n in DATE_FORMATS or n in own}


def _date_text(serial: str, epoch: datetime) -> str:
    """ISO date of a day number, with the time if there is one."""
    try:
        moment = epoch + timedelta(days=float(serial))
    except (ValueError, OverflowError):
        return serial
    moment = (moment + timedelta(microseconds=500)).replace(microsecond=0)
    return moment.date().isoformat() if moment.time() == datetime.min.time() else moment.isoformat(" ")


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """The cells of the first sheet as text, row by row."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter(f"{MAIN}t")))
        dates = _date_styles(book)
        about = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{MAIN}workbookPr")
        epoch = EPOCH_1904 if about is not None and about.get("date1904") in ("1", "true") else EPOCH
        with book.open(_first_sheet(book)) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{MAIN}row":
                    continue
                cells: list[str | None] = []
                for cell in row:
                    place = _column_number(cell.get("r")) if cell.get("r") else len(cells)
                    cells.extend([None] * (place - len(cells)))
                    kind, value = cell.get("t"), cell.findtext(f"{MAIN}v")
                    if kind == "s" and value is not None:
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
                    elif kind == "b" and value is not None:
                        value = "True" if value == "1" else "False"
                    elif kind in (None, "n") and value is not None and int(cell.get("s", 0)) in dates:
                        value = _date_text(value, epoch)
                    cells.append(value)
                yield cells
                row.clear()


def _named(header: list[str | None]) -> list[str]:
    return [h or f"column_{i}" for i, h in enumerate(header)]


def _all_headers(files: DataFrame) -> list[str]:
    """Column names of all workbooks; tasks read the headers, the driver gets each name once per task."""

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first: dict[str, tuple[str, int]] = {}
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                for i, name in enumerate(_named(next(sheet_rows(content), []))):
                    first[name] = min(first.get(name, (path, i)), (path, i))
        yield pd.DataFrame([(n, p, i) for n, (p, i) in first.items()], columns=["name", "path", "place"])

    found = files.select("path", "content").mapInPandas(headers, "name string, path string, place int")
    best = found.groupBy("name").agg(F.min(F.struct("path", "place")).alias("at"))
    return [r["name"] for r in best.orderBy("at.path", "at.place").collect()]


def read_workbooks(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All workbooks below ``path`` in one table with the columns of all headers, in the order of the first file that has them.

    Each file is parsed by one task, in parallel over files.  Without ``schema``
    the types are inferred over all rows.
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path)
    if schema is not None:
        names = schema.fieldNames()
    else:
        names = _all_headers(files)
    if not names:
        return spark.createDataFrame([], T.StructType([]))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = sheet_rows(content)
                header = _named(next(rows, []))
                order = [header.index(n) if n in header else None for n in names]
                chunk: list[list[str | None]] = []
                for row in rows:
                    chunk.append([row[i] if i is not None and i < len(row) else None for i in order])
                    if len(chunk) == 10_000:
                        yield pd.DataFrame(chunk, columns=names, dtype=object)
                        chunk = []
                if chunk:
                    yield pd.DataFrame(chunk, columns=names, dtype=object)

    text_schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    text = files.select("content").mapInPandas(parse, text_schema)
    if schema is None:
        return infer(text)
    return text.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields])
