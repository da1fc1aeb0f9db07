"""Spreadsheet files of a DataFrame, written by the tasks that hold its rows."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from datetime import date, datetime
from decimal import Decimal
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Rows of a sheet: the format allows 1048576, two of which are title and header.
MAX_ROWS = 1_000_000
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
# The parts that every workbook of one sheet has.
_PARTS = {
    "[Content_Types].xml": f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def _cell(x) -> str:
    if x is None:
        return "<c/>"
    if isinstance(x, bool):
        return f'<c t="b"><v>{int(x)}</v></c>'
    if isinstance(x, int | float | Decimal):
        return f"<c><v>{x}</v></c>" if x == x and abs(x) != float("inf") else "<c/>"
    text = x.isoformat(" ") if isinstance(x, datetime) else x.isoformat() if isinstance(x, date) else str(x)
    clean = "".join(ch for ch in text if ch >= " " or ch in "\t\n\r")
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'


def _row(cells) -> bytes:
    return f"<row>{''.join(map(_cell, cells))}</row>".encode()


def _write(folder: str, title: str, sheet: str, header: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, place = pafs.FileSystem.from_uri(folder)
        rows = (list(r.values()) for b in batches for s in range(0, b.num_rows, 1000) for r in b.slice(s, 1000).to_pylist())
        more, number = next(rows, None), 0
        while more is not None:
            name = f"part-{task.partitionId():05d}-{number:03d}.xlsx"
            part, n = f"{place}/.{name}-{task.taskAttemptId()}", 0
            with fs.open_output_stream(part) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
                for path, body in _PARTS.items():
                    z.writestr(path, body)
                z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets><sheet name={quoteattr(sheet[:31])} sheetId="1" r:id="r1"/></sheets></workbook>')
                with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as out:
                    out.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode() + _row([title]) + _row(header))
                    while more is not None and n < MAX_ROWS:
                        out.write(_row(more))
                        more, n = next(rows, None), n + 1
                    out.write(b"</sheetData></worksheet>")
            fs.move(part, f"{place}/{name}")  # a task that runs again replaces the file
            yield pa.RecordBatch.from_pydict({"path": [name], "n_rows": [n]}, schema=pa.schema([("path", pa.string()), ("n_rows", pa.int64())]))
            number += 1

    return run


def write_xlsx(df: DataFrame, folder: str, title: str, sheet: str = "Report", header: list[str] | None = None) -> DataFrame:
    """Writes df as workbooks of at most MAX_ROWS rows, one or more a partition, below folder; returns path and n_rows of each.

    Order df (orderBy) to have the files in order. Null, NaN and infinite cells are empty; empty partitions write nothing.
    """
    fs, place = pafs.FileSystem.from_uri(folder)
    fs.create_dir(place, recursive=True)
    return df.mapInArrow(_write(folder, title, sheet, header or df.columns), "path string, n_rows long")
