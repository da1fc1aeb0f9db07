"""Word documents as a format of Spark: spark.read.format("exam_docx") and df.write.format("exam_docx").

    spark.dataSource.register(DocxFormat)
    lines = spark.read.format("exam_docx").load(folder)

Reading gives path, line_no, html, text, error: a row for each paragraph and table, and for a file that breaks a limit or is no
Word document one row with its error. Each partition reads a group of files of about group_bytes (an option), where each
file counts as open_bytes more (an option), so that many small files are dealt to many tasks. Writing
takes rows path, line_no, text and puts one document for each path into the folder; all rows of a path must be in one
partition, in order (see write_documents()). Files go through pyarrow's file systems, under names that tell their attempt until
the whole write succeeds.
"""

from __future__ import annotations

import html
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from marktide.sources import docx

GROUP_BYTES, OPEN_BYTES = 64 << 20, 256 << 10
_DOCUMENT = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{}</w:body></w:document>'
_TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELATIONS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'


def _opened(path: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def document(paragraphs: list[str]) -> bytes:
    """A Word document of plain paragraphs."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{html.escape(x, quote=False)}</w:t></w:r></w:p>' for x in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELATIONS), ("word/document.xml", _DOCUMENT.format(body))):
            z.writestr(name, text)
    return out.getvalue()


@dataclass
class Group(InputPartition):
    paths: list[str]


class DocxReader(DataSourceReader):
    def __init__(self, folder: str, group_bytes: int, open_bytes: int = OPEN_BYTES):
        self.folder, self.group_bytes, self.open_bytes = folder, group_bytes, open_bytes

    def partitions(self) -> list[Group]:
        import pyarrow.fs as pafs

        fs, place = _opened(self.folder)
        groups, size = [[]], 0
        for f in sorted(fs.get_file_info(pafs.FileSelector(place)), key=lambda f: f.path):
            if f.type == pafs.FileType.File and f.path.lower().endswith(".docx"):
                cost = f.size + self.open_bytes
                if groups[-1] and size + cost > self.group_bytes:
                    groups.append([])
                    size = 0
                groups[-1].append(f.path)
                size += cost
        return [Group(g) for g in groups]

    def read(self, partition: Group) -> Iterator[tuple]:
        fs, _ = _opened(self.folder)
        for path in partition.paths:
            try:
                if fs.get_file_info(path).size > docx.MAX_BYTES:
                    raise ValueError("the file is too large")
                with fs.open_input_file(path) as f:
                    found = docx.lines(f.read())
            except ValueError as e:
                yield path, 0, None, None, str(e)
                continue
            for k, (shown, text) in enumerate(found):
                yield path, k, shown, text, None


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class DocxWriter(DataSourceWriter):
    def __init__(self, folder: str, fields: list[str]):
        self.folder, self.at = folder, [fields.index(c) for c in ("path", "text")]

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        fs, place = _opened(self.folder)
        fs.create_dir(place, recursive=True)
        made: list[tuple[str, str]] = []
        path, held = None, []

        def put() -> None:
            if path is not None:
                name = f"_{path}-{TaskContext.get().taskAttemptId()}"
                with fs.open_output_stream(f"{place}/{name}", compression=None) as f:
                    f.write(document(held))
                made.append((name, f"{path}.docx"))

        for r in rows:
            if r[self.at[0]] != path:
                put()
                path, held = r[self.at[0]], []
            held.append(r[self.at[1]] or "")
        put()
        return Written(made)

    def commit(self, messages: list[Written | None]) -> None:
        fs, place = _opened(self.folder)
        for m in messages:
            for a, b in m.names if m else ():
                fs.move(f"{place}/{a}", f"{place}/{b}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, place = _opened(self.folder)
        for m in messages:
            for a, _ in m.names if m else ():
                fs.delete_file(f"{place}/{a}")


class DocxFormat(DataSource):
    @classmethod
    def name(cls) -> str:
        return "exam_docx"

    def schema(self) -> str:
        return "path string, line_no int, html string, text string, error string"

    def reader(self, schema) -> DocxReader:
        return DocxReader(self.options["path"], int(self.options.get("group_bytes", GROUP_BYTES)), int(self.options.get("open_bytes", OPEN_BYTES)))

    def writer(self, schema, overwrite: bool) -> DocxWriter:
        return DocxWriter(self.options["path"], schema.fieldNames())


def write_documents(lines: DataFrame, folder: str) -> None:
    """lines (path, line_no, text) as one document for each path, a name without its ending."""
    lines.sparkSession.dataSource.register(DocxFormat)
    rows = lines.where("path IS NOT NULL").select("path", "line_no", "text").repartition("path").sortWithinPartitions("path", "line_no")
    rows.write.format("exam_docx").mode("append").save(folder)


def read_documents(spark, folder: str, group_bytes: int = GROUP_BYTES) -> DataFrame:
    spark.dataSource.register(DocxFormat)
    return spark.read.format("exam_docx").option("group_bytes", str(group_bytes)).load(folder)
