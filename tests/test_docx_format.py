"""Word files as a format: written, read in groups, with errors as rows; merged cells and nested tables."""

from __future__ import annotations

from test_exams import document, p

from marktide.sources import docx, docx_format


def test_round_trip_in_groups(spark, tmp_path):
    rows = [(f"d{k}", j, f"line {j} of {k} <&> é" if j else None) for k in range(20) for j in range(5)] + [(None, 0, "lost"), ("d3", 5, "  x  y ")]
    docx_format.write_documents(spark.createDataFrame(rows, "path string, line_no int, text string").repartition(7), f"file://{tmp_path}/out")
    got = docx_format.read_documents(spark, f"file://{tmp_path}/out", 2000)
    assert got.rdd.getNumPartitions() > 3
    texts = {}
    for r in got.orderBy("line_no").collect():
        assert r.error is None
        texts.setdefault(r.path.rpartition("/")[2], []).append(r.text)
    want = {f"d{k}.docx": [f"line {j} of {k} <&> é" for j in range(1, 5)] for k in range(20)}
    want["d3.docx"].append("x  y")
    assert texts == want
    assert sorted(x.name for x in (tmp_path / "out").iterdir() if not x.name.startswith(".")) == sorted(want)


def test_small_files_are_dealt_to_many_tasks(spark, tmp_path):
    """Without a cost of each file, 600 documents of a line were read by one task."""
    rows = spark.range(600).selectExpr("concat('d', id) AS path", "0 AS line_no", "concat('line ', id) AS text")
    docx_format.write_documents(rows, f"file://{tmp_path}/out")
    got = docx_format.read_documents(spark, f"file://{tmp_path}/out")
    assert got.rdd.getNumPartitions() == 3
    assert {(r.path.rpartition("/")[2], r.text) for r in got.collect()} == {(f"d{k}.docx", f"line {k}") for k in range(600)}


def test_bad_files_are_rows(spark, tmp_path, monkeypatch):
    (tmp_path / "a.docx").write_bytes(document(p("good")))
    (tmp_path / "b.docx").write_bytes(b"no archive")
    (tmp_path / "c.DOCX").write_bytes(document(""))
    (tmp_path / "notes.txt").write_text("x")
    got = docx_format.read_documents(spark, f"file://{tmp_path}")
    assert sorted((r.path.rpartition("/")[2], r.text, r.error) for r in got.collect()) == [("a.docx", "good", None), ("b.docx", None, "not a Word document")]
    (tmp_path / "none").mkdir()
    assert docx_format.read_documents(spark, f"file://{tmp_path}/none").collect() == []


def test_merged_cells_stand_at_all_places():
    cell = lambda x, properties="": f"<w:tc>{properties and f'<w:tcPr>{properties}</w:tcPr>'}{p(x)}</w:tc>"
    inner = f"<w:tbl><w:tr>{cell('inner')}</w:tr></w:tbl>"
    table = (
        f"<w:tbl><w:tr>{cell('ab', '<w:gridSpan w:val=\"2\"/>')}{cell('c', '<w:vMerge w:val=\"restart\"/>')}</w:tr>"
        f"<w:tr>{cell('1')}<w:tc>{p('2')}{inner}</w:tc>{cell('', '<w:vMerge/>')}</w:tr><w:tr>{cell('x')}</w:tr></w:tbl>"
    )
    div = lambda x: f"<div>{x}</div>" if x else ""
    row = lambda tag, *xs: "<tr>" + "".join(f"<{tag}>{div(x)}</{tag}>" for x in xs) + "</tr>"
    assert docx.lines(document(table)) == [("<table><tbody>" + row("th", "ab", "ab", "c") + row("td", "1", "2", "c") + row("td", "x", "", "") + "</tbody></table>", "[TABLE]")]
