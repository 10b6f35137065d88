"""Workbooks read by ranges of rows: all rows, whatever the ranges, as one task reads them."""

import io
import zipfile

import pytest

from gradeloom.sources import files, sheets


def put(tmp_path, name, data):
    (tmp_path / name).write_bytes(data)
    return f"{tmp_path}/{name}"


@pytest.mark.parametrize("rows", [7, 100, 100_000])
def test_all_rows_by_any_ranges(spark, tmp_path, rows):
    made = [["Key", "Name ", "", "Note"]] + [[str(i), f"n & <{i}>", "x", "" if i % 3 else "  é "] for i in range(450)]
    made[20] = ["", "", "", ""]
    path = put(tmp_path, "a.xlsx", sheets.workbook(made))
    df = sheets.read_workbooks(spark, [path], rows)
    assert df.rdd.getNumPartitions() == max(1, -(-451 // rows))
    got = {r.row: r.cells for r in df.collect()}
    assert got == {n: {"Key": r[0], "Name": r[1], "Note": r[3]} for n, r in enumerate(made, 1) if n > 1 and any(r)}
    whole = files.sheet_rows(open(path, "rb").read())
    assert len(got) == len(whole) - 1


def test_many_rows_by_several_tasks(spark, tmp_path):
    path = put(tmp_path, "big.xlsx", sheets.workbook([["k", "v"]] + [[str(i), "v" * (i % 50)] for i in range(60_000)]))
    df = sheets.read_workbooks(spark, [path], 10_000)
    assert df.rdd.getNumPartitions() == 7
    assert df.selectExpr("count(*) AS n", "count(distinct cells['k']) AS k", "sum(length(cells['v'])) AS v").first() == (60_000, 60_000, sum(i % 50 for i in range(60_000)))


def sheet(body, shared=None, dimension=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet2.xml", "<worksheet/>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{sheets.NS[1:-1]}">{dimension}<sheetData>{body}</sheetData></worksheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{sheets.NS[1:-1]}">' + "".join(f"<si><t>{x}</t></si>" for x in shared) + "</sst>")
    return out.getvalue()


def test_kinds_of_cells_gaps_and_headers(spark, tmp_path):
    body = '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row><row r="3"/><row r="5" spans="1:3"><c r="A5"><v>1.5</v></c><c r="C5" t="b"><v>1</v></c><c r="AB5"><v>9</v></c></row>'
    path = put(tmp_path, "b.xlsx", sheet(body, ["Roll", "Done"]))
    assert [(r.row, r.cells) for r in sheets.read_workbooks(spark, [path]).collect()] == [(5, {"Roll": "1.5", "Done": "TRUE"})]
    empty = put(tmp_path, "c.xlsx", sheet(""))
    assert sheets.read_workbooks(spark, [empty, path]).count() == 1
    twice = put(tmp_path, "d.xlsx", sheets.workbook([["Roll No", "roll_no"], ["1", "2"]]))
    with pytest.raises(Exception, match="repeated headers"):
        sheets.read_workbooks(spark, [twice]).collect()
    assert sheets.column_of("A1") == 0 and sheets.column_of("AB12") == 27
