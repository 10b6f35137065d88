"""A workbook of many rows is cut into a bounded number of parts, and what lies before a part's rows is not looked into."""

import io

from gradeloom.sources import sheets


def test_parts_are_bounded_and_hold_all_rows(spark, tmp_path):
    made = [["Key", "Name"]] + [[str(i), f"<row r=\"{i}\"> & {i}"] for i in range(20_000)]
    (tmp_path / "many.xlsx").write_bytes(sheets.workbook(made))
    df = sheets.read_workbooks(spark, [f"{tmp_path}/many.xlsx"], rows=10)
    assert df.rdd.getNumPartitions() <= sheets.PARTS
    got = {r.row: (r.cells["Key"], r.cells["Name"]) for r in df.collect()}
    assert got == {n: tuple(r) for n, r in enumerate(made, 1) if n > 1}


def test_rows_before_are_passed_over(monkeypatch):
    class Counted:
        """A pattern that counts how often it is tried."""

        tried = 0

        def match(self, *args):
            Counted.tried += 1
            return found.match(*args)

    found = sheets.ROW
    monkeypatch.setattr(sheets, "ROW", Counted())
    monkeypatch.setattr(sheets, "CHUNK", 1 << 14)
    book = sheets.Workbook(io.BytesIO(sheets.workbook([[str(i), "v" * (i % 9)] for i in range(1, 5001)])))
    assert [(n, r[0]) for n, r in book.rows(4990, 4995, [])] == [(n, str(n)) for n in range(4990, 4996)]
    assert Counted.tried < 1000


def test_rows_without_numbers(monkeypatch):
    monkeypatch.setattr(sheets, "CHUNK", 64)
    import zipfile

    out = io.BytesIO()
    rows = "".join(f'<row{f" r={chr(34)}{i}{chr(34)}" if i % 3 == 0 else (" spans=" + chr(34) + "1:1" + chr(34) if i % 3 == 1 else "")}><c><v>{i}</v></c></row>' for i in range(1, 61))
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{sheets.NS[1:-1]}"><sheetData>{rows}</sheetData></worksheet>')
    for first, last in ((1, 60), (7, 9), (30, 31), (59, None)):
        assert [(n, r) for n, r in sheets.Workbook(out).rows(first, last, [])] == [(n, [str(n)]) for n in range(first, (last or 60) + 1)]
