"""Readers of the domain's files on small files, good ones and bad ones."""

import struct

import pytest

from gradeloom.sources import files


def written(tmp_path, text, name="x.csv"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_roster_aliases_and_precedence(spark, tmp_path):
    path = written(tmp_path, "Roll Number,roll,Student Name,Degree,Contact,Room\n,24001, Ann  Lee ,MT,ann@x.org,\nphd1,,Bo,,bo@x.org,7\n, , , , , \n")
    got = {r.roll_no: r for r in files.read_roster(spark, path).collect()}
    assert set(got) == {"MT24001", "PHD1"}
    assert (got["MT24001"].name, got["MT24001"].email, got["MT24001"].program, got["MT24001"].extra) == ("Ann Lee", "ann@x.org", "MTECH", {"Contact": "ann@x.org"})
    assert got["PHD1"].extra == {"Contact": "bo@x.org", "Room": "7"}


@pytest.mark.parametrize("text", ["roll_no,email\n1,a@b.c\n1,d@e.f\n", "roll_no,name\n1,Ann\n", "roll_no,a,b\n1,a@b.c,d@e.f\n", "name,email\nAnn,a@b.c\n", "roll_no,email\n", "roll_no,email\n,a@b.c\n"])
def test_bad_rosters(spark, tmp_path, text):
    with pytest.raises(ValueError):
        files.read_roster(spark, written(tmp_path, text))


def test_answer_key(spark, tmp_path):
    path = written(tmp_path, "Question,Correct,mark\n1, b ,\n2,canceled,3\n3,C,0\n")
    assert [tuple(r) for r in files.read_answer_key(spark, path, 1.5).orderBy("q_no").collect()] == [(1, "B", 1.5, False), (2, "CANCELED", 3.0, True), (3, "C", 0.0, True)]
    for text in ("q_no,answer\nx,A\n", "q_no,answer\n1,\n", "q_no,answer\n1,A\n1,B\n", "q_no,answer,marks\n1,A,many\n", "q_no\n1\n"):
        with pytest.raises(ValueError):
            files.read_answer_key(spark, written(tmp_path, text, "y.csv"))


def test_rubric(spark, tmp_path):
    path = written(tmp_path, "q,Prompt,Guidelines,sample_answer,marks,hint\n4,Why?,look,because,2.5,h\n5,,g,,,\n")
    got = {r.q_no: r for r in files.read_rubric(spark, path).collect()}
    assert got[4].max_marks == 2.5 and got[4].extra == {"hint": "h"} and got[5].rubric == "g" and got[5].max_marks is None
    for text in ("q_no,rubric\n1,\n", "q_no,rubric,marks\n1,a,0\n", "q_no,rubric\n1,a\n1,b\n", "q_no,rubric\nx,a\n"):
        with pytest.raises(ValueError):
            files.read_rubric(spark, written(tmp_path, text, "y.csv"))


def test_page_counts():
    assert files.pages_of("a.pdf", b"<< /Type /Pages /Count 2 >> << /Type /Page >> <</Type/Page/X 1>>") == 2
    assert files.pages_of("a.png", b"\x89PNG") == 1
    frame = lambda following: struct.pack("<H", 0) + struct.pack("<I", following)
    assert files.pages_of("a.tif", b"II*\0" + struct.pack("<I", 8) + frame(0)) == 1
    for name, data in (("a.pdf", b"/Encrypt /Type /Page"), ("a.pdf", b"no pages"), ("a.tif", b"II*\0" + struct.pack("<I", 8) + frame(14) + frame(0))):
        with pytest.raises(ValueError):
            files.pages_of(name, data)


def test_missing_scans_are_an_error(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(ValueError):
        files.list_scans(spark, str(tmp_path))


def test_broken_state_is_an_error(spark, tmp_path):
    path = written(tmp_path, '{"exam_id": "a", "students": [', "s.json")
    with pytest.raises(Exception):
        files.read_state(spark, path, "exam_id string").collect()


def test_pages_in_object_streams_and_of_later_versions():
    import zlib

    inner = [b"<< /Type /Page /Parent 1 0 R >>", b"<< /Type /Pages /Count 2 >>", b"<< /Type/Page /X (endless) >>"]
    places, at = [], 0
    for number, x in enumerate(inner, 5):
        places.append(b"%d %d" % (number, at))
        at += len(x) + 1
    table = b" ".join(places) + b" "
    packed = zlib.compress(table + b" ".join(inner))
    stream = lambda more, body: b"9 0 obj << /Type /ObjStm /N 3 /First %d %s /Length %d >> stream\r\n%s\nendstream endobj\n" % (len(table), more, len(body), body)
    head = b"%PDF-1.5\n1 0 obj << /Type /Catalog >> endobj\n"
    assert files.pages_of("a.pdf", head + stream(b"/Filter /FlateDecode", packed)) == 2
    assert files.pages_of("scan", head + stream(b"", table + b" ".join(inner))) == 2
    # object 5 is replaced by a later one that is no page, 7 by another page
    later = b"5 0 obj << /Type /Font >> endobj 7 0 obj << /Type /Page /New true >> endobj"
    assert files.pages_of("a.pdf", head + stream(b"/Filter /FlateDecode", packed) + later) == 1
    # page objects within other streams are contents
    assert files.pages_of("a.pdf", head + b"3 0 obj << /Type /Page >> endobj 4 0 obj << /Length 15 >> stream\n/Type /Page zz\nendstream endobj") == 1
