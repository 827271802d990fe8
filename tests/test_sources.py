import io
import json
import zipfile

import pytest

from hirelake.sources import boards, files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_cvs(spark, tmp_path):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    (tmp_path / "a.md").write_text("# Name\n\nSkills", encoding="utf-8")
    (tmp_path / "b.docx").write_bytes(docx(p("Name") + p(" ") + "<w:tbl><w:tr><w:tc>" + p("x") + "</w:tc><w:tc>" + p("") + "</w:tc><w:tc>" + p("y") + "</w:tc></w:tr></w:tbl>" + p("End")))
    (tmp_path / "c.pdf").write_bytes(b"no")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.read_cvs(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "# Name\n\nSkills", "b.docx": "Name\nEnd\nx | y"}
    with pytest.raises(ValueError):
        files.read_cvs(spark, str(tmp_path / "c.pdf"))


def test_reports_and_logs(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5)], "n int, rate double")
    for _ in range(2):
        files.append_report(df, str(tmp_path / "all"))
        files.write_latest(df, str(tmp_path / "latest"))
    assert spark.read.json(str(tmp_path / "all")).count() == 2 and spark.read.json(str(tmp_path / "latest")).count() == 1
    log = spark.createDataFrame([(i, f"12:00 [{'ERROR' if i % 2 else 'INFO'}] x") for i in range(10)], "i int, line string")
    assert [r.i for r in files.log_tail(log, "i", "line", "error", 2).collect()] == [7, 9]


def test_board(spark, tmp_path):
    rows = [
        {"title": "Data Clerk", "job_url": "u1", "company": "A", "description": "<p>Hi<br>there</p>", "location": "Cork, IE", "date_posted": "2025-01-02"},
        {"title": "Night Clerk", "job_url": "u1", "company": "B", "date_posted": "2025-01-02"},
        {"title": "Clerk", "job_url": "u2", "company": "nan"},
        {"title": "Data Chef", "job_url": "u3", "company": "C", "date_posted": "2020-01-01"},
    ]
    path = tmp_path / "board.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)) + "\nbroken", encoding="utf-8")
    got = boards.read_board(spark, str(path), ["clerk", "chef"], hours_old=72, now="2025-01-03")
    assert [(r.url, r.title, r.location, r.description) for r in got.collect()] == [("u1", "Data Clerk", "Cork, Ireland", "Hi\nthere")]
    assert boards.read_board(spark, str(tmp_path / "gone"), ["clerk"]).count() == 0
