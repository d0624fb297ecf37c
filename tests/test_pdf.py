"""The PDF source over made-up documents, and the commands that use it."""

from __future__ import annotations

import pytest

from quern import cli
from quern.sources import pdf

READER = "tests.fake_pdf:open_pdf"
LONG = "text layer of a page " * 20


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "sub dir").mkdir(parents=True)
    (tmp_path / "in" / "a.pdf").write_text("%FAKE|Title A|\n" + "\f".join([LONG, "short", "!x", LONG]))
    (tmp_path / "in" / "sub dir" / "B+1.PDF").write_text("%FAKE||\n" + "\f".join(f"{k} {LONG}" for k in range(30)))
    (tmp_path / "in" / "locked.pdf").write_text("%FAKE|L|secret\n" + LONG)
    (tmp_path / "in" / "broken.pdf").write_text("no document")
    (tmp_path / "in" / "notes.txt").write_text("no pdf")
    return tmp_path / "in"


def load(spark, folder, **options):
    pdf.register(spark)
    return spark.read.format("pdf_pages").options(reader=READER, **options).load(str(folder))


def test_find_pdfs(folder):
    root, files, skipped = pdf.find_pdfs(str(folder))
    assert root == str(folder) and [f for f, _ in files] == ["a.pdf", "broken.pdf", "locked.pdf", "sub dir/B+1.PDF"] and skipped == 1
    assert pdf.find_pdfs(str(folder / "a.pdf"))[:2] == (str(folder), [("a.pdf", (folder / "a.pdf").stat().st_size)])
    assert pdf.find_pdfs(f"file://{folder}")[1] == files
    with pytest.raises(FileNotFoundError):
        pdf.find_pdfs(str(folder / "none"))


def test_pages_titles_errors_and_images(spark, folder):
    got = {(r["rel"], r["page_no"]): r for r in load(spark, folder).collect()}
    a = got["a.pdf", 1]
    assert (a["title"], a["pages_total"], a["text"], a["png"]) == ("Title A", 4, LONG, None)
    assert bytes(got["a.pdf", 2]["png"]) == b"png 1 200" and got["a.pdf", 3]["error"] == "RuntimeError: broken page" and got["a.pdf", 4]["text"] == LONG
    assert got["sub dir/B+1.PDF", 30]["title"] == "B+1"  # no title of its own
    assert got["locked.pdf", None]["error"].startswith("PermissionError") and got["broken.pdf", None]["error"].startswith("ValueError")
    assert load(spark, folder / "locked.pdf", password="secret").first()["text"] == LONG
    assert load(spark, folder, render="never").filter("png is not null").isEmpty()
    assert load(spark, folder / "a.pdf", render="always", dpi="72").filter("png is not null").count() == 3


def test_a_large_file_is_read_by_several_tasks(spark, folder):
    from pyspark.sql import functions as F

    df = load(spark, folder / "sub dir", slotBytes="1000").withColumn("task", F.spark_partition_id())
    rows = df.collect()
    assert sorted(r["page_no"] for r in rows) == list(range(1, 31)) and len({r["task"] for r in rows}) > 5


def test_reader_options_are_checked(spark, folder):
    pdf.register(spark)
    for wrong in ({"reader": READER, "render": "often"}, {"render": "auto"}):
        with pytest.raises(Exception, match="render is|are needed"):
            spark.read.format("pdf_pages").options(**wrong).load(str(folder / "a.pdf")).collect()


def test_table_function(spark, folder):
    pdf.register(spark)
    spark.read.format("binaryFile").load(str(folder / "a.pdf")).createOrReplaceTempView("pdf_files")
    rows = spark.sql(f"SELECT t.* FROM pdf_files, LATERAL pdf_table(content, '{READER}', NULL) t ORDER BY page_no").collect()
    assert [(r["page_no"], r["error"]) for r in rows] == [(1, None), (2, None), (3, "RuntimeError: broken page"), (4, None)]


def test_documents_command_goes_on_where_it_was(spark, folder, tmp_path, capsys):
    out = tmp_path / "data"
    run = lambda *more: cli.main(["documents", str(folder), "--label", "manuals", "--data", str(out), "--reader", READER, *more])
    run()
    said = capsys.readouterr().out
    assert "other files: 1" in said and "written: 32" in said and "broken.pdf" in said and "a.pdf page 3" in said
    pages = sorted(p.relative_to(out / "raw").as_posix() for p in (out / "raw").rglob("*.md"))
    assert len(pages) == 32 and all(p.startswith("manuals/") for p in pages)
    run()
    assert "written: 0" in capsys.readouterr().out
    (folder / "a.pdf").write_text("%FAKE|Title A|\n" + LONG)
    run()
    assert "written: 1" in capsys.readouterr().out
    run("--password", "secret")
    assert "written: 1" in capsys.readouterr().out
    run("--fresh")
    assert "written: 31" in capsys.readouterr().out


def test_migrate_lang_command(spark, tmp_path, capsys):
    english = "The cat sat on the mat and it was not the only one of them that is in the house with you. " * 3
    pages = {"a.md": f"---\ntitle: x\n---\n{english}", "b.md": '---\ntitle: y\nlanguage: "de"\n---\nText', "c.md": "no block", "d.md": "---\ntitle: z\n---\n123"}
    for name, content in pages.items():
        (tmp_path / name).write_text(content)
    cli.main(["migrate-lang", "--raw", str(tmp_path), "--dry-run"])
    assert {n: (tmp_path / n).read_text() for n in pages} == pages
    cli.main(["migrate-lang", "--raw", str(tmp_path)])
    assert {line for line in capsys.readouterr().out.splitlines() if ":" in line} == {"no_frontmatter: 1", "skipped: 1", "unknown: 1", "updated: 1"}
    assert (tmp_path / "a.md").read_text() == f'---\ntitle: x\nlanguage: "en"\n---\n{english}'
    assert all((tmp_path / n).read_text() == pages[n] for n in ("b.md", "c.md", "d.md"))
