import pytest

from siftline.plans import connectors
from siftline.sources import assets, office, readers


def test_office_files_come_back(spark):
    cells = [["name", "amount", "note"], ["a|b", "1", ""], ["", "", ""], ["<c> & d", "2", "line\nbreak"]]
    docx = list(office.docx_blocks(office.write_docx("Top", ["one", "", "two & three"], cells)))
    assert [(b.kind, b.section, b.text) for b in docx[:3]] == [("heading", "Top", "Top"), ("paragraph", "Top", "one"), ("paragraph", "Top", "two & three")]
    assert docx[3].text.split("\n") == ["| name | amount | note |", "| --- | --- | --- |", "| a\\|b | 1 |  |", "| <c> & d | 2 | line break |"]
    pptx = list(office.pptx_blocks(office.write_pptx([("First", ["body"], "said"), ("", ["x"], "")])))
    assert [(b.kind, b.section, b.locator, b.text) for b in pptx] == [("heading", "First", "slide=1", "First"), ("paragraph", "First", "slide=1", "body"), ("caption", "First", "slide=1", "said"), ("heading", "Slide 2", "slide=2", "Slide 2"), ("paragraph", "Slide 2", "slide=2", "x")]
    rows = [["k", "v"]] + [[str(i), f"v{i}"] for i in range(120)]
    xlsx = list(office.xlsx_blocks(office.write_xlsx({"A": rows, "B": [["only", "head"]], "C": []})))
    assert [b.locator for b in xlsx] == ["sheet=A;rows=2-51", "sheet=A;rows=52-101", "sheet=A;rows=102-121", "sheet=B;rows=2-2"]
    assert [line for b in xlsx[:3] for line in b.text.split("\n")[2:]] == [f"| {i} | v{i} |" for i in range(120)]
    assert [office.office_kind(x) for x in (office.write_docx("", [], []), office.write_pptx([]), office.write_xlsx({}), b"PK\x03\x04junk", b"")] == ["docx", "pptx", "xlsx", None, None]
    with pytest.raises(ValueError):
        list(office.docx_blocks(b"no archive"))


def test_shared_strings_and_gaps():
    sheet = '<worksheet xmlns="{0}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="B2"><v>4.5</v></c><c r="C2" t="b"><v>1</v></c></row></sheetData></worksheet>'.format(office._S)
    shared = f'<sst xmlns="{office._S}"><si><t>left</t></si><si><r><t>ri</t></r><r><t>ght</t></r></si></sst>'
    base = office.write_xlsx({"S": []})
    import io
    import zipfile

    with zipfile.ZipFile(io.BytesIO(base)) as z:
        members = {n: z.read(n).decode() for n in z.namelist()}
    data = office._zipped(members | {"xl/worksheets/sheet0.xml": sheet, "xl/sharedStrings.xml": shared})
    assert [b.text for b in office.xlsx_blocks(data)] == ["| left |  | right |\n| --- | --- | --- |\n|  | 4.5 | true |"]


def test_an_asset_fails_alone(spark):
    rows = [(1, "a.txt", b"one\n\ntwo  words"), (2, "b.docx", b"PK\x03\x04broken"), (3, "c.txt", b"\xff\xfe\xfa"), (4, "d.pdf", b"%PDF-1.4"), (5, "e.md", b"# Head\n\ntext"), (6, "f.json", b'{"a": [1, null]}'), (7, None, None), (8, "no ending", office.write_docx("T", [], []))]
    got = {}
    for r in assets.extracted(spark.createDataFrame(rows, "asset_id long, name string, content binary")).collect():
        got.setdefault(r.asset_id, []).append((r.ordinal, r.kind, r.section, r.text, r.error is not None))
    assert got[1] == [(0, "paragraph", None, "one", False), (1, "paragraph", None, "two words", False)]
    assert all(len(got[i]) == 1 and got[i][0][-1] for i in (2, 3, 4)) and 7 not in got
    assert [x[1] for x in got[5]] == ["heading", "paragraph"] and got[5][1][2] == "Head"
    assert [x[3] for x in got[6]] == ["$.a[0]: 1", "$.a[1]: "] and got[8][0][1] == "heading"


def test_pages_agree_with_the_block_reader(spark, sf):
    want = readers.blocks(spark.read.parquet(f"{sf}/pages.parquet"), "page_id", "html", readers.html_blocks)
    key = lambda df: sorted((r.page_id, r.ordinal, r.kind, r.section or "", r.text) for r in df.collect())
    got = connectors.page_chunks(spark, sf)
    assert got.where("error IS NOT NULL").count() == 0 and key(got) == key(want)
