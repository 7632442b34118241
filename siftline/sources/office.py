"""Office files as blocks: the members of their zip archives, read as streams of XML events with the standard library.

Documents give paragraphs (headings by style) and tables in order; presentations a heading, the text frames and the notes of each
slide; workbooks each sheet's rows as tables of ROWS_A_BLOCK rows under the sheet's header. A file that can't be opened raises
``ValueError`` with the reason. Sheets are read to their end.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from typing import NamedTuple
from xml.etree import ElementTree
from xml.sax.saxutils import escape

ROWS_A_BLOCK = 50
# Beginnings of the names of heading styles.
HEADINGS = ("heading", "title", "subtitle")


class Block(NamedTuple):
    kind: str
    section: str | None
    locator: str | None
    text: str


def office_kind(data: bytes) -> str | None:
    """docx, pptx or xlsx by what the archive holds; None for anything else."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = set(z.namelist())
    except (zipfile.BadZipFile, OSError):
        return None
    return next((kind for kind, member in (("docx", "word/document.xml"), ("pptx", "ppt/presentation.xml"), ("xlsx", "xl/workbook.xml")) if member in names), None)


def _opened(data: bytes, member: str) -> zipfile.ZipFile:
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
        z.getinfo(member)
        return z
    except (zipfile.BadZipFile, KeyError, OSError) as e:
        raise ValueError(f"can't be opened: {type(e).__name__}: {e}"[:200]) from None


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _named(node: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (e for e in node.iter() if _local(e.tag) == name)


def _attribute(node: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if _local(k) == name), None)


def _shown(node: ElementTree.Element) -> str:
    """The text of a paragraph; tabs and breaks as white space."""
    out = []
    for e in node.iter():
        name = _local(e.tag)
        out.append((e.text or "") if name == "t" else "\t" if name == "tab" else "\n" if name == "br" else "")
    return "".join(out).strip()


def markdown(rows: list[list[str]]) -> str:
    """A Markdown table under its first row; blank rows go, short ones are filled up; a row alone gets numbered columns."""
    plain = [[re.sub(r"\s+", " ", c.replace("|", "\\|")).strip() for c in r] for r in rows]
    plain = [r for r in plain if any(r)]
    if not plain:
        return ""
    width = max(map(len, plain))
    plain = [r + [""] * (width - len(r)) for r in plain]
    head, body = (plain[0], plain[1:]) if len(plain) > 1 else ([f"col_{i}" for i in range(1, width + 1)], plain)
    return "\n".join("| " + " | ".join(r) + " |" for r in [head, ["---"] * width, *body])


def docx_blocks(data: bytes) -> Iterator[Block]:
    section, inside = None, 0
    with _opened(data, "word/document.xml") as z, z.open("word/document.xml") as xml:
        for event, node in ElementTree.iterparse(xml, events=("start", "end")):
            name = _local(node.tag)
            if name == "tbl":
                inside += 1 if event == "start" else -1
            if event == "start" or inside:
                continue
            if name == "tbl":
                rows = [["\n".join(_shown(p) for p in _named(c, "p")) for c in row if _local(c.tag) == "tc"] for row in node if _local(row.tag) == "tr"]
                if text := markdown(rows):
                    yield Block("table", section, None, text)
                node.clear()
            elif name == "p":
                style = next((_attribute(s, "val") or "" for s in _named(node, "pStyle")), "").lower()
                if text := _shown(node):
                    heading = style.startswith(HEADINGS)
                    section = text if heading else section
                    yield Block("heading" if heading else "paragraph", section, None, text)
                node.clear()


def _targets(z: zipfile.ZipFile, member: str) -> dict[str, tuple[str, str]]:
    """Relations of a member: id to (kind, path)."""
    folder, _, name = member.rpartition("/")
    path = f"{folder}/_rels/{name}.rels"
    if path not in z.namelist():
        return {}
    out = {}
    for r in _named(ElementTree.fromstring(z.read(path)), "Relationship"):
        parts: list[str] = [] if r.get("Target", "").startswith("/") else folder.split("/")
        for p in r.get("Target", "").strip("/").split("/"):
            parts = parts[:-1] if p == ".." else [*parts, p]
        out[r.get("Id", "")] = (r.get("Type", "").rpartition("/")[2], "/".join(parts))
    return out


def _frames(xml: bytes) -> Iterator[tuple[str, str]]:
    """(kind of placeholder, text) of the shapes of a slide."""
    for shape in _named(ElementTree.fromstring(xml), "sp"):
        kind = next((ph.get("type", "body") for ph in _named(shape, "ph")), "")
        text = "\n".join(t for t in (_shown(p) for p in _named(shape, "p")) if t)
        if text:
            yield kind, text


def pptx_blocks(data: bytes) -> Iterator[Block]:
    with _opened(data, "ppt/presentation.xml") as z:
        links = _targets(z, "ppt/presentation.xml")
        shown = _named(ElementTree.fromstring(z.read("ppt/presentation.xml")), "sldId")
        slides = [links[i][1] for i in (next((v for k, v in s.attrib.items() if k.endswith("}id")), None) for s in shown) if i in links]
        for page, slide in enumerate(slides, 1):
            frames = list(_frames(z.read(slide)))
            section = next((t for k, t in frames if k in ("title", "ctrTitle")), f"Slide {page}")
            yield Block("heading", section, f"slide={page}", section)
            yield from (Block("paragraph", section, f"slide={page}", t) for k, t in frames if k not in ("title", "ctrTitle"))
            notes = next((path for kind, path in _targets(z, slide).values() if kind == "notesSlide"), None)
            if notes:
                yield from (Block("caption", section, f"slide={page}", t) for k, t in _frames(z.read(notes)) if k == "body")


def _column(ref: str) -> int:
    """A1 is column 0."""
    n = 0
    for c in re.match("[A-Z]*", ref).group():
        n = 26 * n + ord(c) - 64
    return n - 1


def _sheet_rows(z: zipfile.ZipFile, member: str, shared: list[str]) -> Iterator[list[str]]:
    with z.open(member) as xml:
        for _, node in ElementTree.iterparse(xml, events=("end",)):
            if _local(node.tag) != "row":
                continue
            row: list[str] = []
            for c in (c for c in node if _local(c.tag) == "c"):
                at = _column(c.get("r", "")) if c.get("r") else len(row)
                value, kind = next((v.text or "" for v in _named(c, "v")), ""), c.get("t", "n")
                if kind == "s":
                    value = shared[int(value)] if value else ""
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in _named(c, "t"))
                elif kind == "b":
                    value = "true" if value == "1" else "false"
                row += [""] * (at + 1 - len(row))
                row[at] = value
            yield row
            node.clear()


def xlsx_blocks(data: bytes, rows_a_block: int = ROWS_A_BLOCK) -> Iterator[Block]:
    with _opened(data, "xl/workbook.xml") as z:
        links, shared = _targets(z, "xl/workbook.xml"), []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in _named(si, "t")) for si in _named(ElementTree.fromstring(z.read("xl/sharedStrings.xml")), "si")]
        for sheet in _named(ElementTree.fromstring(z.read("xl/workbook.xml")), "sheet"):
            path = links.get(next((v for k, v in sheet.attrib.items() if k.endswith("}id")), ""), ("", ""))[1]
            if path not in z.namelist():
                continue
            name, head, held, first = sheet.get("name", ""), None, [], 2
            for row in (r for r in _sheet_rows(z, path, shared) if any(c.strip() for c in r)):
                if head is None:
                    head = row
                    continue
                held.append(row)
                if len(held) == rows_a_block:
                    yield Block("table", name, f"sheet={name};rows={first}-{first + len(held) - 1}", markdown([head, *held]))
                    first, held = first + len(held), []
            if head is not None and (held or first == 2):
                yield Block("table", name, f"sheet={name};rows={first}-{first + max(0, len(held) - 1)}", markdown([head, *held]))


BLOCKS_OF = {"docx": docx_blocks, "pptx": pptx_blocks, "xlsx": xlsx_blocks}

_W, _P, _A, _R = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_S, _REL = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/package/2006/relationships"


def _zipped(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def _rels(*links: tuple[str, str, str]) -> str:
    return f'<Relationships xmlns="{_REL}">' + "".join(f'<Relationship Id="{i}" Type="{_R}/{kind}" Target="{escape(to)}"/>' for i, kind, to in links) + "</Relationships>"


def write_docx(heading: str, paragraphs: list[str], table: list[list[str]]) -> bytes:
    """A document with a heading, paragraphs and one table."""
    p = lambda text, style="": f'<w:p>{f"""<w:pPr><w:pStyle w:val="{style}"/></w:pPr>""" if style else ""}<w:r><w:t>{escape(text)}</w:t></w:r></w:p>'
    rows = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in table)
    return _zipped({"word/document.xml": f'<w:document xmlns:w="{_W}"><w:body>{p(heading, "Heading1")}{"".join(map(p, paragraphs))}<w:tbl>{rows}</w:tbl></w:body></w:document>'})


def write_pptx(slides: list[tuple[str, list[str], str]]) -> bytes:
    """Slides of (title, text frames, notes)."""
    shape = lambda text, kind: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{escape(text)}</a:t></a:r></a:p></p:txBody></p:sp>'
    page = lambda root, shapes: f'<p:{root} xmlns:p="{_P}" xmlns:a="{_A}"><p:cSld><p:spTree>{"".join(shapes)}</p:spTree></p:cSld></p:{root}>'
    members = {"ppt/presentation.xml": f'<p:presentation xmlns:p="{_P}" xmlns:r="{_R}"><p:sldIdLst>' + "".join(f'<p:sldId id="{256 + i}" r:id="s{i}"/>' for i in range(len(slides))) + "</p:sldIdLst></p:presentation>",
               "ppt/_rels/presentation.xml.rels": _rels(*[(f"s{i}", "slide", f"slides/slide{i}.xml") for i in range(len(slides))])}
    for i, (title, frames, notes) in enumerate(slides):
        members[f"ppt/slides/slide{i}.xml"] = page("sld", [shape(title, "title"), *[shape(f, "body") for f in frames]])
        members[f"ppt/slides/_rels/slide{i}.xml.rels"] = _rels(("n", "notesSlide", f"../notesSlides/notes{i}.xml"))
        members[f"ppt/notesSlides/notes{i}.xml"] = page("notes", [shape(notes, "body")])
    return _zipped(members)


def write_xlsx(sheets: dict[str, list[list[str]]]) -> bytes:
    """Sheets of rows of text cells."""
    sheet = lambda rows: f'<worksheet xmlns="{_S}"><sheetData>' + "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{escape(c)}</t></is></c>' for c in r) + "</row>" for r in rows) + "</sheetData></worksheet>"
    names = list(sheets)
    members = {"xl/workbook.xml": f'<workbook xmlns="{_S}" xmlns:r="{_R}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="w{i}"/>' for i, n in enumerate(names)) + "</sheets></workbook>",
               "xl/_rels/workbook.xml.rels": _rels(*[(f"w{i}", "worksheet", f"worksheets/sheet{i}.xml") for i in range(len(names))])}
    return _zipped(members | {f"xl/worksheets/sheet{i}.xml": sheet(sheets[n]) for i, n in enumerate(names)})
