"""Office documents as item tables: DOCX, XLSX and PPTX bytes are read with the standard library, document by document, on the executors.

Items have path, item_index, type, style and text; links of a table row are a map. PDF pages enter as rows of lines, see tessera.operators.layout.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BODY, TITLE_OF_TABLE = "正文", "表标题"
EMPTY_CELL = "（空）"
REPEAT_CHARS, ROW_CHARS = 15, 800
ITEM = "path string, item_index long, type string, style string, text string, url string, links map<string,string>"


def _name(e) -> str:
    return e.tag.rpartition("}")[2]


def _attr(e, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _all(e, name: str):
    return [x for x in e.iter() if _name(x) == name]


def _child(e, name: str):
    return next((x for x in e if _name(x) == name), None)


def _squeezed(text: str) -> str:
    return " ".join(text.split())


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, file = posixpath.split(part)
    path = f"{folder}/_rels/{file}.rels"
    if path not in z.namelist():
        return {}
    return {r.attrib["Id"]: r.attrib["Target"] for r in ET.fromstring(z.read(path))}


def _item(kind: str, style: str, text: str, url: str | None = None, links: dict | None = None) -> tuple:
    return kind, style, text, url, links or {}


def unique(headers: list[str]) -> list[str]:
    """Empty headers take the one before, repeats are numbered from 2."""
    out, seen, last = [], {}, "column"
    for h in headers:
        last = h or last
        seen[last] = seen.get(last, 0) + 1
        out.append(last if seen[last] == 1 else f"{last}_{seen[last]}")
    return out


def row_items(rows: list[dict], style: str = "table", most: int = ROW_CHARS) -> list[tuple]:
    """Table items of JSON row objects, in greedy batches of at most most characters."""
    out: list[list[str]] = []
    for r in rows:
        text = json.dumps(r, ensure_ascii=False, separators=(",", ":"))
        if out and sum(map(len, out[-1])) + len(out[-1]) + 1 + len(text) <= most:
            out[-1].append(text)
        else:
            out.append([text])
    return [_item("table", style, "[" + ",".join(b) + "]") for b in out]


def grid_items(grid: list[list[str]]) -> list[tuple]:
    """A table's items: rows filled by one text are paragraphs, two columns are key and value, else the first row names the columns."""
    out, rows = [], []
    for r in grid:
        texts = {c for c in r if c and c != EMPTY_CELL}
        if len(r) > 1 and len(texts) == 1 and all(c in texts for c in r):
            out.append(_item("paragraph", BODY, texts.pop()))
        elif texts:
            rows.append(r)
    if not rows:
        return out
    if max(map(len, rows)) == 2:
        return out + row_items([{k: v} for k, v in ((r + [""])[:2] for r in rows) if k])
    if len(rows) == 1:
        return out + [_item("paragraph", BODY, " ".join(c for c in rows[0] if c))]
    names = unique(rows[0])
    return out + row_items([{n: v for n, v in zip(names, r) if v} for r in rows[1:]])


def _docx_table(table) -> list[tuple]:
    grid: list[list[str]] = []
    carried: dict[int, str] = {}
    for tr in (x for x in table if _name(x) == "tr"):
        row: list[str] = []
        for tc in (x for x in tr if _name(x) == "tc"):
            text = _squeezed(" ".join("".join(t.text or "" for t in _all(p, "t")) for p in _all(tc, "p")))
            props = _child(tc, "tcPr")
            span = _child(props, "gridSpan") if props is not None else None
            merge = _child(props, "vMerge") if props is not None else None
            width = int(_attr(span, "val") or 1) if span is not None else 1
            at = len(row)
            if merge is not None and (_attr(merge, "val") or "continue") == "continue":
                above = carried.get(at, "")
                text = above if len(above) <= REPEAT_CHARS else EMPTY_CELL
            elif merge is not None:
                carried[at] = text
            else:
                carried.pop(at, None)
            row += [text] * width
        grid.append(row)
    return grid_items(grid)


def docx(content: bytes, stem: str = "") -> list[tuple]:
    """Paragraphs, hyperlinks, images and tables of a document's body, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        links = _relations(z, "word/document.xml")
        styles = {}
        if "word/styles.xml" in z.namelist():
            for s in _all(ET.fromstring(z.read("word/styles.xml")), "style"):
                name = _child(s, "name")
                styles[_attr(s, "styleId")] = _attr(name, "val") if name is not None else None
        body = _child(ET.fromstring(z.read("word/document.xml")), "body")
    out: list[tuple] = []
    for block in body:
        if _name(block) == "tbl":
            out += _docx_table(block)
        elif _name(block) == "p":
            mark = next(iter(_all(block, "pStyle")), None)
            style = (styles.get(_attr(mark, "val")) or _attr(mark, "val")) if mark is not None else None
            text = _squeezed("".join((x.text or "") if _name(x) == "t" else " " for x in block.iter() if _name(x) in ("t", "tab", "br")))
            if text:
                out.append(_item("paragraph", style or BODY, text))
            for h in _all(block, "hyperlink"):
                url = links.get(_attr(h, "id") or "")
                if url:
                    out.append(_item("link", BODY, _squeezed("".join(t.text or "" for t in _all(h, "t"))), url))
            out += [_item("image", BODY, "", links.get(_attr(b, "embed") or "")) for b in _all(block, "blip")]
    return out


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx(content: bytes, stem: str = "") -> list[tuple]:
    """A heading for the workbook and each sheet, and its rows as objects named by the first row; empty cells are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [_squeezed("".join(t.text or "" for t in _all(s, "t"))) for s in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        parts, out = _relations(z, "xl/workbook.xml"), [_item("paragraph", "标题", stem)] if stem else []
        for sheet in _all(ET.fromstring(z.read("xl/workbook.xml")), "sheet"):
            path = posixpath.normpath(posixpath.join("xl", parts[_attr(sheet, "id")])) if not parts[_attr(sheet, "id")].startswith("/") else parts[_attr(sheet, "id")][1:]
            root, urls = ET.fromstring(z.read(path)), _relations(z, path)
            out.append(_item("paragraph", "标题 2", _attr(sheet, "name") or ""))
            cells: dict[int, dict[int, str]] = {}
            for c in _all(root, "c"):
                v, kind = _child(c, "v"), c.attrib.get("t")
                text = "".join(t.text or "" for t in _all(c, "t")) if kind == "inlineStr" else shared[int(v.text)] if kind == "s" and v is not None else (v.text or "") if v is not None else ""
                ref = c.attrib["r"]
                if _squeezed(text):
                    cells.setdefault(int(re.search(r"\d+", ref)[0]), {})[_column(ref)] = _squeezed(text)
            for m in _all(root, "mergeCell"):
                low, _, high = m.attrib["ref"].partition(":")
                r0, r1, c0 = int(re.search(r"\d+", low)[0]), int(re.search(r"\d+", high or low)[0]), _column(low)
                for r in range(r0 + 1, r1 + 1):
                    if cells.get(r0, {}).get(c0) and r in cells:
                        cells[r].setdefault(c0, cells[r0][c0])
            at = {h.attrib["ref"]: urls.get(_attr(h, "id") or "") for h in _all(root, "hyperlink")}
            rows = sorted(cells)
            if len(rows) > 1 and len(cells[rows[0]]) <= 2 < len(cells[rows[1]]):
                out.append(_item("paragraph", BODY, " ".join(cells[rows[0]].values())))
                rows = rows[1:]
            if not rows:
                continue
            width = max(max(cells[r]) for r in rows) + 1
            heads = unique([cells[rows[0]].get(c, "") for c in range(width)])
            for r in rows[1:]:
                links = {cells[r][c]: at[ref] for ref in at if at[ref] and int(re.search(r"\d+", ref)[0]) == r and (c := _column(ref)) in cells[r]}
                text = json.dumps([{heads[c]: cells[r][c] for c in sorted(cells[r])}], ensure_ascii=False, separators=(",", ":"))
                out.append(_item("table", f"row:{r}", text, None, links))
    return out


def _slides(z: zipfile.ZipFile) -> list[str]:
    """The parts of the slides in the presentation's order; by their numbers where it has none."""
    parts = [n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)]
    if "ppt/presentation.xml" in z.namelist():
        targets = _relations(z, "ppt/presentation.xml")
        # The relation's id is the attribute with a name space; the plain one numbers the slide.
        ids = [next((v for k, v in s.attrib.items() if k.endswith("}id")), "") for s in _all(ET.fromstring(z.read("ppt/presentation.xml")), "sldId")]
        listed = [posixpath.normpath(posixpath.join("ppt", targets[i])) if not targets[i].startswith("/") else targets[i][1:] for i in ids if i in targets]
        if listed:
            return [n for n in listed if n in parts]
    return sorted(parts, key=lambda n: int(re.search(r"\d+", n)[0]))


def _shapes(parent, dx: int = 0, dy: int = 0):
    """Shapes below parent with their place on the slide (top, left); those of groups are moved by the group's offset."""
    for e in parent:
        name = _name(e)
        if name == "grpSp":
            props = _child(e, "grpSpPr")
            at = {k: next(iter(_all(props, k)), None) if props is not None else None for k in ("off", "chOff")}
            move = [int(at["off"].attrib[c]) - int(at["chOff"].attrib[c]) if at["off"] is not None and at["chOff"] is not None else 0 for c in "xy"]
            yield from _shapes(e, dx + move[0], dy + move[1])
        elif name in ("sp", "graphicFrame", "pic"):
            off = next(iter(_all(e, "off")), None)
            yield e, (int(off.attrib["y"]) + dy, int(off.attrib["x"]) + dx) if off is not None else (0, 0)
        elif name in ("cSld", "spTree", "AlternateContent", "Choice"):
            yield from _shapes(e, dx, dy)


def pptx(content: bytes, stem: str = "") -> list[tuple]:
    """A heading for each slide and its texts in reading order; the last slide and slides with a video are left out."""
    row_height = 260_000
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        out: list[tuple] = []
        for number, name in enumerate(_slides(z)[:-1], 1):
            root = ET.fromstring(z.read(name))
            if _all(root, "videoFile"):
                continue
            shapes = []
            for s, place in _shapes(root):
                if _name(s) == "graphicFrame":
                    grid = [[_squeezed("".join(t.text or "" for t in _all(tc, "t"))) for tc in _all(tr, "tc")] for tr in _all(s, "tr")]
                    shapes.append((*place, grid_items(grid)))
                elif _name(s) == "sp":
                    text = "\n".join(x for x in (_squeezed("".join(t.text or "" for t in _all(p, "t"))) for p in _all(s, "p")) if x)
                    shapes.append((*place, [_item("paragraph", BODY, text)] if text else []))
                elif number > 1:
                    shapes.append((*place, [_item("image", BODY, _attr(next(iter(_all(s, "cNvPr")), s), "descr") or "")]))
            rows: list[list] = []
            for s in sorted(shapes, key=lambda s: s[:2]):
                if rows and s[0] - rows[-1][0][0] <= row_height:
                    rows[-1].append(s)
                else:
                    rows.append([s])
            found = [i for r in rows for s in sorted(r, key=lambda s: s[1]) for i in s[2]]
            if found:
                out += [_item("paragraph", "标题 2", f"第{number}页"), *found]
    return out


READERS = {"docx": docx, "xlsx": xlsx, "pptx": pptx}


def items(files: DataFrame) -> DataFrame:
    """Items of files (path, content); a file of an unknown kind or that can't be read gives one item of type error."""

    def rows(frames):
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"]):
                reader = READERS.get(path.rpartition(".")[2].lower())
                try:
                    found = reader(content, posixpath.splitext(posixpath.basename(path))[0]) if reader else [_item("error", BODY, "unsupported format")]
                except (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError) as e:
                    found = [_item("error", BODY, f"{type(e).__name__}: {e}")]
                out += [(path, i, *x) for i, x in enumerate(found)]
            yield pd.DataFrame(out, columns=["path", "item_index", "type", "style", "text", "url", "links"])

    return files.select("path", "content").mapInPandas(rows, ITEM)


def documents(files: DataFrame) -> DataFrame:
    """Items with their document's ids: doc_id is the path."""
    from tessera.functions import text as T

    kind = F.regexp_replace(F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)), "^docx$", "doc")
    return items(files).withColumns({"file_id": T.file_id(F.col("path"), kind), "doc_id": F.col("path")}).drop("path")
