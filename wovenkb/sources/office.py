"""Workbooks and Word files, read with the standard library from their XML."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from html import unescape
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

MOST_BYTES = 100 * 1024 * 1024
ZIP_MAGIC = b"PK\x03\x04"
_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def check_workbook(name: str, data: bytes) -> None:
    """Raise where a file can't be a workbook: suffix, size or magic bytes."""
    if not name.lower().endswith(".xlsx"):
        raise ValueError("only .xlsx is read")
    if not data or len(data) > MOST_BYTES:
        raise ValueError("the file is empty or over 100 MB")
    if data[:4] != ZIP_MAGIC:
        raise ValueError("not a workbook")


def _place(ref: str) -> tuple[int, int]:
    m = re.match(r"([A-Z]+)(\d+)", ref)
    col = 0
    for ch in m[1]:
        col = col * 26 + ord(ch) - 64
    return int(m[2]) - 1, col - 1


def _number(value: str, fmt: str) -> str:
    """A number as its format shows it: percent, thousands, currency, dates, else plain."""
    x = float(value)
    if re.search(r"(?<![\"\\])[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", fmt.lower())) and fmt.lower() != "general":
        at = datetime(1899, 12, 30) + timedelta(days=x)
        return at.strftime("%Y-%m-%d") if at.time() == datetime.min.time() else at.strftime("%Y-%m-%d %H:%M:%S")
    places = len(m[1]) if (m := re.search(r"\.(0+)", fmt)) else 0
    if "%" in fmt:
        return f"{x * 100:.{places}f}%"
    sign = next((s for s in "¥￥$€£" if s in fmt), "")
    if "#,##" in fmt:
        return f"{sign}{x:,.{places}f}"
    return f"{sign}{x:.{places}f}" if sign else (str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x))


_BUILT_IN = {9: "0%", 10: "0.00%", 3: "#,##0", 4: "#,##0.00", 14: "yyyy-mm-dd", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 22: "m/d/yy h:mm", 1: "0", 2: "0.00"}


def workbook_cells(data: bytes, hidden: bool = False) -> list[dict]:
    """Cells (sheet, row, col, text, formula, comment, link) of all sheets, merged ranges filled down where they are purely vertical.

    Hidden rows and columns are left out, unless a filter is active on the sheet. A broken style table is read as
    if there were no formats.
    """
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(f"{_M}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_M}si")]
    formats: list[str] = []
    try:
        styles = ET.fromstring(z.read("xl/styles.xml"))
        own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_M}numFmt")}
        formats = [own.get(i, _BUILT_IN.get(i, "General")) for i in (int(x.get("numFmtId", 0)) for x in styles.find(f"{_M}cellXfs"))]
    except (KeyError, TypeError, ValueError, ET.ParseError):
        pass
    book = ET.fromstring(z.read("xl/workbook.xml"))
    rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in book.iter(f"{_M}sheet"):
        path = "xl/" + rels[sheet.get(f"{_R}id")].lstrip("/").removeprefix("xl/")
        root = ET.fromstring(z.read(path))
        filtered = root.find(f"{_M}autoFilter") is not None
        skip_cols = set()
        for c in root.iter(f"{_M}col"):
            if c.get("hidden") in ("1", "true"):
                skip_cols.update(range(int(c.get("min")) - 1, int(c.get("max"))))
        cells: dict[tuple[int, int], dict] = {}
        for row in root.iter(f"{_M}row"):
            r = int(row.get("r", 0)) - 1
            if row.get("hidden") in ("1", "true") and not hidden and not filtered:
                continue
            for c in row.findall(f"{_M}c"):
                at = _place(c.get("r"))
                if at[1] in skip_cols and not hidden and not filtered:
                    continue
                v, kind, f = c.find(f"{_M}v"), c.get("t", "n"), c.find(f"{_M}f")
                raw = v.text if v is not None and v.text is not None else ""
                if kind == "s":
                    text = shared[int(raw)] if raw else ""
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{_M}t"))
                elif kind == "b":
                    text = "TRUE" if raw == "1" else "FALSE"
                elif kind in ("str", "e", "d") or not raw:
                    text = raw
                else:
                    style = int(c.get("s", 0))
                    text = _number(raw, formats[style] if style < len(formats) else "General")
                cells[at] = {"sheet": sheet.get("name"), "row": r, "col": at[1], "text": text.strip(), "formula": f.text if f is not None else None}
        for m in root.iter(f"{_M}mergeCell"):
            a, _, b = m.get("ref").partition(":")
            (r1, c1), (r2, c2) = _place(a), _place(b or a)
            if c1 == c2 and (r1, c1) in cells:
                for r in range(r1 + 1, r2 + 1):
                    cells[r, c1] = {**cells[r1, c1], "row": r, "formula": None, "filled": True}
        own_rels, notes, links = _sheet_relations(z, names, path), {}, {}
        for kind, target in own_rels.values():
            if kind.endswith("/comments") and target in names:
                for c in ET.fromstring(z.read(target)).iter(f"{_M}comment"):
                    notes[_place(c.get("ref"))] = "".join(t.text or "" for t in c.iter(f"{_M}t")).strip()
        for h in root.iter(f"{_M}hyperlink"):
            links[_place(h.get("ref").partition(":")[0])] = own_rels.get(h.get(f"{_R}id"), ("", h.get("location") or ""))[1]
        out += [cells[k] | {"comment": notes.get(k), "link": links.get(k)} for k in sorted(cells)]
    return out


def _sheet_relations(z: zipfile.ZipFile, names: set[str], path: str) -> dict[str, tuple[str, str]]:
    """(type, target) of the relations of a sheet by id; targets inside the file as full paths."""
    folder, _, name = path.rpartition("/")
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in names:
        return {}
    out = {}
    for r in ET.fromstring(z.read(rels)):
        target = r.get("Target", "")
        if r.get("TargetMode") != "External":
            parts = target.lstrip("/").split("/") if target.startswith("/") else [*folder.split("/"), *target.split("/")]
            full: list[str] = []
            for x in parts:
                if x == "..":
                    full.pop()
                elif x not in ("", "."):
                    full.append(x)
            target = "/".join(full)
        out[r.get("Id")] = (r.get("Type", ""), target)
    return out


def _grids(data: bytes) -> dict[str, list[list[dict | None]]]:
    by: dict[str, dict[tuple[int, int], dict]] = {}
    for c in workbook_cells(data):
        by.setdefault(c["sheet"], {})[c["row"], c["col"]] = c
    return {n: [[cells.get((r, c)) for c in range(max(k[1] for k in cells) + 1)] for r in sorted({k[0] for k in cells})] for n, cells in by.items()}


def workbook_markdown(data: bytes, notes: bool = False) -> str:
    """Sheets as Markdown: titles, form and signing rows as paragraphs, data as tables; with notes also formulas, comments and links as a list."""
    out = []
    for name, grid in _grids(data).items():
        out.append(f"## {name}")
        rows = [[c["text"] if c else "" for c in r] for r in grid]
        table: list[list[str]] = []
        for r, role in zip(rows, row_roles(rows)):
            if role in ("data", "group_header"):
                table.append(r)
            elif any(r):
                out.append(("### " if role == "title" else "") + " | ".join(c for c in r if c))
        if table:
            lines = ["| " + " | ".join(c.replace("|", "\\|") for c in r) + " |" for r in table]
            out.append("\n".join([lines[0], "|" + "---|" * len(table[0]), *lines[1:]]))
        if notes:
            for c in (c for r in grid for c in r if c):
                said = [f"{k}: {c[k]}" for k in ("formula", "comment", "link") if c.get(k)]
                if said:
                    out.append(f"- {_ref(c['row'], c['col'])}: " + "; ".join(said))
    return "\n\n".join(out)


def _ref(row: int, col: int) -> str:
    letters = ""
    col += 1
    while col:
        col, rest = divmod(col - 1, 26)
        letters = chr(65 + rest) + letters
    return f"{letters}{row + 1}"


def workbook_sections(data: bytes) -> list[dict]:
    """Per sheet: title, form, signing, header, rows as records, and notes resolved to (row, header)."""
    out = []
    for name, grid in _grids(data).items():
        rows = [[c["text"] if c else "" for c in r] for r in grid]
        roles = row_roles(rows)
        pick = lambda role: [c for r, k in zip(rows, roles) if k == role for c in r if c]  # noqa: B023, E731
        data_at = [i for i, k in enumerate(roles) if k == "data"]
        header = rows[data_at[0]] if data_at else []
        names = [h or f"列{i + 1}" for i, h in enumerate(header)]
        records = [{n: v for n, v in zip(names, rows[i]) if v} for i in data_at[1:]]
        notes = [{"row": k, "header": names[c["col"]] if c["col"] < len(names) else "", **{f: c[f] for f in ("formula", "comment", "link") if c.get(f)}} for k, i in enumerate(data_at[1:]) for c in grid[i] if c and any(c.get(f) for f in ("formula", "comment", "link"))]
        out.append({"sheet": name, "title": next(iter(pick("title")), ""), "form": pick("form"), "signing": pick("signing"), "header": header, "rows": records, "notes": notes})
    return out


def workbook_arrays(data: bytes) -> dict[str, list[list[object]]]:
    """Per sheet a two-dimensional array: numbers and booleans as such, formulas with their value, empty cells null."""
    def native(c: dict | None) -> object:
        if c is None or (not c["text"] and not c["formula"]):
            return None
        t = c["text"]
        value = t == "TRUE" if t in ("TRUE", "FALSE") else int(t) if re.fullmatch(r"-?\d{1,15}", t) and not re.match(r"-?0\d", t) else float(t) if re.fullmatch(r"-?\d+\.\d+", t) else t
        return {"formula": c["formula"], "value": value} if c["formula"] else value

    return {n: [[native(c) for c in r] for r in grid] for n, grid in _grids(data).items()}


def workbook_raw(data: bytes) -> list[dict]:
    """Cells (sheet, row, col, text) as they are stored: nothing but the first cell of a merged range, formulas as their text."""
    return [{"sheet": c["sheet"], "row": c["row"], "col": c["col"], "text": f"={c['formula']}" if c["formula"] else c["text"]} for c in workbook_cells(data) if not c.get("filled")]


def workbook_text(data: bytes) -> str:
    """Role-marked CSV of all sheets, the form that the table splitter reads. Merged cells are filled down in data rows
    only; titles, forms, signatures and group headers stay as they are."""
    out: list[str] = []
    by: dict[str, dict[int, dict[int, dict]]] = {}
    for c in workbook_cells(data):
        by.setdefault(c["sheet"], {}).setdefault(c["row"], {})[c["col"]] = c
    for name, rows in by.items():
        out.append(f"=== {name} ===")
        width = max((max(r) for r in rows.values()), default=-1) + 1
        grids = [[[("" if c is None or (bare and c.get("filled")) else c["text"]) for c in (rows[r].get(k) for k in range(width))] for r in sorted(rows)] for bare in (False, True)]
        kept = [(full, bare) for full, bare in zip(*grids) if any(full)]
        for (full, bare), role in zip(kept, row_roles([bare for _, bare in kept])):
            own = full if role == "data" else bare
            if any(own):
                line = io.StringIO()
                csv.writer(line, lineterminator="").writerow(own)
                out.append(f"#{role.upper()}#{line.getvalue()}")
    return "\n".join(out)


def row_roles(rows: list[list[str]]) -> list[str]:
    """Role of each row: title, signing, form, group header, data, in this order."""
    out = []
    for i, row in enumerate(rows):
        filled = [c for c in row if c]
        after = max((sum(map(bool, r)) for r in rows[i + 1 : i + 5]), default=0)
        if len(filled) == 1 and i < 3 and after > 1:
            out.append("title")
        elif any(re.search("签字|签章|盖章|签名|审批人|制表人|Signature|Signed by|Approved by", c) for c in filled):
            out.append("signing")
        elif len(filled) <= 6 and any(re.match(r"[^:：]{1,30}[:：]\s*\S*$", c) for c in filled):
            out.append("form")
        elif i < 6 and 1 < len(filled) < len(row) and after > len(filled):
            out.append("group_header")
        else:
            out.append("data")
    return out


def _word_table(tbl: ET.Element) -> str:
    grid: list[list[str]] = []
    above: dict[int, str] = {}
    for tr in tbl.findall(f"{_W}tr"):
        row: list[str] = []
        for tc in tr.findall(f"{_W}tc"):
            pr = tc.find(f"{_W}tcPr")
            span = pr.find(f"{_W}gridSpan") if pr is not None else None
            merge = pr.find(f"{_W}vMerge") if pr is not None else None
            text = " ".join(" ".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in tc.findall(f"{_W}p")).split())
            if merge is not None and merge.get(f"{_W}val") != "restart":
                text = above.get(len(row), text)
            for _ in range(int(span.get(f"{_W}val")) if span is not None else 1):
                above[len(row)] = text
                row.append(text)
        grid.append(row)
    return _sections_markdown(grid)


def _sections_markdown(grid: list[list[str]]) -> str:
    """Markdown of a grid: a row that one text spans begins a section with that text as its title; the first row of a
    section is its header, unless it has gaps or numbers, and then the header is empty."""
    width = max(map(len, grid), default=0)
    sections: list[tuple[str, list[list[str]]]] = [("", [])]
    for row in grid:
        if width > 1 and len(row) == width and row[0] and len(set(row)) == 1:
            sections.append((row[0], []))
        else:
            sections[-1][1].append([*row, *[""] * (width - len(row))])
    out = []
    for title, rows in sections:
        if title:
            out.append(f"**{title}**")
        if rows:
            named = all(rows[0]) and not any(re.fullmatch(r"[-+]?[\d.,]+%?", c) for c in rows[0])
            lines = ["| " + " | ".join(c.replace("|", "\\|") for c in r) + " |" for r in (rows if named else [[""] * width, *rows])]
            out.append("\n".join([lines[0], "|" + "---|" * width, *lines[1:]]))
    return "\n\n".join(out)


def word_paragraphs(data: bytes) -> str:
    """The paragraphs of a Word file without any structure, for files whose structure can't be read."""
    body = zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml").decode("utf-8", "ignore")
    paragraphs = ("".join(re.findall(r"<w:t(?:\s[^>]*)?>([^<]*)</w:t>", p)) for p in re.split(r"</w:p>", body))
    return "\n\n".join(unescape(p).strip() for p in paragraphs if p.strip())


def word_text(data: bytes) -> str:
    """Markdown of a Word file, or its bare paragraphs where that fails."""
    try:
        return _word_markdown(data)
    except (ET.ParseError, KeyError, TypeError, AttributeError):
        return word_paragraphs(data)


def _word_markdown(data: bytes) -> str:
    """Markdown of a Word file: paragraphs and tables in their order, headings by style or numbering level."""
    z = zipfile.ZipFile(io.BytesIO(data))
    styles = {}
    if "word/styles.xml" in z.namelist():
        for s in ET.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
            name = s.find(f"{_W}name")
            styles[s.get(f"{_W}styleId")] = name.get(f"{_W}val", "").lower() if name is not None else ""
    out = []
    for el in ET.fromstring(z.read("word/document.xml")).find(f"{_W}body"):
        if el.tag == f"{_W}tbl":
            out.append(_word_table(el))
        elif el.tag == f"{_W}p":
            text = "".join((x.text or "") if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else "" for x in el.iter()).strip()
            style = el.find(f"{_W}pPr/{_W}pStyle")
            name = styles.get(style.get(f"{_W}val"), style.get(f"{_W}val", "").lower()) if style is not None else ""
            level = m[1] if (m := re.search(r"(?:heading|标题)\s*(\d)", name)) else "1" if name == "title" else ""
            if text:
                out.append(("#" * int(level) + " " + text) if level else ("- " + text) if el.find(f"{_W}pPr/{_W}numPr") is not None else text)
    return "\n\n".join(x for x in out if x)
