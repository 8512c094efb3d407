"""Text of PDF and office files, and the structure of workbooks.

Files come as (path, content) from ``spark.read.format("binaryFile")``; each is read by itself in
an Arrow pass with the standard library only. Archives are checked before anything is parsed: what
they claim and what they really unpack to must stay under the limits.
"""

from __future__ import annotations

import hashlib
import io
import re
import unicodedata
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.functions.ids import make_id_py, normalize_id_py

#: Limits of a file on disk, of an archive's unpacked size, and of the ratio between the two.
MOST_BYTES, MOST_UNPACKED, MOST_RATIO = 50 << 20, 512 << 20, 200
STRUCTURE = "path string, kind string, id string, label string, source string, relation string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def safe_archive(content: bytes) -> bool:
    """Whether a zip archive stays under the limits, by its directory and by what it unpacks to."""
    if len(content) > MOST_BYTES:
        return False
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            left = MOST_UNPACKED
            if sum(i.file_size for i in z.infolist()) > min(left, MOST_RATIO * max(1, sum(i.compress_size for i in z.infolist()))):
                return False
            for name in z.namelist():
                with z.open(name) as member:
                    while part := member.read(1 << 20):
                        left -= len(part)
                        if left < 0:
                            return False
    except (zipfile.BadZipFile, OSError, EOFError, zlib.error, NotImplementedError, RuntimeError):
        return False
    return True


def _table(rows: list[list[str]]) -> list[str]:
    row = lambda cells: "| " + " | ".join(cells) + " |"
    return [row(rows[0]), row(["---"] * len(rows[0])), *map(row, rows[1:])]


def docx_markdown(content: bytes) -> str:
    """Paragraphs with headings and list items, then the tables."""
    if not safe_archive(content):
        return ""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        styles = {}
        if "word/styles.xml" in z.namelist():
            for s in ET.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                styles[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""
    text = lambda e: "".join("\t" if t.tag == f"{_W}tab" else "\n" if t.tag == f"{_W}br" else t.text or "" for t in e.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br")).strip()
    lines, tables = [], []
    for e in body:
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            key = style.get(f"{_W}val") if style is not None else ""
            name = (styles.get(key) or key).lower()
            level = re.match(r"heading ?([1-3])", name)
            mark = "#" * int(level[1]) + " " if level else "- " if name.startswith("list") else ""
            lines.append(mark + text(e) if text(e) else "")
        elif e.tag == f"{_W}tbl":
            rows = [["\n".join(filter(None, map(text, c.iter(f"{_W}p")))) for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")]
            tables += _table(rows) if rows else []
    return "\n".join(lines + tables)


def _cell(ref: str) -> tuple[int, int]:
    """(row, column) of a reference such as B12, from 0."""
    letters, digits = re.match(r"\$?([A-Z]+)\$?(\d+)", ref).groups()
    column = 0
    for c in letters:
        column = column * 26 + ord(c) - 64
    return int(digits) - 1, column - 1


def _workbook(content: bytes) -> list[tuple[str, dict[tuple[int, int], str], list[tuple[str, str]]]]:
    """(name, cells, tables as (name, range)) of each sheet."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{_X}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_X}si")] if "xl/sharedStrings.xml" in names else []

        def links(part: str) -> dict[str, str]:
            folder, _, name = part.rpartition("/")
            rels = f"{folder}/_rels/{name}.rels"
            if rels not in names:
                return {}
            full = lambda t: t.lstrip("/") if t.startswith("/") else re.sub(r"[^/]+/\.\./", "", f"{folder}/{t}")
            return {r.get("Id"): full(r.get("Target")) for r in ET.fromstring(z.read(rels))}

        sheets = links("xl/workbook.xml")
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_X}sheet"):
            part = sheets.get(sheet.get(f"{_R}id"))
            if part not in names:
                continue
            cells = {}
            for c in ET.fromstring(z.read(part)).iter(f"{_X}c"):
                value, kind = c.find(f"{_X}v"), c.get("t")
                if kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{_X}t"))
                elif value is None or value.text is None:
                    continue
                else:
                    text = shared[int(value.text)] if kind == "s" else {"1": "True", "0": "False"}.get(value.text, value.text) if kind == "b" else value.text
                cells[_cell(c.get("r"))] = text
            tables = [ET.fromstring(z.read(t)) for t in links(part).values() if "/tables/" in t and t in names]
            out.append((sheet.get("name"), cells, [(t.get("displayName") or t.get("name"), t.get("ref")) for t in tables]))
    return out


def xlsx_markdown(content: bytes) -> str:
    """A table for each sheet, without its empty rows."""
    if not safe_archive(content):
        return ""
    lines = []
    for name, cells, _ in _workbook(content):
        if cells:
            width = max(c for _, c in cells) + 1
            rows = [[cells.get((r, c), "") for c in range(width)] for r in sorted({r for r, _ in cells})]
            lines += [f"## Sheet: {name}", *_table(rows)]
    return "\n".join(lines)


def xlsx_structure(path: str, content: bytes) -> list[tuple]:
    """Rows of :data:`STRUCTURE`: the file's sheets, their named tables and those tables' columns."""
    if not safe_archive(content):
        return []
    fid, stem = normalize_id_py(path), path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    rows, seen = [("node", fid, path.rsplit("/", 1)[-1], None, None)], {fid}

    def under(parent: str, label: str, *parts: str) -> str:
        nid = make_id_py(stem, *parts)
        if nid not in seen:
            seen.add(nid)
            rows.append(("node", nid, label, None, None))
        rows.append(("edge", nid, None, parent, "contains"))
        return nid

    for name, cells, tables in _workbook(content):
        sheet = under(fid, f"{name} (sheet)", name)
        for table, ref in tables:
            tid = under(sheet, table, name, table)
            (top, left), (_, right) = (_cell(x) for x in (ref.split(":") * 2)[:2])
            for c in range(left, right + 1):
                if cells.get((top, c)):
                    under(tid, cells[top, c], table, cells[top, c])
    return rows


_STREAM = re.compile(rb"<<((?:[^<>]|<<[^<>]*>>|<[0-9A-Fa-f\s]*>)*)>>\s*stream\r?\n(.*?)\r?\n?endstream", re.S)
_SHOWN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]+>|-?\d+\.?\d*(?=\s*[(<\]])|\bT(?:\*|[jJdDm]\b)|['\"](?=\s)|\bET\b", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(raw: bytes) -> str:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        data = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1][-1:] == b"\n" else _ESCAPES.get(m[1], m[1]), raw[1:-1], flags=re.S)
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("cp1252", "replace")


def pdf_text(content: bytes) -> str:
    """Text of a PDF's content streams in their order, plain or deflated. Fonts with encodings of
    their own, encrypted files and scanned pages give nothing."""
    if len(content) > MOST_BYTES or not content.startswith(b"%PDF") or b"/Encrypt" in content:
        return ""
    pages, left = [], MOST_UNPACKED
    for m in _STREAM.finditer(content):
        data = m[2]
        if b"/FlateDecode" in m[1]:
            try:
                data = zlib.decompressobj().decompress(data, left)
            except zlib.error:
                continue
        left -= len(data)
        if left <= 0:
            break
        if b"BT" not in data or b"Tj" not in data and b"TJ" not in data:
            continue
        out, line = [], []
        for t in _SHOWN.findall(data):
            if t[:1] in b"(<":
                line.append(_pdf_string(t))
            elif t in (b"T*", b"Td", b"TD", b"Tm", b"ET", b"'", b'"'):
                out += ["".join(line)] if line else []
                line = []
            elif re.fullmatch(rb"-\d+\.?\d*", t) and float(t) < -200:  # a wide gap in an array of strings
                line.append(" ")
        pages.append("\n".join(x for x in [*out, "".join(line)] if x.strip()))
    return "\n".join(p for p in pages if p)


READERS: dict[str, Callable[[bytes], str]] = {".pdf": pdf_text, ".docx": docx_markdown, ".xlsx": xlsx_markdown}


def _suffix(path: str) -> str:
    return "." + path.rsplit(".", 1)[-1].lower()


def document_text(files: DataFrame) -> DataFrame:
    """(path, text) of (path, content): PDF, docx and xlsx files; '' for what can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for path, content in zip(b.path, b.content):
                try:
                    texts.append(READERS[_suffix(path)](content))
                except Exception:  # a broken file says nothing
                    texts.append("")
            yield pd.DataFrame({"path": b.path, "text": texts})

    picked = files.where("content IS NOT NULL").where(F.lower("path").rlike(r"\.(pdf|docx|xlsx)$"))
    return picked.select("path", "content").mapInPandas(run, "path string, text string")


def sidecars(files: DataFrame) -> DataFrame:
    """(path, sidecar, text): the Markdown file that stands in for each office file; its name
    depends on the path only, so that an unchanged file keeps its sidecar."""
    stem = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
    nfc = F.pandas_udf(lambda s: s.map(lambda x: hashlib.sha256(unicodedata.normalize("NFC", x).encode()).hexdigest()[:8]), "string")
    rows = document_text(files).where("trim(text) <> ''").where(~F.lower("path").endswith(".pdf"))
    text = F.concat(F.lit("<!-- converted from "), F.regexp_extract("path", "[^/]*$", 0), F.lit(" -->\n\n"), "text")
    return rows.select("path", F.concat(stem, F.lit("_"), nfc("path"), F.lit(".md")).alias("sidecar"), text.alias("text"))


def workbook_structure(files: DataFrame) -> DataFrame:
    """Rows of :data:`STRUCTURE` for all workbooks; one that can't be read gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b.path, b.content):
                try:
                    rows += [(path, *r) for r in xlsx_structure(path, content)]
                except Exception:
                    continue
            yield pd.DataFrame(rows, columns=["path", "kind", "id", "label", "source", "relation"])

    return files.where("content IS NOT NULL").where(F.lower("path").endswith(".xlsx")).select("path", "content").mapInPandas(run, STRUCTURE)
