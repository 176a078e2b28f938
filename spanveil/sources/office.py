"""DOCX text in and out, and what a PDF holds, from `binaryFile` content, with the standard library."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# Limits of an archive.
MAX_ARCHIVE, MAX_ENTRY, MAX_ENTRIES, MAX_BLOCKS = 64 << 20, 16 << 20, 4096, 100_000
PARTS = re.compile(r"word/(?:document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml$")


def open_docx(content: bytes) -> tuple[zipfile.ZipFile, list[str]]:
    if len(content) > MAX_ARCHIVE:
        raise ValueError("archive-too-large")
    z = zipfile.ZipFile(io.BytesIO(content))
    if len(z.infolist()) > MAX_ENTRIES or any(i.file_size > MAX_ENTRY for i in z.infolist()):
        raise ValueError("entry-limit")
    return z, sorted(n for n in z.namelist() if PARTS.match(n))


def paragraph_text(p: ET.Element) -> str:
    out = []
    for e in p.iter():
        out.append({f"{W}tab": "\t", f"{W}br": "\n"}.get(e.tag, e.text or "" if e.tag == f"{W}t" else ""))
    return "".join(out)


def docx_blocks(content: bytes) -> list[tuple[str, int, str, str]]:
    """(part, pos, block_id, text) of every paragraph."""
    z, parts = open_docx(content)
    out = []
    for part in parts:
        for i, p in enumerate(ET.fromstring(z.read(part)).iter(f"{W}p")):
            out.append((part, i, f"{part}#{i}", paragraph_text(p)))
            if len(out) > MAX_BLOCKS:
                raise ValueError("block-limit")
    return out


def rewrite_docx(content: bytes, changes: dict[str, tuple[str, str]]) -> bytes:
    """The archive with block texts replaced; changes: block_id to (expected text, new text). A stale text is an error."""
    z, parts = open_docx(content)
    new: dict[str, bytes] = {}
    for part in parts:
        root = ET.fromstring(z.read(part))
        touched = False
        for i, p in enumerate(root.iter(f"{W}p")):
            want = changes.get(f"{part}#{i}")
            if not want:
                continue
            if paragraph_text(p) != want[0]:
                raise ValueError("stale-text")
            runs = [t for t in p.iter(f"{W}t")]
            for e in [*p.iter()]:
                for child in [c for c in e if c.tag in (f"{W}tab", f"{W}br")]:
                    e.remove(child)
            for k, t in enumerate(runs):
                t.text = want[1] if k == 0 else ""
                t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
            touched = True
        if touched:
            new[part] = ET.tostring(root, xml_declaration=True, encoding="UTF-8")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        for info in z.infolist():
            w.writestr(info, new.get(info.filename, z.read(info.filename)))
    return out.getvalue()


def extract_docx(files: DataFrame) -> DataFrame:
    """path, part, pos, block_id, text, error of `binaryFile` rows (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(path, *b, None) for b in docx_blocks(bytes(content))]
                except (ValueError, zipfile.BadZipFile, ET.ParseError) as e:
                    rows.append((path, None, None, None, None, str(e) if isinstance(e, ValueError) else "not-a-docx"))
            yield pd.DataFrame(rows, columns=["path", "part", "pos", "block_id", "text", "error"]).astype({"pos": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, part string, pos int, block_id string, text string, error string")


def pdf_facts(content: bytes) -> dict:
    """What a PDF holds, by its markers: pages, images, forms, scripts, attachments, encryption, and whether text coverage is full."""
    if not content.startswith(b"%PDF-"):
        return {"valid": False, "pages": 0, "images": 0, "forms": False, "scripts": False, "attachments": False, "encrypted": False, "coverage": "none"}
    has = lambda pattern: re.search(pattern, content) is not None
    images = len(re.findall(rb"/Subtype\s*/Image\b", content))
    opaque = has(rb"/Type\s*/ObjStm\b") or has(rb"/Encrypt\b")
    return {"valid": True, "pages": len(re.findall(rb"/Type\s*/Page\b(?!s)", content)), "images": images, "forms": has(rb"/AcroForm\b"), "scripts": has(rb"/(?:JS|JavaScript)\b"), "attachments": has(rb"/EmbeddedFile\b"), "encrypted": has(rb"/Encrypt\b"), "coverage": "partial" if opaque or images else "full"}


def inspect_pdf(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([{"path": p} | pdf_facts(bytes(c)) for p, c in zip(pdf["path"], pdf["content"], strict=True)], columns=["path", "valid", "pages", "images", "forms", "scripts", "attachments", "encrypted", "coverage"])

    return files.select("path", "content").mapInPandas(run, "path string, valid boolean, pages int, images int, forms boolean, scripts boolean, attachments boolean, encrypted boolean, coverage string")
