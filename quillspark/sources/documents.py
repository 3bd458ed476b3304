"""Text of Word and PDF files, by the standard library: paragraphs of .docx, text operators of PDF content streams."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.session import ship

ship(__name__)

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", re.DOTALL)
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\bT(?:[dDm]\b|\*)|'|\bET\b", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}


def word_text(raw: bytes) -> str | None:
    """The paragraphs of a .docx file, one line each, tables cell by cell; None if it is not one."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as parts:
            root = ElementTree.fromstring(parts.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n"}
    lines = ["".join(e.text or "" if e.tag == f"{_W}t" else marks.get(e.tag, "") for e in p.iter()) for p in root.iter(f"{_W}p")]
    return "\n".join(lines)


def _string(raw: bytes) -> str:
    if raw[:1] == b"<":
        return bytes.fromhex(re.sub(rb"\s", b"", raw[1:-1]).decode().ljust(2, "0")).decode("latin-1")
    plain = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], m[1]), raw[1:-1], flags=re.DOTALL)
    return plain.decode("latin-1")


def pdf_text(raw: bytes) -> str | None:
    """The strings that a PDF's plain or deflated content streams show, a line for each move; None if it is not a PDF.

    Fonts with encodings of their own, and encrypted files, are not decoded.
    """
    if not raw.startswith(b"%PDF"):
        return None
    out = []
    for head, body in _STREAM.findall(raw):
        if b"/FlateDecode" in head:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        for block in re.findall(rb"\bBT\b(.*?\bET\b)", body, re.DOTALL):
            line = ""
            for token in _SHOWN.findall(block):
                if token[:1] in b"(<":
                    line += _string(token)
                elif line:
                    out.append(line)
                    line = ""
    return "\n".join(out)


EXTRACTORS = {"docx": word_text, "pdf": pdf_text}


def extracted(files: DataFrame) -> DataFrame:
    """(path, text, problem) of binary files (path, content) by extension; files of other kinds, and unreadable ones, tell the problem."""

    def read(path: str, content: bytes | None) -> tuple[str | None, str | None]:
        kind = path.rsplit(".", 1)[-1].lower()
        if kind not in EXTRACTORS:
            return None, f"no extractor for .{kind}"
        text = EXTRACTORS[kind](content or b"")
        return (text, None) if text is not None else (None, f"not a readable .{kind}")

    def run(batches):
        for b in batches:
            paths = b.column(0).to_pylist()
            found = [read(p, c.as_py()) for p, c in zip(paths, b.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], ["path", "text", "problem"])

    return files.select("path", "content").mapInArrow(run, "path string, text string, problem string")
