"""Chunkers and symbol extraction for source files: text in, rows out.

A chunker is a function of a file's text that yields ``Piece``s. Brace languages
share one scanner that finds declarations by a table of patterns and their ends
by matching braces outside strings and comments; it is an outline, not a parser.
``chunk_files`` runs them over a table of files by extension.
"""

from __future__ import annotations

import io
import json
import re
import textwrap
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import ship

ship(__name__)

MAX_TOKENS, OVERLAP = 600, 0.15
SCHEMA = "file_id long, ordinal int, kind string, label string, start_line int, end_line int, tokens int, content string"


@dataclass
class Piece:
    kind: str
    label: str | None
    start: int  # lines count from 1
    end: int
    text: str


def tokens_of(text: str) -> int:
    """The blended estimate: characters over 4.1, or a blend with 0.75 tokens a word if that is more."""
    if not text:
        return 0
    chars = len(text) / 4.1
    return max(1, min(120_000, int(max(chars, 0.6 * chars + 0.4 * 0.75 * len(text.split())) + 0.5)))


def split_lines(piece: Piece, most: int = MAX_TOKENS, overlap: float = OVERLAP) -> Iterator[Piece]:
    """A piece above ``most`` tokens as windows of whole lines; neighbours share a part of ``overlap``."""
    lines, total = piece.text.split("\n"), tokens_of(piece.text)
    if total <= most or len(lines) < 2:
        yield piece
        return
    size = max(1, int(most * len(lines) / total))
    shared, at = max(1, int(size * overlap)), 0
    while at < len(lines):
        end = min(len(lines), at + size)
        while end - at > 1 and tokens_of("\n".join(lines[at:end])) > most:
            end -= 1
        yield Piece(piece.kind, piece.label, piece.start + at, piece.start + end - 1, "\n".join(lines[at:end]))
        if end == len(lines):
            return
        at = max(end - shared, at + 1)


# ---- text ----


def plain_text(text: str) -> Iterator[Piece]:
    """Paragraphs between blank lines; long ones by sentences, then words, then characters."""
    limit = MAX_TOKENS * 4
    for m in re.finditer(r"(?:(?!\n[^\S\n]*\n).)+", text.strip("\n"), re.DOTALL):
        body, first = m[0].strip(), text.lstrip("\n")[: m.start()].count("\n") + 1 + (len(text) - len(text.lstrip("\n")))
        if not body:
            continue
        first += len(m[0]) - len(m[0].lstrip("\n"))
        last = first + body.count("\n")
        if len(body) // 4 <= MAX_TOKENS:
            yield Piece("PARAGRAPH", None, first, last, body)
            continue
        units = [u for s in re.split(r"(?<=[.!?])\s+", body) for u in ([s] if len(s) <= limit else textwrap.wrap(s, limit))]
        held = ""
        for u in units:
            if held and len(held) + 1 + len(u) > limit:
                yield Piece("PARAGRAPH", None, first, last, held)
                held = u
            else:
                held = f"{held} {u}" if held else u
        yield Piece("PARAGRAPH", None, first, last, held)


def markdown(text: str, most: int = 400) -> Iterator[Piece]:
    """A section for each heading of level 1 to 6, a block for each fence; long sections end at their last blank line."""
    lines, held, label, fence = text.split("\n"), [], None, None

    def section() -> Iterator[Piece]:
        rest = list(held)
        while rest:
            take = len(rest)
            while take > 1 and tokens_of("\n".join(x for _, x in rest[:take])) > most:
                blank = [k for k in range(1, take - 1) if not rest[k][1].strip()]
                take = blank[-1] if blank else take - 1
            part = rest[:take]
            body = "\n".join(x for _, x in part)
            if body.strip():
                yield Piece("MARKDOWN_SECTION", label, part[0][0], part[-1][0], body)
            rest = rest[take:]

    for n, line in enumerate(lines, 1):
        mark = re.match(r"\s*(`{3,}|~{3,})", line)
        if fence:
            fence[1].append((n, line))
            if mark and mark[1][0] == fence[0][0] and len(mark[1]) >= len(fence[0]) and not line.strip().strip("`~"):
                yield Piece("CODE_BLOCK", label, fence[1][0][0], n, "\n".join(x for _, x in fence[1]))
                fence = None
            continue
        heading = re.match(r"\s*(#{1,6})(?!#)\s*(\S.*?)\s*$", line)
        if heading or mark:
            yield from section()
            held = []
        if heading:
            label = heading[2]
        if mark:
            fence = (mark[1], [(n, line)])
        else:
            held.append((n, line))
    yield from section()
    if fence:
        yield Piece("CODE_BLOCK", label, fence[1][0][0], fence[1][-1][0], "\n".join(x for _, x in fence[1]))


# ---- indentation: Python ----

_PY_DECLARES = re.compile(r"(\s*)(?:(class)|(?:async\s+)?def)\s+([A-Za-z_]\w*)")


def python(text: str) -> Iterator[Piece]:
    """Docstrings, functions and classes with their decorators; what stands between is a block."""
    yield from _python_level(text.split("\n"), 1, True)


def _docstring(lines: list[str], at: int) -> int | None:
    """The line behind a docstring that starts at ``at``."""
    m = re.match(r"\s*[rRuUbB]{0,2}(\"\"\"|''')", lines[at]) if at < len(lines) else None
    if not m:
        return None
    if lines[at][m.end() :].count(m[1]):
        return at + 1
    return next((k + 1 for k in range(at + 1, len(lines)) if m[1] in lines[k]), None)


def _python_level(lines: list[str], first: int, module: bool) -> Iterator[Piece]:
    at, loose = 0, []

    def block() -> Iterator[Piece]:
        if any(x.strip() for _, x in loose):
            yield from split_lines(Piece("CODE_BLOCK", None, first + loose[0][0], first + loose[-1][0], "\n".join(x for _, x in loose)))

    start = next((k for k, x in enumerate(lines) if x.strip() and not x.lstrip().startswith("#")), len(lines))
    end = _docstring(lines, start)
    if end:
        yield Piece("DOCSTRING", None, first + start, first + end - 1, "\n".join(lines[start:end]))
        at = end
    while at < len(lines):
        top = at
        while top < len(lines) and lines[top].lstrip().startswith("@"):
            top += 1
        m = _PY_DECLARES.match(lines[top]) if top < len(lines) else None
        if not m:
            loose.append((at, lines[at]))
            at += 1
            continue
        yield from block()
        loose = []
        depth, stop = len(m[1]), top + 1
        while stop < len(lines) and (not lines[stop].strip() or len(lines[stop]) - len(lines[stop].lstrip()) > depth or re.match(r"\s*[)\]]", lines[stop])):
            stop += 1
        while not lines[stop - 1].strip():
            stop -= 1
        kind = "CODE_CLASS" if m[2] else "CODE_FUNCTION"
        yield from split_lines(Piece(kind, m[3], first + at, first + stop - 1, "\n".join(lines[at:stop])))
        if m[2]:  # methods of a class get pieces of their own
            yield from _python_level(lines[top + 1 : stop], first + top + 1, False)
        else:
            body = next((k for k in range(top, stop) if lines[k].rstrip().endswith(":")), top) + 1
            inner = _docstring(lines, body)
            if inner and body < stop:
                yield Piece("DOCSTRING", m[3], first + body, first + inner - 1, "\n".join(lines[body:inner]))
        at = stop
    if module or len(loose) < len(lines):
        yield from block()


# ---- braces: Java, Kotlin, C#, TypeScript ----

_TYPES = {"class": "CODE_CLASS", "record": "CODE_CLASS", "struct": "CODE_CLASS", "object": "CODE_CLASS", "interface": "CODE_INTERFACE", "enum": "CODE_ENUM", "type": "CODE_INTERFACE"}
_WORDS = r"(?:(?:public|private|protected|internal|static|final|abstract|open|sealed|data|override|suspend|inline|async|export|default|declare|partial|readonly|virtual|const|companion|annotation|value)\s+)*"
_TYPE = re.compile(rf"\s*{_WORDS}(enum\s+class|class|record|struct|object|interface|enum|type)\s+([A-Za-z_$][\w$]*)")
_FUNCTION = {
    "kotlin": re.compile(rf"\s*{_WORDS}fun\s+(?:<[^>]+>\s*)?(?:[\w<>?]+\.)?([A-Za-z_]\w*)\s*\("),
    "typescript": re.compile(rf"\s*{_WORDS}(?:function\s*\*?\s*([A-Za-z_$][\w$]*)|(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>)"),
    "c": re.compile(rf"\s*{_WORDS}(?:(?P<type>[\w<>\[\],.?]+)\s+)?(?P<name>[A-Za-z_]\w*)\s*\([^;]*$|\s*{_WORDS}[\w<>\[\],.? ]+\s+(?P<one>[A-Za-z_]\w*)\s*\([^;]*\)\s*(?:throws [\w, .]+)?\{{"),
}
_STATEMENT = re.compile(r"\s*(?:if|for|while|switch|catch|return|new|throw|else|try|do|using|lock|foreach|synchronized)\b")
_HEADER = re.compile(r"\s*(?:package|import|using|namespace)\b")


def _depths(lines: list[str]) -> list[int]:
    """The brace depth behind each line, strings and comments left out."""
    out, depth, comment = [], 0, False
    for line in lines:
        k, quote = 0, ""
        while k < len(line):
            two, c = line[k : k + 2], line[k]
            if comment:
                comment, k = (False, k + 1) if two == "*/" else (True, k)
            elif quote:
                k, quote = (k + 1, quote) if c == "\\" else (k, "" if c == quote else quote)
            elif two == "//":
                break
            elif two == "/*":
                comment, k = True, k + 1
            elif c in "\"'`":
                quote = c
            else:
                depth += (c == "{") - (c == "}")
            k += 1
        out.append(depth)
    return out


def _end(lines: list[str], depths: list[int], at: int, floor: int) -> int:
    """The last line of a declaration: where its braces close, or where it ends without any."""
    opened = False
    for k in range(at, len(lines)):
        opened = opened or depths[k] > floor or "{" in lines[k]
        if opened and depths[k] <= floor:
            return k
        if not opened and (lines[k].rstrip().endswith(";") or (k > at and not lines[k].strip())):
            return k if lines[k].strip() else k - 1
    return len(lines) - 1


def braces(language: str) -> Callable[[str], Iterator[Piece]]:
    pattern = _FUNCTION[language if language in _FUNCTION else "c"]

    def chunk(text: str) -> Iterator[Piece]:
        lines = text.split("\n")
        depths = _depths(lines)
        head = [k for k, x in enumerate(lines) if _HEADER.match(x) and (depths[k - 1] if k else 0) == 0]
        if head and language != "typescript":
            yield from split_lines(Piece("CODE_HEADER", None, head[0] + 1, head[-1] + 1, "\n".join(lines[k] for k in head)), 200)
        found = list(level(lines, depths, 0, len(lines) - 1, 0, None))
        if language == "typescript":
            imports = [lines[k] for k in head]
            for p in found:  # imports go with each piece they fit in
                joined = "\n".join([*imports, "", p.text])
                fits = imports and tokens_of(joined) <= MAX_TOKENS
                yield from split_lines(Piece(p.kind, p.label, p.start, p.end, joined if fits else p.text))
            if not found and text.strip():
                yield from split_lines(Piece("CODE_BLOCK", None, 1, len(lines), text))
            return
        for p in found:
            yield from split_lines(p)

    def level(lines, depths, lo, hi, floor, owner) -> Iterator[Piece]:
        at = lo
        while at <= hi:
            line, before = lines[at], depths[at - 1] if at else 0
            kind = label = None
            if before == floor and re.match(r"\s*namespace\b[^;]*$", line):
                stop = min(hi, _end(lines, depths, at, floor))
                yield from level(lines, depths, at + 1, stop, floor + 1, None)
                at = stop + 1
                continue
            if before == floor:
                if m := _TYPE.match(line):
                    kind, label = _TYPES[m[1].split()[0]], m[2]
                elif not _STATEMENT.match(line) and not _HEADER.match(line) and (m := pattern.match(line)):
                    names = [g for g in (m.groupdict().get("name"), m.groupdict().get("one"), *m.groups()) if g]
                    label = names[0]
                    kind = "CODE_CONSTRUCTOR" if label == owner else "CODE_METHOD" if owner else "CODE_FUNCTION"
            if not kind:
                at += 1
                continue
            stop, top = min(hi, _end(lines, depths, at, floor)), at
            while top > lo and re.match(r"\s*(?:@|\[|//|/?\*|\*)", lines[top - 1]):  # comments and annotations above
                top -= 1
            yield Piece(kind, label, top + 1, stop + 1, "\n".join(lines[top : stop + 1]))
            if kind in ("CODE_CLASS", "CODE_INTERFACE", "CODE_ENUM") and language != "typescript":
                yield from level(lines, depths, at + 1, stop, floor + 1, label)
            at = stop + 1

    return chunk


# ---- data: JSON, YAML, SQL ----


def json_text(text: str) -> Iterator[Piece]:
    """A piece for each top-level key or element; larger ones are split along their keys; ``root`` if it does not parse."""
    n = text.count("\n") + 1
    try:
        value = json.loads(text)
    except ValueError:
        if text.strip():
            yield Piece("JSON_BLOCK", "root", 1, n, text)
        return

    def walk(v, label: str) -> Iterator[Piece]:
        body = json.dumps(v, indent=2, ensure_ascii=False)
        if tokens_of(body) > MAX_TOKENS and isinstance(v, dict | list) and v:
            items = v.items() if isinstance(v, dict) else enumerate(v)
            for k, x in items:
                yield from walk(x, f"{label}.{k}" if isinstance(v, dict) else f"{label}[{k}]")
        else:
            yield Piece("JSON_BLOCK", label, 1, n, body)

    if isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, k)
    elif isinstance(value, list):
        for k, v in enumerate(value):
            yield from walk(v, f"[{k}]")
    else:
        yield Piece("JSON_BLOCK", "root", 1, n, text)


def yaml_text(text: str, first: int = 1, path: str = "") -> Iterator[Piece]:
    """A piece for each key or list item of the lowest indentation; larger ones are split along theirs."""
    lines = text.split("\n")
    real = [x for x in lines if x.strip() and not x.lstrip().startswith("#") and x.strip() != "---"]
    if not real:
        return
    depth = min(len(x) - len(x.lstrip()) for x in real)
    opener = re.compile(rf"\s{{{depth}}}(?:(-)(?:\s|$)|([^\s#:][^:]*?)\s*:(?:\s|$))")
    starts = [k for k, x in enumerate(lines) if opener.match(x)]
    if not starts:
        yield Piece("YAML_BLOCK", path or "root", first, first + len(lines) - 1, text)
        return
    item = 0
    for a, b in zip(starts, [*starts[1:], len(lines)], strict=True):
        m = opener.match(lines[a])
        name, item = (f"{path}[{item}]", item + 1) if m[1] else (f"{path}.{m[2]}" if path else m[2].strip("\"'"), item)
        body = "\n".join(lines[a:b]).rstrip()
        inner = "\n".join(lines[a + 1 : b])
        if tokens_of(body) > MAX_TOKENS and inner.strip():
            yield from yaml_text(inner, first + a + 1, name)
        else:
            yield Piece("YAML_BLOCK", name, first + a, first + a + body.count("\n"), body)


_SQL_TOKEN = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/|\$\$.*?\$\$|;|\b(?:BEGIN|CASE|END)\b", re.DOTALL | re.IGNORECASE)
_SQL_ROUTINE = re.compile(r"\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:FUNCTION|PROCEDURE|TRIGGER)\b", re.IGNORECASE)
_SQL_LABEL = re.compile(
    r"(?:(?:CREATE|DROP)\s+(?:OR\s+REPLACE\s+)?(?:TABLE|VIEW|INDEX|PROCEDURE|FUNCTION|TRIGGER)\s+(?:IF\s+(?:NOT\s+)?EXISTS\s+)?|ALTER\s+TABLE\s+|INSERT\s+INTO\s+|UPDATE\s+|DELETE\s+FROM\s+)(\w+)", re.IGNORECASE
)


def sql_text(text: str) -> Iterator[Piece]:
    """A piece for each statement with the comments before it; BEGIN ... END bodies of routines stay whole."""
    at, depth = 0, 0

    def piece(a: int, b: int) -> Iterator[Piece]:
        body = text[a:b].strip()
        bare = re.sub(r"/\*.*?\*/|--[^\n]*", "", body, flags=re.DOTALL).strip(" \n\t;")
        if bare:
            m, raw = _SQL_LABEL.match(bare), text[a:b]
            start = text[:a].count("\n") + 1 + raw[: len(raw) - len(raw.lstrip())].count("\n")
            yield Piece("SQL_STATEMENT", " ".join(m[0].split()) if m else bare.split()[0].upper(), start, start + body.count("\n"), body)

    for m in _SQL_TOKEN.finditer(text):
        word = m[0].upper()
        routine = _SQL_ROUTINE.search(text, at, m.start())
        if word in ("BEGIN", "CASE") and routine:
            depth += 1
        elif word == "END" and depth:
            depth -= 1
        elif word == ";" and not depth:
            yield from piece(at, m.end())
            at = m.end()
    yield from piece(at, len(text))


BY_EXTENSION: dict[str, Callable[[str], Iterator[Piece]]] = {
    **dict.fromkeys(("txt", "doc", "docx", "pdf"), plain_text),
    "md": markdown, "py": python, "json": json_text, "yaml": yaml_text, "yml": yaml_text, "sql": sql_text, "java": braces("java"), "cs": braces("csharp"),
    "kt": braces("kotlin"), "kts": braces("kotlin"), **{e: braces("typescript") for e in ("ts", "tsx", "js", "jsx")},
}


def chunk_text(text: str, extension: str) -> list[tuple]:
    """(ordinal, kind, label, start_line, end_line, tokens, content) of one file; blank files have none."""
    if not text or not text.strip():
        return []
    pieces = [p for p in BY_EXTENSION.get(extension.lower(), plain_text)(text) if p.text.strip()]
    return [(k, p.kind, p.label, p.start, max(p.start, p.end), max(1, tokens_of(p.text)), p.text) for k, p in enumerate(pieces)]


def chunk_files(files: DataFrame) -> DataFrame:
    """Chunks of (file_id, path, content) by the extension of the path."""

    def run(batches):
        for b in batches:
            rows = [(i, *c) for i, p, t in zip(b.file_id, b.path, b.content, strict=True) for c in chunk_text(t, p.rsplit(".", 1)[-1])]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in SCHEMA.split(", ")])

    return files.select("file_id", "path", "content").mapInPandas(run, SCHEMA)


# ---- symbols ----

_SYMBOLS = {
    "py": [("CLASS", r"\s*class\s+(\w+)"), ("FUNCTION", r"\s*(?:async\s+)?def\s+(\w+)"), ("IMPORT", r"\s*(?:from\s+([\w.]+)\s+)?import\s+([\w.]+)")],
    "kt": [("CLASS", rf"\s*{_WORDS}(?:enum\s+)?(?:class|object)\s+(\w+)"), ("INTERFACE", rf"\s*{_WORDS}interface\s+(\w+)"), ("FUNCTION", rf"\s*{_WORDS}fun\s+(?:<[^>]+>\s*)?(\w+)"), ("PROPERTY", rf"\s*{_WORDS}va[lr]\s+(\w+)"), ("IMPORT", r"\s*import\s+([\w.*]+)")],
    "java": [("CLASS", rf"\s*{_WORDS}class\s+(\w+)"), ("INTERFACE", rf"\s*{_WORDS}interface\s+(\w+)"), ("ENUM", rf"\s*{_WORDS}enum\s+(\w+)"), ("METHOD", rf"\s+{_WORDS}[\w<>\[\], ]+\s+(\w+)\s*\([^;]*\{{"), ("IMPORT", r"\s*import\s+(?:static\s+)?([\w.*]+)")],
    "ts": [("CLASS", rf"\s*{_WORDS}class\s+(\w+)"), ("INTERFACE", rf"\s*{_WORDS}interface\s+(\w+)"), ("FUNCTION", rf"\s*{_WORDS}function\s+(\w+)"), ("VARIABLE", r"(?:export\s+)?const\s+(\w+)"), ("IMPORT", r"import\s+.*\s+from\s+['\"](.+?)['\"]")],
}
_SYMBOLS |= {"kts": _SYMBOLS["kt"], "tsx": _SYMBOLS["ts"], "js": _SYMBOLS["ts"], "jsx": _SYMBOLS["ts"]}


def symbols_of(text: str, extension: str) -> list[tuple[str, str, str, int]]:
    """(type, name, qualified name, line); owners are the types of lesser indentation above. Other files: their first 20 identifiers."""
    table = _SYMBOLS.get(extension.lower())
    if not table:
        names = dict.fromkeys(re.findall(r"\b[A-Za-z_]\w{2,}\b", text))
        return [("VARIABLE", n, n, 1) for n in list(names)[:20]]
    out, owners = [], []
    for n, line in enumerate(io.StringIO(text), 1):
        depth = len(line) - len(line.lstrip())
        for kind, pattern in table:
            m = re.match(pattern, line)
            if not m:
                continue
            name = ".".join(g for g in m.groups() if g)
            if kind != "IMPORT":
                owners = [(d, o) for d, o in owners if d < depth]
                if kind == "FUNCTION" and owners:
                    kind = "METHOD"
            out.append((kind, name, name if kind == "IMPORT" else ".".join([*[o for _, o in owners], name]), n))
            if kind in ("CLASS", "INTERFACE", "ENUM"):
                owners.append((depth, name))
            break
    return out


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of (file_id, path, content)."""
    schema = "file_id long, symbol_type string, name string, qualified_name string, start_line int"

    def run(batches):
        for b in batches:
            rows = [(i, *s) for i, p, t in zip(b.file_id, b.path, b.content, strict=True) for s in symbols_of(t or "", p.rsplit(".", 1)[-1])]
            yield pd.DataFrame(rows, columns=["file_id", "symbol_type", "name", "qualified_name", "start_line"])

    return files.select("file_id", "path", "content").mapInPandas(run, schema)


def with_path(df: DataFrame, key: str, content: str, extension: str) -> DataFrame:
    return df.select(F.col(key).alias("file_id"), F.concat(F.col(key).cast("string"), F.lit(f".{extension}")).alias("path"), F.col(content).alias("content"))
