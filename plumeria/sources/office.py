"""Texts of office files without added libraries: OOXML documents as a stream of XML, RTF by a stack of groups."""

from __future__ import annotations

import io
import os
import re
import zipfile
from xml.etree import ElementTree

# The messages that stand for a text.
EMPTY_TEXT, EMPTY_DOCX, EMPTY_RTF = "[EMPTY TEXT FILE]", "[EMPTY DOCX FILE]", "[EMPTY RTF FILE]"
#: Bytes of XML that a document may unpack to.
MOST_XML = 500_000_000

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_MARKS = {f"{_W}tab": "\t", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "-"}


def docx_text(content: bytes, tables: bool = False) -> str:
    """The paragraphs of a document's body, one a line; those in text boxes are left out, and those in tables unless ``tables``.

    Then cells are parted by a tab and each row is a line. The XML is read as a stream, and what was read is let go.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        info = z.getinfo("word/document.xml")
        if info.file_size > MOST_XML:
            raise ValueError(f"the document unpacks to {info.file_size} bytes")
        with z.open(info) as f:
            return "\n".join(_paragraphs(f, tables))


def _paragraphs(f, tables: bool):
    skipped = {f"{_W}txbxContent"} | (set() if tables else {f"{_W}tbl"})
    hidden, rows = 0, []  # rows: for each open table, the cells of its row, each a list of paragraphs
    text: list[str] = []
    for event, e in ElementTree.iterparse(f, ("start", "end")):
        tag = e.tag
        if tag in skipped:
            hidden += 1 if event == "start" else -1
        elif hidden:
            pass
        elif event == "start":
            if tag == f"{_W}p":
                text = []
            elif tag == f"{_W}tr":
                rows.append([])
            elif tag == f"{_W}tc" and rows:
                rows[-1].append([])
        elif tag == f"{_W}t":
            text.append(e.text or "")
        elif tag in _MARKS and e.get(f"{_W}val") is None:  # tabs of a style have a value
            text.append(_MARKS[tag])
        elif tag == f"{_W}br":
            text.append("\n" if e.get(f"{_W}type", "textWrapping") == "textWrapping" else "")
        elif tag in (f"{_W}p", f"{_W}tr"):
            done = "".join(text) if tag == f"{_W}p" else "\t".join(" ".join(c) for c in rows.pop())
            if rows and rows[-1]:
                rows[-1][-1].append(done)
            else:
                yield done
        if event == "end" and tag in (f"{_W}p", f"{_W}tbl", f"{_W}tr"):
            e.clear()


_RTF = re.compile(rb"\\([a-zA-Z]{1,32})(-?[0-9]{1,10})? ?|((?:\\'[0-9a-fA-F]{2})+)|\\([^a-zA-Z])|([{}])|([^\\{}\r\n]+)|[\r\n]+|\\", re.S)
# Fixed values of the format: what control words stand for, groups that hold no text, and the code pages of character sets.
_WORDS = {
    "par": "\n", "line": "\n", "sect": "\n\n", "page": "\n\n", "row": "\n", "cell": "|", "nestrow": "\n", "nestcell": "|", "tab": "\t",
    "emdash": "—", "endash": "–", "emspace": " ", "enspace": " ", "qmspace": " ", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”",
}
_SILENT = frozenset("fonttbl colortbl stylesheet info pict object header headerl headerr headerf footer footerl footerr footerf footnote listtable rsidtbl xmlnstbl themedata fldinst".split())
_CHARSETS = {0: 1252, 77: 10000, 128: 932, 129: 949, 134: 936, 136: 950, 161: 1253, 162: 1254, 163: 1258, 177: 1255, 178: 1256, 186: 1257, 204: 1251, 222: 874, 238: 1250, 254: 437}
_SYMBOLS = {b"~": "\xa0", b"_": "-", b"\n": "\n", b"\r": "\n", b"\\": "\\", b"{": "{", b"}": "}"}


def _codec(page: int) -> str:
    return {65001: "utf-8", 10000: "mac_roman"}.get(page, f"cp{page}")


def rtf_text(content: bytes) -> str:
    """The text of an RTF file: escapes in the code page of their font, else of the file; ``\\u`` with its substitutes skipped.

    Groups without text (tables of fonts and the like, pictures, headers, footnotes, those marked ``\\*``) are left out.
    """
    if not content.lstrip().startswith(b"{\\rtf"):
        raise ValueError("no RTF header")
    out: list[str] = []
    raw = bytearray()  # escaped bytes in a row, as a character may take two
    page, fonts, defined = 1252, {}, 0
    silent, font, skip, in_fonts = False, None, 1, False
    stack: list[tuple] = []
    owed, at = 0, 0  # owed: substitutes of the last \u still to skip

    def flush() -> None:
        if raw:
            out.append(raw.decode(_codec(fonts.get(font, page)), "replace"))
            raw.clear()

    while m := _RTF.match(content, at):
        at = m.end()
        word, number, escaped, symbol, brace, plain = m.groups()
        if escaped is None:
            flush()
        if brace:
            owed = 0
            if brace == b"{":
                stack.append((silent, font, skip, in_fonts))
            elif stack:
                silent, font, skip, in_fonts = stack.pop()
            if brace == b"}" and not stack:
                break
        elif escaped:  # bytes in a row at once
            cut = min(owed, len(escaped) // 4)
            owed -= cut
            if not silent:
                raw += bytes.fromhex(escaped[4 * cut :].replace(b"\\'", b"").decode())
        elif word:
            name, n = word.decode(), int(number) if number else None
            if name == "bin":
                at += max(n or 0, 0)
            elif name == "ansicpg":
                page = n or 1252
            elif name == "mac":
                page = 10000
            elif name == "uc":
                skip = max(n or 0, 0)
            elif name in ("f", "deff") and n is not None:
                if in_fonts:
                    defined = n
                elif name == "f":
                    font = n
            elif name == "plain":
                font = None
            elif name == "fcharset" and in_fonts:
                if n in _CHARSETS:
                    fonts[defined] = _CHARSETS[n] if n else page
            elif name in _SILENT:
                silent, in_fonts = True, in_fonts or name == "fonttbl"
            elif silent:
                pass
            elif name == "u" and n is not None:
                out.append(chr(n % 65536))
                owed = skip
            elif name in _WORDS:
                if owed:
                    owed -= 1
                else:
                    out.append(_WORDS[name])
        elif symbol == b"*":
            silent = True
        elif symbol:
            if owed:
                owed -= 1
            elif not silent:
                out.append(_SYMBOLS.get(symbol, ""))
        elif plain:
            cut = min(owed, len(plain))
            owed -= cut
            if not silent:
                out.append(plain[cut:].decode(_codec(fonts.get(font, page)), "replace"))
    flush()
    return "".join(out).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")  # pairs of \u are one character


def local_text(content: bytes, path: str) -> str:
    """An extractor of text, docx and rtf files; empty and broken files and other kinds give a bracketed message."""
    ext = os.path.splitext(path)[1].lower()
    if ext in (".txt", ".csv", ".log"):
        text = content.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")
        return text if text.strip() else EMPTY_TEXT
    if ext not in (".docx", ".rtf"):
        return f"[UNSUPPORTED FILE TYPE: {ext.upper()}]"
    try:
        text = docx_text(content) if ext == ".docx" else rtf_text(content)
    except Exception as e:
        return f"[{ext[1:].upper()} EXTRACTION FAILED: {e}]"
    return text if text.strip() else EMPTY_DOCX if ext == ".docx" else EMPTY_RTF
