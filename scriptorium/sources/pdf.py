"""Text and metadata of PDF files: by a small reader of page streams, and by PDF libraries where they are installed.

Of all readers the text of best quality counts. The small reader follows references, object streams, deflated page
streams and the fonts' code tables; encrypted files and pages that are images give no text.
"""

from __future__ import annotations

import importlib
import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

# Libraries in the order they are tried, and pages that are read.
LIBRARIES = ("pypdf", "PyPDF2")
MOST_PAGES = 5


class NoTextError(ValueError):
    """No reader finds text: the file is a scan, encrypted or broken."""


@dataclass(frozen=True)
class PdfText:
    """What a file holds: its text, and the title and year that its metadata name."""

    text: str
    title: str = ""
    year: int | None = None


def quality(text: str) -> int:
    """Characters, less twenty for each replacement character and one for each control character."""
    return len(text) - 20 * text.count("�") - sum(ord(c) < 32 and c not in "\n\r\t" for c in text) if text else -1


def year_of(dates: list[str]) -> int | None:
    """The first year that a date of creation or change names."""
    return next((int(m[0]) for d in dates if (m := re.search(r"(?:19|20)\d{2}", d))), None)


# --- objects -------------------------------------------------------------------------------------------------------

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.DOTALL)
_STREAM = re.compile(rb"\bstream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")


def _deflated(body: bytes) -> bytes:
    m = _STREAM.search(body)
    if not m:
        return b""
    head = body[: m.start()]
    if b"/FlateDecode" in head:
        try:
            return zlib.decompressobj().decompress(m[1])
        except zlib.error:
            return b""
    return b"" if b"/Filter" in head else m[1]


@dataclass
class _File:
    raw: bytes
    objects: dict[int, bytes] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.raw.lstrip()[:5] == b"%PDF-":
            raise NoTextError("PdfReadError: PDF header not found")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", self.raw):
            raise NoTextError("pdf is encrypted")
        for m in _OBJECT.finditer(self.raw):
            self.objects[int(m[1])] = m[2]
        for body in list(self.objects.values()):
            if b"/ObjStm" in body.split(b"stream", 1)[0]:
                self._unpack(body)

    def _unpack(self, body: bytes) -> None:
        first = re.search(rb"/First\s+(\d+)", body)
        data = _deflated(body)
        if not first or not data:
            return
        numbers = [int(x) for x in data[: int(first[1])].split()]
        places = [(n, int(first[1]) + at) for n, at in zip(numbers[::2], numbers[1::2], strict=False)]
        for (n, at), (_, end) in zip(places, [*places[1:], (0, len(data))], strict=True):
            self.objects.setdefault(n, data[at:end])

    def value(self, body: bytes, key: bytes) -> bytes:
        """The part of a dictionary after a key, references followed once."""
        m = re.search(rb"/" + key + rb"(?![A-Za-z])\s*", body)
        if not m:
            return b""
        rest = body[m.end() :]
        r = _REFERENCE.match(rest)
        return self.objects.get(int(r[1]), b"") if r else rest

    def pages(self) -> Iterator[bytes]:
        """Page objects in reading order, or in the file's order where the tree of pages is broken."""
        roots = [b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog", b)]
        found: list[bytes] = []

        def walk(body: bytes, depth: int) -> None:
            if re.search(rb"/Type\s*/Page(?![A-Za-z])", body):
                found.append(body)
            elif depth < 30:
                kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.DOTALL)
                for r in _REFERENCE.findall(kids[1]) if kids else ():
                    walk(self.objects.get(int(r), b""), depth + 1)

        for root in roots:
            walk(self.value(root, b"Pages"), 0)
        yield from found or [b for b in self.objects.values() if re.search(rb"/Type\s*/Page(?![A-Za-z])", b)]

    def fonts(self, page: bytes) -> dict[bytes, dict[int, str]]:
        """Code tables of the page's fonts by name; empty for a font of plain characters."""
        names = self.value(self.value(page, b"Resources") or page, b"Font")
        out = {}
        for m in re.finditer(rb"/([^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", names.split(b">>", 1)[0]):
            table = re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", self.objects.get(int(m[2]), b""))
            out[m[1]] = _codes(_deflated(self.objects.get(int(table[1]), b""))) if table else {}
        return out

    def contents(self, page: bytes) -> bytes:
        m = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
        return b"\n".join(_deflated(self.objects.get(int(r), b"")) for r in _REFERENCE.findall(m[1])) if m else b""

    def info(self) -> dict[str, str]:
        m = re.search(rb"/Info\s+(\d+)\s+\d+\s+R", self.raw)
        body = self.objects.get(int(m[1]), b"") if m else b""
        out = {}
        for key in (b"Title", b"CreationDate", b"ModDate"):
            at = re.search(rb"/" + key + rb"\s*(?=[(<])", body)
            token = next(_tokens(body[at.end() :]), None) if at else None
            if isinstance(token, _String):
                raw = bytes(token)
                out[key.decode()] = raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")
        return out


def _codes(cmap: bytes) -> dict[int, str]:
    """Code -> text of a font's table."""
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out: dict[int, str] = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.DOTALL):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[int(a, 16)] = text(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.DOTALL):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            for k in range(min(int(b, 16) - int(a, 16) + 1, 1 << 16)):
                out[int(a, 16) + k] = chr(int(c, 16) + k) if len(c) <= 4 else text(c)
    return out


# --- page streams --------------------------------------------------------------------------------------------------


class _String(bytes):
    """A string of a page stream."""


_TOKEN = re.compile(rb"\(|<(?!<)([0-9A-Fa-f\s]*)>|\[|\]|/([^\s/<>\[\]()]*)|([-+]?\d*\.?\d+)|([A-Za-z'\"*]+[0-9*]*)")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _tokens(data: bytes) -> Iterator[bytes | str | float]:
    """Strings, names (with their slash), numbers, brackets and operators as text."""
    at = 0
    while m := _TOKEN.search(data, at):
        at = m.end()
        if m[0] == b"(":
            out, depth = bytearray(), 1
            while at < len(data) and depth:
                c = data[at : at + 1]
                at += 1
                if c == b"\\":
                    octal = re.compile(rb"[0-7]{1,3}").match(data, at)
                    if octal:
                        out.append(int(octal[0], 8) & 255)
                        at = octal.end()
                    else:
                        out += _ESCAPES.get(data[at : at + 1], data[at : at + 1].strip(b"\r\n"))
                        at += 1
                    continue
                depth += (c == b"(") - (c == b")")
                if depth:
                    out += c
            yield _String(out)
        elif m[1] is not None:
            h = b"".join(m[1].split())
            yield _String(bytes.fromhex((h + b"0" * (len(h) % 2)).decode()))
        elif m[2] is not None:
            yield "/" + m[2].decode("latin-1")
        elif m[3] is not None:
            yield float(m[3])
        else:
            yield m[0].decode("latin-1")


def _shown(raw: bytes, codes: dict[int, str]) -> str:
    if not codes:
        return raw.decode("cp1252", "replace")
    wide = max(codes) > 255 or raw[:1] == b"\0" and len(raw) % 2 == 0
    units = [int.from_bytes(raw[i : i + 2]) for i in range(0, len(raw) - 1, 2)] if wide else list(raw)
    return "".join(codes.get(u, "�") for u in units)


#: Thousandths of the letter height that a gap between two strings of a line is wide at least.
GAP = 200


def _page_text(stream: bytes, fonts: dict[bytes, dict[int, str]]) -> str:
    out: list[str] = []
    codes: dict[int, str] = {}
    held: list[bytes | str | float] = []
    for t in _tokens(stream):
        if isinstance(t, str) and t[:1] not in "/[]":
            if t == "Tf":
                codes = next((fonts.get(x[1:].encode("latin-1"), {}) for x in held if isinstance(x, str)), {})
            elif t in ("Tj", "TJ", "'", '"'):
                out += ["\n"] if t in ("'", '"') else []
                for x in held:
                    if isinstance(x, _String):
                        out.append(_shown(x, codes))
                    elif isinstance(x, float) and x <= -GAP and t == "TJ":
                        out.append(" ")
            elif t in ("T*", "TD", "Tm", "BT") or t == "Td" and held[-1:] != [0.0]:
                out.append("\n")
            held = []
        else:
            held.append(t)
    return re.sub(r"\n{2,}", "\n", "".join(out)).strip("\n")


def read_small(raw: bytes) -> PdfText:
    """Text by the reader of this module."""
    file = _File(raw)
    pages = [_page_text(file.contents(p), file.fonts(p)) for _, p in zip(range(MOST_PAGES), file.pages(), strict=False)]
    info = file.info()
    return PdfText("\n".join(pages), info.get("Title", "").strip(), year_of([info.get("CreationDate", ""), info.get("ModDate", "")]))


def read_with(library: str, raw: bytes) -> PdfText:
    """Text by an installed library."""
    reader = importlib.import_module(library).PdfReader(io.BytesIO(raw))
    if reader.is_encrypted:
        raise NoTextError("pdf is encrypted")
    meta = {k: str(v) for k, v in (reader.metadata or {}).items()}
    pages = [p.extract_text() or "" for p in reader.pages[:MOST_PAGES]]
    return PdfText("\n".join(pages), meta.get("/Title", "").strip(), year_of([meta.get("/CreationDate", ""), meta.get("/ModDate", "")]))


def extract(raw: bytes) -> PdfText:
    """The best text that any reader finds; raises NoTextError if none finds any."""
    best, why = PdfText(""), "no text layer"
    for reader in (*((lambda r, lib=lib: read_with(lib, r)) for lib in LIBRARIES), read_small):
        try:
            found = reader(raw)
        except ImportError:
            continue
        except Exception as e:  # noqa: BLE001 - a reader that fails leaves the file to the others
            why = str(e) or type(e).__name__
            continue
        if quality(found.text) > quality(best.text):
            best = found
    if not best.text.strip():
        raise NoTextError(why)
    return best
