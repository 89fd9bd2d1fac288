"""Whole files: what kind of document each is, its DDE links, external relationships, embedded objects and macros. No Spark here.

Each reader takes a file's bytes and works out by itself which format it has.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from xml.etree import ElementTree

from ..functions import fixed_values as V
from . import cfb, formats

WORD_SPACES = ("{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "{http://schemas.microsoft.com/office/word/2003/wordml}")
RELATIONS = "_rels/.rels"


# --- kinds ---------------------------------------------------------------------------


def is_excel_ole(f: cfb.CompoundFile) -> bool:
    return any((e.path or "").lower() in ("workbook", "book") for e in f.entries if e.kind == 2)


def is_powerpoint_ole(f: cfb.CompoundFile) -> bool:
    """Whether the streams and records are there that every presentation has."""
    streams = {e.path: c for e, c in f.streams(orphans=False)}
    user = any(kind == 0x0FF6 for _, _, kind, *_ in formats.ppt_records(streams.get("Current User", b"")))
    kinds = {kind for _, _, kind, *_ in formats.ppt_records(streams.get("PowerPoint Document", b""))}
    return user and {0x0FF5, 0x1772, 0x03E8} <= kinds


def document_type(data: bytes) -> str | None:
    """word, excel, powerpoint, mixed or none of a package; word-xml or excel-xml of a single XML file; None for what is neither."""
    if data.startswith(b"PK\x03\x04"):
        parts = {n: c for n, c, _, _ in formats.zip_parts(data, names={"[Content_Types].xml"})}
        types = [a.get("ContentType", "") for _, _, _, a, _ in formats.xml_elements(parts.get("[Content_Types].xml") or b"<x/>")]
        found = {kind for kind, starts in V.CONTENT_TYPE_STARTS.items() if any(t.startswith(starts) for t in types)}
        return "none" if not found else found.pop() if len(found) == 1 else "mixed"
    if not formats.is_xml(data):
        return None
    try:
        formats.parse_xml(data)
    except ValueError:
        return None
    m = re.search(rb"<\?mso-application\s[^>]*progid=\"([^\"]*)\"", data[:1024])
    return {b"Word.Document": "word-xml", b"Excel.Sheet": "excel-xml"}.get(m[1] if m else b"", "none")


# --- DDE -----------------------------------------------------------------------------


def xml_parts(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, contents) of a package's XML parts; of a single XML file, itself."""
    if not data.startswith(b"PK\x03\x04"):
        yield "", data
        return
    for name, c, _, _ in formats.zip_parts(data):
        if c and name.lower().endswith((".xml", ".rels", ".vml")):
            yield name, c


def supbook12_link(data: bytes) -> str | None:
    """'service topic' of a DDE link record of a binary workbook."""
    if len(data) < 6 or struct.unpack_from("<H", data)[0] != 1:
        return None
    texts, at = [], 2
    for _ in range(2):
        n = struct.unpack_from("<L", data, at)[0]
        fits = n != 0xFFFFFFFF and at + 4 + 2 * n <= len(data)
        texts.append(data[at + 4 : at + 4 + 2 * n].decode("utf-16-le", "replace") if fits else "")
        at += 4 + 2 * n if fits else 0
    return " ".join(texts)


def excel_links(data: bytes) -> Iterator[str]:
    """DDE links of a workbook package: link elements of XML parts, link records of binary ones."""
    binary = []
    for name, c, _, _ in formats.zip_parts(data):
        if not c:
            continue
        if name.lower().endswith((".xml", ".rels", ".vml")):
            try:
                for _, _, tag, a, _ in formats.xml_elements(c):
                    if tag.rpartition("}")[2].lower() == "ddelink":
                        yield " ".join(a[k] for k in ("ddeService", "ddeTopic") if k in a)
            except ValueError:
                continue
        elif name.lower().endswith(".bin"):
            binary.append(c)
    for c in binary:
        for _, kind, _, body in formats.biff12_records(c):
            if kind == 360 and (link := supbook12_link(body)) is not None:
                yield link


def excel_xml_links(data: bytes) -> Iterator[str]:
    """DDE formulas in the cells of an Excel 2003 XML file."""
    for _, _, tag, a, _ in formats.xml_elements(data):
        if tag.rpartition("}")[2].lower() == "cell":
            formula = next((v for k, v in a.items() if k.rpartition("}")[2].lower() == "formula"), None)
            if formula is not None and (m := re.match(V.CSV_DDE, formula)):
                yield " ".join(m.groups()[:2])


def unquote(field: str) -> str:
    """A QUOTE field's numbers as characters; other fields as they are."""
    if "QUOTE" not in field:
        return field
    out = []
    for part in field.strip().split(" ")[1:]:
        number = re.fullmatch(r"\s*[+-]?\d+(?:_\d+)*\s*", part)
        out.append(chr(int(part)) if number and 0 <= int(part) < 0x110000 else part)
    return "".join(out)


def word_xml_fields(data: bytes) -> Iterator[str]:
    """Fields of the Word parts of a package or of a Word XML file: simple ones, and those between begin and end marks, of which inner ones join the outer. In document order."""

    def simple(e) -> str:
        return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == "instr"), "")

    for _, part in xml_parts(data):
        level, held = 0, ""
        above: list[str] = []
        try:
            for event, e in ElementTree.iterparse(formats.checked_xml(part), ("start", "end")):
                if event == "start":
                    above.append(e.tag)
                    continue
                above.pop()
                space, _, name = e.tag.rpartition("}")
                if f"{space}}}" not in WORD_SPACES or name not in ("p", "fldSimple"):
                    continue
                if name == "fldSimple":
                    if simple(e) and (not above or above[-1] != f"{space}}}p"):  # else it is met among its paragraph's children
                        yield unquote(simple(e))
                    continue
                for own in e:
                    kind = own.tag.rpartition("}")[2]
                    if kind == "fldSimple" and simple(own):
                        yield unquote(simple(own))
                    if kind == "r":
                        own = next((c for c in own if c.tag.rpartition("}")[2] in ("fldChar", "instrText")), None)
                        if own is None:
                            continue
                        kind = own.tag.rpartition("}")[2]
                    mark = next((v for k, v in own.attrib.items() if k.rpartition("}")[2] == "fldCharType"), None)
                    level += (mark == "begin") - (mark == "end")
                    if mark == "end" and level <= 0:
                        yield held
                        level, held = 0, ""
                    if kind == "instrText" and own.text:
                        held += unquote(own.text)
        except ElementTree.ParseError:
            continue


def dde_links(data: bytes) -> Iterator[tuple[str, str]]:
    """(source, link or field) of a file of any kind. Only fields of sources docx and rtf are meant for a filter."""
    from ..operators.dde import csv_links

    if data.startswith(cfb.MAGIC):
        f = cfb.CompoundFile(data)
        if is_excel_ole(f):
            for e, c in f.streams(orphans=False):
                if (e.path or "").lower() in ("workbook", "book"):
                    for _, kind, _, body in formats.biff8_records(c):
                        if kind == 430 and len(body) >= 5 and (x := formats.supbook_link(body)):
                            yield "xls", x[1]
        elif not is_powerpoint_ole(f):
            for _, c in f.streams():
                yield from (("doc", x) for x in formats.word_fields(c))
        return
    if data[:4] == b"{\\rt":
        for word, _, _, _, held in formats.rtf_destinations(data):
            if word == b"fldinst":
                yield "rtf", held.replace(b"\r", b"").replace(b"\n", b"").decode("ascii", "replace").strip()
        return
    kind = document_type(data)
    if kind == "excel":
        yield from (("xlsx", x) for x in excel_links(data))
    elif kind == "excel-xml":
        yield from (("excel-xml", x) for x in excel_xml_links(data))
    elif kind == "word-xml":
        yield from (("word-xml", x) for x in word_xml_fields(data))
    elif kind is None:
        yield from (("csv", x) for x in csv_links(data.decode("utf-8", "replace")))
    else:
        yield from (("docx", x) for x in word_xml_fields(data))


# --- relationships and objects --------------------------------------------------------


def external_relationships(data: bytes) -> Iterator[tuple[str, str, str]]:
    """(part, type, target) of a package's external relationships, of all types."""
    if not data.startswith(b"PK\x03\x04"):
        return
    for name, c, _, _ in formats.zip_parts(data):
        if c and name.lower().endswith(".rels"):
            try:
                rows = list(formats.xml_elements(c, "Relationship"))
            except ValueError:
                continue
            for _, _, _, a, _ in rows:
                if a.get("TargetMode") == "External":
                    yield name, a.get("Type", ""), a.get("Target", "")


def embedded_objects(data: bytes) -> Iterator[tuple[str, str, str, bool, bytes, str | None]]:
    """(name, source path, temporary path, is link, contents, error) of packages in compound files, in packages' parts and in Word 2003 XML."""
    for inner in formats.inner_ole(data):
        for e, c in cfb.CompoundFile(inner).streams():
            if (e.path or e.name).rpartition("/")[2].lower() == "\x01ole10native":
                try:
                    p = formats.native_package(c)
                except (ValueError, struct.error, IndexError) as x:
                    yield "", "", "", False, b"", f"{type(x).__name__}: {x}"
                    continue
                yield p["filename"], p["src_path"], p["temp_path"], p["is_link"], p["data"], None


# --- presentations ----------------------------------------------------------------------


def persist_directory(f: cfb.CompoundFile) -> dict[int, int]:
    """Persist id to offset: the edits are followed from the newest back; each that is read later counts (as the format's readers do)."""
    streams = {e.path: c for e, c in f.streams(orphans=False)}
    user, main = streams.get("Current User", b""), streams.get("PowerPoint Document", b"")
    if len(user) < 20 or struct.unpack_from("<H", user, 2)[0] != 0x0FF6:
        raise ValueError("no current user")
    at, out, seen = struct.unpack_from("<L", user, 16)[0], {}, set()
    while at and at not in seen:
        seen.add(at)
        if struct.unpack_from("<H", main, at + 2)[0] != 0x0FF5:
            raise ValueError("no user edit")
        last_edit, directory = struct.unpack_from("<LL", main, at + 16)
        kind, size = struct.unpack_from("<HL", main, directory + 2)
        if kind != 0x1772:
            raise ValueError("no persist directory")
        p, end = directory + 8, directory + 8 + size
        while p + 4 <= end:
            head = struct.unpack_from("<L", main, p)[0]
            first, n = head & 0xFFFFF, head >> 20
            for i, offset in enumerate(struct.unpack_from(f"<{n}L", main, p + 4)):
                out[first + i] = offset
            p += 4 + 4 * n
        at = last_edit
    return out


# --- macros -----------------------------------------------------------------------------


def sheet_states(f: cfb.CompoundFile) -> list[tuple[str, int]]:
    """(name, kind) of the sheets that a workbook's records list; kind 1 is a macro sheet."""
    out = []
    for e, c in f.streams(orphans=False):
        if (e.path or "").lower() in ("workbook", "book"):
            for _, kind, size, body in formats.biff8_records(c):
                if kind == 133 and size >= 8:
                    n, wide = body[6], body[7] & 1
                    out.append((body[8 : 8 + n * (1 + wide)].decode("utf-16-le" if wide else "latin-1", "replace"), body[5]))
    return out


def has_xlm(data: bytes) -> bool:
    """Whether a workbook has a macro sheet: by its records, or by its content types; a SYLK file, by its option row."""
    if data.startswith(cfb.MAGIC):
        return any(kind == 1 for _, kind in sheet_states(cfb.CompoundFile(data)))
    if data.startswith(b"PK\x03\x04"):
        parts = {n: c for n, c, _, _ in formats.zip_parts(data, names={"[Content_Types].xml"})}
        return any(a.get("ContentType", "").endswith(("ms-excel.macrosheet+xml", "ms-excel.macrosheet", "ms-excel.intlmacrosheet+xml", "ms-excel.intlmacrosheet")) for _, _, _, a, _ in formats.xml_elements(parts.get("[Content_Types].xml") or b"<x/>"))
    return data.startswith(b"ID") and any(line.startswith(b"O") and any(p.startswith(b"E") for p in line.split(b";")[1:]) for line in re.split(rb"[\r\n]+", data))


def has_vba(data: bytes) -> bool:
    """Whether a compound file in the file has a macro project, or a stream with plain attributes of one."""
    for inner in formats.inner_ole(data):
        f = cfb.CompoundFile(inner)
        paths = {(e.path or "").upper() for e in f.entries}
        if any(p.endswith("VBA/_VBA_PROJECT") for p in paths) or any(b"Attribut\0" in c for _, c in f.streams()):
            return True
    return False


# --- encryption ----------------------------------------------------------------------------


def is_encrypted(data: bytes) -> bool:
    """Of a file of any kind: a package whose first member is locked; a compound file with the marks of encryption."""
    if data.startswith(b"PK\x03\x04"):
        return bool(next(formats.zip_flags(data), 0) & 1)
    if not data.startswith(cfb.MAGIC):
        return False
    streams = {e.path: c for e, c in cfb.CompoundFile(data).streams(orphans=False)}
    try:
        secured = formats.property_set(streams["\x05SummaryInformation"]).get(0x13, 0) if "\x05SummaryInformation" in streams else 0
    except (ValueError, struct.error):
        secured = 0
    word = streams.get("WordDocument", b"")
    return bool(isinstance(secured, int) and secured & 1 or "EncryptionInfo" in streams or "EncryptedSummary" in streams and "SummaryInformation" not in streams or len(word) >= 12 and word[11] & 1)


# --- trees and times ---------------------------------------------------------------------------


def storage_tree(data: bytes) -> list[tuple[int, int, str, str, int | None, str | None]]:
    """(sid, depth, path, name, size, CLSID) of the root and all streams and storages, by path."""
    f = cfb.CompoundFile(data)
    root, *rest = f.entries
    rows = sorted((e.path.split("/"), e) for e in rest if e.path)
    out = [(0, 0, "", root.name, None, root.clsid or None)]
    return out + [(e.sid, len(parts), e.path, e.name, e.size if e.kind == 2 else None, e.clsid or None) for parts, e in rows]
