"""Readers of other formats: RTF, embedded objects, packages, XML parts, mail, BIFF, PPT records, property sets. No Spark here.

Whatever is untrusted is bounded: inflated sizes, nesting.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import io
import itertools
import lzma
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

from ..functions import fixed_values as V
from .cfb import MAGIC, CompoundFile

MOST = 256 << 20
# Namespaces of Flat OPC and of Word 2003 XML.
FLAT_OPC, WORD_2003 = b"http://schemas.microsoft.com/office/2006/xmlPackage", b"http://schemas.microsoft.com/office/word/2003/wordml"
# Fixed value: how names of embedded files without a name of their own begin.
EMBEDDED_NAME = "oleobj_"


# --- RTF -----------------------------------------------------------------

_RTF = re.compile(rb"\\(?:([a-zA-Z]{1,250})(-?\d+)?[ ]?|'([0-9A-Fa-f]{2})|([^a-zA-Z]))|([{}])|([^\\{}]+)", re.DOTALL)


def rtf_destinations(data: bytes) -> Iterator[tuple[bytes, int, int, int, bytes]]:
    """Groups that a control word begins: (word, start, end, level, text). Text of inner groups counts for the outer ones too, unless they are destinations of their own."""
    stack: list[list] = []  # word, start, held text
    at = 0
    while at < len(data):
        m = _RTF.match(data, at)
        if m is None:
            at += 1
            continue
        start, at = at, m.end()
        if m[5] == b"{":
            stack.append([None, start, bytearray()])
        elif m[5] == b"}":
            if stack:
                word, begun, held = stack.pop()
                if word is not None:
                    yield word, begun, at, len(stack) + 1, bytes(held)
                elif stack:
                    stack[-1][2] += held
        elif m[1]:
            word = m[1]
            if word == b"bin":
                n = max(0, int(m[2] or 0))
                if stack:
                    stack[-1][2] += binascii.hexlify(data[at : at + n])
                at += n
            elif stack and stack[-1][0] is None and not stack[-1][2]:
                stack[-1][0] = word
        elif m[6] is not None and stack:
            stack[-1][2] += m[6]
        elif m[3] is not None and stack and stack[-1][0] not in (b"objdata",):
            stack[-1][2] += bytes([int(m[3], 16)])
    while stack:  # groups that the file leaves open
        word, begun, held = stack.pop()
        if word is not None:
            yield word, begun, len(data), len(stack) + 1, bytes(held)
        elif stack:
            stack[-1][2] += held


def rtf_objects(data: bytes) -> list[dict]:
    """Embedded objects of \\objdata groups."""
    out = []
    for word, start, end, _, held in rtf_destinations(data):
        if word != b"objdata":
            continue
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", held)
        raw = binascii.unhexlify(digits[: len(digits) // 2 * 2])
        row = {"start": start, "end": end, "raw_size": len(raw), "raw_md5": hashlib.md5(raw).hexdigest(), "is_ole": False, "is_package": False, "format_id": None, "class_name": None, "oledata_size": None, "filename": None, "src_path": None, "temp_path": None, "ole_md5": None, "package_md5": None, "clsid": None, "tags": [], "urls": [], "data": raw}
        try:
            o = ole1_object(raw)
            row |= {"data": o["data"], "is_ole": True, "format_id": o["format_id"], "class_name": o["class_name"], "oledata_size": len(o["data"]), "ole_md5": hashlib.md5(o["data"]).hexdigest()}
            name = (o["class_name"] or "").replace("\0", "").lower()
            if name == "package":
                p = native_package(o["data"], sized=False)
                row |= {"data": p["data"], "is_package": True, "filename": p["filename"], "src_path": p["src_path"], "temp_path": p["temp_path"], "package_md5": hashlib.md5(p["data"]).hexdigest()}
                endings = ending(p["temp_path"]), ending(p["filename"])
                if any(re.match(rf"(?i)\.(?:{V.EXECUTABLES})\b", e) for e in endings):
                    row["tags"].append("EXECUTABLE FILE")
                if endings[0] != endings[1]:
                    row["tags"].append("MODIFIED FILE EXTENSION")
            elif o["data"][:8] == MAGIC:
                row["clsid"] = CompoundFile(o["data"]).entries[0].clsid or None
            if (o["class_name"] or "").rstrip("\0") == "OLE2Link":
                row["tags"].append("CVE-2017-0199")
                row["urls"] = wide_urls(o["data"])
            elif name.startswith("equation.3"):
                row["tags"].append("CVE-2017-11882")
        except (ValueError, struct.error, IndexError):
            pass
        out.append(row)
    return out


def ending(path: str) -> str:
    """What follows the last dot of a name, with the dot; a name that only begins with dots has none."""
    name = path.rpartition("/")[2]
    stem, dot, last = name.rpartition(".")
    return dot + last if stem.strip(".") else ""


def wide_urls(data: bytes) -> list[str]:
    """The distinct runs of three or more wide ASCII signs that hold "http", in order."""
    runs = (m[::2].decode("ascii") for m in re.findall(rb"(?:[\x20-\x7E]\0){3,}", data))
    return sorted({r for r in runs if "http" in r})


def write_rtf_object(data: bytes) -> bytes:
    return b"{\\rtf1\\ansi text {\\object\\objemb{\\*\\objclass Package}{\\*\\objdata " + binascii.hexlify(data) + b"}}}"


# --- embedded objects --------------------------------------------------------


def _counted(data: bytes, at: int) -> tuple[str, int]:
    n = struct.unpack_from("<L", data, at)[0]
    if n > len(data) - at - 4:
        raise ValueError("a string longer than its data")
    return data[at + 4 : at + 4 + n].rstrip(b"\0").decode("latin-1"), at + 4 + n


def _ended(data: bytes, at: int, most: int = 1024) -> tuple[str, int]:
    stop = data.find(b"\0", at, at + most)
    if stop < 0:
        raise ValueError("a string without an end")
    return data[at:stop].decode("latin-1"), stop + 1


def ole1_object(data: bytes) -> dict:
    """version, format_id (1 linked, 2 embedded), class, topic and item names, data."""
    version, kind = struct.unpack_from("<LL", data)
    if kind not in (0, 1, 2, 5):
        raise ValueError("unknown object format")
    out = {"version": version, "format_id": kind, "class_name": None, "topic": None, "item": None, "data": b""}
    if kind == 0:
        return out
    out["class_name"], at = _counted(data, 8)
    if kind != 5:
        out["topic"], at = _counted(data, at)
        out["item"], at = _counted(data, at)
    size = struct.unpack_from("<L", data, at)[0]
    out["data"] = data[at + 4 : at + 4 + size]
    return out


def write_ole1_object(name: str, data: bytes) -> bytes:
    return struct.pack("<LL", 0x501, 2) + struct.pack("<L", len(name) + 1) + name.encode() + b"\0" + bytes(8) + struct.pack("<L", len(data)) + data


def native_package(data: bytes, sized: bool = True) -> dict:
    """filename, src_path, temp_path, data, is_link of a package; sized: with a leading total size."""
    at = 4 if sized else 0
    at += 2
    filename, at = _ended(data, at)
    source, at = _ended(data, at)
    at += 8
    temp, at = _ended(data, at)
    if at + 4 > len(data):
        return {"filename": filename, "src_path": source, "temp_path": temp, "data": b"", "is_link": True}
    size = struct.unpack_from("<L", data, at)[0]
    return {"filename": filename, "src_path": source, "temp_path": temp, "data": data[at + 4 : at + 4 + size], "is_link": False}


def write_package(filename: str, source: str, temp: str, data: bytes, sized: bool = True) -> bytes:
    body = struct.pack("<H", 2) + filename.encode("latin-1") + b"\0" + source.encode("latin-1") + b"\0" + struct.pack("<LL", 0x30000, len(temp) + 1) + temp.encode("latin-1") + b"\0" + struct.pack("<L", len(data)) + data
    return struct.pack("<L", len(body)) + body if sized else body


def safe_name(name: str, most: int = 255) -> str:
    """The last part of a path in safe signs, without doubled dots and blanks; cut to most signs, before its ending if there is room for that. May be empty."""
    base = re.sub("[^a-zA-Z0-9._ -]", "_", name.rpartition("/")[2].strip())
    base = re.sub("  +", " ", re.sub(r"\.\.+", ".", base))
    if not most or len(base) < most:
        return base
    dot = base.rfind(".")
    last = base[dot:] if dot >= 0 else ""
    return base[: most - len(last)] + last if dot >= 0 and len(last) <= most else base[:most]


def name_candidates(filename: str, source: str, temp: str, most: int, index: int) -> list[str]:
    """Names for an embedded file, best first: those of the three with an ending of up to four signs; the others; a name of a hash with each of the endings and without; one of a number."""
    names = [safe_name(re.split(r"[\\/]", n)[-1].strip(), most) for n in (filename, source, temp)]
    names = [n for n in names if n]
    named = [n for n in names if "." in n and n.rfind(".") >= len(n) - 5]
    digest = hashlib.md5("\0".join((filename, source, temp)).encode("utf-8", "replace")).hexdigest()
    letters = digest.translate(str.maketrans("0123456789", "ghijklmnop"))[:26]  # instead of chance
    endings = [n[n.rfind(".") :] for n in named] + [""]
    made = [letters[: most - len(e)] + e for e in endings if most - len(e) >= 1]
    return [*named, *(n for n in names if n not in named), *made, f"{EMBEDDED_NAME}{index:03d}"]


# --- ActiveMime, single-file XML, MHTML ---------------------------------------


def inflate(data: bytes, most: int = MOST) -> bytes:
    """As much as can be inflated; ValueError for more than most bytes."""
    engine, out = zlib.decompressobj(), b""
    try:
        out = engine.decompress(data, most)
        if engine.unconsumed_tail:
            raise ValueError(f"inflates to more than {most} bytes")
    except zlib.error:
        engine = zlib.decompressobj()
        parts = bytearray()
        for i in range(0, len(data), 64):
            try:
                parts += engine.decompress(data[i : i + 64], max(1, most - len(parts)))
            except zlib.error:
                break
        out = bytes(parts)
    return out


def active_mime(data: bytes) -> bytes:
    """The compound file in an ActiveMime container."""
    if not data.startswith(b"ActiveMime"):
        raise ValueError("no ActiveMime")
    offsets = ([struct.unpack_from("<H", data, 0x1E)[0] + 46] if len(data) >= 0x20 else []) + [0x32, 0x22A]
    whole, part = memoryview(data), b""
    for o in itertools.chain(offsets, (m.start() for m in re.finditer(rb"x[\x01\x5e\x9c\xda]", data))):  # the only second bytes with which "x" begins a stream
        engine = zlib.decompressobj()
        try:
            out = engine.decompress(whole[o:], MOST)
        except zlib.error:
            continue
        if engine.unconsumed_tail:
            raise ValueError(f"inflates to more than {MOST} bytes")
        if out and engine.eof:
            return out
        part = part or out  # cut short: only if no stream is whole
    if part:
        return part
    raise ValueError("nothing to inflate")


def write_active_mime(data: bytes) -> bytes:
    return b"ActiveMime\0\0" + bytes(0x32 - 12) + zlib.compress(data)


def word2003_objects(data: bytes) -> list[bytes]:
    """ActiveMime contents of w:binData elements."""
    out = []
    for _, _, tag, _, text in xml_elements(data, "binData"):
        with_ = base64.b64decode("".join((text or "").split()) or "", validate=False)
        if tag.endswith("}binData") and with_.startswith(b"ActiveMime"):
            out.append(active_mime(with_))
    return out


def flat_opc_projects(data: bytes) -> list[bytes]:
    """vbaProject parts of a Flat OPC document."""
    out = []
    root = parse_xml(data)
    space = "{http://schemas.microsoft.com/office/2006/xmlPackage}"
    for part in root.iter(f"{space}part"):
        if part.get(f"{space}contentType") == "application/vnd.ms-office.vbaProject":
            out += [base64.b64decode("".join((b.text or "").split())) for b in part.iter(f"{space}binaryData")]
    return out


def mail_parts(data: bytes) -> list[tuple[str, str, bytes]]:
    """(name, content type, decoded bytes) of a message's leaf parts."""
    import email
    import email.policy

    out = []
    for part in email.message_from_bytes(data, policy=email.policy.compat32).walk():
        if not part.is_multipart():
            out.append((part.get_filename() or part.get("Content-Location") or "", part.get_content_type(), part.get_payload(decode=True) or b""))
    return out


def is_xml(data: bytes) -> bool:
    """Whether the first sign is one that XML begins with; mail may quote a namespace too."""
    return re.match(rb"(\xef\xbb\xbf)?\s*<", data) is not None


def is_mhtml(data: bytes) -> bool:
    low = data.lower()
    mime, version = low.find(b"mime"), low.find(b"version")
    return mime >= 0 and b"multipart" in low and -1 < version and abs(version - mime) < 20


# --- packages and XML ------------------------------------------------------------


def zip_flags(data: bytes) -> Iterator[int]:
    """The flags of a package's members."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        yield from (info.flag_bits for info in z.infolist())


def zip_parts(data: bytes, password: str | None = None, names: set[str] | None = None) -> Iterator[tuple[str, bytes | None, bool, str | None]]:
    """(name, contents or None, encrypted, error) of all members of a package, or of those named; the first MOST bytes of each, with an error where it has more."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            if info.is_dir() or names is not None and info.filename not in names:
                continue
            locked = bool(info.flag_bits & 1)
            try:
                with z.open(info, pwd=password.encode() if password and locked else None) as f:
                    held = f.read(MOST)
                    more = len(held) == MOST and f.read(1)
                row = info.filename, held, locked, f"longer than {MOST} bytes" if more else None
            except (RuntimeError, zipfile.BadZipFile, zlib.error, NotImplementedError, EOFError, OSError, ValueError, lzma.LZMAError) as e:
                row = info.filename, None, locked, str(e) or type(e).__name__
            yield row


def checked_xml(data: bytes) -> io.BytesIO:
    if b"<!ENTITY" in data:
        raise ValueError("entity declarations are not read")
    return io.BytesIO(data)


def parse_xml(data: bytes) -> ElementTree.Element:
    if b"<!ENTITY" in data:
        raise ValueError("entity declarations are not read")
    try:
        return ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        raise ValueError(str(e)) from None


def xml_elements(data: bytes, tags: str | None = None) -> Iterator[tuple[int, int, str, dict, str]]:
    """(order of ends, depth, tag, attributes, text); only tags whose local name is listed (blank-separated), if any is."""
    if b"<!ENTITY" in data:
        raise ValueError("entity declarations are not read")
    wanted = set(tags.split()) if tags else None
    depth, seq = 0, 0
    try:
        for event, e in ElementTree.iterparse(io.BytesIO(data), ("start", "end")):
            if event == "start":
                depth += 1
                continue
            depth -= 1
            if wanted is None or e.tag.rpartition("}")[2] in wanted:
                yield seq, depth, e.tag, dict(e.attrib), e.text or ""
            seq += 1
            if wanted is None or e.tag.rpartition("}")[2] not in wanted:
                e.clear()
    except ElementTree.ParseError as e:
        raise ValueError(str(e)) from None


def content_types(data: bytes) -> tuple[dict[str, str], dict[str, str]]:
    """Overrides by part and defaults by extension."""
    overrides, defaults = {}, {}
    for _, _, tag, a, _ in xml_elements(data):
        name = tag.rpartition("}")[2]
        if name == "Override":
            overrides[a.get("PartName", "")] = a.get("ContentType", "")
        elif name == "Default":
            defaults[a.get("Extension", "").lower()] = a.get("ContentType", "")
    return overrides, defaults


def xlsx_links(data: bytes) -> list[str]:
    """'service topic' of DDE link elements."""
    return [f"{a.get('ddeService', '')} {a.get('ddeTopic', '')}" for _, _, tag, a, _ in xml_elements(data, "ddeLink") if tag]


def document_variables(data: bytes) -> list[tuple[str, str]]:
    """(name, value) of document variables in a settings part."""
    rows = [{k.rpartition("}")[2]: v for k, v in a.items()} for _, _, _, a, _ in xml_elements(data, "docVar")]
    return [(a.get("name", ""), a.get("val", "")) for a in rows]


# --- records -------------------------------------------------------------------------

BIFF8_NAMES = {2057: "BOF", 10: "EOF", 430: "SupBook", 6: "Formula", 133: "BoundSheet", 516: "Label", 92: "WriteAccess", 47: "FilePass"}
PPT_NAMES = {0x0FF6: "CurrentUserAtom", 0x0FF5: "UserEditAtom", 0x1772: "PersistDirectoryAtom", 0x03E8: "Document", 0x03FF: "VBAInfo", 0x0400: "VBAInfoAtom", 0x1011: "ExternalObjectStorage", 0x0FC3: "ExOleObjAtom"}


def biff8_records(data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(position, type, size, contents)."""
    at = 0
    while at + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, at)
        yield at, kind, size, data[at + 4 : at + 4 + size]
        at += 4 + size


def biff12_records(data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    at = 0
    while at < len(data):
        start, kind, size = at, data[at] & 0x7F, 0
        more = data[at] & 0x80
        at += 1
        if more:
            if at >= len(data):
                return
            kind |= (data[at] & 0x7F) << 7
            at += 1
        for i in range(4):
            if at >= len(data):
                return
            size |= (data[at] & 0x7F) << 7 * i
            at += 1
            if not data[at - 1] & 0x80:
                break
        yield start, kind, size, data[at : at + size]
        at += size


def supbook_link(data: bytes) -> tuple[str, str] | None:
    """(kind, text) of a BIFF8 link record: 'ole/dde' or 'external'."""
    sheets, cch = struct.unpack_from("<HH", data)
    if cch in (0x0401, 0x3A01) or not 1 <= cch <= 0xFF:
        return None
    wide = data[4] & 1
    text = (data[5 : 5 + 2 * cch].decode("utf-16-le", "replace") if wide else data[5 : 5 + cch].decode("latin-1"))
    if text in (" ", "\0"):
        return None
    return ("ole/dde" if sheets == 0 else "external"), text.replace("\x03", " ")


def ppt_records(data: bytes) -> Iterator[tuple[int, int, int, int, int, int, bytes]]:
    """(depth, position, type, size, instance, version, contents); containers (version 15) before their records."""
    ends, at = [len(data)], 0
    while ends:
        if at + 8 > ends[-1]:
            at = ends.pop()
            continue
        head, kind, size = struct.unpack_from("<HHL", data, at)
        version, instance, end = head & 15, head >> 4, min(at + 8 + size, ends[-1])
        yield len(ends) - 1, at, kind, size, instance, version, b"" if version == 15 else data[at + 8 : end]
        at += 8
        if version == 15:
            ends.append(end)
        else:
            at = end


def ppt_storages(data: bytes) -> list[bytes]:
    """Compound files in external-object records, inflated where they are compressed."""
    out = []
    for m in re.finditer(b"[\x00\x10]\x00\x11\x10", data):
        compressed = m[0][0] == 0x10
        size = struct.unpack_from("<L", data, m.start() + 4)[0] if m.start() + 8 <= len(data) else 0
        body = data[m.start() + 8 : m.start() + 8 + size]
        if compressed and len(body) > 4:
            body = inflate(body[4:])
        if body.startswith(MAGIC):
            out.append(body)
    return out


def word_fields(data: bytes) -> list[str]:
    """Fields of a Word stream that name DDE: bytes 0x13 begin, 0x14 separate and 0x15 end; at most 1000 signs each."""
    out, held, inside, texting = [], "", False, False
    for b in data:
        if b == 0x13:
            inside, texting, held = True, True, ""
        elif not inside:
            continue
        elif b == 0x14:
            texting = False
        elif b == 0x15:
            low = held.lstrip().lower()
            if low.startswith("dde") or low.startswith("\0d\0d\0e\0"):
                out.append(held)
            inside = False
        elif texting:
            if len(held) > 1000:
                texting = False
            elif b in (10, 13):
                held += "\n"
            elif b == 0 or 32 <= b < 128 or b == 9:
                held += chr(b)
            else:
                held += "?"
    return out


SUMMARY = {1: "codepage", 2: "title", 3: "subject", 4: "author", 5: "keywords", 6: "comments", 7: "template", 8: "last_saved_by", 9: "revision_number", 10: "total_edit_time", 11: "last_printed", 12: "create_time", 13: "last_saved_time", 14: "num_pages", 15: "num_words", 16: "num_chars", 18: "creating_application", 19: "security"}


def property_set(data: bytes) -> dict[int, object]:
    """Properties of the first section: numbers, texts, file times (as 100 ns since 1601)."""
    if len(data) < 48:
        raise ValueError("no property set")
    at = struct.unpack_from("<L", data, 44)[0]
    n = struct.unpack_from("<L", data, at + 4)[0]
    out, page = {}, 1252
    for i in range(n):
        if at + 16 + 8 * i > len(data):
            break
        key, off = struct.unpack_from("<LL", data, at + 8 + 8 * i)
        p = at + off
        try:
            kind = struct.unpack_from("<L", data, p)[0] & 0xFFFF
            if kind == 2:
                out[key] = struct.unpack_from("<h", data, p + 4)[0] & (0xFFFF if key == 1 else -1)
            elif kind in (3, 19):
                out[key] = struct.unpack_from("<l", data, p + 4)[0]
            elif kind == 11:
                out[key] = bool(struct.unpack_from("<H", data, p + 4)[0])
            elif kind == 30:
                k = struct.unpack_from("<L", data, p + 4)[0]
                out[key] = data[p + 8 : p + 8 + k].rstrip(b"\0").decode(f"cp{page}" if page != 65001 else "utf-8", "replace")
            elif kind == 31:
                k = struct.unpack_from("<L", data, p + 4)[0]
                out[key] = data[p + 8 : p + 8 + 2 * k].decode("utf-16-le", "replace").rstrip("\0")
            elif kind == 64:
                out[key] = struct.unpack_from("<Q", data, p + 4)[0]
        except (struct.error, LookupError):
            continue
        if key == 1 and isinstance(out.get(1), int):
            page = out[1]
    return out


def write_property_set(values: dict[int, object]) -> bytes:
    rows, body = [], b""
    for key, v in values.items():
        rows.append((key, len(body)))
        if isinstance(v, str):
            raw = v.encode("utf-8") + b"\0"
            part = struct.pack("<LL", 30, len(raw)) + raw
        elif key == 1:
            part = struct.pack("<LH", 2, v)
        else:
            part = struct.pack("<Ll", 3, v)
        body += part.ljust(-(-len(part) // 4) * 4, b"\0")
    start = 8 + 8 * len(rows)
    section = struct.pack("<LL", start + len(body), len(rows)) + b"".join(struct.pack("<LL", k, start + o) for k, o in rows) + body
    return struct.pack("<HHL", 0xFFFE, 0, 0) + bytes(16) + struct.pack("<L", 1) + bytes(16) + struct.pack("<L", 48) + section


def flash_objects(data: bytes) -> list[tuple[int, str, int, int]]:
    """(position, signature, version, size) of plausible Flash objects."""
    out = []
    for m in re.finditer(b"CWS|FWS", data):
        if m.start() + 8 > len(data):
            continue
        version, size = data[m.start() + 3], struct.unpack_from("<l", data, m.start() + 4)[0]
        if version > 20 or size < 1024:
            continue
        body = data[m.start() + 8 :]
        if m[0] == b"FWS" and size > len(data) - m.start():
            continue
        if m[0] == b"CWS":
            try:
                zlib.decompressobj().decompress(body, 1024)
            except zlib.error:
                continue
        out.append((m.start(), m[0].decode(), version, size))
    return out


def form_strings(data: bytes) -> list[str]:
    """Printable runs of five signs or more in a form's object stream, without the usual font name."""
    return [x for m in re.findall(rb"[\t\r\n\x20-\xFF]{5,}", data) if (x := m.decode("utf-8", "replace")) != "Tahoma"]


def form_storages(paths: list[str]) -> list[str]:
    """Paths of the storages that have both streams of a form, o and f."""
    have = {p.lower() for p in paths}
    above = {p.rpartition("/")[0] for p in paths if p.lower().endswith("/o")}
    return sorted(a for a in above if f"{a}/f".lower() in have)


def inner_ole(data: bytes) -> Iterator[bytes]:
    """Every compound file in a file: itself, package parts, ActiveMime in Word XML and MHTML, Flat OPC, PPT objects."""
    if data.startswith(MAGIC):
        f = CompoundFile(data)
        main = next((c for e, c in f.streams(False) if e.path == "PowerPoint Document"), None)
        yield from ([data] if main is None else ppt_storages(main))
    elif data.startswith(b"PK\x03\x04"):
        yield from (c for _, c, _, _ in zip_parts(data) if c and c.startswith(MAGIC))
    elif is_xml(data) and (FLAT_OPC in data or WORD_2003 in data):
        if FLAT_OPC in data:
            yield from flat_opc_projects(data)
        if WORD_2003 in data:
            yield from word2003_objects(data)
    elif is_mhtml(data):
        for _, _, part in mail_parts(data):
            if part.startswith(b"ActiveMime"):
                yield active_mime(part)
