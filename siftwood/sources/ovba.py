"""Macro storages ([MS-OVBA]): stream compression, the dir and PROJECT streams, modules. No Spark here."""

from __future__ import annotations

import struct
from collections.abc import Iterator

CHUNK, MOST = 4096, 256 << 20


def decompress(data: bytes) -> bytes:
    """A compressed container's contents; a truncated last chunk gives what is there."""
    if not data or data[0] != 1:
        raise ValueError("no compressed container")
    out, at = bytearray(), 1
    while at + 2 <= len(data) and len(out) < MOST:
        head = struct.unpack_from("<H", data, at)[0]
        size, signature, packed = (head & 0x0FFF) + 3, head >> 12 & 7, head >> 15
        if signature != 3:
            raise ValueError("wrong chunk signature")
        stop, start = min(at + size, len(data)), len(out)
        at += 2
        if not packed:
            out += data[at : at + CHUNK]
            at += CHUNK
            continue
        while at < stop:
            kinds = data[at]
            at += 1
            for bit in range(8):
                if at >= stop:
                    break
                if not kinds >> bit & 1:
                    out.append(data[at])
                    at += 1
                    continue
                if at + 2 > stop:
                    at = stop
                    break
                token = struct.unpack_from("<H", data, at)[0]
                at += 2
                bits = max((len(out) - start - 1).bit_length(), 4)
                length, back = (token & 0xFFFF >> bits) + 3, (token >> 16 - bits) + 1
                if back > len(out):
                    raise ValueError("a copy from before the start")
                for _ in range(length):
                    out.append(out[-back])
    return bytes(out)


def compress(data: bytes) -> bytes:
    """A container of literals alone: chunks that would grow beyond the limit stay raw."""
    out = bytearray(b"\x01")
    for i in range(0, len(data), CHUNK):
        part = data[i : i + CHUNK]
        body = b"".join(b"\0" + part[k : k + 8] for k in range(0, len(part), 8))
        if len(body) <= CHUNK and len(part) < CHUNK or len(body) <= CHUNK - 1:
            out += struct.pack("<H", 0xB000 | len(body) + 2 - 3) + body
        elif len(part) == CHUNK:
            out += struct.pack("<H", 0x3FFF) + part
        else:  # two short chunks can't stand for one: split so that literals fit
            half = 3600
            for sub in (part[:half], part[half:]):
                own = b"".join(b"\0" + sub[k : k + 8] for k in range(0, len(sub), 8))
                out += struct.pack("<H", 0xB000 | len(own) + 2 - 3) + own if sub else b""
    return bytes(out)


def records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(id, contents) of a dir stream. The version record's size field is not its size."""
    at = 0
    while at + 6 <= len(data):
        kind, size = struct.unpack_from("<HL", data, at)
        if kind == 0x0009:
            size = 6
        at += 6
        yield kind, data[at : at + size]
        at += size


def codec(page: int) -> str:
    special = {1200: "utf-16-le", 1201: "utf-16-be", 10000: "mac-roman", 28591: "latin-1", 65000: "utf-7", 65001: "utf-8", 20127: "ascii", 932: "cp932", 936: "gbk", 949: "cp949", 950: "cp950"}
    name = special.get(page, f"cp{page}")
    try:
        b"".decode(name)
        return name
    except LookupError:
        return "utf-8"


def modules(dir_stream: bytes, streams: dict[str, bytes], project: bytes = b"") -> list[dict]:
    """Modules of a project in order: name, stream, file name and code. streams: by lower-case name inside the storage VBA."""
    page, now, found = 1252, None, []
    for kind, data in records(decompress(dir_stream)):
        if kind == 0x0003 and len(data) >= 2:
            page = struct.unpack_from("<H", data)[0]
        elif kind == 0x0019:
            now = {"name": data.decode(codec(page), "replace"), "stream": None, "stream_unicode": None, "unicode": None, "offset": 0}
            found.append(now)
        elif now is None:
            continue
        elif kind == 0x0047:
            now["unicode"] = data.decode("utf-16-le", "replace")
        elif kind == 0x001A:
            now["stream"] = data.decode(codec(page), "replace")
        elif kind == 0x0032:
            now["stream_unicode"] = data.decode("utf-16-le", "replace")
        elif kind == 0x0031 and len(data) >= 4:
            now["offset"] = struct.unpack_from("<L", data)[0]
    kinds = {}
    for line in project.decode(codec(page), "replace").splitlines():
        key, _, value = line.partition("=")
        ending = {"Document": ".cls", "Module": ".bas", "Class": ".cls", "BaseClass": ".frm"}.get(key.strip())
        if ending:
            kinds[value.partition("/")[0].strip().lower()] = ending
    out = []
    for m in found:
        names = [n for n in (m["stream"], m["stream_unicode"], m["name"], m["unicode"]) if n]
        data = next((streams[n.lower()] for n in names if n.lower() in streams), None)
        if data is None:
            continue
        try:
            code = decompress(data[m["offset"] :]).decode(codec(page), "replace")
        except ValueError:
            continue
        out.append({"name": m["name"], "stream": names[0], "file": m["name"] + kinds.get(m["name"].lower(), ".vba"), "code": code})
    return out


def write_project(sources: dict[str, str], page: int = 1252, prefix: bytes = b"") -> dict[str, bytes]:
    """Streams of a project whose modules have these sources. prefix: what stands before the code in each module stream."""

    def record(kind: int, data: bytes) -> bytes:
        return struct.pack("<HL", kind, len(data)) + data

    text = record(0x0001, struct.pack("<L", 1)) + record(0x0002, struct.pack("<L", 0x409)) + record(0x0014, struct.pack("<L", 0x409)) + record(0x0003, struct.pack("<H", page)) + record(0x0004, b"VBAProject")
    text += record(0x0005, b"") + record(0x0040, b"") + record(0x0006, b"") + record(0x003D, b"") + record(0x0007, bytes(4)) + record(0x0008, bytes(4)) + struct.pack("<HLLH", 0x0009, 4, 1, 1) + record(0x000C, b"") + record(0x003C, b"")
    text += record(0x000F, struct.pack("<H", len(sources))) + record(0x0013, b"\xff\xff")
    out = {}
    for name, code in sources.items():
        raw = name.encode(codec(page), "replace")
        text += record(0x0019, raw) + record(0x0047, name.encode("utf-16-le")) + record(0x001A, raw) + record(0x0032, name.encode("utf-16-le")) + record(0x001C, b"") + record(0x0048, b"")
        text += record(0x0031, struct.pack("<L", len(prefix))) + record(0x001E, bytes(4)) + record(0x002C, b"\xff\xff") + record(0x0021, b"") + record(0x002B, b"")
        out[f"VBA/{name}"] = prefix + compress(code.encode(codec(page), "replace"))
    text += record(0x0010, b"")
    out["VBA/dir"] = compress(text)
    out["VBA/_VBA_PROJECT"] = b"\xcc\x61\xff\xff\0\0\0"
    out["PROJECT"] = "".join(f"Module={n}\r\n" for n in sources).encode(codec(page), "replace")
    return out
