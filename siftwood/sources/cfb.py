"""Compound files ([MS-CFB]): reading, and writing for round trips. No Spark here.

Chains are followed for as many sectors as the file has at most, so damaged files
end rather than loop. Errors come as ValueError.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
FREE, END, FAT_SECTOR, DIFAT_SECTOR = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD, 0xFFFFFFFC
KINDS = {0: "Empty", 1: "Storage", 2: "Stream", 3: "ILockBytes", 4: "IPropertyStorage", 5: "Root"}
CUTOFF, MINI = 4096, 64


@dataclass
class Entry:
    sid: int
    name: str
    kind: int
    left: int
    right: int
    child: int
    clsid: str
    created: int
    modified: int
    start: int
    size: int
    path: str | None = None  # None: an orphan


@dataclass
class CompoundFile:
    data: bytes
    sector: int = 512
    fat: list[int] = field(default_factory=list)
    mini_fat: list[int] = field(default_factory=list)
    entries: list[Entry] = field(default_factory=list)
    header: dict = field(default_factory=dict)

    def __post_init__(self):
        d = self.data
        if d[:8] != MAGIC or len(d) < 512:
            raise ValueError("not a compound file")
        minor, major, order, shift, mini_shift = struct.unpack_from("<HHHHH", d, 24)
        n_dir, n_fat, first_dir, _, cutoff, first_mini, n_mini, first_difat, n_difat = struct.unpack_from("<9L", d, 40)
        if shift not in (9, 12):
            raise ValueError("unknown sector size")
        self.sector = 1 << shift
        self.header = {"minor_version": minor, "major_version": major, "byte_order": order, "sector_shift": shift, "mini_sector_shift": mini_shift, "n_directory_sectors": n_dir, "n_fat_sectors": n_fat, "first_directory_sector": first_dir, "mini_cutoff": cutoff, "first_minifat_sector": first_mini, "n_minifat_sectors": n_mini, "first_difat_sector": first_difat, "n_difat_sectors": n_difat}
        listed = [s for s in struct.unpack_from("<109L", d, 76) if s < DIFAT_SECTOR]
        at, left = first_difat, self.count
        while at < DIFAT_SECTOR and left > 0:
            words = self._words(at)
            listed += [s for s in words[:-1] if s < DIFAT_SECTOR]
            at, left = words[-1] if words else END, left - 1
        for s in listed[: self.count]:
            self.fat += self._words(s)
        self.mini_fat = list(struct.unpack(f"<{len(m) // 4}L", m[: len(m) // 4 * 4])) if (m := self._chain(first_mini)) else []
        raw = self._chain(first_dir)
        self.entries = [e for i in range(len(raw) // 128) if (e := self._entry(i, raw[128 * i : 128 * i + 128]))]
        self._paths()

    @property
    def count(self) -> int:
        return max(0, len(self.data) // self.sector)

    def _sector(self, n: int) -> bytes:
        return self.data[self.sector * (n + 1) : self.sector * (n + 2)]

    def _words(self, n: int) -> list[int]:
        s = self._sector(n)
        return list(struct.unpack(f"<{len(s) // 4}L", s[: len(s) // 4 * 4]))

    def _chain(self, start: int, size: int | None = None) -> bytes:
        out, at, left = [], start, self.count + 1
        while at < DIFAT_SECTOR and left > 0 and at < len(self.fat):
            out.append(self._sector(at))
            at, left = self.fat[at], left - 1
        data = b"".join(out)
        return data if size is None else data[:size]

    def _entry(self, sid: int, b: bytes) -> Entry | None:
        n = struct.unpack_from("<H", b, 64)[0]
        name = b[: max(0, min(n, 64) - 2)].decode("utf-16-le", "replace")
        left, right, child = struct.unpack_from("<3L", b, 68)
        a, e, c = struct.unpack_from("<LHH", b, 80)
        rest = b[88:96].hex().upper()
        clsid = f"{a:08X}-{e:04X}-{c:04X}-{rest[:4]}-{rest[4:]}"
        created, modified, start, size = struct.unpack_from("<QQLQ", b, 100)
        if self.sector == 512:
            size &= 0xFFFFFFFF
        return Entry(sid, name, b[66], left, right, child, "" if not clsid.strip("0-") else clsid, created, modified, start, size)

    def _paths(self) -> None:
        if not self.entries:
            return
        self.entries[0].path = ""
        stack, seen = [(self.entries[0].child, "")], {0}
        while stack:
            sid, above = stack.pop()
            if sid >= len(self.entries) or sid in seen:
                continue
            seen.add(sid)
            e = self.entries[sid]
            if not e.kind:
                continue
            e.path = f"{above}/{e.name}" if above else e.name
            stack += [(e.left, above), (e.right, above)]
            if e.kind == 1:
                stack.append((e.child, e.path))

    def content(self, e: Entry) -> bytes:
        """A stream's bytes, as far as they are there."""
        if e.kind != 2 or not e.size:
            return b""
        if e.size >= CUTOFF:
            return self._chain(e.start, e.size)
        root, out, at, left = self._chain(self.entries[0].start, self.entries[0].size), [], e.start, len(self.mini_fat) + 1
        while at < len(self.mini_fat) and left > 0:
            out.append(root[MINI * at : MINI * at + MINI])
            at, left = self.mini_fat[at], left - 1
        return b"".join(out)[: e.size]

    def streams(self, orphans: bool = True) -> list[tuple[Entry, bytes]]:
        return [(e, self.content(e)) for e in self.entries if e.kind == 2 and (orphans or e.path is not None)]


def write(streams: dict[str, bytes], clsid: bytes = bytes(16), orphans: tuple[str, ...] = ()) -> bytes:
    """A compound file of version 3 with these streams ('storage/stream' paths); orphans are left out of the tree."""
    tree: dict = {}
    for path, data in streams.items():
        *above, last = path.split("/")
        node = tree
        for part in above:
            node = node.setdefault(part, {})
        node[last] = data
    entries: list[list] = [["Root Entry", 5, None, clsid]]
    links: list[list[int]] = [[FREE, FREE, FREE]]

    def add(node: dict, parent: int, above: str) -> None:
        names, own = sorted(node, key=lambda n: (len(n), n.upper())), []
        for name in names:
            value = node[name]
            entries.append([name, 1 if isinstance(value, dict) else 2, value, bytes(16)])
            links.append([FREE, FREE, FREE])
            if f"{above}{name}" not in orphans:
                own.append((len(entries) - 1, value, name))
            elif isinstance(value, dict):
                add(value, len(entries) - 1, f"{above}{name}/")

        def balance(part: list) -> int:
            if not part:
                return FREE
            m = len(part) // 2
            sid = part[m][0]
            links[sid][0], links[sid][1] = balance(part[:m]), balance(part[m + 1 :])
            return sid

        links[parent][2] = balance(own)
        for sid, value, name in own:
            if isinstance(value, dict):
                add(value, sid, f"{above}{name}/")

    add(tree, 0, "")
    sectors: list[bytes] = []
    fat: list[int] = []

    def put(data: bytes) -> int:
        n = -(-len(data) // 512)
        first = len(sectors)
        for i in range(n):
            sectors.append(data[512 * i : 512 * i + 512].ljust(512, b"\0"))
            fat.append(first + i + 1 if i + 1 < n else END)
        return first if n else END

    mini, mini_fat, places = b"", [], {}
    for sid, (_, kind, data, _) in enumerate(entries):
        if kind == 2 and 0 < len(data) < CUTOFF:
            n, first = -(-len(data) // MINI), len(mini) // MINI
            mini += data.ljust(n * MINI, b"\0")
            mini_fat += [first + i + 1 if i + 1 < n else END for i in range(n)]
            places[sid] = first
        elif kind == 2:
            places[sid] = put(data)
    root_start = put(mini)
    mini_start = put(struct.pack(f"<{len(mini_fat)}L", *mini_fat).ljust(-(-4 * len(mini_fat) // 512) * 512, b"\xff")) if mini_fat else END
    rows = b""
    for sid, (name, kind, data, own_clsid) in enumerate(entries):
        raw = name.encode("utf-16-le")[:62]
        size = len(mini) if kind == 5 else len(data) if kind == 2 else 0
        start = root_start if kind == 5 else places.get(sid, END) if kind == 2 else 0
        rows += raw.ljust(64, b"\0") + struct.pack("<HBB3L", len(raw) + 2, kind, 1, *links[sid]) + own_clsid + struct.pack("<LQQLQ", 0, 0, 0, start, size)
    directory = put(rows.ljust(-(-len(rows) // 512) * 512, b"\0"))
    n_fat = 1
    while n_fat * 128 < len(sectors) + n_fat + max(0, -(-(n_fat - 109) // 127)):
        n_fat += 1
    n_difat = max(0, -(-(n_fat - 109) // 127))
    first_fat, first_difat = len(sectors), len(sectors) + n_fat
    words = fat + [FAT_SECTOR] * n_fat + [DIFAT_SECTOR] * n_difat
    words += [FREE] * (n_fat * 128 - len(words))
    listed = list(range(first_fat, first_fat + n_fat))
    difat = b""
    for i in range(n_difat):
        own = listed[109 + 127 * i : 236 + 127 * i]
        difat += struct.pack("<128L", *own, *[FREE] * (127 - len(own)), first_difat + i + 1 if i + 1 < n_difat else END)
    head = MAGIC + bytes(16) + struct.pack("<5H", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6)
    head += struct.pack("<9L", 0, n_fat, directory, 0, CUTOFF, mini_start, -(-4 * len(mini_fat) // 512), first_difat if n_difat else END, n_difat)
    head += struct.pack("<109L", *(listed[:109] + [FREE] * (109 - len(listed[:109]))))
    return head + b"".join(sectors) + struct.pack(f"<{len(words)}L", *words) + difat
