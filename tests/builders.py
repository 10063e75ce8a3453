"""Small artefact files, put together field by field for the reader tests."""

import struct

TICKS = 132223104000000000  # 2020-01-01


def utf16(s):
    return s.encode("utf-16-le")


# --- event logs -----------------------------------------------------------------------------------


class ChunkBuilder:
    """A chunk of an event log: records refer to names and templates by their place in the chunk."""

    def __init__(self):
        self.data = bytearray(b"ElfChnk\0".ljust(512, b"\0"))
        self.names = {}
        self.templates = {}

    def name(self, out, text):
        """Offset of a name, followed by the name where it is met first."""
        at = len(self.data) + len(out)
        if text in self.names:
            out += struct.pack("<I", self.names[text])
        else:
            self.names[text] = at + 4
            out += struct.pack("<IIHH", at + 4, 0, 0, len(text)) + utf16(text) + b"\0\0"

    def element(self, out, node):
        """``(name, {attribute: content}, [content])``; content is text, ``("slot", index, type)`` or an element."""
        name, attributes, content = node
        out += bytes([0x41 if attributes else 0x01]) + struct.pack("<HI", 0xFFFF, 0)
        self.name(out, name)
        if attributes:
            out += struct.pack("<I", 0)
        for k, v in attributes.items():
            out += b"\x06"
            self.name(out, k)
            self.item(out, v)
        if content:
            out += b"\x02"
            for c in content:
                self.item(out, c)
            out += b"\x04"
        else:
            out += b"\x03"

    def item(self, out, c):
        if isinstance(c, str):
            out += struct.pack("<BBH", 5, 1, len(c)) + utf16(c)
        elif c[0] == "slot":
            out += struct.pack("<BHB", 0x0E, c[1], c[2])
        else:
            self.element(out, c)

    def record(self, number, template, values, damaged=False):
        """``values``: (type, bytes) for the template's slots."""
        start = len(self.data)
        self.data += struct.pack("<IIQQ", 0x2A2A, 0, number, TICKS + number * 10)
        out = bytearray(b"\x0f\x01\x01\x00\x0c\x01") + struct.pack("<I", 7)
        key = id(template)
        if key in self.templates:
            out += struct.pack("<I", self.templates[key])
        else:
            self.templates[key] = len(self.data) + len(out) + 4
            out += struct.pack("<I", self.templates[key])
            head = len(out)
            out += struct.pack("<I", 0) + b"\7" * 16 + struct.pack("<I", 0) + b"\x0f\x01\x01\x00"
            self.element(out, template)
            out += b"\0"
            struct.pack_into("<I", out, head + 20, len(out) - head - 24)
        out += struct.pack("<I", len(values))
        for kind, data in values:
            out += struct.pack("<HBB", len(data), kind, 0)
        for _, data in values:
            out += data
        if damaged:
            out[4] = 0x3A
        self.data += out
        size = len(self.data) - start + 4
        self.data += struct.pack("<I", size)
        struct.pack_into("<I", self.data, start + 4, size)

    def done(self):
        struct.pack_into("<I", self.data, 48, len(self.data))
        return bytes(self.data.ljust(65_536, b"\0"))


LOGON = ("Event", {"xmlns": "http://x"}, [
    ("System", {}, [
        ("Provider", {"Name": "Auditing", "Guid": ("slot", 0, 15)}, []), ("EventID", {"Qualifiers": ("slot", 1, 6)}, [("slot", 2, 6)]), ("Version", {}, ["0"]),
        ("TimeCreated", {"SystemTime": ("slot", 3, 17)}, []), ("Computer", {}, ["HOST-<1>"]), ("Security", {"UserID": ("slot", 4, 19)}, []),
    ]),
    ("EventData", {}, [("Data", {"Name": "TargetUserName"}, [("slot", 5, 1)]), ("Data", {"Name": "LogonType"}, [("slot", 6, 8)]), ("Data", {"Name": "IpPort"}, [("slot", 7, 1)]), ("Data", {}, [("slot", 8, 1)])]),
])


def logon(chunk, number, user, sid=b"", **options):
    values = [(15, bytes(range(16))), (0, b""), (6, struct.pack("<H", 4624)), (17, struct.pack("<Q", TICKS)), (19 if sid else 0, sid), (1, utf16(user)), (8, struct.pack("<I", 5)), (1, utf16("0")), (1, utf16("free"))]
    chunk.record(number, LOGON, values, **options)


def event_log(chunks=2, records=3):
    out = b"ElfFile\0".ljust(4096, b"\0")
    for c in range(chunks):
        chunk = ChunkBuilder()
        for i in range(records):
            logon(chunk, c * records + i + 1, f"user<{c}>&{i}", bytes([1, 2, 0, 0, 0, 0, 0, 5]) + struct.pack("<II", 32, 544) if i == 0 else b"")
        out += chunk.done()
    return out


# --- registry hives -------------------------------------------------------------------------------


class HiveBuilder:
    def __init__(self):
        self.bins = bytearray(b"hbin".ljust(32, b"\0"))

    def cell(self, body):
        at = len(self.bins)
        size = (len(body) + 4 + 7) // 8 * 8
        self.bins += struct.pack("<i", -size) + body.ljust(size - 4, b"\0")
        return at

    def value(self, name, kind, data):
        raw = name.encode("cp1252")
        if len(data) <= 4:
            size, at = len(data) | 0x80000000, struct.unpack("<I", data.ljust(4, b"\0"))[0]
        else:
            size, at = len(data), self.cell(data)
        return self.cell(struct.pack("<2sHIIIHH", b"vk", len(raw), size, at, kind, 1, 0) + raw)

    def key(self, name, values=(), subkeys=(), wide=False, lists=b"lf"):
        """``values``: (name, type, bytes); ``subkeys``: offsets."""
        raw = utf16(name) if wide else name.encode("cp1252")
        vlist = self.cell(b"".join(struct.pack("<I", self.value(*v)) for v in values)) if values else 0xFFFFFFFF
        klist = 0xFFFFFFFF
        if subkeys and lists == b"ri":
            inner = [self.cell(struct.pack("<2sH", b"li", 1) + struct.pack("<I", o)) for o in subkeys]
            klist = self.cell(struct.pack("<2sH", b"ri", len(inner)) + b"".join(struct.pack("<I", o) for o in inner))
        elif subkeys:
            klist = self.cell(struct.pack("<2sH", lists, len(subkeys)) + b"".join(struct.pack("<II", o, 0) for o in subkeys))
        head = struct.pack("<2sHQIIIIIIIIII", b"nk", 0 if wide else 0x20, TICKS, 0, 0, len(subkeys), 0, klist, 0xFFFFFFFF, len(values), vlist, 0, 0)
        return self.cell(head.ljust(72, b"\0") + struct.pack("<HH", len(raw), 0) + raw)

    def done(self, root, sequences=(1, 1)):
        base = bytearray(b"regf".ljust(4096, b"\0"))
        struct.pack_into("<II", base, 4, *sequences)
        struct.pack_into("<II", base, 0x24, root, len(self.bins))
        return bytes(base + self.bins)


def sz(s):
    return utf16(s) + b"\0\0"


def tree(b, spec, name="ROOT"):
    """Keys from nested dicts: dicts are subkeys, (type, bytes) tuples values."""
    values = [(k, *v) for k, v in spec.items() if isinstance(v, tuple)]
    return b.key(name, values, [tree(b, v, k) for k, v in spec.items() if isinstance(v, dict)])


def hive(spec):
    b = HiveBuilder()
    return b.done(tree(b, spec))


def hive_log(sequence, pages):
    body = b"".join(struct.pack("<II", o, len(p)) for o, p in pages) + b"".join(p for _, p in pages)
    size = (40 + len(body) + 511) // 512 * 512
    return b"\0" * 512 + (b"HvLE" + struct.pack("<IIIII", size, 0, sequence, 0, len(pages)) + b"\0" * 16 + body).ljust(size, b"\0")


# --- ESE databases --------------------------------------------------------------------------------

PAGE = 4096


def ese_record(fixed, variable=(), tagged=(), nulls=b""):
    """``fixed``: bytes of each column in order; ``variable``: bytes; ``tagged``: (number, flags or None, bytes)."""
    body = b"".join(fixed) + (nulls or b"\0" * ((len(fixed) + 7) // 8))
    out = struct.pack("<BBH", len(fixed), 127 + len(variable), 4 + len(body)) + body
    end = 0
    for v in variable:
        end += len(v)
        out += struct.pack("<H", end)
    out += b"".join(variable)
    if tagged:
        at, slots, data = 4 * len(tagged), b"", b""
        for number, flags, v in tagged:
            slots += struct.pack("<HH", number, (at + len(data)) | (0x4000 if flags is not None else 0))
            data += (bytes([flags]) if flags is not None else b"") + v
        out += slots + data
    return out


def ese_page(number, entries, flags=2):
    """A leaf page; ``entries``: (key, record)."""
    data, tags = b"", [(0, 0)]
    for key, record in entries:
        body = struct.pack("<H", len(key)) + key + record
        tags.append((len(body), len(data)))
        data += body
    head = bytearray(40)
    struct.pack_into("<IHHHI", head, 24, number, 0, 0, len(tags), flags)
    page = bytes(head) + data
    foot = b"".join(struct.pack("<HH", size, place) for size, place in reversed(tags))
    return page.ljust(PAGE - len(foot), b"\0") + foot


def catalogue_row(table, kind, own, kind_or_page, size, locale, name):
    fixed = [struct.pack("<I", table), struct.pack("<H", kind), struct.pack("<I", own), struct.pack("<I", kind_or_page), struct.pack("<I", size), struct.pack("<I", 0), struct.pack("<I", locale)]
    return ese_record(fixed, [name.encode()])


def ese_database(tables, apart=()):
    """``tables``: (object number, name, [(number, name, type, code page)], [records]); ``apart``: (object, [(key, data)])."""
    rows = []
    for number, name, columns, _ in tables:
        rows.append(catalogue_row(number, 1, number, 1, 0, 0, name))
        rows += [catalogue_row(number, 2, n, kind, 0, page, c) for n, c, kind, page in columns]
    pages = [ese_page(2, [(struct.pack(">I", i), r) for i, r in enumerate(rows)])]
    pages += [ese_page(number, [(struct.pack(">I", i), r) for i, r in enumerate(records)]) for number, _, _, records in tables]
    pages += [ese_page(number, entries, 2 | 0x80) for number, entries in apart]
    head = bytearray(PAGE)
    struct.pack_into("<I", head, 4, 0x89ABCDEF)
    struct.pack_into("<I", head, 232, 0x0C)
    struct.pack_into("<I", head, 236, PAGE)
    return bytes(head) * 2 + b"".join(pages)


# --- program caches -------------------------------------------------------------------------------


def cache10(entries, header=0x34):
    out = struct.pack("<I", header).ljust(header, b"\0")
    for path, ft, data in entries:
        raw = utf16(path)
        body = struct.pack("<H", len(raw)) + raw + struct.pack("<QI", ft, len(data)) + data
        out += b"10ts" + struct.pack("<II", 0, len(body)) + body
    return out


def cache8(entries, signature=b"10ts"):
    out = b"\x80".ljust(128, b"\0")
    for path, ft, executed in entries:
        raw = utf16(path)
        body = struct.pack("<H", len(raw)) + raw + struct.pack("<HIIQI", 0, 2 if executed else 0, 0, ft, 0)
        out += signature + struct.pack("<II", 0, len(body)) + body
    return out


def cache7(entries, wide=True):
    rows, text = b"", b""
    size = 48 if wide else 32
    at = 128 + size * len(entries)
    for path, ft, executed in entries:
        raw = utf16(path)
        if wide:
            rows += struct.pack("<HHIQQIIQQ", len(raw), len(raw) + 2, 0, at + len(text), ft, 2 if executed else 0, 0, 0, 0)
        else:
            rows += struct.pack("<HHIQIIII", len(raw), len(raw) + 2, at + len(text), ft, 2 if executed else 0, 0, 0, 0)
        text += raw + b"\0\0"
    return struct.pack("<II", 0xBADC0FEE, len(entries)).ljust(128, b"\0") + rows + text
