"""Writes PDF files for tests and queries; shares no code with what reads them."""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np

BINARY_MARK = b"%\xe2\xe3\xcf\xd3\n"


def name(text: str) -> bytes:
    return b"/" + b"".join(bytes([c]) if chr(c).isalnum() and c < 128 else b"#%02X" % c for c in text.encode())


def literal(raw: bytes) -> bytes:
    out = raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r")
    return b"(" + out + b")"


def hexed(raw: bytes) -> bytes:
    return b"<" + raw.hex().encode() + b">"


def real(x: float) -> bytes:
    return f"{x:.6f}".rstrip("0").rstrip(".").encode()


def dictionary(**entries: bytes) -> bytes:
    return b"<<" + b" ".join(b"/" + k.encode() + b" " + v for k, v in entries.items()) + b">>"


def stream(data: bytes, extra: bytes = b"") -> bytes:
    return b"<</Length %d %s>>\nstream\n" % (len(data), extra) + data + b"\nendstream"


class Writer:
    """Objects by number; ``classic`` or ``packed`` gives the file."""

    def __init__(self, version: str = "1.7"):
        self.out = f"%PDF-{version}\n".encode() + BINARY_MARK
        self.last = None

    def _place(self, objects: dict[int, bytes]) -> dict[int, int]:
        places = {}
        for num, body in objects.items():
            places[num] = len(self.out)
            self.out += b"%d 0 obj\n" % num + body + b"\nendobj\n"
        return places

    def classic(self, objects: dict[int, bytes], trailer: bytes = b"/Root 1 0 R", size: int | None = None) -> Writer:
        """A section with a table; again for an incremental update."""
        places = self._place(objects)
        at = len(self.out)
        self.out += b"xref\n"
        if self.last is None:
            self.out += b"0 1\n0000000000 65535 f \n"
        for num, place in sorted(places.items()):
            self.out += b"%d 1\n%010d 00000 n \n" % (num, place)
        before = b"" if self.last is None else b" /Prev %d" % self.last
        self.out += b"trailer\n<</Size %d %s%s>>\nstartxref\n%d\n%%%%EOF\n" % (size or max(objects, default=0) + 1, trailer, before, at)
        self.last = at
        return self

    def packed(self, plain: dict[int, bytes], inside: dict[int, bytes], trailer: bytes = b"/Root 1 0 R") -> Writer:
        """A section with a cross-reference stream and, for ``inside``, an object stream."""
        container, own = max([*plain, *inside]) + 1, max([*plain, *inside]) + 2
        if inside:
            bodies = list(inside.values())
            starts = [0]
            for b in bodies[:-1]:
                starts.append(starts[-1] + len(b) + 1)
            header = b" ".join(b"%d %d" % (n, s) for n, s in zip(inside, starts, strict=True)) + b" "
            data = zlib.compress(header + b"\n".join(bodies))
            plain = {**plain, container: stream(data, b"/Type /ObjStm /N %d /First %d /Filter /FlateDecode" % (len(inside), len(header)))}
        places = self._place(plain)
        rows = {n: (1, p, 0) for n, p in places.items()} | {n: (2, container, k) for k, n in enumerate(inside)}
        rows[own] = (1, len(self.out), 0)
        packed = b"".join(bytes([a]) + b.to_bytes(5, "big") + c.to_bytes(3, "big") for _, (a, b, c) in sorted(rows.items()))
        index = b" ".join(b"%d 1" % n for n in sorted(rows))
        before = b"" if self.last is None else b"/Prev %d " % self.last
        at = len(self.out)
        body = stream(zlib.compress(packed), b"/Type /XRef /W [1 5 3] /Index [%s] /Size %d %s/Filter /FlateDecode %s" % (index, own + 1, before, trailer))
        self.out += b"%d 0 obj\n" % own + body + b"\nendobj\nstartxref\n%d\n%%%%EOF\n" % at
        self.last = at
        return self


def one_stream(body: bytes) -> bytes:
    """A file whose object 3 is a stream."""
    return Writer().classic({1: b"<</Type /Catalog /Pages 2 0 R>>", 2: b"<</Type /Pages /Kids [] /Count 0>>", 3: body}).out


def page_file(pages: list[tuple[bytes, list[bytes]]], root: bytes = b"", info: bytes | None = None) -> bytes:
    """A file of pages, each its attributes and its content streams."""
    objects = {1: b"<</Type /Catalog /Pages 2 0 R>>"}
    kids, free = [], 3
    for attributes, contents in pages:
        own, free = free, free + 1
        refs = []
        for c in contents:
            objects[free] = stream(c)
            refs.append(b"%d 0 R" % free)
            free += 1
        objects[own] = b"<</Type /Page /Parent 2 0 R " + attributes + (b" /Contents [" + b" ".join(refs) + b"]" if refs else b"") + b">>"
        kids.append(b"%d 0 R" % own)
    objects[2] = b"<</Type /Pages /Count %d /Kids [%s] %s>>" % (len(kids), b" ".join(kids), root)
    trailer = b"/Root 1 0 R"
    if info is not None:
        objects[free] = info
        trailer += b" /Info %d 0 R" % free
    return Writer().classic(objects, trailer).out


# --- encoders, from the standard library where it has them ---


def ascii85(data: bytes) -> bytes:
    return base64.a85encode(data, adobe=True)


def run_length(data: bytes) -> bytes:
    out, at = b"", 0
    while at < len(data):
        run = 1
        while run < 128 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out += bytes([257 - run, data[at]])
            at += run
        else:
            end = at + 1
            while end < len(data) and end - at < 128 and data[end] != data[end - 1]:
                end += 1
            out += bytes([end - at - 1]) + data[at:end]
            at = end
    return out + b"\x80"


def lzw(data: bytes, early: int = 1) -> bytes:
    bits = []
    table = {bytes([b]): b for b in range(256)}
    nxt, width = 258, 9

    def put(code: int) -> None:
        bits.append(format(code, f"0{width}b"))

    put(256)
    have = b""
    for k in range(len(data)):
        more = have + data[k : k + 1]
        if more in table:
            have = more
            continue
        put(table[have])
        table[more] = nxt
        nxt += 1
        # the reader is one entry behind
        if nxt - 1 + early >= 1 << width and width < 12:
            width += 1
        if nxt >= 4094:
            put(256)
            table, nxt, width = {bytes([b]): b for b in range(256)}, 258, 9
        have = data[k : k + 1]
    if have:
        put(table[have])
        if nxt + early >= 1 << width and width < 12:
            width += 1
    put(257)
    text = "".join(bits)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


def png_rows(data: bytes, columns: int) -> bytes:
    """PNG prediction with tag 0 to 4 by turns; the data is padded to whole rows."""
    data += b"\0" * (-len(data) % columns)
    above, out = bytes(columns), b""
    for k in range(0, len(data), columns):
        row, tag = data[k : k + columns], k // columns % 5
        coded = bytearray()
        for c in range(columns):
            a, b, d = (row[c - 1] if c else 0), above[c], (above[c - 1] if c else 0)
            p = a + b - d
            near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - d) else b if abs(p - b) <= abs(p - d) else d
            coded.append((row[c] - [0, a, b, (a + b) // 2, near][tag]) & 255)
        out += bytes([tag]) + bytes(coded)
        above = row
    return out


# --- encryption, revisions 3 to 6, empty user password ---

_PAD = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")


def rc4(key: bytes, data: bytes) -> bytes:
    s = list(range(256))
    j = 0
    for i, k in enumerate((key * 256)[:256]):
        a = s[i]
        j = (j + a + k) & 255
        s[i], s[j] = s[j], a
    i = j = 0
    out = bytearray()
    for b in data:
        i = (i + 1) % 256
        j = (j + s[i]) % 256
        s[i], s[j] = s[j], s[i]
        out.append(b ^ s[(s[i] + s[j]) % 256])
    return bytes(out)


def rc4_many(keys: list[bytes], length: int) -> np.ndarray:
    """Key streams of many keys of 16 bytes, a row each; a state is a row of cells, and a step one cell of each."""
    first, spread = np.arange(len(keys)) * 256, np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)
    states = np.tile(np.arange(256, dtype=np.uint8), len(keys))
    streams = np.empty((len(keys), length), np.uint8)
    j = np.zeros(len(keys), np.uint8)
    for i in range(256):
        a = states[i::256].copy()
        j += a
        j += spread[:, i % 16]
        cell = first + j
        states[i::256] = states[cell]
        states[cell] = a
    j[:] = 0
    for k in range(length):
        i = (k + 1) % 256
        a = states[i::256].copy()
        j += a
        cell = first + j
        b = states[cell]
        states[i::256], states[cell] = b, a
        streams[:, k] = states[first + (a + b)]
    return streams


#: Streams up to this size share the lanes of ``rc4_many``.
_LANE_BYTES = 256


def _user_entries(keys: list[bytes], ids: list[bytes]) -> list[bytes]:
    """/U of many files: twenty key streams, each of another key, over one digest."""
    starts = [hashlib.md5(_PAD + file_id).digest() for file_id in ids]
    if len(keys) < 4:
        out = []
        for key, user in zip(keys, starts, strict=True):
            for k in range(20):
                user = rc4(bytes(b ^ k for b in key), user)
            out.append(user)
        return out
    streams = rc4_many([bytes(b ^ k for b in key) for key in keys for k in range(20)], 16).reshape(-1, 20, 16)
    return [(np.frombuffer(start, np.uint8) ^ np.bitwise_xor.reduce(own)).tobytes() for start, own in zip(starts, streams, strict=True)]


def _rc4_each(pairs: list[tuple[bytes, bytes]]) -> list[bytes]:
    """RC4 of each (key, data)."""
    out = [b"" if 0 < len(data) <= _LANE_BYTES and len(pairs) > 20 else rc4(key, data) for key, data in pairs]
    short = [k for k, (_, data) in enumerate(pairs) if data and not out[k]]
    if short:
        streams = rc4_many([pairs[k][0] for k in short], max(len(pairs[k][1]) for k in short))
        for k, own in zip(short, streams, strict=True):
            data = pairs[k][1]
            out[k] = (np.frombuffer(data, np.uint8) ^ own[: len(data)]).tobytes()
    return out


def encrypted(data: bytes, method: str, seed: bytes) -> bytes:
    """A file with one stream (object 3) encrypted by V2, V2-in-V4, AESV2 or AESV3."""
    return encrypted_files([(data, method, seed)])[0]


def encrypted_files(given: list[tuple[bytes, str, bytes]]) -> list[bytes]:
    """:func:`encrypted` of many (data, method, seed), RC4 of all of them together."""
    from pagequarry.sources import security  # block encryption only; decryption is what is under test

    owner, perms = b"Z" * 32, -44
    ids = [hashlib.md5(seed).digest() for _, _, seed in given]
    keys = []
    for (_, method, seed), file_id in zip(given, ids, strict=True):
        digest = hashlib.sha256(b"key" + seed).digest()
        if method != "AESV3":
            digest = hashlib.md5(_PAD + owner + (perms & 0xFFFFFFFF).to_bytes(4, "little") + file_id).digest()
            for _ in range(50):
                digest = hashlib.md5(digest).digest()
        keys.append(digest)
    legacy = [k for k, (_, method, _) in enumerate(given) if method != "AESV3"]
    users = dict(zip(legacy, _user_entries([keys[k] for k in legacy], [ids[k] for k in legacy]), strict=True))
    # RC4 streams are object 3's
    plain = [k for k in legacy if given[k][1] != "AESV2"]
    coded_by = dict(zip(plain, _rc4_each([(hashlib.md5(keys[k] + b"\3\0\0\0\0").digest(), given[k][0]) for k in plain]), strict=True))
    out = []
    for number, ((data, method, seed), file_id, key) in enumerate(zip(given, ids, keys, strict=True)):
        object_key = key
        if method == "AESV3":
            salt1, salt2 = file_id[:8], file_id[8:]
            user = hashlib.sha256(salt1).digest() + salt1 + salt2
            wrapped = security.cbc_encrypt(hashlib.sha256(salt2).digest(), bytes(16), key)
            entries = b"/V 5 /R 5 /Length 256 /O %s /U %s /OE %s /UE %s /P %d /StmF /S /StrF /S /CF <</S <</CFM /AESV3>>>>" % (hexed(bytes(48)), hexed(user), hexed(bytes(32)), hexed(wrapped), perms)
        else:
            v4 = method != "V2"
            entries = b"/V %d /R %d /Length 128 /O %s /U %s /P %d" % (4 if v4 else 2, 4 if v4 else 3, hexed(owner), hexed(users[number] + bytes(16)), perms)
            if v4:
                entries += b" /StmF /S /StrF /S /CF <</S <</CFM /%s>>>>" % (b"AESV2" if method == "AESV2" else b"V2")
            object_key = hashlib.md5(key + b"\3\0\0\0\0" + (b"sAlT" if method == "AESV2" else b"")).digest()
        if method.startswith("AES"):
            pad = 16 - len(data) % 16
            start = hashlib.md5(b"iv" + seed).digest()
            coded = start + security.cbc_encrypt(object_key, start, data + bytes([pad]) * pad)
        else:
            coded = coded_by[number]
        objects = {1: b"<</Type /Catalog /Pages 2 0 R>>", 2: b"<</Type /Pages /Kids [] /Count 0>>", 3: stream(coded), 4: b"<</Filter /Standard %s>>" % entries}
        out.append(Writer().classic(objects, b"/Root 1 0 R /Encrypt 4 0 R /ID [%s %s]" % (hexed(file_id), hexed(file_id))).out)
    return out
