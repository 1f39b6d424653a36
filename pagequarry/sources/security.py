"""The standard security handler: RC4 and AES, revisions 2 to 6.

AES works on numpy columns of blocks where there are many: decryption in CBC mode treats
all blocks of a stream at once, since each needs only its own ciphertext and the one
before.  A few blocks, and encryption, go by words of a column.  The tables are computed from the field arithmetic that defines them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np

from pagequarry.sources.syntax import PdfError

#: Padding of short passwords (fixed values).
PAD = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")
#: Ciphers by the names that crypt filters use (fixed values).
METHODS = {"V2": "rc4", "AESV2": "aes128", "AESV3": "aes256", "None": "identity"}


def rc4(key: bytes, data: bytes) -> bytes:
    state, j = list(range(256)), 0
    for i, k in enumerate((key * (256 // len(key) + 1))[:256]):
        a = state[i]
        j = (j + a + k) & 255
        state[i], state[j] = state[j], a
    i = j = 0
    stream = bytearray(len(data))
    for k in range(len(data)):
        i = (i + 1) & 255
        a = state[i]
        j = (j + a) & 255
        b = state[j]
        state[i], state[j] = b, a
        stream[k] = state[(a + b) & 255]
    return (int.from_bytes(data, "big") ^ int.from_bytes(stream, "big")).to_bytes(len(data), "big")


#: Keys from which on numpy's lanes are faster than one key after the other.
MANY_KEYS = 60


def rc4_streams(spread: np.ndarray, length: int) -> np.ndarray:
    """The first bytes of the key stream of many keys, a row a key; ``spread`` has each key repeated to 256 bytes, and all keys take each step at once."""
    n = len(spread)
    spread = np.ascontiguousarray(spread.T)
    state = np.repeat(np.arange(256, dtype=np.uint8), n).reshape(256, n)
    flat, lane, at = state.reshape(-1), np.arange(n), np.empty(n, np.intp)
    a, b, j = (np.zeros(n, np.uint8) for _ in range(3))

    def place(cell: np.ndarray) -> np.ndarray:
        np.multiply(cell, n, out=at, dtype=np.intp)
        return np.add(at, lane, out=at)

    def swap(i: int) -> None:
        """Exchange the cells i and j of each state; ``a`` and ``b`` are what they held."""
        a[:] = state[i]
        np.take(flat, place(j), out=b, mode="clip")
        flat[at] = a
        state[i] = b

    for i in range(256):
        np.add(j, state[i], out=j)
        np.add(j, spread[i], out=j)
        swap(i)
    j[:] = 0
    out = np.empty((length, n), np.uint8)
    for k in range(length):
        np.add(j, state[(k + 1) & 255], out=j)
        swap((k + 1) & 255)
        np.take(flat, place(a + b), out=out[k], mode="clip")
    return out.T


def _times(a: int, b: int) -> int:
    """Product in the field of 256 elements that AES uses."""
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = (a << 1) ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


def _substitution() -> np.ndarray:
    """The S-box: field inverse, then a fixed affine map of its bits."""
    box = []
    for x in range(256):
        inverse = next((y for y in range(256) if _times(x, y) == 1), 0)
        out = 0x63
        for turn in range(5):
            out ^= ((inverse << turn) | (inverse >> (8 - turn))) & 0xFF
        box.append(out)
    return np.array(box, np.uint8)


SBOX = _substitution()
UNBOX = np.argsort(SBOX).astype(np.uint8)
_PRODUCT = {m: np.array([_times(x, m) for x in range(256)], np.uint8) for m in (2, 3, 9, 11, 13, 14)}
#: Where each byte of the state comes from when rows are shifted left by their number, and back.
_SHIFT = np.array([((c + r) % 4) * 4 + r for c in range(4) for r in range(4)])
_UNSHIFT = np.argsort(_SHIFT)


#: Blocks from which on numpy's columns are faster than one block after the other.
MANY_BLOCKS = 64
_BOX, _INVERSE = SBOX.tolist(), UNBOX.tolist()


def _columns(box: list[int], factors: tuple[int, int, int, int]) -> list[list[int]]:
    """Substitution and mixing of a byte in row 0 to 3 as words of a column."""
    first = [int.from_bytes(bytes(_times(y, f) for f in factors), "big") for y in box]
    turned = lambda n: [(w >> 8 * n) | (w << (32 - 8 * n)) & 0xFFFFFFFF for w in first]
    return [turned(n) for n in range(4)]


_FORWARD, _BACKWARD = _columns(_BOX, (2, 1, 1, 3)), _columns(_INVERSE, (14, 9, 13, 11))


def key_words(key: bytes) -> list[int]:
    """The key schedule as words of four bytes."""
    words = [int.from_bytes(key[k : k + 4], "big") for k in range(0, len(key), 4)]
    n, turn, box = len(words), 1, _BOX
    for k in range(n, 4 * (n + 7)):
        last = words[-1]
        if k % n == 0:
            last = (box[last >> 16 & 255] ^ turn) << 24 | box[last >> 8 & 255] << 16 | box[last & 255] << 8 | box[last >> 24]
            turn = _times(turn, 2)
        elif n > 6 and k % n == 4:
            last = box[last >> 24] << 24 | box[last >> 16 & 255] << 16 | box[last >> 8 & 255] << 8 | box[last & 255]
        words.append(words[k - n] ^ last)
    return words


def round_keys(key: bytes) -> np.ndarray:
    return np.array(key_words(key), ">u4").view(np.uint8).reshape(-1, 16)


def _block(keys: list[int], block: int, tables: list[list[int]], box: list[int], turn: int) -> int:
    """One block through all rounds; ``turn`` is 1 forwards and 3 backwards, by which rows are shifted."""
    t0, t1, t2, t3 = tables
    a, b, c, d = (block >> 96) ^ keys[0], (block >> 64 & 0xFFFFFFFF) ^ keys[1], (block >> 32 & 0xFFFFFFFF) ^ keys[2], (block & 0xFFFFFFFF) ^ keys[3]
    for k in range(4, len(keys) - 4, 4):
        x, y = (b, d) if turn == 1 else (d, b)
        w0 = t0[a >> 24] ^ t1[x >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[y & 255] ^ keys[k]
        x, y = (c, a) if turn == 1 else (a, c)
        w1 = t0[b >> 24] ^ t1[x >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[y & 255] ^ keys[k + 1]
        x, y = (d, b) if turn == 1 else (b, d)
        w2 = t0[c >> 24] ^ t1[x >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[y & 255] ^ keys[k + 2]
        x, y = (a, c) if turn == 1 else (c, a)
        w3 = t0[d >> 24] ^ t1[x >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[y & 255] ^ keys[k + 3]
        a, b, c, d = w0, w1, w2, w3
    state, out = (a, b, c, d), 0
    for k in range(4):
        word = box[state[k] >> 24] << 24 | box[state[(k + turn) % 4] >> 16 & 255] << 16 | box[state[(k + 2) % 4] >> 8 & 255] << 8 | box[state[(k + 3 * turn) % 4] & 255]
        out = out << 32 | word ^ keys[k - 4]
    return out


def _backward_keys(key: bytes) -> list[int]:
    """Round keys from last to first, the inner ones mixed as ``_BACKWARD`` mixes the state."""
    words, box = key_words(key), _BOX
    t0, t1, t2, t3 = _BACKWARD
    out = words[-4:]
    for k in range(len(words) - 8, 0, -4):
        out += [t0[box[w >> 24]] ^ t1[box[w >> 16 & 255]] ^ t2[box[w >> 8 & 255]] ^ t3[box[w & 255]] for w in words[k : k + 4]]
    return out + words[:4]


def _mix(state: np.ndarray, factors: tuple[int, int, int, int]) -> np.ndarray:
    """Multiply each column of four bytes by the circulant matrix of ``factors``."""
    cells = state.reshape(-1, 4, 4)
    out = np.zeros_like(cells)
    for k, f in enumerate(factors):
        turned = np.roll(cells, -k, axis=2)
        out ^= turned if f == 1 else _PRODUCT[f][turned]
    return out.reshape(-1, 16)


def decrypt_blocks(keys: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    state = blocks
    for k in range(len(keys) - 1, 0, -1):
        state = state ^ keys[k]
        if k < len(keys) - 1:
            state = _mix(state, (14, 11, 13, 9))
        state = UNBOX[state[:, _UNSHIFT]]
    return state ^ keys[0]


def cbc_decrypt(key: bytes, start: bytes, data: bytes) -> bytes:
    if not data:
        return b""
    if len(data) < 16 * MANY_BLOCKS:
        keys, last, out = _backward_keys(key), int.from_bytes(start, "big"), []
        for k in range(0, len(data), 16):
            block = int.from_bytes(data[k : k + 16], "big")
            out.append((_block(keys, block, _BACKWARD, _INVERSE, 3) ^ last).to_bytes(16, "big"))
            last = block
        return b"".join(out)
    blocks = np.frombuffer(data, np.uint8).reshape(-1, 16)
    before = np.concatenate([np.frombuffer(start, np.uint8).reshape(1, 16), blocks[:-1]])
    return (decrypt_blocks(round_keys(key), blocks) ^ before).tobytes()


def cbc_encrypt(key: bytes, start: bytes, data: bytes) -> bytes:
    keys, last, out = key_words(key), int.from_bytes(start, "big"), []
    for k in range(0, len(data), 16):
        last = _block(keys, int.from_bytes(data[k : k + 16], "big") ^ last, _FORWARD, _BOX, 1)
        out.append(last.to_bytes(16, "big"))
    return b"".join(out)


def aes_stream(key: bytes, data: bytes) -> bytes:
    """CBC with the initial vector in front; wrong padding is left in place."""
    if len(data) < 16:
        raise PdfError("AES data shorter than its initial vector")
    if len(data) % 16:
        raise PdfError("AES data is not whole blocks")
    out = cbc_decrypt(key, data[:16], data[16:])
    return out[: -out[-1]] if out and 1 <= out[-1] <= 16 else out


@dataclass
class Settings:
    """What the /Encrypt dictionary says."""

    version: int = 0
    revision: int = 0
    length: int = 40
    permissions: int = 0
    owner: bytes = b""
    user: bytes = b""
    owner_key: bytes = b""
    user_key: bytes = b""
    file_id: bytes = b""
    metadata: bool = True
    stream_filter: str = ""
    methods: dict[str, str] = field(default_factory=dict)


def object_key(file_key: bytes, num: int, gen: int, aes: bool) -> bytes:
    whole = file_key + (num & 0xFFFFFF).to_bytes(3, "little") + (gen & 0xFFFF).to_bytes(2, "little") + b"sAlT" * aes
    return hashlib.md5(whole).digest()[: min(len(file_key) + 5, 16)]


def legacy_key(s: Settings, password: bytes) -> bytes:
    """File key of revisions 2 to 4, before it is checked."""
    size = s.length // 8 or 5
    if s.length < 0 or not 1 <= size <= 16:
        raise PdfError(f"invalid key length of {s.length} bits")
    seed = (password + PAD)[:32] + s.owner + (s.permissions & 0xFFFFFFFF).to_bytes(4, "little") + s.file_id
    if s.revision >= 4 and not s.metadata:
        seed += b"\xff" * 4
    digest = hashlib.md5(seed).digest()
    for _ in range(50 * (s.revision >= 3)):
        digest = hashlib.md5(digest[:size]).digest()
    return digest[:size]


def user_entry(s: Settings, key: bytes) -> bytes:
    """What /U must begin with for a key to be right."""
    if s.revision == 2:
        return rc4(key, PAD)
    out = hashlib.md5(PAD + s.file_id).digest()
    for k in range(20):
        out = rc4(bytes(b ^ k for b in key), out)
    return out


def user_entries(settings: list[Settings], keys: list[bytes]) -> list[bytes]:
    """:func:`user_entry` of many files of revisions from 3 on; each is a sum of key streams, so all rounds are taken at once."""
    if 20 * len(keys) < MANY_KEYS:
        return [user_entry(s, k) for s, k in zip(settings, keys, strict=True)]
    spread = np.frombuffer(b"".join((k * (256 // len(k) + 1))[:256] for k in keys), np.uint8).reshape(-1, 1, 256)
    turned = spread ^ np.arange(20, dtype=np.uint8)[:, None]
    streams = rc4_streams(turned.reshape(-1, 256), 16).reshape(-1, 20, 16)
    starts = np.frombuffer(b"".join(hashlib.md5(PAD + s.file_id).digest() for s in settings), np.uint8).reshape(-1, 16)
    return [row.tobytes() for row in starts ^ np.bitwise_xor.reduce(streams, axis=1)]


def hash_v5(password: bytes, salt: bytes, extra: bytes, revision: int) -> bytes:
    key = hashlib.sha256(password + salt + extra).digest()
    if revision == 5:
        return key
    if revision != 6:
        raise PdfError(f"unsupported revision {revision}")
    for turn in range(1, 1002):
        coded = cbc_encrypt(key[:16], key[16:32], (password + key + extra) * 64)
        # 256 is 1 modulo 3, so the number modulo 3 is the sum of its bytes modulo 3
        kind = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(coded[:16]) % 3]
        key = kind(coded).digest()
        if turn >= 64 and coded[-1] <= turn - 32:
            return key[:32]
    raise PdfError("too many rounds in the password hash")


def modern_key(s: Settings, password: bytes) -> bytes:
    """File key of version 5: the user's entries first, then the owner's."""
    if len(s.user) < 48 or len(s.owner) < 48 or len(s.user_key) < 32 or len(s.owner_key) < 32:
        raise PdfError("encryption entries are too short")
    password = password[:127]
    for entry, wrapped, extra in ((s.user, s.user_key, b""), (s.owner, s.owner_key, s.user[:48])):
        if hash_v5(password, entry[32:40], extra, s.revision) == entry[:32]:
            if len(wrapped) != 32:
                raise PdfError("wrapped key has the wrong size")
            return cbc_decrypt(hash_v5(password, entry[40:48], extra, s.revision), bytes(16), wrapped)
    raise PdfError("password incorrect")


class Handler:
    """Decrypts streams once a password has been accepted; ``later`` leaves that to :func:`refused` where many files can be asked at once."""

    def __init__(self, s: Settings, password: bytes = b"", later: bool = False):
        self.unchecked: Settings | None = None
        for method in s.methods.values():
            if method not in METHODS:
                raise PdfError(f"unknown crypt filter method {method}")
        if s.version in (1, 2):
            self.cipher = "rc4"
        elif s.version == 4:
            self.cipher = METHODS[s.methods.get(s.stream_filter, "None")]
        elif s.version == 5:
            self.cipher = "aes256"
        else:
            raise PdfError(f"unsupported encryption version {s.version}")
        if s.version == 5:
            self.key = modern_key(s, password)
        else:
            self.key = legacy_key(s, password)
            if later and s.revision != 2:
                self.unchecked = s
                return
            wanted = user_entry(s, self.key)
            if (s.user if s.revision == 2 else s.user[:16]) != wanted:
                raise PdfError("password incorrect")

    def decrypt(self, data: bytes, num: int, gen: int) -> bytes:
        if self.cipher == "identity":
            return data
        if self.cipher == "rc4":
            return rc4(object_key(self.key, num, gen, False), data)
        return aes_stream(self.key if self.cipher == "aes256" else object_key(self.key, num, gen, True), data)


def refused(handlers: list[Handler]) -> list[bool]:
    """Whether the password of each handler that was left unchecked is wrong."""
    wanted = user_entries([h.unchecked for h in handlers], [h.key for h in handlers])
    out = [h.unchecked.user[:16] != w for h, w in zip(handlers, wanted, strict=True)]
    for h in handlers:
        h.unchecked = None
    return out
