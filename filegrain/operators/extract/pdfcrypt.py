"""PDF standard security handler for an empty user password: RC4 and AES, revisions 2 to 6.

AES is OpenSSL's, from the library that hashlib has loaded; where there is none it is computed here, hundreds of times slower.
"""

from __future__ import annotations

import ctypes
import hashlib
from dataclasses import dataclass
from functools import cache

PAD = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")


def rc4(key: bytes, data: bytes) -> bytes:
    box, j = list(range(256)), 0
    for i in range(256):
        j = (j + box[i] + key[i % len(key)]) & 255
        box[i], box[j] = box[j], box[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, x in enumerate(data):
        i = (i + 1) & 255
        j = (j + box[i]) & 255
        box[i], box[j] = box[j], box[i]
        out[n] = x ^ box[(box[i] + box[j]) & 255]
    return bytes(out)


# --- AES (FIPS 197); tables are computed from the field


@cache
def _tables() -> tuple[bytes, bytes, list[bytes]]:
    """S-box, its inverse, and products with 2, 3, 9, 11, 13, 14."""
    power, log, x = [0] * 256, [0] * 256, 1
    for i in range(255):
        power[i], log[x] = x, i
        x ^= (x << 1) ^ (0x11B if x & 128 else 0)
        x &= 255
    times = lambda a, b: power[(log[a] + log[b]) % 255] if a and b else 0
    sbox = bytearray(256)
    for a in range(256):
        inverse = power[-log[a] % 255] if a else 0
        bits = inverse
        for k in range(1, 5):
            bits ^= (inverse << k | inverse >> 8 - k) & 255
        sbox[a] = bits ^ 0x63
    back = bytearray(256)
    for a, b in enumerate(sbox):
        back[b] = a
    return bytes(sbox), bytes(back), [bytes(times(a, f) for a in range(256)) for f in (2, 3, 9, 11, 13, 14)]


def _round_keys(key: bytes) -> list[bytes]:
    sbox, n = _tables()[0], len(key) // 4
    w, constant = [key[4 * i : 4 * i + 4] for i in range(n)], 1
    for i in range(n, 4 * (n + 7)):
        t = w[-1]
        if i % n == 0:
            t = bytes(sbox[x] for x in t[1:] + t[:1])
            t = bytes([t[0] ^ constant]) + t[1:]
            constant = (constant << 1) ^ (0x11B if constant & 128 else 0)
        elif n > 6 and i % n == 4:
            t = bytes(sbox[x] for x in t)
        w.append(bytes(a ^ b for a, b in zip(w[i - n], t, strict=True)))
    return [b"".join(w[i : i + 4]) for i in range(0, len(w), 4)]


ROWS = [(5 * i) % 16 for i in range(16)]
ROWS_BACK = [(13 * i) % 16 for i in range(16)]


def _xor(a: bytes, b: bytes) -> bytes:
    return (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).to_bytes(len(a), "big")


def _encrypt_block(keys: list[bytes], block: bytes) -> bytes:
    sbox, _, (m2, m3, *_rest) = _tables()
    s = _xor(block, keys[0])
    for k in keys[1:-1]:
        t = [sbox[s[i]] for i in ROWS]
        s = _xor(bytes(v for c in range(0, 16, 4) for a, b, d, e in [t[c : c + 4]] for v in (m2[a] ^ m3[b] ^ d ^ e, a ^ m2[b] ^ m3[d] ^ e, a ^ b ^ m2[d] ^ m3[e], m3[a] ^ b ^ d ^ m2[e])), k)
    return _xor(bytes(sbox[s[i]] for i in ROWS), keys[-1])


def _decrypt_block(keys: list[bytes], block: bytes) -> bytes:
    _, back, (_, _, m9, m11, m13, m14) = _tables()
    s = _xor(block, keys[-1])
    for k in reversed(keys[1:-1]):
        t = _xor(bytes(back[s[i]] for i in ROWS_BACK), k)
        s = bytes(v for c in range(0, 16, 4) for a, b, d, e in [t[c : c + 4]] for v in (m14[a] ^ m11[b] ^ m13[d] ^ m9[e], m9[a] ^ m14[b] ^ m11[d] ^ m13[e], m13[a] ^ m9[b] ^ m14[d] ^ m11[e], m11[a] ^ m13[b] ^ m9[d] ^ m14[e]))
    return _xor(bytes(back[s[i]] for i in ROWS_BACK), keys[0])


@cache
def _openssl():
    """libcrypto with the types of what is called here; None if it can't be loaded."""
    for name in ("libcrypto.so.3", "libcrypto.so.1.1", "libcrypto.3.dylib"):
        try:
            lib = ctypes.CDLL(name)
            for f in ("EVP_CIPHER_CTX_new", "EVP_aes_128_cbc", "EVP_aes_192_cbc", "EVP_aes_256_cbc"):
                getattr(lib, f).restype, getattr(lib, f).argtypes = ctypes.c_void_p, []
            lib.EVP_CIPHER_CTX_free.restype, lib.EVP_CIPHER_CTX_free.argtypes = None, [ctypes.c_void_p]
            lib.EVP_CIPHER_CTX_set_padding.argtypes = [ctypes.c_void_p, ctypes.c_int]
            lib.EVP_CipherInit_ex.argtypes = [ctypes.c_void_p, ctypes.c_void_p, ctypes.c_void_p, ctypes.c_char_p, ctypes.c_char_p, ctypes.c_int]
            lib.EVP_CipherUpdate.argtypes = [ctypes.c_void_p, ctypes.c_void_p, ctypes.POINTER(ctypes.c_int), ctypes.c_char_p, ctypes.c_int]
            return lib
        except (OSError, AttributeError):
            continue
    return None


def _aes_cbc_openssl(key: bytes, iv: bytes, data: bytes, encrypt: bool) -> bytes | None:
    """The same as aes_cbc; None if the library doesn't do it."""
    lib, parts, step = _openssl(), [], 1 << 30
    data = data[: len(data) // 16 * 16]
    if lib is None or len(key) not in (16, 24, 32) or len(iv) != 16:
        return None
    ctx = lib.EVP_CIPHER_CTX_new()
    try:
        if not ctx or lib.EVP_CipherInit_ex(ctx, getattr(lib, f"EVP_aes_{8 * len(key)}_cbc")(), None, key, iv, int(encrypt)) != 1:
            return None
        lib.EVP_CIPHER_CTX_set_padding(ctx, 0)
        for at in range(0, len(data), step):
            part = data[at : at + step]
            out, n = ctypes.create_string_buffer(len(part) + 16), ctypes.c_int(0)
            if lib.EVP_CipherUpdate(ctx, out, ctypes.byref(n), part, len(part)) != 1 or n.value != len(part):
                return None
            parts.append(out.raw[: n.value])
    finally:
        lib.EVP_CIPHER_CTX_free(ctx)
    return b"".join(parts)


def aes_cbc(key: bytes, iv: bytes, data: bytes, encrypt: bool = False) -> bytes:
    """Whole blocks without padding."""
    if (done := _aes_cbc_openssl(key, iv, data, encrypt)) is not None:
        return done
    keys, out, last = _round_keys(key), [], iv
    for i in range(0, len(data) - 15, 16):
        block = data[i : i + 16]
        if encrypt:
            last = _encrypt_block(keys, _xor(block, last))
            out.append(last)
        else:
            out.append(_xor(_decrypt_block(keys, block), last))
            last = block
    return b"".join(out)


def aes_data(key: bytes, data: bytes) -> bytes:
    """A string or stream: initialisation vector first, padding last where it is valid."""
    out = aes_cbc(key, data[:16], data[16:])
    n = out[-1] if out else 0
    return out[:-n] if 0 < n <= 16 and out.endswith(bytes([n]) * n) else out


def hash_r6(password: bytes, salt: bytes, more: bytes = b"") -> bytes:
    """Algorithm 2.B of ISO 32000-2."""
    k, rounds, last = hashlib.sha256(password + salt + more).digest(), 0, 0
    while rounds < 64 or last > rounds - 32:
        e = aes_cbc(k[:16], k[16:32], (password + k + more) * 64, encrypt=True)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        rounds, last = rounds + 1, e[-1]
    return k[:32]


@dataclass
class Crypt:
    ok: bool
    about: str = ""
    reason: str = ""
    strings: str = "none"
    streams: str = "none"
    key: bytes = b""
    metadata: bool = True

    def read(self, method: str, data: bytes, number: int, generation: int) -> bytes:
        if method == "none" or not data:
            return data
        if method == "AES-256":
            return aes_data(self.key, data)
        salt = number.to_bytes(4, "little")[:3] + (generation & 0xFFFF).to_bytes(2, "little") + (b"sAlT" if method == "AES-128" else b"")
        own = hashlib.md5(self.key + salt).digest()[: min(len(self.key) + 5, 16)]
        return aes_data(own, data) if method == "AES-128" else rc4(own, data)


NEEDED = "A user password is required to open it"


def open_empty(E: dict, id0: bytes) -> Crypt:
    """E: the encryption dictionary in plain values (names as str, strings as bytes)."""
    if E.get("Filter") != "Standard":
        return Crypt(False, reason=f"Unsupported security handler: {E.get('Filter')}")
    V, R, P = int(E.get("V", 0)), int(E.get("R", 2)), int(E.get("P", 0)) & 0xFFFFFFFF
    O, U, whole = E.get("O", b""), E.get("U", b""), E.get("EncryptMetadata", True) is not False  # noqa: E741

    def method(name) -> str:
        if V < 4:
            return "RC4"
        entry = (E.get("CF") or {}).get(name) or {}
        return {"AESV2": "AES-128", "AESV3": "AES-256", "V2": "RC4"}.get(entry.get("CFM"), "none") if name and name != "Identity" else "none"

    streams, strings = method(E.get("StmF")), method(E.get("StrF"))
    about = f"{streams if streams == strings else f'{streams}/{strings}'} (R{R})"
    if R >= 5:
        check, salt = U[32:40], U[40:48]
        digest = (lambda s: hashlib.sha256(s).digest()) if R == 5 else (lambda s: hash_r6(b"", s))
        if digest(check) != U[:32]:
            return Crypt(False, about, NEEDED)
        key = aes_cbc(digest(salt), bytes(16), E.get("UE", b"")[:32])
    else:
        n = 5 if R == 2 else 16 if "AES-128" in (streams, strings) else int(E.get("Length", 40)) // 8
        key = hashlib.md5(PAD + O[:32] + P.to_bytes(4, "little") + id0 + (b"\xff" * 4 if R >= 4 and not whole else b"")).digest()
        for _ in range(50 if R >= 3 else 0):
            key = hashlib.md5(key[:n]).digest()
        key = key[:n]
        if R == 2:
            right = rc4(key, PAD) == U[:32]
        else:
            x = rc4(key, hashlib.md5(PAD + id0).digest())
            for i in range(1, 20):
                x = rc4(bytes(k ^ i for k in key), x)
            right = x[:16] == U[:16]
        if not right:
            return Crypt(False, about, NEEDED)
    return Crypt(True, about, "", strings, streams, key, whole)
