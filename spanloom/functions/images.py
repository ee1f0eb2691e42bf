"""Pixels out of image bytes without an image library: PNG (8 bits, not interlaced) and binary PPM/PGM."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode(data: bytes | None) -> tuple[str, np.ndarray] | None:
    """(format, height x width x 3 bytes), or None for bytes that can't be read."""
    try:
        if data and bytes(data[:8]) == b"\x89PNG\r\n\x1a\n":
            return "PNG", _png(bytes(data))
        if data and bytes(data[:2]) in (b"P5", b"P6"):
            return "PPM", _ppm(bytes(data))
    except (ValueError, IndexError, struct.error, zlib.error):
        return None
    return None


def _ppm(data: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    w, h, top = fields
    n = 3 if data[:2] == b"P6" else 1
    if top != 255:
        raise ValueError("8 bits a sample only")
    return _rgb(np.frombuffer(data, dtype=np.uint8, count=w * h * n, offset=at + 1).reshape(h, w, n))


def _png(data: bytes) -> np.ndarray:
    at, body, head, palette = 8, b"", None, None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, dtype=np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
    if head is None or head[2] != 8 or head[6]:
        raise ValueError("8 bits, not interlaced, only")
    w, h, kind = head[0], head[1], head[3]
    n = _CHANNELS[kind]
    rows = np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h + 1, w + 1, n), dtype=np.int64)  # a row and a column of zeros stand before the first
    for y in range(h):
        how, raw = rows[y, 0], rows[y, 1:].reshape(w, n).astype(np.int64)
        up = out[y, 1:]
        if how == 0:
            out[y + 1, 1:] = raw
        elif how == 1:
            out[y + 1, 1:] = np.cumsum(raw, axis=0) % 256
        elif how == 2:
            out[y + 1, 1:] = (raw + up) % 256
        else:
            for x in range(w):
                a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
                if how == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
                    guess = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
                out[y + 1, x + 1] = (raw[x] + guess) % 256
    pixels = out[1:, 1:].astype(np.uint8)
    return palette[pixels[:, :, 0]] if kind == 3 and palette is not None else _rgb(pixels)


def _rgb(p: np.ndarray) -> np.ndarray:
    """Three channels; transparency is dropped."""
    return np.repeat(p[:, :, :1], 3, axis=2) if p.shape[2] < 3 else p[:, :, :3]


def gray(p: np.ndarray) -> np.ndarray:
    return p.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def resized(p: np.ndarray, h: int, w: int) -> np.ndarray:
    """Nearest pixels at another size."""
    return p[np.arange(h) * p.shape[0] // h][:, np.arange(w) * p.shape[1] // w]


def encode_png(p: np.ndarray) -> bytes:
    """A PNG of height x width x 3 bytes (for tests and sinks)."""
    h, w, _ = p.shape
    raw = b"".join(b"\0" + p[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
