"""TIFF and PNG planes, decoded and encoded with the standard library and NumPy.

TIFF: single plane, 8/16/32-bit integers or floats, strips or tiles, uncompressed, Deflate, LZW or PackBits, with or without
horizontal differencing. PNG: greyscale 8 or 16 bits, palette and colour for writing; not interlaced.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: TIFF field type -> struct code.
TIFF_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"


def lzw_decode(data: bytes) -> bytes:
    out, table, width, code_bits, bits, previous = bytearray(), [], 9, 0, 0, b""
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    for byte in data:
        bits, code_bits = bits << 8 | byte, code_bits + 8
        while code_bits >= width:
            code = bits >> (code_bits - width)
            code_bits -= width
            bits &= (1 << code_bits) - 1
            if code == 256:
                table, width, previous = table[:258], 9, b""
                continue
            if code == 257:
                return bytes(out)
            entry = table[code] if code < len(table) else previous + previous[:1]
            out += entry
            if previous:
                table.append(previous + entry[:1])
            previous = entry
            width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def packbits_decode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


DECODERS = {1: lambda d: d, 5: lzw_decode, 8: zlib.decompress, 32946: zlib.decompress, 32773: packbits_decode}


def decode_tiff(data: bytes) -> np.ndarray:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, = struct.unpack_from(order + "I", data, 4)
    tags = {}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        code = TIFF_TYPES.get(kind)
        if code in (None, "s"):
            continue
        where = at + 10 + 12 * i
        if n * struct.calcsize(code) > 4:
            where, = struct.unpack_from(order + "I", data, where)
        tags[tag] = struct.unpack_from(f"{order}{n}{code}", data, where)
    width, height = tags[256][0], tags[257][0]
    bits, form = tags.get(258, (1,))[0], tags.get(339, (1,))[0]
    if tags.get(277, (1,))[0] != 1:
        raise ValueError("a mask plane must have one sample per pixel")
    if bits not in (8, 16, 32, 64):
        raise ValueError(f"TIFF with {bits} bits per pixel is not supported")
    dtype = np.dtype(order + {1: "u", 2: "i", 3: "f"}[form] + str(bits // 8))
    decode = DECODERS.get(tags.get(259, (1,))[0])
    if decode is None:
        raise ValueError(f"TIFF compression {tags[259][0]} is not supported")
    tiled = 324 in tags
    offsets, counts = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    w, h = (tags[322][0], tags[323][0]) if tiled else (width, min(tags.get(278, (height,))[0], height))
    out = np.zeros((-(-height // h) * h, -(-width // w) * w), dtype.newbyteorder("="))
    across = out.shape[1] // w
    for i, (o, n) in enumerate(zip(offsets, counts)):
        raw = np.frombuffer(decode(data[o : o + n]), dtype)
        block = raw[: len(raw) // w * w].reshape(-1, w)
        if tags.get(317, (1,))[0] == 2:
            block = np.cumsum(block, axis=1, dtype=out.dtype)
        y, x = i // across * h, i % across * w
        out[y : y + len(block), x : x + w] = block[: out.shape[0] - y]
    return out[:height, :width]


def encode_tiff(image: np.ndarray, palette: np.ndarray | None = None) -> bytes:
    """One Deflate strip; a 3 x 256 uint16 palette makes it a palette image."""
    image = np.ascontiguousarray(image)
    rgb = image.ndim == 3
    body = zlib.compress(image.astype(image.dtype.newbyteorder("<")).tobytes())
    form = {"u": 1, "b": 1, "i": 2, "f": 3}[image.dtype.kind]
    entries = [(256, 4, (image.shape[1],)), (257, 4, (image.shape[0],)), (258, 3, (image.dtype.itemsize * 8,) * (3 if rgb else 1)), (259, 3, (8,)), (262, 3, (2 if rgb else 3 if palette is not None else 1,))]
    entries += [(273, 4, (8,)), (277, 3, (3 if rgb else 1,)), (278, 4, (image.shape[0],)), (279, 4, (len(body),)), (339, 3, (form,) * (3 if rgb else 1))]
    if palette is not None:
        entries.append((320, 3, tuple(int(v) for v in palette.ravel())))
    entries.sort()
    at = 8 + len(body) + len(body) % 2
    extra_at, extra, directory = at + 2 + 12 * len(entries) + 4, b"", struct.pack("<H", len(entries))
    for tag, kind, values in entries:
        raw = struct.pack(f"<{len(values)}{TIFF_TYPES[kind]}", *values)
        if len(raw) > 4:
            directory += struct.pack("<HHII", tag, kind, len(values), extra_at + len(extra))
            extra += raw
        else:
            directory += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    return b"II" + struct.pack("<HI", 42, at) + body + b"\0" * (len(body) % 2) + directory + struct.pack("<I", 0) + extra


def decode_png(data: bytes) -> np.ndarray:
    if data[:8] != PNG_MAGIC:
        raise ValueError("not a PNG file")
    at, body, head = 8, b"", b""
    while at < len(data):
        n, = struct.unpack_from(">I", data, at)
        kind = data[at + 4 : at + 8]
        if kind == b"IHDR":
            head = data[at + 8 : at + 8 + n]
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += n + 12
    width, height, bits, color, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    if bits not in (8, 16) or interlaced:
        raise ValueError("PNG must have 8 or 16 bits and no interlacing")
    step = samples * bits // 8
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), np.uint8)
    above = np.zeros(width * step, np.uint8)
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:].copy()
        if kind == 2:
            line += above
        elif kind == 1:
            line = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind in (3, 4):
            for x in range(len(line)):
                a, b, c = (int(line[x - step]) if x >= step else 0), int(above[x]), (int(above[x - step]) if x >= step else 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((a, b, c), key=lambda v: abs(p - v))
                line[x] = (int(line[x]) + guess) & 255
        out[y] = above = line
    image = out.view(">u2").astype(np.uint16) if bits == 16 else out
    return image.reshape(height, width) if samples == 1 else image.reshape(height, width, samples)


def encode_png(image: np.ndarray) -> bytes:
    """Greyscale (2-D) or RGB(A) (3-D), 8 or 16 bits."""
    color = {1: 0, 3: 2, 4: 6}[1 if image.ndim == 2 else image.shape[2]]
    raw = np.ascontiguousarray(image.astype(">u2") if image.dtype == np.uint16 else image.astype(np.uint8)).view(np.uint8).reshape(image.shape[0], -1)
    lines = np.column_stack([np.zeros(len(raw), np.uint8), raw]).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 16 if image.dtype == np.uint16 else 8, color, 0, 0, 0)
    return PNG_MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def decode_mask(data: bytes, name: str = "mask") -> np.ndarray:
    """A 2-D plane from the bytes of a TIFF or PNG file."""
    image = decode_png(data) if data[:8] == PNG_MAGIC else decode_tiff(data)
    if image.ndim != 2:
        raise ValueError(f"{name} is not a 2-D plane: shape {image.shape}")
    return image
