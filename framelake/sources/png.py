"""PNG in both directions: 8 bits a channel, without interlacing; what packed frames need."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Fixed values of the format: signature, and channels by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def encode_png(width: int, height: int, channels: int, pixels: bytes) -> bytes:
    """``channels``: 1 (gray) or 3 (red, green, blue); rows without a filter."""
    if channels not in (1, 3) or len(pixels) != width * height * channels:
        raise ValueError("pixels do not fit the size")
    rows = np.zeros((height, 1 + width * channels), dtype=np.uint8)
    rows[:, 1:] = np.frombuffer(pixels, dtype=np.uint8).reshape(height, -1)
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if channels == 1 else 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes())) + _chunk(b"IEND", b"")


def _unfilter(raw: bytes, height: int, line: int, step: int) -> np.ndarray:
    """Undo each row's filter: none, left, up, mean of both, or the nearest of left, up and corner."""
    out = np.zeros((height + 1, line), dtype=np.uint8)
    for y in range(height):
        kind = raw[y * (line + 1)]
        row = np.frombuffer(raw, dtype=np.uint8, count=line, offset=y * (line + 1) + 1)
        up = out[y]
        if kind == 0:
            out[y + 1] = row
        elif kind == 1:
            out[y + 1] = np.add.accumulate(row.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            out[y + 1] = row + up
        elif kind in (3, 4):
            now, above = [0] * step, [0] * step + up.tolist()
            for i, v in enumerate(row.tolist()):
                a, b, c = now[i], above[i + step], above[i]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    near = (abs(b - c), abs(a - c), abs(a + b - 2 * c))
                    guess = (a, b, c)[near.index(min(near))]
                now.append((v + guess) & 255)
            out[y + 1] = now[step:]
        else:
            raise ValueError("unknown filter")
    return out[1:]


def decode_png(data: bytes) -> tuple[int, int, int, bytes]:
    """Width, height, channels (1 or 3, palettes resolved, alpha dropped) and pixels. ValueError for any other or broken file."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, palette, head = 8, [], None, None
    while at + 12 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        name, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(data) < at + 12 + size or zlib.crc32(name + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError("broken chunk")
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            packed.append(body)
        elif name == b"IEND":
            break
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        raise ValueError("unsupported PNG")
    width, height, _, colour, *_ = head
    step = CHANNELS[colour]
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as why:
        raise ValueError(str(why)) from why
    if len(raw) != height * (1 + width * step):
        raise ValueError("pixels do not fit the size")
    image = _unfilter(raw, height, width * step, step).reshape(height, width, step)
    if colour == 3:
        if palette is None or image.max(initial=0) >= len(palette):
            raise ValueError("no such colour")
        image = palette[image[:, :, 0]]
    elif colour in (4, 6):
        image = image[:, :, :-1]
    return width, height, image.shape[2], np.ascontiguousarray(image).tobytes()
