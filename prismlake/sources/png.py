"""PNG images of 8 or 16 bits, grey or colour (the first channel), without interlacing."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type: grey, RGB, grey with alpha, RGB with alpha.
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def _chunks(raw: bytes):
    at = len(_SIGNATURE)
    while at + 8 <= len(raw):
        n, kind = struct.unpack_from(">I4s", raw, at)
        yield kind, raw[at + 8 : at + 8 + n]
        at += 12 + n


def _restore(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """Undo one row's filter; columns of step bytes depend on the one to the left."""
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    if kind == 1:
        pixels = row.reshape(-1, step)
        return np.cumsum(pixels, axis=0, dtype=np.uint8).reshape(-1)
    if kind not in (3, 4):
        raise ValueError(f"PNG filter {kind} is unknown")
    out, up = row.astype(np.int64).reshape(-1, step), above.astype(np.int64).reshape(-1, step)
    left, corner = np.zeros(step, np.int64), np.zeros(step, np.int64)
    for i in range(len(out)):
        if kind == 3:
            guess = (left + up[i]) >> 1
        else:
            # The neighbour nearest to left + above - corner; left, then above, on ties.
            near = np.abs(np.stack((left, up[i], corner)) - (left + up[i] - corner))
            guess = np.choose(near.argmin(axis=0), (left, up[i], corner))
        left = out[i] = (out[i] + guess) & 255
        corner = up[i]
    return out.astype(np.uint8).reshape(-1)


def _filtered(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """Apply one row's filter: what remains after its guess from the pixels to the left and above."""
    r, up = row.astype(np.int64), above.astype(np.int64)
    left, corner = (np.concatenate((np.zeros(step, np.int64), v[:-step])) for v in (r, up))
    if kind == 4:
        near = np.abs(np.stack((left, up, corner)) - (left + up - corner))
        guess = np.choose(near.argmin(axis=0), (left, up, corner))
    else:
        guess = (0, left, up, (left + up) >> 1)[kind]
    return ((r - guess) & 255).astype(np.uint8)


def encode(image: np.ndarray) -> bytes:
    """A grey PNG of 8 or 16 bits whose rows take turns in the five filters."""
    depth = image.dtype.itemsize
    if image.dtype.kind != "u" or depth not in (1, 2) or image.ndim != 2:
        raise ValueError("only grey images of 8 or 16 bits are written")
    raw = np.frombuffer(image.astype(image.dtype.newbyteorder(">")).tobytes(), np.uint8).reshape(len(image), -1)
    above = np.concatenate((np.zeros_like(raw[:1]), raw[:-1]))
    rows = [bytes([y % 5]) + _filtered(y % 5, raw[y], above[y], depth).tobytes() for y in range(len(raw))]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8 * depth, 0, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


def size(raw: bytes, source: str = "image") -> tuple[int, int]:
    """(height, width) from the image header, which comes first."""
    if not raw.startswith(_SIGNATURE) or raw[12:16] != b"IHDR":
        raise ValueError(f"{source}: not a PNG file")
    width, height = struct.unpack(">II", raw[16:24])
    return height, width


def decode(raw: bytes, source: str = "image") -> np.ndarray:
    """(height, width) of 32-bit floats in [0, 1]."""
    if not raw.startswith(_SIGNATURE):
        raise ValueError(f"{source}: not a PNG file")
    header, packed = None, []
    for kind, body in _chunks(raw):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
    if header is None:
        raise ValueError(f"{source}: no image header")
    width, height, depth, colour, _, _, interlaced = header
    if depth not in (8, 16) or colour not in _CHANNELS or interlaced:
        raise ValueError(f"{source}: only 8 and 16 bits, grey or colour, without interlacing are supported")
    channels, size = _CHANNELS[colour], depth // 8
    step = channels * size
    try:
        data = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as e:
        raise ValueError(f"{source}: damaged image data") from e
    line = width * step
    if len(data) < height * (line + 1):
        raise ValueError(f"{source}: image data is too short")
    rows = data[: height * (line + 1)].reshape(height, line + 1)
    out, above = np.zeros((height, line), np.uint8), np.zeros(line, np.uint8)
    for y in range(height):
        above = out[y] = _restore(int(rows[y, 0]), rows[y, 1:], above, step)
    first = np.ascontiguousarray(out.reshape(height, width, step)[:, :, :size])
    samples = first.view(">u2" if size == 2 else np.uint8).reshape(height, width)
    return (samples.astype(np.float64) / (65535 if size == 2 else 255)).astype(np.float32)
