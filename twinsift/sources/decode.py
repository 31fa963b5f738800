"""Decoders by suffix, scaling, and gray rasters of pixels.

PNG, BMP and portable maps are decoded here, from bytes. Spark's image reader covers JPEG, GIF and
what else the JVM reads (see ``files``). HEIF and camera raw have a place in the registry for a
library that reads them; without one such files are invalid.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable

import numpy as np

from ..schema import HEIF_SUFFIXES, RAW_SUFFIXES

Decoder = Callable[[bytes], np.ndarray]
#: From suffix to a function from bytes to pixels (height x width x channels, RGB order).
DECODERS: dict[str, Decoder] = {}
#: Suffixes that need a library from outside; :func:`register` takes its decoder.
OPTIONAL = (*HEIF_SUFFIXES, *RAW_SUFFIXES)
#: Megabytes that a decoded image may take, by default and at the bounds of what may be asked.
LIMIT_MB, LEAST_MB, MOST_MB = 1536, 32, 4096
LIMIT_NAME = "TWINSIFT_ALLOCATION_MB"


def allocation_limit() -> int:
    """Bytes that a decoded image may take: megabytes from the environment, the default for less than the least."""
    asked = os.environ.get(LIMIT_NAME, "")
    megabytes = int(asked) if asked.isdigit() else 0
    return (LIMIT_MB if megabytes < LEAST_MB else min(megabytes, MOST_MB)) << 20


def register(*suffixes: str) -> Callable[[Decoder], Decoder]:
    def put(decoder: Decoder) -> Decoder:
        DECODERS.update(dict.fromkeys(suffixes, decoder))
        return decoder

    return put


def requested_size(width: int, height: int, target_width: int, target_height: int, ignore_aspect: bool = False) -> tuple[int, int]:
    """The size to decode at, as ``functions.scalars.requested_size`` has it for columns."""
    rounded = lambda x: max(1, int(x + 0.5))
    if not target_width and not target_height:
        return width, height
    if not target_width:
        return rounded(width * target_height / height), target_height
    if not target_height:
        return target_width, rounded(height * target_width / width)
    if ignore_aspect:
        return target_width, target_height
    if width * target_height > height * target_width:
        return target_width, rounded(height * target_width / width)
    return rounded(width * target_height / height), target_height


def scaled(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """``pixels`` at another size: each new pixel is the whole part of the mean over those it covers, or the one it lies in."""
    out = pixels.astype(np.int64)
    for axis, size in ((0, height), (1, width)):
        n = out.shape[axis]
        if n == size:
            continue
        starts = np.arange(size) * n // size
        stops = np.maximum(starts + 1, (np.arange(size) + 1) * n // size)
        sums = np.concatenate((np.zeros_like(out.take([0], axis)), np.cumsum(out, axis=axis)), axis=axis)
        spans = (stops - starts).reshape([-1 if a == axis else 1 for a in range(out.ndim)])
        out = (sums.take(stops, axis) - sums.take(starts, axis)) // spans
    return out.astype(pixels.dtype)


def gray(pixels: np.ndarray) -> np.ndarray:
    """(11 R + 16 G + 5 B) / 32 of colours; alpha is ignored."""
    p = pixels.reshape(*pixels.shape[:2], -1).astype(np.int64)
    return ((11 * p[..., 0] + 16 * p[..., 1] + 5 * p[..., 2]) >> 5 if p.shape[2] >= 3 else p[..., 0]).astype(np.uint8)


def gray_raster(pixels: np.ndarray, side: int = 64) -> bytes:
    """Gray, stretched to side x side whatever the aspect."""
    return scaled(gray(pixels), side, side).tobytes()


def rotated(pixels: np.ndarray, flip: int) -> np.ndarray:
    """Camera raw orientation: 3 upside down, 5 a quarter to the left, 6 a quarter to the right."""
    return np.rot90(pixels, {3: 2, 5: 1, 6: -1}.get(flip, 0))


def upright(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """Pixels as an EXIF orientation (1 to 8) wants them shown."""
    if orientation in (2, 4, 5, 7):
        pixels = pixels[:, ::-1]
    return np.rot90(pixels, {3: 2, 4: 2, 5: 1, 6: -1, 7: -1, 8: 1}.get(orientation, 0))


def jpeg_orientation(head: bytes) -> int:
    """The EXIF orientation in a JPEG's first segments; 1 where there is none."""
    at = 2
    while head[:2] == b"\xff\xd8" and at + 4 <= len(head) and head[at] == 0xFF and head[at + 1] not in (0xD9, 0xDA):
        size = int.from_bytes(head[at + 2 : at + 4], "big")
        body = head[at + 4 : at + 2 + size]
        if head[at + 1] == 0xE1 and body[:6] == b"Exif\0\0":
            tiff = body[6:]
            order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
            try:
                first = struct.unpack_from(f"{order}I", tiff, 4)[0]
                for entry in range(struct.unpack_from(f"{order}H", tiff, first)[0]):
                    tag, _, _, value = struct.unpack_from(f"{order}HHIH", tiff, first + 2 + 12 * entry)
                    if tag == 0x0112:
                        return value if 1 <= value <= 8 else 1
            except struct.error:
                return 1
        at += 2 + size
    return 1


def png_size(head: bytes) -> tuple[int, int]:
    """Width and height out of a PNG's first 24 bytes; zeros for what is none."""
    return struct.unpack(">II", head[16:24]) if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24 else (0, 0)


def decode_image(suffix: str, data: bytes, target_width: int = 0, target_height: int = 0, ignore_aspect: bool = False) -> tuple[np.ndarray, int, int]:
    """Pixels at the requested size, and the source's width and height; ValueError for what cannot be decoded."""
    if suffix not in DECODERS:
        raise ValueError(f"no decoder for {suffix!r}")
    try:
        pixels = DECODERS[suffix](data)
    except (struct.error, zlib.error, IndexError, OverflowError, MemoryError) as e:
        raise ValueError(f"broken {suffix}") from e
    height, width = pixels.shape[:2]
    return scaled(pixels, *requested_size(width, height, target_width, target_height, ignore_aspect)), width, height


def decode_gray(suffix: str, data: bytes) -> tuple[bytes, int, int]:
    """Raster, width and height; ValueError for what cannot be decoded."""
    pixels, width, height = decode_image(suffix, data)
    return gray_raster(pixels), width, height


def _checked(width: int, height: int, channels: int) -> None:
    if width <= 0 or height <= 0 or width * height * channels > allocation_limit():
        raise ValueError("size out of bounds")


#: First column and row, and steps, of the seven passes of an interlaced PNG.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


@register("png", "apng")
def png(data: bytes) -> np.ndarray:
    """Gray, colour and palette, of 1 to 16 bits a sample, interlaced or not; of an animation the first image."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None:
        raise ValueError("no header")
    width, height, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if channels is None or depth not in (1, 2, 4, 8, 16) or colour == 3 and palette is None:
        raise ValueError("unsupported PNG")
    _checked(width, height, channels * max(1, depth // 8))
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    out = np.zeros((height, width, channels), np.uint8)
    for left, top, across, down in PASSES if interlaced else ((0, 0, 1, 1),):
        columns, rows = -(-(width - left) // across), -(-(height - top) // down)
        if columns > 0 and rows > 0:
            stride = (columns * channels * depth + 7) // 8
            if len(raw) < rows * (stride + 1):
                raise ValueError("short PNG")
            lines = raw[: rows * (stride + 1)].reshape(rows, stride + 1)
            raw = raw[rows * (stride + 1) :]
            whole = _unfiltered(lines[:, 0], lines[:, 1:], max(1, channels * depth // 8))
            out[top::down, left::across] = _samples(whole, columns, channels, depth)
    if colour == 3:
        return palette[np.minimum(out[..., 0], len(palette) - 1)]
    if depth < 8:
        out *= 255 // ((1 << depth) - 1)
    return out[..., :1] if colour in (0, 4) else out


def _samples(lines: np.ndarray, columns: int, channels: int, depth: int) -> np.ndarray:
    """Rows x columns x channels out of packed lines; of 16 bits the upper 8."""
    if depth >= 8:
        return lines.reshape(len(lines), columns, channels, depth // 8)[..., 0]
    bits = np.unpackbits(lines, axis=1).reshape(len(lines), -1, depth)
    values = (bits << np.arange(depth)[::-1].astype(np.uint8)).sum(axis=2, dtype=np.uint8)
    return values[:, : columns * channels].reshape(len(lines), columns, channels)


def _unfiltered(kinds: np.ndarray, lines: np.ndarray, step: int) -> np.ndarray:
    """Lines with their filters undone, along diagonals: there every pixel's left, upper and corner neighbours are known."""
    if not kinds.any():
        return lines
    height, stride = lines.shape
    width = -(-stride // step)
    raw = np.zeros((height, width * step), np.int16)
    raw[:, :stride] = lines
    raw = raw.reshape(height, width, step)
    out = np.zeros((height + 1, width + 1, step), np.int16)
    for diagonal in range(height + width - 1):
        y = np.arange(max(0, diagonal - width + 1), min(height, diagonal + 1))
        x = diagonal - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        base = left + up - corner
        to_left, to_up, to_corner = np.abs(base - left), np.abs(base - up), np.abs(base - corner)
        nearest = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        kind = kinds[y][:, None]
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) >> 1, nearest], 0)
        out[y + 1, x + 1] = (raw[y, x] + guess) & 255
    return out[1:, 1:].reshape(height, -1)[:, :stride].astype(np.uint8)


@register("bmp", "dib")
def bmp(data: bytes) -> np.ndarray:
    """Uncompressed, 24 or 32 bits."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP")
    start, _, width, height, _, bits, packed = struct.unpack("<IIiiHHI", data[10:34])
    if bits not in (24, 32) or packed not in (0, 3):
        raise ValueError("unsupported BMP")
    _checked(width, abs(height), bits // 8)
    stride = (width * bits // 8 + 3) // 4 * 4
    if len(data) < start + stride * abs(height):
        raise ValueError("short BMP")
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    pixels = rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    return pixels[::-1] if height > 0 else pixels


@register("pgm", "ppm")
def portable(data: bytes) -> np.ndarray:
    """Binary gray (P5) and colour (P6) maps of 8 bits."""
    head = re.match(rb"(P[56])\s+(?:#.*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", data)
    if head is None or int(head[4]) > 255:
        raise ValueError("unsupported portable map")
    channels, width, height = (3 if head[1] == b"P6" else 1), int(head[2]), int(head[3])
    _checked(width, height, channels)
    if len(data) - head.end() < width * height * channels:
        raise ValueError("short portable map")
    return np.frombuffer(data, np.uint8, width * height * channels, head.end()).reshape(height, width, channels)
