"""Five 256-bit perceptual hashes of gray 64 x 64 rasters, over whole batches.

Every function takes rows x 4096 bytes (row-major) and gives rows x 256 booleans. All
comparisons are strict. Rasters are resampled to the hash's own size by the nearest pixel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE, BITS = 64, 256


def nearest(size: int) -> np.ndarray:
    """The pixel of 64 that stands for each of ``size``: the one over its centre."""
    return (2 * np.arange(size) + 1) * SIDE // (2 * size)


def _resampled(raster: np.ndarray, height: int, width: int) -> np.ndarray:
    return raster.reshape(-1, SIDE, SIDE)[:, nearest(height)[:, None], nearest(width)[None, :]]


def ahash(raster: np.ndarray) -> np.ndarray:
    """Above the average of 16 x 16 pixels."""
    p = _resampled(raster, 16, 16).reshape(-1, BITS).astype(np.int64)
    return p * BITS > p.sum(axis=1, keepdims=True)


def dhash(raster: np.ndarray) -> np.ndarray:
    """Brighter than the right neighbour, on 16 rows of 17 pixels."""
    p = _resampled(raster, 16, 17)
    return (p[:, :, :-1] > p[:, :, 1:]).reshape(-1, BITS)


def bhash(raster: np.ndarray) -> np.ndarray:
    """Above the median of the 256 blocks' sums."""
    s = raster.reshape(-1, 16, 4, 16, 4).astype(np.int64).sum(axis=(2, 4)).reshape(-1, BITS)
    middle = np.sort(s, axis=1)[:, 127:129].sum(axis=1, keepdims=True)
    return 2 * s > middle


def whash(raster: np.ndarray) -> np.ndarray:
    """Above the average of the low band of one Haar step each way, on 32 x 32 pixels."""
    p = _resampled(raster, 32, 32).astype(np.float64)
    c = 1.0 / np.sqrt(2.0)
    rows = (p[:, :, 0::2] + p[:, :, 1::2]) * c
    low = ((rows[:, 0::2] + rows[:, 1::2]) * c).reshape(-1, BITS)
    # one after the other, as the definition adds them
    total = np.add.accumulate(low, axis=1)[:, -1:]
    return low > total / BITS


def dct_basis() -> np.ndarray:
    """16 x 32 orthonormal cosines in single precision."""
    u, x = np.arange(16)[:, None], np.arange(32)[None, :]
    scale = np.where(u == 0, np.sqrt(1.0 / 32), np.sqrt(2.0 / 32))
    return (scale * np.cos(np.pi * u * (2 * x + 1) / 64)).astype(np.float32)


def phash(raster: np.ndarray) -> np.ndarray:
    """Above the average of the low cosine coefficients but the first; single precision, added in order."""
    p = _resampled(raster, 32, 32).astype(np.float32)
    basis = dct_basis()
    rows = np.zeros((len(p), 32, 16), np.float32)
    for x in range(32):
        rows += p[:, :, x, None] * basis[:, x]
    low = np.zeros((len(p), 16, 16), np.float32)
    for y in range(32):
        low += basis[:, y, None] * rows[:, y, None, :]
    low = low.reshape(-1, BITS)
    average = np.add.accumulate(low[:, 1:], axis=1, dtype=np.float32)[:, -1:] / np.float32(BITS - 1)
    return (low > average) & p.reshape(len(p), -1).any(axis=1, keepdims=True)


KERNELS = {"dhash": dhash, "phash": phash, "ahash": ahash, "whash": whash, "bhash": bhash}


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows x 32 bytes; bit i is bit i % 8 of byte i // 8."""
    return np.packbits(bits, axis=1, bitorder="little")


def unpack(data: bytes | None) -> np.ndarray | None:
    """256 booleans; none for what is not 32 bytes."""
    if data is None or len(data) != BITS // 8:
        return None
    return np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little").astype(bool)


def hasher(algorithm: str):
    """A vectorised UDF from a raster (4096 bytes) to the hash (32 bytes); null stays null."""
    kernel = KERNELS[algorithm]

    @F.pandas_udf(T.BinaryType())
    def run(rasters: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(rasters), index=rasters.index, dtype=object)
        sound = rasters[rasters.map(lambda r: r is not None and len(r) == SIDE * SIDE)]
        if len(sound):
            packed = pack(kernel(np.frombuffer(b"".join(sound), np.uint8).reshape(-1, SIDE * SIDE)))
            out[sound.index] = [row.tobytes() for row in packed]
        return out

    return run


@F.pandas_udf(T.StringType())
def bits_text(hashes: pd.Series) -> pd.Series:
    """A hash as 256 characters 0 or 1, bit 0 first."""
    return hashes.map(lambda h: None if (b := unpack(h)) is None else "".join("01"[int(x)] for x in b))


def words(hash_column: str) -> list:
    """The four 64-bit words of a hash, little-endian, as columns w0 .. w3."""
    out = []
    for w in range(4):
        hexed = F.concat(*(F.hex(F.substring(hash_column, 8 * w + 8 - b, 1)) for b in range(8)))
        out.append(F.conv(hexed, 16, -10).cast("long").alias(f"w{w}"))
    return out
