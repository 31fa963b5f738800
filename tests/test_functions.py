import numpy as np
import pytest

from twinsift.functions import hashes as H
from twinsift.operators.view import GroupFilter
from twinsift.sources import decode


def raster(values):
    return np.asarray(values, np.uint8).reshape(1, 4096)


def test_flat_and_black():
    flat = raster(np.full(4096, 7))
    for name in ("ahash", "dhash", "bhash", "whash"):
        assert not H.KERNELS[name](flat).any()
    assert not H.phash(raster(np.zeros(4096))).any()


def test_one_bright_pixel_sets_one_average_bit():
    p = np.ones((64, 64))
    p[4 * 3 + 2, 4 * 5 + 2] = 2
    assert np.flatnonzero(H.ahash(raster(p))[0]).tolist() == [3 * 16 + 5]


def test_falling_gradient_sets_all_difference_bits():
    assert H.dhash(raster(np.tile(np.arange(64)[::-1] * 4, (64, 1)))).all()
    assert not H.dhash(raster(np.tile(np.arange(64) * 4, (64, 1)))).any()


def test_block_median_halves_distinct_blocks():
    p = np.repeat(np.repeat(np.arange(256).reshape(16, 16), 4, 0), 4, 1)
    assert H.bhash(raster(p)).sum() == 128


def test_pack_is_least_bit_first():
    bits = np.zeros((1, 256), bool)
    bits[0, 9] = True
    data = H.pack(bits)[0].tobytes()
    assert data[1] == 2 and len(data) == 32
    assert (H.unpack(data) == bits[0]).all()
    assert H.unpack(b"short") is None and H.unpack(None) is None


@pytest.mark.parametrize(
    "text, files, mb, terms",
    [("", 0, 0, ()), ("min:2 min:3", 3, 0, ()), ("5mb minmb:2", 0, 5, ()), ("size>=50mb combmb", 0, 0, ()), ("min:3.5 Cat .JPG", 0, 0, ("cat", ".jpg")), ("min:-4", 0, 0, ())],
)
def test_filter_grammar(text, files, mb, terms):
    assert GroupFilter.parse(text) == GroupFilter(files, mb, terms)


def test_gray_raster_of_a_png():
    import struct
    import zlib

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + bytes([0, 255, 0] * 20) for _ in range(10))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 20, 10, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    gray, width, height = decode.decode_gray("png", png)
    assert (width, height) == (20, 10) and set(gray) == {(16 * 255) >> 5} and len(gray) == 4096
    for broken in (png[:30], b"", b"junk"):
        with pytest.raises(ValueError):
            decode.decode_gray("png", broken)
    with pytest.raises(ValueError):
        decode.decode_gray("heic", png)
