import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsift import __main__ as cli
from twinsift.functions import hashes as H
from twinsift.functions.scalars import card_similarity
from twinsift.library import Library
from twinsift.operators import keep
from twinsift.operators.cache import SnapshotCache
from twinsift.sources import decode
from twinsift.sources import files as scans


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(kind, line, above, step):
    out = bytearray()
    for x, value in enumerate(line):
        left = line[x - step] if x >= step else 0
        up, corner = above[x], above[x - step] if x >= step else 0
        base = left + up - corner
        paeth = min((abs(base - left), 0, left), (abs(base - up), 1, up), (abs(base - corner), 2, corner))[2]
        out.append((value - (0, left, up, (left + up) // 2, paeth)[kind]) & 255)
    return bytes([kind]) + bytes(out)


def packed_lines(samples, depth):
    rows = samples.reshape(len(samples), -1)
    if depth == 8:
        return [r.astype(np.uint8).tobytes() for r in rows]
    if depth == 16:
        return [(r.astype(">u2") * 257).tobytes() for r in rows]
    return [np.packbits(((r[:, None] >> np.arange(depth)[::-1]) & 1).astype(np.uint8).ravel()).tobytes() for r in rows]


def png(samples, depth=8, colour=2, interlaced=False, palette=None):
    """height x width x channels of samples, each line by another filter."""
    height, width, channels = samples.shape
    step, body = max(1, channels * depth // 8), b""
    for left, top, across, down in decode.PASSES if interlaced else ((0, 0, 1, 1),):
        part = samples[top::down, left::across]
        if not part.size:
            continue
        above = None
        for y, line in enumerate(packed_lines(part, depth)):
            body += filtered(y % 5, line, above or bytes(len(line)), step)
            above = line
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, int(interlaced)))
    extra = chunk(b"PLTE", palette.tobytes()) if palette is not None else b""
    return b"\x89PNG\r\n\x1a\n" + head + extra + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize("depth, colour, channels", [(8, 2, 3), (8, 6, 4), (16, 2, 3), (8, 0, 1), (1, 0, 1), (2, 0, 1), (4, 0, 1), (8, 4, 2)])
def test_png_round_trip(depth, colour, channels, interlaced):
    draw = np.random.default_rng(depth + colour)
    samples = draw.integers(0, 1 << min(depth, 8), (13, 19, channels))
    got = decode.png(png(samples, depth, colour, interlaced))
    shown = samples * (255 // ((1 << depth) - 1)) if depth < 8 else samples
    assert (got == (shown[..., :1] if colour in (0, 4) else shown)).all()


def test_png_palette_and_broken():
    palette = np.arange(12, dtype=np.uint8).reshape(4, 3)
    samples = np.random.default_rng(1).integers(0, 4, (9, 9, 1))
    whole = png(samples, 2, 3, False, palette)
    assert (decode.png(whole) == palette[samples[..., 0]]).all()
    for broken in (whole[:40], whole[:-30], b""):
        with pytest.raises(ValueError):
            decode.decode_gray("png", broken)


def test_a_large_filtered_png_takes_no_loop_over_its_bytes():
    lines = np.random.default_rng(2).integers(0, 256, (600, 1 + 3 * 800)).astype(np.uint8)
    lines[:, 0] = 4
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", 800, 600, 8, 2, 0, 0, 0))
    whole = b"\x89PNG\r\n\x1a\n" + head + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")
    assert decode.decode_image("png", whole, 64, 0)[0].shape == (48, 64, 3)


def test_sizes_and_limits(monkeypatch):
    assert decode.requested_size(400, 200, 64, 64) == (64, 32) and decode.requested_size(400, 200, 0, 50) == (100, 50)
    assert decode.requested_size(400, 200, 64, 64, True) == (64, 64) and decode.requested_size(4, 900, 0, 64) == (1, 64)
    assert decode.scaled(np.full((5, 7, 3), 9, np.uint8), 64, 2).shape == (2, 64, 3)
    for text, megabytes in (("", 1536), ("31", 1536), ("32", 32), ("9999", 4096), ("x", 1536)):
        monkeypatch.setenv(decode.LIMIT_NAME, text)
        assert decode.allocation_limit() == megabytes << 20
    monkeypatch.setenv(decode.LIMIT_NAME, "32")
    with pytest.raises(ValueError):
        decode.decode_gray("ppm", b"P6 4000 4000 255 ")


def test_orientations():
    a = np.arange(6).reshape(2, 3, 1)
    shown = {1: a, 2: a[:, ::-1], 3: a[::-1, ::-1], 4: a[::-1], 5: a.transpose(1, 0, 2), 6: np.rot90(a, -1), 7: a[::-1, ::-1].transpose(1, 0, 2), 8: np.rot90(a)}
    for orientation, expected in shown.items():
        assert (decode.upright(a, orientation) == expected).all()
    assert decode.rotated(a, 6).shape == (3, 2, 1) and (decode.rotated(a, 0) == a).all() and (decode.rotated(a, 3) == a[::-1, ::-1]).all()


def with_exif(jpeg, orientation):
    tiff = b"MM\0*" + struct.pack(">IHHHIHHI", 8, 1, 0x0112, 3, 1, orientation, 0, 0)
    body = b"Exif\0\0" + tiff
    return jpeg[:2] + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + jpeg[2:]


def write_by_jvm(spark, pixels, path, kind):
    jvm = spark._jvm
    height, width = pixels.shape[:2]
    image = jvm.java.awt.image.BufferedImage(width, height, 1)
    for y in range(height):
        for x in range(width):
            r, g, b = (int(v) for v in pixels[y, x])
            image.setRGB(x, y, r << 16 | g << 8 | b)
    assert jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(str(path)))


@pytest.fixture
def folder(spark, tmp_path):
    top = tmp_path / "photos"
    (top / "sub dir" / "deep").mkdir(parents=True)
    y, x = np.mgrid[0:48, 0:36]
    one, two = (np.repeat((128 + 80 * np.sin(x / a) + 40 * np.cos(y / b)).astype(int)[..., None], 3, axis=2) for a, b in ((5, 7), (3, 4)))
    brighter = np.clip(one + 3, 0, 255)
    (top / "b.png").write_bytes(png(one))
    (top / "A.PNG").write_bytes(png(brighter, interlaced=True))
    (top / "sub dir" / "copy.png").write_bytes(png(one))
    (top / "_two.ppm").write_bytes(b"P6 36 48 255 " + two.astype(np.uint8).tobytes())
    (top / "broken.png").write_bytes(b"nothing")
    (top / "raw.nef").write_bytes(b"nothing")
    (top / "notes.txt").write_bytes(b"text")
    write_by_jvm(spark, one, top / "j g.jpg", "jpg")
    turned = tmp_path / "turned.jpg"
    write_by_jvm(spark, np.rot90(one), turned, "jpg")
    (top / "sub dir" / "deep" / "turned.jpg").write_bytes(with_exif(turned.read_bytes(), 6))
    write_by_jvm(spark, two, top / "two.gif", "gif")
    return top


def names(rows):
    return {os.path.basename(r["path"]) for r in rows}


def test_scan_hash_group_and_forget(spark, folder, tmp_path):
    cache = str(tmp_path / "cache")
    first = Library.scan(spark, str(folder), "dhash", True, cache=cache, batch_files=3)
    assert first.discovered == 9 and first.cache_hits == 0 and not first.cancelled
    rows = {os.path.basename(r["path"]): r for r in first.files.collect()}
    assert set(rows) == {"b.png", "A.PNG", "copy.png", "_two.ppm", "j g.jpg", "turned.jpg", "two.gif"}
    assert all((r["width"], r["height"], r["hash_mask"]) == (36, 48, 1) and r["phash"] is None for r in rows.values())
    expected = H.pack(H.dhash(np.frombuffer(decode.decode_gray("png", (folder / "b.png").read_bytes())[0], np.uint8).reshape(1, -1)))[0].tobytes()
    assert bytes(rows["b.png"]["dhash"]) == bytes(rows["copy.png"]["dhash"]) == expected
    ordered = [r["path"] for r in first.files.orderBy("idx").collect()]
    assert ordered == sorted(ordered, key=lambda p: (p.lower(), p))
    cards = first.grouping(40).cards().collect()
    by_group = {}
    for r in cards:
        by_group.setdefault(r["group_id"], []).append(r)
    assert sorted(sorted(names(g)) for g in by_group.values()) == [["A.PNG", "b.png", "copy.png", "j g.jpg", "turned.jpg"], ["_two.ppm", "two.gif"]]
    assert all(r["similarity"] == "100%" for r in cards if r["pos"] == 0)

    again = Library.scan(spark, str(folder), "dhash", True, cache=cache)
    assert again.cache_hits == 7 and again.files.count() == 7
    other = Library.scan(spark, str(folder), "ahash", True, cache=cache)
    assert other.cache_hits == 7 and other.files.where("dhash is null or ahash is null").count() == 0 and other.files.where("hash_mask = 5").count() == 7

    results = spark.createDataFrame([(str(folder / "b.png"), "deleted"), (str(folder / "A.PNG"), "failed")], "path string, status string")
    left = other.forget_deleted(results)
    assert "b.png" not in names(left.files.collect()) and left.files.count() == 6
    assert SnapshotCache(spark, cache).load().where("rel_path = 'b.png'").count() == 0
    os.remove(folder / "two.gif")
    flat = Library.scan(spark, str(folder), "dhash", False, cache=cache)
    assert names(flat.files.collect()) == {"A.PNG", "_two.ppm", "j g.jpg", "b.png"}
    kept = {r["rel_path"] for r in SnapshotCache(spark, cache).load().collect()}
    assert "two.gif" not in kept and "sub dir/copy.png" in kept


def test_a_cancelled_scan_is_taken_up(spark, folder, tmp_path):
    cache, asked = str(tmp_path / "cache"), []
    cut = Library.scan(spark, str(folder), "dhash", True, cache=cache, batch_files=2, cancelled=lambda: asked.append(1) or len(asked) > 2)
    assert cut.cancelled
    done = SnapshotCache(spark, cache).load().count()
    assert 0 < done < 7
    whole = Library.scan(spark, str(folder), "dhash", True, cache=cache)
    assert whole.cache_hits == done and whole.files.count() == 7


def test_exact_copies_are_planned_and_moved(spark, folder, tmp_path):
    library = Library.scan(spark, str(folder), "md5", True, others=True, cache=str(tmp_path / "cache"))
    os.utime(folder / "b.png", (1, 1))
    assert [r["files"] for r in library.groups().collect()] == [2, 2]  # the copies, and the two files of the same word
    cards = library.cards().collect()
    assert {r["similarity"] for r in cards} == {"100%"}
    plan = library.plan("shortest_name")
    assert names(plan.collect()) == {"copy.png", "broken.png"}
    assert {r["status"] for r in keep.move_to_trash(plan, str(tmp_path / "trash")).collect()} == {"planned"} and (folder / "broken.png").exists()
    stop = tmp_path / "stop"
    stop.touch()
    assert {r["status"] for r in keep.move_to_trash(plan, str(tmp_path / "trash"), False, str(stop)).collect()} == {"cancelled"}
    results = keep.move_to_trash(plan, str(tmp_path / "trash"), False)
    assert {r["status"] for r in results.collect()} == {"deleted"} and not (folder / "broken.png").exists()
    assert library.forget_deleted(results).groups().count() == 0
    selected = library.select(spark.createDataFrame([(str(folder / "raw.nef"),)], "path string"))
    assert names(selected.selected_plan().collect()) == {"raw.nef"}


def test_cards_without_hashes(spark):
    rows = spark.createDataFrame([(4, False, False), (None, False, False), (9, True, False), (None, False, True)], "d int, leads boolean, same boolean")
    assert [r[0] for r in rows.select(card_similarity("dhash", "d", "leads", "same")).collect()] == ["99%", "-", "100%", "-"]
    assert [r[0] for r in rows.select(card_similarity("md5", "d", "leads", "same")).collect()] == ["0%", "0%", "100%", "100%"]


def test_command_line(spark, folder, capsys):
    assert cli.main([]) == 2
    assert cli.main([str(folder), "9"]) == 0
    assert "by dhash" in capsys.readouterr().out


def test_rasters_of_few_tasks(spark, folder, monkeypatch):
    files = scans.classified(scans.list_folder(spark, str(folder), True))
    assert scans.with_rasters(files).where("gray is not null").count() == 7
    inside = files.where("suffix = 'png'").withColumn("content", F.expr("cast('x' as binary)"))
    assert scans.with_rasters(inside, "content").where("gray is null").count() == inside.count()
