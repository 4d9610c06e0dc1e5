import hashlib
import io
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from latentrank.functions.svg import calibration_svg, points_of
from latentrank.sources import images
from latentrank.sources.images import DamagedImage, crop_images, decode_png, encode_png, write_images


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(1, 4), st.integers(0, 2**32 - 1), st.booleans())
def test_round_trip(height, width, channels, seed, smooth):
    rng = np.random.default_rng(seed)
    pixels = rng.integers(0, 256, (height, width, channels)).astype(np.uint8)
    if smooth:
        pixels = np.cumsum(np.cumsum(pixels % 5, 0), 1).astype(np.uint8)
    back = decode_png(encode_png(pixels))
    assert np.array_equal(back.reshape(pixels.shape), pixels)


def plain_png(lines, width, height, colour=2):
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    header = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", header) + part(b"tEXt", b"a\0b") + part(b"IDAT", zlib.compress(lines)[:5]) + part(b"IDAT", zlib.compress(lines)[5:]) + part(b"IEND", b"")


def test_every_filter_is_undone_as_the_format_says():
    """Each filter on each row, filtered byte by byte by the format's formulas."""
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (6, 5 * 3))
    for way in range(5):
        lines = bytearray()
        for y in range(6):
            lines.append(way)
            for x in range(15):
                a = int(pixels[y, x - 3]) if x >= 3 else 0
                b = int(pixels[y - 1, x]) if y else 0
                c = int(pixels[y - 1, x - 3]) if x >= 3 and y else 0
                near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                lines.append((int(pixels[y, x]) - [0, a, b, (a + b) // 2, near][way]) % 256)
        assert np.array_equal(decode_png(plain_png(bytes(lines), 5, 6)).reshape(6, 15), pixels)


def test_another_reader_agrees():
    image = pytest.importorskip("PIL.Image")
    pixels = np.random.default_rng(2).integers(0, 256, (7, 11, 3)).astype(np.uint8)
    assert np.array_equal(np.asarray(image.open(io.BytesIO(encode_png(pixels)))), pixels)


def test_damage_is_told():
    good = encode_png(np.zeros((2, 2), np.uint8))
    for bad in (b"", b"GIF89a", good[:-12], good[:40] + b"\x00" + good[41:], plain_png(b"\x09" + bytes(3), 1, 1), plain_png(bytes(3), 1, 1), plain_png(bytes(4), 1, 1, colour=3)):
        with pytest.raises(DamagedImage):
            decode_png(bad)
    with pytest.raises(ValueError):
        encode_png(np.zeros((0, 2), np.uint8))


def test_crops_of_odd_boxes(spark, monkeypatch):
    monkeypatch.setattr(images, "LOT", 4)  # many lots for one image
    rng = np.random.default_rng(3)
    pixels = {"a": rng.integers(0, 256, (9, 12, 3)).astype(np.uint8), "b": rng.integers(0, 256, (4, 4)).astype(np.uint8)}
    table = spark.createDataFrame([*((k, encode_png(v), 1) for k, v in pixels.items()), ("null", None, 1), ("unused", b"no image", 1)], "image string, content binary, width int")
    rows = [(i, "a", *map(int, sorted(rng.integers(-3, 15, 2))), *map(int, sorted(rng.integers(-3, 12, 2)))) for i in range(50)]
    rows = [(i, k, x0, y0, x1, y1) for i, k, x0, x1, y0, y1 in rows]
    rows += [(50, "b", 0, 0, 4, 4), (50, "b", 0, 0, 4, 4), (51, "b", None, 0, 1, 1), (52, "null", 0, 0, 1, 1), (53, "none", 0, 0, 1, 1), (54, None, 0, 0, 1, 1), (None, "b", 3, 3, 9, 9), (55, "b", 3, 3, 1, 1)]
    boxes = spark.createDataFrame([(*r, "x") for r in rows], "box_id bigint, image string, x0 int, y0 int, x1 int, y1 int, content string")
    got = sorted(((r.box_id is None, r.box_id or 0), r.image, r.width, r.height, r.content) for r in crop_images(table, boxes).collect())
    want = []
    for i, k, x0, y0, x1, y1 in rows:
        if k in pixels or k == "null":
            cut = pixels[k][max(0, y0) : max(0, y1), max(0, x0) : max(0, x1)] if k in pixels and x0 is not None else np.zeros((0, 0))
            want.append(((i is None, i or 0), k, *((cut.shape[1], cut.shape[0], encode_png(cut)) if cut.size else (0, 0, None))))
    assert got == sorted(want, key=lambda r: r[:2])
    assert crop_images(table.limit(0), boxes).count() == crop_images(table, boxes.limit(0)).count() == 0


def test_small_images_are_spread_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(images, "TASK_IMAGES", 20, raising=False)
    drawn = spark.range(200).select(F.col("id").alias("image"), images.png_of(F.transform(F.sequence(F.lit(1), F.lit(64)), lambda x: (x + 0).cast("int")), 8, 8).alias("content"))
    boxes = spark.range(200).select(F.col("id").alias("box_id"), F.col("id").alias("image"), *[F.lit(v).alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), (1, 1, 5, 5))])
    cut = images.crop_images(drawn, boxes).withColumn("task", F.spark_partition_id())
    assert cut.agg(F.count_distinct("task")).first()[0] > 4 and cut.count() == 200
    written = images.write_images(cut.coalesce(1).select(F.concat(F.col("box_id").cast("string"), F.lit(".png")).alias("file"), "content"), str(tmp_path / "out"))
    assert len(written.inputFiles()) > 4 and len(list((tmp_path / "out").glob("*.png"))) == 200


def test_one_file_a_row(spark, tmp_path):
    rows = [(f"r{i % 3}/p {i}.png", encode_png(np.full((2, 2), i, np.uint8))) for i in range(20)]
    table = spark.createDataFrame(rows, "file string, content binary").repartition(5)
    told = {r.file: (r.bytes, r.sha256) for r in write_images(table, str(tmp_path / "out")).collect()}
    found = {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.endswith(".crc")}
    assert found == dict(rows)
    assert told == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in rows}
    write_images(table, str(tmp_path / "out"))  # again over the same names
    assert len(list((tmp_path / "out").rglob("*.png"))) == 20
    for bad in ([("a", b"x"), ("a", b"y")], [(None, b"x")], [("../a", b"x")], [("/a", b"x")], [("a", None)], [("", b"")]):
        with pytest.raises(ValueError):
            write_images(spark.createDataFrame(bad, "file string, content binary"), str(tmp_path / "bad"))
    assert not [p for p in (tmp_path / "bad").rglob("*") if p.is_file()]
    assert write_images(table.limit(0), str(tmp_path / "none")).count() == 0


def test_plot_reads_back():
    points = [(1, 0.51234567890123, 0.4321, 7), (4, 0.69, 0.7, 1200), (10, 0.99, 1.0, 55)]
    svg = calibration_svg(points, 0.0421, 1234)
    assert points_of(svg) == points
    assert "ICI = 0.042, 1,234 tie(s) left out" in svg and "40%" in svg
    assert points_of(calibration_svg([])) == []
