"""Raster images: a PNG encoder and reader, crops of many boxes, one file a row.

Pixels are 8-bit arrays (height, width) of grey values or (height, width, n) with
n = 2 (grey and alpha), 3 (RGB) or 4 (RGB and alpha).
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cache import _fs

#: Fixed values of the format: its first bytes, and the colour type of so many channels.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
COLOUR_TYPE = {1: 0, 2: 4, 3: 2, 4: 6}
#: Boxes of an image that are cut in one go; an image with more is read once for each lot.
LOT = 1024
#: Images or boxes that a task takes, about, and tasks at most.
TASK_IMAGES, TASKS = 500, 2000


class DamagedImage(ValueError):
    """The bytes are no PNG, are damaged, or are of a kind that is not read here."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _predictors(rows: np.ndarray, step: int) -> list[np.ndarray]:
    """What each of the five filters predicts for every byte, from whole rows (int16)."""
    left, up, corner = np.zeros_like(rows), np.zeros_like(rows), np.zeros_like(rows)
    left[:, step:] = rows[:, :-step]
    up[1:] = rows[:-1]
    corner[1:, step:] = rows[:-1, :-step]
    guess = left + up - corner
    a, b, c = np.abs(guess - left), np.abs(guess - up), np.abs(guess - corner)
    nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
    return [np.zeros_like(rows), left, up, (left + up) // 2, nearest]


def encode_png(pixels: np.ndarray, level: int = 6) -> bytes:
    """PNG bytes; every row takes the filter with the least sum of absolute differences."""
    pixels = np.asarray(pixels, np.uint8)
    pixels = pixels[:, :, None] if pixels.ndim == 2 else pixels
    height, width, channels = pixels.shape
    if not height or not width or channels not in COLOUR_TYPE:
        raise ValueError(f"An image of {width} x {height} pixels with {channels} channels cannot be written.")
    rows = pixels.reshape(height, width * channels)
    ways = np.stack([(rows - p).astype(np.uint8) for p in _predictors(rows.astype(np.int16), channels)])
    cost = np.abs(ways.astype(np.int8).astype(np.int32)).sum(2)
    best = cost.argmin(0)
    lines = np.column_stack([best.astype(np.uint8), ways[best, np.arange(height)]])
    header = struct.pack(">IIBBBBB", width, height, 8, COLOUR_TYPE[channels], 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """Bytes of the rows, filters undone: whole rows at once for those that look
    up only, else pixel by pixel along the row."""
    out = np.zeros((len(lines), lines.shape[1] - 1), np.uint8)
    up = np.zeros(out.shape[1], np.uint8)
    for y, line in enumerate(lines):
        way, raw = int(line[0]), line[1:]
        if way == 0:
            row = raw.copy()
        elif way == 1:
            row = np.cumsum(raw.reshape(-1, step), 0, np.uint8).ravel()
        elif way == 2:
            row = raw + up
        elif way in (3, 4):
            row = raw.astype(np.int16)
            above = up.astype(np.int16)
            left = corner = np.zeros(step, np.int16)
            for x in range(0, len(row), step):
                b = above[x : x + step]
                if way == 3:
                    guess = (left + b) // 2
                else:
                    p = left + b - corner
                    pa_, pb, pc = np.abs(p - left), np.abs(p - b), np.abs(p - corner)
                    guess = np.where((pa_ <= pb) & (pa_ <= pc), left, np.where(pb <= pc, b, corner))
                row[x : x + step] = left = (row[x : x + step] + guess) & 255
                corner = b
            row = row.astype(np.uint8)
        else:
            raise DamagedImage(f"Row {y} names filter {way}, which there is not.")
        out[y] = up = row
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Pixels of a PNG with 8 bits a channel and no palette or interlacing; checksums are tested."""
    if not data or data[:8] != SIGNATURE:
        raise DamagedImage("The first bytes are not those of a PNG.")
    at, packed, header, ended = 8, [], None, False
    while at + 12 <= len(data) and not ended:
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise DamagedImage(f"Part {kind!r} fails its checksum.")
        if kind == b"IHDR" and size == 13:
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if header is None or not ended:
        raise DamagedImage("The image has no header or no end.")
    width, height, depth, colour, _, _, interlaced = header
    channels = next((n for n, c in COLOUR_TYPE.items() if c == colour), None)
    if depth != 8 or channels is None or interlaced:
        raise DamagedImage(f"Images of depth {depth}, colour type {colour} and interlacing {interlaced} are not read.")
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise DamagedImage(str(e)) from e
    if len(raw) != height * (width * channels + 1):
        raise DamagedImage("The image has too few or too many bytes.")
    rows = _unfiltered(np.frombuffer(raw, np.uint8).reshape(height, -1), channels)
    return rows.reshape((height, width) if channels == 1 else (height, width, channels))


def spread(rows: DataFrame, *by: str, n: int | None = None) -> DataFrame:
    """``rows`` in as many tasks as their number (or ``n``) asks for: few bytes of them are much work."""
    n = rows.count() if n is None else n
    return rows.repartition(min(TASKS, max(1, -(-n // TASK_IMAGES))), *by)


def png_of(pixels: Column, width: Column | int, height: Column | int) -> Column:
    """Grey PNG bytes of a column of pixels (array<int> from 0 to 255, row by row)."""

    @F.pandas_udf("binary")
    def encoded(rows, widths, heights):
        out = [None if r is None else encode_png(np.asarray(r, np.uint8).reshape(h, w)) for r, w, h in zip(rows, widths, heights)]
        return rows.__class__(out, dtype=object)

    whole = lambda n: n if isinstance(n, Column) else F.lit(n)
    return encoded(pixels, whole(width), whole(height))


def crop_images(images: DataFrame, boxes: DataFrame, image_col: str = "image", id_col: str = "box_id", content_col: str = "content") -> DataFrame:
    """(``id_col``, ``image_col``, width, height, content): every box of ``boxes``
    (``id_col``, ``image_col``, x0, y0, x1, y1; ends exclusive) cut out of its image
    as a PNG.

    Images must have distinct names.  The boxes of an image are dealt into lots of
    about ``LOT``, so that an image is read once a lot and not once a box, and one
    with a third of all boxes is spread over tasks.  Boxes are kept within the
    image; a box with nothing in it gives null content and size 0, and so does one
    with a null side or whose image has null content.  Boxes without an image, or
    with a null name, are left out; repeated boxes stay; a damaged image raises
    ``DamagedImage``.
    """
    corners = ["x0", "y0", "x1", "y1"]
    named = boxes.select(F.col(image_col).alias("__image"), F.col(id_col).alias("__id"), *[F.col(c).cast("int").alias(c) for c in corners])
    sizes = named.groupBy("__image").agg(F.ceil(F.count("*") / LOT).cast("bigint").alias("__lots"))
    lot = F.pmod(F.xxhash64("__id", *corners), F.col("__lots"))
    lots = named.join(sizes, "__image").groupBy("__image", lot.alias("__lot")).agg(F.collect_list(F.struct("__id", *corners)).alias("boxes"))
    work = lots.join(images.select(F.col(image_col).alias("__image"), F.col(content_col).alias("content")), "__image")
    work = spread(work, "__image", "__lot", n=boxes.count()).select("__image", "content", "boxes")
    kinds = dict(boxes.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                content, part = batch.column(1)[i].as_py(), batch.column(2).slice(i, 1).flatten()
                ids, (xs0, ys0, xs1, ys1) = part.field(0), (part.field(k + 1).to_pylist() for k in range(4))
                pixels = None if content is None else decode_png(content)
                out = []
                for box in zip(xs0, ys0, xs1, ys1):
                    x0, y0, x1, y1 = (0, 0, 0, 0) if pixels is None or None in box else box
                    cut = None if pixels is None else pixels[max(0, y0) : max(0, y1), max(0, x0) : max(0, x1)]
                    out.append((cut.shape[1], cut.shape[0], encode_png(cut)) if cut is not None and cut.size else (0, 0, None))
                w, h, pngs = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.repeat(batch.column(0)[i], len(out)), pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(pngs, pa.binary())],
                    names=[id_col, image_col, "width", "height", "content"],
                )

    return work.mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{image_col}` {kinds[image_col]}, width int, height int, content binary")


def write_images(rows: DataFrame, path: str, file_col: str = "file", content_col: str = "content") -> DataFrame:
    """Writes each row's ``content`` to ``path``/``file`` and returns (file, bytes,
    sha256) of what was written.

    Tasks write for themselves, to another name first and then by a rename, so a
    task that runs twice leaves one whole file.  Names may hold folders.  Names
    that are null, empty, repeated, or lead out of ``path`` raise before anything
    is written, and so does null content.
    """
    spark = rows.sparkSession
    fs, p = _fs(spark, path)
    fs.mkdirs(p)
    root = fs.makeQualified(p).toString()
    root = "file://" + root.removeprefix("file:") if root.startswith("file:/") and not root.startswith("file://") else root
    chosen = rows.select(F.col(file_col).alias("file"), F.col(content_col).alias("content"))
    name = F.col("file")
    bad = name.isNull() | (name == "") | name.startswith("/") | name.rlike(r"(^|/)\.\.?(/|$)") | F.col("content").isNull()
    wrong = chosen.select(name, bad.alias("bad")).groupBy("file").agg(F.count("*").alias("n"), F.max("bad").alias("bad")).where("bad OR n > 1").first()
    if wrong is not None:
        raise ValueError(f"File '{wrong['file']}' has no content, a name that cannot be used, or {wrong['n']} rows.")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as files

        store, base = files.FileSystem.from_uri(root)
        made: set[str] = set()
        for batch in batches:
            names, sizes, sums = batch.column(0).to_pylist(), [], []
            for name, content in zip(names, batch.column(1).to_pylist()):
                folder, _, last = f"{base}/{name}".rpartition("/")
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                draft = f"{folder}/.{last}.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as f:
                    f.write(content)
                store.move(draft, f"{folder}/{last}")
                sizes.append(len(content))
                sums.append(hashlib.sha256(content).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(sums, pa.string())], names=["file", "bytes", "sha256"])

    from .cache import saved

    return saved(spread(chosen, "file").mapInArrow(run, "file string, bytes bigint, sha256 string"))
