"""Media columns: Netpbm and BMP decoded to arrays, area-resized, written as NPY tiles with difference hashes.

decode() reads PBM, PGM and PPM (plain and raw, one or two bytes a sample) and
uncompressed BMP (1, 4, 8, 24 and 32 bits, bottom-up and top-down) without a media
library. resize() averages exact pixel areas through an integral image, so its cost
does not depend on the reduction. A tile is a small image as one NPY array.

A null or damaged image gives null results and its reason in ``error``; nothing is
dropped. For the text query null text counts as empty, a null doc_id is kept, repeated
rows are kept, an empty table gives an empty result, extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import attempt_tag, fresh_dir, map_arrow, materialize, open_fs, require

#: Bytes of a row of the stored form: 64 pixels of three samples. A payload is padded to a multiple of this.
ROW = 192
TILE = 8


class MediaError(ValueError):
    pass


def _netpbm_header(data: bytes, numbers: int) -> tuple[list[int], int]:
    """``numbers`` header fields after the magic, and where the samples start; comments run from # to the end of a line."""
    out, at = [], 2
    while len(out) < numbers:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            if data[at : at + 1] == b"#":
                at = data.find(b"\n", at)
                if at < 0:
                    raise MediaError("header ends in a comment")
            at += 1
        end = at
        while end < len(data) and 48 <= data[end] <= 57:
            end += 1
        if end == at:
            raise MediaError("header number missing")
        out.append(int(data[at:end]))
        at = end
    return out, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    kind = data[1:2]
    bits, planes = kind in b"14", 3 if kind in b"36" else 1
    (width, height, *rest), at = _netpbm_header(data, 2 if bits else 3)
    most = 1 if bits else rest[0]
    if not (width and height and 0 < most < 65536):
        raise MediaError("bad size or maximum")
    shape, count = (height, width, planes) if planes == 3 else (height, width), width * height * planes
    if kind == b"4":
        stride = (width + 7) // 8
        raw = np.frombuffer(data, np.uint8, offset=at)
        if len(raw) < stride * height:
            raise MediaError("samples missing")
        samples = np.unpackbits(raw[: stride * height].reshape(height, stride), axis=1)[:, :width]
    elif kind in b"56":
        wide = np.dtype(">u2" if most > 255 else "u1")
        if len(data) - at < count * wide.itemsize:
            raise MediaError("samples missing")
        samples = np.frombuffer(data, wide, count, at)
    elif kind == b"1":
        samples = np.array([b - 48 for b in data[at - 1 :] if b in b"01"][:count], np.uint8)
    else:
        samples = np.array(data[at - 1 :].split()[:count]).astype(np.int64)
    if samples.size != count:
        raise MediaError("samples missing")
    samples = samples.reshape(shape)
    if bits:
        return ((1 - samples) * 255).astype(np.uint8)
    if samples.size and samples.max() > most:
        raise MediaError("sample above the maximum")
    return samples.astype(np.uint8) if most == 255 else ((samples.astype(np.int64) * 255 + most // 2) // most).astype(np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise MediaError("header too short")
    u32 = lambda at: int.from_bytes(data[at : at + 4], "little")
    start, head, width, height = u32(10), u32(14), u32(18), int.from_bytes(data[22:26], "little", signed=True)
    depth, packed = int.from_bytes(data[28:30], "little"), u32(30)
    if packed not in (0, 3) or depth not in (1, 4, 8, 24, 32) or (packed == 3 and depth != 32) or not width or not height:
        raise MediaError("unsupported BMP")
    rows, stride = abs(height), (width * depth + 31) // 32 * 4
    if len(data) < start + stride * rows:
        raise MediaError("samples missing")
    lines = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if height > 0:
        lines = lines[::-1]
    if depth >= 24:
        return lines[:, : width * depth // 8].reshape(rows, width, depth // 8)[:, :, 2::-1]
    per = 8 // depth
    if per == 1:
        index = lines[:, :width]
    else:
        index = np.stack([(lines >> (8 - depth * (i + 1))) & ((1 << depth) - 1) for i in range(per)], 2).reshape(rows, -1)[:, :width]
    colours = u32(46) or 1 << depth
    palette = np.frombuffer(data, np.uint8, 4 * colours, 14 + head).reshape(-1, 4)[:, 2::-1]
    if index.max() >= colours:
        raise MediaError("colour outside the palette")
    return palette[index]


def decode(data: bytes) -> np.ndarray:
    """Samples of an image as uint8: (rows, columns) or (rows, columns, 3)."""
    try:
        if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
            return decode_netpbm(data)
        if data[:2] == b"BM":
            return decode_bmp(data)
    except MediaError:
        raise
    except (ValueError, IndexError, OverflowError) as e:
        raise MediaError(str(e)) from e
    raise MediaError("neither Netpbm nor BMP")


def encode_ppm(pixels: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24-bit bottom-up BMP."""
    rows, width = pixels.shape[:2]
    stride = (width * 3 + 3) // 4 * 4
    lines = np.zeros((rows, stride), np.uint8)
    lines[:, : width * 3] = pixels[::-1, :, ::-1].reshape(rows, -1)
    size = stride * rows
    numbers = [(54 + size, 4), (0, 4), (54, 4), (40, 4), (width, 4), (rows, 4), (1, 2), (24, 2), (0, 4), (size, 4), (2835, 4), (2835, 4), (0, 4), (0, 4)]
    return b"BM" + b"".join(n.to_bytes(k, "little") for n, k in numbers) + lines.tobytes()


def _edges(integral: np.ndarray, size: int) -> np.ndarray:
    """The integral along its first axis at ``size`` + 1 even cuts, linear between whole samples."""
    n = integral.shape[0] - 1
    at = np.arange(size + 1) * n
    whole, part = at // size, (at % size) / size
    above = integral[np.minimum(whole + 1, n)]
    part = part.reshape(-1, *[1] * (integral.ndim - 1))
    return integral[whole] * (1 - part) + above * part


def resize(pixels: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Mean of the exact area each new pixel covers, rounded half up."""
    sums = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1, *pixels.shape[2:]), np.int64)
    np.cumsum(np.cumsum(pixels, 0, dtype=np.int64), 1, out=sums[1:, 1:])
    cut = _edges(np.moveaxis(_edges(sums, rows), 1, 0), columns)
    cut = np.moveaxis(cut, 0, 1)
    area = (pixels.shape[0] / rows) * (pixels.shape[1] / columns)
    mean = np.diff(np.diff(cut, axis=0), axis=1) / area
    return np.clip(np.floor(mean + 0.5 + 1e-9), 0, 255).astype(np.uint8)


def difference_hash(pixels: np.ndarray) -> int:
    """64 bits: whether each of 8 by 8 areas is darker than its right neighbour."""
    grey = pixels if pixels.ndim == 2 else (pixels.astype(np.uint32) @ np.array([299, 587, 114], np.uint32) // 1000).astype(np.uint8)
    small = resize(grey, 8, 9)
    return int.from_bytes(np.packbits(small[:, :-1] < small[:, 1:]).tobytes(), "big")


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def write_tiles(media: DataFrame, folder: str, size: int = TILE, keep: str | None = None) -> DataFrame:
    """Decode ``media`` (id, media), write one NPY stack of tiles a task, and describe each image.

    Columns: id, rows, columns, planes, dhash (16 hexadecimal digits), tile_file, tile_row,
    tile_crc32, payload_sha256 and tail_crc32 of the decoded samples, error; and, as ``kept``, the long column ``keep``. A task that is
    tried again writes a new file; only files named in the result count.
    """
    require(media, "id", "media")
    schema = "id long, rows int, columns int, planes int, dhash string, tile_file string, tile_row long, tile_crc32 long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, error string, kept long"
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    fields = [pa.field(f.split()[0], types[f.split()[1]]) for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, tiles, most = None, [], 4096
        fs, base = open_fs(folder)
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal tiles, rows
            if tiles:
                fs.create_dir(base, recursive=True)
                with fs.open_output_stream(f"{base}/{path}") as out:
                    out.write(npy(np.stack(tiles)))
            done = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))
            tiles, rows = [], []
            return done

        for batch in batches:
            for key, data, kept in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = data.as_py()
                if not tiles:
                    path = f"tiles-{attempt_tag()}.npy"
                try:
                    if data is None:
                        raise MediaError("null")
                    pixels = decode(data)
                except MediaError as e:
                    rows.append((key, *[None] * 10, None if data is None else len(data), None if data is None else hashlib.sha256(data).hexdigest(), str(e), kept))
                    continue
                shown = pixels if pixels.ndim == 3 else np.repeat(pixels[:, :, None], 3, 2)
                tile = resize(shown, size, size)
                payload = np.ascontiguousarray(pixels).tobytes()
                rows.append((key, pixels.shape[0], pixels.shape[1], 3 if pixels.ndim == 3 else 1, f"{difference_hash(pixels):016x}", f"{folder}/{path}", len(tiles), zlib.crc32(npy(tile)), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), None, kept))
                tiles.append(tile)
                if len(tiles) >= most:
                    yield flush()
            if len(rows) >= most:
                yield flush()
        if rows:
            yield flush()

    carried = F.col(keep) if keep else F.lit(None)
    out = media.select("id", "media", carried.cast("long").alias("kept")).mapInArrow(run, schema)
    return out if keep else out.drop("kept")


def text_media(docs: DataFrame) -> DataFrame:
    """Texts as images of 64 columns, three samples a pixel: id, n_bytes, media. PPM for odd numbers of rows, BMP for even ones."""
    require(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, stored, total, first = [], [], 0, 0
            for i, text in enumerate(batch.column(1)):
                data = (text.as_py() or "").encode()
                if total + len(data) > 16_000_000 and stored:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, i - first), pa.array(sizes, pa.int64()), pa.array(stored, pa.binary())], names=["id", "n_bytes", "media"])
                    sizes, stored, total, first = [], [], 0, i
                total += len(data)
                rows = max(1, -(-len(data) // ROW))
                pixels = np.frombuffer(data.ljust(rows * ROW), np.uint8).reshape(rows, ROW // 3, 3)
                sizes.append(len(data))
                stored.append(encode_ppm(pixels) if rows % 2 else encode_bmp(pixels))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first), pa.array(sizes, pa.int64()), pa.array(stored, pa.binary())], names=["id", "n_bytes", "media"])

    return map_arrow(docs.select("doc_id", "text"), run, "id long, n_bytes long, media binary")


def media_features(docs: DataFrame) -> DataFrame:
    """Store whole texts as media in the shared folder, read the stored bytes back and compute features of them."""
    stored = materialize(text_media(docs), "media")
    described = write_tiles(stored, fresh_dir(docs.sparkSession, "tiles"), keep="n_bytes")
    feature = F.concat_ws(":", "dhash", F.lpad(F.lower(F.hex("tile_crc32")), 8, "0"))
    return described.select(
        F.col("id").alias("doc_id"), F.col("kept").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature")
    )
