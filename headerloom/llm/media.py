"""Media columns: Netpbm and BMP images to NPY tiles and difference hashes (operator 8).

``decode_image`` reads Netpbm (P1 to P6, plain and raw, up to 16 bits) and
uncompressed BMP (1, 4, 8, 24 and 32 bits) into numpy arrays; ``area_resize``
takes exact means over rectangles, fractional borders included, from an
integral image; tiles are NPY files in a binary column. Each row is one image;
Spark partitions the rows and nothing is gathered.

The query writes every text's UTF-8 bytes, padded with zeros to a multiple of
64, as a grey image 64 samples wide to the shared folder, reads it back from
there and computes everything from the bytes read.

Edge cases: a null text counts as empty (one row of zeros); a null image or one
that can't be read gives null columns and the reason in ``error``; an image
without samples is an error; repeated rows each keep their row; an empty table
gives an empty result; columns besides the id and the media are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headerloom.llm.common import staged, text_or_empty

TILE = 16
WIDTH = 64
#: Rows of an image that one step of the integral image takes; bounds memory for tall images.
BAND_ROWS = 65_536

_HEADER_ITEM = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d+)")


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - 48
    values, at = [], 2
    for _ in range(2 if kind in (1, 4) else 3):
        m = _HEADER_ITEM.match(data, at)
        if not m:
            raise ValueError("broken Netpbm header")
        values.append(int(m[1]))
        at = m.end()
    width, height, top = *values[:2], (values[2] if len(values) == 3 else 1)
    if not 0 < top < 65_536:
        raise ValueError("Netpbm maximum out of range")
    depth = 3 if kind in (3, 6) else 1
    n = width * height * depth
    if kind in (1, 2, 3):
        body = re.sub(rb"#[^\n\r]*", b"", data[at:])
        # Bits of a plain bitmap may stand without white space between them.
        samples = np.array([c - 48 for c in body if c in b"01"] if kind == 1 else body.split(), dtype=np.int64)
    elif kind == 4:
        row = -(-width // 8)
        packed = np.frombuffer(data, np.uint8, offset=at + 1)[: row * height]
        if len(packed) < row * height:
            raise ValueError("image data end early")
        samples = np.unpackbits(packed.reshape(height, row), axis=1)[:, :width].ravel()
    else:
        samples = np.frombuffer(data[at + 1 : at + 1 + n * (2 if top > 255 else 1)], ">u2" if top > 255 else np.uint8)
    if len(samples) < n:
        raise ValueError("image data end early")
    samples = samples[:n].reshape((height, width, 3) if depth == 3 else (height, width))
    if kind in (1, 4):
        return np.where(samples == 1, 0, 255).astype(np.uint8)
    if samples.size and int(samples.max()) > top:
        raise ValueError("a sample is above the maximum")
    if top == 255:
        return samples.astype(np.uint8, copy=False)
    # Other maxima are spread over 0 to 255.
    return ((samples.astype(np.uint32) * 255 + top // 2) // top).astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    if len(data) < 30:
        raise ValueError("broken BMP header")
    at, size = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    core = size == 12
    width, height = struct.unpack_from("<HH" if core else "<ii", data, 18)
    bits = struct.unpack_from("<H", data, 24 if core else 28)[0]
    packing = 0 if core else struct.unpack_from("<I", data, 30)[0]
    if packing != 0 or bits not in (1, 4, 8, 24, 32):
        raise ValueError(f"BMP of {bits} bits, compression {packing}, is not supported")
    flipped, height = height > 0, abs(height)
    row = (width * bits + 31) // 32 * 4
    raw = np.frombuffer(data[at : at + row * height], np.uint8)
    if len(raw) < row * height or width <= 0:
        raise ValueError("image data end early")
    raw = raw.reshape(height, row)
    if bits >= 24:
        out = raw[:, : width * bits // 8].reshape(height, width, bits // 8)[:, :, 2::-1]
    else:
        entry, start = (3, 26) if core else (4, 14 + size)
        colours = (0 if core else struct.unpack_from("<I", data, 46)[0]) or 1 << bits
        table = np.frombuffer(data[start : start + entry * colours], np.uint8).reshape(-1, entry)[:, 2::-1]
        places = raw if bits == 8 else np.unpackbits(raw, axis=1).reshape(height, -1, bits) @ (1 << np.arange(bits)[::-1])
        places = places[:, :width]
        if places.size and int(places.max()) >= len(table):
            raise ValueError("a colour is outside the palette")
        out = table[places]
    return np.ascontiguousarray(out[::-1] if flipped else out)


def decode_image(data: bytes) -> np.ndarray:
    """(height, width) of grey or (height, width, 3) of RGB samples, 8 bits each."""
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        out = _netpbm(data)
    elif data[:2] == b"BM":
        out = _bmp(data)
    else:
        raise ValueError("neither Netpbm nor BMP")
    if not out.size:
        raise ValueError("an image without samples")
    return out


def encode_grey(samples: np.ndarray) -> bytes:
    """Raw grey Netpbm of an 8-bit array."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def grey(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    # Integer luma weights in thousandths.
    return ((image.astype(np.uint32) @ np.array([299, 587, 114], dtype=np.uint32) + 500) // 1000).astype(np.uint8)


def _edges(n: int, out: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(out + 1) * n / out
    whole = np.minimum(at.astype(np.int64), n - 1)
    return whole, at - whole


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means of the grey image over height x width equal rectangles, as float64.

    Row sums up to each fractional edge come from the integral image, taken
    band by band so that tall images need no whole one in memory.
    """
    rows, cols = image.shape
    x, fx = _edges(cols, width)
    y, fy = _edges(rows, height)
    at_edges = np.zeros((height + 1, width + 1))
    above = np.zeros(cols + 1, dtype=np.int64)
    for top in range(0, rows, BAND_ROWS):
        band = image[top : top + BAND_ROWS]
        integral = np.zeros((len(band) + 1, cols + 1), dtype=np.int64)
        np.cumsum(band, axis=0, out=integral[1:, 1:])
        np.cumsum(integral[1:, 1:], axis=1, out=integral[1:, 1:])
        integral += above
        above = integral[-1]
        here = np.flatnonzero((y >= top) & (y < top + len(band)))
        r = y[here] - top
        lines = integral[r] + fy[here, None] * (integral[r + 1] - integral[r])
        at_edges[here] = lines[:, x] + fx * (lines[:, x + 1] - lines[:, x])
    sums = at_edges[1:, 1:] - at_edges[:-1, 1:] - at_edges[1:, :-1] + at_edges[:-1, :-1]
    return sums * (height * width / (rows * cols))


def difference_hash(image: np.ndarray) -> int:
    """64 bits, row by row: whether each of 8 x 9 means is below its right neighbour, to 1/1024 of a level."""
    small = np.rint(area_resize(image, 8, 9) * 1024)
    return int.from_bytes(np.packbits(small[:, :-1] < small[:, 1:]).tobytes(), "big")


def tile_of(image: np.ndarray, size: int = TILE) -> bytes:
    """The image resized to size x size as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(image, size, size)), 0, 255).astype(np.uint8))
    return out.getvalue()


def media_tiles(media: DataFrame, id_col: str, media_col: str, size: int = TILE) -> DataFrame:
    """``id_col``, height, width, npy (tile), dhash (16 hex digits) and error of each image."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for value in batch.column(1):
                try:
                    image = grey(decode_image(value.as_py() or b""))
                    rows.append((*image.shape, tile_of(image, size), f"{difference_hash(image):016x}", None))
                except (ValueError, struct.error, IndexError) as e:
                    rows.append((None, None, None, None, str(e)))
            parts = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p, k) for p, k in zip(parts, kinds, strict=True)]], names=[id_col, "height", "width", "npy", "dhash", "error"])

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(F.col(id_col), F.col(media_col)).mapInArrow(work, f"`{id_col}` {kind}, height int, width int, npy binary, dhash string, error string")


def texts_as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes and media: each text's bytes, zero-padded, as a grey image WIDTH wide."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for value in batch.column(1).cast(pa.binary()):
                raw = value.as_buffer()
                padded = np.zeros(max(1, -(-raw.size // WIDTH)) * WIDTH, dtype=np.uint8)
                padded[: raw.size] = np.frombuffer(raw, np.uint8)
                sizes.append(raw.size)
                media.append(encode_grey(padded.reshape(-1, WIDTH)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), text_or_empty(text_col).alias("text")).mapInArrow(work, f"`{id_col}` {kind}, n_bytes long, media binary")


def payload_digests(stored: DataFrame, id_col: str = "doc_id", size: int = TILE) -> DataFrame:
    """Digests of the samples in each stored image, with its tile and difference hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(2):
                media = value.as_buffer()
                image = decode_image(media.to_pybytes())
                payload = image.tobytes()
                tile = tile_of(image, size)
                feature = f"{difference_hash(image):016x}-{zlib.crc32(tile):08x}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), media.size, hashlib.sha256(media).hexdigest(), feature, tile))
            parts = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_npy"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(p, k) for p, k in zip(parts, kinds, strict=True)]], names=[id_col, "n_bytes", *names])

    kind = stored.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_npy binary"
    return stored.select(id_col, "n_bytes", "media").mapInArrow(work, schema)


def op8_media(spark, sf_dir: str) -> DataFrame:
    """Every document's text as a stored grey image, with digests, tile and hash from the stored bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return payload_digests(staged(texts_as_media(docs), "media"))
