"""Operator 7: media columns. Netpbm and BMP images as numpy arrays, area-resized by integral images.

encode()/decode() cover Netpbm P1 to P6 (8 and 16 bits; written as P5 or P6) and BMP of 8, 24 and 32 bits.
A resized image is kept as an NPY tile beside a difference hash of its brightness.

Defined cases: null text is an empty text, whose payload is one block of padding; equal payloads give
equal values; an empty table gives no row; a file that is no such image, is cut short, names a colour beyond its
palette, a sample above its largest one or more samples than its bytes can hold raises ValueError in decode() and
gives nulls in media_columns(), as a null does; an image without samples has a height and a width but no hash and
no tile; texts of any length are stored whole; columns other than those named are ignored.
"""

from __future__ import annotations

import io
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import documents, map_batches, texts_of

BLOCK, PAD, WIDTH = 576, 255, 24
TILE = 32


def encode_netpbm(image: np.ndarray) -> bytes:
    """P5 for (height, width), P6 for (height, width, 3); uint8 or uint16."""
    kind = b"P5" if image.ndim == 2 else b"P6"
    top = 255 if image.dtype == np.uint8 else 65535
    return b"%s\n%d %d\n%d\n" % (kind, image.shape[1], image.shape[0], top) + image.astype(np.uint8 if top == 255 else ">u2").tobytes()


def netpbm_header(data: bytes) -> tuple[bytes, int, int, int, int]:
    """(kind, width, height, largest sample, where the samples begin)"""
    kind, at, fields = data[:2], 2, []
    if len(data) < 3 or kind[:1] != b"P" or kind[1:] not in (b"1", b"2", b"3", b"4", b"5", b"6"):
        raise ValueError("not a Netpbm image")
    need = 2 if kind in (b"P1", b"P4") else 3
    while len(fields) < need:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            end = data.find(b"\n", at)
            if end < 0:
                raise ValueError("header ends in a comment")
            at = end + 1
            continue
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if not 0 < end - at < 10:
            raise ValueError("a number of the header is missing or too long")
        fields.append(int(data[at:end]))
        at = end
    return kind, fields[0], fields[1], fields[2] if need == 3 else 1, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6, with comments; samples as they are stored where the largest is 255 or 65535, else stretched to that (P1 and P4: 0 for black, 255 for white)."""
    kind, width, height, top, at = netpbm_header(data)
    depth = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * depth
    if not 0 < top < 65536:
        raise ValueError("largest sample out of range")
    if n > 8 * len(data):
        raise ValueError("image is cut short")
    shape = (height, width) if depth == 1 else (height, width, 3)
    if kind == b"P4":
        row = -(-width // 8)
        raw = np.frombuffer(data[at + 1 : at + 1 + row * height], np.uint8)
        if len(raw) < row * height:
            raise ValueError("image is cut short")
        return np.where(np.unpackbits(raw.reshape(height, row), axis=1)[:, :width] == 1, 0, 255).astype(np.uint8) if n else np.empty(shape, np.uint8)
    if kind == b"P1":
        bits = np.frombuffer(data[at:], np.uint8)
        flat = np.where(bits[(bits == 48) | (bits == 49)][:n] == 49, 0, 255)
        top = 255
    elif kind in (b"P2", b"P3"):
        words = data[at:].split()[:n]
        if not all(w.isdigit() and len(w) < 10 for w in words):
            raise ValueError("a sample is no number in range")
        flat = np.array([int(w) for w in words], np.int64)
    else:
        size = 1 if top < 256 else 2
        flat = np.frombuffer(data[at + 1 : at + 1 + n * size], np.uint8 if size == 1 else ">u2", min(n, max(0, len(data) - at - 1) // size))
    if len(flat) != n:
        raise ValueError("image is cut short")
    if n and int(flat.max()) > top:
        raise ValueError("a sample is above the largest")
    full = 255 if top < 256 else 65535
    if top != full:
        flat = (flat.astype(np.int64) * full + top // 2) // top
    return flat.astype(np.uint8 if full == 255 else np.uint16).reshape(shape)


def encode_bmp(image: np.ndarray) -> bytes:
    """8 bits with a grey palette for (height, width), 24 bits for (height, width, 3); rows from the bottom."""
    height, width = image.shape[:2]
    grey = image.ndim == 2
    rows = image[::-1] if grey else image[::-1, :, ::-1].reshape(height, width * 3)
    stride = -(-rows.shape[1] // 4) * 4
    body = np.zeros((height, stride), np.uint8)
    body[:, : rows.shape[1]] = rows
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy() if grey else np.empty((0, 4), np.uint8)
    palette[:, 3:] = 0
    start = 54 + palette.size
    head = struct.pack("<2sIHHI", b"BM", start + body.size, 0, 0, start)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8 if grey else 24, 0, body.size, 2835, 2835, 256 if grey else 0, 0)
    return head + info + palette.tobytes() + body.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits, rows from the bottom or the top."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    (start,) = struct.unpack_from("<I", data, 10)
    size, width, height, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if packed or bits not in (8, 24, 32) or width <= 0 or size < 40:
        raise ValueError("this kind of BMP isn't supported")
    stride = -(-width * bits // 32) * 4
    rows = abs(height)
    if len(data) < start + stride * rows:
        raise ValueError("image is cut short")
    body = np.frombuffer(data[start : start + stride * rows], np.uint8).reshape(rows, stride)[:, : width * bits // 8]
    body = body if height < 0 else body[::-1]
    if bits > 8:
        return body.reshape(rows, width, bits // 8)[:, :, 2::-1]
    (used,) = struct.unpack_from("<I", data, 46)
    used = used or 256
    if used > 256 or len(data) < 14 + size + 4 * used:
        raise ValueError("palette is cut short")
    palette = np.frombuffer(data[14 + size : 14 + size + 4 * used], np.uint8).reshape(-1, 4)[:, 2::-1]
    if body.size and int(body.max()) >= used:
        raise ValueError("a sample is beyond the palette")
    colours = palette[body]
    return colours[:, :, 0] if (palette == palette[:, :1]).all() else colours


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the exact area that each target sample covers, from the integral image read between its nodes; uint8."""
    grey = image if image.ndim == 2 else image.astype(np.float64) @ np.array([0.299, 0.587, 0.114])
    h, w = grey.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(grey, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])

    def between(table: np.ndarray, n: int, size: int) -> np.ndarray:
        at = np.arange(size + 1) * n / size
        low = np.minimum(at.astype(np.int64), n - 1)
        part = (at - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    nodes = between(between(total, h, height).T, w, width).T
    sums = np.diff(np.diff(nodes, axis=0), axis=1)
    mean = sums * (height * width / (h * w))
    return np.clip(np.floor(mean * (255 / 65535 if image.dtype == np.uint16 else 1) + 0.5), 0, 255).astype(np.uint8)


def difference_hash(image: np.ndarray) -> int:
    """64 bits: whether each of 8 x 9 area means is brighter than its right neighbour."""
    small = area_resize(image, 8, 9)
    return int.from_bytes(np.packbits(small[:, :-1] > small[:, 1:]).tobytes(), "big")


def npy_tile(image: np.ndarray, size: int = TILE) -> bytes:
    out = io.BytesIO()
    np.save(out, area_resize(image, size, size))
    return out.getvalue()


def payload_image(payload: bytes) -> np.ndarray:
    """UTF-8 bytes, padded by 255 to a positive multiple of BLOCK, as rows of WIDTH samples."""
    n = max(1, -(-len(payload) // BLOCK)) * BLOCK
    return np.frombuffer(payload.ljust(n, bytes([PAD])), np.uint8).reshape(-1, WIDTH)


def media_from_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", form: str = "netpbm") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text stored losslessly as a grey image file, `netpbm` or `bmp`."""
    write = {"netpbm": encode_netpbm, "bmp": encode_bmp}[form]

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [t.encode() for t in texts_of(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array([write(payload_image(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id", "text"], fn, "doc_id long, n_bytes long, media binary")


def media_columns(media: DataFrame, carry: list[str], media_col: str = "media", payload: bool = True) -> DataFrame:
    """The columns `carry`, media, payload (samples read back), height, width, dhash (16 hex digits) and tile (an NPY file) of every stored image."""
    kept = [*carry, media_col]

    def one(data: bytes | None) -> tuple:
        try:
            image = decode(data or b"")
        except (ValueError, struct.error):
            return None, None, None, None, None
        if not image.size:
            return b"", image.shape[0], image.shape[1], None, None
        return image.tobytes() if payload else None, image.shape[0], image.shape[1], f"{difference_hash(image):016x}", npy_tile(image)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = list(zip(*[one(x) for x in batch.column(len(carry)).to_pylist()]))
        kinds = [pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, k) for x, k in zip(got, kinds)]], names=[*kept, "payload", "height", "width", "dhash", "tile"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.select(*kept).schema)
    return map_batches(media, kept, fn, f"{head}, payload binary, height int, width int, dhash string, tile binary", rows=64)


def op7_media_columns(spark, sf_dir):
    read = media_columns(media_from_text(documents(spark, sf_dir)), ["doc_id", "n_bytes"])
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, greatest(length(payload) - 31, 1), 32)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.lit("dhash:"), F.col("dhash"), F.lit(" tile:"), F.lpad(F.lower(F.hex(F.crc32("tile"))), 8, "0")).alias("feature"),
    )
