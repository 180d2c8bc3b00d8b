import hashlib
import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernel.llm import media

RNG = np.random.default_rng(11)


def bmp(bits, rows, palette=4, height=None):
    """A BMP with a palette of greys 10, 20, ...; rows from the bottom, each value once for every byte of a sample."""
    body = b"".join(bytes(v for v in row for _ in range(bits // 8)).ljust(-(-len(row) * bits // 32) * 4, b"\0") for row in rows)
    colours = b"".join(bytes([10 * k % 256] * 3 + [0]) for k in range(1, palette + 1)) if bits == 8 else b""
    head = b"BM" + (54 + len(colours) + len(body)).to_bytes(4, "little") + bytes(4) + (54 + len(colours)).to_bytes(4, "little")
    info = np.array([40, len(rows[0]), len(rows) if height is None else height], "<i4").tobytes() + np.array([1, bits], "<i2").tobytes() + np.array([0, len(body), 0, 0, palette if bits == 8 else 0, 0], "<i4").tobytes()
    return head + info + colours + body


def test_kinds_of_bmp():
    assert media.decode(bmp(8, [[0, 1], [2, 3]])).tolist() == [[30, 40], [10, 20]]
    assert media.decode(bmp(8, [[0, 1], [2, 3]], height=-2)).tolist() == [[10, 20], [30, 40]]
    assert media.decode(bmp(32, [[7, 8]])).tolist() == [[[7] * 3, [8] * 3]]
    assert media.decode(bmp(24, [[7, 8, 9]], height=-1)).tolist() == [[[7] * 3, [8] * 3, [9] * 3]]


HEADS = [b"P1 2 2\n", b"P2 2 2 9\n", b"P3 1 2 300\n", b"P4 9 2\n", b"P5 2 2 255\n", b"P5 2 2 7\n", b"P6 1 2 65535\n", b"P5 ", b"P2 ", b"BM", bmp(8, [[0, 1]])[:54], bmp(8, [[0, 1]])[:28], bmp(24, [[0, 1]])[:54], bmp(32, [[0, 1]])[:46]]


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(HEADS), st.one_of(st.binary(max_size=80), st.text("0123456789 -#\n", max_size=60).map(str.encode)))
def test_any_bytes_give_an_image_or_a_value_error(head, rest):
    try:
        image = media.decode(head + rest)
    except ValueError:
        return
    assert image.dtype in (np.uint8, np.uint16) and image.ndim in (2, 3)
    if image.size:
        assert media.area_resize(image, 3, 3).shape == (3, 3)


def test_bad_images_give_nulls(spark):
    rows = [(1, b"P2 1 1 9\n-3"), (2, bmp(8, [[3]], palette=2)), (3, None), (4, b"P5 1 1 255\n\x07"), (5, b"P3 1 1 255\n1 2 99999999999999999999")]
    got = {r.k: r for r in media.media_columns(spark.createDataFrame(rows, "k int, media binary"), ["k"]).collect()}
    assert all(got[k].payload is None and got[k].tile is None and got[k].dhash is None and got[k].height is None for k in (1, 2, 3, 5))
    assert bytes(got[4].payload) == b"\x07" and got[4].height == 1


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.booleans(), st.booleans())
def test_round_trips(height, width, colour, wide):
    shape = (height, width, 3) if colour else (height, width)
    image = RNG.integers(0, 256, shape).astype(np.uint8)
    assert (media.decode(media.encode_bmp(image)) == image).all()
    if wide:
        image = RNG.integers(0, 65536, shape).astype(np.uint16)
    back = media.decode(media.encode_netpbm(image))
    assert back.dtype == image.dtype and (back == image).all()


@pytest.mark.parametrize(
    "data,want",
    [
        (b"P1\n# c\n3 2\n1 0 1\n010\n", [[0, 255, 0], [255, 0, 255]]),
        (b"P2 2 1 9\n3 9", [[85, 255]]),
        (b"P3\n1 1\n255\n1 2 3\n", [[[1, 2, 3]]]),
        (b"P4\n10 1\n\xaa\x80", [[0, 255, 0, 255, 0, 255, 0, 255, 0, 255]]),
        (b"P5 2 1 255\n\x01\x02", [[1, 2]]),
        (b"P5 2 1 15\n\x05\x0f", [[85, 255]]),
        (b"P5 1 1 300\n\x01\x2c", [[65535]]),
        (b"P1 0 0", []),
    ],
)
def test_formats(data, want):
    assert media.decode(data).tolist() == want


@pytest.mark.parametrize("data", [b"", b"P", b"P7\n1 1\n1\n", b"P5 2 2 255\n\x01", b"P5 2", b"P5 #", b"P4\n9 2\n\x00", b"BM", b"BM" + b"\0" * 60, b"P2 2 2 9\n1", b"P2 1 1 9\n-3", b"P2 1 1 9\n10", b"P3 1 1 255\n1 2 99999999999999999999999", b"P2 1 1 255\n1_0", b"P5 1 1 15\n\x10", b"P5 99999999999 1 255\n", b"P6 999999 999999 255\n", bmp(8, [[3]], palette=2), bmp(8, [[0]], palette=300), bmp(24, [[0]])[:-4]])
def test_broken_images(data):
    with pytest.raises(ValueError):
        media.decode(data)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 30), st.integers(1, 30), st.integers(1, 12), st.integers(1, 12))
def test_area_resize(h, w, height, width):
    image = RNG.integers(0, 256, (h, w)).astype(np.uint8)
    want = np.zeros((height, width))
    for y in range(height):
        for x in range(width):
            y0, y1, x0, x1 = y * h / height, (y + 1) * h / height, x * w / width, (x + 1) * w / width
            total = sum(float(image[i, j]) * (min(i + 1, y1) - max(i, y0)) * (min(j + 1, x1) - max(j, x0)) for i in range(int(y0), min(h, int(np.ceil(y1)))) for j in range(int(x0), min(w, int(np.ceil(x1)))))
            want[y, x] = total / ((y1 - y0) * (x1 - x0))
    assert np.abs(media.area_resize(image, height, width) - want).max() <= 0.51


def test_tile_and_hash():
    image = np.tile(np.arange(90, dtype=np.uint8), (40, 1))
    assert np.load(io.BytesIO(media.npy_tile(image))).shape == (32, 32)
    assert media.difference_hash(image) == 0 and media.difference_hash(image[:, ::-1]) == (1 << 64) - 1


@pytest.mark.parametrize("form", ["netpbm", "bmp"])
def test_columns(spark, odd_docs, odd_rows, no_docs, form):
    rows = media.media_columns(media.media_from_text(odd_docs, form=form), ["doc_id", "n_bytes"]).collect()
    texts = dict(odd_rows)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert bytes(r.payload) == raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff") and r.n_bytes == len(raw)
    assert len(rows) == len(odd_rows)
    same = [r for r in rows if r.doc_id in (5, 6)]
    assert same[0][2:] == same[1][2:]
    assert media.media_from_text(no_docs).count() == 0


def test_columns_of_broken_media(spark):
    rows = media.media_columns(spark.createDataFrame([(1, bytearray(b"no")), (2, None)], "doc_id long, media binary"), ["doc_id"]).collect()
    assert all(r.payload is None and r.dhash is None for r in rows)


def test_query(spark, tiny):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    rows = media.op7_media_columns(spark, tiny).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = media.encode_netpbm(media.payload_image(raw))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
