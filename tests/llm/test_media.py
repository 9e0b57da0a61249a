import hashlib
import io
import struct
import zlib

import numpy as np
import pytest
from spanloom.llm import media as M


def test_decoders():
    assert M.decode(b"P1\n# c\n3 2\n1 0 1\n0 1 0\n").tolist() == [[1, 0, 1], [0, 1, 0]]
    assert M.decode(b"P4 3 2\n\xa0\x40").tolist() == [[1, 0, 1], [0, 1, 0]]
    assert M.decode(b"P2 2 1 9\n3 4").tolist() == [[3, 4]]
    assert M.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert M.decode(b"P5 1 1 65535\n\x01\x02").tolist() == [[258]]
    grid = np.arange(15, dtype=np.uint8).reshape(3, 5)
    assert (M.decode(M.encode_bmp(grid)) == grid).all() and (M.decode(M.encode_netpbm(grid)) == grid).all()
    for bad in (b"", b"P9 1 1", b"BMxx", b"P5 9 9 255\n12"):
        with pytest.raises(Exception):  # noqa: B017
            M.decode(bad)


def test_area_resize_against_upsampled_mean():
    rng = np.random.default_rng(0)
    for h, w, a, b in ((6, 9, 4, 5), (1, 64, 8, 9), (7, 3, 7, 3), (5, 5, 1, 1)):
        x = rng.integers(0, 256, (h, w)).astype(np.uint8)
        fine = np.repeat(np.repeat(x.astype(float), a, 0), b, 1)  # every output cell is then whole
        assert np.allclose(M.area_resize(x, a, b), fine.reshape(a, h, b, w).mean(axis=(1, 3)))


def test_texts_round_trip(spark, edge_docs):
    got = {r.doc_id: r for r in M.media_features(edge_docs).collect()}
    for i, text in {1: "", 2: "", 3: "the cat sat on the mat " * 4000, 7: "é😀 password = abcdefghijklmnop a.b@c.de"}.items():
        raw = text.encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
    stored = {r.doc_id: r.media for r in M.media_of_texts(edge_docs).collect()}
    assert all(hashlib.sha256(stored[i]).hexdigest() == got[i].media_sha256 and len(stored[i]) == got[i].media_bytes for i in stored)


@pytest.mark.parametrize("rows", range(1, 8))
def test_all_forms_are_lossless(rows):
    payload = np.random.default_rng(rows).integers(0, 256, rows * 64).astype(np.uint8).tobytes()
    assert M.decode(M.store(payload)).tobytes() == payload


def test_tiles(spark, no_docs):
    image = np.arange(40 * 50, dtype=np.int64).reshape(40, 50).astype(np.uint8)
    df = spark.createDataFrame([(1, bytearray(M.encode_netpbm(image))), (2, None), (3, bytearray(b"junk"))], "media_id long, media binary")
    got = M.tiles(df, size=32, resize=None).collect()
    whole = np.zeros_like(image)
    for r in got:
        if r.npy:
            t = np.load(io.BytesIO(r.npy))
            whole[r.tile_y : r.tile_y + t.shape[0], r.tile_x : r.tile_x + t.shape[1]] = t
    assert (whole == image).all() and sorted((r.media_id, r.error is None) for r in got) == [(1, True)] * 4 + [(3, False)]
    assert M.media_features(no_docs).count() == 0
    small = [r for r in M.tiles(df, size=8, resize=(16, 12)).collect() if r.npy]
    assert len(small) == 4 and all((np.load(io.BytesIO(r.npy)) == M.resized(image, 16, 12)[r.tile_y : r.tile_y + 8, r.tile_x : r.tile_x + 8]).all() for r in small)
    assert M.resized(np.stack([image, image, image], 2), 5, 5).shape == (5, 5, 3)


def bmp(w, h, bits=24, used=0):
    return b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, 0, 0, 0, 0, used, 0)


BAD = [
    b"P5 99999999999 99999999999 255\n1", bmp(2**31 - 1, 2**31 - 1), bmp(-(2**31), -(2**31)), b"P2 1 1 255 300", b"P2 1 1 255 -4", b"P5 0 5 255\n",
    bmp(0, 7), b"P5 5 0 255\n", b"P5 1 1 0\n1", b"P5 1 1 70000\n11", b"P1 3 3 101", b"P4 99 99\n1", b"P", b"P6 1 1 255\n12", b"P2 1 1 9 " + b"9" * 5000, bmp(4, 4, 8, 2**32 - 1),
]


def test_malformed_images_are_error_rows(spark):
    for data in BAD:
        with pytest.raises(ValueError):
            M.decode(data)
    got = M.tiles(spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(BAD)], "media_id long, media binary")).collect()
    assert sorted(r.media_id for r in got) == list(range(len(BAD))) and all(r.error and r.npy is None and r.dhash is None for r in got)


def mean_of(image, y0, y1, x0, x1):
    """Mean of an area with fractions of pixels at its borders, pixel by pixel."""
    total = 0.0
    for y in range(int(y0), min(image.shape[0], int(np.ceil(y1)))):
        for x in range(int(x0), min(image.shape[1], int(np.ceil(x1)))):
            total += float(image[y, x]) * (min(y + 1, y1) - max(y, y0)) * (min(x + 1, x1) - max(x, x0))
    return total / ((y1 - y0) * (x1 - x0))


def test_difference_hash_against_single_pixels(monkeypatch):
    monkeypatch.setattr(M, "SLAB", 3)
    rng = np.random.default_rng(4)
    for h, w in ((5, 64), (17, 9), (8, 9), (1, 64), (40, 31)):
        image = rng.integers(0, 256, (h, w)).astype(np.uint8)
        cells = np.round([[mean_of(image, i * h / 8, (i + 1) * h / 8, j * w / 9, (j + 1) * w / 9) for j in range(9)] for i in range(8)], 6)
        want = "".join(f"{int(''.join('1' if r[j + 1] > r[j] else '0' for j in range(8)), 2):02x}" for r in cells)
        assert M.difference_hash(image) == want


def test_query_goes_through_tiles(spark):
    texts = [(1, "ab" * 500), (2, ""), (3, "z" * 64 * 7)]
    got = {r.doc_id: r for r in M.media_features(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    stored = M.media_of_texts(spark.createDataFrame(texts, "doc_id long, text string")).selectExpr("doc_id AS media_id", "media")
    cut = sorted((r.media_id, r.tile_y, r.tile_x, bytes(r.npy), r.dhash) for r in M.tiles(stored).collect())
    for i in got:
        mine = [x for x in cut if x[0] == i]
        assert got[i].n_tiles == len(mine) == 4
        assert got[i].tiles_sha256 == hashlib.sha256(b"".join(x[3] for x in mine)).hexdigest()
        assert got[i].tile_hashes == ",".join(x[4] for x in mine)
        assert all(np.load(io.BytesIO(x[3])).shape[:2] == (32, 32) for x in mine)
