"""Media columns: Netpbm and BMP bytes to numpy arrays, area resizing by integral images, NPY tiles, difference hashes.

decode() reads P1 to P6 (8 and 16 bits a sample) and uncompressed BMP (8-bit palette, 24 and 32 bits). area_resize() takes
each output cell's mean from an integral image, with fractions of cells at its borders. tiles() gives NPY bytes and a
64-bit difference hash for each tile. media_of_texts() stores texts losslessly as images and reads them back.

Null media has no row in tiles(); media that isn't an image of these formats (sides of 0, samples missing or above the
largest value included) gives one row with the reason. Null text counts as empty. A text of n bytes is padded with bytes 0
to a positive multiple of 64. Equal texts give equal values, so repeated rows give equal rows. Very long texts are taken
whole, alone in their batch; resizing holds slabs of SLAB rows. Nothing is ranked, so
there are no ties. An empty table gives an empty result. Other columns are not
read and may have any name.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, map_texts, spark_schema, with_release

WIDTH = 64
#: Rows of an image that are summed at once.
SLAB = 1 << 14
#: Sides of a tile, and what images are resized to before they are cut.
TILE, RESIZED = 32, (64, 64)


def _header(data: bytes, n: int) -> tuple[list[int], int]:
    """n numbers behind the magic of a Netpbm file, and where the samples begin; # starts a comment."""
    out, i = [], 2
    while len(out) < n:
        while data[i : i + 1].isspace():
            i += 1
        if data[i : i + 1] == b"#":
            i = data.index(b"\n", i) + 1
            continue
        j = i
        while data[j : j + 1].isdigit():
            j += 1
        if j == i:
            raise ValueError("a Netpbm header needs a number here")
        out.append(int(data[i:j]))
        i = j
    return out, i + 1


def _checked(w: int, h: int, samples: int, there: int) -> None:
    if w <= 0 or h <= 0:
        raise ValueError("an image has sides of at least 1")
    if samples > there:
        raise ValueError(f"{samples} samples or bytes needed, {there} there")


def decode_netpbm(data: bytes) -> np.ndarray:
    """H x W (bitmap, grey) or H x W x 3 array; bitmaps have 1 for black."""
    if data[:1] != b"P" or data[1:2] not in b"123456" or len(data) < 2:
        raise ValueError("not a Netpbm file")
    kind = data[1] - 48
    numbers, at = _header(data, 2 if kind in (1, 4) else 3)
    w, h = numbers[:2]
    top = 1 if kind in (1, 4) else numbers[2]
    if not 0 < top < 1 << 16:
        raise ValueError("the largest value is from 1 to 65535")
    channels = 3 if kind in (3, 6) else 1
    n, there = w * h * channels, len(data) - at
    if kind == 1:
        flat = np.frombuffer(bytes(c for c in data[at - 1 :] if c in b"01"), np.uint8) - 48
        _checked(w, h, n, len(flat))
        flat = flat[:n]
    elif kind == 4:
        row = (w + 7) // 8
        _checked(w, h, row * h, there)
        flat = np.unpackbits(np.frombuffer(data, np.uint8, row * h, at).reshape(h, row), axis=1)[:, :w].ravel()
    elif kind in (2, 3):
        words = data[at:].split()
        _checked(w, h, n, len(words))
        if any(not x.isdigit() or len(x.lstrip(b"0")) > 5 or int(x) > top for x in words[:n]):
            raise ValueError(f"samples are numbers from 0 to {top}")
        flat = np.array(words[:n], np.int64).astype(np.uint16 if top > 255 else np.uint8)
    else:
        _checked(w, h, n * (2 if top > 255 else 1), there)
        flat = np.frombuffer(data, ">u2" if top > 255 else np.uint8, n, at)
    return flat.reshape((h, w, 3) if channels == 3 else (h, w))


def decode_bmp(data: bytes) -> np.ndarray:
    """H x W (8 bits, its palette applied unless it is the grey ramp) or H x W x 3 in RGB order."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP file")
    start, size, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed or bits not in (8, 24, 32):
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits")
    row = (w * bits // 8 + 3) // 4 * 4
    _checked(w, abs(h), row * abs(h), len(data) - start)
    rows = np.frombuffer(data, np.uint8, row * abs(h), start).reshape(abs(h), row)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        _checked(w, abs(h), used * 4, len(data) - 14 - size)
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(-1, 4)
        if rows.max() >= used:
            raise ValueError("a sample is behind the palette's end")
        ramp = used == 256 and all((palette[:, i] == np.arange(256)).all() for i in range(3))
        return rows if ramp else palette[:, 2::-1][rows]
    return rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_netpbm(image: np.ndarray) -> bytes:
    """P5 or P6 with 255 as the largest value."""
    return b"P%d\n%d %d\n255\n" % (6 if image.ndim == 3 else 5, image.shape[1], image.shape[0]) + image.tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """8-bit BMP with the grey ramp as palette, rows from the bottom up."""
    h, w = image.shape
    row = (w + 3) // 4 * 4
    rows = np.zeros((h, row), np.uint8)
    rows[:, :w] = image[::-1]
    ramp = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy()
    ramp[:, 3] = 0
    start = 14 + 40 + 1024
    head = b"BM" + struct.pack("<IHHI", start + rows.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, rows.size, 2835, 2835, 256, 256)
    return head + ramp.tobytes() + rows.tobytes()


def grey(image: np.ndarray) -> np.ndarray:
    """Mean of the channels as floats."""
    return image.mean(axis=2) if image.ndim == 3 else image.astype(np.float64)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area that each output cell covers, from the integral image; cells may cover fractions of pixels. Of the
    integral image only the rows at cell borders are kept; it is summed in slabs of SLAB rows."""
    h, w = image.shape

    def at(n: int, out: int) -> tuple[np.ndarray, np.ndarray]:
        edge = np.arange(out + 1) * (n / out)
        low = np.minimum(edge.astype(np.int64), n - 1)
        return low, edge - low

    (y, fy), (x, fx) = at(h, height), at(w, width)
    wanted = np.unique(np.concatenate([y, y + 1]))
    total, sums = np.zeros((len(wanted), w + 1)), np.zeros(w)
    for i in range(0, h, SLAB):
        slab = np.cumsum(image[i : i + SLAB], axis=0, dtype=np.float64) + sums
        sums = slab[-1]
        here = (wanted > i) & (wanted <= i + len(slab))
        total[here, 1:] = np.cumsum(slab[wanted[here] - i - 1], axis=1)
    rows = total[np.searchsorted(wanted, y)] * (1 - fy)[:, None] + total[np.searchsorted(wanted, y + 1)] * fy[:, None]
    corner = rows[:, x] * (1 - fx) + rows[:, x + 1] * fx
    return np.diff(np.diff(corner, axis=0), axis=1) / (h / height * w / width)


def difference_hash(image: np.ndarray) -> str:
    """16 hexadecimal digits: whether a cell of the 8 x 9 area mean is brighter than its left neighbour."""
    small = np.round(area_resize(grey(image), 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means rounded to the image's own kind of numbers, channel by channel."""
    channels = image[:, :, None] if image.ndim == 2 else image
    means = np.stack([area_resize(channels[:, :, c], height, width) for c in range(channels.shape[2])], axis=2)
    out = np.round(means).astype(image.dtype)
    return out[:, :, 0] if image.ndim == 2 else out


def tiles_of(image: np.ndarray, size: int = TILE, resize: tuple[int, int] | None = RESIZED) -> list[tuple[int, int, bytes, str]]:
    """tile_y, tile_x, NPY bytes and difference hash of each tile of an image."""
    if resize is not None:
        image = resized(image, *resize)
    starts = [(y, x) for y in range(0, image.shape[0], size) for x in range(0, image.shape[1], size)]
    return [(y, x, npy(t := image[y : y + size, x : x + size]), difference_hash(t)) for y, x in starts]


def tiles(df: DataFrame, id_col: str = "media_id", media_col: str = "media", size: int = TILE, resize: tuple[int, int] | None = RESIZED) -> DataFrame:
    """Each image, area-resized to `resize` (height, width; None keeps its size), as tiles of at most size x size: media_id,
    tile_y, tile_x, npy, dhash, ready to be written as a table. Bytes that can't be decoded give one row with the reason in
    `error` and nulls. Tiles cover the whole image; the last ones of a row or column may be smaller."""
    bound_batches(df.sparkSession)
    out = spark_schema("media_id bigint,tile_y int,tile_x int,npy binary,dhash string,error string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        for batch in with_release(batches):
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data is None:
                    continue
                try:
                    rows = [(key, *tile, None) for tile in tiles_of(decode(data), size, resize)]
                except (ValueError, IndexError, OverflowError, struct.error) as e:
                    rows = [(key, None, None, None, None, str(e) or type(e).__name__)]
                for i in range(0, len(rows), 256):
                    columns = zip(*rows[i : i + 256], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return df.select(F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{media_col}`")).mapInArrow(run, out)


def payload_of(text: bytes) -> bytes:
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def store(payload: bytes) -> bytes:
    """The payload as an image with WIDTH samples a row: colour where its rows come in threes, else BMP for an even number
    of rows and grey Netpbm for an odd one. The choice depends on the length alone."""
    samples = np.frombuffer(payload, np.uint8)
    rows = len(payload) // WIDTH
    if rows % 3 == 0:
        return encode_netpbm(samples.reshape(rows // 3, WIDTH, 3))
    grid = samples.reshape(rows, WIDTH)
    return encode_bmp(grid) if rows % 2 == 0 else encode_netpbm(grid)


def _encode(texts: list[bytes]) -> list:
    return [[len(t) for t in texts], [store(payload_of(t)) for t in texts]]


def _features(media: list[bytes]) -> list:
    """Columns of FEATURES: of the samples read back, of the stored form, of the image as a whole and of its tiles."""
    rows = []
    for m in media:
        image = decode(m)
        payload, cut = np.ascontiguousarray(image).tobytes(), tiles_of(image)
        digest = hashlib.sha256(b"".join(x for _, _, x, _ in cut)).hexdigest()
        whole = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        rows.append((*whole, len(m), hashlib.sha256(m).hexdigest(), difference_hash(image), len(cut), digest, ",".join(x for *_, x in cut)))
    return [list(c) for c in zip(*rows, strict=True)]


FEATURES = (
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "n_tiles long, tiles_sha256 string, tile_hashes string"
)


def _store_and_read(texts: list[bytes]) -> list:
    lengths, media = _encode(texts)
    return [lengths, *_features(media)]


def media_of_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text stored as an image."""
    return map_texts(df, _encode, "n_bytes long, media binary", id_col, text_col, as_bytes=True)


def media_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as an image, read the stored bytes back, resize them by area, cut NPY tiles: digests of the samples,
    the stored form and the tiles, the difference hashes of the whole image (feature) and of each tile."""
    return map_texts(df, _store_and_read, f"n_bytes long, {FEATURES}", id_col, text_col, as_bytes=True)
