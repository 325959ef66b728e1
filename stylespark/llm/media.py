"""Media columns: Netpbm and BMP bytes to numpy arrays, area resize by integral images, NPY tiles, difference hashes.

All functions work on whole images in memory, one at a time; a document of n bytes makes an image of about n bytes. Tiles
are written as sheets: NPY files of the tiles of one batch, which the rows name by path and place.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stylespark.llm.common import opened, prepared, shared_dir, written

WIDTH = 64
TILE = 16
#: Rows whose images are made before they are handed on.
STORED_ROWS = 100
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, media_kind string, feature string, sheet string, place int"


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6. Bitmaps (1 is black) and graymaps give (height, width), pixmaps (height, width, 3); uint8, or uint16 for maxval above 255."""
    kind = data[:2]
    if not re.fullmatch(rb"P[1-6]", kind):
        raise ValueError("no Netpbm image")
    fields, at, need = [], 2, 2 if kind in (b"P1", b"P4") else 3
    while len(fields) < need:
        m = re.compile(rb"(?:\s+|#[^\n\r]*[\n\r])*(\d+)").match(data, at)
        if not m:
            raise ValueError("broken Netpbm header")
        fields.append(int(m[1]))
        at = m.end()
    width, height, top = *fields[:2], fields[2] if need == 3 else 1
    depth = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * depth
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\n\r]*", b"", data[at:])
        values = np.array([c - 48 for c in body if c in b"01"][:n] if kind == b"P1" else [int(x) for x in body.split()[:n]])
        out = values.astype(np.uint8 if top < 256 else np.uint16)
    elif kind == b"P4":
        stride = -(-width // 8)
        bits = np.frombuffer(data, np.uint8, stride * height, at + 1).reshape(height, stride)
        out = np.unpackbits(bits, axis=1)[:, :width].ravel()
    else:
        out = np.frombuffer(data, np.uint8 if top < 256 else ">u2", n, at + 1)
    if len(out) != n:
        raise ValueError("short Netpbm image")
    return out.reshape((height, width, 3) if depth == 3 else (height, width))


def encode_netpbm(image: np.ndarray) -> bytes:
    """(height, width) as P5, (height, width, 3) as P6, of 8 bits."""
    height, width = image.shape[:2]
    return b"%s\n%d %d\n255\n" % (b"P6" if image.ndim == 3 else b"P5", width, height) + image.astype(np.uint8, copy=False).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits: (height, width, 3) RGB, or (height, width) where the palette is gray."""
    if data[:2] != b"BM":
        raise ValueError("no BMP image")
    start, = struct.unpack_from("<I", data, 10)
    head, width, height, _, bits, packing = struct.unpack_from("<IiiHHI", data, 14)
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32) or (packing == 3 and bits != 32):
        raise ValueError("this kind of BMP is not read")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if height > 0:
        raw = raw[::-1]
    if bits >= 24:
        return raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]
    if bits == 8:
        index = raw[:, :width]
    else:
        per = 8 // bits
        index = (raw[:, :, None] >> np.arange(8 - bits, -1, -bits) & (1 << bits) - 1).reshape(rows, stride * per)[:, :width]
    used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.frombuffer(data, np.uint8, 4 * used, 14 + head).reshape(-1, 4)[:, 2::-1]
    return palette[index, 0] if (palette == palette[:, :1]).all() else palette[index]


def encode_bmp(image: np.ndarray) -> bytes:
    """(height, width) as 8 bits with a gray palette, (height, width, 3) as 24 bits."""
    height, width = image.shape[:2]
    bits = 24 if image.ndim == 3 else 8
    stride = (width * bits + 31) // 32 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * bits // 8] = (image[::-1, :, ::-1] if bits == 24 else image[::-1]).reshape(height, -1)
    palette = b"" if bits == 24 else np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(-1, 4).copy()
    if bits == 8:
        palette[:, 3] = 0
        palette = palette.tobytes()
    start = 54 + len(palette)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", start + rows.size, 0, 0, start, 40, width, height, 1, bits, 0, rows.size, 2835, 2835, 0, 0) + palette + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each cell's area, edges counted by their fractions, from one integral image; float64."""
    h, w = gray.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(gray, 0, dtype=np.float64), 1, out=total[1:, 1:])

    def at(table: np.ndarray, edges: np.ndarray, axis: int) -> np.ndarray:
        low = np.minimum(edges.astype(np.int64), table.shape[axis] - 2)
        part = edges - low
        part = part[:, None] if axis == 0 else part[None, :]
        return np.take(table, low, axis) * (1 - part) + np.take(table, low + 1, axis) * part

    ys, xs = np.linspace(0, h, height + 1), np.linspace(0, w, width + 1)
    corners = at(at(total, ys, 0), xs, 1)
    sums = corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]
    return sums / (h / height * (w / width))


def difference_hash(gray: np.ndarray) -> str:
    """64 bits as 16 hex digits: whether each cell of an 8 x 9 resize is darker than its right neighbour."""
    small = np.rint(area_resize(gray, 8, 9) * 256)  # so that rounding of sums doesn't decide ties
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def payload(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and them with zeros up to a positive multiple of WIDTH."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def stored(body: bytes) -> bytes:
    """A payload as a gray image WIDTH wide: BMP or Netpbm by its checksum."""
    return (encode_bmp if zlib.crc32(body) & 1 else encode_netpbm)(np.frombuffer(body, np.uint8).reshape(-1, WIDTH))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, STORED_ROWS):  # a payload and its image are held for a few rows only
            part = batch.slice(a, STORED_ROWS)
            n, media = [], []
            for t in part.column(1):
                size, body = payload(t.as_py())
                n.append(size)
                media.append(stored(body))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def _features(folder: str):
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, tiles, sheet = [], [], f"{folder}/{uuid.uuid4().hex}.npy"
            for k, n, cell in zip(*(batch.column(i) for i in range(3)), strict=True):
                media = cell.as_py()
                image = decode(media)
                body = image.astype(np.uint8, copy=False).tobytes()
                gray = image.mean(2) if image.ndim == 3 else image
                rows.append((k.as_py(), n.as_py(), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]), len(media), hashlib.sha256(media).hexdigest(), media[:2].decode(), difference_hash(gray), sheet, len(tiles)))
                tiles.append(np.rint(area_resize(gray, TILE, TILE)).astype(np.uint8))
            if tiles:
                with opened(sheet, "w") as out:
                    out.write(npy(np.stack(tiles)))
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in FEATURES.split(", ")])

    return run


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path = sheet = None
    for batch in batches:
        own = []
        for name, place in zip(batch.column("sheet").to_pylist(), batch.column("place").to_pylist(), strict=True):
            if name != path:
                with opened(name, "r") as file:
                    path, sheet = name, np.load(io.BytesIO(file.read()), allow_pickle=False)
            own.append(npy(sheet[place]))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.binary())], names=[*batch.schema.names, "tile"])


def text_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each text's bytes as an image WIDTH samples wide: doc_id, n_bytes, media."""
    prepared(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return written(rows.mapInArrow(_store, "doc_id long, n_bytes long, media binary"), "media")


def media_features(media: DataFrame) -> DataFrame:
    """Decode stored images (doc_id, n_bytes, media), give their digests and difference hashes, and write their tiles: each row names its sheet and its place there."""
    spark = prepared(media.sparkSession)
    return written(media.select("doc_id", "n_bytes", "media").mapInArrow(_features(shared_dir(spark, "tiles")), FEATURES), "features")


def with_tiles(features: DataFrame) -> DataFrame:
    """features with the tile (NPY bytes) that its sheet holds."""
    return features.mapInArrow(_tiles, f"{FEATURES}, tile binary")


def media_columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the texts as images and their tiles as NPY sheets in the shared folder, read both back and return what they hold.

    Null or empty texts are one row of zeros. Equal texts give equal values but for sheet and place. Repeated rows and null ids are
    kept; a very long text is one image, decoded whole; further columns are ignored; an empty table gives no rows. Images that can't
    be decoded raise.
    """
    return with_tiles(media_features(text_media(docs, doc_id, text)))
