"""TIFF media columns: walk image directories, decode strips and tiles, undo predictors, one row per page.

Read: both byte orders, 8-bit samples (1 to 4 a pixel, chunky), strips or tiles, compression none (1), LZW (5), deflate
(8, 32946) and PackBits (32773), predictors 1 and 2. Write: the same, grey or chunky samples.

Defined results: null or empty media, or bytes that are no TIFF, give one row with page null and an error; a damaged page
gives a row with its error and no pixels; other columns are carried along under their own names, but for those
named like the new ones, which are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernel as K

#: No compression read here makes more bytes of one (a deflate stream 1,032, an LZW code of 12 bits 4,096).
MOST_RATIO = 4096

# Fixed values of the format: tag numbers, and bytes per value of each field type.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES = 284, 317, 322, 323, 324, 325
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run >= 2:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + 1
        while j < n and j - i < 128 and not (j + 1 < n and data[j] == data[j + 1]):
            j += 1
        out += bytes((j - i - 1,)) + data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; widths grow one code early; 256 clears, 257 ends."""
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, out, width, before = list(base), bytearray(), 9, b""
    have, held = 0, 0
    for byte in data:
        held = (held << 8) | byte
        have += 8
        while have >= width:
            have -= width
            code = (held >> have) & ((1 << width) - 1)
            held &= (1 << have) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, width, before = list(base), 9, b""
                continue
            if not before:
                before = table[code]
                out += before
                continue
            if code > len(table):
                raise ValueError("LZW code beyond the table")
            entry = table[code] if code < len(table) else before + before[:1]
            out += entry
            table.append(before + entry[:1])
            before = entry
            width = min(12, (len(table) + 1).bit_length())
        if len(out) >= size:
            break
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, have, width = bytearray(), 0, 0, 9

    def put(code: int) -> None:
        nonlocal held, have
        held, have = (held << width) | code, have + width
        while have >= 8:
            have -= 8
            out.append((held >> have) & 255)
        held &= (1 << have) - 1

    put(256)
    codes = {bytes((i,)): i for i in range(256)}
    last, word = 258, b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in codes:
            word = longer
            continue
        put(codes[word])
        codes[longer] = last
        last += 1
        word = data[i : i + 1]
        if last == 4094:  # one code early, as the widths
            put(codes[word])
            put(256)
            codes = {bytes((i,)): i for i in range(256)}
            last, width, word = 258, 9, b""
        else:
            width = last.bit_length()
    if word:
        put(codes[word])
        last += 1
        width = min(12, last.bit_length())
    put(257)
    if have:
        out.append((held << (8 - have)) & 255)
    return bytes(out)


def unpack(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        out = data
    elif compression in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    elif compression == LZW:
        out = lzw_decode(data, size)
    elif compression == PACKBITS:
        out = packbits_decode(data, size)
    else:
        raise ValueError(f"compression {compression}")
    if len(out) < size:
        raise ValueError("a strip or tile is short")
    return out[:size]


def compress(data: bytes, compression: int) -> bytes:
    return {NONE: bytes, DEFLATE: lambda d: zlib.compress(d, 1), LZW: lzw_encode, PACKBITS: packbits_encode}[compression](data)


class Reader:
    def __init__(self, data: bytes):
        self.data = data
        if data[:4] == b"II*\0":
            self.order = "<"
        elif data[:4] == b"MM\0*":
            self.order = ">"
        else:
            raise ValueError("no TIFF")

    def directories(self):
        """Tag values of each directory in the chain; a loop in it is an error."""
        at, seen = struct.unpack_from(self.order + "I", self.data, 4)[0], set()
        while at:
            if at in seen:
                raise ValueError("directories go round")
            seen.add(at)
            n = struct.unpack_from(self.order + "H", self.data, at)[0]
            tags = {}
            for k in range(n):
                tag, kind, count = struct.unpack_from(self.order + "HHI", self.data, at + 2 + 12 * k)
                size = TYPE_BYTES.get(kind, 0) * count
                where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(self.order + "I", self.data, at + 10 + 12 * k)[0]
                code = {1: "B", 3: "H", 4: "I"}.get(kind)
                if code:
                    tags[tag] = struct.unpack_from(f"{self.order}{count}{code}", self.data, where)
            yield tags
            at = struct.unpack_from(self.order + "I", self.data, at + 2 + 12 * n)[0]

    def pixels(self, tags: dict) -> np.ndarray:
        one = lambda tag, default=None: tags.get(tag, (default,))[0]
        width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
        if any(b != 8 for b in tags.get(BITS, (1,))) or one(PLANAR, 1) != 1 or not width or height is None:
            raise ValueError("only chunky 8-bit samples are read")
        compression, predictor = one(COMPRESSION, 1), one(PREDICTOR, 1)
        if predictor not in (1, 2):
            raise ValueError(f"predictor {predictor}")
        tiled = TILE_AT in tags
        block_w, block_h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height) or 1)
        where, sizes = tags[TILE_AT if tiled else STRIP_AT], tags[TILE_BYTES if tiled else STRIP_BYTES]
        if not block_w or not block_h or -(-width // block_w) * -(-height // block_h) != len(where):
            raise ValueError("strips or tiles do not fit the size")
        if max(width, block_w) * max(height, block_h) * samples > MOST_RATIO * (sum(sizes) + 64) * (len(where) if tiled else 1):
            raise ValueError("the size is beyond what the stored bytes can hold")
        image = np.zeros((height, width, samples), dtype=np.uint8)
        across = -(-width // block_w)
        for k, (at, n) in enumerate(zip(where, sizes, strict=True)):
            y, x = k // across * block_h, k % across * block_w
            rows = block_h if tiled else min(block_h, height - y)
            block = np.frombuffer(unpack(self.data[at : at + n], compression, rows * block_w * samples), dtype=np.uint8).reshape(rows, block_w, samples)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=np.uint8)
            image[y : y + rows, x : x + block_w] = block[: height - y, : width - x]
        return image


def write(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows: int = 256, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A TIFF of 8-bit pages (height, width, samples); strips of `rows`, or tiles (height, width)."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 0))
    link = 4
    for image in pages:
        height, width, samples = image.shape
        h, w = tile or (min(rows, height) or 1, width)
        at, sizes = [], []
        for y in range(0, height, h):
            for x in range(0, width, w):
                block = image[y : y + h, x : x + w]
                if tile:
                    block = np.pad(block, ((0, h - block.shape[0]), (0, w - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros((block.shape[0], 1, samples), dtype=np.uint8))
                packed = compress(np.ascontiguousarray(block).tobytes(), compression)
                at.append(len(out))
                sizes.append(len(packed))
                out += packed
        entries = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if samples >= 3 else 1]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        entries += [(TILE_WIDTH, 4, [w]), (TILE_HEIGHT, 4, [h]), (TILE_AT, 4, at), (TILE_BYTES, 4, sizes)] if tile else [(ROWS_PER_STRIP, 4, [h]), (STRIP_AT, 4, at), (STRIP_BYTES, 4, sizes)]
        fields = []
        for tag, kind, values in sorted(entries):
            data = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(data) > 4:
                out += b"\0" * (len(out) % 2)
                data, where = struct.pack(order + "I", len(out)), data
                out += where
            fields.append(struct.pack(order + "HHI", tag, kind, len(values)) + data.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + b"".join(fields)
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def grey_pages(payload: bytes, width: int = 64, page_bytes: int = 1 << 20) -> list[np.ndarray]:
    """A payload (a multiple of width bytes) as grey pages of at most page_bytes."""
    return [np.frombuffer(payload[i : i + page_bytes], dtype=np.uint8).reshape(-1, width, 1) for i in range(0, len(payload), page_bytes)]


def feature(image: np.ndarray) -> str:
    """Size, mean, deviation, and a 64-bit average hash (cells of an 8 by 8 grid above their mean) of a page."""
    grey = image.mean(axis=2) if image.shape[2] > 1 else image[:, :, 0]
    h, w = grey.shape
    if not h or not w:
        return f"{w}x{h}"
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = grey.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)
    y, x = np.arange(9) * h // 8, np.arange(9) * w // 8
    y1, x1 = np.maximum(y[1:], np.minimum(y[:-1] + 1, h)), np.maximum(x[1:], np.minimum(x[:-1] + 1, w))
    y0, x0 = y1 - np.maximum(y1 - y[:-1], 1), x1 - np.maximum(x1 - x[:-1], 1)
    cells = (total[y1][:, x1] - total[y0][:, x1] - total[y1][:, x0] + total[y0][:, x0]) / ((y1 - y0)[:, None] * (x1 - x0)[None, :])
    bits = (cells > cells.mean()).reshape(-1)
    number = int("".join("1" if b else "0" for b in bits), 2)
    return f"{w}x{h}:{grey.mean():.3f}:{grey.std():.3f}:{number:016x}"


def read_pages(data: bytes | None):
    """(page, image, tags, error) of each page."""
    try:
        reader = Reader(data or b"")
        pages = enumerate(reader.directories())
        while True:
            try:
                page, tags = next(pages)
            except StopIteration:
                return
            try:
                yield page, reader.pixels(tags), tags, None
            except (ValueError, KeyError, struct.error, zlib.error, IndexError, TypeError, ZeroDivisionError, MemoryError, OverflowError) as e:
                yield page, None, tags, str(e)
    except (ValueError, struct.error, MemoryError, OverflowError) as e:
        yield None, None, {}, str(e)


PAGE = "page int, width int, height int, samples int, compression int, pixels binary, feature string, error string"


def decode(media: DataFrame, column: str = "media") -> DataFrame:
    """One row per page of each TIFF in a binary column, beside the other columns."""
    new = [c.split()[0] for c in PAGE.split(", ")]
    others = [c for c in media.columns if c != column and c not in new]

    def decoded(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = [(p, tags.get(WIDTH, (None,))[0], tags.get(HEIGHT, (None,))[0], tags.get(SAMPLES, (1,))[0] if tags else None, tags.get(COMPRESSION, (1,))[0] if tags else None, None if image is None else image.tobytes(), None if image is None else feature(image), error) for p, image, tags, error in read_pages(batch.column(column)[i].as_py())]
                kinds = [pa.int32()] * 5 + [pa.binary(), pa.string(), pa.string()]
                columns = [pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
                same = pa.array(np.full(len(rows), i))
                yield pa.RecordBatch.from_arrays([batch.column(c).take(same) for c in others] + columns, names=[*others, *new])

    schema = "".join(f"`{c}` {media.schema[c].dataType.simpleString()}, " for c in others)
    return media.select(*others, column).mapInArrow(K.lean(decoded), schema + PAGE)


def store_texts(docs: DataFrame, width: int = 64) -> DataFrame:
    """Each whole text as a TIFF, read back: digests of the bytes read and of the stored form."""
    from zlib import crc32

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_pages int"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]

    def stored(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = (text.as_py() or "").encode()
                payload = raw + b"\0" * (max(width, -(-len(raw) // width) * width) - len(raw))
                media = write(grey_pages(payload, width))
                read, features = [], []
                for _, image, _, error in read_pages(media):
                    if error:
                        raise ValueError(error)
                    read.append(image.tobytes())
                    features.append(feature(image))
                back = b"".join(read)
                rows.append((doc_id, len(raw), len(back), hashlib.sha256(back).hexdigest(), crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), ";".join(features), len(read)))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in schema.split(", ")]) if rows else pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], names=[c.split()[0] for c in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(K.lean(stored), schema)
