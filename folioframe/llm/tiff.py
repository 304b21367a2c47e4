"""TIFF columns: image directories to one row per page, and a lossless store of bytes as 8-bit samples.

The reader follows the chain of image directories of a classic TIFF of either byte order, decodes uncompressed,
PackBits, LZW and deflate strips or tiles, undoes the horizontal and the floating-point predictor, and puts
strips, tiles and planes together. Samples have 1, 2, 4 (one to a byte in the result), 8, 16, 32 or 64 bits. The writer
makes what the reader reads, for the round trip.

Defined results: a null or empty value has no pages; a page that cannot be read, for its damage or for a form that is not
among these, gives one row with ``error`` and its number, and the pages after it are read; a file that breaks off in a
directory gives such a row in its place; a page that claims more than its bytes can hold is an error, whatever its size,
and so is one beyond what a value of a row can hold; a chain of directories that meets itself ends; null keys and repeated
rows give pages like any other; an empty table gives an empty result; columns of other names are not carried along.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, spread, table

#: Fixed values of the TIFF 6.0 specification: tags, sizes of field types, and compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
FILL_ORDER = 266
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
TYPE_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
LZW_CLEAR, LZW_END = 256, 257
#: Bytes that a compressed byte can make at most, by scheme, and the bytes that a value of a row can hold.
EXPANDS = {NONE: 1, PACKBITS: 64, LZW: 2731, DEFLATE: 1033, OLD_DEFLATE: 1033}
VALUE_BYTES = (1 << 31) - (1 << 16)

#: Each byte with its bits the other way round, for files that begin bytes at the low bit.
TURNED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))

#: How documents are stored: samples in a row (payloads are padded to it), rows in a strip, rows in a page.
ROW_SAMPLES = 192
STRIP_ROWS = 16
PAGE_ROWS = 64
TILE = 64


class TiffError(ValueError):
    """A file that cannot be read as it claims to be."""


# -- compression -------------------------------------------------------------------------------------------------


def packbits_decode(data: bytes, size: int) -> bytes:
    """Runs and literals until ``size`` bytes are out."""
    out, at, end = bytearray(), 0, len(data)
    while at < end and len(out) < size:
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


_RUN = re.compile(rb"(.)\1{2,127}", re.S)


def packbits_encode(data: bytes) -> bytes:
    """Runs of three bytes or more as runs, the rest as literals."""
    out, at = bytearray(), 0

    def literal(chunk: bytes) -> None:
        for k in range(0, len(chunk), 128):
            part = chunk[k : k + 128]
            out.append(len(part) - 1)
            out.extend(part)

    for m in _RUN.finditer(data):
        literal(data[at : m.start()])
        out.append(257 - (m.end() - m.start()))
        out.append(m[1][0])
        at = m.end()
    literal(data[at:])
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, high bit first; the width grows one code early."""
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    words, out, got = list(start), [], 0
    bits = have = at = 0
    width, last, end = 9, b"", len(data)
    while got < size:
        while have < width:
            if at >= end:
                return b"".join(out)
            bits = (bits << 8 | data[at]) & 0xFFFFFF
            at += 1
            have += 8
        have -= width
        code = bits >> have & ((1 << width) - 1)
        if code == LZW_END:
            break
        if code == LZW_CLEAR:
            words, width, last = list(start), 9, b""
            continue
        if not last:
            if code > 255:
                raise TiffError("LZW code before its word")
            word = words[code]
        else:
            if code < len(words):
                word = words[code]
            elif code == len(words):
                word = last + last[:1]
            else:
                raise TiffError("LZW code before its word")
            words.append(last + word[:1])
            n = len(words)
            width = 9 if n < 511 else 10 if n < 1023 else 11 if n < 2047 else 12
        out.append(word)
        got += len(word)
        last = word
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """The codes that lzw_decode reads; the table is cleared before it is full."""
    start = {bytes([i]): i for i in range(256)}
    words, codes, widths = dict(start), [LZW_CLEAR], [9]
    word, width, free = b"", 9, 258
    for i in range(len(data)):
        more = word + data[i : i + 1]
        if more in words:
            word = more
            continue
        codes.append(words[word])
        widths.append(width)
        words[more] = free
        free += 1
        width = 9 if free < 512 else 10 if free < 1024 else 11 if free < 2048 else 12
        if free >= 4094:
            codes.append(LZW_CLEAR)
            widths.append(width)
            words, width, free = dict(start), 9, 258
        word = data[i : i + 1]
    if word:
        codes.append(words[word])
        widths.append(width)
        free += 1
        width = 9 if free < 512 else 10 if free < 1024 else 11 if free < 2048 else 12
    codes.append(LZW_END)
    widths.append(width)
    return packed(codes, widths)


def packed(codes: list[int], widths: list[int]) -> bytes:
    """Codes of given widths as bits, high bit first."""
    code, width = np.array(codes, np.int64), np.array(widths, np.int64)
    grid = (code[:, None] >> (width[:, None] - 1 - np.arange(12))) & 1
    keep = np.arange(12) < width[:, None]
    return np.packbits(grid[keep].astype(np.uint8)).tobytes()


def decompress(scheme: int, data: bytes, size: int) -> bytes:
    """At least ``size`` bytes of one strip or tile."""
    if scheme == NONE:
        out = data
    elif scheme == PACKBITS:
        out = packbits_decode(data, size)
    elif scheme == LZW:
        out = lzw_decode(data, size)
    elif scheme in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from None
    else:
        raise TiffError(f"compression {scheme}")
    if len(out) < size:
        raise TiffError("a strip or tile is too short")
    return out[:size]


def compress(scheme: int, data: bytes) -> bytes:
    return {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 3)}[scheme](data)


# -- reading -----------------------------------------------------------------------------------------------------


@dataclass
class Page:
    """One image; samples is rows x columns x samples in the file's sample type, byte order removed."""

    number: int
    width: int
    height: int
    bits: int
    samples_per_pixel: int
    compression: int
    predictor: int
    tiled: bool
    samples: np.ndarray


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and fields of each image directory in the order of the chain."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("no TIFF header")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        try:
            count = struct.unpack_from(order + "H", data, at)[0]
            fields = {}
            for k in range(count):
                tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
                if kind not in TYPE_CODES:
                    continue
                place = at + 2 + 12 * k + 8
                if TYPE_BYTES[kind] * n > 4:
                    place = struct.unpack_from(order + "I", data, place)[0]
                if n > len(data):
                    raise TiffError("a field is longer than the file")
                fields[tag] = struct.unpack_from(f"{order}{n}{TYPE_CODES[kind]}", data, place)
            at = struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]
        except struct.error:
            raise TiffError("the file breaks off in a directory") from None
        yield order, fields


def sample_type(order: str, bits: int, kind: int) -> np.dtype:
    letter = {1: "u", 2: "i", 3: "f"}.get(kind)
    if bits in (1, 2, 4) and kind == 1:
        return np.dtype("u1")
    if letter is None or bits not in (8, 16, 32, 64) or letter == "f" and bits < 16:
        raise TiffError(f"samples of {bits} bits, format {kind}")
    return np.dtype(f"{order}{letter}{bits // 8}")


def unpacked(raw: bytes, rows: int, across: int, bits: int) -> np.ndarray:
    """Samples of 1, 2 or 4 bits, rows of which begin at whole bytes, one to a byte."""
    each = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, -1), axis=1)[:, : across * bits].reshape(rows, across, bits)
    return each @ (1 << np.arange(bits - 1, -1, -1)).astype(np.uint8)


def unpredicted(block: np.ndarray, predictor: int, raw: bytes, dtype: np.dtype) -> np.ndarray:
    """Undo the predictor of a block of rows x columns x samples."""
    if predictor == 1:
        return block
    if predictor == 2:
        whole = block.view(block.dtype.str.replace("f", "u")).astype(f"=u{block.dtype.itemsize}")
        return np.cumsum(whole, axis=1, dtype=whole.dtype).view(block.dtype.newbyteorder("="))
    if predictor == 3 and dtype.kind == "f":
        rows, cols, n = block.shape
        flat = np.frombuffer(raw, np.uint8).reshape(rows, cols * dtype.itemsize, n)
        flat = np.cumsum(flat, axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, cols * n)
        return np.ascontiguousarray(flat.transpose(0, 2, 1)).view(f">f{dtype.itemsize}").reshape(rows, cols, n).astype(f"=f{dtype.itemsize}")
    raise TiffError(f"predictor {predictor}")


def page_of(data: bytes, number: int, order: str, f: dict[int, tuple]) -> Page:
    """Decode one directory's image."""
    one = lambda tag, default=None: f.get(tag, (default,))[0]
    width, height, n = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    if not width or not height or not n:
        raise TiffError("an image without size")
    bits = f.get(BITS, (1,))
    if len(set(bits)) != 1:
        raise TiffError("samples of different widths")
    dtype = sample_type(order, bits[0], one(SAMPLE_FORMAT, 1))
    whole = bits[0] >= 8
    scheme, predictor, separate = one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1) == 2
    tiled = TILE_OFFSETS in f
    if tiled:
        cols, rows, offsets, counts = one(TILE_WIDTH), one(TILE_HEIGHT), f[TILE_OFFSETS], f.get(TILE_BYTES, ())
    else:
        cols, rows, offsets, counts = width, min(one(ROWS_PER_STRIP, height), height), f.get(STRIP_OFFSETS, ()), f.get(STRIP_BYTES, ())
    if not cols or not rows:
        raise TiffError("tiles or strips without size")
    across, down, planes = -(-width // cols), -(-height // rows), n if separate else 1
    if min(len(offsets), len(counts)) < across * down * planes:
        raise TiffError("strips or tiles are missing")
    per = n // planes
    row_bytes = cols * per * dtype.itemsize if whole else -(-cols * per * bits[0] // 8)
    if max(width * height * n * dtype.itemsize, rows * row_bytes) > VALUE_BYTES:
        raise TiffError("a page larger than a value can be")
    if sum(min(c, len(data)) for c in counts[: across * down * planes]) * EXPANDS.get(scheme, 1) < width * height * n * bits[0] // 8:
        raise TiffError("a page larger than its bytes can make")
    low_first = one(FILL_ORDER, 1) == 2
    if one(FILL_ORDER, 1) not in (1, 2):
        raise TiffError(f"fill order {one(FILL_ORDER)}")
    if not whole and predictor != 1:
        raise TiffError(f"predictor {predictor} of samples of {bits[0]} bits")
    out = np.zeros((height, width, n), dtype.newbyteorder("="))
    for k in range(across * down * planes):
        plane, place = divmod(k, across * down)
        y, x = place // across * rows, place % across * cols
        tall = rows if tiled else min(rows, height - y)
        part = data[offsets[k] : offsets[k] + counts[k]]
        raw = decompress(scheme, part.translate(TURNED) if low_first else part, tall * row_bytes)
        block = np.frombuffer(raw, dtype) if whole else unpacked(raw, tall, cols * per, bits[0])
        block = unpredicted(block.reshape(tall, cols, per), predictor, raw, dtype)
        out[y : y + tall, x : x + cols, plane * per : (plane + 1) * per] = block[: height - y, : width - x]
    return Page(number, width, height, bits[0], n, scheme, predictor, tiled, out)


def pages_of(data: bytes) -> Iterator[Page]:
    """Every page of a file, in order; the first that cannot be read raises."""
    for found in pages_or_errors(data):
        if isinstance(found, TiffError):
            raise found
        yield found


def pages_or_errors(data: bytes) -> Iterator[Page | TiffError]:
    """Every page of a file, in order, or why it cannot be read; a broken directory is the last."""
    chain = enumerate(directories(data))
    while True:
        try:
            number, (order, fields) = next(chain)
        except StopIteration:
            return
        except TiffError as e:
            yield e
            return
        try:
            yield page_of(data, number, order, fields)
        except TiffError as e:
            yield e


# -- writing -----------------------------------------------------------------------------------------------------


def tiff_bytes(pages: list[np.ndarray], scheme: int, predictor: int = 1, tile: int = 0, strip_rows: int = STRIP_ROWS, order: str = "<", bits: int = 8) -> bytes:
    """A file with one directory for each page of rows x columns, whose samples have 8 bits or, without a predictor, 1, 2 or 4."""
    out = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        height, width = page.shape
        blocks = []
        if tile:
            for y in range(0, height, tile):
                for x in range(0, width, tile):
                    full = np.zeros((tile, tile), np.uint8)
                    part = page[y : y + tile, x : x + tile]
                    full[: part.shape[0], : part.shape[1]] = part
                    blocks.append(full)
        else:
            blocks = [page[y : y + strip_rows] for y in range(0, height, strip_rows)]
        places, lengths = [], []
        for block in blocks:
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), np.uint8))
            if bits < 8:
                block = np.packbits((block[:, :, None] >> np.arange(bits - 1, -1, -1) & 1).astype(np.uint8).reshape(len(block), -1), axis=1)
            made = compress(scheme, block.tobytes())
            places.append(len(out))
            lengths.append(len(made))
            out += made
        out += b"\0" * (len(out) % 2)

        def listed(values: list[int]) -> tuple[int, int, bytes]:
            nonlocal out
            body = struct.pack(f"{order}{len(values)}I", *values)
            if len(values) == 1:
                return 4, 1, body
            at = len(out)
            out += body
            return 4, len(values), struct.pack(order + "I", at)

        short = lambda v: (3, 1, struct.pack(order + "HH", v, 0))
        long = lambda v: (4, 1, struct.pack(order + "I", v))
        fields = {WIDTH: long(width), HEIGHT: long(height), BITS: short(bits), COMPRESSION: short(scheme), PHOTOMETRIC: short(1), SAMPLES: short(1), PREDICTOR: short(predictor)}
        if tile:
            fields |= {TILE_WIDTH: long(tile), TILE_HEIGHT: long(tile), TILE_OFFSETS: listed(places), TILE_BYTES: listed(lengths)}
        else:
            fields |= {ROWS_PER_STRIP: long(strip_rows), STRIP_OFFSETS: listed(places), STRIP_BYTES: listed(lengths)}
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields))
        for tag in sorted(fields):
            kind, n, value = fields[tag]
            out += struct.pack(order + "HHI", tag, kind, n) + value
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


# -- operators ---------------------------------------------------------------------------------------------------

PAGES_SCHEMA = "key bigint, page int, width int, height int, bits int, samples int, compression int, predictor int, tiled boolean, pixels binary, error string"


def tiff_pages(df: DataFrame, key: str, content: str) -> DataFrame:
    """One row per page of each TIFF: its shape and its decoded samples in the machine's byte order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("key", pa.int64()), *[(n, pa.int32()) for n in ("page", "width", "height", "bits", "samples", "compression", "predictor")], ("tiled", pa.bool_()), ("pixels", pa.binary()), ("error", pa.string())]
        )
        for b in batches:
            for key_value, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for n, p in enumerate(pages_or_errors(data) if data else ()):
                    row = (n, *[None] * 8, str(p)) if isinstance(p, TiffError) else (n, p.width, p.height, p.bits, p.samples_per_pixel, p.compression, p.predictor, p.tiled, p.samples.tobytes(), None)
                    rows = [(key_value, *row)]  # a page at a time: pages may be large
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    small_batches(df.sparkSession)
    return df.select(key, content).mapInArrow(run, PAGES_SCHEMA)


def stored(payload: bytes) -> bytes:
    """The payload as a TIFF; its checksum picks compression, predictor and layout, so equal payloads are stored alike."""
    pick = zlib.crc32(payload)
    scheme = (LZW, PACKBITS, DEFLATE, NONE)[pick & 3]
    predictor = 2 if pick & 8 and scheme in (LZW, DEFLATE) else 1
    tile = TILE if pick & 0x30 == 0 else 0
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW_SAMPLES)
    pages = [rows[k : k + PAGE_ROWS] for k in range(0, len(rows), PAGE_ROWS)]
    return tiff_bytes(pages, scheme, predictor, tile, order="<" if pick & 0x40 else ">")


def features(pages: list[Page], payload: bytes) -> str:
    """Pages, size, mean, deviation and entropy of the samples read back."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256).astype(np.float64)
    total = counts.sum()
    levels = np.arange(256)
    mean = float((counts * levels).sum() / total)
    spread = math.sqrt(max(float((counts * levels * levels).sum() / total) - mean * mean, 0.0))
    p = counts[counts > 0] / total
    first = pages[0]
    return (
        f"pages={len(pages)};width={first.width};height={sum(x.height for x in pages)};compression={first.compression};predictor={first.predictor};"
        f"tiled={int(first.tiled)};mean={mean:.4f};std={spread:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f}"
    )


OP1_SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with blanks to a positive multiple of a row, and their number before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (max(-(-len(raw) // ROW_SAMPLES), 1) * ROW_SAMPLES - len(raw)), len(raw)


def through_tiff(docs: DataFrame) -> DataFrame:
    """Store every text as a TIFF, read it back page by page, and describe what was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for text in b.column(1).to_pylist():
                payload, n = payload_of(text)
                media = stored(payload)
                pages = list(pages_of(media))
                back = b"".join(p.samples.tobytes() for p in pages)
                row = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(pages, back))
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [x.split()[0] for x in OP1_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=names)

    small_batches(docs.sparkSession)
    return spread(docs.select("doc_id", "text")).mapInArrow(run, OP1_SCHEMA)


def op1_tiff_pages(spark, sf_dir: str) -> DataFrame:
    """Every document through the TIFF store and back."""
    return through_tiff(table(spark, sf_dir, "documents"))
