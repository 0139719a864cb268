"""TIFF columns: images in binary columns, one row per page.

The reader walks the chain of image directories in either byte order, decodes uncompressed, PackBits, LZW and deflate
strips or tiles, undoes the horizontal and floating-point predictors, and gives the samples of each page row by row.
The writer stores 8-bit samples in strips or tiles.

Samples of 1, 2 and 4 bits become bytes.

Defined cases: a null, empty or malformed image gives one row with page 0 and an error; a faulty page gives a row with an
error and the pages before and behind it are kept; unknown compressions, other bit depths and truncated data are errors; a
directory chain that comes back to itself ends; an empty table gives no rows; columns of the input named like an output column are replaced.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shelfmark.llm.common import PIECE_BYTES, pieces

# Fixed numbers of the format: field types with their sizes, tags, compressions.
TYPE_FORMAT = {1: "B", 3: "H", 4: "I", 16: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}
CLEAR, END, FIRST = 256, 257, 258


class TiffError(ValueError):
    pass


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: str
    predictor: int
    pixels: bytes  # rows from the top, samples of a pixel together, little-endian


# -- compressions ----------------------------------------------------------------------------------------------------
def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more equal bytes as repeats, everything else as literals of at most 128 bytes."""
    if not data:
        return b""
    values = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    lengths = np.diff(np.append(starts, len(values)))
    out, at = bytearray(), 0

    def literals(stop):
        for i in range(at, stop, 128):
            part = data[i : min(i + 128, stop)]
            out.append(len(part) - 1)
            out.extend(part)

    for start, length in zip(starts[lengths > 2].tolist(), lengths[lengths > 2].tolist(), strict=True):
        literals(start)
        at = start + length
        while length > 0:
            run = min(length, 128)
            out.extend((257 - run if run > 1 else 0, data[start]))
            length -= run
    literals(len(data))
    return bytes(out)


def _lzw_codes(data: bytes) -> Iterator[int]:
    """Codes of 9 to 12 bits, high bit first; the width grows one code early, and returns to 9 after a clear code."""
    bits = int.from_bytes
    at, held, have, width, known = 0, 0, 0, 9, FIRST - 1
    while True:
        while have < width:
            if at >= len(data):
                return
            chunk = data[at : at + 4]
            held, have, at = (held << (8 * len(chunk))) | bits(chunk, "big"), have + 8 * len(chunk), at + 4
        have -= width
        code = held >> have
        held &= (1 << have) - 1
        yield code
        if code == CLEAR:
            width, known = 9, FIRST - 1  # the first code after a clear adds no entry
        elif code == END:
            return
        else:
            known += 1
            if known + 1 >= (1 << width) and width < 12:
                width += 1


def lzw_decode(data: bytes, size: int) -> bytes:
    out, length = [], 0
    table, last = [], b""
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    for code in _lzw_codes(data):
        if code == CLEAR:
            table, last = base.copy(), b""
            continue
        if code == END or length >= size:
            break
        if not table:
            table = base.copy()
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise TiffError(f"bad LZW code {code}")
        if last:
            table.append(last + entry[:1])
        out.append(entry)
        length += len(entry)
        last = entry
    return b"".join(out)[:size]


def lzw_encode(data: bytes) -> bytes:
    base = {bytes((i,)): i for i in range(256)}
    table, width, held, have, out = base.copy(), 9, 0, 0, bytearray()
    following = FIRST

    def put(code):
        nonlocal held, have
        held, have = (held << width) | code, have + width
        while have >= 8:
            have -= 8
            out.append(held >> have)
            held &= (1 << have) - 1

    put(CLEAR)
    last = b""
    for value in data:
        longer = last + bytes((value,))
        if longer in table:
            last = longer
            continue
        put(table[last])
        table[longer] = following
        following += 1
        if following + 1 > (1 << width) and width < 12:
            width += 1
        if following >= 4094:
            put(CLEAR)
            table, following, width = base.copy(), FIRST, 9
        last = longer[-1:]
    if last:
        put(table[last])
        following += 1
        if following + 1 > (1 << width) and width < 12:
            width += 1
    put(END)
    if have:
        out.append((held << (8 - have)) & 255)
    return bytes(out)


def inflate(data: bytes, size: int) -> bytes:
    try:
        return zlib.decompressobj().decompress(data, size)
    except zlib.error as error:
        raise TiffError(str(error)) from None


DECODERS = {NONE: lambda data, size: data[:size], LZW: lzw_decode, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: unpack_bits}
ENCODERS = {"none": (NONE, bytes), "lzw": (LZW, lzw_encode), "deflate": (DEFLATE, lambda d: zlib.compress(d, 6)), "packbits": (PACKBITS, pack_bits)}


# -- reading ---------------------------------------------------------------------------------------------------------
def _directory(data: bytes, order: str, at: int) -> tuple[int, int]:
    """Number of entries, and the place of the next directory."""
    if at + 2 > len(data):
        raise TiffError("directory outside the file")
    (n,) = struct.unpack_from(order + "H", data, at)
    if at + 6 + 12 * n > len(data):
        raise TiffError("truncated directory")
    return n, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _entries(data: bytes, order: str, at: int, n: int) -> dict:
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        code = TYPE_FORMAT.get(kind)
        if code is None:
            continue
        size, place = struct.calcsize(code) * count, at + 10 + 12 * i
        if size > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        if place + size > len(data):
            raise TiffError(f"values of tag {tag} outside the file")
        tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, place)
    return tags


def _unpack_bits(block: np.ndarray, bits: int, rows: int, columns: int, depth: int) -> np.ndarray:
    """Samples of 1, 2 or 4 bits, the highest first, as bytes; every row starts at a byte."""
    digits = np.unpackbits(block.reshape(rows, -1), axis=1)[:, : columns * depth * bits].reshape(rows, columns, depth, bits)
    return (digits << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=3, dtype=np.uint8)


def _undo_predictor(block: np.ndarray, predictor: int, order: str, bits: int, rows: int, columns: int, depth: int) -> np.ndarray:
    """Bytes of one strip or tile -> rows x columns x depth samples."""
    size = bits // 8
    if predictor == 3:
        # byte planes of a row, most significant first, differenced by samples
        planes = block.reshape(rows, size * columns, depth).cumsum(axis=1, dtype=np.uint8)
        planes = planes.reshape(rows, size, columns * depth)
        little = np.ascontiguousarray(planes[:, ::-1, :].transpose(0, 2, 1))
        return little.view(f"<u{size}").reshape(rows, columns, depth)
    values = block.view(f"{order}u{size}").reshape(rows, columns, depth).astype(f"<u{size}")
    return values.cumsum(axis=1, dtype=values.dtype) if predictor == 2 else values


def _page(data: bytes, order: str, tags: dict) -> Page:
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    bits, compression, predictor = one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if not width or not height or not samples:
        raise TiffError("no image size")
    if bits not in (1, 2, 4, 8, 16, 32, 64) or set(tags.get(BITS, (bits,))) != {bits}:
        raise TiffError(f"unsupported bits per sample {tags.get(BITS)}")
    if compression not in DECODERS:
        raise TiffError(f"unsupported compression {compression}")
    if predictor not in (1, 2, 3):
        raise TiffError(f"unsupported predictor {predictor}")
    if bits < 8 and predictor != 1:
        raise TiffError(f"predictor {predictor} of samples of {bits} bits")
    separate = one(PLANAR, 1) == 2 and samples > 1
    depth, planes = (1, samples) if separate else (samples, 1)
    if TILES in tags:
        across, down = one(TILE_WIDTH), one(TILE_HEIGHT)
        offsets, counts = tags[TILES], tags.get(TILE_BYTES)
    else:
        across, down = width, min(one(ROWS_PER_STRIP, height), height)
        offsets, counts = tags.get(STRIPS, ()), tags.get(STRIP_BYTES)
    if not across or not down:
        raise TiffError("empty strips or tiles")
    columns, rows = -(-width // across), -(-height // down)
    if counts is None and len(offsets) == 1 and compression == NONE:
        counts = (len(data) - offsets[0],)
    if counts is None or len(offsets) != len(counts) or len(offsets) < columns * rows * planes:
        raise TiffError("missing strips or tiles")
    size = max(1, bits // 8)
    if width * height * samples * bits > 1032 * len(data) * 64:  # no compression here packs more tightly
        raise TiffError("image size does not fit the data")
    image = np.zeros((height, width, samples), f"<u{size}")
    for i in range(columns * rows * planes):
        plane, place = divmod(i, columns * rows)
        top, left = place // columns * down, place % columns * across
        tall = down if TILES in tags else min(down, height - top)
        wanted = tall * -(-across * depth * bits // 8)  # a row ends with a whole byte
        if offsets[i] + counts[i] > len(data):
            raise TiffError("strip or tile outside the file")
        raw = DECODERS[compression](data[offsets[i] : offsets[i] + counts[i]], wanted)
        if len(raw) < wanted:
            raise TiffError("truncated strip or tile")
        block = np.frombuffer(raw, np.uint8)
        block = _unpack_bits(block, bits, tall, across, depth) if bits < 8 else _undo_predictor(block, predictor, order, bits, tall, across, depth)
        part = block[: height - top, : width - left]
        image[top : top + part.shape[0], left : left + part.shape[1], plane if separate else slice(None)] = part[:, :, 0] if separate else part
    return Page(width, height, samples, bits, NAMES[compression], predictor, image.tobytes())


FAULTS = (TiffError, struct.error, ValueError, MemoryError, OverflowError)


def _fault(error: Exception) -> TiffError:
    return TiffError(str(error) or type(error).__name__)


def read_pages(data: bytes | None) -> Iterator[Page | TiffError]:
    """The pages of an image. A faulty page is an error in its place and the walk goes on with the next directory; where
    the chain of directories itself breaks, the error is the last element."""
    try:
        if not data or len(data) < 8 or data[:4] not in (b"II*\0", b"MM\0*"):
            raise TiffError("not a TIFF image" if data else "no data")
        order = "<" if data[:2] == b"II" else ">"
        (at,) = struct.unpack_from(order + "I", data, 4)
        seen = set()
        if not at:
            raise TiffError("no directory")
        while at and at not in seen:
            seen.add(at)
            n, following = _directory(data, order, at)
            try:
                page = _page(data, order, _entries(data, order, at, n))
            except FAULTS as error:
                page = _fault(error)
            yield page
            at = following
    except FAULTS as error:
        yield _fault(error)


# -- writing ---------------------------------------------------------------------------------------------------------
def write_image(
    pages: list[np.ndarray], compression: str = "deflate", predictor: int = 1, strip_bytes: int = 1 << 16, tile: tuple[int, int] | None = None
) -> bytes:
    """An image file with a page for each array (height, width[, samples]) of unsigned integers, little-endian."""
    number, encode = ENCODERS[compression]
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for page in pages:
        values = page[:, :, None] if page.ndim == 2 else page
        height, width, samples = values.shape
        size = values.dtype.itemsize
        if tile:
            across, down = tile
            blocks = [np.pad(values[y : y + down, x : x + across], ((0, max(0, y + down - height)), (0, max(0, x + across - width)), (0, 0))) for y in range(0, height, down) for x in range(0, width, across)]
        else:
            across, down = width, max(1, strip_bytes // max(1, width * samples * size))
            blocks = [values[y : y + down] for y in range(0, height, down)]
        places, counts = [], []
        for block in blocks:
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
            elif predictor == 3:
                bytes_ = np.ascontiguousarray(block).view(np.uint8).reshape(block.shape[0], -1, size)[:, :, ::-1]
                planes = bytes_.transpose(0, 2, 1).reshape(block.shape[0], -1, samples)
                block = np.diff(planes, axis=1, prepend=np.zeros_like(planes[:, :1]))
            raw = encode(np.ascontiguousarray(block).tobytes())
            places.append(len(out))
            counts.append(len(raw))
            out += raw
        out += b"\0" * (len(out) % 2)
        entries = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8 * size] * samples), (COMPRESSION, 3, [number]), (PHOTOMETRIC, 3, [1])]
        entries += [] if tile else [(STRIPS, 4, places)]
        entries += [(SAMPLES, 3, [samples])] + ([] if tile else [(ROWS_PER_STRIP, 4, [down]), (STRIP_BYTES, 4, counts)]) + [(PREDICTOR, 3, [predictor])]
        entries += [(TILE_WIDTH, 4, [across]), (TILE_HEIGHT, 4, [down]), (TILES, 4, places), (TILE_BYTES, 4, counts)] if tile else []
        entries += [(SAMPLE_FORMAT, 3, [3 if predictor == 3 else 1] * samples)]
        rows = bytearray(struct.pack("<H", len(entries)))
        for tag, kind, numbers in entries:
            packed = struct.pack(f"<{len(numbers)}{TYPE_FORMAT[kind]}", *numbers)
            if len(packed) > 4:
                place, packed = len(out), packed + b"\0" * (len(packed) % 2)
                out += packed
                packed = struct.pack("<I", place)
            rows += struct.pack("<HHI", tag, kind, len(numbers)) + packed.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        link = len(out) + len(rows)
        out += rows + b"\0\0\0\0"
    return bytes(out)


# -- columns ---------------------------------------------------------------------------------------------------------
FIELDS = [("page", T.IntegerType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("samples", T.IntegerType()), ("bits", T.IntegerType())]
FIELDS += [("compression", T.StringType()), ("predictor", T.IntegerType()), ("feature", T.StringType()), ("pixels", T.BinaryType()), ("error", T.StringType())]


def feature(page: Page) -> str:
    """Size, mean, deviation and a 16-bin histogram of the samples."""
    values = np.frombuffer(page.pixels, f"<u{max(1, page.bits // 8)}")
    bins = np.bincount((values >> np.array(max(0, page.bits - 4), values.dtype)).astype(np.int64), minlength=16)
    shape = f"{page.width}x{page.height}x{page.samples}"
    return f"{shape};{values.mean(dtype=np.float64):.4f};{values.std(dtype=np.float64):.4f};{'.'.join(map(str, bins.tolist()))}"


def explode_pages(df: DataFrame, media: str = "media") -> DataFrame:
    """One row per page: the columns of ``df`` but ``media``, then page number, size, samples, feature and pixels."""
    names = [n for n, _ in FIELDS]
    kept = [c for c in df.columns if c.lower() not in names and c != media]
    schema = T.StructType([*df.select(*kept).schema.fields, *[T.StructField(n, t) for n, t in FIELDS]])
    new = pa.schema([("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("bits", pa.int32()), ("compression", pa.string()), ("predictor", pa.int32()), ("feature", pa.string()), ("pixels", pa.binary()), ("error", pa.string())])

    def rows_of(piece):
        """Runs of pages of one slice, bounded by their decoded bytes; a long page is a run of its own."""
        of, rows, held = [], [], 0
        for i, data in enumerate(piece.column(media).to_pylist()):
            for number, page in enumerate(read_pages(data)):
                of.append(i)
                if isinstance(page, TiffError):
                    rows.append((number, *[None] * 8, str(page)))
                else:
                    rows.append((number, page.width, page.height, page.samples, page.bits, page.compression, page.predictor, feature(page), page.pixels, None))
                    held += len(page.pixels)
                if held > PIECE_BYTES:
                    yield of, rows
                    of, rows, held = [], [], 0
        if rows:
            yield of, rows

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, media):
                for of, rows in rows_of(piece):
                    left = piece.select(kept).take(pa.array(of, pa.int64())) if kept else None
                    columns = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(new)]
                    yield pa.RecordBatch.from_arrays([*(left.columns if left else []), *columns], names=[*kept, *names])

    return df.select(*kept, media).mapInArrow(run, schema)
