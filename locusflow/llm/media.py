"""TIFF media columns: encode payloads as images, walk and decode them, one row per page.

The reader follows every image directory, decodes PackBits, LZW and deflate strips or tiles,
undoes the integer and floating-point predictors and returns the samples pixel by pixel.  Both byte
orders, samples of 1, 8, 16 or 32 bits and any count of them per pixel, interleaved or in planes, are
read.  A file that is damaged or of another form is a row with the reason.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the TIFF 6.0 format: tags, field types and compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
FILL_ORDER, SAMPLE_FORMAT = 266, 339
FIELD_TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CODEC_NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}
CLEAR, END = 256, 257

#: Pixels of 3 samples, 64 a row: 192 bytes, the unit payloads are padded to.
UNIT = 192
#: Rows of a page; longer payloads take several pages.
PAGE_ROWS = 256
#: Bytes of a decoded page, at most: what a directory may claim before it counts as damaged.
LARGEST_PAGE = 1 << 30
#: Rows of a strip, and the side of a tile.
STRIP_ROWS, TILE_SIDE = 32, 16


class BadTiff(ValueError):
    """The bytes are not a TIFF this reader can decode."""


# ---------------------------------------------------------------- codecs


def packbits(data: bytes) -> bytes:
    """Runs of three or more equal bytes become repeats; all else is literal."""
    values = np.frombuffer(data, np.uint8)
    if not len(values):
        return b""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    lengths = np.diff(np.append(starts, len(values)))
    out, literal = [], 0

    def flush(upto: int) -> None:
        for at in range(literal, upto, 128):
            part = data[at : min(at + 128, upto)]
            out.append(bytes([len(part) - 1]) + part)

    for run in np.flatnonzero(lengths >= 3).tolist():
        start, length = int(starts[run]), int(lengths[run])
        flush(start)
        for at in range(0, length, 128):
            n = min(128, length - at)
            out.append(bytes([257 - n if n > 1 else 0, data[start]]))
        literal = start + length
    flush(len(data))
    return b"".join(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, at, made = [], 0, 0
    while made < size and at < len(data):
        head = data[at]
        if head < 128:
            part, at = data[at + 1 : at + 2 + head], at + 2 + head
        elif head > 128:
            part, at = data[at + 1 : at + 2] * (257 - head), at + 2
        else:
            part, at = b"", at + 1
        out.append(part)
        made += len(part)
    return b"".join(out)


def _lzw_widths(codes: int) -> np.ndarray:
    """Bits of the 1st, 2nd, ... code behind a clear code: a code is added per code but the first."""
    table = 256 + np.arange(1, codes + 1)  # the entry made last before that code is written
    return np.where(table < 511, 9, np.where(table < 1023, 10, np.where(table < 2047, 11, 12)))


#: Codes between two clear codes at most, so that the table never passes 12 bits.
_FULL = 4094 - 258 + 1
_WIDTHS = _lzw_widths(_FULL + 2)
_ENDS = np.cumsum(_WIDTHS)


def lzw(data: bytes) -> bytes:
    codes: list[int] = []
    groups: list[list[int]] = []
    table: dict[int, int] = {}
    prefix, fresh = -1, 258
    for value in data:
        if prefix < 0:
            prefix = value
            continue
        key = prefix << 8 | value
        found = table.get(key)
        if found is not None:
            prefix = found
            continue
        codes.append(prefix)
        table[key] = fresh
        fresh += 1
        prefix = value
        if len(codes) == _FULL:
            groups.append([*codes, CLEAR])
            codes, table, fresh = [], {}, 258
    groups.append([*codes, *([prefix] if prefix >= 0 else []), END])
    bits = [_bits_of(np.array([CLEAR]), np.array([9]))]
    for group in groups:
        bits.append(_bits_of(np.array(group), _WIDTHS[: len(group)]))
    return np.packbits(np.concatenate(bits)).tobytes()


def _bits_of(codes: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The codes' bits, highest first, one per element."""
    wide = codes[:, None] >> np.arange(11, -1, -1) & 1
    return wide[np.arange(12) >= 12 - widths[:, None]].astype(np.uint8)


def unlzw(data: bytes, size: int) -> bytes:
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    words = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    total, at, out, made = 8 * len(data), 0, [], 0
    singles = [bytes([i]) for i in range(256)] + [b"", b""]
    while made < size and at + 9 <= total:
        first = int(words[at >> 3]) << (at & 7) >> 23 & 511
        if first == CLEAR:
            at += 9
            continue
        ends = at + _ENDS
        fit = int(np.searchsorted(ends, total, side="right"))
        starts, widths = ends[:fit] - _WIDTHS[:fit], _WIDTHS[:fit].astype(np.uint32)
        shift = 32 - (starts & 7).astype(np.uint32) - widths
        codes = words[starts >> 3] >> shift & ((np.uint32(1) << widths) - np.uint32(1))
        stop = np.flatnonzero((codes == CLEAR) | (codes == END))
        n = int(stop[0]) if len(stop) else fit
        entries, previous = singles.copy(), b""
        for code in codes[:n].tolist():
            if code < len(entries):
                entry = entries[code]
            elif code == len(entries) and previous:
                entry = previous + previous[:1]
            else:
                raise BadTiff("LZW code beyond the table")
            out.append(entry)
            made += len(entry)
            if previous:
                entries.append(previous + entry[:1])
            previous = entry
        if n == fit or codes[n] == END:
            break
        at = int(ends[n])
    return b"".join(out)


def encode(data: bytes, codec: int) -> bytes:
    if codec == DEFLATE:
        return zlib.compress(data, 1)
    return {NONE: bytes, PACKBITS: packbits, LZW: lzw}[codec](data)


def decode(data: bytes, codec: int, size: int) -> bytes:
    """``size`` bytes of samples from a strip or tile."""
    if codec in (DEFLATE, OLD_DEFLATE):
        try:
            found = zlib.decompressobj().decompress(data, size)  # no more than the strip holds
        except zlib.error as e:
            raise BadTiff(str(e)) from e
    elif codec == PACKBITS:
        found = unpackbits(data, size)
    elif codec == LZW:
        found = unlzw(data, size)
    elif codec == NONE:
        found = data
    else:
        raise BadTiff(f"compression {codec}")
    if len(found) < size:
        raise BadTiff("strip or tile is too short")
    return found[:size]


def difference(samples: np.ndarray) -> np.ndarray:
    """Horizontal differencing of (rows, width, samples per pixel)."""
    out = samples.copy()
    out[:, 1:] -= samples[:, :-1]
    return out


def undo_difference(samples: np.ndarray) -> np.ndarray:
    """Running sums of (rows, width, samples per pixel), modulo the samples' width."""
    return np.cumsum(samples, axis=1, dtype=samples.dtype)


def undo_float_difference(raw: np.ndarray, width: int, samples: int) -> np.ndarray:
    """Rows of 32-bit floats: bytes differenced at a pixel's stride, and split into planes, highest byte first."""
    rows = raw.shape[0]
    summed = np.cumsum(raw.reshape(rows, -1, samples), axis=1, dtype=np.uint8)
    planes = summed.reshape(rows, 4, width * samples).transpose(0, 2, 1)
    return np.ascontiguousarray(planes).view(">u4").reshape(rows, width, samples)


def _samples_of(raw: bytes, rows: int, width: int, samples: int, bits: int, predictor: int, order: str) -> np.ndarray:
    """(rows, width, samples) of a decoded strip or tile; one-bit samples are bytes 0 and 1."""
    lines = np.frombuffer(raw, np.uint8).reshape(rows, -1)
    if bits == 1:
        return np.unpackbits(lines, axis=1)[:, : width * samples].reshape(rows, width, samples)
    if predictor == 3:
        return undo_float_difference(lines, width, samples)
    found = np.frombuffer(raw, f"{order}u{bits // 8}").reshape(rows, width, samples)
    found = found.astype(f"=u{bits // 8}")
    return undo_difference(found) if predictor == 2 else found


# ---------------------------------------------------------------- writer


@dataclass(frozen=True)
class Layout:
    codec: int
    predictor: int
    tiled: bool


#: Forms a page is stored in, taken in turn by its index plus the number of its rows.
LAYOUTS = (
    Layout(PACKBITS, 1, False),
    Layout(DEFLATE, 2, False),
    Layout(LZW, 1, False),
    Layout(DEFLATE, 1, True),
    Layout(PACKBITS, 1, True),
    Layout(DEFLATE, 2, True),
)


def write_tiff(payload: bytes, page_rows: int = PAGE_ROWS, layouts: tuple[Layout, ...] = LAYOUTS) -> bytes:
    """A little-endian TIFF of 64 x n pixels of 3 samples; ``payload`` is a positive multiple of 192 bytes."""
    if not payload or len(payload) % UNIT:
        raise ValueError("payload must be a positive multiple of 192 bytes")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT // 3, 3)
    parts, at, link = [b"II*\0", b""], 8, 1
    for top in range(0, len(rows), page_rows):
        page = rows[top : top + page_rows]
        layout = layouts[(top // page_rows + len(page)) % len(layouts)]
        blocks = [encode(b, layout.codec) for b in _blocks(page, layout)]
        offsets = [at + sum(map(len, blocks[:i])) for i in range(len(blocks))]
        body = b"".join(blocks)
        body += b"\0" * (len(body) % 2)
        sizes = [len(b) for b in blocks]
        fields = [(WIDTH, 4, [page.shape[1]]), (HEIGHT, 4, [len(page)]), (BITS, 3, [8, 8, 8]), (COMPRESSION, 3, [layout.codec])]
        fields += [(PHOTOMETRIC, 3, [2]), (SAMPLES, 3, [3]), (PLANAR, 3, [1]), (PREDICTOR, 3, [layout.predictor])]
        if layout.tiled:
            fields += [(TILE_WIDTH, 4, [TILE_SIDE]), (TILE_HEIGHT, 4, [TILE_SIDE]), (TILE_OFFSETS, 4, offsets), (TILE_BYTES, 4, sizes)]
        else:
            fields += [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [STRIP_ROWS]), (STRIP_BYTES, 4, sizes)]
        directory_at = at + len(body)
        extra_at = directory_at + 2 + 12 * len(fields) + 4
        entries, extra = [], b""
        for tag, kind, values in sorted(fields):
            data = struct.pack(f"<{len(values)}{FIELD_TYPES[kind]}", *values)
            if len(data) > 4:
                place = struct.pack("<I", extra_at + len(extra))
                extra += data + b"\0" * (len(data) % 2)
            else:
                place = data.ljust(4, b"\0")
            entries.append(struct.pack("<HHI", tag, kind, len(values)) + place)
        parts[link] += struct.pack("<I", directory_at)
        parts += [body, struct.pack("<H", len(fields)) + b"".join(entries), extra]
        link = len(parts) - 2
        at = extra_at + len(extra)
    parts[link] += struct.pack("<I", 0)
    return b"".join(parts)


def _blocks(page: np.ndarray, layout: Layout) -> Iterator[bytes]:
    if layout.tiled:
        pad = -len(page) % TILE_SIDE
        padded = np.concatenate([page, np.zeros((pad, *page.shape[1:]), np.uint8)]) if pad else page
        for y in range(0, len(padded), TILE_SIDE):
            for x in range(0, page.shape[1], TILE_SIDE):
                tile = padded[y : y + TILE_SIDE, x : x + TILE_SIDE]
                yield (difference(tile) if layout.predictor == 2 else tile).tobytes()
    else:
        for y in range(0, len(page), STRIP_ROWS):
            strip = page[y : y + STRIP_ROWS]
            yield (difference(strip) if layout.predictor == 2 else strip).tobytes()


# ---------------------------------------------------------------- reader


@dataclass(frozen=True)
class Page:
    index: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    pixels: bytes


def read_pages(data: bytes) -> Iterator[Page]:
    """Walks the image directories of a TIFF and decodes each page."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise BadTiff("no TIFF header")
    at, seen, index = struct.unpack(order + "I", data[4:8])[0], set(), 0
    while at:
        if at in seen:
            raise BadTiff("directories form a ring")
        seen.add(at)
        try:
            fields, at = _directory(data, at, order)
        except struct.error as e:
            raise BadTiff("directory is cut off") from e
        yield _page(data, fields, index, order)
        index += 1


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple[int, ...]], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    fields = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        code = FIELD_TYPES.get(kind)
        if code is None:
            continue
        form = f"{order}{count}{code}"
        place = at + 10 + 12 * i
        if struct.calcsize(form) > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        fields[tag] = struct.unpack_from(form, data, place)
    (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return fields, following


def _page(data: bytes, fields: dict[int, tuple[int, ...]], index: int, order: str) -> Page:
    """Pixels in reading order, samples of a pixel together, little-endian."""

    def one(tag: int, default: int) -> int:
        return (fields.get(tag) or (default,))[0]

    tiled = TILE_OFFSETS in fields
    offsets = fields.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, ())
    sizes = fields.get(TILE_BYTES if tiled else STRIP_BYTES, ())
    width, height, samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    wide, high = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(height, one(ROWS_PER_STRIP, height)))
    bits, codec, predictor = one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if min(width, height, samples, wide, high) < 1:
        raise BadTiff("a size is missing or zero")
    if set(fields.get(BITS, (1,))) - {bits} or bits not in (1, 8, 16, 32) or one(FILL_ORDER, 1) != 1:
        raise BadTiff("only samples of 1, 8, 16 or 32 bits, highest bit first, are read")
    if predictor not in (1, 2, 3) or bits == 1 < predictor or (predictor == 3 and (bits, one(SAMPLE_FORMAT, 1)) != (32, 3)):
        raise BadTiff(f"predictor {predictor} on {bits} bits")
    planes = samples if one(PLANAR, 1) == 2 else 1
    each, stored = samples // planes, -(-bits // 8)
    across, down = -(-width // wide), -(-height // high)
    if max(width * height * samples, wide * high * each) * stored > LARGEST_PAGE:
        raise BadTiff("page is too large")
    if min(len(offsets), len(sizes)) < across * down * planes:
        raise BadTiff("strips or tiles are missing")
    out = np.zeros((height, width, samples), f"<u{stored}")
    for i in range(across * down * planes):
        plane, at = divmod(i, across * down)
        y, x = at // across * high, at % across * wide
        rows = high if tiled else min(high, height - y)
        line = -(-wide * each * bits // 8)
        raw = decode(data[offsets[i] : offsets[i] + sizes[i]], codec, rows * line)
        block = _samples_of(raw, rows, wide, each, bits, predictor, order)
        out[y : y + rows, x : x + wide, plane * each : (plane + 1) * each] = block[: height - y, : width - x]
    return Page(index, width, height, samples, bits, codec, predictor, tiled, out.tobytes())


# ---------------------------------------------------------------- operators


def padded(text: bytes) -> bytes:
    """The text and spaces up to a positive multiple of 192 bytes."""
    return text + b" " * (-len(text) % UNIT or (UNIT if not text else 0))


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (a TIFF of the padded text), one row per input row, in order.

    Null text counts as empty and gives one page of 192 spaces.  Null ids stay null, repeated rows
    stay, an empty table gives no rows, columns other than id and text are ignored.  Equal texts
    give equal bytes.  Nothing is shuffled.
    """
    from .common import rows_of, text_bytes

    def write(batches):
        for batch in batches:
            for part in _slices(batch):
                keys, texts = rows_of(part)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(keys, pa.int64()),
                        "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                        "media": pa.array([write_tiff(padded(t)) for t in texts], pa.binary()),
                    }
                )

    return text_bytes(docs, id_col, text_col).mapInArrow(write, "doc_id long, n_bytes long, media binary")


PAGE_SCHEMA = (
    "doc_id long, n_bytes long, media binary, page int, width int, height int, samples int, bits int, "
    "compression string, predictor int, tiled boolean, pixels binary, error string, first boolean"
)


def decode_pages(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", n_bytes_col: str | None = None) -> DataFrame:
    """One row per page of each TIFF, pages of a file in order and next to each other.

    ``first`` marks a file's first row, the only one that carries ``media``.  A null or unreadable file
    gives one row with page null and the reason in ``error``; pages before a damaged one are kept.  ``pixels`` are
    little-endian samples of ``bits`` each (one-bit samples: bytes 0 and 1).  Null ids stay null,
    repeated rows stay, an empty table gives no rows, other columns are ignored.
    """
    carried = F.col(n_bytes_col) if n_bytes_col else F.lit(None).cast("long")
    names = [f.split()[0] for f in PAGE_SCHEMA.split(", ")]
    rows = media.select(F.col(id_col).alias("doc_id"), carried.alias("n_bytes"), F.col(media_col).alias("media"))

    def walk(batches):
        for batch in batches:
            for part in _slices(batch, 128):
                out = []
                for key, n_bytes, data in zip(*(part.column(i).to_pylist() for i in range(3))):
                    first = True
                    try:
                        if data is None:
                            raise BadTiff("no media")
                        for p in read_pages(data):
                            form = (p.index, p.width, p.height, p.samples, p.bits, CODEC_NAMES[p.compression], p.predictor, p.tiled, p.pixels)
                            out.append((key, n_bytes, data if first else None, *form, None, first))
                            first = False
                    except BadTiff as e:
                        out.append((key, n_bytes, data if first else None, *[None] * 9, str(e), first))
                types = [pa.int64(), pa.int64(), pa.binary(), *[pa.int32()] * 5, pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    return rows.mapInArrow(walk, PAGE_SCHEMA)


def page_digests(pages: DataFrame) -> DataFrame:
    """Folds the neighbouring page rows of a file into one row of digests and a feature string.

    Reads :func:`decode_pages` as it streams by, so no payload is shuffled or held beyond a file.
    One row per file, null ones included: a null medium has payload_bytes 0, null media_bytes, digests
    and feature, and its reason in ``error``; of a damaged file the pages before the damage count.
    """
    from hashlib import sha256

    fields = ["doc_id", "n_bytes", "media", "page", "width", "height", "samples", "compression", "predictor", "tiled", "pixels", "error", "first"]

    def fold(batches):
        held = None
        for batch in batches:
            done = []
            for row in zip(*(batch.column(n).to_pylist() for n in fields)):
                row = dict(zip(fields, row))
                if row["first"]:
                    if held:
                        done.append(_digest(held))
                    held = [row]
                else:
                    held.append(row)
            yield _digested(done)
        yield _digested([_digest(held)] if held else [])

    def _digest(rows):
        payload, media = b"".join(r["pixels"] for r in rows if r["pixels"] is not None), rows[0]["media"]
        if media is None:
            return (rows[0]["doc_id"], rows[0]["n_bytes"], 0, *[None] * 5, rows[0]["error"])
        histogram = np.bincount(np.frombuffer(payload, np.uint8) >> 5, minlength=8).tolist()
        forms = [f"{r['width']}x{r['height']}x{r['samples']}:{r['compression']}{r['predictor']}{'t' if r['tiled'] else 's'}" for r in rows if r["page"] is not None]
        feature = f"pages={len(forms)};{','.join(forms)};sum={int(np.frombuffer(payload, np.uint8).sum(dtype=np.int64))};bins={','.join(map(str, histogram))}"
        errors = [r["error"] for r in rows if r["error"]]
        return (rows[0]["doc_id"], rows[0]["n_bytes"], len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), sha256(media).hexdigest(), feature, errors[0] if errors else None)

    def _digested(rows):
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    return pages.mapInArrow(fold, schema)
