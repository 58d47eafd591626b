"""TIFF as a media column: walk image directories, decode strips and tiles, emit one row for each page.

Reads both byte orders; strips and tiles; chunky and planar samples of 8, 16 or 32 bits and 1-bit bilevel;
compression none, PackBits, LZW (most significant bit first) and deflate (both codes); horizontal predictor.
The fixed values below are those of the TIFF 6.0 specification.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_rows, slices, texts_of

# Field types and their bytes, compression codes.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
LETTERS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
NONE, LZW, ADOBE_DEFLATE, DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: How many bytes one byte of a file can stand for, in any of the compressions: a header that claims more is damaged.
MOST_GROWTH = 4096
#: Stored bytes that one step of tiff_pages() decodes, about.
STEP_BYTES = 1 << 20


def inflate(data: bytes, most: int) -> bytes:
    """The first `most` bytes: what a strip or tile has beyond its pixels is never decoded."""
    out = zlib.decompressobj().decompress(data, most) if most else b""
    if len(out) < most:
        raise ValueError("deflated data end early")
    return out


def unpack_bits(data: bytes, most: int | None = None) -> bytes:
    """Stops after `most` bytes, if given."""
    out, i, n = bytearray(), 0, len(data)
    while i < n and (most is None or len(out) < most):
        c = data[i]
        if c < 128:
            out += data[i + 1 : i + 2 + c]
            i += c + 2
        elif c > 128:
            out += data[i + 1 : i + 2] * (257 - c)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        end = i + 1
        while end < n and end - i < 128 and not (end + 1 < n and data[end] == data[end + 1]):
            end += 1
        out.append(end - i - 1)
        out += data[i:end]
        i = end
    return bytes(out)


def lzw_decode(data: bytes, most: int | None = None) -> bytes:
    """Codes of 9 to 12 bits; the width grows one code early; 256 clears, 257 ends. Stops after `most` bytes, if given."""
    out, table, width, acc, bits, last = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        acc, bits = (acc << 8 | byte) & 0xFFFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits & ((1 << width) - 1)
        if code == 256:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code == 257:
            break
        if not table:
            raise ValueError("LZW data begin without a clear code")
        if code < len(table):
            word = table[code]
        elif code == len(table) and last:
            word = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        out += word
        if most is not None and len(out) >= most:
            break
        if last and len(table) < 4096:
            table.append(last + word[:1])
        last = word
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    acc, bits, out, width = 0, 0, bytearray(), 9
    table: dict[bytes, int] = {bytes((i,)): i for i in range(256)}
    size, word = 258, b""

    def put(code: int) -> None:
        nonlocal acc, bits
        acc, bits = acc << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits & 255)
        acc &= (1 << bits) - 1

    put(256)
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = size
        size += 1
        # The reader is one entry behind, and grows one code early.
        width = 9 if size - 1 < 511 else 10 if size - 1 < 1023 else 11 if size - 1 < 2047 else 12
        if size >= 4094:
            put(256)
            table, size, width = {bytes((i,)): i for i in range(256)}, 258, 9
        word = data[i : i + 1]
    if word:
        put(table[word])
        # The reader adds an entry for this code as well.
        size += 1
        width = 9 if size - 1 < 511 else 10 if size - 1 < 1023 else 11 if size - 1 < 2047 else 12
    put(257)
    if bits:
        out.append(acc << (8 - bits) & 255)
    return bytes(out)


def write_tiff(pixels: np.ndarray, compression: int = DEFLATE, predictor: int = 2, rows_per_strip: int = 64, tile: tuple[int, int] | None = None) -> bytes:
    """One page from rows x columns x samples of uint8; strips, or tiles of (rows, columns), multiples of 16."""
    height, width, samples = pixels.shape

    def stored(part: np.ndarray) -> bytes:
        if predictor == 2:
            part = part.copy()
            part[:, 1:] -= part[:, :-1].copy()
        raw = part.tobytes()
        return {NONE: bytes, LZW: lzw_encode, PACKBITS: pack_bits}.get(compression, lambda x: zlib.compress(x, 6))(raw)

    if tile:
        parts = []
        for y in range(0, height, tile[0]):
            for x in range(0, width, tile[1]):
                cell = np.zeros((*tile, samples), np.uint8)
                cut = pixels[y : y + tile[0], x : x + tile[1]]
                cell[: cut.shape[0], : cut.shape[1]] = cut
                parts.append(stored(cell))
    else:
        parts = [stored(pixels[y : y + rows_per_strip]) for y in range(0, height, rows_per_strip)]
    counts = [len(p) for p in parts]
    at, starts = 8, []
    for n in counts:
        starts.append(at)
        at += n + (n & 1)
    body = b"".join(p + b"\0" * (len(p) & 1) for p in parts)
    tags = [(256, 4, [width]), (257, 4, [height]), (258, 3, [8] * samples), (259, 3, [compression]), (262, 3, [2 if samples == 3 else 1]), (277, 3, [samples]), (284, 3, [1]), (317, 3, [predictor])]
    tags += [(322, 4, [tile[1]]), (323, 4, [tile[0]]), (324, 4, starts), (325, 4, counts)] if tile else [(273, 4, starts), (278, 4, [rows_per_strip]), (279, 4, counts)]
    tags.sort()
    extra, entries, more = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        data = struct.pack(f"<{len(values)}{LETTERS[kind]}", *values)
        if len(data) > 4:
            entries += struct.pack("<HHII", tag, kind, len(values), more + len(extra))
            extra += data + b"\0" * (len(data) & 1)
        else:
            entries += struct.pack("<HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", at) + body + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + extra


def _directories(data: bytes) -> Iterator[tuple[str, dict[int, list]]]:
    end = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if end is None:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(end + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("image directories form a loop")
        seen.add(at)
        n, tags = struct.unpack_from(end + "H", data, at)[0], {}
        for i in range(n):
            p = at + 2 + 12 * i
            tag, kind, count = struct.unpack_from(end + "HHI", data, p)
            size = SIZES.get(kind, 0) * count
            where = p + 8 if size <= 4 else struct.unpack_from(end + "I", data, p + 8)[0]
            if kind in LETTERS:
                if where + size > len(data):
                    raise ValueError("a field lies outside the file")
                tags[tag] = list(struct.unpack_from(f"{end}{count}{LETTERS[kind]}", data, where))
        yield end, tags
        at = struct.unpack_from(end + "I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, end: str, tags: dict[int, list]) -> dict:
    one = lambda tag, default=None: tags[tag][0] if tags.get(tag) else default
    width, height, samples, compression, predictor, planar = one(256), one(257), one(277, 1), one(259, 1), one(317, 1), one(284, 1)
    bits = tags.get(258) or [1]
    if not width or not height:
        raise ValueError("a page without width or height")
    if len(set(bits)) > 1 or bits[0] not in (1, 8, 16, 32):
        raise ValueError(f"unsupported bits per sample {bits}")
    if width * height * samples * bits[0] > 8 * MOST_GROWTH * len(data):
        raise ValueError("a page of more pixels than its file can hold")
    unpack = {NONE: lambda x, n: x, LZW: lzw_decode, ADOBE_DEFLATE: inflate, DEFLATE: inflate, PACKBITS: unpack_bits}.get(compression)
    if unpack is None:
        raise ValueError(f"unsupported compression {compression}")
    bits, planes, deep = bits[0], samples if planar == 2 else 1, 1 if planar == 2 else samples
    kind = np.dtype({1: "u1", 8: "u1", 16: end + "u2", 32: end + "u4"}[bits])
    out = np.zeros((height, width, samples), kind.newbyteorder("="))
    tiled = 324 in tags
    starts, counts = tags.get(324 if tiled else 273) or [], tags.get(325 if tiled else 279) or []
    w, h = (one(322), one(323)) if tiled else (width, min(one(278, height), height))
    across, down = -(-width // w), -(-height // h)
    if len(starts) < across * down * planes or len(counts) < len(starts):
        raise ValueError("strips or tiles are missing")
    for k in range(across * down * planes):
        plane, cell = divmod(k, across * down)
        y, x = cell // across * h, cell % across * w
        rows = h if tiled else min(h, height - y)
        line = -(-w * deep * bits // 8)
        raw = unpack(data[starts[k] : starts[k] + counts[k]], rows * line)
        if bits == 1:
            part = np.unpackbits(np.frombuffer(raw, "u1", rows * line).reshape(rows, line), axis=1)[:, : w * deep].reshape(rows, w, deep)
        else:
            part = np.frombuffer(raw, kind, rows * w * deep).reshape(rows, w, deep).astype(out.dtype)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=out.dtype)
        elif predictor != 1:
            raise ValueError(f"unsupported predictor {predictor}")
        part = part[: height - y, : width - x]
        out[y : y + part.shape[0], x : x + part.shape[1], plane : plane + deep] = part
    return {"width": width, "height": height, "samples": samples, "bits": bits, "compression": compression, "pixels": out.tobytes(), "feature": feature(out)}


def feature(pixels: np.ndarray) -> str:
    """Shape, least, greatest and mean value, and the shares of 16 value ranges in thousandths."""
    top = int(np.iinfo(pixels.dtype).max) + 1
    flat = pixels.reshape(-1)
    if not flat.size:
        return "0x0x0"
    bins = np.bincount((flat.astype(np.int64) * 16 // top).astype(np.int64), minlength=16) * 1000 // flat.size
    h, w, s = pixels.shape
    return f"{w}x{h}x{s} min={flat.min()} max={flat.max()} mean={int(flat.sum(dtype=np.int64)) * 1000 // flat.size} bins={','.join(map(str, bins))}"


def read_tiff(data: bytes) -> list[dict]:
    """The pages; ValueError where the file is damaged or of an unsupported kind."""
    try:
        return [_page(data, end, tags) for end, tags in _directories(data)]
    except (struct.error, zlib.error, IndexError, TypeError, KeyError, ZeroDivisionError) as e:
        raise ValueError(f"damaged TIFF: {e}") from e


_OUT = [("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("bits", pa.int32()), ("compression", pa.int32()), ("pixels", pa.binary()), ("feature", pa.string()), ("error", pa.string())]


def tiff_pages(files: DataFrame, media: str = "media") -> DataFrame:
    """One row for each page: the input's columns, then page (from 0), width, height, samples, bits, compression,
    pixels (rows x columns x samples, chunky), feature, error.

    A null, damaged or unsupported file gives one row with error set and the rest null; a file without pages gives
    none. Repeated rows: each counts. Empty table: no rows. An input column with one of the result names gives way to
    the result. No shuffle. Files are decoded STEP_BYTES of stored bytes at a time, or one by one.
    """
    names = {n for n, _ in _OUT}
    keep = [c for c in files.columns if c not in names or c == media]
    files = files.select(*[F.col(f"`{c}`") for c in keep])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema] + ["page int, width int, height int, samples int, bits int, compression int, pixels binary, feature string, error string"])
    place = keep.index(media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, media, STEP_BYTES):
                take, rows = [], []
                for i, data in enumerate(b.column(place).to_pylist()):
                    try:
                        if data is None:
                            raise ValueError("no file")
                        pages = [p | {"page": k} for k, p in enumerate(read_tiff(data))]
                    except ValueError as e:
                        pages = [{"error": str(e)}]
                    take += [i] * len(pages)
                    rows += pages
                kept = pa.Table.from_batches([b]).take(pa.array(take, pa.int64())).combine_chunks()
                cols = [kept.column(c).combine_chunks() if kept.num_rows else pa.array([], kept.schema.field(c).type) for c in range(kept.num_columns)]
                yield pa.RecordBatch.from_arrays(cols + [pa.array([r.get(n) for r in rows], t) for n, t in _OUT], keep + [n for n, _ in _OUT])

    return files.mapInArrow(run, schema)


def stored_as(rows: int) -> dict:
    """Compression, predictor and layout of a page of so many rows."""
    if rows <= 2:
        return {"compression": PACKBITS, "predictor": 1}
    if rows <= 4:
        return {"compression": LZW, "predictor": 2}
    if rows % 16 == 0:
        return {"compression": ADOBE_DEFLATE, "predictor": 2, "tile": (16, 32)}
    return {"compression": DEFLATE, "predictor": 2}


def text_tiffs(docs: DataFrame, row_bytes: int = 192, samples: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, media: each whole text as UTF-8, padded with spaces to a positive multiple of row_bytes, as
    one TIFF page of row_bytes / samples columns. How it is stored follows from its size alone, so equal texts have
    equal files, and every compression of the format is in use: PackBits in strips for the smallest, LZW in strips
    with predictor, deflate in tiles, and deflate in strips with predictor for the largest.

    Null text counts as empty; null doc_id stays null; repeated rows: a row each; empty table: no rows; other columns
    are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                texts = texts_of(b.column(1))
                media = []
                for x in texts:
                    rows = max(1, -(-len(x) // row_bytes))
                    media.append(write_tiff(np.frombuffer(x.ljust(rows * row_bytes, b" "), np.uint8).reshape(rows, row_bytes // samples, samples), **stored_as(rows)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return doc_rows(docs, text, doc_id).mapInArrow(run, "doc_id long, n_bytes long, media binary")
