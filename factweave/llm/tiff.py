"""TIFF columns: a reader that walks image directories and decodes PackBits, LZW or deflate strips and tiles, and a writer for it.

Reader: classic TIFF of either byte order, 8-bit samples, interleaved, one or more samples a pixel; compression 1 (none), 5 (LZW),
8 and 32946 (deflate), 32773 (PackBits); predictor 1 or 2; strips or tiles; any number of directories. One row per page.

Writer: lossless storage of any bytes as grey pixels, WIDTH to a row, a page for each PAGE bytes. Its layout follows from the bytes' CRC-32, so equal
bytes are stored alike, and a corpus passes through all decoders.

Rows: null content gives no page and a null error; content that is not a TIFF, or is damaged, gives no page and its error, never a failed task.
Repeated rows keep their pages each. Other columns pass through `keep`.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import carried

WIDTH = 64
PAGE = 1 << 20
STRIP_ROWS = 256
TILE = 64  # pixels a side

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CLEAR, STOP, FIRST, LAST = 256, 257, 258, 4094  # LZW codes; the table is cleared once LAST is given
TYPES = {1: "B", 2: "c", 3: "H", 4: "I"}

PAGES = "array<struct<page:int,width:int,height:int,samples:int,compression:int,predictor:int,tiled:boolean,pixels:binary>>"


# --- compressions ---------------------------------------------------------------------------------------------------


def packbits(row: bytes) -> bytes:
    """One row: runs of three or more as a count and a byte, all else as counted literals."""
    a = np.frombuffer(row, "u1")
    cuts = np.flatnonzero(np.diff(a)) + 1
    starts = np.concatenate(([0], cuts, [len(a)])) if len(a) else np.array([0])
    sizes = np.diff(starts)
    out, literal = bytearray(), 0  # literal: where the literals not written yet begin

    def flush(upto: int) -> None:
        for i in range(literal, upto, 128):
            piece = row[i : min(i + 128, upto)]
            out.append(len(piece) - 1)
            out.extend(piece)

    for k in np.flatnonzero(sizes > 2).tolist():
        begin, size = int(starts[k]), int(sizes[k])
        flush(begin)
        while size > 1:
            n = min(size, 128)
            out.extend((257 - n & 255, row[begin]))
            begin, size = begin + n, size - n
        literal = begin
    flush(len(row))
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while len(out) < size and i < n:
        k = data[i]
        if k < 128:
            out += data[i + 1 : i + 2 + k]
            i += k + 2
        elif k > 128:
            out += data[i + 1 : i + 2] * (257 - k)
            i += 2
        else:
            i += 1
    return bytes(out)


def _widths(n: int) -> np.ndarray:
    """Bits of each of the n codes after a clear code: one more once the table, an entry behind, fills all codes but one."""
    k = np.arange(n) + FIRST - 1  # entries when code number k is read
    return 9 + (k >= 511).astype("int64") + (k >= 1023) + (k >= 2047)


def lzw(data: bytes) -> bytes:
    groups: list[list[int]] = []
    i = 0
    while i < len(data) or not groups:
        codes, table, free = [], {}, FIRST
        if i < len(data):
            held = data[i]
            i += 1
            while i < len(data):
                key = held << 8 | data[i]
                found = table.get(key)
                if found is None:
                    codes.append(held)
                    table[key] = free
                    free += 1
                    if free == LAST:
                        break
                    held = data[i]
                else:
                    held = found
                i += 1
            if free != LAST:
                codes.append(held)
        groups.append(codes)
    values, widths = [CLEAR], [9]
    for n, codes in enumerate(groups):
        codes.append(STOP if n == len(groups) - 1 else CLEAR)
        values += codes
        widths += _widths(len(codes)).tolist()
    v, w = np.array(values), np.array(widths)
    first = np.cumsum(w) - w
    total = int(first[-1] + w[-1])
    shifted = v << (24 - w - first % 8)  # a code spans three bytes at most
    out = np.zeros((total + 7) // 8 + 3, "int64")
    for k in range(3):
        np.add.at(out, first // 8 + k, shifted >> (16 - 8 * k) & 255)
    return out[: (total + 7) // 8].astype("u1").tobytes()


_schedule = np.concatenate(([0], np.cumsum(_widths(4096))))


def unlzw(data: bytes) -> bytes:
    """Codes between two clear codes have widths that are known beforehand, so their values are read together."""
    raw = np.frombuffer(data + b"\0\0\0", "u1").astype("int64")
    bits, at, out = 8 * len(data), 0, []
    while at + 9 <= bits:
        n = int(np.searchsorted(_schedule, bits - at, "right")) - 1
        first = at + _schedule[:n]
        byte = first >> 3
        wide = _schedule[1 : n + 1] - _schedule[:n]
        codes = (raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]) >> (24 - wide - (first & 7)) & (1 << wide) - 1
        ends = np.flatnonzero((codes == CLEAR) | (codes == STOP))
        m = int(ends[0]) if len(ends) else n
        table = [bytes((b,)) for b in range(256)] + [b"", b""]
        last = b""
        for c in codes[:m].tolist():
            if c < len(table):
                entry = table[c]
                if last:
                    table.append(last + entry[:1])
            elif last and c == len(table):
                entry = last + last[:1]
                table.append(entry)
            else:
                raise ValueError("an LZW code beyond the table")
            out.append(entry)
            last = entry
        if m == n or codes[m] == STOP:
            break
        at += int(_schedule[m + 1])
    return b"".join(out)


def _unpack(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return unpackbits(data, size)
    if compression == LZW:
        return unlzw(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    raise ValueError(f"compression {compression} is not read")


# --- reader ---------------------------------------------------------------------------------------------------------


def directories(data: bytes) -> Iterator[dict[int, list]]:
    """Tags and values of each image directory, in the order of the chain; a chain that returns to a directory is an error."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    (at,), seen = struct.unpack_from(order + "I", data, 4), set()
    while at:
        if at in seen:
            raise ValueError("directories run in a circle")
        seen.add(at)
        (n,), tags = struct.unpack_from(order + "H", data, at), {}
        for k in range(n):
            entry = at + 2 + 12 * k
            tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
            if kind in TYPES:
                size = struct.calcsize(TYPES[kind]) * count
                place = entry + 8 if size <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
                if place + size > len(data):
                    raise ValueError("a value lies beyond the end")
                tags[tag] = list(struct.unpack_from(f"{order}{count}{TYPES[kind]}", data, place))
        yield tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def pages(data: bytes) -> Iterator[tuple]:
    """(page, width, height, samples, compression, predictor, tiled, pixels) of each directory."""
    for number, tags in enumerate(directories(data)):
        one = lambda tag, default=None, tags=tags: tags.get(tag, [default])[0]
        width, height, samples = one(256), one(257), one(277, 1)
        compression, predictor, tiled = one(259, NONE), one(317, 1), 322 in tags
        if not width or not height or set(tags.get(258, [1])) != {8} or one(284, 1) != 1 or predictor not in (1, 2):
            raise ValueError("a layout that is not read")
        if tiled:
            wide, high, places, sizes = one(322), one(323), tags[324], tags[325]
        else:
            wide, high, places, sizes = width, min(one(278, height), height), tags[273], tags[279]
        across, down = -(-width // wide), -(-height // high)
        if len(places) < across * down or len(sizes) < across * down:
            raise ValueError("a strip or tile is missing")
        image = np.zeros((down * high, across * wide, samples), "u1")
        for k in range(across * down):
            top, left = k // across * high, k % across * wide
            tall = high if tiled else min(high, height - top)
            need = tall * wide * samples
            raw = _unpack(data[places[k] : places[k] + sizes[k]], compression, need)
            if len(raw) < need:
                raise ValueError("a strip or tile is too short")
            block = np.frombuffer(raw, "u1", need).reshape(tall, wide, samples)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype="u1")
            image[top : top + tall, left : left + wide] = block
        yield number, width, height, samples, compression, predictor, tiled, image[:height, :width].tobytes()


# --- writer ---------------------------------------------------------------------------------------------------------


def tiff(payload: bytes, compression: int = DEFLATE, predictor: int = 1, tiled: bool = False, width: int = WIDTH, page: int = PAGE, order: str = "<") -> bytes:
    """Bytes whose number is a positive multiple of width, as one page or more of grey pixels."""
    if not payload or len(payload) % width:
        raise ValueError(f"bytes must fill rows of {width}")
    rows = np.frombuffer(payload, "u1").reshape(-1, width)
    per = max(1, page // width)
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4  # where the offset of the next directory goes
    for first in range(0, len(rows), per):
        image = rows[first : first + per]
        blocks = []
        if tiled:
            tall, wide = -(-len(image) // TILE) * TILE, -(-width // TILE) * TILE
            whole = np.zeros((tall, wide), "u1")
            whole[: len(image), :width] = image
            blocks = [whole[y : y + TILE, x : x + TILE] for y in range(0, tall, TILE) for x in range(0, wide, TILE)]
        else:
            blocks = [image[y : y + STRIP_ROWS] for y in range(0, len(image), STRIP_ROWS)]
        places, sizes = [], []
        for b in blocks:
            if predictor == 2:
                b = np.diff(b, axis=1, prepend=np.zeros((len(b), 1), "u1"))
            raw = np.ascontiguousarray(b).tobytes()
            if compression == PACKBITS:
                step = b.shape[1]
                raw = b"".join(packbits(raw[i : i + step]) for i in range(0, len(raw), step))
            elif compression == LZW:
                raw = lzw(raw)
            elif compression != NONE:
                raw = zlib.compress(raw, 1)
            places.append(len(out))
            sizes.append(len(raw))
            out += raw
        tags = {256: (4, [width]), 257: (4, [len(image)]), 258: (3, [8]), 259: (3, [compression]), 262: (3, [1]), 277: (3, [1]), 284: (3, [1]), 317: (3, [predictor])}
        tags |= {322: (3, [TILE]), 323: (3, [TILE]), 324: (4, places), 325: (4, sizes)} if tiled else {273: (4, places), 278: (4, [STRIP_ROWS]), 279: (4, sizes)}
        entries = b""
        for tag, (kind, values) in sorted(tags.items()):
            packed = struct.pack(f"{order}{len(values)}{TYPES[kind]}", *values)
            if len(packed) > 4:
                out += b"\0" * (len(out) % 2)
                packed, place = struct.pack(order + "I", len(out)), packed
                out += place
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def stored(payload: bytes) -> bytes:
    """The payload as a TIFF whose compression, predictor and tiling follow from its CRC-32."""
    k = zlib.crc32(payload)
    compression = (PACKBITS, LZW, DEFLATE)[k % 3]
    return tiff(payload, compression, 1 if compression == PACKBITS else 1 + k // 3 % 2, bool(k // 6 % 2))


# --- columns --------------------------------------------------------------------------------------------------------


def stored_column(payload: Column) -> Column:
    @F.pandas_udf("binary")
    def store(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if x is None else stored(bytes(x)) for x in batch], dtype=object)

    return store(payload)


def pages_column(content: Column) -> Column:
    """struct(pages, error) of a column of TIFF files: the pages before the damage, if there is any, and what it is. A null file has neither."""

    @F.pandas_udf(f"pages {PAGES}, error string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ["page", "width", "height", "samples", "compression", "predictor", "tiled", "pixels"]
        for batch in batches:
            rows = []
            for x in batch:
                found, error = [], None
                try:
                    for p in pages(bytes(x)) if x is not None else ():
                        found.append(dict(zip(names, p)))
                except (ValueError, IndexError, KeyError, TypeError, struct.error, zlib.error) as e:
                    error = f"{type(e).__name__}: {e}"
                rows.append((found, error))
            yield pd.DataFrame(rows, columns=["pages", "error"])

    return read(content)


def read_pages(files: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """One row per page: columns keep of files in a struct `file`, the page's own columns, and the error of its file. A file without pages has a row of nulls."""
    keep = [c for c in files.columns if c != content] if keep is None else keep
    held = files.select(F.struct(*keep).alias("file") if keep else F.lit(None).alias("file"), pages_column(F.col(content)).alias("_t"))
    return held.select("file", F.inline_outer("_t.pages"), F.col("_t.error").alias("error"))


def padded(text: Column) -> Column:
    """UTF-8 of a text with bytes 0 up to a positive multiple of 64."""
    raw = text.cast("binary")
    size = F.octet_length(text)
    wide = F.greatest(F.lit(64), F.ceil(size / 64).cast("int") * 64)
    return F.concat(raw, F.repeat(F.lit("\0"), wide - size).cast("binary"))


def media_features(docs: DataFrame, text: Column, keep: list[str] | None = None) -> DataFrame:
    """Stores every text as a TIFF, reads it back, and measures payload and pages: columns keep and the digests.

    feature: pages, then width x height, compression, predictor and tiling of the first, then the number of lit samples and the mean sample in thousandths.
    """
    row, columns = carried(keep, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    out = docs.select(row, text.alias("_text"))
    out = out.select("_row", F.octet_length("_text").cast("bigint").alias("n_bytes"), stored_column(padded(F.col("_text"))).alias("_media"))
    out = out.select("_row", "n_bytes", "_media", measured(F.col("_media")).alias("_m"))
    return out.select(*columns, "n_bytes", "_m.payload_bytes", "_m.payload_sha256", "_m.tail_crc32", F.octet_length("_media").cast("bigint").alias("media_bytes"), F.sha2("_media", 256).alias("media_sha256"), "_m.feature")


def measured(content: Column) -> Column:
    """Of each file, over the samples of all its pages in turn: number, SHA-256, CRC-32 of the last 64, and a feature string."""
    import hashlib

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for x in batch:
                found = list(pages(bytes(x)))
                payload = b"".join(p[-1] for p in found)
                _, width, height, _, compression, predictor, tiled, _ = found[0]
                samples = np.frombuffer(payload, "u1")
                mean = int(samples.sum(dtype="int64")) * 1000 // len(samples)
                feature = f"{len(found)}:{width}x{height}:{compression}:{predictor}:{int(tiled)}:{np.count_nonzero(samples)}:{mean}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), feature))
            yield pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "feature"])

    return measure(content)
