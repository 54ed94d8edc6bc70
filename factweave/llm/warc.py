"""WARC archives in seekable Zstandard bundles.

A bundle is a chain of independent Zstandard frames, each of some records, closed by a skippable frame that lists the compressed and
the plain size of every frame (the public seekable format). An index maps each record identifier to its bundle, frame and the offset
of its record within the plain frame, so one record is read by decompressing one frame.

Payloads that repeat are stored once: of records with equal payloads of at least LEAST bytes that with the largest identifier is a
response, the others revisit it. Groups are found on digests, by an aggregation and a join of tables that Spark can split at a hot key; payloads are
shuffled once and bundled where they land.

Rows: a null payload counts as empty. Null identifiers are smaller than all others; in a group that has no identifier at all every row
is a response. Rows that repeat the response's identifier are responses as well. An empty table gives no bundle.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import text_or_empty, work_dir, written

LEAST = 1000
FRAME = 256 * 1024  # plain bytes after which a frame is closed
BUNDLE = 16 * 1024 * 1024  # compressed bytes after which a bundle is closed
LEVEL = 3
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # fixed values of the format

STORED = "bundle string, kind string, content binary, page_id long, frame int, offset long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


# --- records --------------------------------------------------------------------------------------------------------


def _clean(value) -> str:
    return "".join(" " if c in "\r\n\0" else c for c in str(value))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record. Of a revisit only headers are stored; both kinds name the digest and size of the full payload."""
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = b"" if revisit else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(plain: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers (names in lower case), block and end of the record at an offset."""
    split = plain.index(b"\r\n\r\n", at)
    version, *lines = plain[at:split].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    begin = split + 4
    end = begin + int(head["content-length"])
    if plain[end : end + 4] != b"\r\n\r\n":
        raise ValueError("a record without its end")
    return head, plain[begin:end], end + 4


# --- bundles --------------------------------------------------------------------------------------------------------


class Bundle:
    """Frames in the making; finish() closes them with their seek table."""

    def __init__(self, frame: int = FRAME):
        import zstandard

        self.press = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.limit, self.out, self.open, self.sizes = frame, bytearray(), bytearray(), []

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset of a record."""
        if self.open and len(self.open) + len(data) > self.limit:
            self.close()
        place = len(self.sizes), len(self.open)
        self.open += data
        return place

    def close(self) -> None:
        packed = self.press.compress(bytes(self.open))
        self.sizes.append((len(packed), len(self.open)))
        self.out += packed
        self.open = bytearray()

    def finish(self) -> bytes:
        if self.open:
            self.close()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return bytes(self.out) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """Offset, compressed and plain size of each frame, from the footer."""
    n, flags, magic = struct.unpack_from("<IBI", bundle, len(bundle) - 9)
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    wide = 12 if flags & 128 else 8
    first = len(bundle) - 9 - n * wide
    if struct.unpack_from("<II", bundle, first - 8) != (SKIPPABLE, n * wide + 9):
        raise ValueError("a damaged seek table")
    out, at = [], 0
    for k in range(n):
        packed, plain = struct.unpack_from("<II", bundle, first + k * wide)
        out.append((at, packed, plain))
        at += packed
    return out


def frame_of(bundle: bytes, number: int) -> bytes:
    import zstandard

    at, packed, plain = seek_table(bundle)[number]
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=plain)


def record_at(bundle: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its place in the index: only its frame is decompressed."""
    return parse(frame_of(bundle, frame), offset)[:2]


# --- tables ---------------------------------------------------------------------------------------------------------


def with_roles(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type and refers_to of every row."""
    payload = text_or_empty("html")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.cast("binary").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("payload_digest", F.sha1("payload"))
    seen = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n"))
    seen = written(seen.where("_n > 1").drop("_n"))
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    out = rows.join(seen, ["payload_digest", "payload_bytes"], "left").withColumn("_revisit", revisit)
    return out.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(F.col("_revisit"), "revisit").otherwise("response").alias("record_type"), F.when(F.col("_revisit"), F.col("_first")).alias("refers_to"))


def bundles(roles: DataFrame, frame: int = FRAME, bundle: int = BUNDLE) -> DataFrame:
    """Rows of kind "bundle" (name, content) and of kind "index" (name, page_id, frame, offset), made partition by partition."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        open_, index = Bundle(frame), []

        def closed() -> pd.DataFrame:
            content = open_.finish()
            name = hashlib.sha1(content).hexdigest()
            rows = [(name, "bundle", content, None, None, None)] + [(name, "index", None, *x) for x in index]
            return pd.DataFrame(rows, columns=["bundle", "kind", "content", "page_id", "frame", "offset"]).astype({"page_id": "Int64", "frame": "Int32", "offset": "Int64"})

        for batch in batches:
            for page_id, url, payload, digest, kind, refers_to in zip(*(batch[c] for c in ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to"))):
                number = None if pd.isna(page_id) else int(page_id)
                target = None if pd.isna(refers_to) else int(refers_to)
                place = open_.add(record(number, url, bytes(payload), digest, target, kind == "revisit"))
                index.append((number, *place))
                if len(open_.out) >= bundle:
                    yield closed()
                    open_, index = Bundle(frame), []
        if index:
            yield closed()

    # Identifiers as text: a column of longs with nulls would pass through floating point.
    safe = roles.withColumn("page_id", F.col("page_id").cast("string")).withColumn("refers_to", F.col("refers_to").cast("string"))
    return safe.mapInPandas(write, STORED)


def write_archives(pages: DataFrame, path: str | None = None, least: int = LEAST) -> str:
    """Write the bundles of a table of pages and their index below path (in the shared folder unless given)."""
    path = path or work_dir(pages.sparkSession)
    bundles(with_roles(pages, least)).write.partitionBy("kind").parquet(path)
    return path


def _number(raw: Column, at: int) -> Column:
    """The 32-bit number, least byte first, that begins at byte `at` (from 1) of a few bytes."""
    digits = F.hex(F.substring(raw, at, 4))
    return F.conv(F.concat(*[F.substring(digits, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("int")


def _frames(content: Column) -> Column:
    """Offset, compressed and plain size of each frame of a bundle, from its footer; only the footer goes to Python."""

    @F.pandas_udf("array<struct<at:int,packed:int,plain:int>>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[dict(zip(("at", "packed", "plain"), f)) for f in seek_table(bytes(x))] for x in batch], dtype=object)

    footer = F.substring(content, -9, 9)
    wide = F.when(F.hex(F.substring(footer, 5, 1)) >= "80", 12).otherwise(8)
    size = 8 + wide * _number(footer, 1) + 9
    return read(F.substring(content, -size, size))


def _cut(content: Column, frames: Column) -> Column:
    return F.transform(frames, lambda f: F.struct(f["plain"].alias("plain"), F.substring(content, f["at"] + 1, f["packed"]).alias("packed")))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of rows (plain, packed), a frame each: a batch for every frame."""
    import hashlib

    import zstandard

    unpack = zstandard.ZstdDecompressor()
    ident = lambda v: int(x) if v and (x := v.removeprefix("<urn:page:").removesuffix(">")) else None
    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    for batch in batches:
        for size, packed in zip(batch.column("plain"), batch.column("packed")):
            plain, at, rows = unpack.decompress(packed.as_py(), max_output_size=size.as_py()), 0, []
            while at < len(plain):
                head, block, at = parse(plain, at)
                digest, kind, n = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"], int(head["x-payload-length"])
                if kind == "response" and (len(block) != n or hashlib.sha1(block).hexdigest() != digest):
                    raise ValueError("a payload differs from its digest")
                rows.append((ident(head["warc-record-id"]), head.get("warc-target-uri"), n, digest, kind, ident(head.get("warc-refers-to")), block))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def read_archives(spark, path: str) -> DataFrame:
    """Every record of the bundles below path, frame by frame; a response's payload is checked against its digest, a revisit's is empty."""
    stored = spark.read.schema(STORED).parquet(path).where("kind = 'bundle'")
    return stored.select(F.inline(_cut(F.col("content"), _frames(F.col("content"))))).mapInArrow(_parsed, RECORDS)


def read_index(spark, path: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(path).where("kind = 'index'").select("page_id", "bundle", "frame", "offset")


def look_up(spark, path: str, wanted: DataFrame) -> DataFrame:
    """page_id, headers and payload of the records named in wanted(page_id), each from its one frame. A bundle is sent once, and of it only the frames asked for go on."""
    places = read_index(spark, path).join(wanted.select("page_id").distinct(), "page_id")
    asked = places.groupBy("bundle", "frame").agg(F.collect_list(F.struct("page_id", "offset")).alias("records"))
    asked = asked.groupBy("bundle").agg(F.collect_list(F.struct("frame", "records")).alias("asked"))
    content = spark.read.schema(STORED).parquet(path).where("kind = 'bundle'").select("bundle", "content")
    held = content.join(asked, "bundle").withColumn("_f", _frames(F.col("content")))
    cut = F.transform("asked", lambda a: F.struct(F.get("_f", a["frame"])["plain"].alias("plain"), F.substring(F.col("content"), F.get("_f", a["frame"])["at"] + 1, F.get("_f", a["frame"])["packed"]).alias("packed"), a["records"].alias("records")))

    @F.pandas_udf("array<struct<page_id:bigint,headers:map<string,string>,payload:binary>>")
    def find(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for sizes, frames, records in batches:
            out = []
            for size, packed, asked in zip(sizes, frames, records):
                plain = unpack.decompress(bytes(packed), max_output_size=int(size))
                found = ((r["page_id"], *parse(plain, int(r["offset"]))[:2]) for r in asked)
                out.append([{"page_id": k, "headers": head, "payload": block} for k, head, block in found])
            yield pd.Series(out, dtype=object)

    return held.select(F.inline(cut)).select(F.inline(find("plain", "packed", "records")))
