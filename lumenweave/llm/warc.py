"""WARC records in ZIP-packaged archives: a writer and a reader that never extracts.

Each archive is a ZIP file with stored members: ``archive/data-*.warc.gz`` (one gzip member a record) and, last,
``indexes/index.cdxj`` (a line a record: member, offset and length of its gzip member). The central directory
always comes with the ZIP64 records. The reader opens an archive for random access, parses the end records and the
directory and reads the index by its range; the ranges of records, some ``RANGE_BYTES`` of neighbours at a time, are
then dealt evenly to tasks, each of which reads just its ranges of the file. Nothing is unpacked or read as a whole.

Spark's text writer lays the archives down, so they go wherever Spark can write and survive lost tasks; a row is a
stretch of the file and the line feed that the writer adds after it falls between members, where ZIP allows gaps,
or is the archive's comment of one byte. Archives in a store that only Spark can open come through its binary reader
instead, an archive (about ``ARCHIVE_BYTES``, 2 GB at most) at a time.

Defined results: a null html is an empty payload; payloads under ``min_revisit`` bytes are all responses; of equal
larger ones the largest page_id is the response and rows that repeat that id (ties) are responses too; rows without a
page_id are responses; very long pages make a member and a range of their own; rows that repeat many times are dealt
evenly to archives; an empty table gives an empty table; other columns are not read and may have any names.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.llm.shared import cut, new_path, slices, utf8

#: Payload bytes of an archive and of a member, before compression; bytes of records, as they are stored, that are read at once.
ARCHIVE_BYTES, MEMBER_BYTES, MIN_REVISIT, RANGE_BYTES = 32 << 20, 4 << 20, 1000, 1 << 20
#: One (page_id, payload) of more rows than these, and than a thousandth of all, is dealt evenly instead of by itself.
HOT_ROWS = 1000
#: Schemes of stores that are opened for random access.
RANGED = ("file", "hdfs", "s3", "gs")

#: The layouts of ZIP's records.
LOCAL, CENTRAL, END, END64, LOCATOR64 = struct.Struct("<4s5H3I2H"), struct.Struct("<4s6H3I5H2I"), struct.Struct("<4s4H2IH"), struct.Struct("<4sQ2H2I4Q"), struct.Struct("<4sIQI")
DOS_DATE = (2020 - 1980) << 9 | 1 << 5 | 1
FULL = 0xFFFFFFFF


# --- records -----------------------------------------------------------------------------------------------


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; a revisit has no payload of its own but names that payload's length and digest."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {uri}", "WARC-Date: 2020-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if len(block) != int(headers["content-length"]):
        raise ValueError("the record is cut short")
    return headers, block


def squeeze(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


# --- ZIP, written as a stream of rows ------------------------------------------------------------------------


class ZipRows:
    """Turns members into the rows of a text file; ``at`` is the offset of the next row."""

    def __init__(self) -> None:
        self.at, self.central = 0, []

    def member(self, name: str, data: bytes) -> bytes:
        raw, crc, big = name.encode(), zlib.crc32(data), len(data) >= FULL
        extra = struct.pack("<HH2Q", 1, 16, len(data), len(data)) if big else b""
        size = FULL if big else len(data)
        row = LOCAL.pack(b"PK\3\4", 45, 0x800, 0, 0, DOS_DATE, crc, size, size, len(raw), len(extra)) + raw + extra + data
        far = struct.pack("<HH3Q", 1, 24, len(data), len(data), self.at)
        self.central.append(CENTRAL.pack(b"PK\1\2", 45, 45, 0x800, 0, 0, DOS_DATE, crc, FULL, FULL, len(raw), len(far), 0, 0, 0, 0, FULL) + raw + far)
        self.at += len(row) + 1  # the writer's line feed
        return row

    def end(self) -> bytes:
        held, n = b"".join(self.central), len(self.central)
        end64 = END64.pack(b"PK\6\6", END64.size - 12, 45, 45, 0, 0, n, n, len(held), self.at)
        locator = LOCATOR64.pack(b"PK\6\7", 0, self.at + len(held), 1)
        return held + end64 + locator + END.pack(b"PK\5\6", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(len(held), FULL), FULL, 1)


def pack_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, url, html, digest, refers_to) of a partition to the rows of one archive."""
    rows, member, index, size, n = ZipRows(), [], [], 0, 0
    out = lambda row: pa.RecordBatch.from_pydict({"row": pa.array([row], pa.binary())})
    name = lambda: f"archive/data-{n:05d}.warc.gz"
    at = 0
    for batch in batches:
        for part in slices(batch):
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in part.columns)):
                payload = html.encode("utf-8", "surrogatepass")
                gz = squeeze(record(page_id, url, payload, digest, refers_to))
                index.append(json.dumps({"id": page_id, "member": name(), "offset": at, "length": len(gz)}))
                member.append(gz)
                at += len(gz)
                size += len(payload)
                if size >= MEMBER_BYTES:
                    yield out(rows.member(name(), b"".join(member)))
                    member, size, at, n = [], 0, 0, n + 1
    if member:
        yield out(rows.member(name(), b"".join(member)))
    if index:
        yield out(rows.member("indexes/index.cdxj", "\n".join(index).encode()))
        yield out(rows.end())


# --- ZIP, read by ranges -------------------------------------------------------------------------------------

ReadRange = Callable[[int, int], bytes]


def central_directory(read: ReadRange, size: int) -> dict[str, tuple[int, int]]:
    """Of each stored member, the offset of its local header and its size."""
    # A comment of up to 64 KB may follow the end record; most archives have a short one or none.
    for reach in (1 << 10, END.size + 0xFFFF + LOCATOR64.size):
        tail = read(max(0, size - reach), min(size, reach))
        end_at = tail.rfind(b"PK\5\6")
        while end_at >= 0 and end_at + END.size + int.from_bytes(tail[end_at + 20 : end_at + 22], "little") != len(tail):
            end_at = tail.rfind(b"PK\5\6", 0, end_at)
        if end_at >= LOCATOR64.size:
            break
    if end_at < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, n, length, at, _ = END.unpack_from(tail, end_at)
    if end_at >= LOCATOR64.size and tail[end_at - LOCATOR64.size :][:4] == b"PK\6\7":
        where = LOCATOR64.unpack_from(tail, end_at - LOCATOR64.size)[2]
        *_, n, length, at = END64.unpack(read(where, END64.size))
    held, p, found = read(at, length), 0, {}
    for _ in range(n):
        sig, _, _, _, method, _, _, _, stored, full, name_n, extra_n, comment_n, _, _, _, local = CENTRAL.unpack_from(held, p)
        if sig != b"PK\1\2":
            raise ValueError("broken central directory")
        p += CENTRAL.size
        name, extra = held[p : p + name_n].decode(), held[p + name_n : p + name_n + extra_n]
        p += name_n + extra_n + comment_n
        q = 0
        while q + 4 <= len(extra):
            tag, length_q = struct.unpack_from("<HH", extra, q)
            if tag == 1:
                wide = iter(struct.unpack_from(f"<{length_q // 8}Q", extra, q + 4))
                full = next(wide) if full == FULL else full
                stored = next(wide) if stored == FULL else stored
                local = next(wide) if local == FULL else local
            q += 4 + length_q
        if method == 0:
            found[name] = (local, stored)
    return found


def data_at(read: ReadRange, local: int) -> int:
    """Where the data of the member with this local header begin."""
    head = LOCAL.unpack(read(local, LOCAL.size))
    if head[0] != b"PK\3\4":
        raise ValueError("no local header")
    return local + LOCAL.size + head[-2] + head[-1]


def record_ranges(read: ReadRange, size: int) -> Iterator[tuple[int, int]]:
    """Offset and length of each indexed record, in the order of the index."""
    members = central_directory(read, size)
    starts = {name: data_at(read, local) for name, (local, _) in members.items()}
    for name, (_, length) in members.items():
        if name.startswith("indexes/"):
            for line in read(starts[name], length).decode().split("\n"):
                at = json.loads(line)
                yield starts[at["member"]] + at["offset"], at["length"]


def read_archive(read: ReadRange, size: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each indexed record, each read by its own range."""
    for at, length in record_ranges(read, size):
        yield parse_record(zlib.decompress(read(at, length), 31))


def neighbours(ranges: Iterator[tuple[int, int]], most: int = RANGE_BYTES) -> Iterator[list[tuple[int, int]]]:
    """Ranges in groups that follow each other and hold at most ``most`` bytes (one range at least)."""
    held: list[tuple[int, int]] = []
    for at, length in ranges:
        if held and (sum(held[-1]) != at or at + length - held[0][0] > most):
            yield held
            held = []
        held.append((at, length))
    if held:
        yield held


def scheme(path: str) -> str:
    return path.partition(":")[0] if ":" in path.partition("/")[0] else "file"


def opened(path: str) -> pa.NativeFile:
    """A file for random access."""
    if scheme(path) == "file":
        return stores.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    store, name = stores.FileSystem.from_uri(path)
    return store.open_input_file(name)


# --- the operator -------------------------------------------------------------------------------------------


def mark_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = MIN_REVISIT, parts: int = 8, hot_rows: int = HOT_ROWS) -> DataFrame:
    """page_id, url, html, digest, refers_to (the response's page_id for revisits, else null), in ``parts`` partitions."""
    ids, t = F.col(page_id).cast("long").alias("page_id"), utf8(F.col(html))
    digest = F.sha1(F.encode(t, "UTF-8")).alias("digest")
    keys = pages.select(ids, digest, F.octet_length(t).alias("n"))
    last = keys.filter(F.col("n") >= min_revisit).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).filter("copies > 1")
    # Only ids and digests meet in the skewed join; the texts are dealt once, by an even key.
    revisits = keys.join(last.select("digest", "last"), "digest").filter(F.col("page_id") < F.col("last")).select("page_id", "digest", F.col("last").alias("refers_to")).distinct()
    rows = pages.select(ids, F.col(url).alias("url"), t.alias("html"), digest)
    deal = lambda df: df.repartition(parts, "page_id", "digest")
    out = ["page_id", "url", "html", "digest", "refers_to"]
    if not pages.groupBy(page_id).count().filter(F.col("count") > hot_rows).limit(1).count():
        return deal(rows).join(deal(revisits), ["page_id", "digest"], "left").select(out)
    # Rows that repeat an id and a payload very often, under 1,000 of such pairs: their rows are dealt one by one.
    most = max(hot_rows, pages.count() // 1000)
    hot = cut(keys.groupBy("page_id", "digest").count().filter(F.col("count") > most).join(revisits, ["page_id", "digest"], "left").select(F.col("page_id").alias("h_id"), F.col("digest").alias("h_digest"), "refers_to"))
    same = F.col("page_id").eqNullSafe(F.col("h_id")) & (F.col("digest") == F.col("h_digest"))
    often = rows.join(F.broadcast(hot), same).select(out).repartition(parts)
    seldom = rows.join(F.broadcast(hot.drop("refers_to")), same, "left_anti")
    return deal(seldom).join(deal(revisits), ["page_id", "digest"], "left").select(out).union(often)


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, **names) -> None:
    """Write the pages' records as ZIP archives below ``path``, about ``archive_bytes`` of payload in each."""
    html = names.get("html", "html")
    total = pages.agg(F.sum(F.octet_length(html))).first()[0] or 0
    parts = max(1, -(-total // archive_bytes))
    rows = mark_revisits(pages, parts=parts, **names).mapInArrow(pack_partition, "row binary")
    rows.select(F.col("row").cast("string").alias("value")).write.text(path)


RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, block binary"


def rows_of(records: Iterator[tuple[dict[str, str], bytes]]) -> Iterator[pa.RecordBatch]:
    """Batches of the records, some MB each; a response's block is held against its digest."""
    out, held = [], 0
    for head, block in records:
        digest = head["warc-payload-digest"].partition(":")[2]
        if head["warc-type"] == "response" and hashlib.sha1(block).hexdigest() != digest:
            raise ValueError("a payload does not match its digest")
        out.append((named_page(head.get("warc-record-id")), head["warc-target-uri"], head["warc-type"], int(head["warc-payload-length"]), digest, named_page(head.get("warc-refers-to")), block))
        held += len(block)
        if held >= MEMBER_BYTES:
            yield batch_of(out)
            out, held = [], 0
    if out:
        yield batch_of(out)


def list_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, length) of archives to the ranges of their records: path, offset of the first, lengths of all that follow it."""
    for batch in batches:
        for path, size in zip(*(c.to_pylist() for c in batch.columns)):
            if not size:
                continue
            with opened(path) as f:
                groups = list(neighbours(record_ranges(lambda at, n: f.read_at(n, at), size), RANGE_BYTES))
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(groups), pa.string()), pa.array([g[0][0] for g in groups], pa.int64()), pa.array([[n for _, n in g] for g in groups], pa.list_(pa.int64()))], names=["path", "at", "lengths"])


def read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of the ranges that ``list_ranges`` found."""

    def records(path: str, at: int, lengths: list[int]) -> Iterator[tuple[dict[str, str], bytes]]:
        with opened(path) as f:
            data = memoryview(f.read_at(sum(lengths), at))
        for n in lengths:
            yield parse_record(zlib.decompress(data[:n], 31))
            data = data[n:]

    for batch in batches:
        yield from rows_of(r for row in zip(*(c.to_pylist() for c in batch.columns)) for r in records(*row))


def read_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of archives whose content Spark brought."""
    for batch in batches:
        for content in batch.column(0):
            view = memoryview(content.as_buffer())
            if len(view):
                yield from rows_of(read_archive(lambda at, n, v=view: bytes(v[at : at + n]), len(view)))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the archives below ``path``: page_id, url, record_type, payload_bytes, payload_digest, refers_to, block."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    if scheme(path) not in RANGED:
        return files.select("content").mapInArrow(read_whole, RECORD)
    # Names and sizes only: the content is not read for them.
    ranges = cut(files.select("path", "length").mapInArrow(list_ranges, "path string, at long, lengths array<long>"))
    return ranges.repartition(max(1, ranges.count()), "path", "at").mapInArrow(read_ranges, RECORD)


def named_page(urn: str | None) -> int | None:
    """The page_id of ``<urn:page:ID>``; null ids are written as None."""
    name = (urn or "").rpartition(":")[2].rstrip(">")
    return None if name in ("", "None") else int(name)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("block", pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back, without the blocks."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path).drop("block")
