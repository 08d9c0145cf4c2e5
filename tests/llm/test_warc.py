import hashlib
import io
import zipfile
import zlib
from pathlib import Path

import pyarrow as pa
import pytest

from lumenweave.llm import warc
from lumenweave.llm.shared import new_path


def expect(rows):
    """(page_id, url, html) to (page_id, payload, type, refers_to)."""
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", i), i, key=lambda x: -1 if x is None else x)
    out = []
    for i, _, h in rows:
        h = h or ""
        again = len(h.encode()) >= 1000 and i is not None and i < last[h]
        out.append((i, h.encode(), "revisit" if again else "response", last[h] if again else None))
    return out


ROWS = [
    (1, "http://a/1", "<p>é</p>" * 200), (2, None, "<p>é</p>" * 200), (5, "u\r\nx: y", "<p>é</p>" * 200), (5, "again", "<p>é</p>" * 200), (3, "b", "small"), (4, "b", "small"), (6, "c", None), (7, "", ""), (None, "n", "<i>" * 500), (8, "n", "<i>" * 500), (9, "big", "\r\n\r\nWARC/1.1\n" * 5000),
    (10, "edge", "y" * 999), (11, "edge", "y" * 999), (12, "edge", "z" * 1000), (13, "edge", "z" * 1000),
]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, digest string")
    path = new_path(spark, "warc-test")
    warc.write_archives(pages, path, archive_bytes=20_000)
    got = warc.read_archives(spark, path).collect()
    want = [(i, len(p), hashlib.sha1(p).hexdigest(), t, f, b"" if t == "revisit" else p) for i, p, t, f in expect(ROWS)]
    key = lambda x: (str(x[0]), x[3], str(x[4]))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.block)) for r in got), key=key) == sorted(want, key=key)
    files = [p for p in Path(path.removeprefix("file:")).iterdir() if p.name.startswith("part-") and p.stat().st_size]
    assert len(files) > 1
    for p in files:  # any reader of ZIP files can open them
        with zipfile.ZipFile(p) as z:
            assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages).collect() == []


def archive(rows, member_bytes, monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_BYTES", member_bytes)
    t = pa.table({"page_id": [r[0] for r in rows], "url": [r[1] for r in rows], "html": [r[2] or "" for r in rows], "digest": [hashlib.sha1((r[2] or "").encode()).hexdigest() for r in rows], "refers_to": pa.array([None] * len(rows), pa.int64())})
    return b"".join(b.column(0)[0].as_py() + b"\n" for b in warc.pack_partition(iter(t.to_batches())))


def test_reads_only_ranges(monkeypatch):
    data = archive(ROWS, 4000, monkeypatch)
    read = []
    found = list(warc.read_archive(lambda at, n: read.append(n) or data[at : at + n], len(data)))
    assert [b for _, b in found] == [(r[2] or "").encode() for r in ROWS]
    members = zipfile.ZipFile(io.BytesIO(data)).namelist()
    assert len([m for m in members if m.startswith("archive/")]) > 1
    assert len(read) >= len(ROWS)


def test_reads_other_writers_archives():
    rows = [warc.squeeze(warc.record(i, "u", b"body %d" % i, hashlib.sha1(b"body %d" % i).hexdigest(), None)) for i in range(3)]
    buffer, at, index = io.BytesIO(), 0, []
    for i, gz in enumerate(rows):
        index.append(f'{{"id": {i}, "member": "archive/a.warc.gz", "offset": {at}, "length": {len(gz)}}}')
        at += len(gz)
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
        z.writestr("indexes/index.cdxj", "\n".join(index))
        with z.open("archive/a.warc.gz", "w", force_zip64=True) as f:
            f.write(b"".join(rows))
        z.comment = b"PK\5\6 a comment"
    data = buffer.getvalue()
    assert [b for _, b in warc.read_archive(lambda at, n: data[at : at + n], len(data))] == [b"body 0", b"body 1", b"body 2"]


def test_broken_archives_are_refused(monkeypatch):
    data = archive(ROWS[:3], 1 << 20, monkeypatch)
    with pytest.raises((ValueError, zlib.error)):
        list(warc.read_archive(lambda at, n: data[at : at + n], len(data) - 40))
    with pytest.raises(ValueError):
        list(warc.read_archive(lambda at, n: b"", 0))
    with pytest.raises(ValueError):
        warc.parse_record(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort")


def test_ranges_are_read_from_the_file_and_no_more(tmp_path, monkeypatch):
    rows = [(i, "u", f"{i} {j}" + "x" * 300) for i in range(40) for j in range(2)]
    data = archive(rows, 4000, monkeypatch)
    (tmp_path / "a b%20.zip").write_bytes(data)
    asked = []

    class File:
        def __init__(self, path):
            self.f = open(path, "rb")  # noqa: SIM115

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def read_at(self, n, at):
            asked.append((at, n))
            self.f.seek(at)
            return self.f.read(n)

    monkeypatch.setattr(warc, "opened", File)
    listed = pa.table({"path": [str(tmp_path / "a b%20.zip")], "length": [len(data)]})
    monkeypatch.setattr(warc, "RANGE_BYTES", 500)
    ranges = list(warc.list_ranges(iter(listed.to_batches())))
    assert sum(n for _, n in asked) < len(data)
    asked.clear()
    one = ranges[0].slice(3, 1)
    (got,) = list(warc.read_ranges(iter([one])))
    assert asked == [(one.column(1)[0].as_py(), sum(one.column(2)[0].as_py()))] and got.num_rows == len(one.column(2)[0])
    every = [r for b in warc.read_ranges(iter(ranges)) for r in b.to_pylist()]
    assert [(r["page_id"], r["block"].decode()) for r in every] == [(i, h) for i, _, h in rows]


def test_neighbours():
    assert list(warc.neighbours(iter([(0, 4), (4, 4), (8, 1), (20, 5), (25, 90), (115, 1)]), 9)) == [[(0, 4), (4, 4), (8, 1)], [(20, 5)], [(25, 90)], [(115, 1)]]
    assert list(warc.neighbours(iter([]))) == []
    assert [warc.scheme(p) for p in ("/a/b:c", "file:/x", "viewfs://c/x", "s3://b/x")] == ["file", "file", "viewfs", "s3"]


def test_files_with_odd_names_open(tmp_path):
    (tmp_path / "x y%20z").write_bytes(b"0123456789")
    for path in (f"{tmp_path}/x y%20z", f"file:{tmp_path}/x y%20z", f"file://{tmp_path}/x y%20z"):
        with warc.opened(path) as f:
            assert f.read_at(3, 4) == b"456"


def test_rows_that_repeat_often_and_stores_that_only_spark_opens(spark, monkeypatch):
    rows = ROWS + [(20, "hot", "h" * 1500)] * 60 + [(21, "hot", "h" * 1500)] * 50 + [(None, "null", "n" * 1200)] * 40
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, h_id string")
    monkeypatch.setattr(warc, "HOT_ROWS", 10)
    marked = warc.mark_revisits(pages, parts=6, hot_rows=10)
    most = max(r["count"] for r in marked.groupBy(warc.F.spark_partition_id().alias("p")).count().collect())
    assert most < 80
    want = sorted((str(i), len(p), t, str(f)) for i, p, t, f in expect(rows))
    assert sorted((str(r.page_id), len(r.html.encode()), "revisit" if r.refers_to is not None else "response", str(r.refers_to)) for r in marked.collect()) == want
    monkeypatch.setattr(warc, "RANGED", ())
    assert sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in warc.round_trip(pages).collect()) == want
