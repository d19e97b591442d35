import base64
import gzip
import hashlib
import io

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, IsNull, Not, StringStartsWith

from barloom.llm.warc import Counted, Stream, WarcReader, archive, base32, body_of, clean, known, member, page_records, record, register

PAGE = "page_id long, url string, html string, record_id string, payload string"


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(rows):
    top = {}
    for p, u, h in rows:
        top[h or ""] = max(top.get(h or "", (False, -1, False, "")), (p is not None, p or 0, u is not None, u or ""))
    seen, out = set(), []
    for p, u, h in rows:
        h = h or ""
        mine = (p is not None, p or 0, u is not None, u or "") == top[h] and h not in seen
        if mine:
            seen.add(h)
        best = top[h][1] if top[h][0] else None
        out.append((p, len(h.encode()), sha(h), "response" if mine else "revisit", None if mine else best))
    return sorted(out, key=repr)


@pytest.fixture
def made(spark, tmp_path):
    def make(rows, **options):
        path = f"file://{tmp_path}/a"
        archive(spark.createDataFrame([(*r, "x", "y") for r in rows], PAGE), path, **options)
        return path

    return make


ROWS = [(i, f"http://h{i % 5}.org/{i}", f"<p>page {i % 7}</p>" if i % 3 else f"own é {i}") for i in range(60)]
ROWS += [(100, None, None), (101, "http://e.org/\r\nX: y", ""), (None, "u", "null id"), (102, "same", "all\r\n\r\nWARC/1.1\r\nequal"), (102, "same", "all\r\n\r\nWARC/1.1\r\nequal"), (None, "w", "only nulls"), (None, "v", "only nulls"), (103, "long", "word \U0001f600 " * 60_000)]


def test_round_trip_and_revisits(spark, made):
    path = made(ROWS)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in page_records(spark, path).collect()), key=repr)
    assert got == brute(ROWS)
    full = spark.read.format("warc").load(path)
    kept = full.where("warc_type = 'response'").select(F.decode("payload", "UTF-8").alias("t"), "target_uri").collect()
    assert sorted(r.t for r in kept) == sorted({h or "" for _, _, h in ROWS})
    assert all("\n" not in (r.target_uri or "") for r in kept)
    ids = [r.record_id for r in full.collect()]
    assert len(set(ids)) == len(ids)


def test_small_payloads_are_all_responses(spark, made):
    got = page_records(spark, made([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long enough"), (4, "d", "long enough")], revisit_from=5)).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)]


def test_empty(spark, made):
    assert page_records(spark, made([])).count() == 0


def test_conditions_are_pushed_down(spark, made):
    path = made(ROWS)
    df = spark.read.format("warc").option("payload", "none").load(path).where("warc_type = 'revisit' and target_uri like 'http://h1%' and content_length is not null")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan.replace("PushedFilters", "")
    assert df.count() == sum(r[3] == "revisit" for r in brute([x for x in ROWS])) - sum(1 for r in df.sparkSession.read.format("warc").load(path).where("warc_type = 'revisit'").collect() if not (r.target_uri or "").startswith("http://h1"))


def reader(path, payload="full", filters=(), **options):
    r = WarcReader({"path": path, "payload": payload, **options})
    r.filters = list(filters)
    return r


def scan(r, count=None):
    fs = pafs.LocalFileSystem()
    out = []
    for p in r.partitions():
        for name, a, z in p.parts:
            out += list(r.records(fs, name, a, z, count or Counted()))
    return out


def records(n=50, size=100_000):
    return [record([("WARC-Type", "response" if i % 5 else "request"), ("WARC-Record-ID", f"<urn:{i}>"), ("WARC-Target-URI", f"http://x/{i}")], bytes([i]) * (size + i)) for i in range(n)]


def test_unwanted_blocks_are_not_decoded(tmp_path):
    for name, data in (("a.warc.gz", b"".join(member(r, 6) for r in records())), ("b.warc.gz", b"".join(map(gzip.compress, records()))), ("c.warc.gz", gzip.compress(b"".join(records()))), ("d.warc", b"".join(records()))):
        path = tmp_path / name
        path.write_bytes(data)
        count = Counted()
        got = scan(reader(f"file://{path}", filters=[EqualTo(("warc_type",), "request")]), count)
        assert [r[0] for r in got] == [f"<urn:{i}>" for i in range(0, 50, 5)] and [r[-3] for r in got] == [bytes([i]) * (100_000 + i) for i in range(0, 50, 5)]
        assert (count.seen, count.decoded) == (50, 10)
        if name in ("a.warc.gz", "d.warc"):

            class Watched(io.BytesIO):
                bytes = 0

                def read(self, n=-1):
                    out = super().read(n)
                    self.bytes += len(out)
                    return out

            packed = name.endswith("gz")
            f = Watched(data if not packed else b"".join(member(r, 0) for r in records()))
            s, n = Stream(f, packed), 0
            while (head := s.head()) is not None:
                n += 1
                s.skip(int(head.rpartition(b" ")[2]))
            assert n == 50 and f.bytes < 0.7 * len(f.getvalue())


def test_large_files_are_split_at_places(spark, made):
    import re
    from pathlib import Path

    from barloom.llm.warc import WarcWriter

    path = made([(1, "a", "b")])
    w = WarcWriter({"path": path, "place_bytes": "2000"})
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"record_id": f"<urn:{i}>", "warc_type": "response", "target_uri": f"u{i}", "refers_to": None, "refers_to_uri": None, "payload_digest": None, "extra": None, "payload": hashlib.sha512(str(i).encode()).hexdigest().encode() * 3} for i in range(200)])
    w.commit([w.write(iter([batch]))])
    r = reader(path, partition_bytes=5000)
    assert len(r.partitions()) > 5
    assert {x[0] for x in scan(r)} >= {f"<urn:{i}>" for i in range(200)} and len(scan(r)) == len(scan(reader(path)))
    assert not [p for p in Path(re.sub("^file://", "", path)).iterdir() if p.name.startswith("_")]


def test_a_staged_file_is_not_read(spark, made):
    import re
    from pathlib import Path

    path = made([(1, "a", "b")])
    left = Path(re.sub("^file://", "", path)) / "_staging-0"
    left.mkdir()
    (left / "part-0.warc.gz").write_bytes(b"half a file")
    assert page_records(spark, path).count() == 1


def test_broken_files_are_errors(tmp_path):
    good = b"".join(member(r, 6) for r in records(3, 100))
    for name, data in (("a.warc.gz", good[:-20]), ("b.warc.gz", good + b"junk and more of it, no member"), ("c.warc", b"no record\r\n\r\n"), ("d.warc", records(1, 100)[0][:-50])):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(ValueError, match="near"):
            scan(reader(f"file://{tmp_path / name}"))
    bad = record([("WARC-Type", "response"), ("WARC-Payload-Digest", "sha1:" + "A" * 32)], b"x")
    (tmp_path / "e.warc").write_bytes(bad)
    with pytest.raises(ValueError, match="digest"):
        scan(reader(f"file://{tmp_path}/e.warc"))
    assert len(scan(reader(f"file://{tmp_path}/e.warc", payload="none"))) == 1


def test_blocks_and_headers():
    http = "application/http; msgtype=response"
    assert body_of(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody", http) == b"body" and body_of(b"body", "text/plain") == b"body"
    assert body_of(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nbody\r\nb;x=1\r\n and more..\r\n0\r\n\r\n", http) == b"body and more.."
    assert clean("a\r\nb\tc") == "a%0D%0Ab%09c"
    of = {"a": "x", "b": None}.get
    assert known(StringStartsWith(("a",), "x"), of) and known(IsNull(("b",)), of) and known(EqualTo(("b",), "x"), of) is None and known(Not(EqualTo(("b",), "x")), of) is None


def test_base32(spark):
    texts = ["", "a", "some text", "é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", base32(F.sha1(F.col("t").cast("binary"))).alias("s"))
    assert all(r.s == sha(r.t) for r in df.collect())


def test_registered_once_more(spark):
    register(spark)
    register(spark)
