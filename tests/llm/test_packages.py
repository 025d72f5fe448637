"""Packages: round trips with nulls, repeats, ties and clashing columns; packages that others wrote; ZIP64; broken ones."""

import base64
import hashlib
import io
import zipfile
import zlib
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeforge.llm import packages as P

KIND = "page_id long, url string, html string, payload int, key string, head int, path string, refers_to string, record_type int"


def rows():
    out = [(i, f"http://x/{i % 5}", "same" if i % 3 == 0 else f"<p>é {i}</p>" * (i % 40), 1, "k", 2, "p", "r", 3) for i in range(200)]
    out += [(300, None, None), (301, "u", ""), (302, "", None), (None, "n", "only null"), (None, "n", "only null"), (None, None, "same"), (-7, "u", "neg"), (8, "u", "neg")]
    out += [(400, "u", "twice")] * 3 + [(400, "a", "twice"), (401, "u", "twice"), (402, "b\r\nX: y", "x" * 300_000)]
    return [(*r, 1, "k", 2, "p", "r", 3)[:9] if len(r) < 9 else r for r in out]


def brute(table):
    best = {}
    for r in table:
        key, at = r[2] or "", (r[0] is None, r[0] or 0)
        best[key] = min(best.get(key, at), at)
    done, out = set(), Counter()
    for r in table:
        raw, at = (r[2] or "").encode(), (r[0] is None, r[0] or 0)
        first = at == best[r[2] or ""] and (r[2] or "") not in done
        if first:
            done.add(r[2] or "")
        head = best[r[2] or ""]
        out[(r[0], len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first or head[0] else head[1])] += 1
    return out


@pytest.mark.parametrize("package, bound", [(P.PACKAGE_BYTES, P.BROADCAST_BYTES), (2000, 0)])
def test_round_trip(spark, monkeypatch, package, bound):
    monkeypatch.setattr(P, "BROADCAST_BYTES", bound)
    monkeypatch.setattr(P, "write_packages", lambda r, f, w=P.write_packages: w(r, f, package))
    df = spark.createDataFrame(rows(), KIND).repartition(3)
    out = P.round_trip(df).cache()
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect())
    assert got == brute(rows())
    texts = {r.page_id: r.payload for r in out.where("record_type = 'response'").collect()}
    assert bytes(texts[401] if 401 in texts else texts[400]) == b"twice" and bytes(texts[402]) == b"x" * 300_000
    assert out.where("record_type = 'revisit' and payload is not null").count() == 0
    assert out.where("stated_digest != payload_digest").count() == 0


def test_sql(spark):
    table = [r[:3] for r in rows() if r[0] is not None and r[0] != 400]
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", table)
    assert Counter(con.sql(P.oracle()).fetchall()) == brute(table)


def test_empty(spark):
    out = P.round_trip(spark.createDataFrame([], KIND))
    assert out.count() == 0 and {"page_id", "payload_digest", "refers_to"} <= set(out.columns)


def warc(payload, n):
    return P.write_record(f"urn:page:{n}", "http://x", payload, len(payload), P.digest(payload), None)


def test_packages_of_others(spark, tmp_path, monkeypatch):
    """Bytes in front, a comment that looks like an end record, ZIP64 end records, deflated members, no index."""
    archive = b"".join(warc(b"p%d" % i, i) for i in range(20))
    for k, (limit, front, comment) in enumerate([(None, b"", b""), (None, b"MZ" * 900, b"PK\5\6 no end"), (1, b"", b"c"), (1, b"MZ" * 900, b"")]):
        body = io.BytesIO()
        body.write(front)
        with monkeypatch.context() as m:
            if limit:
                m.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", limit)
            with zipfile.ZipFile(body, "a") as z:
                z.writestr("readme.txt", "x" * 500, zipfile.ZIP_DEFLATED)
                with z.open(zipfile.ZipInfo("archive/a.warc.gz"), "w", force_zip64=True) as out:
                    out.write(archive)
                z.writestr("archive/b.warc.gz", warc(b"other", 99))
                z.comment = comment
        raw = body.getvalue()
        assert (b"PK\6\7" in raw) == bool(limit)
        (tmp_path / f"{k}.zip").write_bytes(raw)
    paths = spark.createDataFrame([(f"file://{tmp_path}/{k}.zip",) for k in range(4)], "path string")
    places = P.locate(paths)
    got = P.read_records(places).select("path", "record_id", F.col("payload").cast("string")).collect()
    assert Counter(r[1] for r in got) == Counter({f"urn:page:{i}": 4 for i in (*range(20), 99)})
    assert {r[2] for r in got} == {f"p{i}" for i in range(20)} | {"other"}


def test_wide_fields_of_the_directory():
    """A member beyond 4 GB, stated by the directory's extra field only."""
    import struct

    extra = struct.pack("<HHQQQ", 1, 24, 5 << 32, 5 << 32, 6 << 32)
    entry = b"PK\1\2" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, P.OVERFLOW, P.OVERFLOW, 1, len(extra), 0, 0, 0, 0, P.OVERFLOW) + b"a" + extra
    raw = entry + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 1, 1, len(entry), 0, 0)
    assert P.directory(pa.PythonFile(io.BytesIO(raw), "r"), len(raw)) == [P.Member("a", 0, 0, 5 << 32, 6 << 32)]


def test_broken_packages(tmp_path):
    for raw in (b"", b"PK", b"no package at all" * 100, b"PK\5\6" + bytes([0, 0, 0, 0, 1, 0, 1, 0, 200, 0, 0, 0, 0, 0, 0, 0, 0, 0])):
        with pytest.raises(ValueError):
            P.directory(pa.PythonFile(io.BytesIO(raw), "r"), len(raw))
    with pytest.raises(ValueError):
        list(P.members_of(warc(b"x", 1)[:-3]))
    with pytest.raises(ValueError):
        P.read_record(zlib.decompress(zlib.compress(b"GET / HTTP/1.1\r\n\r\n")))


def test_base32(spark):
    got = spark.range(1).select(P.base32(F.sha1(F.lit("abc").cast("binary"))).alias("d")).first().d
    assert got == P.digest(b"abc")
