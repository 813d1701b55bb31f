import hashlib
import io
import os
import random
import zipfile

import pyarrow.fs as pafs
import pytest

from fumble.llm import warc as W
from fumble.llm.queries import op11_warc_archives
from fumble.llm.shared import shared_path
from tests.conftest import SF001
from tests.llm.helpers import data, prose, with_clashes

SCHEMA = "page_id long, url string, html string"
COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pages(seed=3):
    rng = random.Random(seed)
    long, wide = prose(rng, 400), "é" * 500  # 1000 bytes of 500 letters
    rows = [(1, None, None), (2, "http://a/ b\r\nc", ""), (3, "http://a/", "short"), (4, None, "short"), (None, "http://n/", long)]
    rows += [(i, f"http://h{i}.org/x", long) for i in range(10, 30)] + [(30, "u", wide), (31, "u", wide), (32, "u", wide[:-1]), (33, "u", wide[:-1])]
    rows += [(40, "u", "<p>\r\n\r\nWARC/1.1\r\n\x00" + prose(rng, 9000)), (None, "u", "z" * 1200), (None, "v", "z" * 1200)]
    rows += [(50 + i, f"http://p/{i}", prose(rng, rng.choice([3, 300, 500]))) for i in range(20)]
    return rows + [rows[24], rows[12], rows[-1]]


def brute(rows):
    best = {}
    for i, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 1000 and i is not None:
            best[raw] = max(best.get(raw, i), i)
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        refers = best.get(raw, i)
        refers = None if refers == i else refers
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=repr)


def reader(raw):
    return (lambda at, n: raw[at : at + n]), len(raw)


def archive(members, **options):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, **options) as z:
        for name, body in members:
            z.writestr(name, body)
    return out.getvalue()


def test_round_trip(spark):
    rows = pages()
    df = with_clashes(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert data(W.warc_round_trip(df), *COLUMNS) == brute(rows)


def test_equal_payloads_by_shuffle(spark):
    rows = pages()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert data(W.warc_round_trip(spark.createDataFrame(rows, SCHEMA)), *COLUMNS) == brute(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/pages.parquet").select("page_id", "url", "html").collect()]
    assert data(op11_warc_archives(spark, SF001), *COLUMNS) == brute(rows)


def test_empty_table(spark):
    assert data(W.warc_round_trip(spark.createDataFrame([], SCHEMA)), *COLUMNS) == []


def test_many_members_and_archives(spark, monkeypatch):
    rows = [r for r in pages() if r[0] is not None]
    local = pafs.LocalFileSystem()
    folder = shared_path(spark, "warc-small").replace("file://", "")
    os.makedirs(f"{folder}/zip")
    monkeypatch.setattr(W, "MEMBER", 600)
    one = W.Archive(local, folder, "zip/a.zip")
    for i, url, html in rows:
        raw = (html or "").encode()
        one.add(i, W.record(i, url, raw, hashlib.sha1(raw).hexdigest(), None))
    path, size, n = one.close()
    raw = open(f"{folder}/{path}", "rb").read()
    assert (size, n) == (len(raw), len(rows)) and zipfile.ZipFile(io.BytesIO(raw)).testzip() is None
    assert len(W.directory(*reader(raw))) > 4
    got = [W.record_row(raw[a : a + k]) for a, k in W.places(*reader(raw))]
    assert [(g[0], g[3]) for g in got] == [(i, hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in rows]


def records(n=5):
    return [W.record(i, "u", f"text {i}".encode(), hashlib.sha1(f"text {i}".encode()).hexdigest(), None) for i in range(n)]


def found(raw):
    return [W.record_row(raw[a : a + k])[0] for a, k in W.places(*reader(raw))]


def test_members_without_an_index_are_walked(monkeypatch):
    import gzip

    some = records()
    plain = b"".join(gzip.decompress(x) for x in some)
    assert found(archive([("data.warc.gz", b"".join(some))])) == list(range(5))
    assert found(archive([("x/data.warc", plain), ("note.txt", b"no records")])) == list(range(5))
    monkeypatch.setattr(W, "READ", 7)
    assert found(archive([("data.warc.gz", b"".join(some))])) == list(range(5))
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    raw = archive([("data.warc", info + plain)])
    rows = [W.record_row(raw[a : a + k]) for a, k in W.places(*reader(raw))]
    assert rows[0] is None and [r[0] for r in rows[1:]] == list(range(5))


def test_zip64_directories(monkeypatch):
    body = b"".join(records())
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 64)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    raw = archive([("a.txt", b"x" * 100), ("data.warc.gz", body), ("b.txt", b"")])
    assert W.END64 in raw and W.LOCATOR in raw
    assert [m.name for m in W.directory(*reader(raw))] == ["a.txt", "data.warc.gz", "b.txt"]
    assert found(raw) == found(b"#!/bin/sh\n" * 9 + raw) == list(range(5))


def test_more_members_than_16_bits_count():
    raw = archive([(f"{i}", b"") for i in range(70_000)])
    members = W.directory(*reader(raw))
    assert len(members) == 70_000 and members[-1].name == "69999"


def test_comments_prefixes_and_names():
    body = b"".join(records())
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("é/data.warc.gz", body)
        z.comment = W.END + b"x" * 40 + W.END
    assert found(out.getvalue()) == found(b"before" + out.getvalue()) == list(range(5))
    assert W.directory(*reader(archive([]))) == []


def test_damage_is_found():
    good = archive([("data.warc.gz", b"".join(records()))])
    with pytest.raises(ValueError, match="end of central"):
        W.directory(*reader(good[:-30]))
    deflated = io.BytesIO()
    with zipfile.ZipFile(deflated, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("data.warc.gz", b"a" * 1000)
    with pytest.raises(ValueError, match="not stored"):
        found(deflated.getvalue())
    with pytest.raises(ValueError, match="damaged"):
        found(archive([("data.warc.gz", b"".join(records())[:-3])]))
    line = 'page:1 20200101000000 {"filename": "data.warc.gz", "offset": 0, "length": 99999}\n'
    with pytest.raises(ValueError, match="outside"):
        found(archive([("data.warc.gz", b"".join(records())), ("indexes/0.cdxj", line)]))
    with pytest.raises(ValueError, match="has not"):
        found(archive([("indexes/0.cdxj", line)]))
    lied = W.record(1, "u", b"text", hashlib.sha1(b"other").hexdigest(), None)
    with pytest.raises(ValueError, match="payload is damaged"):
        W.record_row(lied)
