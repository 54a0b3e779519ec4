import gzip
import hashlib
import random

import pytest

from sparkloom.llm import warc
from sparkloom.runtime import scratch_path


def through(spark, pages, versions=(1, 2)):
    legacy, made = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    warc.write_arc(pages, legacy, versions)
    warc.write_warc(warc.convert(warc.read_arc(spark, [legacy])), made)
    return warc.read_warc(spark, [made])


def expected(rows):
    first = {}
    raw = [(p, (h or "").encode()) for p, _, h in rows]
    for p, h in raw:
        if len(h) >= 100 and p is not None:
            first[h] = min(first.get(h, p), p)
    out = []
    for p, h in raw:
        again = len(h) >= 100 and p is not None and p > first[h]
        out.append((p, len(h), hashlib.sha256(h).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rnd = random.Random(1)
    nasty = ["\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n", "http://x/ 0.0.0.0 20090101000000 text/html 5\n", "é\x00\n", "Content-Length: 3\r\nX-Page-Id: 9\r\n\r\n"]
    payloads = ["".join(rnd.choice(nasty) for _ in range(rnd.randint(0, 9))) for _ in range(12)] + ["x" * 99, "x" * 100, "y" * 3_000_000, "", None]
    rows = [(i, rnd.choice(["http://a/b", "http://a/b c\td", None, "é://ü"]), rnd.choice(payloads)) for i in rnd.sample(range(500), 120)]
    rows += [(None, "http://n/", "z" * 200), (None, None, None), rows[0]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record string").repartition(3)
    records = through(spark, df)
    got = sorted((tuple(r) for r in warc.index(records).collect()), key=str)
    assert got == expected(rows)
    kept = {r.page_id: bytes(r.payload).decode() for r in records.where("record_type = 'response'").collect()}
    assert all(kept[p] == (h or "") for p, _, h in rows if p in kept and p is not None)


def test_versions_and_members():
    block = warc.http_block(5, b"\nx 1 2 3\n")
    for version in (1, 2):
        parts = [warc.arc_start(version), warc.arc_record(version, "http://a/", "20090102030405", block), warc.arc_record(version, "http://b/", "20090102030406", b"")]
        whole = b"\n".join(parts) + b"\n"
        for content in (whole, gzip.compress(whole), b"".join(gzip.compress(p + b"\n") for p in parts)):
            got = list(warc.parse_arc(content))
            assert [(h["URL"], h["Archive-date"], b) for h, b in got] == [("http://a/", "20090102030405", block), ("http://b/", "20090102030406", b"")]
            assert set(got[0][0]) == set(warc.ARC_FIELDS[version])
    spaced = warc.arc_start(1) + b"\nhttp://a/x y 0.0.0.0 20090102030405 text/html 2\nhi\n"
    assert [(h["URL"], b) for h, b in warc.parse_arc(spaced)] == [("http://a/x y", b"hi")]
    with pytest.raises(ValueError):
        list(warc.parse_arc(warc.arc_start(1) + b"\nhttp://a/ 0 20090102030405 text/html 99\nshort"))
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"http://a/ 0 20090102030405 text/html 2\nhi\n"))


def test_synthesised_fields():
    record = warc.warc_record(3, "http://a/", "20090102030405", warc.http_block(3, b"body"), hashlib.sha256(b"body").hexdigest(), None)
    (head, block), = warc.parse_warc(record + b"\n")
    assert head["WARC-Date"] == "2009-01-02T03:04:05Z" and head["WARC-Type"] == "response" and block.endswith(b"body")
    again = warc.warc_record(9, "http://b/", "20090102030405", warc.http_block(9, b"body"), hashlib.sha256(b"body").hexdigest(), 3)
    (other, block), = warc.parse_warc(again + b"\n")
    assert other["WARC-Refers-To"] == head["WARC-Record-ID"] and other["WARC-Type"] == "revisit" and block.endswith(b"\r\n\r\n")


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.index(through(spark, df, (1,))).count() == 0
