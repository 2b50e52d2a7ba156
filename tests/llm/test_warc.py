from __future__ import annotations

import hashlib

from corpus_helpers import rows

from swellworks.llm import warc
from swellworks.llm.runtime import Workspace


def brute(pages):
    keeper = {}
    for p, _, h in pages:
        b = (h or "").encode()
        if len(b) >= 1000 and p is not None:
            keeper[b] = max(keeper.get(b, p), p)
    count = {}
    for _, _, h in pages:
        count[(h or "").encode()] = count.get((h or "").encode(), 0) + 1
    out = []
    for p, _, h in pages:
        b = (h or "").encode()
        k = keeper.get(b) if count[b] > 1 else None
        again = k is not None and k != p
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", k if again else None))
    return sorted(out, key=repr)


def test_round_trip_and_lookup(spark):
    big, other = "x" * 1500, "é" * 700
    pages = [(i, f"http://www.H{i % 3}.Example.com:80/p/{i}?q=1", big if i % 2 else other) for i in range(40)]
    pages += [(100, None, None), (101, "not a url", ""), (102, "http://e.org/\r\nx y", "small"), (103, "http://e.org", "small"), (39, "http://h0.example.com/again", big), (None, "http://n.org/", big), (200, "http://[bad", "y" * 999)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert rows(warc.archive_round_trip(df), *names) == brute(pages)
    ws = Workspace(spark, "warc-test")
    parts = warc.write_index(warc.write_archives(warc.decide(df, ws), ws, target=4000), ws, block=4, per_part=20)
    assert parts.count() > 1
    index = warc.CaptureIndex([tuple(r) for r in parts.collect()])
    for page, url, html in pages:
        if url:
            found = [c for c in index.lookup(url) if c[1] == page]
            assert found, url
            got = index.fetch(found[0])
            assert got["page_id"] == page and (got["record_type"] == "revisit" or got["payload"] == (html or "").encode())
            assert [index.fetch(c)["page_id"] for c in index.lookup_page(url, page)] == [page] * pages.count((page, url, html))
    assert index.lookup("http://nowhere.example/") == [] and list(index.lookup_page("http://e.org", 5)) == []


def test_common_url_and_repeated_rows(spark):
    """One url and null urls over many blocks and index files; each capture is found once."""
    pages = [(i, "http://hot.example/", f"p{i}") for i in range(150)] + [(None, None, "none")] * 9 + [(7, "http://hot.example/", "p7")] * 5 + [(i, None, None) for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    ws = Workspace(spark, "warc-test")
    parts = warc.write_index(warc.write_archives(warc.decide(df, ws), ws, target=500), ws, block=4, per_part=30)
    found = warc.captures_of(df, parts, per_task=40)
    assert rows(found, "page_id") == sorted([(p[0],) for p in pages], key=repr)
    assert found.select("uri", "offset").distinct().count() == len(pages)


def test_keys():
    assert warc.reversed_host_key("https://user@www.a.Example.com:8080/x?y=1") == "com,example,a)/x?y=1"
    assert warc.reversed_host_key("http://e.org") == "org,e)/"
    assert warc.reversed_host_key(None) == ""


def test_empty(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
