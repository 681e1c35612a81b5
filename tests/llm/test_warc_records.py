"""The written WARC records: references that resolve, and records of every type."""

import gzip
from pathlib import Path

from paperloom.llm import archives
from paperloom.llm.common import scratch, table


def written(spark, arcs):
    path = scratch(spark, "test_warc")
    archives.write_warc(archives.arc_to_warc(arcs, archives.revisits(archives.arc_digests(arcs))), path)
    files = Path(path.removeprefix("file:")).glob("*.txt.gz")
    return path, [r for f in files for r in archives.read_warc(gzip.decompress(f.read_bytes()))]


def test_every_revisit_names_a_written_response(spark, sf):
    arcs = archives.pages_to_arc(table(spark, sf, "pages").unionByName(table(spark, sf, "pages").selectExpr("page_id + 100000 AS page_id", "concat(url, '/again') AS url", "html")))
    _, found = written(spark, arcs)
    by_id = {f["warc-record-id"]: f for f, _ in found}
    assert len(by_id) == len(found)
    again = [f for f, _ in found if f["warc-type"] == "revisit"]
    assert again
    for f in again:
        to = by_id[f["warc-refers-to"]]
        assert (to["warc-type"], to["warc-payload-digest"], to["warc-date"]) == ("response", f["warc-payload-digest"], f["warc-refers-to-date"])
    assert not any(b"X-Refers-To-Page" in block for _, block in found)


def test_records_of_every_type_are_written(spark):
    http = b"HTTP/1.1 200 OK\r\nX-Page-Id: 7\r\n\r\nbody"
    blocks = [("http://h/", "text/html", http), ("ftp://h/f.png", "image/png", b"\x89PNG\xff\x00\r\n\r\n"), ("dns:h", "text/dns", b"h. A 1.1.1.1")]
    arc = archives.arc_header("1", "f.arc", "20010203040506") + b"".join(archives.arc_record("1", u, "20010203040506", m, b) for u, m, b in blocks)
    path, found = written(spark, spark.createDataFrame([(bytearray(arc),)], "arc binary"))
    got = {(f["warc-type"], f.get("warc-target-uri", f.get("warc-filename"))): (f["content-type"], block) for f, block in found}
    assert got[("response", "http://h/")][1] == http
    assert got[("resource", "ftp://h/f.png")] == ("image/png", blocks[1][2])
    assert got[("response", "dns:h")] == ("text/dns", blocks[2][2])
    assert got[("warcinfo", "f.arc")][1].startswith(b"1 0 paperloom")
    assert sorted((r["page_id"] or 0) for r in archives.read_archives(spark, path).collect()) == [0, 7]


def test_a_page_of_any_scheme_stays(spark):
    df = spark.createDataFrame([(1, "filedesc://x", "a"), (2, "ftp://x", "a"), (3, "dns:x", "b")], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in archives.convert_pages(df).collect())
    assert got == [(1, "revisit", 2), (2, "response", None), (3, "response", None)]
