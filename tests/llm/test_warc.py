"""Derivatives of pages, field by field."""

from __future__ import annotations

import base64
import hashlib
import re
from html.parser import HTMLParser

from dispatchlake.llm import warc
from dispatchlake.llm.queries import QUERIES


class Plain(HTMLParser):
    """Visible text by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in warc.UNSEEN
        self.out.append("\n" if tag in warc.BLOCKS else "")

    def handle_endtag(self, tag):
        self.hidden -= tag in warc.UNSEEN
        self.out.append("\n" if tag in warc.BLOCKS else "")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def plain_text(page):
    parser = Plain()
    parser.feed(page)
    parser.close()
    lines = (re.sub(r"[ \t\r\f\v\xa0]+", " ", line).strip() for line in "".join(parser.out).split("\n"))
    return "\n".join(line for line in lines if line)


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_read_html():
    page = "<!DOCTYPE html><title>A &amp; B</title><script>if (a<b) x()</script><p>1 < 2 <b>bo</b>ld<br/>next<!-- no --><a href='/x?a=1&amp;b=2'>L</a><A HREF=y>M</A><style>p{}</style>&nbsp;end"
    text, title, links, charset = warc.read_html(page)
    assert (text, title, links, charset) == ("A & B\n1 < 2 bold\nnextLM end", "A & B", ["/x?a=1&b=2", "y"], None)
    for broken in ("", "<", "<a", "a<!-- b", "a<script>b", "<" * 3000, "<!--" * 30000, "a</", "<p", "&#99999999; &"):
        assert isinstance(warc.read_html(broken)[0], str)


def test_query_over_the_table(spark):
    folder = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = QUERIES["op8_warc_derivatives"](spark, folder).collect()
    assert len(rows) == 2 * len(pages) and len({r.record_id for r in rows}) == len(rows)
    conversions = {r.page_id: r for r in rows if r.record_type == "conversion"}
    for r in rows:
        page = pages[r.page_id]
        assert r.target_uri == page.url and r.payload_digest == sha1(page.html.encode()) and r.block_digest == sha1(r.block.encode())
        assert r.content_length == len(r.block.encode()) and r.refers_to == conversions[r.page_id].refers_to
        if r.record_type == "conversion":
            assert r.block == plain_text(page.html), r.page_id
        else:
            assert f"conversion: {conversions[r.page_id].record_id}\r\n" in r.block


def test_odd_rows_and_kept_headers(spark):
    rows = [(1, "<urn:uuid:x>", "http://a/b/", "2024-05-01T00:00:00Z", {"Server": "s", "ETag": "1"}, "<a href='../c'>t</a>", 0), (2, None, None, None, None, None, 0), (2, None, None, None, None, None, 0), (3, None, "http://a", None, {}, "<p>" * 40000 + "<a href='http://[bad'>z", 0)]
    source = spark.createDataFrame(rows, "page_id int, record_id string, target_uri string, date string, headers map<string,string>, text string, block int")
    got = warc.derive(source).withColumn("record", warc.serialized()).collect()
    assert len(got) == 8
    one = {r.record_type: r for r in got if r.page_id == 1}
    assert all(r.refers_to == "<urn:uuid:x>" and r.source_headers == {"Server": "s", "ETag": "1"} and r.date == "2024-05-01T00:00:00Z" for r in one.values())
    assert "outlink: http://a/c\r\n" in one["metadata"].block and one["conversion"].block == "t"
    head, block = one["conversion"].record.split("\r\n\r\n", 1)
    assert head.startswith("WARC/1.1\r\n") and "WARC-Refers-To: <urn:uuid:x>" in head and block == "t\r\n\r\n"
    assert {r.block for r in got if r.page_id == 2 and r.record_type == "conversion"} == {""}
    assert warc.derive(source.where("false")).count() == 0
