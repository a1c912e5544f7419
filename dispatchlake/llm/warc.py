"""Derivatives of web archive responses: metadata and plain-text conversion records."""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchlake.llm.common import map_slices

#: Names under which record ids are made, one for each record type.
_NAMES = {kind: uuid.uuid5(uuid.NAMESPACE_URL, f"dispatchlake:warc:{kind}") for kind in ("response", "metadata", "conversion")}

#: Elements whose content is not text, and elements that begin a line.
UNSEEN = ("script", "style", "noscript", "template", "svg")
BLOCKS = {"address", "article", "aside", "blockquote", "br", "caption", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "option", "p", "pre", "section", "table", "td", "th", "title", "tr", "ul"}

_TAG = re.compile(r"/?([A-Za-z][A-Za-z0-9:-]*)")
_END = {name: re.compile(f"</{name}", re.I) for name in UNSEEN}
_HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CHARSET = re.compile(r"""charset\s*=\s*["']?([A-Za-z0-9_-]+)""", re.I)
_BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, key: str) -> str:
    """The same id for the same key, whenever the records are made."""
    return f"<urn:uuid:{uuid.uuid5(_NAMES[kind], key)}>"


def read_html(page: str) -> tuple[str, str | None, list[str], str | None]:
    """Text, title, link targets as written, and declared character set of a page, in one pass.

    A comment, element or tag that is never closed takes the rest of the page.
    """
    pieces: list[str] = []
    links: list[str] = []
    title = charset = None
    at = 0
    title_from: int | None = None
    while True:
        less = page.find("<", at)
        if less < 0:
            pieces.append(page[at:])
            break
        pieces.append(page[at:less])
        if page.startswith("<!--", less):
            end = page.find("-->", less + 4)
            if end < 0:
                break
            at = end + 3
            continue
        name = _TAG.match(page, less + 1)
        if name is None and page[less + 1 : less + 2] not in ("!", "?", "/"):
            pieces.append("<")  # a sign, not a tag
            at = less + 1
            continue
        more = page.find(">", less)
        if more < 0:
            break
        at = more + 1
        if name is None:
            continue
        element, closing = name[1].lower(), page[less + 1] == "/"
        if element in BLOCKS:
            pieces.append("\n")
        if element == "title":
            if not closing:
                title_from = len(pieces)
            elif title_from is not None and title is None:
                title = " ".join(html.unescape("".join(pieces[title_from:])).split())
        elif element == "a" and not closing:
            href = _HREF.search(page, less, more)
            if href:
                links.append(html.unescape(next(g for g in href.groups() if g is not None)).strip())
        elif element == "meta" and charset is None:
            found = _CHARSET.search(page, less, more)
            charset = found[1].lower() if found else None
        if element in UNSEEN and not closing and page[more - 1] != "/":
            end = _END[element].search(page, at)
            if end is None:
                break
            at = end.start()
    lines = (_BLANKS.sub(" ", line).strip() for line in html.unescape("".join(pieces)).split("\n"))
    return "\n".join(line for line in lines if line), title, links, charset


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of pages: what ``derive`` takes.

    A table of pages keeps no headers and no time; the headers are the type and
    length of the content, the time is ``date``.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    return pages.select(
        F.col(id_col).alias("page_id"),
        F.lit(None).cast("string").alias("record_id"),
        F.col(url_col).alias("target_uri"),
        F.lit(date).alias("date"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=utf-8"), F.lit("Content-Length"), F.length(payload).cast("string")).alias("headers"),
        F.col(html_col).alias("text"),
    )


FIELDS = "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, headers map<string,string>, source_headers map<string,string>, payload_digest string, block_digest string, content_length long, block string"


def derive(source: DataFrame) -> DataFrame:
    """A metadata record and a conversion record of every response.

    ``source``: ``page_id``, ``record_id`` (null: made from id and address),
    ``target_uri``, ``date``, ``headers`` and ``text``, the payload. Both
    derivatives name the response in ``refers_to`` and keep its address, date,
    headers (``source_headers``) and payload digest; ``headers`` are their own
    named fields, with the digest of the block. The metadata record lists title,
    character set, links and the conversion's id; the conversion is the plain
    text of the page.

    Defined results: a null payload is empty and its text too; a null address
    stays null and links are kept as written; repeated rows give repeated
    records with the same ids; other columns are not read; an empty table gives
    an empty result.
    """
    rows = source.select("page_id", "record_id", "target_uri", "date", F.map_entries("headers").alias("headers"), "text")
    kind = rows.schema["page_id"].dataType.simpleString()
    strings = pa.map_(pa.string(), pa.string())

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        index: list[int] = []
        made: list[tuple] = []
        for i, row in enumerate(batch.select(["page_id", "record_id", "target_uri", "date", "headers", "text"]).to_pylist()):
            page, url = row["text"] or "", row["target_uri"]
            key = f"{row['page_id']} {url}"
            origin = row["record_id"] or record_id("response", key)
            ids = {k: record_id(k, f"{key} {origin}") for k in ("metadata", "conversion")}
            source_headers = [(h["key"], h["value"]) for h in row["headers"] or []]
            payload = digest(page.encode())
            text, title, links, charset = read_html(page)
            targets = []
            for link in links:
                try:
                    targets.append(urljoin(url or "", link))
                except ValueError:
                    targets.append(link)
            fields = [("title", title), ("charset", charset), ("payload-digest", payload), ("conversion", ids["conversion"]), *(("outlink", t) for t in targets)]
            notes = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields if v)
            for record, content, block in (("metadata", "application/warc-fields", notes), ("conversion", "text/plain; charset=utf-8", text)):
                data = block.encode()
                own = [("WARC-Type", record), ("WARC-Record-ID", ids[record]), ("WARC-Refers-To", origin), ("WARC-Target-URI", url), ("WARC-Date", row["date"]), ("WARC-Block-Digest", digest(data)), ("Content-Type", content), ("Content-Length", str(len(data)))]
                index.append(i)
                made.append((record, ids[record], origin, url, row["date"], content, [h for h in own if h[1] is not None], source_headers, payload, digest(data), len(data), block))
        types = [pa.string()] * 6 + [strings, strings, pa.string(), pa.string(), pa.int64(), pa.string()]
        columns = [pa.array(c, t) for c, t in zip(zip(*made) if made else [[]] * 12, types)]
        names = ["page_id", *(f.split()[0] for f in FIELDS.split(", "))]
        return pa.RecordBatch.from_arrays([batch.column("page_id").take(pa.array(index, pa.int64())), *columns], names=names)

    return map_slices(rows, f"page_id {kind}, {FIELDS}", work)


def serialized() -> Column:
    """A whole record of ``derive`` as it stands in an archive: version, named fields, block, two line ends."""
    fields = F.array_join(F.transform(F.map_entries("headers"), lambda h: F.concat(h["key"], F.lit(": "), h["value"])), "\r\n")
    return F.concat(F.lit("WARC/1.1\r\n"), fields, F.lit("\r\n\r\n"), F.col("block"), F.lit("\r\n\r\n"))
