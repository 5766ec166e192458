import base64
import gzip
import hashlib
import zlib
from collections import Counter
from html.parser import HTMLParser

from codeloom.llm import warc_derive as D
from codeloom.llm.queries import op10_warc_derivatives

BREAKS = "address article aside blockquote br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split()


class Visible(HTMLParser):
    """Text, title and links by the standard parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden, self.title, self.in_title, self.links = [], 0, None, False, 0

    def handle_starttag(self, tag, attrs):
        self.links += tag == "a" and any(k == "href" for k, _ in attrs)
        if tag in BREAKS:
            self.out.append("\n")
        if tag in ("script", "style", "noscript", "template", "title"):
            self.hidden += 1
            self.out.append(" ")
            self.in_title = tag == "title" and self.title is None

    def handle_endtag(self, tag):
        if tag in BREAKS:
            self.out.append("\n")
        if tag in ("script", "style", "noscript", "template", "title"):
            self.hidden -= 1
            self.in_title = False

    def handle_data(self, data):
        if self.in_title:
            self.title = (self.title or "") + data
        elif not self.hidden:
            self.out.append(data)


def by_parser(page):
    v = Visible()
    v.feed(page)
    v.close()
    lines = (" ".join(x.split()) for x in "".join(v.out).split("\n"))
    return "\n".join(x for x in lines if x), " ".join((v.title or "").split()), v.links


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def fields(text):
    return dict(line.split(": ", 1) for line in text.split("\r\n") if line)


def test_query_against_the_standard_parser(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op10_warc_derivatives(spark, sf).collect()
    assert len(rows) == 2 * len(pages) and len({r.record_id for r in rows}) == len(rows)
    for r in rows:
        page, head, block = pages[r.page_id], fields(r.header), r.block.encode()
        assert head["WARC-Block-Digest"] == sha1(block) == r.block_digest and int(head["Content-Length"]) == len(block) == r.content_length
        assert head["WARC-Target-URI"] == head["WARC-Refers-To-Target-URI"] == page.url and head["WARC-Refers-To"] == r.refers_to and head["WARC-Refers-To-Date"] == head["WARC-Date"]
        assert r.source_payload_digest == sha1(page.html.encode())
        text, title, links = by_parser(page.html)
        if r.warc_type == "conversion":
            assert r.block == text and head["WARC-Payload-Digest"] == sha1(block)
        else:
            said = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in r.block.split("\r\n") if line)
            assert (said["title"], int(said["outlinks"])) == (title, links)
            assert said["source-warc-record-id"] == r.refers_to and said["source-warc-payload-digest"] == said["payload-digest"] == sha1(page.html.encode())
            assert said["http-status"] == "HTTP/1.1 200 OK" and said["http-content-type"] == "text/html; charset=utf-8" and said["cut-off"] == "false"
    assert all(len({x.refers_to for x in rows if x.page_id == p}) == 1 for p in list(pages)[:50])


def record(head, body, **warc):
    block = head.encode() + b"\r\n\r\n" + body
    named = {"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:1>", "WARC-Date": "2020-01-02T03:04:05Z", "WARC-Target-URI": "http://a.example/x"} | {k.replace("_", "-"): v for k, v in warc.items()}
    return [*named.items(), ("Content-Length", str(len(block)))], block


def one(head, body, **warc):
    found = [r for stretch in D.inflated(D.member(*record(head, body, **warc))) for s in D.records_of(stretch) for r in D.derive(s)]
    return {r["warc_type"]: r for r in found}


def test_headers_transfers_and_character_sets():
    got = one("HTTP/1.1 404 Not Found\r\nServer: x\r\nX-Long: a\r\n  b\r\nContent-Type: text/html; charset=ISO-8859-1", "<p>Grün</p>".encode("latin-1"), WARC_IP_Address="10.0.0.1", WARC_Warcinfo_ID="<urn:uuid:9>", WARC_Truncated="length", WARC_Payload_Digest="sha1:WRONG")
    assert got["conversion"]["block"].decode() == "Grün"
    said = got["metadata"]["block"].decode()
    for line in ("http-status: HTTP/1.1 404 Not Found", "http-server: x", "http-x-long: a b", "source-warc-ip-address: 10.0.0.1", "cut-off: true", "payload-digest-agrees: false", "source-warc-payload-digest: sha1:WRONG"):
        assert line + "\r\n" in said
    assert ("WARC-Warcinfo-ID", "<urn:uuid:9>") in got["metadata"]["headers"] and got["conversion"]["refers_to"] == "<urn:uuid:1>"
    assert got["conversion"]["source_payload_digest"] == "sha1:WRONG" and ("WARC-Refers-To-Date", "2020-01-02T03:04:05Z") in got["conversion"]["headers"]
    page = "<title>T</title><p>eins</p><p>zwei</p>".encode()
    chunked = b"".join(b"%x;x=y\r\n%s\r\n" % (len(page[i : i + 7]), page[i : i + 7]) for i in range(0, len(page), 7)) + b"0\r\n\r\n"
    for head, body in (("Transfer-Encoding: chunked", chunked), ("Content-Encoding: gzip", gzip.compress(page)), ("Content-Encoding: deflate", zlib.compress(page)), ("Content-Encoding: deflate", zlib.compress(page)[2:-4]), ("X: y", page)):
        got = one(f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n{head}", body)
        assert got["conversion"]["block"] == b"eins\nzwei", head
        assert f"payload-digest: {sha1(page)}" in got["metadata"]["block"].decode()
    assert one("HTTP/1.1 200 OK\r\nContent-Type: text/html", b'<meta charset="cp1251"><p>' + "мир".encode("cp1251"))["conversion"]["block"].decode() == "мир"
    assert list(one("HTTP/1.1 200 OK\r\nContent-Type: image/png", b"\x89PNG")) == ["metadata"]
    assert one("HTTP/1.1 200 OK\r\nContent-Type: text/plain", b"a <b>\nc")["conversion"]["block"] == b"a <b>\nc"
    assert one("HTTP/1.1 200 OK", b"x", WARC_Type="request") == {}


def test_files_are_read_and_written(spark, tmp_path):
    info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:uuid:0>"), ("Content-Length", "3")], b"a:b"
    some = [record("HTTP/1.1 200 OK\r\nContent-Type: text/html", f"<p>page {i}</p>".encode(), WARC_Record_ID=f"<urn:uuid:{i}>") for i in range(700)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(D.member(*r) for r in [info, *some[:600]]))
    (tmp_path / "b.warc").write_bytes(b"".join(D.serialize(*r) for r in some[600:]))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"no record"))
    (tmp_path / "d.warc.gz").write_bytes(D.member(*some[0])[:40])
    members = D.read_warc(spark, str(tmp_path))
    assert Counter(r.file.rpartition("/")[2] for r in members.select("file").collect())["a.warc.gz"] == 601
    rows = D.derivatives(members).collect()
    texts = Counter(r.block for r in rows if r.warc_type == "conversion")
    assert set(texts) >= {f"page {i}" for i in range(700)} and sum(r.warc_type == "metadata" for r in rows) >= 700
    whole = D.warc_file([r.asDict() for r in rows[:10]])
    back = [r for stretch in D.inflated(whole) for r in D.records_of(stretch)]
    assert [(r.get("WARC-Record-ID"), r.block.decode()) for r in back] == [(r.record_id, r.block) for r in rows[:10]] and not any(r.cut for r in back)


def test_odd_rows(spark):
    pages = [(1, "u", None), (1, "u", None), (2, None, ""), (3, "u\n v", "<"), (None, None, None), (5, "u", "<p>" + "w " * 200_000), (6, "u", "日本 \x00 é")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' as block", "'y' as member", "'z' as header")
    rows = D.of_pages(df).collect()
    assert len(rows) == 14 and D.of_pages(df.limit(0)).count() == 0
    assert len({r.record_id for r in rows if r.page_id == 1}) == 2
    assert {r.block for r in rows if r.page_id in (1, 2) and r.warc_type == "conversion"} == {""}
    assert all("WARC-Target-URI" not in r.header for r in rows if r.url is None) and any("WARC-Target-URI: u v" in r.header for r in rows)
    assert next(len(r.block) for r in rows if r.page_id == 5 and r.warc_type == "conversion") == 399_999
    junk = spark.createDataFrame([(None,), (bytearray(b""),), (bytearray(b"WARC/1.1"),), (bytearray(b"\x1f\x8b\x08bad"),)], "member binary")
    assert D.derivatives(junk).count() == 0
