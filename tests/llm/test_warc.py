import gzip
import hashlib
import html
import re
import time

from pyspark.sql import functions as F

from kinesieve.llm import warc
from tests.conftest import TINY

RESPONSES = "record_id string, target_uri string, date string, http_headers string, payload string"


def derived(spark, rows, schema=RESPONSES):
    return {(r.refers_to, r.type): r for r in warc.derive(spark.createDataFrame(rows, schema)).collect()}


def test_text(spark):
    page = '<!DOCTYPE html><HTML lang="en"><head><title>A &amp; B</title><style>p{}</style></head><body data-x="a>b"><!-- <p>no</p> --><p>One&nbsp;  two</p>three<br/>&#233;&#x4E2d; &lt;b&gt; &unknown; &amp;amp; <script>var t="</p>";</script><b>bo</b>ld <a href=x>y</a></body></html>'
    r = derived(spark, [("<urn:uuid:1>", "http://a/", "2020-01-01T00:00:00Z", "Content-Type: text/html\r\nServer: x", page)])
    text, meta = r["<urn:uuid:1>", "conversion"], r["<urn:uuid:1>", "metadata"]
    assert text.block == "One two\nthree\né中 <b> &unknown; &amp; bold y"
    assert "title: A & B\r\n" in meta.block and "source-header: Server: x\r\n" in meta.block and "html-lang: en\r\n" in meta.block and "outlinks: 1\r\n" in meta.block
    assert text.source_digest == "sha256:" + hashlib.sha256(page.encode()).hexdigest()
    assert text.block_digest == "sha256:" + hashlib.sha256(text.block.encode()).hexdigest()
    assert text.content_length == len(text.block.encode()) and text.record_id != meta.record_id
    assert "WARC-Refers-To: <urn:uuid:1>\r\n" in text.headers and "WARC-Target-URI: http://a/\r\n" in text.headers


def test_odd_rows(spark):
    rows = [("<a>", None, None, None, None), ("<b>", "u", "d", "", ""), (None, "u", None, "X: y", "&#xD800; &#0; <p"), ("<c>", "u", "d", None, "word " * 50_000), ("<c>", "u", "d", None, "word " * 50_000)]
    got = warc.derive(spark.createDataFrame([(*r, 3) for r in rows], RESPONSES + ", type int")).collect()
    assert len(got) == 10
    assert [r.block for r in got if r.type == "conversion"][:3] == ["", "", "&#xD800; &#0; <p"]
    assert "WARC-Target-URI" not in got[0].headers and "WARC-Refers-To" not in got[4].headers
    assert warc.derive(spark.createDataFrame([], RESPONSES)).collect() == []


def test_pages_against_plain_python(spark):
    pages = spark.read.parquet(f"{TINY}/pages.parquet")
    got = warc.derive(warc.responses_of(pages), keep=("page_id",)).filter("type = 'conversion'").collect()
    source = {r.page_id: r.html for r in pages.collect()}
    for r in got:
        t = re.sub(r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<head.*?</head>", " ", source[r.page_id])
        plain = html.unescape(re.sub(r"<[^>]*>", " ", t))
        assert re.sub(r"\s", "", plain) == re.sub(r"\s", "", r.block)


def test_round_trip(spark, tmp_path):
    records = warc.derive(warc.responses_of(spark.read.parquet(f"{TINY}/pages.parquet").limit(20)))
    members = warc.serialise(records).collect()
    (tmp_path / "a.warc.gz").write_bytes(b"".join(bytes(m.member) for m in members[:15]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(bytes(m.member) for m in members[15:]))
    (tmp_path / "c.warc").write_bytes(b"".join(gzip.decompress(bytes(m.member)) for m in members[:3]))
    back = warc.read_records(spark, str(tmp_path))
    expected = sorted((r.type, r.record_id, r.refers_to, r.target_uri, r.block) for r in records.collect())
    got = sorted((r.type, r.record_id, r.refers_to, r.target_uri, bytes(r.block).decode()) for r in back.filter(F.col("path").endswith("gz")).collect())
    assert got == expected and back.count() == len(members) + 3


def test_http_responses(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hi</p>"
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:9>\r\nWARC-Target-URI: http://b/\r\nWARC-Date: 2021-01-01T00:00:00Z\r\nContent-Length: {len(body)}\r\n\r\n"
    (tmp_path / "x.warc").write_bytes(head.encode() + body + b"\r\n\r\n")
    rows = warc.derive(warc.response_rows(warc.read_records(spark, str(tmp_path)))).collect()
    assert {r.type: r.block for r in rows}["conversion"] == "hi" and rows[0].refers_to == "<urn:uuid:9>"
    assert "source-header: Content-Type: text/html" in rows[0].block


def test_source_bytes_and_digests(spark, tmp_path):
    page = "<title>Café</title><p>déjà vu</p>"
    zipped = gzip.compress(page.encode(), mtime=0)
    chunks = b"%x\r\n%s\r\n0\r\n\r\n" % (len(zipped), zipped)
    bodies = {
        "latin": ("Content-Type: text/html; charset=ISO-8859-1", page.encode("latin-1"), "Content"),
        "binary": ("Content-Type: image/png", bytes(range(128, 256)) + b"\r\n\r\n\x00\xff", None),
        "gzip": ("Content-Type: text/html\r\nContent-Encoding: gzip", zipped, None),
        "chunked": ("Content-Encoding: gzip\r\nTransfer-Encoding: chunked", chunks, None),
        "broken": ("Content-Type: text/html; charset=no-such\r\nContent-Encoding: gzip", b"<p>a\xffb</p>", None),
    }
    out = b""
    for name, (head, body, declared) in bodies.items():
        block = f"HTTP/1.1 200 OK\r\n{head}\r\n\r\n".encode() + body
        digests = "WARC-Payload-Digest: sha1:ABC\r\nWARC-Block-Digest: sha1:DEF\r\n" if declared else ""
        out += f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <{name}>\r\n{digests}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    (tmp_path / "x.warc").write_bytes(out)
    got = {(r.refers_to.strip("<>"), r.type): r for r in warc.derive(warc.response_rows(warc.read_records(spark, str(tmp_path)))).collect()}
    assert len(got) == 2 * len(bodies)
    for name, (_, body, declared) in bodies.items():
        own, meta = "sha256:" + hashlib.sha256(body).hexdigest(), got[name, "metadata"]
        assert meta.source_digest == ("sha1:ABC" if declared else own)
        assert f"source-content-length: {len(body)}\r\n" in meta.block and own in meta.block
        assert ("source-block-digest: sha1:DEF\r\n" in meta.block) == bool(declared)
    assert all(got[x, "conversion"].block == "Café\ndéjà vu" and "title: Café\r\n" in got[x, "metadata"].block for x in ("latin", "gzip", "chunked"))
    assert got["broken", "conversion"].block == "a\ufffdb"


def test_tag_with_very_many_attributes(spark):
    many = " ".join(f"a{i}='{i}>'" for i in range(200_000))
    pages = [(1, "u", f"<p>before</p><b {many}>in</b><div {many}>after</div>"), (2, "u", "x <a " + "\"q\" " * 200_000), (3, "u", "<i" + "'" * 200_001)]
    rows = warc.derive(warc.responses_of(spark.createDataFrame(pages, "page_id long, url string, html string")), keep=("page_id",)).filter("type = 'conversion'")
    got = {r.page_id: r.block for r in rows.collect()}
    assert got[1] == "before\nin\nafter"
    assert got[2].startswith("x <a \"q\"") and got[3].startswith("<i'")


def test_many_members(tmp_path):
    """Gzip members one after another, plain records, and blank lines between them."""
    import gzip
    import time

    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    begin = time.time()
    got = list(warc.parse_members(gzip.compress(one) * 20_000))
    assert len(got) == 20_000 and all(x == ({"warc-type": "response", "content-length": "5"}, b"hello") for x in got)
    assert len(list(warc.parse_members(one * 20_000 + b"\r\n" + one))) == 20_001
    assert list(warc.parse_members(b"")) == [] and time.time() - begin < 60


def test_unclosed_openers_take_linear_time(spark):
    """A megabyte of openers that nothing closes, and each text's own ending kept."""
    rows = [(i, opener * (1_000_000 // len(opener)) + "<p>end</p>" * (i % 2)) for i, opener in enumerate(["<!-- ", "<script> ", "<style ", "<b ", "<title>", "<a ", "<html ", "<svg>x"])]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit("u"))
    begin = time.time()
    out = warc.derive(warc.responses_of(df), keep=("page_id",)).filter("type = 'conversion'").collect()
    assert len(out) == len(rows) and time.time() - begin < 90
    assert all(r.block.endswith("end") for r in out if r.page_id % 2)


def test_long_pages_as_short_ones(spark):
    """What comes before and after the last closer is the same by both ways."""
    parts = ["<!-- a -->x", "<script src='>'>y</script>z", "<style>q</STYLE >", "<b title='>'>bold</b>", "<title>t</title>", "<p>one<p>two", "<head>h<script>'</head>'</script></head>", "<!-- open", "<svg>", "5 < 6 > 4", "<a href=x>l</a>", "<a name=x", "&lt;"]
    rows = [(i, "".join(parts[(i * k + k * k) % len(parts)] for k in range(1 + i % 9))) for i in range(120)]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit("u"))
    take = lambda: {(r.page_id, r.type): r.block for r in warc.derive(warc.responses_of(df), keep=("page_id",)).collect()}
    short, warc.LONG = take(), 0
    try:
        assert take() == short
    finally:
        warc.LONG = 1 << 14
